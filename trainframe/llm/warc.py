"""WARC archives with an index: record heads first, then sorted byte-range reads.

Writing: of records with equal payloads of at least ``LEAST`` bytes the one with the smallest page_id is a response,
the others are revisits without payload; smaller payloads are always responses. Each task writes archives of its own,
every record a gzip member, and returns the index rows (file, offset, length, URL, digest), which Spark commits as one
table. Archives that no index row names are remains of lost attempts and are never read. Reading: index rows of the
selected records are sorted by file and offset, neighbours closer than ``GAP`` bytes are fetched in one read.

Archives are opened through pyarrow's file systems, so the folder may be local and shared, HDFS, S3 or the like.
Null html is an empty payload, a null URL an empty field, line breaks in URLs are percent-encoded. Rows with equal
page_id keep one record each; where they have equal payloads too, all are responses or all revisit the same page.
Rows with a null page_id are written as responses.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainframe.llm.store import stored
from trainframe.session import scratch

LEAST = 100
GAP = 64 << 10
READ_BYTES = 8 << 20
ROLL_BYTES = 256 << 20
INDEX = "page_id long, url string, payload_digest string, file string, offset long, length long, record_type string, refers_to long, row long"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def revisits(pages: DataFrame) -> DataFrame:
    """page_id, digest and refers_to of the rows whose payload a smaller page_id has."""
    payload = F.coalesce("html", F.lit(""))
    marks = stored(pages.where("page_id is not null").where(F.octet_length(payload) >= LEAST).select(F.col("page_id").cast("long"), F.sha2(payload, 256).alias("digest")), "digests")
    firsts = marks.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last"))
    return marks.distinct().join(firsts.where("last > refers_to"), "digest").where("page_id > refers_to").select("page_id", "digest", "refers_to")


def head(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*lines, "Content-Type: text/html", f"Content-Length: {size if refers_to is None else 0}", "", ""]).encode()


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (in lower case) and content of one record."""
    top, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in top.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages as archives and return the index, which is stored beside them."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    again = revisits(pages)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html", F.sha2(F.coalesce("html", F.lit("")), 256).alias("own"))
    same = (F.col("page_id") == F.col("_id")) & (F.col("own") == F.col("digest"))
    rows = rows.join(again.withColumnRenamed("page_id", "_id"), same, "left").select("page_id", "url", "html", "own", "refers_to")
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _file_system(folder)
        out, name, at, row = None, "", 0, 0
        try:
            for batch in batches:
                index = []
                for page, url, html, digest, refers in zip(*(batch.column(i) for i in range(5)), strict=True):
                    payload, own, to = (html.as_py() or "").encode(), digest.as_py(), refers.as_py()
                    record = gzip.compress(head(page.as_py(), url.as_py(), own, len(payload), to) + (payload if to is None else b"") + b"\r\n\r\n", 4, mtime=0)
                    if out is None or at > ROLL_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"part-{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    out.write(record)
                    index.append((page.as_py(), url.as_py(), own, name, at, len(record), "response" if to is None else "revisit", to, row))
                    at += len(record)
                    row += 1
                cols = list(zip(*index, strict=True)) or [[]] * 9
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [f.split()[0] for f in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    path = f"{folder}/index"
    rows.mapInArrow(run, INDEX).write.parquet(path)
    return spark.read.schema(INDEX).parquet(path)


def coalesced(offsets: list[int], lengths: list[int], gap: int = GAP, most: int = READ_BYTES) -> list[tuple[int, int]]:
    """Byte ranges that cover sorted records; near ones share a range."""
    out: list[tuple[int, int]] = []
    for a, n in zip(offsets, lengths, strict=True):
        if out and a - out[-1][1] <= gap and a + n - out[-1][0] <= most:
            out[-1] = (out[-1][0], max(out[-1][1], a + n))
        else:
            out.append((a, a + n))
    return out


def read_records(selected: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """Fetch the records that index rows name: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A response's digest and size come from the payload that was read; a revisit's from its fields.
    """
    n = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    span = F.floor(F.col("offset") / READ_BYTES)
    ranges = selected.select("file", "offset", "length").repartition(n, "file", span).sortWithinPartitions("file", "offset")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]

    def number(urn: str | None) -> int | None:
        return int(urn[10:-1]) if urn and len(urn) > 11 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _file_system(folder)
        for batch in batches:
            named: dict[str, list[tuple[int, int]]] = {}
            for f, a, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                named.setdefault(f, []).append((a, k))
            for f, where in named.items():
                with files.open_input_file(f"{base}/{f}") as src:
                    at = 0
                    for lo, hi in coalesced([w[0] for w in where], [w[1] for w in where]):
                        raw, rows = src.read_at(hi - lo, lo), []
                        while at < len(where) and where[at][0] < hi:
                            a, k = where[at]
                            fields, payload = parse(zlib.decompress(raw[a - lo : a - lo + k], 31))
                            whole = fields["warc-type"] == "response"
                            rows.append((number(fields["warc-record-id"]), fields["warc-target-uri"], len(payload) if whole else int(fields["warc-payload-length"]), hashlib.sha256(payload).hexdigest() if whole else fields["warc-payload-digest"][7:], fields["warc-type"], number(fields.get("warc-refers-to")), payload.decode() if with_payload and whole else None))
                            at += 1
                        cols = list(zip(*rows, strict=True))
                        m = 7 if with_payload else 6
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:m], kinds[:m], strict=True)], names[:m])

    return ranges.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * with_payload)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page and read every record back through the index."""
    folder = scratch(pages.sparkSession, "warc")
    return read_records(write_archives(pages, folder), folder).drop("url")
