"""Exact duplicates by composable polynomial fingerprints and a chunkwise streaming comparison.

A text is a polynomial of its UTF-8 bytes; its fingerprint is the value at a fixed base modulo three primes. Chunks of
``CHUNK`` bytes are hashed side by side and combine by H(XY) = H(X) * base^|Y| + H(Y), so a term of the sum needs only
its own bytes and the number of bytes behind it. Texts longer than ``HUGE`` are cut into pieces of that size which other
tasks hash; their terms add up in an ordinary sum.

Equal length and fingerprint make a group. Texts of groups with several rows are compared chunk by chunk: rows of a slice
first among themselves, then one carrier for each slice in sorted runs, by a salted and then by the plain key, with only
the head of the run in memory. A group with a difference is told apart by sha256.

The scan that brings the texts to the comparison leaves out most texts that have no partner by a bit table of ``WORDS``
words of 64 bits, whatever the number of groups; when it fills up, more texts are shuffled and nothing else changes.
Groups that hold over one ``HOT``-th of the rows are at most ``HOT`` and are broadcast, so no key of the join is hotter.

A null text is empty, and empty texts are equal. A null doc_id is smaller than any other; rows of equal doc_id and text
are folded with their number, and one of them stays. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainframe.llm import textscan as T
from trainframe.llm.store import shuffle_partitions, stored

CHUNK, HUGE = 1 << 14, 8 << 20
WORDS, SALTS, HOT = 1 << 20, 64, 1000
#: Primes below 2^31, so that products of two residues fit 64 bits, and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (1103515245, 1664525, 1366127081)
KEY = ["n_bytes", "fp"]


def powers(base: int, exponents: np.ndarray, prime: int) -> np.ndarray:
    """base ** exponents modulo the prime, by squaring."""
    out, square, left = np.ones(len(exponents), np.uint64), np.uint64(base % prime), exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & T.U(1), out * square % T.U(prime), out)
        square = square * square % T.U(prime)
        left = left >> T.U(1)
    return out


_TABLES: dict[tuple[int, int], np.ndarray] = {}


def _table(prime: int, base: int) -> np.ndarray:
    if (prime, base) not in _TABLES:
        _TABLES[prime, base] = powers(base, np.arange(CHUNK), prime)
    return _TABLES[prime, base]


def terms(data: np.ndarray, offs: np.ndarray, behind: np.ndarray, primes: tuple[int, ...] = PRIMES) -> np.ndarray:
    """Terms of the given byte strings, each followed by so many bytes of its text: one row for each prime.

    The term of a whole text (nothing behind) is its fingerprint.
    """
    size = np.diff(offs)
    per = -(-size // CHUNK)
    row = np.repeat(np.arange(len(size)), per)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    start = offs[row] + nth * CHUNK
    end = np.minimum(start + CHUNK, offs[row + 1])
    power = np.repeat(end - offs[0] - 1, end - start) - np.arange(len(data))
    out = np.zeros((len(primes), len(size)), np.uint64)
    if len(row):
        after = offs[row + 1] - end + behind[row]
        for k, (prime, base) in enumerate(zip(primes, BASES, strict=False)):
            p = T.U(prime)
            chunks = np.add.reduceat(data * _table(prime, base)[power], start - offs[0]) % p
            parts = chunks * powers(base, after, prime) % p
            np.add.at(out[k], row, parts)
        out %= np.array(primes, np.uint64)[:, None]
    return out


def _packed(found: np.ndarray) -> pa.Array:
    """Residues of each string as one byte string."""
    width = 4 * len(found)
    raw = np.ascontiguousarray(found.T.astype(">u4")).tobytes()
    return pa.array([raw[i : i + width] for i in range(0, len(raw), width)], pa.binary())


def fingerprints(docs: DataFrame, primes: tuple[int, ...] = PRIMES, huge: int = HUGE) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_bytes, sha, fp) of every row, and (n_bytes, fp, at, piece) of the texts over ``huge`` bytes."""
    names = ["doc_id", "n_bytes", "sha", "fp", "row", "at", "piece"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in T.slices(batch, "text"):
                data, offs = T.flat(part.column("text"))
                size = np.diff(offs)
                for r in np.flatnonzero(size > huge):
                    head = [part.column(0).slice(r, 1), pa.array(size[r : r + 1]), part.column(2).slice(r, 1), pa.nulls(1, pa.binary()), pa.array([row])]
                    for i, a in enumerate(range(offs[r], offs[r + 1], huge)):
                        piece = pa.array([data[a : min(a + huge, offs[r + 1])].tobytes()], pa.binary())
                        yield pa.RecordBatch.from_arrays([*head, pa.array([i]), piece], names)
                    row += 1
                small = np.flatnonzero(size <= huge)
                if len(small) < len(size):
                    part = part.take(pa.array(small))
                    data, offs = T.flat(part.column("text"))
                n = part.num_rows
                fp = _packed(terms(data, offs, np.zeros(n, np.int64), primes))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offs)), part.column(2), fp, *(pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.binary()))], names)

    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2(text.cast("binary"), 256).alias("sha"))
    found = stored(rows.mapInArrow(run, "doc_id long, n_bytes long, sha string, fp binary, row long, at long, piece binary"), "fingerprints")

    def piece_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "piece"):
                data, offs = T.flat(part.column("piece"))
                behind = part.column("n_bytes").to_numpy() - part.column("at").to_numpy() * huge - np.diff(offs)
                got = terms(data, offs, behind, primes).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("row"), *(pa.array(t) for t in got)], ["row", *cols])

    cols = [f"t{k}" for k in range(len(primes))]
    pieces = found.where("piece is not null")
    spread = pieces.select("row", "n_bytes", "at", "piece").repartition(shuffle_partitions(docs), "row", "at")
    sums = spread.mapInArrow(piece_terms, "row long, " + ", ".join(f"{c} long" for c in cols)).groupBy("row").agg(*(F.sum(c).alias(c) for c in cols))
    whole = sums.select("row", F.concat(*(F.unhex(F.lpad(F.hex(F.col(c) % p), 8, "0")) for c, p in zip(cols, primes, strict=True))).alias("fp"))
    heads = found.where("at = 0").select("row", "doc_id", "n_bytes", "sha").join(whole, "row").drop("row")
    rows = found.where("fp is not null").select("doc_id", "n_bytes", "sha", "fp").unionByName(heads)
    return rows, pieces.select("row", "n_bytes", "at", "piece").join(whole, "row").select(*KEY, "at", "piece")


def bit_table(groups: DataFrame) -> np.ndarray:
    """Bits of the fingerprints of groups with several rows, in WORDS words however many groups there are."""
    low = groups.where("rows > 1 and n_bytes > 0").select(F.conv(F.hex(F.substring("fp", 1, 4)), 16, 10).cast("long").alias("low"))
    bits = low.selectExpr(f"low % {WORDS} as word", f"shiftleft(1L, int(low div {WORDS} % 64)) as bit")
    got = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(WORDS, np.int64)
    table[got.column("word").to_numpy()] = got.column("bits").to_numpy()
    return table.view(np.uint64)


def carriers(docs: DataFrame, table: np.ndarray, primes: tuple[int, ...], huge: int) -> DataFrame:
    """Chunks (n_bytes, fp, at, piece) of the texts whose bit is set: in each slice one of every distinct text."""
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for part in T.slices(batch, "text"):
                data, offs = T.flat(part.column("text"))
                size = np.diff(offs)
                found = terms(data, offs, np.zeros(len(size), np.int64), primes)
                low = found[0]
                hit = (bits[(low % T.U(WORDS)).astype(np.int64)] >> (low // T.U(WORDS) % T.U(64)) & T.U(1)).astype(bool) & (size > 0) & (size <= huge)  # pieces of longer ones are stored already
                rows = np.flatnonzero(hit)
                if not len(rows):
                    continue
                fps = _packed(found[:, rows])
                seen = {(fps[i].as_py(), data[offs[r] : offs[r + 1]].tobytes()): None for i, r in enumerate(rows)}
                cut = [(len(text), fp, at, text[at * CHUNK : (at + 1) * CHUNK]) for fp, text in seen for at in range(-(-len(text) // CHUNK))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*cut, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], [*KEY, "at", "piece"])

    return docs.select("text").mapInArrow(run, "n_bytes long, fp binary, at long, piece binary")


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In a sorted run: the head of each key, and whether a later piece of the key differs from it."""
    names, head = [*KEY, "at", "piece", "differs"], None
    for batch in batches:
        out = []
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if head is None or head[:3] != row[:3]:
                if head is not None:
                    out.append(head)
                head = row
            elif row[4] or (row[3] != head[3] and not head[4]):
                head = (*head[:4], True)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema=_HEADS)
    if head is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, head, strict=True))], schema=_HEADS)


_HEADS = pa.schema([("n_bytes", pa.int64()), ("fp", pa.binary()), ("at", pa.int64()), ("piece", pa.binary()), ("differs", pa.bool_())])


def differing(chunks: DataFrame) -> DataFrame:
    """Keys (n_bytes, fp) of groups in which some chunk is not the same in all texts."""
    n, schema = shuffle_partitions(chunks), "n_bytes long, fp binary, at long, piece binary, differs boolean"
    runs = chunks.withColumn("differs", F.lit(False)).withColumn("salt", F.spark_partition_id() % SALTS)
    for keys in ([*KEY, "at", "salt"], [*KEY, "at"]):
        runs = runs.repartition(n, *keys).sortWithinPartitions(*keys).select(*KEY, "at", "piece", "differs", *keys[3:])
        runs = runs.select(*KEY, "at", "piece", "differs").mapInArrow(_compared, schema)
    return runs.where("differs").select(*KEY).distinct()


def exact_duplicates(docs: DataFrame, primes: tuple[int, ...] = PRIMES, huge: int = HUGE) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row; of equal texts the largest doc_id stays."""
    rows, pieces = fingerprints(docs, primes, huge)
    folded = stored(rows.groupBy(*KEY, "doc_id", "sha").agg(F.count("*").alias("m")), "folded")
    groups = folded.groupBy(*KEY).agg(F.sum("m").alias("rows"))
    chunks = carriers(docs, bit_table(groups), primes, huge).unionByName(pieces)
    bad = stored(differing(chunks), "differing")
    sure = folded.withColumn("kind", F.lit(""))
    if not bad.isEmpty():
        told = folded.join(bad.withColumn("told", F.lit(True)), KEY, "left")
        sure = told.withColumn("kind", F.when(F.col("told"), F.col("sha")).otherwise("")).drop("told")
    key = [*KEY, "kind"]
    groups = stored(sure.groupBy(*key).agg(F.max("doc_id").alias("keep_id"), F.sum("m").alias("group_size"), F.count("*").alias("parts")), "groups")
    most = max(1, folded.count() // HOT)  # fewer than HOT groups have more rows
    hot = F.broadcast(groups.where(F.col("parts") > most))
    met = sure.join(hot, key).unionByName(sure.join(hot.select(*key), key, "left_anti").join(groups.where(F.col("parts") <= most), key))
    last = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    each = met.select("doc_id", "keep_id", "group_size", last.alias("last"), "sha", F.explode(F.sequence(F.lit(1).cast("long"), "m")).alias("copy"))
    return each.select("doc_id", "keep_id", "group_size", (F.col("last") & (F.col("copy") == 1)).alias("kept"), F.col("sha").alias("text_sha256"))
