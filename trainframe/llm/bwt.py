"""Removal of repeated passages by interval expansion on Burrows-Wheeler transforms.

A byte goes when a string of ``LENGTH`` bytes over it also starts in a document with a smaller doc_id. Documents travel
as chunks of a few megabytes. (1) Each string has one minimizer, the smallest hash among its ``GRAM``-byte grams, so equal
strings have equal minimizers. Chunks send their distinct minimizers, packed, to buckets, and get back those that occur in more than one
document. (2) Strings with such a minimizer form runs of neighbouring strings; the runs go to groups by minimizer, equal
runs of a chunk once, with the smallest doc_id. (3) A string also holds half of the bytes that are left on the longer side of
its minimizer, and equal strings hold equal ones; strings that share these bytes with another run are open. Each group builds
the transform of its stretches of open strings and expands
intervals breadth first: the interval of c+w comes from that of w by one backward step, lengths rise by one a round and stop at LENGTH,
where the intervals left are the repeated strings; each yields its smallest doc_id. (4) Chunks get these back and cut the documents.

Grams of 16 bytes that documents share by chance grow faster than the input; the 33 bytes of (3) do so far less, and with them the text of the transforms.

A passage that a third of all documents hold counts once per chunk, so no key grows with it beyond the number of chunks.
Null texts are empty. Strings never cross documents. A null doc_id counts as larger than any other. Rows of equal doc_id
do not count as earlier than each other. Other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainframe.llm import textscan as T
from trainframe.llm.store import shuffle_partitions, stored
from trainframe.session import scratch

LENGTH, GRAM = 50, 16
CHUNK_BYTES = 4 << 20
GROUP_BYTES = 16 << 20
LAST = 2**63 - 1
SLICE_BYTES = 1 << 20
TRANSFORM_BYTES = 1 << 18
_BLOCK = 1 << 18


def minimizers(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> np.ndarray:
    """For each start of a string of ``length`` bytes the smallest hash of its grams, computed block by block."""
    n, w = len(data) - length + 1, length - gram + 1
    out = np.empty(max(n, 0), np.uint64)
    for lo in range(0, n, _BLOCK):
        v = gram_hashes(data[lo : min(lo + _BLOCK, n) + length - 1], gram)
        done = 1
        while done < w:
            step = min(done, w - done)
            v = np.minimum(v[:-step], v[step:])
            done += step
        out[lo : lo + len(v)] = v
    return out


def gram_hashes(part: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of the gram at each place."""
    h, size, total, shift = T.BYTE_CODES[part], 1, None, 0
    bits = gram
    while bits:  # hash of a gram from those of its power-of-two parts
        if bits & 1:
            total = h if total is None else total[: len(part)] * np.uint64(pow(T.MULT, size, 2**64)) + _at(h, shift, len(total))
            shift += size
        bits >>= 1
        if bits:
            h = h[:-size] * np.uint64(pow(T.MULT, size, 2**64)) + h[size:]
            size *= 2
    return T.mix(total[: len(part) - gram + 1]) >> np.uint64(8)  # seven bytes travel


def _at(h: np.ndarray, shift: int, n: int) -> np.ndarray:
    got = h[shift:]
    return np.concatenate([got, np.zeros(n - len(got), np.uint64)]) if len(got) < n else got[:n]


def parts_of(ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """First and last document (exclusive) and byte of parts of about ``SLICE_BYTES``; a longer document is a part of its own.

    The arrays of eight bytes for each byte that are worked with then stay small however large a chunk is.
    """
    at, lo = 0, 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, lo + SLICE_BYTES, "right")))
        yield at, to, lo, int(ends[to - 1])
        at, lo = to, int(ends[to - 1])


def run_hashes(data: np.ndarray, ends: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of the bytes of each run, part by part; ``first`` rises and no run goes beyond one of the ``ends``."""
    out = np.empty(len(first), np.uint64)
    for _, _, lo, hi in parts_of(ends):
        a, b = np.searchsorted(first, (lo, hi))
        out[a:b] = T.span_hash(data[lo:hi], first[a:b] - lo, first[a:b] + size[a:b] - lo)
    return out


def runs(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of neighbouring strings of one document and one minimizer: first start, count, minimizer, document."""
    got = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    for a, b, lo, hi in parts_of(ends):
        first, count, m, doc = _runs(data[lo:hi], ends[a:b] - lo, length)
        got.append((first + lo, count, m, doc + a))
    first, count, m, doc = (np.concatenate(g) for g in zip(*got, strict=True))
    return first, count, m, doc


def _runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    m = minimizers(data, length)
    if not len(m):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    good = np.ones(len(m), bool)
    for j in range(1, length):  # strings that would cross the end of a document
        at = ends - j
        good[at[(at >= 0) & (at < len(m))]] = False
    begin = np.zeros(len(m), bool)
    begin[0] = True
    begin[1:] = (m[1:] != m[:-1]) | (good[1:] != good[:-1])
    edge = ends[ends < len(m)]
    begin[edge] = True
    first = np.flatnonzero(begin)
    count = np.diff(np.append(first, len(m)))
    ok = good[first]
    first, count = first[ok], count[ok]
    return first, count, m[first], np.searchsorted(ends, first, "right")


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes sorted by their first ``depth`` symbols or more, and the rank of every suffix.

    Each pass sorts by as many neighbouring ranks of the one before, symbols at first, as fit one number.
    """
    n, k = len(text), 1
    used = np.bincount(text) > 0
    rank = np.cumsum(used)[text] if n else np.zeros(0, np.int64)
    while True:
        bits = max(int(rank.max(initial=1)).bit_length(), 1)
        take = min(63 // bits, -(-depth // k))
        key = np.zeros(n, np.int64)
        for j in range(0, take * k, k):
            key <<= bits
            key[: max(n - j, 0)] += rank[j:]
        order = _order(key, take * bits)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])[:n])
        k *= take
        if k >= depth or rank.max(initial=0) == n:
            return order, rank - 1


def _order(key: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of numbers of so many bits; each pass sorts as many of them as fit beside the place."""
    place = max(len(key) - 1, 1).bit_length()
    order = None
    for low in range(0, bits, 63 - place):
        part = (key >> low) & ((1 << 63 - place) - 1)
        part = part << place if order is None else part[order] << place
        part = np.sort(part + np.arange(len(key))) & ((1 << place) - 1)
        order = part if order is None else order[part]
    return order


def repeated(text: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Class of the string of ``length`` symbols at each position, by interval expansion on the transform.

    Positions of one class start equal strings. Symbol 0 parts texts and must not be inside a compared string.
    """
    n = len(text)
    order, _ = suffix_order(text, length)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    # following the transform: the suffix at slot i continues at slot after[i]; that inverts the backward step
    after = place[np.minimum(order + 1, n - 1)]
    symbol = text[order]
    border = np.ones(n + 1, bool)  # slot i begins an interval of the present length
    border[1:n] = symbol[1:] != symbol[:-1]
    open_ = np.flatnonzero(~border[:n])
    here, before, gone = after[open_], after[open_ - 1], 0
    for _ in range(1, length):  # intervals of c+w from those of w: both slots begin with c and continue in one interval of w
        interval = np.cumsum(border[:n], dtype=np.int32)
        parted = interval[here] != interval[before]
        if np.count_nonzero(parted) == gone:  # then no longer strings part them either
            break
        border[open_[parted]] = True
        gone = np.count_nonzero(parted)
        if 8 * gone > len(open_):
            open_, here, before, gone = open_[~parted], here[~parted], before[~parted], 0
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(border[:n]) - 1
    return out


def smallest(strings: np.ndarray, size: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For every start of a string in each run (runs of ``size`` bytes, one after another) the smallest doc_id that has it."""
    total = int(size.sum())
    to = np.cumsum(size)
    text = np.zeros(total + len(size), np.uint16)
    shift = np.repeat(np.arange(len(size)), size)
    text[np.arange(total) + shift] = strings.astype(np.uint16) + 1
    count = size - length + 1
    starts = np.repeat(to - size + np.arange(len(size)), count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    kind = repeated(text, length)[starts]
    least = np.full(int(kind.max(initial=-1)) + 1, LAST, np.int64)
    np.minimum.at(least, kind, np.repeat(docs, count))
    return least[kind]


def pieces(data: np.ndarray, size: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of runs of one minimizer each (runs of ``size`` bytes, one after another): strings, hash of the bytes they share, run; minimizer of each run.

    The strings of a piece have their first smallest gram at one place and half of their other bytes, at least, on one side of it.
    Their hash is that of the gram with this half, so equal strings of any runs are in pieces of equal hash.
    """
    got, least, half = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))], [np.zeros(0, np.uint64)], (length - gram) // 2
    for a, b, lo, hi in parts_of(np.cumsum(size)):
        part, own = data[lo:hi], size[a:b]
        to = np.cumsum(own)
        begin, count, n = to - own, own - length + 1, own - gram + 1
        at = np.arange(int(n.sum())) + np.repeat(begin - (np.cumsum(n) - n), n)  # grams do not cross runs
        v = gram_hashes(part, gram)[at]
        least.append(np.minimum.reduceat(v, np.cumsum(n) - n))
        hit = v == np.repeat(least[-1], n)
        places, nth = at[hit], np.cumsum(hit) - hit
        start = np.arange(int(count.sum())) + np.repeat(np.cumsum(n) - n - (np.cumsum(count) - count), count)
        place, start = places[nth[start]], at[start]
        right = place - start < half
        new = np.flatnonzero(np.diff(2 * place + right, prepend=-1))
        place, right = place[new], right[new]
        h = T.span_hash(part, np.where(right, place, place - half), np.where(right, place + gram + half, place + gram))
        got.append((np.diff(np.append(new, len(start))), h, a + np.searchsorted(to, start[new], "right")))
    count, h, run = (np.concatenate(g) for g in zip(*got, strict=True))
    return count, h, run, np.concatenate(least)


def earliest(data: np.ndarray, size: np.ndarray, docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """The same as ``smallest`` for distinct runs of one minimizer each.

    Only strings that may be in several runs enter a transform, and runs of different minimizers, which have no string in
    common, enter different ones of about ``TRANSFORM_BYTES``.
    """
    count = size - length + 1
    least = np.repeat(docs, count)
    strings, h, run, m = pieces(data, size, length)
    by = np.argsort(h, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], h[by][1:] != h[by][:-1]])[: len(h)])
    each = np.diff(np.append(first, len(h)))
    several = np.empty(len(h), bool)
    several[by] = np.repeat(run[by][first] != run[by][first + each - 1], each)
    pos = np.flatnonzero(np.repeat(several, strings))
    if not len(pos):
        return least
    run = np.repeat(np.arange(len(size)), count)[pos]
    head = np.flatnonzero(np.concatenate([[True], (pos[1:] != pos[:-1] + 1) | (run[1:] != run[:-1])]))
    run, first, k = run[head], pos[head], np.diff(np.append(head, len(pos)))
    many = int((k + length - 1).sum()) // TRANSFORM_BYTES + 1
    part = (T.mix(m[run]) >> np.uint64(32)) % np.uint64(many)
    by = np.argsort(part, kind="stable")
    for mine in np.split(by, np.flatnonzero(np.diff(part[by])) + 1):
        own, n = run[mine], k[mine]
        begin, size_ = first[mine] + own * (length - 1), n + length - 1
        least[_ranges(first[mine], n)] = smallest(data[_ranges(begin, size_)], size_, docs[own], length)
    return least


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, so many of each."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _binary(values: np.ndarray, to: np.ndarray) -> pa.Array:
    """A byte string of the values between each two neighbouring places."""
    return pa.Array.from_buffers(pa.binary(), len(to) - 1, [None, pa.py_buffer((to * values.itemsize).astype("<i4")), pa.py_buffer(np.ascontiguousarray(values))])


def _bits(flags: np.ndarray, to: np.ndarray) -> pa.Array:
    """The same of flags, eight a byte."""
    n = np.diff(to)
    full = np.concatenate([[0], np.cumsum(-(-n // 8))])
    out = np.zeros(8 * full[-1], bool)
    out[_ranges(8 * full[:-1], n)] = flags
    return _binary(np.packbits(out), full)


def _column(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    return T.flat(table.column(name).cast(pa.large_binary()).combine_chunks())


def _structs(cell: pa.Scalar, part: int) -> pa.Table:
    """The structs of a list that belong to a part."""
    if not cell.is_valid:
        return pa.table({"part": pa.array([], pa.int64())})
    table = pa.Table.from_batches([pa.RecordBatch.from_struct_array(cell.values)])
    return table.filter(pa.array(table.column("part").to_numpy() == part))


def chunks(docs: DataFrame) -> tuple[DataFrame, int, int]:
    """Documents packed in chunks, bucketed by chunk so that later joins do not move the texts again."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = shuffle_partitions(docs)
    count = max(2 * parts, int(total // CHUNK_BYTES) + 1)
    rows = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(count)).cast("int").alias("chunk"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of one chunk travel together and compressed."""
        for batch in batches:
            chunk = batch.column("chunk").to_numpy()
            order = np.argsort(chunk, kind="stable")
            at = np.flatnonzero(np.diff(chunk[order], prepend=-1))
            out = []
            for x, y in zip(at, np.append(at[1:], len(order)), strict=True):
                take = pa.array(order[x:y])
                data, offs = T.flat(batch.column("text").take(take))
                out.append((int(chunk[order[x]]), batch.column("doc_id").take(take).to_numpy().astype("<i8").tobytes(), np.diff(offs).astype("<i8").tobytes(), _squeezed(data)))
            if out:
                yield _rows(out)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, held, size = None, [], 0

        def full() -> pa.RecordBatch:
            return _rows([(chunk, b"".join(h[0] for h in held), b"".join(h[1] for h in held), _squeezed(np.concatenate([h[2] for h in held])))])

        for batch in batches:
            for i in range(batch.num_rows):
                c, ids, sizes, data = (batch.column(k)[i].as_py() for k in range(4))
                if held and (c != chunk or size > 4 * CHUNK_BYTES):
                    yield full()
                    held, size = [], 0
                chunk = c
                held.append((ids, sizes, _opened({"ids": ids, "sizes": sizes, "data": data})[2]))
                size += len(held[-1][2])
        if held:
            yield full()

    schema = "chunk int, ids binary, sizes binary, data binary"
    packed = rows.mapInArrow(squeeze, schema).repartition(parts, "chunk").sortWithinPartitions("chunk", "ids").mapInArrow(merge, schema)
    name = f"chunks_{uuid.uuid4().hex}"
    packed.withColumn("part", F.monotonically_increasing_id()).write.option("path", scratch(spark, "chunks")).option("compression", "uncompressed").format("parquet").bucketBy(parts, "chunk").saveAsTable(name)
    groups = max(2 * parts, int(5 * total // GROUP_BYTES) + 1)
    return spark.table(name), parts, groups


def _rows(rows: list[tuple[int, bytes, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[i] for r in rows], pa.binary()) for i in (1, 2, 3))], ["chunk", "ids", "sizes", "data"])


def _squeezed(data: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(data), "zstd", asbytes=True) if len(data) else b""


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, ends and bytes of the documents of a chunk."""
    ids, sizes = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["sizes"], "<i8")
    ends = np.cumsum(sizes)
    size = int(ends[-1]) if len(ends) else 0
    return ids, ends, np.frombuffer(pa.decompress(row["data"], size, "zstd", asbytes=True) if size else b"", np.uint8)


def _keys(m: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each minimizer and the five bytes that tell it from others there."""
    return (m % np.uint64(buckets)).astype(np.int64), (m // np.uint64(buckets)) & np.uint64((1 << 40) - 1)


def _five(q: np.ndarray) -> bytes:
    return np.ascontiguousarray(q.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _from_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def shared_minimizers(table: DataFrame, buckets: int, length: int) -> DataFrame:
    """chunk and, by part and bucket, the minimizers that more than one document has."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                _, ends, data = _opened(row)
                _, _, m, doc = runs(data, ends, length)
                bucket, q = _keys(m, buckets)
                order = np.lexsort((doc, q, bucket))
                bucket, q, doc = bucket[order], q[order], doc[order]
                new = np.concatenate([[True], (q[1:] != q[:-1]) | (bucket[1:] != bucket[:-1])])[: len(q)]
                at = np.flatnonzero(new)
                many = doc[at] != doc[np.append(at[1:], len(q)) - 1]
                bucket, q = bucket[at], q[at]
                at = np.flatnonzero(np.diff(bucket, prepend=-1))
                to = np.append(at[1:], len(q))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(bucket[at], pa.int32()), pa.array(np.full(len(at), row["chunk"]), pa.int32()), pa.array(np.full(len(at), row["part"]), pa.int64()), pa.array([_five(q[a:b]) for a, b in zip(at, to, strict=True)], pa.binary()), pa.array([np.packbits(many[a:b]).tobytes() for a, b in zip(at, to, strict=True)], pa.binary())],
                    ["bucket", "chunk", "part", "q", "many"],
                )

    def answer(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = []
        for batch in batches:
            for row in batch.to_pylist():
                q = _from_five(row["q"])
                keep.append((row["chunk"], row["part"], q, np.unpackbits(np.frombuffer(row["many"], np.uint8))[: len(q)].astype(bool)))
        every = np.concatenate([k[2] for k in keep])
        order = np.argsort(every, kind="stable")
        value = every[order]
        same = value[1:] == value[:-1]
        twice = np.zeros(len(every), bool)
        twice[1:] |= same
        twice[:-1] |= same
        flag = np.empty(len(every), bool)
        flag[order] = twice
        at, out = 0, []
        for chunk, part, q, own in keep:
            got = q[flag[at : at + len(q)] | own]
            at += len(q)
            if len(got):
                out.append((chunk, part, key[0].as_py(), _five(got)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["chunk", "part", "bucket", "q"])

    asked = table.mapInArrow(ask, "bucket int, chunk int, part long, q binary, many binary")
    return asked.groupBy("bucket").applyInArrow(answer, "chunk int, part long, bucket int, q binary").groupBy("chunk").agg(F.collect_list(F.struct("part", "bucket", "q")).alias("shared"))


def earlier_copies(table: DataFrame, shared: DataFrame, buckets: int, groups: int, length: int) -> DataFrame:
    """chunk and, by part and group, the runs of the part that lose bytes, with the smallest doc_id of each of their strings."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "shared"}
                ids, ends, data = _opened(row)
                mine = _structs(batch.column("shared")[i], row["part"])
                if not mine.num_rows:
                    continue
                q, offs = _column(mine, "q")
                wanted = np.sort(_from_five(q.tobytes()) | np.repeat(mine.column("bucket").to_numpy().astype(np.uint64) << np.uint64(40), np.diff(offs) // 5))
                first, count, m, doc = runs(data, ends, length)
                bucket, q = _keys(m, buckets)
                own = q | (bucket.astype(np.uint64) << np.uint64(40))
                hit = wanted[np.minimum(np.searchsorted(wanted, own), len(wanted) - 1)] == own
                first, count, m, doc = first[hit], count[hit], m[hit], doc[hit]
                size = count + length - 1
                h = run_hashes(data, ends, first, size)
                order = np.lexsort((ids[doc], h))
                new = np.concatenate([[True], h[order][1:] != h[order][:-1]])[: len(h)]
                one = order[new]  # equal runs of a part once, with its smallest doc_id
                last = order[np.append(np.flatnonzero(new)[1:], len(order)) - 1] if len(order) else order
                more = ids[doc[last]] > ids[doc[one]]
                group = (T.mix(m[one]) % np.uint64(groups)).astype(np.int64)
                by = np.argsort(group, kind="stable")
                one, more, group = one[by], more[by], group[by]
                if not len(one):
                    continue
                to = np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(one))
                first, size, raw, wide = first[one], size[one], data.tobytes(), size.max() >= 65536
                text = b"".join(raw[x : x + k] for x, k in zip(first.tolist(), size.tolist(), strict=True))
                none = _binary(size[:0], 0 * to)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(pa.array(x, t) for x, t in ((group[to[:-1]], pa.int32()), (np.full(len(to) - 1, row["chunk"]), pa.int32()), (np.full(len(to) - 1, row["part"]), pa.int64()))),
                        _bits(more, to), _binary(ids[doc[one]].astype("<i8"), to), none if wide else _binary(size.astype("<u2"), to), _binary(size.astype("<u4"), to) if wide else none,
                        _binary(np.frombuffer(text, np.uint8), np.concatenate([[0], np.cumsum(size)])[to]),
                    ],
                    ["group", "chunk", "part", "more", "ids", "short", "long", "data"],
                )

    def expand(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, offs = _column(table, "ids")
        ids, n = ids.view("<i8"), np.diff(offs) // 8
        bits, offs = _column(table, "more")
        more = np.unpackbits(bits)[_ranges(8 * offs[:-1], n)].astype(bool)
        long, offs = _column(table, "long")
        wide = np.repeat(np.diff(offs) > 0, n)
        size = np.empty(len(ids), np.int64)
        size[wide], size[~wide] = long.view("<u4"), _column(table, "short")[0].view("<u2")
        data, offs = _column(table, "data")
        begin = np.cumsum(size) - size
        ends = np.cumsum(size)
        keys = run_hashes(data, ends, begin, size)
        # equal runs of different chunks count once, with the smallest doc_id
        order = np.lexsort((ids, keys))
        new = np.concatenate([[True], keys[order][1:] != keys[order][:-1]])
        which = np.empty(len(keys), np.int64)
        which[order] = np.cumsum(new) - 1
        one = order[new]
        by = np.argsort(one)
        place = np.empty(len(one), np.int64)
        place[by] = np.arange(len(one))
        which, one = place[which], one[by]
        count = size[one] - length + 1
        to = np.cumsum(count)
        distinct = np.zeros(len(keys), bool)
        distinct[one] = True
        least = earliest(data[np.repeat(distinct, size)], size[one], ids[one], length)
        early = np.minimum.reduceat(least, to - count)[which] < ids
        lost = early | more
        runs_to = np.concatenate([[0], np.cumsum(n)])
        for x, y, _, _ in parts_of(offs[1:]):
            mine = runs_to[x] + np.flatnonzero(lost[runs_to[x] : runs_to[y]])
            own = np.searchsorted(mine, runs_to[x : y + 1])
            here = x + np.flatnonzero(np.diff(own))
            if not len(mine):
                continue
            w, own = which[mine], np.unique(own)
            k = count[w]
            values = least[_ranges(to[w] - k, k)]
            strings = np.concatenate([[0], np.cumsum(k)])[own]
            new = np.concatenate([[True], values[1:] != values[:-1]])  # runs of one value, row by row
            new[strings[:-1]] = True
            new = np.flatnonzero(new)
            at = np.searchsorted(new, strings)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(table.column("chunk").to_numpy()[here]), pa.array(table.column("part").to_numpy()[here]), _binary(keys[mine].astype("<u8"), own), _binary(k.astype("<u4"), own),
                    _binary(values[new].astype("<i8"), at), _binary(np.diff(np.append(new, len(values))).astype("<u4"), at),
                ],
                ["chunk", "part", "keys", "counts", "least", "times"],
            )

    sent = table.join(shared.hint("merge"), "chunk").select(*table.columns, "shared").mapInArrow(send, "group int, chunk int, part long, more binary, ids binary, short binary, long binary, data binary")
    got = sent.groupBy("group").applyInArrow(expand, "chunk int, part long, keys binary, counts binary, least binary, times binary")
    return got.groupBy("chunk").agg(F.collect_list(F.struct("part", "keys", "counts", "least", "times")).alias("got"))


def removal(docs: DataFrame, length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes kept and the sha256 of a text that loses any, of every row."""
    table, parts, groups = chunks(docs)
    shared = stored(shared_minimizers(table, parts, length), "minimizers")
    copies = stored(earlier_copies(table, shared, parts, groups, length), "copies")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes", "text_sha256"][: 7 if with_text else 5]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "got"}
                every, all_ends, whole = _opened(row)
                mine = _structs(batch.column("got")[i], row["part"])
                if mine.num_rows:
                    keys, count, values, times = (_column(mine, c)[0].view(t) for c, t in (("keys", "<u8"), ("counts", "<u4"), ("least", "<i8"), ("times", "<u4")))
                    count, least = count.astype(np.int64), np.repeat(values, times)
                    base = np.cumsum(count) - count
                    order = np.argsort(keys)
                for x, y, lo, hi in parts_of(all_ends):
                    ids, ends, data = every[x:y], all_ends[x:y] - lo, whole[lo:hi]
                    gone = np.zeros(len(data) + 1, np.int32)
                    if mine.num_rows:
                        first, n, _, doc = runs(data, ends, length)
                        h = run_hashes(data, ends, first, n + length - 1)
                        at = np.minimum(np.searchsorted(keys[order], h), len(keys) - 1)
                        hit = keys[order][at] == h
                        first, n, doc, at = first[hit], n[hit], doc[hit], order[at[hit]]
                        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                        early = least[np.repeat(base[at], n) + step] < np.repeat(ids[doc], n)
                        start = (np.repeat(first, n) + step)[early]
                        gone += np.bincount(start, minlength=len(gone)).astype(np.int32)
                        gone -= np.bincount(start + length, minlength=len(gone)).astype(np.int32)[: len(gone)]
                    covered = np.cumsum(gone[:-1]) > 0
                    begins = ends - np.diff(ends, prepend=0)
                    total = np.concatenate([[0], np.cumsum(covered)])
                    edge = covered.copy()
                    edge[1:] &= ~covered[:-1]
                    edge[begins[begins < len(data)]] |= covered[begins[begins < len(data)]]
                    spans = np.concatenate([[0], np.cumsum(edge)])
                    removed = total[ends] - total[begins]
                    rest = [data[a:b][~covered[a:b]].tobytes() if r else data[a:b].tobytes() for a, b, r in zip(begins.tolist(), ends.tolist(), removed.tolist(), strict=True)]
                    cols = [pa.array(ids, mask=ids == LAST), pa.array(ends - begins), pa.array(removed), pa.array(spans[ends] - spans[begins]), pa.array([hashlib.sha256(r).hexdigest() for r in rest], pa.string())]
                    if with_text:
                        kept = removed > 0  # only texts that lose bytes go on
                        cols.append(pa.array(rest, pa.binary(), mask=~kept))
                        cols.append(pa.array([hashlib.sha256(data[a:b].tobytes()).hexdigest() if r else None for a, b, r in zip(begins.tolist(), ends.tolist(), removed.tolist(), strict=True)], pa.string()))
                    yield pa.RecordBatch.from_arrays(cols, names)

    joined = table.join(copies.hint("merge"), "chunk", "left").select("part", "ids", "sizes", "data", "got")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_bytes binary, text_sha256 string" * with_text)


def cut_documents(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with their columns, texts without what ``removal`` takes away and n_chars to match.

    A character of which some bytes went goes whole. Rows of equal doc_id and equal text get equal results.
    """
    names = docs.columns
    cut = removal(docs, length, with_text=True).where("n_removed > 0")
    cut = cut.groupBy("doc_id", "text_sha256").agg(F.min(F.struct("kept_sha256", "kept_bytes")).alias("_kept")).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"), F.col("_kept.kept_bytes").alias("_kept"))
    got = docs["doc_id"].cast("long").eqNullSafe(cut["_id"]) & (F.sha2(docs["text"].cast("binary"), 256) == cut["_sha"])
    joined = docs.join(cut, got, "left").select(*[docs[c] for c in names], "_kept")
    at = names.index("text")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(i) for i in range(len(names))]
            kept = batch.column(len(names))
            texts = [k.decode("utf-8", "ignore") if k is not None else t for k, t in zip(kept.to_pylist(), cols[at].to_pylist(), strict=True)]
            cols[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                i = names.index("n_chars")
                cols[i] = pa.array([len(t) if k else n for t, k, n in zip(texts, kept.is_valid().to_pylist(), cols[i].to_pylist(), strict=True)], cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(put, docs.schema)
