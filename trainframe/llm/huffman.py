"""Token-id output by canonical length-limited Huffman coding.

Pass one tokenises every text and counts ids per task; the counts meet in a sum per id, at most one row per id of the
vocabulary. The driver derives code lengths by package-merge and canonical codes from the lengths. Pass two encodes
each document, deals documents to ranges of ascending doc_id and writes blocks. A block is decodable by itself: it
names its documents, their token counts and the bit position of every ``STEP``-th token, so all checkpoints of a block
decode side by side with one table look-up per token.

Null and empty texts give the end id alone. Rows with a null doc_id come first. Documents of equal doc_id keep one
order (by token count and bits). Other columns are ignored. An empty table gives no block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainframe.llm import tokens as K
from trainframe.llm.store import shuffle_partitions, stored
from trainframe.session import scratch

STEP = 256
BLOCK_TOKENS = 1 << 16
MAX_BITS = 18


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.int64)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 2**limit:
        raise ValueError(f"{n} ids do not fit in codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.float64)
    level, leaves = leaf, []
    for _ in range(limit):
        leaves.append(None if level is leaf else flags)  # noqa: F821 - set in the round before
        half = len(level) // 2 * 2
        packages = level[0:half:2] + level[1:half:2]
        both = np.concatenate([leaf, packages])
        at = np.argsort(both, kind="stable")
        level, flags = both[at], at < n
    take, size = 2 * n - 2, np.zeros(n, dtype=np.int64)
    for flags in reversed(leaves):
        c = take if flags is None else int(flags[:take].sum())
        size[:c] += 1
        take = 2 * (take - c)
        if flags is None or take <= 0:
            break
    out[order] = size
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code = last = 0
    ids = np.flatnonzero(lengths)
    for i in ids[np.lexsort((ids, lengths[ids]))].tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def table(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Decoding table: for the next ``width`` bits, id * 64 + code length."""
    width = int(lengths.max(initial=1))
    codes, out = canonical(lengths), np.zeros(1 << width, dtype=np.uint32)
    ids = np.flatnonzero(lengths)
    ids = ids[np.lexsort((ids, lengths[ids]))]
    span = (1 << (width - lengths[ids])).astype(np.int64)
    out[: span.sum()] = np.repeat((ids * 64 + lengths[ids]).astype(np.uint32), span)
    assert not len(ids) or codes[ids[0]] == 0
    return out, width


def pack_bits(ids: np.ndarray, offs: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """Bits of each row of ids, each row from a byte of its own: bytes, byte offsets of rows, bit position of each id in its row."""
    size = lengths[ids]
    run = np.concatenate([[0], np.cumsum(size)])
    row_bytes = (run[offs[1:]] - run[offs[:-1]] + 7) // 8
    to = np.concatenate([[0], np.cumsum(row_bytes)])
    per = np.diff(offs)
    pos = run[:-1] - np.repeat(run[offs[:-1]], per)
    at = pos + np.repeat(to[:-1] * 8, per)
    words = np.zeros(int(to[-1]) // 4 + 2, dtype=np.uint64)
    if len(ids):
        word = at >> 5
        value = codes[ids] << (64 - size - (at & 31)).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        words[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes()[: int(to[-1])], to, pos


def unpack_bits(raw: bytes, at: np.ndarray, n: np.ndarray, lookup: np.ndarray, width: int) -> np.ndarray:
    """Ids of runs that start at bit positions ``at`` and have ``n`` ids each, all runs side by side."""
    words = np.frombuffer(raw + b"\0" * (12 - len(raw) % 4), dtype=">u4").astype(np.uint64)
    pair = (words[:-1] << np.uint64(32)) | words[1:]
    order = np.argsort(-n, kind="stable")
    at, left = at[order].copy(), n[order]
    to = (np.cumsum(n) - n)[order]
    out = np.zeros(int(n.sum()), dtype=np.uint32)
    for k in range(int(n.max(initial=0))):
        m = int(np.searchsorted(-left, -k, "left"))  # runs longer than k
        p = at[:m]
        got = lookup[((pair[p >> 5] << (p & 31).astype(np.uint64)) >> np.uint64(64 - width)).astype(np.int64)]
        out[to[:m] + k] = got >> 6
        p += (got & 63).astype(np.int64)
    return out


def _planes(ids: np.ndarray) -> bytes:
    """Low bytes, then higher bytes: general compression gets further on these."""
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[: 2 if (ids < 65536).all() else 4]).tobytes()


def _from_planes(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(-1, n) if n else np.zeros((2, 0), np.uint8)
    out = np.zeros(n, np.uint32)
    for i, plane in enumerate(planes):
        out |= plane.astype(np.uint32) << np.uint32(8 * i)
    return out


def token_rows(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n, ids of every document, and one row per task with counts of ids; kept in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        names = ["doc_id", "n", "ids", "counts"]
        for batch in batches:
            for part, ids, offs in K.encoded(batch, "text", path):
                rows = [np.append(ids[a:b], np.uint32(end_id)) for a, b in zip(offs[:-1], offs[1:], strict=True)]
                got = np.bincount(np.concatenate(rows))
                if len(got) > len(total):
                    got[: len(total)] += total
                    total = got
                else:
                    total[: len(got)] += got
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(r) for r in rows], pa.int64()), pa.array([_planes(r) for r in rows], pa.binary()), pa.nulls(len(rows), pa.binary())], names)
        if total.any():
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.array([0], pa.int64()), pa.nulls(1, pa.binary()), pa.array([np.stack([used, total[used]]).astype("<i8").tobytes()], pa.binary())], names)

    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, ids binary, counts binary"), "token-ids")


def global_counts(rows: DataFrame) -> np.ndarray:
    """Occurrences of every id, summed on the cluster; the driver gets one row per id of the vocabulary."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("counts"):
                both = np.frombuffer(raw.as_py(), "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["id", "n"])

    got = rows.where("counts is not null").select("counts").mapInArrow(spread, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["id"] for r in got), default=0) + 1, np.int64)
    for r in got:
        out[r["id"]] = r["n"]
    return out


def write_blocks(rows: DataFrame, lengths: np.ndarray) -> str:
    """Write the blocks of all documents in ascending doc_id order; returns the folder.

    Columns of a block: shard and first (tokens of the shard before the block) place it; doc_ids, n_tokens, checkpoints
    (little-endian int64 bit positions of every STEP-th token of each document) and bits hold it.
    """
    spark = rows.sparkSession
    codes = canonical(lengths)
    docs = rows.where("counts is null").select("doc_id", "n", "ids")
    parts = shuffle_partitions(rows)
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else None
    cuts = np.unique(np.array(cuts or [], dtype=np.int64))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids_of, n_of, key = batch.column("ids"), batch.column("n").to_numpy(), batch.column("doc_id")
            for at in range(0, batch.num_rows, 64):
                n = n_of[at : at + 64]
                ids = np.concatenate([_from_planes(ids_of[at + i].as_py(), int(k)) for i, k in enumerate(n)])
                offs = np.concatenate([[0], np.cumsum(n)])
                raw, to, pos = pack_bits(ids, offs, codes, lengths)
                doc = key.slice(at, 64)
                shard = np.where(doc.is_null().to_numpy(zero_copy_only=False), 0, np.searchsorted(cuts, doc.fill_null(0).to_numpy(), "right"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard, pa.int32()), doc, pa.array(n), pa.array([pos[a:b:STEP].astype("<i8").tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True)], pa.binary()), pa.array([raw[a:b] for a, b in zip(to[:-1], to[1:], strict=True)], pa.binary())],
                    ["shard", "doc_id", "n", "checkpoints", "bits"],
                )

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, before, held, held_n = None, 0, [], 0

        def full() -> pa.RecordBatch:
            size = np.cumsum([0] + [8 * len(h[3]) for h in held[:-1]])
            points = b"".join((np.frombuffer(h[2], "<i8") + s).astype("<i8").tobytes() for h, s in zip(held, size, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([before], pa.int64()), pa.array([[h[0] for h in held]], pa.list_(pa.int64())), pa.array([[h[1] for h in held]], pa.list_(pa.int64())), pa.array([points], pa.binary()), pa.array([b"".join(h[3] for h in held)], pa.binary())],
                ["shard", "first", "doc_ids", "n_tokens", "checkpoints", "bits"],
            )

        for batch in batches:
            for s, d, n, c, b in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if held and (s != shard or held_n + n > BLOCK_TOKENS):
                    yield full()
                    before, held, held_n = before + held_n, [], 0
                if s != shard:
                    shard, before = s, 0
                held.append((d, n, c, b))
                held_n += n
        if held:
            yield full()

    path = scratch(spark, "token-blocks")
    (
        docs.mapInArrow(encode, "shard int, doc_id long, n long, checkpoints binary, bits binary")
        .repartitionById(len(cuts) + 1, F.col("shard"))
        .sortWithinPartitions("shard", "doc_id", "n", "bits")
        .mapInArrow(block, "shard int, first long, doc_ids array<long>, n_tokens array<long>, checkpoints binary, bits binary")
        .write.option("compression", "uncompressed")
        .parquet(path)
    )
    return path


def shard_starts(blocks: DataFrame) -> list[int]:
    """Tokens before each shard, from the block heads; one number per shard reaches the driver."""
    sums = blocks.groupBy("shard").agg(F.sum(F.expr("aggregate(n_tokens, 0L, (a, x) -> a + x)")).alias("n")).collect()
    per = np.zeros(max((r["shard"] for r in sums), default=-1) + 1, np.int64)
    for r in sums:
        per[r["shard"]] = r["n"]
    return [0, *np.cumsum(per).tolist()]


def read_blocks(spark, path: str, lengths: np.ndarray, with_ids: bool = False) -> DataFrame:
    """Decode the blocks of a folder: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    blocks = spark.read.parquet(path)
    starts = shard_starts(blocks)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, width = table(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                n = np.array(batch.column("n_tokens")[i].as_py(), np.int64)
                points = np.frombuffer(batch.column("checkpoints")[i].as_py(), "<i8")
                runs = -(-n // STEP)
                size = np.full(int(runs.sum()), STEP, np.int64)
                last = np.cumsum(runs) - 1
                size[last[runs > 0]] = (n - STEP * (runs - 1))[runs > 0]
                ids = unpack_bits(batch.column("bits")[i].as_py(), points, size, lookup, width)
                offs = np.concatenate([[0], np.cumsum(n)])
                start = starts[batch.column("shard")[i].as_py()] + batch.column("first")[i].as_py() + offs[:-1]
                cols = [pa.array(batch.column("doc_ids")[i].as_py(), pa.int64()), pa.array(start), pa.array(n), pa.array(K.crc32_rows(ids, offs))]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def encode_documents(docs: DataFrame, path: str, end_id: int, max_bits: int = MAX_BITS) -> tuple[str, np.ndarray]:
    """Write all documents in the block format: folder and code lengths, which are all a reader needs."""
    rows = token_rows(docs, path, end_id)
    lengths = code_lengths(global_counts(rows), max_bits)
    return write_blocks(rows, lengths), lengths
