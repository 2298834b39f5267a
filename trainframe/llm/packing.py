"""Best-fit packing of token pieces by length patterns.

Only the histogram of piece lengths (one number per length up to the capacity) reaches the driver. Patterns are
one to three lengths that fill a sequence exactly. Non-negative least squares fits how often each is used, weighing
long pieces more; counts are rounded along a running sum, as far as pieces last; what is left goes into the fullest
sequence that takes it, longest first. The plan is a table of (length, range of ranks, range of sequences, offset),
whose size depends on the capacity, not on the number of documents. Pieces get a rank among those of their length
from counts per task, so no group of equal lengths ever meets in one task.

Null texts are empty and give one piece with the end id. Rows with equal doc_id are packed one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trainframe.llm import tokens as K
from trainframe.llm.store import stored

CAPACITY = 2048
ROUNDS = 120


def cut(n: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and length of the pieces of rows with n ids; only the first piece of a row may be short."""
    k = -(-n // capacity)
    row = np.repeat(np.arange(len(n)), k)
    piece = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k)
    head = n - capacity * (k - 1)
    start = np.where(piece == 0, 0, head[row] + (piece - 1) * capacity)
    return row, start, np.where(piece == 0, head[row], capacity)


def pieces(docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their task and their number among the task's pieces of the same length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for part, ids, offs in K.encoded(batch, "text", path):
                full = np.insert(ids, offs[1:], np.uint32(end_id))
                n = np.diff(offs) + 1
                base = np.cumsum(n) - n
                row, start, length = cut(n, capacity)
                at = base[row] + start
                order = np.argsort(length, kind="stable")
                sizes, first, count = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(first, count) + np.repeat(seen[sizes], count)
                seen[sizes] += count
                edges = np.append(at, len(full))
                cols = [part.column("doc_id").take(pa.array(row)), pa.array(np.where(start == 0, 0, (start - (n - capacity * (-(-n // capacity) - 1))[row]) // capacity + 1), pa.int32()), pa.array(start), pa.array(length), pa.array(K.crc32_rows(full, edges)), pa.array(np.full(len(row), task), pa.int32()), pa.array(nth)]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(full.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth", "ids"][: len(cols)])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * with_ids
    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema), "pieces")


def patterns(present: np.ndarray, capacity: int) -> np.ndarray:
    """All multisets of two or three present lengths that sum to the capacity; the missing third is 0."""
    has = np.zeros(capacity + 1, bool)
    has[present] = True
    rows = []
    a = present[present * 2 <= capacity]
    a2 = a[has[capacity - a]]
    rows.append(np.stack([a2, capacity - a2, np.zeros_like(a2)], 1))
    for x in present[present * 3 <= capacity]:
        y = present[(present >= x) & (2 * present <= capacity - x)]
        y = y[has[capacity - x - y]]
        rows.append(np.stack([np.full_like(y, x), y, capacity - x - y], 1))
    return np.concatenate(rows)


def fit(hist: np.ndarray, pats: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Non-negative least squares of pattern counts against the histogram by multiplicative steps."""
    weight = np.arange(len(hist), dtype=float) ** 2
    weight[0] = 0.0
    x = hist[pats[:, :2]].min(1).astype(float) / np.maximum(np.bincount(pats.ravel(), minlength=len(hist))[pats[:, :2]].max(1), 1)
    up = (weight * hist)[pats].sum(1)
    for _ in range(rounds):
        made = sum(np.bincount(pats[:, j], weights=x, minlength=len(hist)) for j in range(3))
        down = (weight * made)[pats].sum(1)
        x *= up / np.maximum(down, 1e-12)
    return x


def plan(hist: np.ndarray, capacity: int = CAPACITY, rounds: int = ROUNDS) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, first sequence, offset), each up to the next of its length, and the number of sequences."""
    left = hist.astype(np.int64).copy()
    rank = np.zeros(len(hist), np.int64)
    rows: list[tuple[int, int, int, int]] = []
    seq = 0

    def put(length: int, count: int, first: int, offset: int) -> None:
        rows.append((length, int(rank[length]), first, offset))
        rank[length] += count
        left[length] -= count

    if left[capacity]:
        n = int(left[capacity])
        put(capacity, n, 0, 0)
        seq = n
    present = np.flatnonzero(left[:capacity])
    present = present[present > 0]
    pats = patterns(present, capacity) if len(present) else np.zeros((0, 3), np.int64)
    if len(pats):
        x = fit(left, pats, rounds)
        # patterns side by side share their longest piece; rounding the running sum keeps what each such group uses
        ranked = np.sort(pats, axis=1)
        order = np.lexsort((-ranked[:, 1], -ranked[:, 2]))
        repeats = np.diff(np.rint(np.cumsum(x[order])), prepend=0).astype(np.int64)
        for (a, b, c), want in zip(ranked[order][repeats > 0].tolist(), repeats[repeats > 0].tolist(), strict=True):
            used = [v for v in (c, b, a) if v]
            n = min(want, *(int(left[v]) // used.count(v) for v in used))
            if n > 0:
                at = 0
                for v in used:
                    put(v, n, seq, at)
                    at += v
                seq += n
    # the rest: longest first into the sequence with the least room that takes it
    room: dict[int, list[tuple[int, int]]] = {}
    spaces = np.zeros(capacity + 1, bool)
    for v in range(capacity, 0, -1):
        while left[v] > 0:
            fits = np.flatnonzero(spaces[v:])
            if len(fits):
                s = int(fits[0]) + v
                first, count = room[s].pop()
                if not room[s]:
                    spaces[s] = False
            else:
                s, first, count = capacity, seq, max(1, int(left[v]) // (capacity // v))
                seq += count
            n = min(count, int(left[v]))
            put(v, n, first, capacity - s)
            if n < count:
                room.setdefault(s, []).append((first + n, count - n))
                spaces[s] = True
            if s > v:
                room.setdefault(s - v, []).append((first, n))
                spaces[s - v] = True
    return np.array(rows, np.int64).reshape(-1, 4), seq


def pack(numbered: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces that carry length, task and nth (see ``pieces``)."""
    counts = stored(numbered.groupBy("length", "task").count(), "length-counts")
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect():
        hist[r["length"]] = r["n"]
    rows, _ = plan(hist, capacity)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    keys = rows[:, 0] * (1 << 48) + rows[:, 1]
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = numbered.join(base, ["length", "task"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "nth", "task")
    names = [c for c in ranked.columns if c != "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, r = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            i = np.searchsorted(keys, length * (1 << 48) + r, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(rows[i, 2] + r - rows[i, 1]), pa.array(rows[i, 3])], [*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")
    return ranked.mapInArrow(place, f"{fields}, sequence_id long, offset long")
