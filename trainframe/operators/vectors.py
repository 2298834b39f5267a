"""Element-wise sums of arrays per group in two stages of vectors, never of single cells.

Each task adds up its rows of a group in memory and sends the sum in chunks of ``CHUNK`` dimensions; chunks of the same
group meet in one task and are added in sorted runs. A row is shuffled for each task, group and chunk, so a group that
holds all rows is summed by all tasks, and one vector of millions of dimensions is merged by many.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

CHUNK = 1024
#: Numbers that a task holds in sums before it sends them on.
HELD = 1 << 22


def _group_rows(columns: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by their key, and where each distinct key begins (one more at the end)."""
    code = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        d = c.dictionary_encode(null_encoding="encode")
        code = np.unique(code * len(d.dictionary) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    return order, np.append(np.flatnonzero(np.diff(code[order], prepend=-1)), len(code))


def _added(a: tuple, b: tuple) -> tuple:
    """Sum of two (rows, sums, counts); counts are None while every dimension was there in every row."""
    (n, x, c), (m, y, d) = a, b
    if c is None and d is None and len(x) == len(y):
        return n + m, x + y, None
    size = max(len(x), len(y))
    wide = lambda v: np.concatenate([v, np.zeros(size - len(v), v.dtype)])
    each = lambda k, v, s: wide(np.full(len(v), k, np.int64) if s is None else s)
    return n + m, wide(x) + wide(y), each(n, x, c) + each(m, y, d)


def _sum(values: np.ndarray, valid: np.ndarray | None, size: np.ndarray, dtype: type) -> tuple:
    """(rows, sums, counts) of some arrays of one group, given flat."""
    if valid is None and (size == size[0]).all():
        return len(size), values.reshape(len(size), size[0]).sum(0, dtype=dtype), None
    place = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
    good = np.ones(len(values), bool) if valid is None else valid
    sums, most = np.zeros(size.max(), dtype), size.max()
    np.add.at(sums, place[good], values[good])
    return len(size), sums, np.bincount(place[good], minlength=most)


def chunk_sums(df: DataFrame, by: Sequence[str], values: str, chunk: int = CHUNK, held: int = HELD) -> DataFrame:
    """(by.., chunk, n, sums, counts): sums of ``chunk`` dimensions over the rows of a group.

    ``n`` is the number of rows with an array. ``counts`` has the number of rows with a value for each dimension; it is
    null where that is ``n`` for all of them. Null arrays and null elements are left out; arrays may differ in length.
    """
    by = list(by)
    element = df.schema[values].dataType.elementType
    whole = isinstance(element, S.IntegralType)
    dtype, kind = (np.int64, S.LongType()) if whole else (np.float64, S.DoubleType())
    rows = df.select(*by, F.col(values).cast(S.ArrayType(kind)).alias("_v")).filter(F.col("_v").isNotNull())
    fields = [rows.schema[k] for k in by] + [S.StructField("chunk", S.IntegerType()), S.StructField("n", S.LongType())]
    schema = S.StructType([*fields, S.StructField("sums", S.ArrayType(kind)), S.StructField("counts", S.ArrayType(S.LongType()))])

    def batch_of(made: list[tuple], keys: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array([m[0][i] for m in made], keys.field(i).type) for i in range(len(by))]
        columns += [pa.array([m[1] for m in made], pa.int32()), pa.array([m[2][0] for m in made], pa.int64())]
        columns += [pa.array([m[2][1] for m in made], pa.list_(pa.int64() if whole else pa.float64())), pa.array([m[2][2] for m in made], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def sent(sums: dict, keys: pa.Schema) -> Iterator[pa.RecordBatch]:
        for key, (n, x, c) in sums.items():
            cut = range(0, max(len(x), 1), chunk)
            made = [(key, at // chunk, (n, x[at : at + chunk], None if c is None else c[at : at + chunk])) for at in cut]
            for at in range(0, len(made), 1024):
                yield batch_of(made[at : at + 1024], keys)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, size, keys = {}, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.schema
            lists = batch.column(len(by))
            order, first = _group_rows(batch.columns[: len(by)] or [pa.array(np.zeros(batch.num_rows))])
            lists = lists.take(pa.array(order))
            flat, length = lists.flatten(), pa.compute.list_value_length(lists).to_numpy()
            valid = None if not flat.null_count else flat.is_valid().to_numpy(zero_copy_only=False)
            flat, offs = flat.fill_null(0).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(length)])
            heads = [c.take(pa.array(order[first[:-1]])).to_pylist() for c in batch.columns[: len(by)]]
            for g, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
                key, to = tuple(h[g] for h in heads), slice(offs[a], offs[b])
                new = _sum(flat[to], None if valid is None else valid[to], length[a:b], dtype)
                old = sums.get(key)
                sums[key] = new if old is None else _added(old, new)
                size += len(sums[key][1]) - (0 if old is None else len(old[1]))
            if size > held:
                yield from sent(sums, keys)
                sums, size = {}, 0
        if sums:
            yield from sent(sums, keys)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total, keys = None, None, None
        for batch in batches:
            keys, made = batch.schema, []
            heads = list(zip(*(batch.column(i).to_pylist() for i in range(len(by) + 1)), strict=True))
            n, sums, counts = (batch.column(c) for c in ("n", "sums", "counts"))
            for i, key in enumerate(heads):
                counted = counts[i].values
                new = (n[i].as_py(), sums[i].values.to_numpy(), None if counted is None else counted.to_numpy())
                if key == last:
                    total = _added(total, new)
                    continue
                if last is not None:
                    made.append((last[:-1], last[-1], total))
                last, total = key, new
            if made:
                yield batch_of(made, keys)
        if last is not None:
            yield batch_of([(last[:-1], last[-1], total)], keys)

    parts = rows.mapInArrow(partial, schema)
    return parts.repartition(*by, "chunk").sortWithinPartitions(*by, "chunk").mapInArrow(merged, schema)


def vector_sums(df: DataFrame, by: Sequence[str], values: str, chunk: int = CHUNK) -> DataFrame:
    """(by.., values): element-wise sum of the arrays of a group; a dimension without any value is null."""
    parts = chunk_sums(df, by, values, chunk)
    shown = F.when(F.col("counts").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "counts", lambda s, c: F.when(c > 0, s)))
    return parts.filter(F.size("sums") > 0).groupBy(*by).agg(F.flatten(F.sort_array(F.collect_list(F.struct("chunk", shown.alias("s"))))["s"]).alias(values))


def mean_square(df: DataFrame, by: Sequence[str], values: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """(by.., out): squared norm of the mean array of a group, each dimension averaged over the rows that have it."""
    parts = chunk_sums(df, by, values, chunk)
    square = lambda s, c: F.when(c > 0, (s / c) * (s / c)).otherwise(0.0)
    plain = F.transform("sums", lambda s: square(s, F.col("n")))
    each = F.when(F.col("counts").isNull(), plain).otherwise(F.zip_with("sums", "counts", square))
    return parts.filter(F.size("sums") > 0).groupBy(*by).agg(F.sum(F.aggregate(each, F.lit(0.0), lambda a, x: a + x)).alias(out))
