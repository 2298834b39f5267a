"""Dense global positions and prefix sums without an unpartitioned window over the data.

Rows are put in buckets by a pure function of their order key. A window ranks rows inside a bucket,
and a table with one row per bucket carries the running total of all earlier buckets. Only that
bucket table, whose size is fixed by a parameter, is ever ordered in one task or broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainframe.session import written

MAX_BUCKETS = 65536


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hash_digits(df: DataFrame) -> int:
    """Hex digits that give at least 16 hash buckets per shuffle partition, between 256 and 65536 in all."""
    return next((d for d in (2, 3) if 16**d >= 16 * _partitions(df)), 4)


def range_buckets(df: DataFrame) -> int:
    """Eight range buckets per shuffle partition, between 64 and 16384 in all."""
    return min(max(8 * _partitions(df), 64), 16384)


def seeded_key(seed: object, *cols: Column | str) -> Column:
    """Deterministic shuffle key: md5 of the seed and the columns joined by '|'."""
    parts = [F.lit(str(seed))] + [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def seeded_draw(seed: object, *cols: Column | str) -> Column:
    """Non-negative bigint below 2**60, a pure function of the seed and the columns."""
    return F.conv(F.substring(seeded_key(seed, *cols), 1, 15), 16, 10).cast("bigint")


def _offsets(counts: DataFrame, by: Sequence[str], bucket: str, value: str, keep: Sequence[str] = ()) -> DataFrame:
    before = Window.partitionBy(*by).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    return counts.select(
        *by,
        bucket,
        F.coalesce(F.sum(value).over(before), F.lit(0)).alias("_before"),
        F.sum(value).over(whole).alias("_total"),
        *keep,
    )


def hash_position(
    df: DataFrame,
    key: Column,
    tie: Sequence[str],
    by: Sequence[str] = (),
    digits: int | None = None,
    out: str = "pos",
    total: str | None = None,
    ranges: DataFrame | None = None,
) -> DataFrame:
    """Position of each row in (key, tie) order, ``key`` being a hex digest; per group if ``by`` is given.

    ``digits`` leading hex digits make 16**digits even buckets, by default as ``hash_digits`` says.
    ``total`` names a column for the number of rows. With ``ranges`` (by.., first, stop), which need ``by``, buckets without a position in
    one of the ranges are left out before anything is sorted, and before the shuffle where the table of buckets is small
    (``MAX_BUCKETS`` rows); a few rows beside the ranges may remain. The rows themselves are never broadcast, however small
    their files are.
    """
    digits = digits or hash_digits(df)
    if not 1 <= digits <= 4:
        raise ValueError("digits must be 1..4")
    by, keyed = list(by), df.withColumn("_key", key)
    keyed = keyed.withColumn("_bucket", F.substring("_key", 1, digits))
    counts = keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _offsets(counts, by, "_bucket", "_n")
    if not by:
        offsets = F.broadcast(offsets)  # at most 16**digits rows
    inside = Window.partitionBy(*by, "_bucket").orderBy("_key", *tie)
    if ranges is None:
        placed = keyed.withColumn("_row", F.row_number().over(inside)).join(offsets, [*by, "_bucket"])
    else:
        reached = (F.col("first") < F.col("_before") + F.col("_n")) & (F.col("stop") > F.col("_before"))
        near = _offsets(counts, by, "_bucket", "_n", keep=["_n"]).join(ranges, by).filter(reached).select(*by, "_bucket", "_before", "_total").distinct()
        small = ranges.select(*by).distinct().count() * 16**digits <= MAX_BUCKETS
        met = keyed.join(F.broadcast(near), [*by, "_bucket"]) if small else keyed.hint("merge").join(near, [*by, "_bucket"])
        placed = met.withColumn("_row", F.row_number().over(inside))
    placed = placed.withColumn(out, F.col("_before") + F.col("_row") - 1)
    if total:
        placed = placed.withColumn(total, F.col("_total"))
    return placed.drop("_key", "_bucket", "_row", "_before", "_total")


def range_bucket(df: DataFrame, key: str, buckets: int | None = None, out: str = "_bucket") -> DataFrame:
    """Add an order-preserving bucket number of a numeric key, cut at approximate quantiles.

    Quantiles only balance the buckets; the cuts become literals of the plan, so a row's bucket never
    depends on partitioning. Equal keys always share a bucket.
    """
    buckets = buckets or range_buckets(df)
    if not 2 <= buckets <= MAX_BUCKETS:
        raise ValueError("buckets out of range")
    num = df.withColumn("_num", F.col(key).cast("double"))
    cuts = num.select("_num").approxQuantile("_num", [i / buckets for i in range(1, buckets)], 0.5 / buckets)
    cuts = sorted(set(cuts))
    if not cuts:
        return df.withColumn(out, F.lit(0.0))
    edges = [float("-inf"), *cuts, float("inf")]
    return Bucketizer(splits=edges, inputCol="_num", outputCol=out).transform(num).drop("_num")


def prefix_sum(
    df: DataFrame, key: str, value: Column | None = None, buckets: int | None = None, out: str = "pos", total: str | None = None
) -> DataFrame:
    """Sum of ``value`` over all rows with a smaller unique numeric ``key``. Without a value: the position."""
    value = F.lit(1).cast("bigint") if value is None else value
    cut = range_bucket(df.withColumn("_value", value), key, buckets)
    sums = cut.groupBy("_bucket").agg(F.sum("_value").alias("_n"))
    offsets = F.broadcast(_offsets(sums, [], "_bucket", "_n"))  # at most `buckets` rows
    inside = Window.partitionBy("_bucket").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(offsets, "_bucket")
    placed = placed.withColumn(out, F.col("_before") + F.col("_local"))
    if total:
        placed = placed.withColumn(total, F.col("_total"))
    return placed.drop("_bucket", "_value", "_local", "_before", "_total")


def sorted_position(df: DataFrame, order: Sequence[Column | str], out: str = "pos") -> DataFrame:
    """Position in any total order, such as (-count, token), where the leading key may be very uneven.

    Spark's range-partitioned sort balances on the whole order tuple. The sorted rows are written once
    with their partition and row number, which freezes the layout, and partition offsets are added.
    """
    laid = df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    laid = written(laid.withColumn("_bucket", F.shiftright("_at", 33)), "sorted")
    counts = laid.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = F.broadcast(_offsets(counts, [], "_bucket", "_n"))  # one row per shuffle partition
    row = F.col("_at") - F.shiftleft(F.col("_bucket"), 33)
    return laid.join(offsets, "_bucket").withColumn(out, F.col("_before") + row).drop("_at", "_bucket", "_before", "_total")
