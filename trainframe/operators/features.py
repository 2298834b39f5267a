"""Numeric array features: channel statistics, standardising, polynomial terms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def channel_stats(df: DataFrame, values: str, channels: int) -> DataFrame:
    """(channel, mean, mean_std, global_std) of arrays holding ``channels`` equal consecutive parts.

    ``mean`` is the mean of the records' channel means and ``mean_std`` the mean of their sample standard
    deviations, which is not the deviation over all values; that one is ``global_std``.
    """
    width = F.floor(F.size(values) / channels).cast("int")
    part = df.select(
        F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(channels - 1)), lambda c: F.slice(F.col(values), c * width + 1, width)))
        .alias("channel", "_v")
    ).withColumn("_n", F.size("_v"))
    total = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    part = part.withColumn("_sum", total).withColumn("_mean", F.col("_sum") / F.col("_n"))
    part = part.withColumn("_dev", F.aggregate("_v", F.lit(0.0), lambda a, x: a + F.pow(x.cast("double") - F.col("_mean"), 2)))
    grand = F.sum("_sum") / F.sum("_n")
    # Deviations from the record means plus the spread of those means give the deviation over all values.
    between = F.sum(F.col("_n") * F.pow("_mean", 2)) - F.sum("_n") * F.pow(grand, 2)
    return part.groupBy("channel").agg(
        F.avg("_mean").alias("mean"),
        F.avg(F.sqrt(F.col("_dev") / (F.col("_n") - 1))).alias("mean_std"),
        F.sqrt((F.sum("_dev") + between) / (F.sum("_n") - 1)).alias("global_std"),
    )


def standardize(values: Column, means: Sequence[float], stds: Sequence[float]) -> Column:
    """(x - mean) / std per channel with given constants; the array holds equal consecutive parts."""
    m, s = (F.array(*[F.lit(float(v)) for v in vs]) for vs in (means, stds))
    width = F.floor(F.size(values) / len(means))
    channel = lambda i: (F.floor(i / width) + 1).cast("int")
    return F.transform(values, lambda x, i: (x.cast("double") - F.element_at(m, channel(i))) / F.element_at(s, channel(i)))


def polynomial(x: Column, degree: int = 4) -> Column:
    """[x, x^2, ..., x^degree]."""
    return F.transform(F.sequence(F.lit(1), F.lit(degree)), lambda i: F.pow(x, i))
