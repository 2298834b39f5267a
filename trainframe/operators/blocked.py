"""Running aggregates per group that do not put a whole group in one task.

A group may hold a large part of all rows, so the window runs inside (group, block), where the block
is a monotone function of the order key, and a small table with one row per (group, block) carries
what earlier blocks contribute. Group and order keys must not be null; a row with one fails the job
instead of going missing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_STEPS = 4096


def step_block(order: str | Column, size: int = BLOCK_STEPS) -> Column:
    """Block of a step-like order key: its value divided by ``size``, rounded down."""
    c = F.col(order) if isinstance(order, str) else order
    return F.floor(c / F.lit(size))


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[str],
    block: Column,
    sums: Mapping[str, Column] | None = None,
    maxs: Mapping[str, Column] | None = None,
    mins: Mapping[str, Column] | None = None,
    lags: Mapping[str, Column] | None = None,
    leads: Mapping[str, Column] | None = None,
    exclusive: bool = False,
) -> DataFrame:
    """Add running sums, maxima, minima, previous-row and next-row values in ``order`` within each group.

    ``order`` must be a total order inside the group and ``block`` non-decreasing along it.
    With ``exclusive`` the current row is left out of sums, maxima and minima. ``df`` is read twice, so
    checkpoint it before calling this several times in a row.
    """
    by = list(by)
    sums, maxs, mins, lags, leads = (dict(m or {}) for m in (sums, maxs, mins, lags, leads))
    inputs = {**sums, **maxs, **mins, **lags, **leads}
    names = {k: f"_in{i}" for i, k in enumerate(inputs)}
    absent = reduce(or_, [F.col(c).isNull() for c in by], block.isNull())
    guarded = F.when(absent, F.raise_error("null group or order key").cast("bigint")).otherwise(block.cast("bigint"))
    work = df.select("*", guarded.alias("_block"), *[inputs[k].alias(names[k]) for k in inputs])

    ordered = Window.partitionBy(*by, "_block").orderBy(*order)
    frame = ordered.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    blocks = Window.partitionBy(*by).orderBy("_block")
    earlier = blocks.rowsBetween(Window.unboundedPreceding, -1)

    key = F.struct(*order)
    totals = [F.sum(names[k]).alias(names[k]) for k in sums]
    totals += [F.max(names[k]).alias(names[k]) for k in maxs]
    totals += [F.min(names[k]).alias(names[k]) for k in mins]
    totals += [F.max_by(F.struct(names[k]), key).alias(names[k]) for k in lags]
    totals += [F.min_by(F.struct(names[k]), key).alias(names[k]) for k in leads]
    carry = work.groupBy(*by, "_block").agg(*totals)
    carry = carry.select(
        *by,
        "_block",
        *[F.sum(names[k]).over(earlier).alias("_c" + names[k]) for k in sums],
        *[F.max(names[k]).over(earlier).alias("_c" + names[k]) for k in maxs],
        *[F.min(names[k]).over(earlier).alias("_c" + names[k]) for k in mins],
        *[F.lag(names[k]).over(blocks).alias("_c" + names[k]) for k in lags],
        *[F.lead(names[k]).over(blocks).alias("_c" + names[k]) for k in leads],
    )

    local = work.select(
        "*",
        *[F.sum(names[k]).over(frame).alias("_l" + names[k]) for k in sums],
        *[F.max(names[k]).over(frame).alias("_l" + names[k]) for k in maxs],
        *[F.min(names[k]).over(frame).alias("_l" + names[k]) for k in mins],
        *[F.lag(F.struct(names[k])).over(ordered).alias("_l" + names[k]) for k in lags],
        *[F.lead(F.struct(names[k])).over(ordered).alias("_l" + names[k]) for k in leads],
    )
    both = local.join(carry, [*by, "_block"], "left")  # every block has its carry row

    def pair(k: str) -> tuple[Column, Column]:
        return F.col("_l" + names[k]), F.col("_c" + names[k])

    out = []
    for k in sums:
        a, c = pair(k)
        out.append(F.when(a.isNull() & c.isNull(), F.lit(None)).otherwise(_zero(a) + _zero(c)).alias(k))
    out += [F.greatest(*pair(k)).alias(k) for k in maxs]
    out += [F.least(*pair(k)).alias(k) for k in mins]
    out += [F.coalesce(*pair(k)).getField(names[k]).alias(k) for k in [*lags, *leads]]
    return both.select(*df.columns, *out)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))
