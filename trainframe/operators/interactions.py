"""User-item interactions, held-out items and sampled negatives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainframe.operators.blocked import running, step_block
from trainframe.operators.position import seeded_draw
from trainframe.session import for_compute, sized, written

# Slots of users, and the positives and draws that a slot may hold to be worked on by one task.
SLOTS = 65536
MOST_ROWS = 1 << 20


def distinct_interactions(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Distinct (user, item) pairs. With the number of rows of ``df`` the tasks grow in number, not in size."""
    pairs = df.select("user", "item")
    return (pairs if rows is None else sized(pairs, rows, "user", "item")).dropDuplicates()


def cardinality(df: DataFrame) -> DataFrame:
    """One row: max id + 1 for users and items."""
    return df.agg((F.max("user") + 1).alias("user_num"), (F.max("item") + 1).alias("item_num"))


def negatives(features: DataFrame, positives: DataFrame, item_num: Column, num_ng: int, seed: int = 0, most: int = MOST_ROWS) -> DataFrame:
    """(user, item, ng_no, neg): ``num_ng`` uniform items per feature row that the user has no interaction with.

    A draw r is uniform over the user's missing items, and the r-th missing item is r plus the number of
    positives whose item less its rank among the positives is at most r. A user who has every item gets no rows.

    Users are dealt to ``SLOTS`` slots. Those of a slot with at most ``most`` positives and draws in all are sorted by user
    once, positives first, and each task merges its users' draws with their positives, so that no draw is shuffled.
    In other slots the count is a running sum over positives and draws merged in value order, cut in blocks, so
    that no large user's items are gathered in one place. ``features`` and ``positives`` are read several times, so hand
    over stored tables.
    """
    items = features.sparkSession.range(1).select(item_num.cast("long")).first()[0]
    absent = F.col("user").isNull() | F.floor("item").isNull()
    slot = F.pmod(F.xxhash64("user"), F.lit(SLOTS)).cast("int")
    pos = positives.withColumn("_slot", F.when(absent, F.raise_error("null group or order key").cast("int")).otherwise(slot))
    feats = features.withColumn("_slot", F.when(F.col("user").isNull(), F.raise_error("null group or order key").cast("int")).otherwise(slot))
    if items is None:
        feats = feats.filter(F.lit(False))
    same = features is positives and items is not None  # then the rows travel once
    loads = pos.select("_slot", F.lit(1).alias("_n")).unionByName(feats.select("_slot", F.lit(num_ng).alias("_n")))
    slots = loads.groupBy("_slot").agg(F.sum("_n").alias("_n"))
    rows, full = slots.agg(F.sum("_n"), F.collect_list(F.when(F.col("_n") > most, F.col("_slot")))).first()  # at most SLOTS
    if not full:
        return _merged_draws(None if same else feats, pos, items or 0, num_ng, seed, rows or 0)
    large = F.col("_slot").isin(full)
    few = _merged_draws(None if same else feats.filter(~large), pos.filter(~large), items or 0, num_ng, seed, rows)
    return few.unionByName(_running_draws(feats.filter(large), pos.filter(large), F.lit(items or 0), num_ng, seed))


def _merged_draws(features: DataFrame | None, positives: DataFrame, items: int, num_ng: int, seed: int, count: int) -> DataFrame:
    """Draws of users whose rows fit one task; ``count`` positives and draws in all. Without features each positive is one."""
    if features is None:
        rows = sized(positives.select("user", "item"), count, "user").withColumn("_kind", F.explode(F.array(F.lit(0), F.lit(1))))
    else:
        rows = positives.select("user", "item", F.lit(0).alias("_kind")).unionByName(features.select("user", "item", F.lit(1).alias("_kind")))
        rows = sized(rows, count, "user")
    rows = rows.sortWithinPartitions("user", "_kind", "item")
    numbers = F.when(F.col("_kind") == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(1), F.lit(num_ng)))
    rows = rows.withColumn("ng_no", F.explode(numbers))
    value = F.when(F.col("_kind") == 0, F.col("item").cast("long")).otherwise(seeded_draw(seed, "user", "item", "ng_no"))
    rows = rows.select("user", "item", "ng_no", "_kind", value.alias("_value"))

    def merge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, owned, gaps = None, np.zeros(0, np.int64), None  # the user a batch ended in, its positives so far, their sorted gaps
        for part in parts:
            n = part.num_rows
            if not n:
                continue
            user = part.column(0)
            starts = np.r_[0, np.flatnonzero(pc.not_equal(user.slice(1), user.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1]
            group = np.zeros(n, np.int64)
            group[starts[1:]] = 1
            group = np.cumsum(group)
            value, draw = part.column(4).to_numpy(zero_copy_only=False), part.column(3).to_numpy() == 1
            held = np.bincount(group[~draw], minlength=len(starts))  # positives of each user
            passed, free = np.zeros(n, np.int64), items - held
            went_on = last is not None and user[0].as_py() == last
            end = starts[1] if len(starts) > 1 else n
            if went_on:  # the first user has rows in earlier batches
                new = value[:end][~draw[:end]]
                if len(new):
                    owned, gaps = np.r_[owned, new], None
                free[0] = items - len(owned)
            taken = draw & (free[group] > 0)
            value = np.where(taken, value % np.maximum(free, 1)[group], value)
            if went_on and taken[:end].any():
                gaps = np.sort(owned - np.arange(len(owned))) if gaps is None else gaps
                passed[:end] = np.searchsorted(gaps, value[:end], "right")
            at = end if went_on else 0
            if at < n:
                g, d = group[at:], draw[at:]
                rank = np.arange(at, n) - starts[g]
                key = np.where(d, value[at:], value[at:] - rank)
                order = np.lexsort((d, key, g))
                count = np.cumsum(~d[order])
                before = np.cumsum(held)[g[order]] - held[g[order]] - (held[0] if went_on else 0)
                passed[at:][order] = count - before
                tail = slice(starts[-1], n)
                last, owned, gaps = user[n - 1].as_py(), value[tail][~draw[tail]], None
            kept = part.select([0, 1, 2]).filter(pa.array(taken))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array((value + passed)[taken])], ["user", "item", "ng_no", "neg"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(merge, f"user {kinds['user']}, item {kinds['item']}, ng_no int, neg long")


def _running_draws(features: DataFrame, positives: DataFrame, item_num: Column, num_ng: int, seed: int) -> DataFrame:
    """Draws by a running sum in blocks, for users of any size; the draws are made once and stored."""
    ranked = running(positives, ["user"], ["item"], step_block("item"), sums={"_rank": F.lit(1)}, exclusive=True)
    gaps = ranked.select("user", (F.col("item") - F.coalesce("_rank", F.lit(0))).alias("_v"), F.lit(0).alias("_draw"),
                         "item", F.lit(0).alias("ng_no"))
    owned = positives.groupBy("user").agg(F.count(F.lit(1)).alias("_owned"))
    free = features.select("user", "item").join(owned, "user", "left")
    free = free.withColumn("_free", item_num - F.coalesce("_owned", F.lit(0))).filter("_free > 0")
    drawn = for_compute(free, "user", "item").withColumn("ng_no", F.explode(F.sequence(F.lit(1), F.lit(num_ng))))
    drawn = drawn.select("user", (seeded_draw(seed, "user", "item", "ng_no") % F.col("_free")).alias("_v"), F.lit(1).alias("_draw"),
                         "item", "ng_no")
    merged = running(
        written(gaps.unionByName(drawn), "draws"), ["user"], ["_v", "_draw", "item", "ng_no"], step_block("_v"),
        sums={"_passed": F.lit(1) - F.col("_draw")},
    )
    return merged.filter("_draw = 1").select("user", "item", "ng_no", (F.col("_v") + F.col("_passed")).alias("neg"))


def train_triples(features: DataFrame, negs: DataFrame) -> DataFrame:
    """Positives with label 1 and negatives with label 0."""
    ones = features.select("user", "item", F.lit(1).alias("label"))
    return ones.unionByName(negs.select("user", F.col("neg").alias("item"), F.lit(0).alias("label")))


def hold_out_last(df: DataFrame, when: str) -> DataFrame:
    """Each user's last item by (``when``, item)."""
    last = df.groupBy("user").agg(F.max(F.struct(when, "item")).alias("_l"))
    return last.select("user", F.col("_l.item").alias("item"))


def candidates(truth: DataFrame, negs: DataFrame) -> DataFrame:
    """(user, position, item): the true item at position 0, then its negatives."""
    first = truth.select("user", F.lit(0).alias("position"), "item")
    return first.unionByName(negs.select("user", F.col("ng_no").alias("position"), F.col("neg").alias("item")))
