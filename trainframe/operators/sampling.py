"""Seeded epoch orders, shards, batches, splits and restart plans as relations over positions.

The contract is determinism by row key: a row's place depends on the seed and its id, never on how
the input is partitioned, so a restart with another number of workers sees the same order.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainframe.operators.blocked import running, step_block
from trainframe.operators.position import hash_position, prefix_sum, seeded_key

# Places of an order that are joined by one key when parts of passes look up their rows.
BLOCK_PLACES = 4096


def round_up(value: Column, multiple: Column) -> Column:
    """Smallest multiple not below ``value``."""
    return F.ceil(value / multiple) * multiple


def local_batch(batch: Column | int, replicas: Column | int) -> Column:
    """Rows per replica for a global batch, rounded up."""
    b = batch if isinstance(batch, Column) else F.lit(batch)
    r = replicas if isinstance(replicas, Column) else F.lit(replicas)
    return F.ceil(b / r)


def epoch_shuffle(
    df: DataFrame, id_col: str, seed: int = 0, epoch: int = 0, pass_no: int = 0, digits: int | None = None
) -> DataFrame:
    """Order of one pass of one epoch: adds ``pos`` and the row count ``n``."""
    key = seeded_key(seed, F.lit(epoch), F.lit(pass_no), id_col)
    return hash_position(df, key, [id_col], digits=digits, total="n")


def epochs_shuffle(df: DataFrame, id_col: str, epochs: Sequence[int], seed: int = 0, pass_no: int = 0) -> DataFrame:
    """Orders of several epochs in one plan: adds ``epoch``, ``pos`` and ``n``."""
    each = df.withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in epochs])))
    key = seeded_key(seed, "epoch", F.lit(pass_no), id_col)
    return hash_position(each, key, [id_col], by=["epoch"], total="n")


def natural_order(df: DataFrame, id_col: str) -> DataFrame:
    """Order by a unique numeric id: adds ``pos`` and ``n``."""
    return prefix_sum(df, id_col, total="n")


def strided_shards(order: DataFrame, replicas: int, index: int = 0) -> DataFrame:
    """Every row from ``index`` on goes to rank (offset mod replicas) as its k-th row. No shuffle."""
    off = F.col("pos") - F.lit(index) % F.col("n")
    return (
        order.withColumn("_off", off)
        .filter("_off >= 0")
        .withColumn("rank", (F.col("_off") % replicas).cast("int"))
        .withColumn("k", F.floor(F.col("_off") / replicas))
        .drop("_off")
    )


def padded_shards(order: DataFrame, replicas: int, index: int = 0) -> DataFrame:
    """Strided shards of equal length: a rank one row short gets the row at its own rank in full order.

    Each input row yields its shard row, its padding row, or both, so the order is computed once.
    """
    base = F.lit(index) % F.col("n")
    left = F.col("n") - base
    off = F.col("pos") - base
    length = F.ceil(left / replicas)
    short = (left % replicas != 0) & (F.col("pos") >= left % replicas) & (F.col("pos") < replicas)
    own = F.when(
        off >= 0,
        F.struct((off % replicas).cast("int").alias("rank"), F.floor(off / replicas).alias("k"), F.lit(False).alias("pad")),
    )
    pad = F.when(short, F.struct(F.col("pos").cast("int").alias("rank"), (length - 1).alias("k"), F.lit(True).alias("pad")))
    rows = order.withColumn("length", length).withColumn("_s", F.explode(F.array_compact(F.array(own, pad))))
    return rows.select(*order.columns, "length", "_s.rank", "_s.k", "_s.pad")


def batches(shards: DataFrame, batch: int, replicas: int, drop_last: bool = False) -> DataFrame:
    """Cut each rank's padded shard into batches of ceil(batch / replicas) rows. No shuffle."""
    local = local_batch(batch, replicas)
    out = shards.withColumn("batch_id", F.floor(F.col("k") / local)).withColumn("slot", F.col("k") % local)
    return out.filter((F.col("batch_id") + 1) * local <= F.col("length")) if drop_last else out


def passes_shuffle(df: DataFrame, id_col: str, passes: DataFrame, seed: int = 0, epoch: int = 0) -> DataFrame:
    """Orders of the passes that ``passes`` names in ``pass_no``: adds ``pass_no`` and ``pos``. One row per id and pass.

    Where ``passes`` says which places of a pass are read (base, n_batches, size), rows far from them are left out early.
    """
    named = passes.agg(F.array_sort(F.collect_set("pass_no")).alias("p")).scalar()
    each, ranges = df.withColumn("pass_no", F.explode(named)), None
    if {"base", "n_batches", "size"} <= set(passes.columns):
        ranges = passes.select("pass_no", F.col("base").alias("first"), (F.col("base") + F.col("n_batches") * F.col("size")).alias("stop")).distinct()
    return hash_position(each, seeded_key(seed, F.lit(epoch), "pass_no", id_col), [id_col], by=["pass_no"], ranges=ranges)


def _segment(index: int, n: int, size: int, batches: int | None) -> tuple[int, int]:
    """Batches of a segment that starts at ``index``, and the index behind it."""
    if not n:
        return 0, index
    first, whole = -(-(n - index % n) // size), -(-n // size)
    count = first if batches is None else batches
    if count < first:
        return count, index + count * size
    passes, more = divmod(count - first, whole)
    top = -(-(index + first * size) // n) * n
    return count, top + passes * -(-whole * size // n) * n + more * size


def resume_plan(segments: DataFrame, n: Column, batch: int) -> DataFrame:
    """Start and end index of each segment of a run that is restarted with other replica counts.

    ``segments`` holds (run, seg, replicas, batches); null ``batches`` run to the end of the pass. A batch moves the
    index by size = replicas * ceil(batch / replicas), a short one at the end of a pass too. Behind that the index
    is rounded up to a multiple of ``n``, the same for all segments of a run, and pass number index // n begins in an
    order of its own.

    Where a segment starts depends on all before it, but one that runs to the end of its pass leaves a whole number of
    passes, from which the next one starts as from 0. So runs are cut there into stretches, the stretches are folded
    side by side, and a running sum over their ends moves each to its place. Only the two running sums see a whole run.
    """
    rows = segments.withColumns({"batches": F.col("batches").cast("bigint"), "n": n}).withColumn(
        "size", (F.col("replicas") * local_batch(batch, F.col("replicas"))).cast("bigint")
    )
    before = Window.partitionBy("run").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.col("batches").isNull()
    rows = rows.withColumns({"_whole": whole, "_stretch": F.coalesce(F.sum(whole.cast("bigint")).over(before), F.lit(0))})
    rows = rows.withColumns({"start": F.lit(0).cast("bigint"), "end": F.lit(0).cast("bigint")})

    def fold(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, index = object(), 0
        for part in parts:
            made = []
            for r, s, total, size, batches in zip(*(part.column(c).to_pylist() for c in ("run", "_stretch", "n", "size", "batches")), strict=True):
                start = index if (r, s) == stretch else 0
                stretch, (count, index) = (r, s), _segment(start, total, size, batches)
                made.append((count, start, index))
            new = dict(zip(("batches", "start", "end"), zip(*made, strict=True), strict=True)) if made else {}
            yield pa.RecordBatch.from_arrays(
                [pa.array(new[c], pa.int64()) if c in new else part.column(c) for c in part.schema.names], part.schema.names
            )

    folded = rows.repartition("run", "_stretch").sortWithinPartitions("run", "_stretch", "seg").mapInArrow(fold, rows.schema)
    earlier = F.coalesce(F.sum(F.when(F.col("_whole"), F.col("end"))).over(before), F.lit(0))
    moved = folded.withColumn("_from", earlier).withColumns({"start": F.col("start") + F.col("_from"), "end": F.col("end") + F.col("_from")})
    return moved.select(*segments.columns, "n", "size", "start", "end")


def resume_passes(plan: DataFrame) -> DataFrame:
    """Parts of segments by pass: adds pass_no, base (place in the pass), first_batch and n_batches."""
    n, size, start = F.col("n"), F.col("size"), F.col("start")
    first, whole = F.ceil((n - start % n) / size), F.ceil(n / size)
    later = F.ceil(F.greatest(F.col("batches") - first, F.lit(0)) / whole)
    rows = plan.filter("n > 0 and batches > 0").withColumns({"_first": first, "_whole": whole})
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), later)))
    begins = F.col("_first") + (F.col("_j") - 1) * F.col("_whole")
    top = round_up(start + F.col("_first") * size, n) + (F.col("_j") - 1) * round_up(F.col("_whole") * size, n)
    is_first = F.col("_j") == 0
    out = rows.withColumns({
        "pass_no": F.floor(F.when(is_first, start).otherwise(top) / n),
        "base": F.when(is_first, start % n).otherwise(0),
        "first_batch": F.when(is_first, 0).otherwise(begins).cast("bigint"),
    })
    most = F.when(is_first, F.col("_first")).otherwise(F.col("_whole"))
    return out.withColumn("n_batches", F.least(most, F.col("batches") - F.col("first_batch"))).drop("_first", "_whole", "_j")


def elastic_resume(orders: DataFrame, passes: DataFrame) -> DataFrame:
    """Rows each (run, seg, batch, rank, slot) reads.

    A part of a pass covers a range of places, so it meets the order of its pass on blocks of ``BLOCK_PLACES`` places;
    batch, rank and slot follow from the place. No place is expanded, and only ids and places are shuffled.
    """
    size, base = F.col("size"), F.col("base")
    upto = F.least(base + F.col("n_batches") * size, F.col("n"))
    covered = passes.withColumn("_upto", upto).filter(F.col("_upto") > base)
    covered = covered.withColumn("_block", F.explode(F.sequence(F.floor(base / BLOCK_PLACES), F.floor((F.col("_upto") - 1) / BLOCK_PLACES))))
    met = orders.withColumn("_block", F.floor(F.col("pos") / BLOCK_PLACES)).join(covered, ["pass_no", "_block"])
    off = (F.col("pos") - base) % size
    rows = met.filter((F.col("pos") >= base) & (F.col("pos") < F.col("_upto"))).withColumns({
        "batch_no": F.col("first_batch") + F.floor((F.col("pos") - base) / size),
        "rank": off % F.col("replicas"),
        "slot": F.floor(off / F.col("replicas")),
    })
    return rows.select("pass_no", "pos", "run", "seg", "replicas", "batch_no", "rank", "slot", *[c for c in orders.columns if c not in ("pass_no", "pos")])


def split_files(df: DataFrame, id_col: str, seed: int = 1000) -> DataFrame:
    """Seeded split of files: with q = n // 20 the first 17q train, the next q test, the rest valid."""
    q = F.floor(F.col("n") / 20)
    name = F.when(F.col("pos") < 17 * q, "train").when(F.col("pos") < 18 * q, "test").otherwise("valid")
    return hash_position(df, seeded_key(seed, id_col), [id_col], total="n").withColumn("split", name)


def split_ordered(df: DataFrame, id_col: str, train: float = 0.8, valid: float = 0.9) -> DataFrame:
    """Split in natural order at int(n * train) and int(n * valid)."""
    cut1, cut2 = (F.floor(F.col("n") * F.lit(x)) for x in (train, valid))
    name = F.when(F.col("pos") < cut1, "train").when(F.col("pos") < cut2, "valid").otherwise("test")
    return natural_order(df, id_col).withColumn("split", name)


def truncate_whole(order: DataFrame, multiple: int) -> DataFrame:
    """Keep the first n // multiple * multiple positions."""
    return order.filter(F.col("pos") < F.floor(F.col("n") / multiple) * multiple)


def skip_finished(planned: DataFrame, log: DataFrame) -> DataFrame:
    """Planned (run, epoch, loop_no) rows after the last finished one of each run."""
    last = log.groupBy("run").agg(F.max(F.struct("epoch", "loop_no")).alias("last"))
    p, d = planned.alias("p"), last.alias("d")
    done = F.struct("p.epoch", "p.loop_no") <= F.col("d.last")
    return p.join(d, (F.col("p.run") == F.col("d.run")) & done, "left_anti")


def committed_steps(steps: DataFrame, by: Sequence[str], order: str, block: Column) -> DataFrame:
    """Drop the first batch of every loop and all batches of loops that do not train."""
    ranked = running(steps, by, [order], block, sums={"_idx": F.lit(1)}, exclusive=True)
    return ranked.filter(F.col("is_training") & (F.coalesce("_idx", F.lit(0)) >= 1)).drop("_idx")
