"""Distributed statistics: keyed sums merged over replicas, carried across syncs, safe to replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainframe.operators.blocked import running, step_block
from trainframe.operators.vectors import vector_sums

SYNC = ["run", "epoch", "sync_no"]


def accumulate(log: DataFrame) -> DataFrame:
    """Sum of deltas per (run, epoch, sync_no, key): partial sums per task, then one merge."""
    return log.groupBy(*SYNC, "key").agg(F.sum("delta").alias("value"))


def accumulate_once(log: DataFrame) -> DataFrame:
    """As ``accumulate`` over a log with retries: the lowest attempt of a sync is its result, later ones are dropped.

    Deltas are summed per attempt first, so finding the first attempt works on totals, not on the log.
    """
    sums = log.groupBy(*SYNC, "attempt", "key").agg(F.sum("delta").alias("value"))
    first = sums.groupBy(*SYNC).agg(F.min("attempt").alias("attempt"))
    return sums.join(first, [*SYNC, "attempt"]).select(*SYNC, "key", "value")


def accumulate_loops(log: DataFrame) -> DataFrame:
    """(run, epoch, sync_no, attempt, key, value) of a log in which some syncs are made inside a loader's loop (``in_loop``).

    A result outside of loops is stored: later attempts read it and count nothing. Code inside a loop is not replayed, so
    a sync there is not stored and every attempt is a result of its own.
    """
    sums = log.groupBy(*SYNC, "in_loop", "attempt", "key").agg(F.sum("delta").alias("value"))
    first = sums.filter(~F.col("in_loop")).groupBy(*SYNC).agg(F.min("attempt").alias("_first"))
    out = sums.join(first, SYNC, "left").filter(F.col("in_loop") | (F.col("attempt") == F.col("_first")))
    return out.select(*SYNC, "attempt", "key", "value")


def carried_totals(log: DataFrame) -> DataFrame:
    """(run, segment, sync_no, key, total): totals persist over syncs until a clear starts a new segment.

    The log holds (run, seq, sync_no, op, key, delta) with op 'add' or 'clear'. A row gives a key's total
    from that sync on; keys without an update at a sync keep their last row.
    """
    cleared = F.when(F.col("op") == "clear", 1).otherwise(0)
    marked = running(log, ["run"], ["seq"], step_block("seq"), sums={"segment": cleared}).filter("op = 'add'")
    sums = marked.groupBy("run", "segment", "sync_no", "key").agg(F.sum("delta").alias("_delta"))
    total = running(sums, ["run", "segment", "key"], ["sync_no"], step_block("sync_no"), sums={"total": F.col("_delta")})
    return total.drop("_delta")


def final_totals(log: DataFrame) -> DataFrame:
    """(run, key, total) after the last clear of each run, which needs no order beyond that clear."""
    last = log.filter("op = 'clear'").groupBy("run").agg(F.max("seq").alias("_last"))
    kept = log.filter("op = 'add'").join(last, "run", "left").filter(F.col("seq") > F.coalesce("_last", F.lit(-1)))
    return kept.groupBy("run", "key").agg(F.sum("delta").alias("total"))


def reduce_vectors(df: DataFrame, by: Sequence[str], values: str) -> DataFrame:
    """Element-wise sum of arrays per group: vectors are summed per task, then chunks of dimensions are merged."""
    return vector_sums(df, by, values)


def reduce_counters(df: DataFrame, by: Sequence[str], counter: str) -> DataFrame:
    """Sum of map values per (group, key)."""
    return df.select(*by, F.explode(counter).alias("key", "_n")).groupBy(*by, "key").agg(F.sum("_n").alias("count"))


def reduce_sets(df: DataFrame, by: Sequence[str], members: str) -> DataFrame:
    """Union of arrays as sets, one row per (group, member)."""
    return df.select(*by, F.explode(members).alias("member")).distinct()


def any_flag(df: DataFrame, by: Sequence[str], flag: Column) -> DataFrame:
    """Logical or over replicas."""
    return df.groupBy(*by).agg(F.bool_or(flag).alias("any_flag"))


def leader_value(df: DataFrame, by: Sequence[str], rank: str, value: str) -> DataFrame:
    """Give every replica the value of rank 0 of its group."""
    lead = df.filter(F.col(rank) == 0).select(*by, F.col(value).alias("leader_" + value))
    return df.join(lead, list(by))


def weighted_scores(df: DataFrame, by: Sequence[str], loss: Column, weight: Column, correct: Column) -> DataFrame:
    """sum(loss * weight) / sum(weight) and correct / total."""
    return df.groupBy(*by).agg(
        F.sum(weight).alias("total"),
        (F.sum(loss * weight) / F.sum(weight)).alias("loss"),
        (F.sum(correct) / F.sum(weight)).alias("accuracy"),
    )


def argmax(scores: Column) -> Column:
    """Zero-based index of the first largest score."""
    return F.array_position(scores, F.array_max(scores)) - 1


def replica_mean(df: DataFrame, by: Sequence[str], metric: Column) -> DataFrame:
    """Mean over replicas, each counted once whatever its number of rows."""
    return df.groupBy(*by).agg((F.sum(metric) / F.sum(F.lit(1.0))).alias("mean"))


def loss_over(df: DataFrame, by: Sequence[str], loss: Column, size: Column) -> DataFrame:
    """Summed loss over a given size (rows or batches), with its perplexity."""
    out = df.groupBy(*by).agg((F.sum(loss) / size).alias("loss"))
    return out.withColumn("perplexity", F.exp("loss"))


def logging_windows(df: DataFrame, by: Sequence[str], idx: str, interval: int, metrics: dict[str, Column]) -> DataFrame:
    """Sums over logging windows divided by ``interval``.

    Window 1 holds batches 0..interval and so one more than the others; a last window that never
    reaches its closing batch is not reported.
    """
    window = F.greatest(F.ceil(F.col(idx) / interval), F.lit(1))
    sums = [(F.sum(c) / interval).alias(name) for name, c in metrics.items()]
    out = df.groupBy(*by, window.alias("log_window")).agg(*sums, F.max(idx).alias("_last"))
    return out.filter(F.col("_last") == F.col("log_window") * interval).drop("_last")


def best_so_far(df: DataFrame, by: Sequence[str], order: str, metric: str, mode: str, block: Column | None = None) -> DataFrame:
    """Rows whose metric is strictly better than all earlier ones of the group; ``mode`` is 'max' or 'min'."""
    block = step_block(order) if block is None else block
    if mode == "max":
        out = running(df, by, [order], block, maxs={"_best": F.col(metric)}, exclusive=True)
        better = F.col(metric) > F.col("_best")
    elif mode == "min":
        out = running(df, by, [order], block, mins={"_best": F.col(metric)}, exclusive=True)
        better = F.col(metric) < F.col("_best")
    else:
        raise ValueError("mode must be 'max' or 'min'")
    return out.filter(F.col("_best").isNull() | better).drop("_best")


def final_metrics(df: DataFrame) -> DataFrame:
    """(trial, metric, iterations, value): last value of each metric per trial."""
    return df.groupBy("trial", "metric").agg(F.max("iter").alias("iterations"), F.max_by("value", "iter").alias("value"))


def best_trial(df: DataFrame, by: Sequence[str], metric: str, mode: str) -> DataFrame:
    """Best trial per group by the last value of ``metric``; ties go to the lower trial. Mode is required."""
    if mode not in ("max", "min"):
        raise ValueError("mode must be 'max' or 'min'")
    last = df.filter(F.col("metric") == metric).groupBy(*by, "trial").agg(F.max_by("value", "iter").alias("value"))
    key = F.col("value") if mode == "min" else -F.col("value")
    best = last.groupBy(*by).agg(F.min(F.struct(key.alias("k"), "trial", "value")).alias("b"), F.count(F.lit(1)).alias("trials"))
    return best.select(*by, F.col("b.trial").alias("trial"), F.col("b.value").alias("value"), "trials")
