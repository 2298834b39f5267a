"""Job records: rule checks, rollups of pods, histories and listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainframe.functions.records import micros_between, runtime_seconds
from trainframe.operators.blocked import running

# Phases of a job that still needs resources, longest job name, exit code of a wanted stop.
ACTIVE = ("Pending", "Running", "Starting", "Stopping")
NAME_LENGTH = 63
STOPPED = 143


def active_jobs(jobs: DataFrame) -> DataFrame:
    """Jobs in an active phase; a job without a phase is not."""
    return jobs.filter(F.col("phase").isin(*ACTIVE))


def broken_rules(df: DataFrame, key: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """One row (key, rule) per rule whose condition holds."""
    hits = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))
    return df.select(*key, F.explode(hits).alias("rule"))


def spec_rules() -> dict[str, Column]:
    """Rules on name, min_replicas and max_replicas; an absent minimum is 0 and an absent maximum unbounded."""
    lo, hi = F.coalesce("min_replicas", F.lit(0)), F.col("max_replicas")
    return {
        "max_below_min": hi < lo,
        "max_below_one": hi < 1,
        "min_negative": F.col("min_replicas") < 0,
        "name_too_long": F.length("name") > NAME_LENGTH,
    }


def batch_rules() -> dict[str, Column]:
    """Rules on batch, max_batch, min_local and max_local."""
    b = F.col("batch")
    return {"max_below_batch": F.col("max_batch") < b, "lower_above_batch": F.col("min_local") > b, "upper_below_batch": F.col("max_local") < b}


def spec_changes(history: DataFrame, block: Column) -> DataFrame:
    """(job, ts, seq, spec, old_spec) of updates that change an immutable spec."""
    rows = running(history, ["job"], ["ts", "seq"], block, lags={"old_spec": F.col("spec")})
    return rows.filter(F.col("old_spec").isNotNull() & (F.col("old_spec") != F.col("spec")))


def job_info(jobs: DataFrame) -> DataFrame:
    """Replica bounds and gradient defaults from hints and spec.

    Twice the profiled replicas, at least 1, capped by the spec's maximum and floored by its minimum;
    then the largest batch must still give every replica the smallest local batch. Without a fitted
    model, or if not preemptible, speedup equals the replica count (``linear``).
    """
    lo = F.coalesce("min_replicas", F.lit(0))
    most = F.greatest(2 * F.coalesce("max_profiled", F.lit(0)), F.lit(1))
    most = F.greatest(F.least(most, F.coalesce(F.nullif("max_replicas", F.lit(0)), most)), lo)
    modelled = F.col("params").isNotNull() & F.col("init_batch").isNotNull() & F.coalesce("preemptible", F.lit(True))
    batch, local = F.coalesce(F.nullif("max_batch", F.lit(0)), "init_batch"), F.coalesce(F.nullif("min_local", F.lit(0)), F.lit(1))
    tight = modelled & F.col("has_bounds") & (batch < local * most)
    return jobs.select(
        "job", lo.alias("min_replicas"), F.when(tight, F.floor(batch / local)).otherwise(most).alias("max_replicas"),
        F.coalesce("preemptible", F.lit(True)).alias("preemptible"), (~modelled).alias("linear"),
        F.coalesce("grad.sqr", F.lit(0.0)).alias("sqr"), F.coalesce("grad.var", F.lit(1.0)).alias("var"),
    )


def pod_counts(pods: DataFrame) -> DataFrame:
    """(job, ready, scheduled): pods with all of at least one container ready; pods with condition PodScheduled true."""
    ready = (F.coalesce(F.size("ready"), F.lit(0)) > 0) & F.forall("ready", lambda x: x)
    scheduled = F.coalesce(F.col("conditions")["PodScheduled"] == "True", F.lit(False))
    return pods.groupBy("job").agg(F.count_if(ready).alias("ready"), F.count_if(scheduled).alias("scheduled"))


def job_outcome(pods: DataFrame) -> DataFrame:
    """(job, outcome, pod): Succeeded, Failed with its first fatal pod in name order, or null while undecided.

    Succeeded needs as many pods as replicas, all succeeded; a pod without a phase has not. A failed pod is not fatal after an admission
    error, when resources ran out, or when a preemptible job's pod was deleted or told to stop.
    """
    reason = F.coalesce("reason", F.lit("None"))
    stopped = F.col("deleted").isNotNull() | F.coalesce(F.array_contains("exit_codes", STOPPED), F.lit(False))
    mild = (reason == "UnexpectedAdmissionError") | F.startswith(reason, F.lit("Outof")) | (F.coalesce("preemptible", F.lit(False)) & stopped)
    fatal = F.col("phase").isin("Failed", "Unknown") & ~mild
    per = pods.groupBy("job").agg(
        F.count(F.lit(1)).alias("_n"),
        F.bool_and(F.col("phase").eqNullSafe("Succeeded")).alias("_all"),
        F.min("replicas").alias("_lo"),
        F.max("replicas").alias("_hi"),
        F.min(F.when(fatal, F.col("pod"))).alias("_fatal"),
    )
    won = F.col("_all") & (F.col("_n") == F.col("_lo")) & (F.col("_n") == F.col("_hi"))
    outcome = F.when(won, "Succeeded").when(F.col("_fatal").isNotNull(), "Failed")
    return per.select("job", outcome.alias("outcome"), F.when(~won, F.col("_fatal")).alias("pod"))


def group_problems(pods: DataFrame) -> DataFrame:
    """(job, problem) for pods with missing annotations, on a wrong node, or of unlike groups; the first that applies."""
    missing = F.col("grp").isNull() | F.col("replicas").isNull() | F.col("rank").isNull() | F.col("want_node").isNull()
    per = pods.groupBy("job").agg(
        F.bool_or(missing).alias("_missing"),
        F.bool_or(F.coalesce(F.col("node") != F.col("want_node"), F.lit(False))).alias("_node"),
        ((F.min("grp") != F.max("grp")) | (F.min("replicas") != F.max("replicas")) | F.bool_or(F.col("rank") >= F.col("replicas"))).alias("_unlike"),
    )
    problem = F.when(F.col("_missing"), "annotations").when(F.col("_node"), "node").when(F.col("_unlike"), "inconsistent")
    return per.select("job", problem.alias("problem")).filter("problem is not null")


def completion_summary(jobs: DataFrame) -> DataFrame:
    """(status, submitted, seconds): finished jobs and their summed durations by status."""
    took = F.floor(micros_between(F.col("created"), F.col("completed")) / 1000000)
    return jobs.groupBy("status").agg(F.count(F.lit(1)).alias("submitted"), F.sum(took).alias("seconds"))


def job_listing(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs by start time with their run time in whole minutes and seconds."""
    took = runtime_seconds(F.col("created"), F.col("completed"), now)
    cols = jobs.withColumn("minutes", F.floor(took / 60)).withColumn("seconds", took % 60)
    return cols.orderBy("created", "job")


def restarts(events: DataFrame, block: Column) -> DataFrame:
    """Adds ``grp``, the number of starts so far, and ``restart`` where replicas or a rank's node changed.

    Events hold (job, ts, seq, phase, allocation).
    """
    started = (F.col("phase") == "Starting").cast("int")
    rows = running(events, ["job"], ["ts", "seq"], block, sums={"grp": started}, lags={"_was": F.col("allocation")})
    return rows.withColumn("restart", F.col("_was").isNotNull() & (F.col("_was") != F.col("allocation"))).drop("_was")


def phase_times(events: DataFrame, block: Column) -> DataFrame:
    """(job, phase, times, seconds): visits to each phase and time until the next event."""
    rows = running(events, ["job"], ["ts", "seq"], block, leads={"_next": F.col("ts")})
    took = micros_between(F.col("ts"), F.col("_next"))
    return rows.groupBy("job", "phase").agg(F.count(F.lit(1)).alias("times"), (F.coalesce(F.sum(took), F.lit(0)) / 1e6).alias("seconds"))
