"""Step profiles and gradient statistics per job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONFIG = ["job_id", "nodes", "replicas", "local_bsz"]


def step_profile(steps: DataFrame) -> DataFrame:
    """Times and counts per job and configuration, from (.., is_accum, step_time, sync_time) rows."""
    optim = ~F.col("is_accum")
    return steps.groupBy(*CONFIG).agg(
        F.sum(F.when(F.col("is_accum"), F.col("step_time")).otherwise(0.0)).alias("accum_time"),
        F.count_if("is_accum").alias("accum_count"),
        F.sum(F.when(optim, F.col("step_time")).otherwise(0.0)).alias("optim_time"),
        F.sum(F.when(optim, F.col("sync_time")).otherwise(0.0)).alias("sync_time"),
        F.count_if(optim).alias("optim_count"),
    )


def usable(profile: DataFrame) -> DataFrame:
    """Configurations with at least one optimizer step."""
    return profile.filter("optim_count > 0")


def profile_means(profile: DataFrame) -> DataFrame:
    """Mean accumulation and optimizer time. Optimizer time without sync counts as accumulation time.

    ``valid`` is false where sync time exceeds optimizer time, which a sound log never shows.
    """
    p = usable(profile)
    local = F.col("accum_time") + F.col("optim_time") - F.col("sync_time")
    return p.select(
        *CONFIG,
        (local / (F.col("accum_count") + F.col("optim_count"))).alias("accum_mean"),
        (F.col("optim_time") / F.col("optim_count")).alias("optim_mean"),
        (F.col("optim_time") >= F.col("sync_time")).alias("valid"),
    )


def max_profiled(profile: DataFrame) -> DataFrame:
    """Largest replica count seen per job."""
    return profile.groupBy("job_id").agg(F.max("replicas").alias("max_profiled"))


def gradient_params(reports: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum over models of each model's latest (sqr, var)."""
    latest = reports.groupBy(*by, "model").agg(F.max_by(F.struct("sqr", "var"), "step").alias("g"))
    return latest.groupBy(*by).agg(F.sum("g.sqr").alias("sqr"), F.sum("g.var").alias("var"))


def step_split(steps: DataFrame) -> DataFrame:
    """Compute and sync seconds per step and job."""
    n = F.count(F.lit(1))
    return steps.groupBy("job_id").agg(
        ((F.sum("step_time") - F.sum("sync_time")) / n).alias("compute"), (F.sum("sync_time") / n).alias("sync")
    )
