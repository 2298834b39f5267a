"""Small column functions over job records: quantities, tags, names, times, hints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Quantity suffixes and the multiplier each stands for.
SUFFIXES = {
    "": 1.0, "m": 1e-3, "k": 1e3, "M": 1e6, "G": 1e9, "T": 1e12, "P": 1e15, "E": 1e18,
    "Ki": 2.0**10, "Mi": 2.0**20, "Gi": 2.0**30, "Ti": 2.0**40, "Pi": 2.0**50, "Ei": 2.0**60,
}
QUANTITY = "^([+-]?[0-9.]+(?:[eE][+-]?[0-9]+)?)(m|k|[KMGTPE]i|[MGTPE])?$"


def quantity(name: Column, value: Column) -> Column:
    """Amount in smallest whole units, rounded up; CPU counts in thousandths. Null if not a quantity."""
    number = F.regexp_extract(value, QUANTITY, 1).try_cast("double")
    factors = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    suffix = F.regexp_extract(value, QUANTITY, 2)
    # Thousandths of a CPU are already whole units, so 'm' and the CPU factor cancel before multiplying.
    factor = F.when((name == "cpu") & (suffix == "m"), 1.0).when(name == "cpu", factors[suffix] * 1000)
    by = factor.otherwise(F.when(suffix == "m", F.lit(1.0) / 1000).otherwise(factors[suffix]))
    return F.ceil(number * by)


def tag(prefix: Column, name: Column) -> Column:
    """Join a tag prefix and a name with exactly one added slash."""
    return F.when(prefix == "", name).when(F.endswith(prefix, F.lit("/")), F.concat(prefix, name)).otherwise(
        F.concat_ws("/", prefix, name)
    )


def trial_fields(name: Column) -> Column:
    """Struct (base, replicas, restarts, id) of a trial name 'Base_replicas_restarts_id'."""
    p = F.split(name, "_")
    return F.struct(
        F.array_join(F.slice(p, 1, F.size(p) - 3), "_").alias("base"),
        F.element_at(p, -3).cast("int").alias("replicas"),
        F.element_at(p, -2).cast("int").alias("restarts"),
        F.element_at(p, -1).alias("id"),
    )


def parse_time(text: Column) -> Column:
    """ISO time with zone as a timestamp."""
    return F.to_timestamp(text)


def runtime_seconds(created: Column, completed: Column, now: Column) -> Column:
    """Seconds from creation to completion, or to ``now`` while running; whole days count."""
    return F.floor(micros_between(created, F.coalesce(completed.cast("timestamp"), now)) / 1000000)


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from start to end. Times without zone are read in the session's zone."""
    return F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))


HINTS = """initBatchSize bigint, localBszBounds array<bigint>, globalBatchSize bigint, maxBatchSize bigint, maxProfiledReplicas bigint,
    gradientAccumulation boolean, gradParams struct<norm: double, var: double>,
    perfParams struct<alpha_c: double, beta_c: double, alpha_n: double, beta_n: double, alpha_r: double, beta_r: double, gamma: double>"""


def parse_hints(body: Column) -> Column:
    """Known hint fields of a JSON body; other fields are dropped."""
    return F.from_json(body, HINTS)


def rename_hints(h: Column) -> Column:
    """Snake-case hints; missing gradient statistics become (1, 1)."""
    grad = F.struct(
        F.coalesce(h["gradParams"]["norm"], F.lit(1.0)).alias("sqr"), F.coalesce(h["gradParams"]["var"], F.lit(1.0)).alias("var")
    )
    return F.struct(
        h["initBatchSize"].alias("init_batch_size"), h["localBszBounds"].alias("local_bsz_bounds"),
        h["globalBatchSize"].alias("global_batch_size"), h["maxBatchSize"].alias("max_batch_size"),
        h["maxProfiledReplicas"].alias("max_profiled_replicas"), h["gradientAccumulation"].alias("gradient_accumulation"),
        grad.alias("grad_params"), h["perfParams"].alias("perf_params"),
    )
