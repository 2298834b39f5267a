"""Best batch configuration per allocation, speedups, batch changes and worker counts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainframe.functions import perf
from trainframe.operators.blocked import running, step_block
from trainframe.session import for_compute

# Rounding slack, gain needed to change the batch, share of single-worker speedup each
# node must bring, gain needed to resize, and resize distance below which the size is kept.
EPS = 1e-8
CHANGE_GAIN = 1.05
NODE_SHARE = 0.5
RESIZE_GAIN = 1.05
RESIZE_MARGIN = 0.15


INPUTS = ("params", "grad", "init_batch", "max_batch", "min_local", "max_local", "accumulation")


SEARCH_ROWS = 2048


def _best_of_grid(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Goodput, local batch and accumulation steps of the best grid point of each row of _search_inputs."""
    nodes, replicas, init, top, lo, hi, accumulation, ac, bc, an, bn, ar, br, gamma, sqr, var = (c[:, None] for c in x.T)
    i = np.arange(perf.GRID)
    first = np.maximum(init, lo * replicas)
    local = np.where(i == perf.GRID - 1, top, first * (top / first) ** (i / (perf.GRID - 1.0))) / replicas
    least = (replicas == 1) & (local > init + EPS)
    steps = np.where(accumulation > 0, np.maximum(np.ceil(local / hi - EPS) - 1, least), 0)
    whole = np.where((accumulation == 0) & (replicas == 1), init, np.ceil(local / (steps + 1) - EPS))
    bsz = np.minimum(hi, np.maximum(lo, whole))
    extra = np.maximum(replicas - 2, perf.TINY)
    net = np.where(nodes > 1, an + bn * extra, np.where(replicas > 1, ar + br * extra, perf.TINY + perf.TINY * extra))
    compute = ac + bc * bsz
    batch = replicas * bsz * (steps + 1)
    scale = batch / init
    below = var / scale + sqr
    throughput = batch / (steps * compute + (compute**gamma + net**gamma) ** (1 / gamma))
    value = throughput * np.where(below > 0, (var + sqr) / below, 1.0) / scale
    at = value.argmax(1)
    row = np.arange(len(x))
    return value[row, at], bsz[row, at], steps[row, at]


def _search(*columns: pd.Series) -> pd.DataFrame:
    x = np.stack([c.to_numpy(float) for c in columns], 1)
    fine = ~np.isnan(x).any(1) & (x[:, 1] > 0)
    parts = np.array_split(x[fine], max(1, -(-int(fine.sum()) // SEARCH_ROWS)))
    with np.errstate(all="ignore"):
        found = [np.concatenate(v) for v in zip(*map(_best_of_grid, parts), strict=True)]
    out = pd.DataFrame({"goodput": np.nan, "local_bsz": pd.array([None] * len(x), "Int64"), "accum_steps": pd.array([None] * len(x), "Int64")})
    out.loc[fine, "goodput"] = found[0]
    out.loc[fine, "local_bsz"], out.loc[fine, "accum_steps"] = found[1].astype(np.int64), found[2].astype(np.int64)
    return out


def with_best(df: DataFrame, nodes: Column, replicas: Column, out: str = "_best") -> DataFrame:
    """Add struct ``out`` (goodput, local_bsz, accum_steps): the best of 50 geometric total batch sizes.

    Reads the columns named in INPUTS. Each Arrow batch is searched as one block of (rows, candidates), so the
    search needs no shuffle and a row goes in and out once. Ties go to the smaller grid index. A row without a
    model, statistics or replicas has a null result.
    """
    top = F.coalesce("max_batch", "init_batch")
    inputs = [nodes, replicas, F.col("init_batch"), top, F.coalesce("min_local", F.lit(1)), F.coalesce("max_local", top), F.col("accumulation").cast("int")]
    inputs += [F.col("params")[p] for p in perf.PARAMS] + [F.col("grad")["sqr"], F.col("grad")["var"]]
    search = F.pandas_udf(_search, "goodput double, local_bsz bigint, accum_steps bigint")
    return df.withColumn(out, search(*[c.cast("double") for c in inputs]))


def search(df: DataFrame) -> DataFrame:
    """Best configuration for each row's nodes and replicas."""
    found = with_best(for_compute(df), F.col("nodes"), F.col("replicas"))
    return found.select("*", "_best.*").drop("_best")


def config_grid(jobs: DataFrame, nodes: list[int], replicas: list[int], bsz: list[int], accum: list[int]) -> DataFrame:
    """Every listed configuration of each job with nodes <= replicas, built inside the row."""
    lists = {"nodes": nodes, "replicas": replicas, "local_bsz": bsz, "accum_steps": accum}
    out = jobs
    for name, values in lists.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return out.filter("nodes <= replicas")


def evaluate(df: DataFrame) -> DataFrame:
    """Adds throughput, efficiency and goodput; ``valid`` is false below the initial batch size."""
    n, r, b, a = (F.col(c) for c in ("nodes", "replicas", "local_bsz", "accum_steps"))
    batch = r * b * (a + 1)
    return (
        df.withColumn("throughput", perf.throughput(F.col("params"), n, r, b, a))
        .withColumn("efficiency", perf.efficiency(F.col("grad"), F.col("init_batch"), batch))
        .withColumn("goodput", F.col("throughput") * F.col("efficiency"))
        .withColumn("valid", batch >= F.col("init_batch"))
    )


def speedups(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """(job_id, nodes, replicas, speedup) relative to one replica on one node; (0, 0) gives 0.

    Distinct requests are searched once. The base is searched once per job.
    """
    asked = requests.select("job_id", "nodes", "replicas").distinct()
    one = F.lit(1)
    base = with_best(for_compute(jobs, "job_id"), one, one).select("*", F.col("_best.goodput").alias("_base")).drop("_best")
    rows = for_compute(asked.join(base, "job_id"), "job_id", "nodes", "replicas")
    found = with_best(rows, F.col("nodes"), F.col("replicas"))
    ratio = F.when(F.col("replicas") == 0, F.lit(0.0)).otherwise(F.col("_best.goodput") / F.col("_base"))
    return found.select("job_id", "nodes", "replicas", ratio.alias("speedup"))


def batch_change(df: DataFrame) -> DataFrame:
    """Next (local_bsz, accum_steps) from the current ones and the best ones for the allocation.

    Without autoscaling the batch is split evenly; the first time the best is taken; later only if it
    is more than 5 % better.
    """
    n, r = F.col("nodes"), F.col("replicas")
    found = with_best(for_compute(df), n, r)
    now = perf.goodput(F.col("params"), F.col("grad"), F.col("init_batch"), n, r, F.col("current_bsz"), F.col("current_accum"))
    ratio = F.col("_best.goodput") / F.greatest(now, F.lit(EPS))
    fixed = ~F.col("autoscale")
    fresh = F.coalesce(F.col("current_bsz"), F.lit(0)) == 0
    take = fresh | (ratio > CHANGE_GAIN)
    even = F.ceil(F.col("init_batch") / r)
    return found.withColumn(
        "next_bsz", F.when(fixed, even).when(take, F.col("_best.local_bsz")).otherwise(F.col("current_bsz"))
    ).withColumn(
        "next_accum", F.when(fixed, F.lit(0)).when(take, F.col("_best.accum_steps")).otherwise(F.col("current_accum"))
    ).drop("_best")


def packed_workers(slots: DataFrame) -> DataFrame:
    """(cluster, worker, nodes_used): workers filled into nodes in order, from (cluster, node_order, capacity)."""
    live = running(
        slots.filter("capacity > 0"), ["cluster"], ["node_order"], step_block("node_order"),
        sums={"_end": F.col("capacity"), "nodes_used": F.lit(1)},
    )
    return live.select(
        "cluster", F.explode(F.sequence(F.col("_end") - F.col("capacity") + 1, F.col("_end"))).alias("worker"), "nodes_used"
    )


def recommend_workers(jobs: DataFrame, slots: DataFrame) -> DataFrame:
    """(job_id, workers): the largest count whose speedup per node is at least half that of one worker.

    The current count stays when the gain is below 5 % or the new count is within 15 % of it. A job
    without a model gets one worker. ``jobs`` holds cluster, current and the search columns.
    """
    one, w = F.lit(1), F.col("worker")
    base = with_best(for_compute(jobs.filter(F.col("params").isNotNull()), "job_id"), one, one)
    base = base.withColumn("_base", F.col("_best.goodput")).drop("_best")
    rows = with_best(for_compute(base.join(packed_workers(slots), "cluster"), "job_id", "worker"), w, w)
    rows = rows.withColumn("speedup", F.col("_best.goodput") / F.col("_base"))
    ok = F.col("speedup") / F.col("nodes_used") >= NODE_SHARE
    per = rows.groupBy("job_id", "current").agg(
        F.max(F.when(ok, F.struct("worker", "speedup"))).alias("b"),
        F.max(F.when(F.col("worker") == F.col("current"), F.col("speedup"))).alias("now"),
    )
    count, gain = F.coalesce("b.worker", F.lit(0)), F.coalesce("b.speedup", F.lit(0.0))
    stay = (gain < F.col("now") * RESIZE_GAIN) | (F.abs(count + 1 - F.col("current")) < RESIZE_MARGIN * F.col("current"))
    modelled = per.select("job_id", F.when(stay, F.col("current")).otherwise(count).alias("workers"))
    plain = jobs.filter(F.col("params").isNull()).select("job_id", F.lit(1).cast("bigint").alias("workers"))
    return modelled.unionByName(plain)


def throughput_by_scale(df: DataFrame, scales: range = range(1, 17)) -> DataFrame:
    """Wide predicted throughput per job, one column per replica count, all on one node."""
    cols = [
        perf.throughput(F.col("params"), F.lit(1), F.lit(s), F.col("local_bsz"), F.lit(0)).alias(f"replicas_{s}") for s in scales
    ]
    return df.select("job_id", *cols)


def series_product(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Product of two labelled series at equal time and labels."""
    joined = a.withColumnRenamed("value", "_a").join(b.withColumnRenamed("value", "_b"), on)
    return joined.select(*on, (F.col("_a") * F.col("_b")).alias("value"))
