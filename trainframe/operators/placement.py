"""Allocations as tables: ranks, quotas, fits, differences, scores and choices among given candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainframe.operators.blocked import running, step_block
from trainframe.operators.position import sorted_position
from trainframe.operators.ranktree import first_nodes

# Utility range a size is kept in, its target, and the factor on jobs that would restart.
KEEP_UTILITY = (0.35, 0.65)
TARGET_UTILITY = 0.5
RESTART_FACTOR = 0.9

# Absolute and relative difference up to which two utilities count as equal.
CLOSE = (1e-8, 1e-5)


def group_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], out: str = "rank") -> DataFrame:
    """Rank from 0 within each group by a total order, through one balanced sort over (group, order)."""
    by = list(by)
    placed = sorted_position(df, [*by, *order], out="_pos")
    first = placed.groupBy(*by).agg(F.min("_pos").alias("_first"))
    return placed.join(first, by).withColumn(out, F.col("_pos") - F.col("_first")).drop("_pos", "_first")


def rank_jobs(jobs: DataFrame) -> DataFrame:
    """Pinned jobs first, then fewer minimum replicas, then older; adds ``rank`` per cluster."""
    return group_rank(jobs, ["cluster"], [~F.col("pinned"), "min_replicas", "created", "job"])


def rank_nodes(nodes: DataFrame) -> DataFrame:
    """Preemptible nodes last, then by name; adds ``rank`` per cluster."""
    return group_rank(nodes, ["cluster"], ["preemptible", "node"])


def _shape() -> Column:
    """A job's resources as a sorted array, which can be a key."""
    return F.array_sort(F.map_entries(F.col("resources").cast("map<string,bigint>")))


def first_fit(jobs: DataFrame, ranked_nodes: DataFrame) -> DataFrame:
    """(cluster, job, allocation): the first node by rank that holds max(min_replicas, 1) replicas, repeated; [] if none.

    Each distinct request of a cluster is answered once and goes down a tree over the ranked nodes.
    """
    asked = jobs.withColumns({"shape": _shape(), "need": F.greatest("min_replicas", F.lit(1)).cast("bigint")})
    key = ["cluster", "shape", "need"]
    best = first_nodes(asked.select(*key).distinct(), ranked_nodes).select(*key, "node")
    empty = F.array().cast("array<string>")
    allocation = F.when(F.col("node").isNull(), empty).otherwise(F.array_repeat("node", F.col("need").cast("int")))
    return asked.join(best, key, "left").select("cluster", "job", allocation.alias("allocation"))


def schedulable(jobs: DataFrame, ranked_nodes: DataFrame) -> DataFrame:
    """Jobs for which some node has every requested amount, answered once per distinct request in the same way."""
    asked = jobs.withColumn("shape", _shape())
    requests = asked.select("cluster", "shape", F.lit(1).cast("bigint").alias("need")).distinct()
    kept = first_nodes(requests, ranked_nodes).select("cluster", "shape")
    return asked.join(kept, ["cluster", "shape"], "left_semi").drop("shape")


def allocation_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(job, old, new) where the allocation list changes; an absent job has the empty list."""
    empty = F.array().cast("array<string>")
    both = old.select("job", F.col("allocation").alias("_o")).join(new.select("job", F.col("allocation").alias("_n")), "job", "full")
    both = both.select("job", F.coalesce("_o", empty).alias("old"), F.coalesce("_n", empty).alias("new"))
    return both.filter(~F.col("old").eqNullSafe(F.col("new")))


def allocation_counts(alloc: DataFrame) -> DataFrame:
    """(job, node, replicas) from lists of nodes, one entry per replica."""
    return alloc.select("job", F.explode("allocation").alias("node")).groupBy("job", "node").agg(F.count(F.lit(1)).alias("replicas"))


def allocation_lists(counts: DataFrame) -> DataFrame:
    """Inverse of ``allocation_counts``, nodes in name order."""
    parts = F.sort_array(F.collect_list(F.struct("node", "replicas")))
    lists = counts.groupBy("job").agg(parts.alias("_p"))
    return lists.select("job", F.flatten(F.transform("_p", lambda e: F.array_repeat(e["node"], e["replicas"].cast("int")))).alias("allocation"))


def active_nodes(alloc: DataFrame, desired: Column | None = None, prefix: str = "~") -> DataFrame:
    """Distinct nodes in use and, up to a desired count, numbered placeholders for missing ones."""
    used = alloc.select(F.explode("allocation").alias("node")).distinct()
    if desired is None:
        return used
    missing = used.agg((desired - F.count(F.lit(1))).alias("_m")).filter("_m > 0")
    extra = missing.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_m") - 1)).alias("_k"))
    return used.unionByName(extra.select(F.concat(F.lit(prefix), F.col("_k").cast("string")).alias("node")))


def missing_workers(current: DataFrame, live: DataFrame) -> DataFrame:
    """Workers that are not on a live node."""
    return current.join(live, "node", "left_anti")


def quota_fill(df: DataFrame, by: Sequence[str], order: str, amount: str, cap: str, block: Column | None = None) -> DataFrame:
    """Adds ``given``: each row gets what is left of its group's cap when rows are served in order."""
    block = step_block(order) if block is None else block
    rows = running(df, by, [order], block, sums={"_upto": F.col(amount)})
    given = F.least("_upto", cap) - F.least(F.col("_upto") - F.col(amount), F.col(cap))
    return rows.withColumn("given", given).drop("_upto")


def serve_from_start(asks: DataFrame, supply: DataFrame, by: Sequence[str], order: str, amount: str, cap: str, width: int = 256) -> DataFrame:
    """Rows (columns of ``asks``, those of ``supply``, ``given``): each ask takes up to its cap from the supply rows of its group in order.

    Amounts and caps are whole numbers; every ask meets the full supply. One running sum gives each supply row the
    range of units it holds; ask and supply meet on steps of ``width`` units, so what is compared are the rows that
    give something and at most one step more per ask, not all rows of a group. Rows that give nothing are left out.
    """
    rows = running(supply.filter(F.col(amount) > 0), by, [order], step_block(order), sums={"_end": F.col(amount)})
    rows = rows.withColumn("_start", F.col("_end") - F.col(amount)).withColumn("_step", F.floor(F.col("_start") / width))
    steps = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(cap) - 1) / width))
    met = asks.filter(F.col(cap) > 0).withColumn("_step", F.explode(steps)).join(rows, [*by, "_step"]).filter(F.col("_start") < F.col(cap))
    return met.withColumn("given", F.least(F.col(amount), F.col(cap) - F.col("_start"))).drop("_start", "_end", "_step")


def first_holder(states: DataFrame) -> DataFrame:
    """Drop rows from the second distributed job on, per (candidate, node) in job order.

    ``states`` holds (candidate, job, job_order, node, replicas); a job on several nodes is distributed.
    """
    spread = states.filter("replicas > 0").groupBy("candidate", "job").agg(F.count(F.lit(1)).alias("_nodes"))
    marked = states.join(spread, ["candidate", "job"], "left")
    holds = ((F.coalesce("_nodes", F.lit(0)) > 1) & (F.col("replicas") > 0)).cast("int")
    rows = running(marked, ["candidate", "node"], ["job_order"], step_block("job_order"), sums={"_held": holds})
    return rows.filter("_held <= 1").drop("_held", "_nodes")


def cluster_utility(states: DataFrame, job_resources: DataFrame, node_resources: DataFrame, speedups: DataFrame) -> DataFrame:
    """(candidate, utility): per resource the sum over jobs of speedup / replicas times share of active nodes; then the maximum.

    ``states`` is (candidate, job, node, replicas); resources are (job or node, resource, amount) rows;
    speedups are (candidate, job, speedup). A candidate that places nothing has utility 0.
    """
    used = states.filter("replicas > 0")
    active = used.select("candidate", "node").distinct().join(node_resources, "node")
    total = active.groupBy("candidate", "resource").agg(F.sum("amount").alias("_total"))
    jobs = used.groupBy("candidate", "job").agg(F.sum("replicas").alias("_r")).join(speedups, ["candidate", "job"])
    asks = jobs.join(job_resources.filter("amount > 0"), "job").join(total, ["candidate", "resource"])
    share = F.col("_r") * F.col("amount") / F.col("_total")
    per = asks.groupBy("candidate", "resource").agg(F.sum(F.col("speedup") / F.col("_r") * share).alias("_u"))
    best = per.groupBy("candidate").agg(F.max("_u").alias("_best"))
    return states.select("candidate").distinct().join(best, "candidate", "left").select("candidate", F.coalesce("_best", F.lit(0.0)).alias("utility"))


def dominant_share(job_resources: DataFrame, node_resources: DataFrame) -> DataFrame:
    """(job, share): largest share of any resource that one replica takes of all nodes."""
    total = node_resources.groupBy("resource").agg(F.sum("amount").alias("_total"))
    return job_resources.join(total, "resource").groupBy("job").agg(F.max(F.col("amount") / F.col("_total")).alias("share"))


def changed_jobs(states: DataFrame, base: DataFrame) -> DataFrame:
    """(candidate, job, changed): whether a job's node counts differ from the base allocation."""
    used, kept = states.filter("replicas > 0"), base.filter("replicas > 0")
    match = kept.select("job", "node", F.col("replicas").alias("_b"))
    mine = used.join(match, ["job", "node"], "left").groupBy("candidate", "job").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("replicas").eqNullSafe(F.col("_b"))).alias("_same")
    )
    size = kept.groupBy("job").agg(F.count(F.lit(1)).alias("_base"))
    both = mine.join(size, "job", "left")
    same = (F.col("_n") == F.col("_same")) & (F.col("_same") == F.coalesce("_base", F.lit(0)))
    return both.select("candidate", "job", (~same).alias("changed"))


def candidate_objective(
    states: DataFrame, base: DataFrame, job_resources: DataFrame, node_resources: DataFrame, speedups: DataFrame, node_index: DataFrame
) -> DataFrame:
    """(candidate, value, size): minus the summed scaled speedups, jobs that would restart at 0.9, and highest used node + 1; both 0 if nothing is placed."""
    nodes = node_index.agg(F.count(F.lit(1)).alias("n")).scalar()
    jobs = speedups.join(dominant_share(job_resources, node_resources), "job").join(changed_jobs(states, base), ["candidate", "job"])
    gain = F.col("speedup") * F.col("share") * nodes * F.when(F.col("changed"), RESTART_FACTOR).otherwise(1.0)
    value = jobs.groupBy("candidate").agg((-F.sum(gain)).alias("value"))
    size = states.filter("replicas > 0").join(node_index, "node").groupBy("candidate").agg((F.max("node_index") + 1).alias("size"))
    every = states.select("candidate").distinct().join(value, "candidate", "left").join(size, "candidate", "left")
    return every.select("candidate", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("size", F.lit(0)).alias("size"))


def pareto_front(df: DataFrame, by: Sequence[str], block: Column | None = None) -> DataFrame:
    """Rows not beaten on both ``value`` and ``size`` within their group; equal rows all stay."""
    by = list(by)
    best = df.groupBy(*by, "size").agg(F.min("value").alias("value"))
    rows = running(best, by, ["size"], step_block("size") if block is None else block, mins={"_lower": F.col("value")}, exclusive=True)
    front = rows.filter(F.col("_lower").isNull() | (F.col("value") < F.col("_lower"))).drop("_lower")
    return df.join(front, [*by, "size", "value"])


def pick_under(df: DataFrame, by: Sequence[str], limit: Column) -> DataFrame:
    """Lowest value with size within the limit, first candidate on ties; no row if none fits."""
    best = df.filter(F.col("size") <= limit).groupBy(*by).agg(F.min(F.struct("value", "candidate")).alias("_b"))
    return best.select(*by, F.col("_b.candidate").alias("candidate"), F.col("_b.value").alias("value"))


def desired_size(front: DataFrame, by: Sequence[str], current: str) -> DataFrame:
    """Keep the current size while its pick's utility is in range, else the size of the candidate nearest to 0.5.

    Only utilities of at least 0.35 count. Of candidates at the same distance the first one decides, whichever side of 0.5
    it is on; later candidates of (nearly) its utility win by a larger size. Without a candidate the size stays.
    """
    lo, hi = (F.lit(x) for x in KEEP_UTILITY)
    fits = F.when(F.col("size") <= F.col(current), F.struct("value", "candidate", "utility"))
    near = F.when(F.col("utility") >= lo, F.struct(F.abs(F.col("utility") - TARGET_UTILITY).alias("d"), "candidate", "utility"))
    per = front.groupBy(*by, current).agg(F.min(fits).alias("_f"), F.min(near).alias("_n"))
    later = front.select(*by, "candidate", "size", "utility").join(per.select(*by, "_n"), list(by))
    close = F.abs(F.col("utility") - F.col("_n.utility")) <= CLOSE[0] + CLOSE[1] * F.abs(F.col("_n.utility"))
    largest = later.filter((F.col("candidate") >= F.col("_n.candidate")) & close).groupBy(*by).agg(F.max("size").alias("_s"))
    keep = F.coalesce(F.col("_f.utility").between(lo, hi), F.lit(False))
    out = per.join(largest, list(by), "left")
    return out.select(*by, F.when(keep, F.col(current)).otherwise(F.coalesce("_s", current)).alias("size"))
