"""Resource sums of pods and nodes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainframe.functions.records import quantity

# Resources counted by request, all others by limit; phases that hold no resources.
BY_REQUEST = ("cpu", "memory", "ephemeral-storage")
FINISHED = ("Succeeded", "Failed")


def positive(df: DataFrame, amount: str = "amount") -> DataFrame:
    return df.filter(F.col(amount) > 0)


def default_resources(containers: Column, requests: Mapping[str, str] | None, limits: Mapping[str, str] | None) -> Column:
    """Fill in missing requests and limits of the first container; what it names already stays."""

    def merged(have: Column, defaults: Mapping[str, str] | None) -> Column:
        if defaults is None:
            return have
        extra = F.create_map(*[F.lit(x) for kv in defaults.items() for x in kv])
        have = F.coalesce(have, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
        return F.map_concat(F.map_filter(extra, lambda k, v: ~F.map_contains_key(have, k)), have)

    def filled(c: Column) -> Column:
        return F.struct(c["name"].alias("name"), merged(c["requests"], requests).alias("requests"), merged(c["limits"], limits).alias("limits"))

    def as_is(c: Column) -> Column:
        return F.struct(c["name"].alias("name"), c["requests"].alias("requests"), c["limits"].alias("limits"))

    return F.transform(containers, lambda c, i: F.when(i == 0, filled(c)).otherwise(as_is(c)))


def request_rows(pods: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, resource, amount) rows, not yet summed: requested or limited amounts and one 'pods' per pod."""
    chosen = F.flatten(
        F.transform(
            "containers",
            lambda c: F.concat(
                F.coalesce(F.filter(F.map_entries(c["requests"]), lambda e: e["key"].isin(*BY_REQUEST)), F.array()),
                F.coalesce(F.filter(F.map_entries(c["limits"]), lambda e: ~e["key"].isin(*BY_REQUEST)), F.array()),
            ),
        )
    )
    entries = F.concat(chosen, F.array(F.struct(F.lit("pods").alias("key"), F.lit("1").alias("value"))))
    each = pods.select(*key, F.explode(entries).alias("_e"))
    return each.select(*key, F.col("_e.key").alias("resource"), quantity(F.col("_e.key"), F.col("_e.value")).alias("amount"))


def pod_requests(pods: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, resource, amount) summed over containers, positive amounts only."""
    return positive(request_rows(pods, key).groupBy(*key, "resource").agg(F.sum("amount").alias("amount")))


def node_capacity(nodes: DataFrame) -> DataFrame:
    """(node, resource, amount) from a map of quantity strings."""
    each = nodes.select("node", F.explode("allocatable").alias("resource", "_v"))
    return each.select("node", "resource", quantity(F.col("resource"), F.col("_v")).alias("amount"))


def node_free(nodes: DataFrame, pods: DataFrame) -> DataFrame:
    """(node, resource, amount) left after requests of unfinished pods; only resources the node has, positive only. A pod without a phase is unfinished."""
    live = pods.filter(~F.coalesce("phase", F.lit("")).isin(*FINISHED))
    used = request_rows(live, ["node"]).groupBy("node", "resource").agg(F.sum("amount").alias("_used"))
    free = node_capacity(nodes).join(used, ["node", "resource"], "left")
    return positive(free.select("node", "resource", (F.col("amount") - F.coalesce("_used", F.lit(0))).alias("amount")))


def node_template(free: DataFrame) -> DataFrame:
    """Largest amount of each resource over nodes."""
    return free.groupBy("resource").agg(F.max("amount").alias("amount"))


def resource_types(jobs: DataFrame) -> DataFrame:
    """Resource names any job asks for."""
    return jobs.select(F.explode(F.map_keys("resources")).alias("resource")).distinct()


def allowed_nodes(nodes: DataFrame, taint_key: str, taint_value: str) -> DataFrame:
    """Nodes without taints (none or null), or whose only taint is the given one."""
    count = F.coalesce(F.size("taints"), F.lit(0))
    one = (F.col("taints")[0]["key"] == taint_key) & (F.col("taints")[0]["value"] == taint_value)
    return nodes.filter((count <= 0) | F.when(count == 1, one).otherwise(False))


def bundle_usage(groups: DataFrame) -> DataFrame:
    """(node, resource, amount) over all bundles but the first of each group; a 'node:address' key names the node."""
    bundle = F.explode(F.slice("bundles", 2, F.greatest(F.size("bundles") - 1, F.lit(0)))).alias("b")
    each = groups.select(bundle)
    name = F.element_at(F.filter(F.map_keys("b"), lambda k: F.startswith(k, F.lit("node"))), 1)
    each = each.select(F.element_at(F.split(name, ":"), 2).alias("node"), F.explode("b").alias("resource", "_n"))
    return each.groupBy("node", "resource").agg(F.sum("_n").alias("amount"))
