"""Readers for ratings, ranking candidates, text corpora, job, pod and node records, and hint feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trainframe.functions.records import HINTS

JOB = """metadata struct<name: string, namespace: string, creationTimestamp: string>,
    spec struct<minReplicas: bigint, maxReplicas: bigint, preemptible: boolean, template: string>,
    status struct<phase: string, allocation: array<string>, train: string>"""

POD = """metadata struct<name: string, namespace: string, labels: map<string,string>, annotations: map<string,string>, deletionTimestamp: string>,
    spec struct<nodeName: string, containers: array<struct<name: string, resources: struct<requests: map<string,string>, limits: map<string,string>>>>>,
    status struct<phase: string, reason: string, conditions: array<struct<type: string, status: string>>,
                  containerStatuses: array<struct<ready: boolean, state: struct<terminated: struct<exitCode: int>>>>>"""

NODE = """metadata struct<name: string>, spec struct<taints: array<struct<key: string, value: string, effect: string>>>,
    status struct<allocatable: map<string,string>>"""

JOB_EVENT = "job string, ts timestamp, seq bigint, type string, phase string, allocation array<string>, preemptible boolean"


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """(user, item) from tab-separated files without a header; further columns are not read."""
    return spark.read.csv(path, sep="\t", schema="user int, item int", enforceSchema=True)


def ranking_candidates(spark: SparkSession, path: str) -> DataFrame:
    """(user, position, item) from lines '(user,item)<tab>negative<tab>...'; the true item is at position 0."""
    pair = "^\\((\\d+),\\s*(\\d+)\\)"
    parts = F.split("value", "\t")
    lines = spark.read.text(path).filter("value <> ''")
    items = F.concat(F.array(F.regexp_extract("value", pair, 2)), F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))
    return lines.select(F.regexp_extract("value", pair, 1).cast("int").alias("user"), F.posexplode(items).alias("position", "item")).select(
        "user", "position", F.col("item").cast("int").alias("item")
    )


def corpus_lines(spark: SparkSession, glob: str) -> DataFrame:
    """(path, text) of trimmed lines; bytes that are not UTF-8 are dropped."""
    lines = spark.read.text(glob).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    cleaned = F.replace(F.make_valid_utf8("text"), F.lit("\ufffd"), F.lit(""))
    lines = lines.withColumn("text", F.when(F.is_valid_utf8("text"), F.col("text")).otherwise(cleaned))
    return lines.withColumn("text", F.regexp_replace("text", "(?U)^\\s+|\\s+$", ""))


def jobs(spark: SparkSession, path: str) -> DataFrame:
    """Flat job records from JSON lines with a fixed schema; the hints in status stay JSON for ``parse_hints``."""
    raw = spark.read.schema(JOB).json(path)
    return raw.select(
        F.concat_ws("/", "metadata.namespace", "metadata.name").alias("job"), F.to_timestamp("metadata.creationTimestamp").alias("created"),
        F.col("spec.minReplicas").alias("min_replicas"), F.col("spec.maxReplicas").alias("max_replicas"), F.col("spec.preemptible").alias("preemptible"),
        F.col("spec.template").alias("template"), F.col("status.phase").alias("phase"), F.col("status.allocation").alias("allocation"), F.col("status.train").alias("hints"),
    )


def pods(spark: SparkSession, path: str, job_label: str = "job") -> DataFrame:
    """Flat pod records from JSON lines; the pod's job is named by a label. Of a condition told twice the last counts."""
    raw = spark.read.schema(POD).json(path)
    told = F.filter("status.conditions", lambda c: c["type"].isNotNull())
    kinds = F.array_distinct(F.transform(told, lambda c: c["type"]))
    last = F.transform(kinds, lambda k: F.element_at(F.filter(told, lambda c: c["type"] == k), -1)["status"])
    return raw.select(
        F.concat_ws("/", "metadata.namespace", F.col("metadata.labels")[job_label]).alias("job"), F.col("metadata.name").alias("pod"), F.col("spec.nodeName").alias("node"),
        F.col("status.phase").alias("phase"), F.col("status.reason").alias("reason"), F.to_timestamp("metadata.deletionTimestamp").alias("deleted"),
        F.filter(F.transform("status.containerStatuses", lambda c: c["state"]["terminated"]["exitCode"]), lambda e: e.isNotNull()).alias("exit_codes"),
        F.transform("status.containerStatuses", lambda c: c["ready"]).alias("ready"), F.map_from_arrays(kinds, last).alias("conditions"),
        F.col("metadata.annotations").alias("annotations"),
        F.transform("spec.containers", lambda c: F.struct(c["name"].alias("name"), c["resources"]["requests"].alias("requests"), c["resources"]["limits"].alias("limits"))).alias("containers"),
    )


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """Flat node records from JSON lines: node, allocatable quantities, taints (null if none are told)."""
    raw = spark.read.schema(NODE).json(path)
    return raw.select(F.col("metadata.name").alias("node"), F.col("status.allocatable").alias("allocatable"), F.col("spec.taints").alias("taints"))


def hint_feed(spark: SparkSession, path: str) -> DataFrame:
    """Stream of (job, ts, seq, hints) from a folder of JSON files; unknown hint fields are dropped."""
    hints = ", ".join(["job string", "ts timestamp", "seq bigint", HINTS])
    raw = spark.readStream.schema(hints).json(path)
    return raw.select("job", "ts", "seq", F.struct(*[c for c in raw.columns if c not in ("job", "ts", "seq")]).alias("hints"))


def job_feed(spark: SparkSession, path: str) -> DataFrame:
    """Stream of job change events from a folder of JSON files."""
    return spark.readStream.schema(JOB_EVENT).json(path)
