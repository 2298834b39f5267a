"""Online profiles, exactly-once totals, latest hints and phase timelines as Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainframe.operators.blocked import running
from trainframe.operators.profiles import CONFIG, step_profile
from trainframe.sources.sinks import Snapshots


def _start(stream: DataFrame, checkpoint: str, mode: str, sink, every: str | None):
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def _by_batch(path: str):
    """Sink that gives every micro-batch its own folder, so a repeated batch replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def run_profile(steps: DataFrame, path: str, checkpoint: str, every: str | None = "30 seconds"):
    """Keep step profiles up to date: each batch writes the configurations that changed."""
    return _start(step_profile(steps), checkpoint, "update", _by_batch(path), every)


def current_profile(spark, path: str) -> DataFrame:
    """Newest row of each configuration."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy(*CONFIG).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*CONFIG, "batch")]), "batch").alias("r"))
    return newest.select(*CONFIG, "r.*")


def run_totals(updates: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Sum (run, key, delta) updates once per (non-null) update_id, however late they come.

    ``path/ids`` keeps the update ids that counted, by batch and day of ``ts``. A repeated update has the ts of its first
    delivery, so a batch meets the ids of its own days only. Nothing is dropped for being late; days that can no longer
    be repeated may be deleted there. ``path/sums`` gets one file set of partial sums per batch.
    """
    spark = updates.sparkSession
    day = F.coalesce(F.to_date("ts"), F.lit("1970-01-01").cast("date"))

    def write(batch: DataFrame, batch_id: int) -> None:
        once = batch.withColumn("day", day).dropDuplicates(["update_id"])
        if batch_id > 0:
            seen = spark.read.schema(once.select("update_id", "day").withColumn("batch", F.lit(0).cast("bigint")).schema).parquet(f"{path}/ids")
            seen = seen.filter(F.col("batch") < batch_id).join(once.select("day").distinct(), "day", "left_semi")
            once = once.join(seen.select("update_id", "day"), ["update_id", "day"], "left_anti")
        once.select("update_id", "run", "key", "delta", "day").write.mode("overwrite").partitionBy("day").parquet(f"{path}/ids/batch={batch_id}")
        counted = spark.read.schema(once.select("update_id", "run", "key", "delta", "day").schema).parquet(f"{path}/ids/batch={batch_id}")
        sums = counted.groupBy("run", "key").agg(F.sum("delta").alias("delta"))
        sums.write.mode("overwrite").parquet(f"{path}/sums/batch={batch_id}")

    return _start(updates, checkpoint, "append", write, every)


def current_totals(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/sums").groupBy("run", "key").agg(F.sum("delta").alias("total"))


def run_latest_hints(feed: DataFrame, store: Snapshots, checkpoint: str, name: str = "hints", every: str | None = None):
    """Keep the newest hints of each job by (ts, seq). Batch n writes snapshot n from the one before it."""

    def upsert(batch: DataFrame, batch_id: int) -> None:
        before = store.latest(name, below=batch_id)
        rows = batch if before is None else batch.unionByName(before)
        newest = rows.groupBy("job").agg(F.max_by(F.struct("ts", "seq", "hints"), F.struct("ts", "seq")).alias("r"))
        store.save(name, newest.select("job", "r.*"), batch_id)

    return _start(feed, checkpoint, "append", upsert, every)


def new_jobs(events: DataFrame) -> DataFrame:
    """Added, preemptible jobs only; preemptible unless said otherwise."""
    return events.filter((F.col("type") == "ADDED") & F.coalesce("preemptible", F.lit(True)))


PHASES = "job bigint, phase string, from_ts bigint, seq bigint, to_ts bigint"


def run_phases(events: DataFrame, path: str, store: Snapshots, checkpoint: str, name: str = "open_phase", every: str | None = None):
    """Closed phases (job, phase, from_ts, seq, to_ts) from (job, micros, seq, phase) events.

    The open phase of each job is a snapshot. A micro-batch is put in order with it through blocked
    windows on the hour, so a job with many events in a batch is no problem. An event before its job's open phase is
    late: the phases of such jobs are read again and written anew, cut by it, and the newest writing counts.
    Events with equal (job, micros, seq) are one. Batch n writes its own folder and snapshot n, which makes a repeated
    batch harmless.
    """
    cols = ["job", "micros", "seq", "phase"]
    spark = events.sparkSession

    def advance(batch: DataFrame, batch_id: int) -> None:
        before = store.latest(name, below=batch_id)
        rows = batch.select(*cols)
        if before is not None:
            opened = before.select("job", F.struct("micros", "seq").alias("_open"))
            late = rows.join(opened, "job").filter(F.struct("micros", "seq") < F.col("_open")).select("job").distinct()
            if not late.isEmpty():
                written = spark.read.schema(f"{PHASES}, batch bigint").parquet(path).filter(F.col("batch") < batch_id)
                past = written.join(late, "job", "left_semi").select("job", F.col("from_ts").alias("micros"), "seq", "phase")
                rows = rows.unionByName(past)
            rows = rows.unionByName(before.select(*cols))
        rows = rows.dropDuplicates(["job", "micros", "seq"])
        hour = F.floor(F.col("micros") / 3600000000)
        closed = running(rows, ["job"], ["micros", "seq"], hour, leads={"to_ts": F.col("micros")}).filter("to_ts is not null")
        closed.select("job", "phase", F.col("micros").alias("from_ts"), "seq", "to_ts").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        last = rows.groupBy("job").agg(F.max_by(F.struct(*cols[1:]), F.struct("micros", "seq")).alias("r"))
        store.save(name, last.select("job", "r.*"), batch_id)

    return _start(events, checkpoint, "append", advance, every)


def current_phases(spark, path: str) -> DataFrame:
    """Closed phases as last written."""
    rows = spark.read.schema(f"{PHASES}, batch bigint").parquet(path)
    newest = rows.groupBy("job", "from_ts", "seq").agg(F.max_by(F.struct("phase", "to_ts"), "batch").alias("r"))
    return newest.select("job", "r.phase", "from_ts", "seq", "r.to_ts")


def run_append(stream: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """Append rows to parquet; the checkpoint makes a restarted query go on where it stopped."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
