"""Scalar series and versioned snapshots."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trainframe.functions.records import tag

# Tags of loader and training scalars with the column each comes from.
LOADER_TAGS = {"Total_Batch_Size": "total_batch", "Local_Batch_Size": "local_bsz", "Accumulation_Steps": "accum_steps"}
TRAINING_TAGS = {
    "Gradient_Norm_Sqr": "sqr", "Gradient_Variance": "var", "Gain": "gain", "Learning_Rate_Factor": "lr_factor",
    "Accum_Scale": "accum_scale", "Accum_Count": "accum_count", "Progress": "progress",
}


def scalar_rows(df: DataFrame, tags: Mapping[str, str], prefix: Column | str = "") -> DataFrame:
    """(run, tag, step, value) from one wide row per step. Accum_Count is kept only above 0."""
    prefix = F.lit(prefix) if isinstance(prefix, str) else prefix
    cells = [F.struct(tag(prefix, F.lit(t)).alias("tag"), F.col(c).cast("double").alias("value"), F.lit(t).alias("t")) for t, c in tags.items()]
    long = df.select("run", "step", F.inline(F.array(*cells)))
    return long.filter((F.col("t") != "Accum_Count") | (F.col("value") > 0)).select("run", "tag", "step", "value")


def write_scalars(rows: DataFrame, path: str) -> None:
    """Append scalar rows as parquet, one folder per tag."""
    rows.write.mode("append").partitionBy("tag").parquet(path)


class Snapshots:
    """Named tables kept in versions under one folder. A version exists once its commit row is written.

    With ``keep``, older versions than the newest ``keep`` are removed after each save.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int | None = None):
        self.spark, self.root, self.names, self.keep = spark, root, set(), keep

    def _remove(self, folder: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def register(self, name: str) -> None:
        if name in self.names:
            raise ValueError(f"state exists: {name}")
        self.names.add(name)

    def save(self, name: str, df: DataFrame, version: int) -> None:
        """Write one version, data first and commit row after; writing it again takes the commit row away before."""
        self._remove(f"{self.root}/{name}.commits/snapshot={version}")
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/snapshot={version}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.root}/{name}.commits/snapshot={version}")
        if self.keep:
            for old in self.versions(name)[: -self.keep]:
                self._remove(f"{self.root}/{name}.commits/snapshot={old}")
                self._remove(f"{self.root}/{name}/snapshot={old}")

    def versions(self, name: str) -> list[int]:
        """Committed versions, oldest first."""
        try:
            commits = self.spark.read.parquet(f"{self.root}/{name}.commits")
        except AnalysisException:
            return []
        return sorted(r[0] for r in commits.select("snapshot").distinct().collect())  # one row per version

    def latest(self, name: str, below: int | None = None) -> DataFrame | None:
        """Newest version, or the newest before ``below``; None when there is none."""
        found = [v for v in self.versions(name) if below is None or v < below]
        return self.spark.read.parquet(f"{self.root}/{name}/snapshot={found[-1]}") if found else None

    def kept(self, name: str, keep: int = 1) -> list[int]:
        """Versions a retention of ``keep`` would leave."""
        return self.versions(name)[-keep:]
