"""Connected components of a table of links by repeated contraction.

Each round every node points to its smallest neighbour or itself, pointers are followed twice, and links are renamed
to what their ends point at. A component of n nodes takes about log n rounds. Every round is written to the shared
folder; the driver only asks whether links are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainframe.llm.store import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id and root (smallest id reachable) of every node that has a link."""
    left = stored(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "links")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        both = left.select(F.col("b").alias("id"), F.col("a").alias("p")).unionByName(left.select(F.col("a").alias("id"), F.col("b").alias("p")))
        parent = stored(both.groupBy("id").agg(F.least("id", F.min("p")).alias("p")), "parents")
        for _ in range(2):
            up = parent.select(F.col("id").alias("p"), F.col("p").alias("q"))
            parent = parent.join(up, "p").select("id", F.col("q").alias("p"))
        parent = stored(parent, "parents")
        rounds.append(parent)
        ends = left
        for side in ("a", "b"):
            ends = ends.join(parent.select(F.col("id").alias(side), F.col("p").alias(f"_{side}")), side)
        left = stored(ends.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).where("a < b").distinct(), "links")
    if not rounds:
        return links.sparkSession.createDataFrame([], "id long, root long")
    out = rounds[0].withColumnRenamed("p", "root")
    for parent in rounds[1:]:
        up = parent.select(F.col("id").alias("root"), F.col("p").alias("_up"))
        out = out.join(up, "root", "left").select("id", F.coalesce("_up", "root").alias("root"))
    return out
