"""Top-k lists and ranking metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def blend(a: Column, b: Column) -> Column:
    """Score of two models with halved output weights."""
    return 0.5 * a + 0.5 * b


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each user by falling score, then position: adds ``rank`` from 0.

    Spark limits each task's rows per user before the shuffle, so a very active user sends k rows per task.
    """
    w = Window.partitionBy("user").orderBy(F.col("score").desc(), "position")
    return scored.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).withColumn(
        "rank", F.col("_rank") - 1
    ).drop("_rank")


def user_metrics(scored: DataFrame, k: int) -> DataFrame:
    """(user, hit, ndcg): whether and where the item at position 0 is among the top k."""
    found = top_k(scored, k).groupBy("user").agg(F.min(F.when(F.col("position") == 0, F.col("rank"))).alias("_r"))
    return found.select(
        "user",
        F.when(F.col("_r").isNull(), 0).otherwise(1).alias("hit"),
        F.coalesce(1 / F.log2(F.col("_r") + 2), F.lit(0.0)).alias("ndcg"),
    )


def ranking_metrics(scored: DataFrame, k: int) -> DataFrame:
    """One row: users, hit rate and mean NDCG at k."""
    return user_metrics(scored, k).agg(
        F.count(F.lit(1)).alias("users"), F.avg("hit").alias("hit_rate"), F.avg("ndcg").alias("ndcg")
    )
