"""Exact match and token F1 of predictions against several candidate answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainframe.functions.text import normalize_answer


def with_references(predictions: DataFrame, references: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per (question, candidate answer). Both sides are joined on the question key only."""
    return predictions.join(references, list(key))


def exact_match_each(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, em): 1 if the prediction equals any candidate after normalisation."""
    same = normalize_answer(F.col("prediction")) == normalize_answer(F.col("answer"))
    return pairs.groupBy(*key).agg(F.max(F.when(same, 1).otherwise(0)).alias("em"))


def exact_match(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    return exact_match_each(pairs, key).agg(F.count(F.lit(1)).alias("questions"), (100 * F.avg("em")).alias("exact_match"))


def token_f1_each(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, f1): best F1 over candidates of the multiset overlap of raw tokens.

    Tokens of both sides are counted in one grouping on (key, candidate, token), so long texts and
    frequent tokens are combined map-side. An empty side scores 1 only if both are empty; a null side is empty.
    """
    no_tokens = F.array().cast("array<string>")
    sides = F.concat(
        F.transform(F.coalesce("prediction_tokens", no_tokens), lambda t: F.struct(t.alias("t"), F.lit(1).alias("p"), F.lit(0).alias("a"))),
        F.transform(F.coalesce("answer_tokens", no_tokens), lambda t: F.struct(t.alias("t"), F.lit(0).alias("p"), F.lit(1).alias("a"))),
    )
    each = pairs.select(*key, "ref_no", F.explode_outer(sides).alias("_s"))
    counts = each.groupBy(*key, "ref_no", F.col("_s.t").alias("_t")).agg(F.sum("_s.p").alias("p"), F.sum("_s.a").alias("a"))
    sizes = counts.groupBy(*key, "ref_no").agg(
        F.coalesce(F.sum("p"), F.lit(0)).alias("p"),
        F.coalesce(F.sum("a"), F.lit(0)).alias("a"),
        F.coalesce(F.sum(F.least("p", "a")), F.lit(0)).alias("same"),
    )
    f1 = (
        F.when((F.col("p") == 0) & (F.col("a") == 0), F.lit(1.0))
        .when(F.col("same") == 0, F.lit(0.0))
        .otherwise(2 * F.col("same") / (F.col("p") + F.col("a")))
    )
    return sizes.groupBy(*key).agg(F.max(f1).alias("f1"))


def token_f1(pairs: DataFrame, key: Sequence[str]) -> DataFrame:
    return token_f1_each(pairs, key).agg(F.count(F.lit(1)).alias("questions"), (100 * F.avg("f1")).alias("f1"))
