"""Vocabulary building and token lookup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainframe.operators.position import sorted_position

# Special tokens in id order.
SPECIALS = ("<unk>", "<pad>", "<MASK>", "<cls>", "<sep>")

# Entries of the most frequent tokens that are broadcast; rarer tokens go through a shuffle join.
HEAD_SIZE = 65536


def each_token(df: DataFrame, tokens: str = "tokens", *keep: str) -> DataFrame:
    """One row per token with the ``keep`` columns and ``i``. Outer explode keeps Spark from tokenising twice for a filter."""
    return df.select(*keep, F.posexplode_outer(tokens).alias("i", "token")).filter(F.col("token").isNotNull())


def build_vocabulary(tokens: DataFrame, token: str = "token", specials: Sequence[str] = SPECIALS, freq: str | None = None) -> DataFrame:
    """(token, token_id, freq): specials first, then by falling frequency, ties by token.

    ``freq`` names a column of counts where tokens are counted in part already, as ``dictionary.word_counts`` gives them.
    Counting combines map-side, so a token that makes up a third of the text costs one row per task.
    """
    counts = (
        tokens.filter(~F.col(token).isin(*specials))
        .groupBy(F.col(token).alias("token"))
        .agg((F.sum(freq) if freq else F.count(F.lit(1))).alias("freq"))
    )
    ranked = sorted_position(counts, [F.col("freq").desc(), "token"], out="_pos")
    first = ranked.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(s) for s in specials])).alias("token_id", "token")
    )
    return first.select("token", F.col("token_id").cast("bigint").alias("token_id"), F.lit(0).cast("bigint").alias("freq")).unionByName(
        ranked.select("token", (F.col("_pos") + len(specials)).alias("token_id"), "freq")
    )


def lookup_ids(tokens: DataFrame, vocab: DataFrame, unk_id: int = 0, head: int = HEAD_SIZE) -> DataFrame:
    """Replace ``token`` by ``token_id`` in a table with a row per token; unknown tokens get ``unk_id``.

    The first ``head`` ids, which cover the frequent tokens and hence all skew, are broadcast; other tokens are shuffled
    to meet the rest. Texts with their tokens in arrays go through ``dictionary`` instead.
    """
    words = vocab.select("token", "token_id")
    top = F.broadcast(words.filter(F.col("token_id") < head))  # at most `head` rows
    rest = words.filter(F.col("token_id") >= head)
    common = tokens.join(top, "token")
    rare = tokens.join(top, "token", "left_anti").join(rest, "token", "left")
    unk = F.lit(unk_id).cast("bigint")
    return common.unionByName(rare.withColumn("token_id", F.coalesce("token_id", unk))).drop("token")


def long_enough(df: DataFrame, tokens: Column, minimum: int) -> DataFrame:
    """Keep rows with at least ``minimum`` tokens."""
    return df.filter(F.size(tokens) >= minimum)
