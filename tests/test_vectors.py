"""Sums of vectors by chunks against plain Python, and what is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from trainframe.operators import vectors as X


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(6)
    out = []
    for i in range(300):
        size = rng.choice([0, 1, 3, 7])
        v = None if i % 17 == 0 else [None if rng.random() < 0.1 else rng.randint(-9, 9) for _ in range(size)]
        out.append((None if i % 3 == 0 else "b", rng.choice([1, 2, None]), v))
    return out + [("all", 1, [None, None]), ("none", 1, None), ("none", 2, [])]


def plain(rows):
    sums, counts = {}, {}
    for a, b, v in rows:
        for d, x in enumerate(v or []):
            sums.setdefault((a, b), {}).setdefault(d, 0)
            counts.setdefault((a, b), {}).setdefault(d, 0)
            if x is not None:
                sums[a, b][d] += x
                counts[a, b][d] += 1
    return sums, counts


@pytest.mark.parametrize("kind", ["int", "double"])
@pytest.mark.parametrize("chunk", [2, 1024])
def test_sums_and_mean_squares(spark, rows, kind, chunk):
    df = spark.createDataFrame(rows, "a string, b int, v array<int>").withColumn("v", F.col("v").cast(f"array<{kind}>")).repartition(5)
    sums, counts = plain(rows)
    got = {(r["a"], r["b"]): r["v"] for r in X.vector_sums(df, ["a", "b"], "v", chunk).collect()}
    assert got == {k: [s[d] if counts[k][d] else None for d in sorted(s)] for k, s in sums.items()}
    got = {(r["a"], r["b"]): r["m"] for r in X.mean_square(df, ["a", "b"], "v", "m", chunk).collect()}
    want = {k: sum((s[d] / counts[k][d]) ** 2 for d in s if counts[k][d]) for k, s in sums.items()}
    assert got == pytest.approx(want)


def test_empty_table(spark):
    assert X.vector_sums(spark.createDataFrame([], "a string, v array<double>"), ["a"], "v").count() == 0


def test_values_that_are_not_finite(spark):
    df = spark.createDataFrame([("n", [1.0, float("nan")]), ("i", [float("inf"), 1.0]), ("i", [float("-inf"), 1.0]), ("f", [3.0, 4.0])], "a string, v array<double>")
    got = {r["a"]: r["m"] for r in X.mean_square(df, ["a"], "v", "m").collect()}
    assert got["f"] == 25.0 and got["n"] != got["n"] and got["i"] != got["i"]


def test_rows_shuffled_grow_with_chunks_not_cells(spark):
    """One group of all rows: every task sends one row for each chunk of 1,024 dimensions."""
    df = spark.range(400).repartition(4).select(F.lit("hot").alias("a"), F.transform(F.sequence(F.lit(0), F.lit(2499)), lambda d: (d + F.col("id")).cast("long")).alias("v"))
    whole = X.chunk_sums(df, ["a"], "v")
    assert whole.count() == 3
    plan = whole._jdf.queryExecution()
    whole_rows = X.vector_sums(df, ["a"], "v").first()["v"]
    assert whole_rows == [400 * d + 400 * 399 // 2 for d in range(2500)]
    text = plan.executedPlan().toString()
    assert text.count("MapInArrow") == 2 and "posexplode" not in text
    held = X.chunk_sums(df, ["a"], "v", held=1)  # sums sent on after every batch
    assert sorted(r["chunk"] for r in held.collect()) == [0, 1, 2]
