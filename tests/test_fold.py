"""Folds in rank order over partitions: against a loop, and how many values a task gets on each level."""

import random
from functools import reduce

import pytest
from pyspark.sql import functions as F

from trainframe.operators import perfmodel as M


@pytest.mark.parametrize(("parts", "block"), [(1, 2), (7, 2), (9, 3), (16, 1024)])
def test_fold_equals_a_loop(spark, parts, block):
    """Joining strings is associative and does not commute; one group has half of the rows, one a single row, one no name."""
    rng = random.Random(parts)
    rows = [("hot", i, chr(97 + rng.randrange(26))) for i in rng.sample(range(-500, 5000), 600)]
    rows += [(g, i, rng.choice("xyz")) for g in ("a", "b", None) for i in rng.sample(range(1000), 90)] + [("one", 0, "!")]
    want = {g: reduce(lambda a, b: a + b, [v for _, v in sorted((i, v) for k, i, v in rows if k == g)]) for g in {r[0] for r in rows}}
    df = spark.createDataFrame(rows, "g string, i int, v string").repartition(5)
    got = M.reduce_custom(df, ["g"], "i", "v", lambda a, b: a + b, block=block, parts=parts)
    assert {r["g"]: r["v"] for r in got.collect()} == want


def test_fold_of_everything_and_of_nothing(spark):
    df = spark.range(1000).select("id", F.array("id").alias("v"))
    got = M.reduce_custom(df, [], "id", "v", lambda a, b: [*a, *b], block=2, parts=8).collect()
    assert [r["v"] for r in got] == [list(range(1000))]
    assert M.reduce_custom(df.limit(0), [], "id", "v", lambda a, b: [*a, *b]).count() == 0


def test_no_task_folds_a_whole_group(spark):
    """One group of all rows: each fold carries the number of values that went into it one by one."""
    df = spark.range(8000).select(F.lit(1).alias("g"), "id", F.struct(F.lit(1).alias("n"), F.lit(1).alias("steps"), F.lit(1).alias("most")).alias("v"))

    def fn(a, b):
        steps = a["steps"] + 1 if b["steps"] == 1 or a["n"] > 1 else 2
        return {"n": a["n"] + b["n"], "steps": steps, "most": max(a["most"], b["most"], steps)}

    def fresh(a, b):  # a value from another level starts its count anew
        return fn({**a, "steps": 1} if a["n"] > 1 and b["n"] > 1 else a, {**b, "steps": 1})

    got = M.reduce_custom(df, ["g"], "id", "v", fresh, block=4, parts=16).first()["v"]
    assert got["n"] == 8000 and got["most"] < 8000 / 8
