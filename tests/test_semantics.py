"""Rules that are easy to get nearly right: null sides, ties, scales that change, syncs inside loops."""

import pytest
from pyspark.sql import functions as F

from trainframe.operators import accumulate as A
from trainframe.operators import answers as N
from trainframe.operators import noise as Z
from trainframe.operators import placement as L


def test_missing_sides_score_like_empty_ones(spark):
    rows = [(1, 0, None, ["a", "b"]), (2, 0, ["a"], None), (3, 0, None, None), (4, 0, None, ["a"]), (4, 1, None, []), (5, 0, ["a"], ["a"])]
    df = spark.createDataFrame(rows, "q int, ref_no int, prediction_tokens array<string>, answer_tokens array<string>")
    assert {r["q"]: r["f1"] for r in N.token_f1_each(df, ["q"]).collect()} == {1: 0.0, 2: 0.0, 3: 1.0, 4: 1.0, 5: 1.0}


def desired(rows, current):
    """The rule as a loop over candidates in order."""
    best, size = float("inf"), current
    for util, n in rows:
        if util < 0.35:
            continue
        if abs(util - best) <= 1e-8 + 1e-5 * abs(best) and n > size:
            size = n
        if abs(util - 0.5) < abs(best - 0.5):
            best, size = util, n
    return size


@pytest.mark.parametrize(
    "rows",
    [
        [(0.7, 4), (0.3, 9), (0.72, 11)],
        [(0.25 + 0.5, 4), (0.375, 6), (0.625, 9), (0.375, 5), (0.375, 8)],  # equal distances on both sides
        [(0.7, 4), (0.7, 9), (0.7, 2), (0.7000001, 12), (0.71, 20)],
        [(0.1, 4)],
        [(0.9, 8), (0.8, 7), (0.8, 7), (0.8, 3)],
    ],
)
def test_ties_of_the_desired_size(spark, rows):
    data = [("c", i, float(-i), n, u, 1) for i, (u, n) in enumerate(rows)]  # no candidate is small enough for the current size
    df = spark.createDataFrame(data, "cluster string, candidate int, value double, size int, utility double, current int").repartition(3)
    assert L.desired_size(df, ["cluster"], "current").first()["size"] == desired(rows, 1)


def test_scale_that_changes_inside_a_step(spark):
    rows = [(0, 0, m, r, 0, [float(m + r)], s) for m, s in enumerate([4.0, 4.0, 6.0, 6.00001]) for r in range(2)]
    rows += [(0, 1, m, r, 0, [float(m + r)], 4.0) for m in range(3) for r in range(2)]
    rows += [(0, 2, m, r, 0, [1.0], s) for m, s in enumerate([4.0, 2.0, 4.0]) for r in range(2)]
    df = spark.createDataFrame(rows, "run int, step int, micro int, replica int, grp int, grad array<double>, accum_scale double")
    kept = Z.after_scale_change(df)
    assert {(r["step"], r["micro"]) for r in kept.collect()} == {(0, 2), (0, 3), (1, 0), (1, 1), (1, 2), (2, 2)}
    scales = {r["step"]: r["scale"] for r in Z.noise_estimates(kept, "accum_scale").collect()}
    assert scales == pytest.approx({0: 12.0, 1: 12.0, 2: 4.0}, rel=1e-4)  # accumulations times the scale of one
    assert {r["step"]: r["scale"] for r in Z.noise_estimates(kept).collect()} == {0: 4.0, 1: 6.0, 2: 2.0}


def test_syncs_inside_loops_are_not_replayed(spark):
    rows = [("r", 0, 0, a, False, "k", d) for a, d in ((0, 1), (0, 2), (1, 100))] + [("r", 0, 1, a, True, "k", d) for a, d in ((0, 5), (1, 7), (1, 8))] + [("r", 0, 2, 1, False, "k", 9)]
    df = spark.createDataFrame(rows, "run string, epoch int, sync_no int, attempt int, in_loop boolean, key string, delta long")
    got = {(r["sync_no"], r["attempt"]): r["value"] for r in A.accumulate_loops(df).collect()}
    assert got == {(0, 0): 3, (1, 0): 5, (1, 1): 15, (2, 1): 9}
    assert A.accumulate_loops(df.filter(F.lit(False))).count() == 0
