import pytest
from pyspark.sql import functions as F

from trainframe import session
from trainframe.operators import interactions as I
from trainframe.operators import ranking as R
from trainframe.plans import ranking as plan_ranking


def _missing(owned, items):
    return [i for i in range(items) if i not in owned]


@pytest.mark.parametrize("items", [40, 20000])
def test_negatives_match_brute_force(spark, items):
    """A hot user with nearly everything, one with everything, one with a few items, one with the ends only."""
    own = {1: set(range(items)) - {3, 17, items - 1}, 2: set(range(items)), 3: {0, 1, 5}, 4: {0, items - 1}}
    pairs = [(u, i) for u, s in own.items() for i in s]
    pos = spark.createDataFrame(pairs, "user long, item long")
    feats = pos.filter("item < 30")
    got = I.negatives(feats, pos, F.lit(items), 3, seed=4).toPandas()
    import hashlib

    assert set(got["user"]) == {1, 3, 4} and len(got) == 3 * len([p for p in pairs if p[1] < 30 and p[0] != 2])
    gone = {u: _missing(s, items) for u, s in own.items()}
    for r in got.itertuples():
        h = hashlib.md5(f"4|{r.user}|{r.item}|{r.ng_no}".encode()).hexdigest()
        assert r.neg == gone[r.user][int(h[:15], 16) % len(gone[r.user])]


def test_user_without_positives_draws_from_all_items(spark):
    pos = spark.createDataFrame([(1, 0)], "user long, item long")
    feats = spark.createDataFrame([(2, 7)], "user long, item long")
    got = I.negatives(feats, pos, F.lit(10), 5).toPandas()
    assert len(got) == 5 and got["neg"].between(0, 9).all()


def test_ranking_metrics_by_hand(spark):
    rows = [(1, p, 10 + p, s) for p, s in enumerate([0.5, 0.9, 0.7, 0.5])] + [(2, 0, 5, 0.1), (2, 1, 6, 0.2), (2, 2, 7, 0.3)]
    m = R.user_metrics(spark.createDataFrame(rows, "user int, position int, item int, score double"), 3).toPandas().set_index("user")
    assert m.loc[1, "hit"] == 1 and abs(m.loc[1, "ndcg"] - 0.5) < 1e-12  # rank 2, the tie goes to position 0
    assert m.loc[2, "hit"] == 1 and abs(m.loc[2, "ndcg"] - 0.5) < 1e-12
    m = R.user_metrics(spark.createDataFrame(rows, "user int, position int, item int, score double"), 2).toPandas().set_index("user")
    assert m.loc[1, "hit"] == 0 and m.loc[1, "ndcg"] == 0


@pytest.mark.parametrize("batch", [1, 7, 10000])
@pytest.mark.parametrize("most", [0, 300, 1 << 20])
def test_negatives_of_split_batches_and_full_slots(spark, batch, most):
    """Users over several Arrow batches, repeated rows, a user without positives, a null item among the features; slots over their limit go by blocks."""
    import hashlib

    items = 50
    own = {u: sorted({(u * 7 + i * i) % items for i in range(u % 9 * 5)}) for u in range(1, 30)} | {30: list(range(items))}
    pos = spark.createDataFrame([(u, i) for u, s in own.items() for i in s], "user int, item long")
    rows = [(u, i) for u, s in own.items() for i in s[:3]] + [(2, 7), (2, 7), (99, 4), (3, None)]
    feats = spark.createDataFrame(rows, "user int, item long")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = I.negatives(feats, pos, F.lit(items), 4, seed=2, most=most)
        assert df.schema.simpleString() == "struct<user:int,item:bigint,ng_no:int,neg:bigint>"
        got = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    expected = []
    for u, i in rows:
        gone = _missing(own.get(u, []), items)
        for k in range(1, 5) if gone else ():
            h = hashlib.md5("|".join(str(x) for x in (2, u, i, k) if x is not None).encode()).hexdigest()
            expected.append((u, i, k, gone[int(h[:15], 16) % len(gone)]))
    key = lambda r: (r[0], -1 if r[1] is None else r[1], *r[2:])
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_repeated_positives_count_each(spark):
    """A positive told twice takes one more of the user's items, whichever way the draws go."""
    pos = spark.createDataFrame([(1, 3), (1, 3), (1, 8)], "user long, item long")
    feats = spark.createDataFrame([(1, i) for i in range(20)], "user long, item long")
    few, large = (sorted(I.negatives(feats, pos, F.lit(12), 3, seed=1, most=m).collect()) for m in (1 << 20, 0))
    assert few == large and len(few) == 60


def test_null_user_fails_the_job(spark):
    good = spark.createDataFrame([(1, 3)], "user long, item long")
    for bad in ([(None, 1)], [(1, None)]):
        with pytest.raises(Exception, match="null group or order key"):
            I.negatives(good, spark.createDataFrame(bad, "user long, item long"), F.lit(9), 2).collect()


def test_draws_are_made_behind_the_last_shuffle(spark):
    """What is shuffled is positives and feature rows, not a row per draw."""
    pos = spark.createDataFrame([(1, 0), (2, 1)], "user long, item long")
    plan = I.negatives(pos, pos, F.lit(10), 99)._jdf.queryExecution().sparkPlan().toString()
    assert "Generate" in plan and plan.index("Generate") < plan.index("Exchange")


def test_tasks_grow_in_number_with_the_rows(spark, monkeypatch):
    """Pairs and draws go to as many tasks as their rows ask for, which the number of shuffle partitions does not bound."""
    monkeypatch.setattr(session, "TASK_ROWS", 10)
    pos = spark.range(400).select(F.col("id").alias("user"), (F.col("id") % 7).alias("item"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(user" in plan(I.distinct_interactions(pos, 700)) and ", 70), REPARTITION_BY_NUM" in plan(I.distinct_interactions(pos, 700))
    assert ", 120), REPARTITION_BY_NUM" in plan(I.negatives(pos, pos, F.lit(9), 2))  # 400 positives and 800 draws
    assert I.distinct_interactions(pos.unionByName(pos), 800).count() == 400


@pytest.mark.parametrize("most", [0, 30, 1 << 20])
def test_features_that_are_the_positives_travel_once(spark, most):
    rows = [(u, (u * i * i) % 50) for u in range(1, 40) for i in range(u % 9)] + [(5, 1), (5, 1)]
    pos = spark.createDataFrame(rows, "user long, item long")
    other = pos.select("*")
    one, two = (sorted(map(tuple, I.negatives(f, pos, F.lit(50), 3, seed=2, most=most).collect())) for f in (pos, other))
    assert one == two and len(one) == 3 * len(rows)
    plan = I.negatives(pos, pos, F.lit(50), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(user") == 1 and "Union" not in plan


def test_last_item_by_orders_is_the_last_of_all_lines(spark, tmp_path):
    """Two orders on one day, repeated orders and lines, null items, a null user, lines without an order."""
    orders = [(1, 1, "2020-01-01"), (2, 1, "2020-01-01"), (3, 1, "2019-01-01"), (4, 2, "2020-05-01"), (4, 2, "2020-05-01"), (5, 3, None), (6, 3, "2018-01-01"), (7, 4, "2018-01-01"), (8, None, "2018-01-01")]
    lines = [(1, 5), (1, 9), (2, 7), (3, 50), (4, 3), (4, None), (5, 8), (6, 2), (6, 2), (7, None), (8, 4), (None, 6), (99, 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    expected = I.hold_out_last(plan_ranking._bought(spark, str(tmp_path)), "o_orderdate")
    got = {tuple(r) for r in plan_ranking._truth(spark, str(tmp_path)).collect()}
    assert got == {tuple(r) for r in expected.collect()} == {(1, 9), (2, 3), (3, 2), (4, None), (None, 4)}
