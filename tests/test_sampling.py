import math
import random

import pytest
from pyspark.sql import functions as F

from trainframe.operators import position
from trainframe.operators import sampling as S


@pytest.mark.parametrize("n,replicas", [(9, 1), (9, 5), (15, 3), (25, 3), (25, 5)])
@pytest.mark.parametrize("index", [0, 7, 2 * 9])
def test_shards_are_even_and_cover(spark, n, replicas, index):
    order = S.epoch_shuffle(spark.range(n), "id", epoch=1, pass_no=index // n)
    rows = S.padded_shards(order, replicas, index).toPandas()
    length = math.ceil((n - index % n) / replicas)
    assert (rows.groupby("rank").size() == length).all() and rows["rank"].nunique() == replicas
    for _, p in rows.groupby("rank"):
        assert sorted(p["k"]) == list(range(length))
    if index % n == 0:
        counts = rows.groupby("id").size()
        assert set(counts.index) == set(range(n)) and counts.max() - counts.min() <= 1


def test_order_changes_with_epoch_and_pass(spark):
    orders = [tuple(S.epoch_shuffle(spark.range(25), "id", epoch=e, pass_no=p).orderBy("pos").toPandas()["id"]) for e, p in [(0, 0), (0, 1), (1, 0), (0, 0)]]
    assert len(set(orders)) == 3 and orders[0] == orders[3]


def test_elastic_resume_positions(spark):
    """100 rows, batch 10: 2 batches on 1 replica, 5 on 4, the rest on 2 give local sizes 10, 3, 5 and ends 20, 80, 100."""
    segs = spark.createDataFrame([(0, 0, 1, 2), (0, 1, 4, 5), (0, 2, 2, None)], "run int, seg int, replicas int, batches int")
    plan = S.resume_plan(segs, F.lit(100), 10)
    assert [(r["end"], r["batches"]) for r in plan.orderBy("seg").collect()] == [(20, 2), (80, 5), (100, 2)]
    parts = S.resume_passes(plan)
    rows = S.elastic_resume(S.passes_shuffle(spark.range(100), "id", parts), parts).toPandas()
    assert sorted(rows["id"]) == list(range(100))
    assert [rows[rows["seg"] == s].groupby(["batch_no", "rank"]).size().max() for s in range(3)] == [10, 3, 5]


def test_elastic_resume_goes_on_into_later_passes(spark):
    """Step by step: every batch moves the index by its size, the end of a pass rounds it up to a multiple of n."""
    n, segs = 23, [(run, seg, (seg * 2 + run) % 5 + 1, (seg * 5 + run) % 9) for run in range(3) for seg in range(6)]
    want, ends = [], {}
    for run in range(3):
        index = 0
        for _, seg, replicas, count in (s for s in segs if s[0] == run):
            local = -(-4 // replicas)
            for b in range(count):
                size, base = replicas * local, index % n
                want += [(run, seg, index // n, b, off % replicas, off // replicas, base + off) for off in range(min(size, n - base))]
                index += size
                if base + size >= n:
                    index -= index % -n
            ends[run, seg] = index
    plan = S.resume_plan(spark.createDataFrame(segs, "run int, seg int, replicas int, batches int"), F.lit(n), 4)
    assert {(r["run"], r["seg"]): r["end"] for r in plan.collect()} == ends
    parts = S.resume_passes(plan)
    rows = S.elastic_resume(S.passes_shuffle(spark.range(n), "id", parts), parts)
    assert sorted(tuple(r) for r in rows.select("run", "seg", "pass_no", "batch_no", "rank", "slot", "pos").collect()) == sorted(want)
    assert S.resume_plan(plan.select("run", "seg", "replicas", "batches"), F.lit(0), 4).where("batches > 0 or end > 0").count() == 0


def test_drop_last_keeps_whole_batches(spark):
    b = S.batches(S.padded_shards(S.epoch_shuffle(spark.range(103), "id"), 4), 10, 4, drop_last=True).toPandas()
    assert (b.groupby(["rank", "batch_id"]).size() == 3).all()


def test_round_up(spark):
    rows = spark.range(200).select("id", S.round_up(F.col("id"), F.lit(7)).alias("r")).collect()
    assert all(r["r"] == r["id"] - r["id"] % -7 for r in rows)


def test_resume_plan_of_many_stretches_equals_one_fold(spark):
    """Segments that run to the end of their pass cut a run into stretches; each starts where a fold over the run says."""
    rng = random.Random(3)
    n, segs = 57, [(run, seg * 3, rng.randint(1, 5), None if rng.random() < 0.3 else rng.randint(0, 20)) for run in range(4) for seg in range(60)]
    want = {}
    for run in range(4):
        index = 0
        for _, seg, replicas, count in (s for s in segs if s[0] == run):
            size = replicas * -(-8 // replicas)
            start, made = index, 0
            while made < count if count is not None else made == 0 or index % n:
                base, index, made = index % n, index + size, made + 1
                if base + size >= n:
                    index += -index % n
            want[run, seg] = (made, start, index)
    df = spark.createDataFrame(segs, "run int, seg int, replicas int, batches int").repartition(5)
    plan = S.resume_plan(df, F.lit(n), 8)
    assert {(r["run"], r["seg"]): (r["batches"], r["start"], r["end"]) for r in plan.collect()} == want


def test_a_long_run_is_folded_by_many_tasks(spark):
    """What the fold gets is dealt out by stretches, not by runs."""
    df = spark.range(4000).select((F.col("id") % 1).alias("run"), F.col("id").alias("seg"), F.lit(2).alias("replicas"), F.when(F.col("id") % 10 < 9, 3).alias("batches"))
    plan = S.resume_plan(df, F.lit(100), 8)
    text = plan._jdf.queryExecution().executedPlan().toString()
    fold = text[text.index("MapInArrow") :]
    assert "hashpartitioning(run" in fold and "_stretch" in fold[fold.index("hashpartitioning(run") :].split(")")[0]
    assert plan.count() == 4000


def test_rows_far_from_the_places_read_are_left_out(spark):
    parts = spark.createDataFrame([(0, 0, 2, 0, 40, 0, 3, 10, 5000)], "run int, seg int, replicas int, pass_no int, base int, first_batch int, n_batches int, size int, n int")
    orders = S.passes_shuffle(spark.range(5000), "id", parts)
    assert 30 <= orders.count() < 500
    whole = {r["pos"]: r["id"] for r in S.passes_shuffle(spark.range(5000), "id", parts.select("pass_no")).collect()}
    got = S.elastic_resume(orders, parts).collect()
    assert sorted(r["pos"] for r in got) == list(range(40, 70)) and all(whole[r["pos"]] == r["id"] for r in got)


@pytest.mark.parametrize("digits,join", [(2, "BroadcastHashJoin"), (4, "SortMergeJoin")])
def test_rows_of_a_small_file_are_not_broadcast(spark, tmp_path, digits, join):
    """A file of a few kB stands for many rows once each is repeated per pass; what is broadcast is the table of buckets, or nothing."""
    path = str(tmp_path / "ids")
    spark.range(3000).write.parquet(path)
    ids = spark.read.parquet(path).withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.lit(2))))
    ranges = spark.createDataFrame([(0, 100, 900), (2, 0, 5), (2, 2500, 3000)], "pass_no int, first long, stop long")
    key = position.seeded_key(7, "pass_no", "id")
    got = position.hash_position(ids, key, ["id"], by=["pass_no"], digits=digits, ranges=ranges)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    lines = [x for x in plan.splitlines() if "_bucket" in x and "Join" in x and "Inner" in x]
    assert lines and join in lines[0] and "BuildLeft" not in lines[0]
    every = position.hash_position(ids, key, ["id"], by=["pass_no"], digits=digits)
    inside = "(pass_no = 0 and pos >= 100 and pos < 900) or (pass_no = 2 and (pos < 5 or pos >= 2500))"
    assert sorted(got.filter(inside).collect()) == sorted(every.filter(inside).collect())
