import pandas as pd
import pytest
from pyspark.sql import functions as F

from trainframe.functions import records as C
from trainframe.operators import accumulate as A
from trainframe.operators import jobs as J
from trainframe.operators import placement as L
from trainframe.operators import ranktree
from trainframe.operators import resources as R


@pytest.mark.parametrize(
    "name,value,want",
    [
        ("cpu", "10k", 10**7), ("cpu", "100m", 100), ("cpu", "1000", 10**6), ("cpu", "1M", 10**9), ("cpu", "1.37m", 2), ("cpu", "0.5", 500),
        ("memory", "1T", 10**12), ("memory", "1Gi", 2**30), ("memory", "10e3", 10000), ("memory", "1E", 10**18), ("memory", "1500m", 2), ("memory", "2Ei", 2**61), ("pods", "7", 7),
        ("memory", "lots", None),
    ],
)
def test_quantity(spark, name, value, want):
    got = spark.createDataFrame([(name, value)], "n string, v string").select(C.quantity(F.col("n"), F.col("v")).alias("q")).first()["q"]
    assert got == want


CONTAINERS = "array<struct<name: string, requests: map<string,string>, limits: map<string,string>>>"


def test_pod_requests_and_defaults(spark):
    pod = [
        ("train", {"cpu": "6", "memory": "2k"}, {"cpu": "8", "fpga": "5"}),
        ("logger", {"cpu": "250m", "memory": "40", "fpga": "9"}, {"fpga": "1", "memory": "999"}),
        ("bare", None, None),
    ]
    df = spark.createDataFrame([("p", pod)], f"pod string, containers {CONTAINERS}")
    got = {r["resource"]: r["amount"] for r in R.pod_requests(df, ["pod"]).collect()}
    assert got == {"pods": 1, "cpu": 6250, "memory": 2040, "fpga": 6}
    filled = df.select("pod", R.default_resources(F.col("containers"), {"cpu": "1", "gpu": "2"}, None).alias("containers")).first()["containers"]
    assert filled[0]["requests"] == {"cpu": "6", "memory": "2k", "gpu": "2"} and filled[0]["limits"] == pod[0][2] and filled[1]["requests"] == pod[1][1]
    bare = spark.createDataFrame([("p", [("m", None, None)])], f"pod string, containers {CONTAINERS}")
    got = bare.select(R.default_resources(F.col("containers"), {"cpu": "1"}, None).alias("c")).first()["c"][0]
    assert got["requests"] == {"cpu": "1"} and got["limits"] is None


def test_node_free_drops_negative_and_foreign(spark):
    nodes = spark.createDataFrame([("a", {"cpu": "2", "pods": "5"})], "node string, allocatable map<string,string>")
    one = [("m", {"cpu": "1500m", "memory": "1"}, None)]
    pods = spark.createDataFrame([("a", "Running", one), ("a", "Failed", one), ("b", "Running", one)], f"node string, phase string, containers {CONTAINERS}")
    assert {r["resource"]: r["amount"] for r in R.node_free(nodes, pods).collect()} == {"cpu": 500, "pods": 4}
    assert {r["resource"]: r["amount"] for r in R.node_free(nodes, pods.union(pods)).collect()} == {"pods": 3}


def test_first_fit_expected_answers(spark):
    """Ranks: mid (room for 3 slots, 9 of disk), tiny (1, 2), wide (8, 4), then the preemptible huge (50, 50)."""
    made = [("mid", 3, 9, False), ("huge", 50, 50, True), ("wide", 8, 4, False), ("tiny", 1, 2, False)]
    nodes = spark.createDataFrame([("east", n, {"slot": s, "disk": d}, p) for n, s, d, p in made] + [("west", "only", {"slot": 1}, False)], "cluster string, node string, free map<string,long>, preemptible boolean")
    asks = [("east", "a", {"slot": 1, "disk": 3}, 3, ["mid"] * 3), ("east", "b", {"slot": 1}, 4, ["wide"] * 4), ("east", "c", {"disk": 1, "slot": 2}, 0, ["mid"]),
            ("east", "d", {"slot": 2, "disk": 1}, None, ["mid"]), ("east", "e", {"slot": 5, "disk": 5}, 2, ["huge"] * 2), ("east", "f", {"slot": 60}, 1, []),
            ("west", "g", {"slot": 1}, 1, ["only"]), ("west", "h", {"slot": 1, "disk": 1}, 1, []), ("north", "i", {"slot": 1}, 1, []), (None, "j", {"slot": 1}, 1, []), ("east", "k", None, 1, [])]
    jobs = spark.createDataFrame([a[:4] for a in asks], "cluster string, job string, resources map<string,long>, min_replicas int")
    ranked = L.rank_nodes(nodes)
    assert {r["job"]: r["allocation"] for r in L.first_fit(jobs, ranked).collect()} == {a[1]: a[4] for a in asks}
    assert {r["job"] for r in L.schedulable(jobs, ranked).collect()} == set("abcdeg")


@pytest.mark.parametrize("chunk", [1, 2, 1024])
def test_first_fit_does_not_depend_on_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(ranktree, "BLOCK", chunk)
    nodes = spark.range(17).select(F.lit(0).alias("cluster"), F.col("id").cast("string").alias("node"), F.create_map(F.lit("cpu"), F.col("id") * 3 % 17).alias("free"), (F.col("id") % 4 == 0).alias("preemptible"))
    jobs = spark.range(1, 20).select(F.lit(0).alias("cluster"), F.col("id").alias("job"), F.create_map(F.lit("cpu"), F.col("id")).alias("resources"), F.lit(1).alias("min_replicas"))
    got = {r["job"]: r["allocation"] for r in L.first_fit(jobs, L.rank_nodes(nodes)).collect()}
    order = sorted(range(17), key=lambda i: (i % 4 == 0, str(i)))
    for j in range(1, 20):
        want = [str(i) for i in order if i * 3 % 17 >= j][:1]
        assert got[j] == want
    assert {r["job"] for r in L.schedulable(jobs, L.rank_nodes(nodes)).collect()} == set(range(1, 17))


@pytest.mark.parametrize("width", [1, 3, 256])
def test_serve_from_start_matches_a_loop(spark, width):
    amounts = {"a": [2, 0, 5, 1, 4], "b": [3], "c": []}
    caps = [("a", "j0", 0), ("a", "j1", 1), ("a", "j2", 7), ("a", "j3", 50), ("b", "j4", 3), ("b", "j5", 2), ("c", "j6", 4), ("a", "j7", None)]
    supply = spark.createDataFrame([(g, i, n) for g, ns in amounts.items() for i, n in enumerate(ns)], "cluster string, rank long, amount long")
    asks = spark.createDataFrame(caps, "cluster string, job string, cap long")
    want = {}
    for g, job, cap in caps:
        for i, n in enumerate(amounts[g]):
            given = max(0, min(n, (cap or 0) - sum(amounts[g][:i])))
            if given:
                want[job, i] = given
    rows = L.serve_from_start(asks, supply, ["cluster"], "rank", "amount", "cap", width).collect()
    assert {(r["job"], r["rank"]): r["given"] for r in rows} == want and len(rows) == len(want)


def test_accumulator_story(spark):
    log = [(0, s, y, o, k, d) for s, (y, o, k, d) in enumerate([(0, "add", "a", 10.0), (0, "add", "a", 5.0), (1, "add", "a", 1.0), (1, "add", "b", 6.0), (2, "add", "b", -10.0), (2, "add", "c", -10.0), (3, "clear", None, None)])]
    df = spark.createDataFrame(log, "run int, seq int, sync_no int, op string, key string, delta double")
    got = {(r["sync_no"], r["key"]): r["total"] for r in A.carried_totals(df).collect()}
    assert got == {(0, "a"): 15.0, (1, "a"): 16.0, (1, "b"): 6.0, (2, "b"): -4.0, (2, "c"): -10.0}
    assert A.final_totals(df).count() == 0
    assert {r["key"]: r["total"] for r in A.final_totals(df.filter("op = 'add'")).collect()} == {"a": 16.0, "b": -4.0, "c": -10.0}


def test_replay_takes_first_attempt(spark):
    rows = [(0, 0, 0, 1, "a", 9.0), (0, 0, 0, 0, "a", 1.0), (0, 0, 0, 0, "a", 2.0), (0, 0, 0, 1, "b", 7.0), (0, 0, 1, 5, "a", 4.0)]
    df = spark.createDataFrame(rows, "run int, epoch int, sync_no int, attempt int, key string, delta double")
    assert {(r["sync_no"], r["key"]): r["value"] for r in A.accumulate_once(df).collect()} == {(0, "a"): 3.0, (1, "a"): 4.0}


def test_reductions(spark):
    df = spark.createDataFrame([(0, r, [1, 1, 1], {"foo": int(r == 0), "bar": r}, [r]) for r in range(4)], "g int, rank int, vec array<int>, counter map<string,int>, keys array<int>")
    assert A.reduce_vectors(df, ["g"], "vec").first()["vec"] == [4, 4, 4]
    assert {r["key"]: r["count"] for r in A.reduce_counters(df, ["g"], "counter").collect()} == {"foo": 1, "bar": 6}
    assert {r["member"] for r in A.reduce_sets(df, ["g"], "keys").collect()} == {0, 1, 2, 3}
    assert {r["leader_rank"] for r in A.leader_value(df.withColumn("rank2", F.col("rank")), ["g"], "rank2", "rank").collect()} == {0}


def test_spec_rules(spark):
    df = spark.createDataFrame([("a", 4, 2), ("b", None, 1), ("c", 1, None), ("x" * 64, -1, 0)], "name string, min_replicas int, max_replicas int")
    got = {(r["name"][:1], r["rule"]) for r in J.broken_rules(df, ["name"], J.spec_rules()).collect()}
    assert got == {("a", "max_below_min"), ("x", "max_below_one"), ("x", "min_negative"), ("x", "name_too_long")}


def test_outcomes(spark):
    rows = [
        ("ok", "p0", "Succeeded", None, None, None, True, 2), ("ok", "p1", "Succeeded", None, None, None, True, 2),
        ("few", "p0", "Succeeded", None, None, None, True, 2),
        ("stop", "p0", "Failed", None, None, [143], True, 1), ("pinned", "p0", "Failed", None, None, [143], False, 1),
        ("full", "p0", "Failed", "OutOfcpu", None, None, True, 1), ("full2", "p0", "Failed", "Outofcpu", None, None, True, 1),
        ("odd", "p1", "Unknown", None, None, None, True, 2), ("odd", "p0", "Running", None, None, None, True, 2),
    ]
    df = spark.createDataFrame(rows, "job string, pod string, phase string, reason string, deleted timestamp, exit_codes array<int>, preemptible boolean, replicas int")
    got = {r["job"]: (r["outcome"], r["pod"]) for r in J.job_outcome(df).collect()}
    assert got == {
        "ok": ("Succeeded", None), "few": (None, None), "stop": (None, None), "pinned": ("Failed", "p0"), "full": ("Failed", "p0"), "full2": (None, None), "odd": ("Failed", "p1"),
    }


def test_trial_and_tag_and_runtime(spark):
    one = spark.range(1)
    assert tuple(one.select(C.trial_fields(F.lit("My_Trial_4_2_ab12")).alias("f")).first()["f"]) == ("My_Trial", 4, 2, "ab12")
    tags = one.select(*[C.tag(F.lit(p), F.lit("X")).alias(n) for n, p in (("a", ""), ("b", "t"), ("c", "t/"))]).first()
    assert tuple(tags) == ("X", "t/X", "t/X")
    t = lambda x: C.parse_time(F.lit(x))
    got = one.select(C.runtime_seconds(t("2020-01-01T00:00:00Z"), t(None), t("2020-01-03T00:01:30+00:00")).alias("s")).first()["s"]
    assert got == 2 * 86400 + 90


def test_desired_size_rules(spark):
    rows = [("keep", 1, -5.0, 3, 0.4, 4), ("near", 1, -5.0, 3, 0.8, 4), ("near", 2, -6.0, 9, 0.55, 4), ("near", 3, -6.5, 12, 0.55, 4), ("none", 1, -1.0, 2, 0.1, 7)]
    df = spark.createDataFrame(rows, "cluster string, candidate int, value double, size int, utility double, current int")
    assert {r["cluster"]: r["size"] for r in L.desired_size(df, ["cluster"], "current").collect()} == {"keep": 4, "near": 12, "none": 7}


def test_allocation_round_trip(spark):
    a = spark.createDataFrame([("j", ["n1", "n0", "n1"]), ("k", [])], "job string, allocation array<string>")
    counts = L.allocation_counts(a)
    assert {(r["node"], r["replicas"]) for r in counts.collect()} == {("n1", 2), ("n0", 1)}
    assert L.allocation_lists(counts).first()["allocation"] == ["n0", "n1", "n1"]
    diff = L.allocation_diff(a, spark.createDataFrame([("j", ["n1", "n1", "n0"]), ("l", ["x"])], a.schema)).collect()
    assert {r["job"] for r in diff} == {"j", "l"}
    nodes = L.active_nodes(a, F.lit(4)).toPandas()["node"]
    assert set(nodes) == {"n0", "n1", "~0", "~1"}
