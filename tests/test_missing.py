"""Null phases, null taints and candidates that place nothing."""

from trainframe.operators import jobs as J
from trainframe.operators import placement as L
from trainframe.operators import resources as R


def test_nodes_without_taints(spark):
    rows = [(1, None), (2, []), (3, [("team", "blue")]), (4, [("team", "red")]), (5, [("team", "blue")] * 2)]
    nodes = spark.createDataFrame(rows, "node int, taints array<struct<key:string,value:string>>")
    assert sorted(r["node"] for r in R.allowed_nodes(nodes, "team", "blue").collect()) == [1, 2, 3]


def test_outcome_needs_every_phase(spark):
    schema = "job int, pod string, phase string, reason string, deleted date, exit_codes array<int>, preemptible boolean, replicas int"
    rows = [(1, "a", "Succeeded", None, None, None, True, 2), (1, "b", None, None, None, None, True, 2), (2, "a", "Succeeded", None, None, None, True, 1), (3, "a", "Failed", None, None, [143], None, 1)]
    got = {r["job"]: (r["outcome"], r["pod"]) for r in J.job_outcome(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (None, None), 2: ("Succeeded", None), 3: ("Failed", "a")}


def test_empty_candidates_score_zero(spark):
    states = spark.createDataFrame([(0, 1, 7, 2), (1, 1, 7, 0), (1, 2, 8, 0)], "candidate int, job int, node int, replicas int")
    jobs = spark.createDataFrame([(1, "cpu", 1.0), (2, "cpu", 1.0)], "job int, resource string, amount double")
    nodes = spark.createDataFrame([(7, "cpu", 4.0), (8, "cpu", 4.0)], "node int, resource string, amount double")
    speed = spark.createDataFrame([(0, 1, 1.5)], "candidate int, job int, speedup double")
    index = spark.createDataFrame([(7, 0), (8, 1)], "node int, node_index int")
    got = {r["candidate"]: r["utility"] for r in L.cluster_utility(states, jobs, nodes, speed).collect()}
    assert got == {0: 0.375, 1: 0.0}
    base = spark.createDataFrame([(1, 7, 2)], "job int, node int, replicas int")
    rows = {r["candidate"]: (r["value"], r["size"]) for r in L.candidate_objective(states, base, jobs, nodes, speed, index).collect()}
    assert rows == {0: (-0.375, 1), 1: (0.0, 0)}
