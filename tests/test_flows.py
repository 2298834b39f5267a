import json

import pytest
from pyspark.sql import functions as F

from trainframe.operators import perfmodel as M
from trainframe.sources import readers as D
from trainframe.sources import sinks as K
from trainframe.streaming import jobs as T


def test_readers(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("1\t2\t5\t99\n3\t4\t1\t98\n")
    assert [tuple(r) for r in D.ratings(spark, str(tmp_path / "r.tsv")).orderBy("user").collect()] == [(1, 2), (3, 4)]
    (tmp_path / "c.txt").write_text("(0,25)\t1064\t174\n(1, 133)\t8\n")
    got = [tuple(r) for r in D.ranking_candidates(spark, str(tmp_path / "c.txt")).orderBy("user", "position").collect()]
    assert got == [(0, 0, 25), (0, 1, 1064), (0, 2, 174), (1, 0, 133), (1, 1, 8)]
    (tmp_path / "books" / "a").mkdir(parents=True)
    (tmp_path / "books" / "a" / "x.txt").write_bytes(b"  one \n\xff\xfetwo\xff\n")
    lines = D.corpus_lines(spark, str(tmp_path / "books" / "*" / "*.txt")).collect()
    assert [r["text"] for r in lines] == ["one", "two"] and lines[0]["path"].endswith("x.txt")


def test_snapshots(spark, tmp_path):
    s = K.Snapshots(spark, str(tmp_path))
    s.register("a")
    with pytest.raises(ValueError):
        s.register("a")
    assert s.latest("a") is None and s.versions("a") == []
    for v in (0, 9, 10):
        s.save("a", spark.range(v + 1), v)
    s.save("a", spark.range(3), 9)
    assert s.versions("a") == [0, 9, 10] and s.latest("a").count() == 11 and s.latest("a", below=10).count() == 3 and s.kept("a", 2) == [9, 10]


def test_scalars_drop_empty_count(spark, tmp_path):
    df = spark.createDataFrame([("r", 0, 1.0, 0.0), ("r", 1, 2.0, 3.0)], "run string, step long, gain double, accum_count double")
    rows = K.scalar_rows(df, {"Gain": "gain", "Accum_Count": "accum_count"}, "x")
    K.write_scalars(rows, str(tmp_path / "s"))
    assert {(r["tag"], r["step"], r["value"]) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {("x/Gain", 0, 1.0), ("x/Gain", 1, 2.0), ("x/Accum_Count", 1, 3.0)}


def _hint(folder, name, **fields):
    (folder / f"{name}.json").write_text(json.dumps(fields) + "\n")


def test_latest_hints_over_restarts(spark, tmp_path):
    feed = tmp_path / "feed"
    feed.mkdir()
    store = K.Snapshots(spark, str(tmp_path / "store"))

    def run():
        T.run_latest_hints(D.hint_feed(spark, str(feed)), store, str(tmp_path / "cp")).awaitTermination()
        return {r["job"]: (r["hints"]["initBatchSize"], r["seq"]) for r in store.latest("hints").collect()}

    _hint(feed, "a", job="j", ts="2024-01-01T00:00:02Z", seq=2, initBatchSize=20, nonsense=1)
    _hint(feed, "b", job="k", ts="2024-01-01T00:00:01Z", seq=1, initBatchSize=10)
    assert run() == {"j": (20, 2), "k": (10, 1)}
    _hint(feed, "c", job="j", ts="2024-01-01T00:00:01Z", seq=1, initBatchSize=5)  # late and older
    _hint(feed, "d", job="k", ts="2024-01-01T00:00:03Z", seq=3, initBatchSize=30)
    assert run() == {"j": (20, 2), "k": (30, 3)} and "nonsense" not in store.latest("hints").select("hints.*").columns
    assert run() == {"j": (20, 2), "k": (30, 3)}


def _events(spark, folder, rows, n):
    spark.createDataFrame(rows, "job bigint, micros bigint, seq bigint, phase string").coalesce(1).write.mode("append").parquet(folder)


def test_phases_go_on_after_restart(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    store = K.Snapshots(spark, str(tmp_path / "store"))

    def run():
        stream = spark.readStream.schema("job bigint, micros bigint, seq bigint, phase string").parquet(src)
        T.run_phases(stream, out, store, str(tmp_path / "cp")).awaitTermination()
        return sorted(tuple(r) for r in T.current_phases(spark, out).select("job", "phase", "from_ts", "to_ts").collect())

    _events(spark, src, [(1, 10, 0, "Pending"), (1, 30, 1, "Starting"), (2, 5, 0, "Pending")], 0)
    assert run() == [(1, "Pending", 10, 30)]
    _events(spark, src, [(1, 70, 2, "Running"), (2, 5_000_000_000_000, 1, "Failed")], 1)
    want = [(1, "Pending", 10, 30), (1, "Starting", 30, 70), (2, "Pending", 5, 5_000_000_000_000)]
    assert run() == want and run() == want
    _events(spark, src, [(1, 50, 9, "Late"), (1, 30, 1, "Starting"), (3, 1, 0, "Pending")], 2)  # late, repeated and new
    want = [(1, "Late", 50, 70), (1, "Pending", 10, 30), (1, "Starting", 30, 50), (2, "Pending", 5, 5_000_000_000_000)]
    assert run() == want
    _events(spark, src, [(1, 80, 10, "Succeeded"), (3, 0, 1, "Early")], 3)
    assert run() == sorted([*want, (1, "Running", 70, 80), (3, "Early", 0, 1)])


def test_totals_count_late_and_repeated_updates_once(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")

    def run(*rows):
        df = spark.createDataFrame(rows, "ts string, update_id long, run long, key string, delta long").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(src)
        T.run_totals(spark.readStream.schema(df.schema).parquet(src), out, str(tmp_path / "cp")).awaitTermination()
        return {(r["run"], r["key"]): r["total"] for r in T.current_totals(spark, out).collect()}

    assert run(("2024-05-01", 1, 7, "a", 10), ("2024-05-01", 1, 7, "a", 10), ("2024-05-02", 2, 7, "a", 5)) == {(7, "a"): 15}
    assert run(("2024-05-02", 2, 7, "a", 5), ("2020-01-01", 3, 7, "a", 1), (None, 4, 8, "b", 2)) == {(7, "a"): 16, (8, "b"): 2}
    assert run((None, 4, 8, "b", 2), ("2020-01-01", 3, 7, "a", 1), ("2024-05-01", 5, 7, "a", 100)) == {(7, "a"): 116, (8, "b"): 2}


def test_snapshots_keep_the_newest(spark, tmp_path):
    s = K.Snapshots(spark, str(tmp_path), keep=2)
    for v in range(4):
        s.save("a", spark.range(v + 1), v)
    s.save("a", spark.range(9), 3)
    assert s.versions("a") == [2, 3] and s.latest("a").count() == 9
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == ["snapshot=2", "snapshot=3"]


def test_new_jobs_filter(spark):
    df = spark.createDataFrame([(1, "ADDED", True), (2, "ADDED", None), (3, "ADDED", False), (4, "MODIFIED", True)], "id int, type string, preemptible boolean")
    assert {r["id"] for r in T.new_jobs(df).collect()} == {1, 2}


@pytest.mark.parametrize("block", [2, 3, 1000])
def test_reduce_custom_keeps_rank_order(spark, block):
    df = spark.range(50).select((F.col("id") % 2).alias("g"), "id", F.char(F.col("id") + 48).alias("v"))
    got = {r["g"]: r["v"] for r in M.reduce_custom(df, ["g"], "id", "v", lambda a, b: a + b, block=block).collect()}
    assert got == {g: "".join(chr(i + 48) for i in range(g, 50, 2)) for g in (0, 1)}


def test_nested_pod_and_node_records(spark, tmp_path):
    pods = [
        {"metadata": {"name": "p0", "namespace": "lab", "labels": {"team/job": "fit"}, "deletionTimestamp": "2024-03-01T10:00:00Z"},
         "spec": {"nodeName": "n0", "containers": [{"name": "a", "resources": {"limits": {"cpu": "2"}}}, {"name": "b"}]},
         "status": {"phase": "Failed", "reason": "Evicted", "conditions": [{"type": "Ready", "status": "True"}, {"type": "PodScheduled", "status": "True"}, {"type": "Ready", "status": "False"}],
                    "containerStatuses": [{"ready": False, "state": {"terminated": {"exitCode": 143}}}, {"ready": True, "state": {"running": {}}}]}},
        {"metadata": {"name": "p1"}, "unknown": 1},
    ]
    (tmp_path / "pods.json").write_text("\n".join(map(json.dumps, pods)))
    full, bare = sorted(D.pods(spark, str(tmp_path / "pods.json"), "team/job").collect(), key=lambda r: r["pod"])
    assert (full["job"], full["node"], full["phase"], full["reason"]) == ("lab/fit", "n0", "Failed", "Evicted") and full["deleted"] is not None
    assert full["exit_codes"] == [143] and full["ready"] == [False, True] and full["conditions"] == {"Ready": "False", "PodScheduled": "True"}
    assert [c["name"] for c in full["containers"]] == ["a", "b"] and full["containers"][0]["limits"] == {"cpu": "2"} and full["containers"][1]["requests"] is None
    assert bare["node"] is None and bare["containers"] is None and bare["conditions"] is None
    (tmp_path / "nodes.json").write_text(json.dumps({"metadata": {"name": "n0"}, "status": {"allocatable": {"cpu": "4"}}}))
    assert [tuple(r) for r in D.nodes(spark, str(tmp_path / "nodes.json")).collect()] == [("n0", {"cpu": "4"}, None)]


def test_pod_records_are_stored_compressed(spark, tmp_path, monkeypatch):
    """Records as JSON take many times their table, so the files are compressed, and cut by records as one task reads a file."""
    from trainframe.plans import flows

    spark.sql("select id as l_orderkey, id % 3 + 1 as l_suppkey, cast(1 as int) as l_linenumber, 2.0D as l_quantity, 0.05D as l_discount, if(id % 4 = 0, 'R', 'N') as l_returnflag from range(1000)").write.parquet(str(tmp_path / "lineitem.parquet"))
    spark.sql("select id + 1 as s_suppkey from range(3)").write.parquet(str(tmp_path / "supplier.parquet"))
    paths = {}
    monkeypatch.setattr(flows, "scratch", lambda s, name: paths.setdefault(name, str(tmp_path / name)))
    monkeypatch.setattr(flows, "FILE_RECORDS", 50, raising=False)
    got = {(r["node"], r["resource"]): r["amount"] for r in flows.node_free_from_files(spark, str(tmp_path)).collect()}
    live = sum(1 for i in range(1000) if i % 3 == 0 and i % 4)
    assert got[1, "cpu"] == 5000 - 2 * live and got[1, "pods"] == 1000 - live
    files = list((tmp_path / "pods").glob("part-*"))
    assert len(files) >= 20 and all(f.name.endswith(".json.gz") for f in files)
    assert sum(f.stat().st_size for f in files) < 100 * 1000
