"""Resources, placements and job records over ``supplier`` (nodes), ``part`` and ``orders`` (jobs) and ``lineitem`` (pods)."""

from pyspark.sql import functions as F

from trainframe.functions import records as C
from trainframe.operators import jobs as J
from trainframe.operators import placement as L
from trainframe.operators import resources as R
from trainframe.operators.blocked import step_block
from trainframe.session import spread, table


def _map(*pairs):
    return F.create_map(*[x if not isinstance(x, str) else F.lit(x) for kv in pairs for x in kv])


def _text(c):
    return c.cast("bigint").cast("string")


# --- quantities and resources ---

SUFFIX_LIST = list(C.SUFFIXES)


def quantities(spark, sf):
    i = F.pmod("l_orderkey", F.lit(len(SUFFIX_LIST)))
    suffix = F.array(*[F.lit(s) for s in SUFFIX_LIST])[i.cast("int")]
    name = F.when((i < 7) & (F.col("l_partkey") % 2 == 0), "cpu").otherwise("memory")
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", name.alias("name"), F.concat(F.col("l_linenumber").cast("string"), suffix).alias("value"))
    return li.select("l_orderkey", "l_partkey", "l_linenumber", "name", "value", C.quantity(F.col("name"), F.col("value")).alias("amount"))


def _pods(spark, sf):
    no_map = F.lit(None).cast("map<string,string>")
    q = F.col("l_linenumber")
    main = F.struct(
        F.lit("main").alias("name"),
        _map(("cpu", F.concat(_text(F.col("l_quantity")), F.lit("m"))), ("memory", F.concat(_text(q), F.lit("Mi")))).alias("requests"),
        _map(("gpu", _text(q % 3)), ("ephemeral-storage", F.lit("1k"))).alias("limits"),
    )
    side = F.struct(
        F.lit("side").alias("name"),
        _map(("ephemeral-storage", F.concat(_text(F.round(F.col("l_discount") * 100)), F.lit("k")))).alias("requests"),
        no_map.alias("limits"),
    )
    phase = F.when(F.col("l_returnflag") == "R", "Succeeded").when(F.col("l_returnflag") == "A", "Running").when(F.col("l_linenumber") != 1, "Pending")
    cols = ["l_orderkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"]
    rows = spread(table(spark, sf, "lineitem").select(*cols), "l_orderkey", "l_linenumber")
    return rows.select("l_orderkey", F.col("l_suppkey").alias("node"), phase.alias("phase"), F.array(main, side).alias("containers"))


def _nodes(spark, sf):
    s = F.col("s_suppkey")
    alloc = _map(("cpu", _text(4 + s % 13)), ("memory", F.concat(_text(16 + s % 7), F.lit("Gi"))), ("pods", F.lit("1000")), ("gpu", _text(s % 5 * 50)))
    return table(spark, sf, "supplier").select(s.alias("node"), alloc.alias("allocatable"))


PODS = """
r AS (SELECT l_orderkey, l_suppkey AS node, l_returnflag, u.k AS resource, u.a AS amount FROM lineitem,
      LATERAL (VALUES ('cpu', CAST(l_quantity AS BIGINT)), ('memory', l_linenumber * 1048576::BIGINT), ('gpu', (l_linenumber % 3)::BIGINT),
                      ('ephemeral-storage', CAST(round(l_discount * 100) AS BIGINT) * 1000), ('pods', 1::BIGINT)) u(k, a))"""

CAPACITY = """
c AS (SELECT s_suppkey AS node, u.k AS resource, u.a AS amount FROM supplier,
      LATERAL (VALUES ('cpu', (4 + s_suppkey % 13) * 1000), ('memory', (16 + s_suppkey % 7) * 1073741824), ('pods', 1000), ('gpu', s_suppkey % 5 * 50)) u(k, a)),
f AS (SELECT c.node, c.resource, CAST(c.amount - coalesce(used, 0) AS BIGINT) AS amount FROM c LEFT JOIN
      (SELECT node, resource, sum(amount) AS used FROM r WHERE l_returnflag <> 'R' GROUP BY 1, 2) u ON c.node = u.node AND c.resource = u.resource)"""


def pod_requests(spark, sf):
    return R.pod_requests(_pods(spark, sf), ["l_orderkey"])


def default_requests(spark, sf):
    pods = _pods(spark, sf).withColumn("containers", R.default_resources(F.col("containers"), {"cpu": "2", "ephemeral-storage": "3k"}, {"gpu": "1", "fpga": "2"}))
    return R.pod_requests(pods, ["l_orderkey"])


def node_free(spark, sf):
    return R.node_free(_nodes(spark, sf), _pods(spark, sf))


def node_template(spark, sf):
    return R.node_template(R.node_free(_nodes(spark, sf), _pods(spark, sf)))


def resource_types(spark, sf):
    p = F.col("p_type")
    return R.resource_types(table(spark, sf, "part").select(_map(("cpu", F.lit(1)), ("pods", F.lit(1))).alias("a"), p).select(F.map_concat("a", F.create_map(p, F.lit(1))).alias("resources")))


def allowed_nodes(spark, sf):
    s = F.col("s_suppkey")
    taint = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    ours = taint(F.lit("group"), F.when(s % 7 == 1, "other").otherwise("train"))
    none = F.array().cast("array<struct<key:string,value:string>>")
    taints = F.when(s % 3 == 0, F.when(s % 2 == 0, none)).when(s % 3 == 1, F.array(ours)).otherwise(F.array(ours, ours))
    return R.allowed_nodes(table(spark, sf, "supplier").select("s_suppkey", taints.alias("taints")), "group", "train").select("s_suppkey")


def bundle_usage(spark, sf):
    o = F.col("o_orderkey")
    node = lambda k: F.concat(F.lit("node:"), (F.col("o_custkey") % k).cast("string"))
    b = F.array(
        F.create_map(F.lit("CPU"), F.lit(0.001)),
        F.create_map(node(50), F.lit(0.5), F.lit("CPU"), (o % 4).cast("double")),
        F.create_map(F.lit("GPU"), (o % 3).cast("double"), node(40), F.lit(0.25)),
    )
    out = R.bundle_usage(table(spark, sf, "orders").select(b.alias("bundles")))
    return out.select("node", "resource", F.round("amount", 6).alias("amount"))


# --- placement ---


def _ranked_nodes(spark, sf):
    s = F.col("s_suppkey")
    free = F.create_map(F.lit("cpu"), 4000 + s % 13 * 1000, F.lit("memory"), 16 + s % 7)
    n = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("cluster"), F.col("s_name").alias("node"), (s % 3 == 0).alias("preemptible"), free.alias("free"))
    return L.rank_nodes(n)


def _jobs(spark, sf):
    p = F.col("p_partkey")
    res = F.create_map(F.lit("cpu"), F.col("p_size").cast("bigint") * 250, F.lit("memory"), 1 + p % 5)
    return table(spark, sf, "part").select(
        (p % 25).cast("int").alias("cluster"), p.alias("job"), res.alias("resources"), (p % 4).alias("min_replicas"),
        F.col("p_retailprice").alias("created"), (F.col("p_size") % 5 == 0).alias("pinned"),
    )


NODES = """
n AS (SELECT s_nationkey AS cluster, s_name AS node, s_suppkey % 3 = 0 AS pre, 4000 + s_suppkey % 13 * 1000 AS cpu, 16 + s_suppkey % 7 AS mem,
             row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey % 3 = 0, s_name) - 1 AS rank FROM supplier),
j AS (SELECT p_partkey % 25 AS cluster, p_partkey AS job, p_size * 250 AS cpu, 1 + p_partkey % 5 AS mem, p_partkey % 4 AS lo, p_retailprice AS created, p_size % 5 = 0 AS pinned FROM part)"""


def job_ranks(spark, sf):
    return L.rank_jobs(_jobs(spark, sf)).select("cluster", "job", "rank")


def node_ranks(spark, sf):
    return _ranked_nodes(spark, sf).select("cluster", "node", "rank")


def first_fit(spark, sf):
    out = L.first_fit(_jobs(spark, sf), _ranked_nodes(spark, sf))
    return out.select("cluster", "job", F.concat_ws(",", "allocation").alias("allocation"))


def schedulable(spark, sf):
    return L.schedulable(_jobs(spark, sf), _ranked_nodes(spark, sf)).select("cluster", "job")


def allocation_diff(spark, sf):
    o = table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey") % 20
    alloc = lambda n: F.array_repeat(F.concat(F.lit("n"), n.cast("string")), (1 + k % 3).cast("int"))
    old = o.filter("o_orderstatus <> 'F'").select(k.alias("job"), alloc(c).alias("allocation"))
    new = o.filter(k % 7 != 0).select(k.alias("job"), alloc(c + (k % 5 == 0).cast("int")).alias("allocation"))
    out = L.allocation_diff(old, new)
    return out.select("job", F.concat_ws(",", "old").alias("old"), F.concat_ws(",", "new").alias("new"))


def _alloc(spark, sf):
    node = F.concat(F.lit("n"), F.col("l_suppkey").cast("string"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job"), F.array_repeat(node, F.col("l_linenumber")).alias("allocation"))


def allocation_counts(spark, sf):
    return L.allocation_counts(_alloc(spark, sf))


def allocation_lists(spark, sf):
    return L.allocation_lists(L.allocation_counts(_alloc(spark, sf))).select("job", F.concat_ws(",", "allocation").alias("allocation"))


def active_nodes(spark, sf):
    most = table(spark, sf, "customer").agg(F.count("*").alias("n")).scalar()
    return L.active_nodes(_alloc(spark, sf), desired=most)


def missing_workers(spark, sf):
    cur = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_orderkey").alias("worker"))
    return L.missing_workers(cur, table(spark, sf, "supplier").filter("s_acctbal > 5000").select(F.col("s_suppkey").alias("node")))


def quota_fill(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_orderkey").agg(F.sum("l_linenumber").alias("amount"))
    rows = rows.withColumn("cap", 500 + F.col("l_suppkey") % 7 * 100)
    return L.quota_fill(rows, ["l_suppkey"], "l_orderkey", "amount", "cap").select("l_suppkey", "l_orderkey", "amount", "given")


def spread_minimum(spark, sf):
    """Each job's minimum handed out over the nodes of its cluster in rank order; nodes that give nothing are left out."""
    n = _ranked_nodes(spark, sf).select("cluster", "node", "rank", (F.col("free")["cpu"] / 2000).cast("bigint").alias("amount"))
    asks = _jobs(spark, sf).select("cluster", "job", (F.col("min_replicas") * 3).alias("cap"))
    return L.serve_from_start(asks, n, ["cluster"], "rank", "amount", "cap").select("job", "node", "given")


def _states(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.floor(F.col("l_orderkey") / 50).alias("candidate"), (F.col("l_partkey") % 40).alias("job"), F.col("l_suppkey").alias("node"), (F.col("l_linenumber") % 3).alias("r")
    )
    return li.groupBy("candidate", "job", "node").agg(F.sum("r").alias("replicas"))


def first_holder(spark, sf):
    out = L.first_holder(_states(spark, sf).withColumn("job_order", F.col("job")))
    return out.select("candidate", "job", "node", "replicas")


def _scores(spark, sf):
    states = _states(spark, sf)
    speed = states.groupBy("candidate", "job").agg(F.sqrt(F.sum("replicas")).alias("speedup")).filter("speedup > 0")
    s = F.col("s_suppkey")
    node_map = F.create_map(F.lit("cpu"), 1000 + s % 7 * 100, F.lit("gpu"), 4 + s % 3)
    nodes = table(spark, sf, "supplier").select(s.alias("node"), F.explode(node_map).alias("resource", "amount"))
    j = F.col("job")
    job_map = F.create_map(F.lit("cpu"), 100 + j * 7, F.lit("gpu"), j % 3)
    jobs = table(spark, sf, "part").select((F.col("p_partkey") % 40).alias("job")).distinct().select("job", F.explode(job_map).alias("resource", "amount"))
    index = table(spark, sf, "supplier").select(s.alias("node"), s.alias("node_index"))
    return states, speed, nodes, jobs, index


def cluster_utility(spark, sf):
    states, speed, nodes, jobs, _ = _scores(spark, sf)
    return L.cluster_utility(states, jobs, nodes, speed).select("candidate", F.round("utility", 9).alias("utility"))


def candidate_objective(spark, sf):
    states, speed, nodes, jobs, index = _scores(spark, sf)
    base = states.filter(F.col("candidate") == F.col("job") % 10).select("job", "node", "replicas")
    out = L.candidate_objective(states, base, jobs, nodes, speed, index)
    return out.select("candidate", F.round("value", 8).alias("value"), "size")


STATES = """
s AS (SELECT l_orderkey // 50 AS candidate, l_partkey % 40 AS job, l_suppkey AS node, CAST(sum(l_linenumber % 3) AS BIGINT) AS replicas FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT candidate, job, sum(replicas) AS r, sqrt(sum(replicas)) AS sp FROM s GROUP BY 1, 2 HAVING sum(replicas) > 0),
n AS (SELECT s_suppkey AS node, 'cpu' AS res, 1000 + s_suppkey % 7 * 100 AS cap FROM supplier UNION ALL SELECT s_suppkey, 'gpu', 4 + s_suppkey % 3 FROM supplier),
a AS (SELECT DISTINCT p_partkey % 40 AS job FROM part),
j AS (SELECT job, 'cpu' AS res, 100 + job * 7 AS ask FROM a UNION ALL SELECT job, 'gpu', job % 3 FROM a)"""


def _front(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("cluster"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("candidate"), F.col("l_partkey").alias("tag"),
        F.floor("l_extendedprice").alias("value"), F.col("l_quantity").cast("bigint").alias("size"), (F.col("l_discount") * 10).alias("utility"),
    )


def pareto(spark, sf):
    return L.pareto_front(_front(spark, sf), ["cluster"]).select("cluster", "candidate", "tag", "value", "size")


def pick_under(spark, sf):
    return L.pick_under(_front(spark, sf), ["cluster"], F.col("cluster") % 30)


def desired_size(spark, sf):
    f = _front(spark, sf).withColumn("current", F.col("cluster") % 30)
    return L.desired_size(f, ["cluster"], "current")


FRONT = """
f AS (SELECT l_suppkey AS cluster, l_orderkey * 10 + l_linenumber AS candidate, l_partkey AS tag, CAST(floor(l_extendedprice) AS BIGINT) AS value,
             CAST(l_quantity AS BIGINT) AS size, l_discount * 10 AS utility FROM lineitem)"""

# --- job records ---


def active_jobs(spark, sf):
    phase = F.when(F.col("o_orderstatus") == "O", "Running").when(F.col("o_orderstatus") == "P", "Pending").when(F.col("o_orderkey") % 2 == 0, "Succeeded")
    return J.active_jobs(table(spark, sf, "orders").select("o_orderkey", phase.alias("phase")))


def _specs(spark, sf):
    o = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        o, F.repeat(F.lit("x"), (o % 70).cast("int")).alias("name"), F.when(o % 5 != 0, o % 6 - 1).alias("min_replicas"), F.when(o % 7 != 0, o % 4).alias("max_replicas")
    )


def spec_rules(spark, sf):
    return J.broken_rules(_specs(spark, sf), ["o_orderkey"], J.spec_rules())


def batch_rules(spark, sf):
    o = F.col("o_orderkey")
    b = table(spark, sf, "orders").select(o, (o % 64).alias("batch"), F.when(o % 3 != 0, o % 50).alias("max_batch"), F.when(o % 5 != 0, o % 40).alias("min_local"), F.when(o % 2 == 0, o % 90).alias("max_local"))
    return J.broken_rules(b, ["o_orderkey"], J.batch_rules())


def spec_changes(spark, sf):
    h = table(spark, sf, "orders").select(F.col("o_custkey").alias("job"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("spec"))
    return J.spec_changes(h, F.unix_date(F.to_date("ts"))).select("job", "seq", "spec", "old_spec")


def job_info(spark, sf):
    o = F.col("o_orderkey")
    params = F.when(o % 4 != 0, F.struct(F.lit(1.0).alias("gamma")))
    jobs = table(spark, sf, "orders").select(
        o.alias("job"), F.when(o % 5 != 0, o % 3).alias("min_replicas"), F.when(o % 6 != 0, o % 9).alias("max_replicas"), F.when(o % 7 != 0, o % 11).alias("max_profiled"),
        params.alias("params"), F.when(o % 8 != 0, 32 + o % 5 * 16).alias("init_batch"), F.when(o % 3 == 0, o % 2 * 96).alias("max_batch"),
        F.when(o % 2 == 0, o % 13 * 4).alias("min_local"), (o % 2 == 0).alias("has_bounds"), F.when(o % 9 != 0, o % 10 != 1).alias("preemptible"),
        F.when(o % 3 == 1, F.struct((o % 17).cast("double").alias("sqr"), (o % 19).cast("double").alias("var"))).alias("grad"),
    )
    out = J.job_info(jobs)
    return out.select("job", "min_replicas", "max_replicas", F.col("preemptible").cast("int").alias("preemptible"), F.col("linear").cast("int").alias("linear"), "sqr", "var")


def _job_pods(spark, sf):
    n, o = F.col("l_linenumber"), F.col("l_orderkey")
    phase = F.when(o % 3 == 0, "Succeeded").when(F.col("l_returnflag") == "A", "Failed").when(F.col("l_returnflag") == "N", "Running").otherwise("Unknown")
    return table(spark, sf, "lineitem").select(
        o.alias("job"), F.concat(n.cast("string"), F.lit("-"), F.col("l_partkey").cast("string")).alias("pod"), phase.alias("phase"),
        F.when(n % 4 == 0, "UnexpectedAdmissionError").when(n % 4 == 1, "OutofCPU").alias("reason"), F.when(F.col("l_linestatus") == "O", F.col("l_shipdate")).alias("deleted"),
        F.array(F.when(n == 3, 143).otherwise(1)).alias("exit_codes"), (o % 2 == 0).alias("preemptible"), (4 + o % 2).alias("replicas"),
        F.when(n == 7, F.array().cast("array<boolean>")).otherwise(F.array(F.col("l_quantity") > 10, F.col("l_quantity") > 5)).alias("ready"),
        F.create_map(F.lit("PodScheduled"), F.when(F.col("l_returnflag") == "A", "True").otherwise("False")).alias("conditions"),
        F.when((n != 6) | (o % 4 == 0), o % 10 + F.when(o % 11 == 0, n).otherwise(0)).alias("grp"), n.alias("rank"),
        F.col("l_suppkey").alias("node"), (F.col("l_suppkey") + F.when(o % 13 == 0, 1).otherwise(0)).alias("want_node"),
    )


def pod_counts(spark, sf):
    return J.pod_counts(_job_pods(spark, sf))


def job_outcome(spark, sf):
    return J.job_outcome(_job_pods(spark, sf))


def group_problems(spark, sf):
    return J.group_problems(_job_pods(spark, sf))


def _completed(spark, sf):
    ship = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("completed"))
    return table(spark, sf, "orders").join(ship, "o_orderkey").select(
        F.col("o_orderkey").alias("job"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("created"), "completed"
    )


def completion_summary(spark, sf):
    return J.completion_summary(_completed(spark, sf))


def job_listing(spark, sf):
    jobs = _completed(spark, sf).withColumn("completed", F.when(F.col("status") == "F", F.col("completed")))
    now = F.to_timestamp(F.lit("2005-01-01 00:01:30"))
    return J.job_listing(jobs, now).select("job", "status", "minutes", "seconds")


def _job_events(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("job"), "ts", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "Starting").otherwise(F.col("event_type")).alias("phase"),
        F.array_repeat(F.concat(F.lit("n"), (k % 3).cast("string")), 1 + k % 2).alias("allocation"),
    )


def restarts(spark, sf):
    out = J.restarts(_job_events(spark, sf), F.unix_date(F.to_date("ts")))
    return out.select("seq", "job", "grp", F.col("restart").cast("int").alias("restart"))


def phase_times(spark, sf):
    return J.phase_times(_job_events(spark, sf), F.unix_date(F.to_date("ts"))).withColumn("seconds", F.round("seconds", 6))


def trial_names(spark, sf):
    name = F.concat_ws("_", F.regexp_replace("o_orderpriority", " ", "_"), (F.col("o_orderkey") % 8).cast("string"), (F.col("o_custkey") % 5).cast("string"), F.col("o_orderkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", C.trial_fields(name).alias("f")).select("o_orderkey", "f.*")


def time_parsing(spark, sf):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+02:00'")
    return table(spark, sf, "events").select("event_id", F.unix_micros(C.parse_time(text)).alias("micros"))


def hint_fields(spark, sf):
    """Hints written as JSON from event columns, with an unknown field, then parsed and renamed."""
    v = F.col("value")
    body = F.to_json(
        F.struct(
            F.col("event_id").alias("initBatchSize"), F.array("event_id", F.col("user_id")).alias("localBszBounds"), F.col("event_type").alias("unknownField"),
            F.when(F.col("event_id") % 2 == 0, F.struct(v.alias("norm"), (v * 2).alias("var"))).alias("gradParams"), F.struct(v.alias("gamma")).alias("perfParams"),
        )
    )
    e = spread(table(spark, sf, "events").select("event_id", "user_id", "event_type", "value"), "event_id")
    h = e.select("event_id", C.rename_hints(C.parse_hints(body)).alias("h"))
    return h.select(
        "event_id", F.col("h.init_batch_size").alias("init_batch_size"), F.col("h.local_bsz_bounds")[1].alias("upper"), F.coalesce("h.max_batch_size", F.lit(-1)).alias("max_batch_size"),
        F.round("h.grad_params.sqr", 6).alias("sqr"), F.round("h.grad_params.var", 6).alias("var"), F.round("h.perf_params.gamma", 6).alias("gamma"),
    )


QUERIES = {
    "quantities": (
        quantities,
        """WITH s AS (SELECT *, ['', 'm', 'k', 'M', 'G', 'T', 'P', 'E', 'Ki', 'Mi', 'Gi', 'Ti', 'Pi', 'Ei'][l_orderkey % 14 + 1] AS suffix,
                  ([1, 0.001, 1e3, 1e6, 1e9, 1e12, 1e15, 1e18, 1024, 1048576, 1073741824, 1099511627776, 1125899906842624, 1152921504606846976]::DOUBLE[])[l_orderkey % 14 + 1] AS factor,
                  CASE WHEN l_orderkey % 14 < 7 AND l_partkey % 2 = 0 THEN 'cpu' ELSE 'memory' END AS name FROM lineitem)
           SELECT l_orderkey, l_partkey, l_linenumber, name, l_linenumber || suffix AS value,
                  CAST(CASE WHEN suffix = 'm' THEN CASE WHEN name = 'cpu' THEN l_linenumber ELSE 1 END ELSE l_linenumber * factor * CASE WHEN name = 'cpu' THEN 1000 ELSE 1 END END AS BIGINT) AS amount FROM s""",
    ),
    "pod_requests": (pod_requests, f"WITH {PODS} SELECT l_orderkey, resource, CAST(sum(amount) AS BIGINT) AS amount FROM r GROUP BY 1, 2 HAVING sum(amount) > 0"),
    "default_requests": (
        default_requests,
        f"""WITH {PODS}, d AS (SELECT l_orderkey, resource, amount FROM r UNION ALL SELECT l_orderkey, 'ephemeral-storage', 3000 FROM lineitem UNION ALL SELECT l_orderkey, 'fpga', 2 FROM lineitem)
            SELECT l_orderkey, resource, CAST(sum(amount) AS BIGINT) AS amount FROM d GROUP BY 1, 2 HAVING sum(amount) > 0""",
    ),
    "node_free": (node_free, f"WITH {PODS}, {CAPACITY} SELECT node, resource, amount FROM f WHERE amount > 0"),
    "node_template": (node_template, f"WITH {PODS}, {CAPACITY} SELECT resource, max(amount) AS amount FROM f WHERE amount > 0 GROUP BY 1"),
    "resource_types": (resource_types, "SELECT DISTINCT p_type AS resource FROM part UNION SELECT 'cpu' UNION SELECT 'pods'"),
    "allowed_nodes": (allowed_nodes, "SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0 OR (s_suppkey % 3 = 1 AND s_suppkey % 7 <> 1)"),
    "bundle_usage": (
        bundle_usage,
        """WITH b AS (SELECT o_custkey % 50 AS n, 'node:' || o_custkey % 50 AS k, 0.5::DOUBLE AS v FROM orders UNION ALL SELECT o_custkey % 50, 'CPU', o_orderkey % 4 FROM orders
                      UNION ALL SELECT o_custkey % 40, 'GPU', o_orderkey % 3 FROM orders UNION ALL SELECT o_custkey % 40, 'node:' || o_custkey % 40, 0.25 FROM orders)
           SELECT CAST(n AS VARCHAR) AS node, k AS resource, round(sum(v), 6) AS amount FROM b GROUP BY 1, 2""",
    ),
    "job_ranks": (job_ranks, f"WITH {NODES} SELECT cluster, job, row_number() OVER (PARTITION BY cluster ORDER BY NOT pinned, lo, created, job) - 1 AS rank FROM j"),
    "node_ranks": (node_ranks, f"WITH {NODES} SELECT cluster, node, rank FROM n"),
    "first_fit": (
        first_fit,
        f"""WITH {NODES}, h AS (SELECT j.cluster, job, greatest(lo, 1) AS need, arg_min(n.node, n.rank) AS node FROM j JOIN n ON j.cluster = n.cluster
                                AND least(n.cpu // j.cpu, n.mem // j.mem) >= greatest(lo, 1) GROUP BY 1, 2, 3)
            SELECT j.cluster, j.job, coalesce(rtrim(repeat(node || ',', need), ','), '') AS allocation FROM j LEFT JOIN h ON j.job = h.job""",
    ),
    "schedulable": (schedulable, f"WITH {NODES} SELECT cluster, job FROM j WHERE EXISTS (SELECT 1 FROM n WHERE n.cluster = j.cluster AND n.cpu >= j.cpu AND n.mem >= j.mem)"),
    "allocation_diff": (
        allocation_diff,
        """WITH l AS (SELECT o_orderkey AS job, CASE WHEN o_orderstatus <> 'F' THEN rtrim(repeat('n' || o_custkey % 20 || ',', 1 + o_orderkey % 3), ',') ELSE '' END AS old,
                      CASE WHEN o_orderkey % 7 <> 0 THEN rtrim(repeat('n' || (o_custkey % 20 + (o_orderkey % 5 = 0)::INT) || ',', 1 + o_orderkey % 3), ',') ELSE '' END AS new FROM orders)
           SELECT job, old, new FROM l WHERE old <> new""",
    ),
    "allocation_counts": (allocation_counts, "SELECT l_orderkey AS job, 'n' || l_suppkey AS node, CAST(sum(l_linenumber) AS BIGINT) AS replicas FROM lineitem GROUP BY 1, 2"),
    "allocation_lists": (
        allocation_lists,
        """WITH c AS (SELECT l_orderkey AS job, 'n' || l_suppkey AS node, sum(l_linenumber) AS r FROM lineitem GROUP BY 1, 2)
           SELECT job, string_agg(rtrim(repeat(node || ',', CAST(r AS BIGINT)), ','), ',' ORDER BY node) AS allocation FROM c GROUP BY 1""",
    ),
    "active_nodes": (
        active_nodes,
        """WITH u AS (SELECT DISTINCT 'n' || l_suppkey AS node FROM lineitem), m AS (SELECT (SELECT count(*) FROM customer) - count(*) AS m FROM u)
           SELECT node FROM u UNION ALL SELECT '~' || unnest(range(m)) FROM m WHERE m > 0""",
    ),
    "missing_workers": (
        missing_workers,
        "SELECT l_suppkey AS node, l_orderkey AS worker FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)",
    ),
    "quota_fill": (
        quota_fill,
        """WITH a AS (SELECT l_suppkey, l_orderkey, sum(l_linenumber) AS amount, 500 + l_suppkey % 7 * 100 AS cap FROM lineitem GROUP BY 1, 2),
           r AS (SELECT *, sum(amount) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS upto FROM a)
           SELECT l_suppkey, l_orderkey, CAST(amount AS BIGINT) AS amount, CAST(greatest(least(amount, cap - (upto - amount)), 0) AS BIGINT) AS given FROM r""",
    ),
    "spread_minimum": (
        spread_minimum,
        f"""WITH {NODES}, r AS (SELECT job, n.node, n.cpu // 2000 AS a, lo * 3 AS cap, sum(n.cpu // 2000) OVER (PARTITION BY job ORDER BY rank) AS upto FROM j JOIN n ON j.cluster = n.cluster)
            SELECT job, node, CAST(least(a, cap - (upto - a)) AS BIGINT) AS given FROM r WHERE a > 0 AND cap - (upto - a) > 0""",
    ),
    "first_holder": (
        first_holder,
        f"""WITH {STATES}, d AS (SELECT *, count_if(replicas > 0) OVER (PARTITION BY candidate, job) AS nodes FROM s),
            h AS (SELECT *, sum((nodes > 1 AND replicas > 0)::INT) OVER (PARTITION BY candidate, node ORDER BY job) AS held FROM d)
            SELECT candidate, job, node, replicas FROM h WHERE held <= 1""",
    ),
    "cluster_utility": (
        cluster_utility,
        f"""WITH {STATES}, t AS (SELECT candidate, res, sum(cap) AS total FROM (SELECT DISTINCT candidate, node FROM s WHERE replicas > 0) JOIN n USING (node) GROUP BY 1, 2),
            u AS (SELECT p.candidate, j.res, sum(sp / r * (r * ask / total)) AS u FROM p JOIN j USING (job) JOIN t ON p.candidate = t.candidate AND j.res = t.res WHERE ask > 0 GROUP BY 1, 2)
            SELECT candidate, round(max(u), 9) AS utility FROM u GROUP BY 1""",
    ),
    "candidate_objective": (
        candidate_objective,
        f"""WITH {STATES}, w AS (SELECT job, max(ask / total) AS share FROM j JOIN (SELECT res, sum(cap) AS total FROM n GROUP BY 1) USING (res) GROUP BY 1),
            g AS (SELECT candidate, job, list((node, replicas) ORDER BY node) AS st FROM s WHERE replicas > 0 GROUP BY 1, 2),
            v AS (SELECT p.candidate, -sum(sp * share * (SELECT count(*) FROM supplier) * CASE WHEN g.st = b.st THEN 1 ELSE 0.9::DOUBLE END) AS value
                  FROM p JOIN w USING (job) JOIN g ON p.candidate = g.candidate AND p.job = g.job LEFT JOIN g b ON b.job = p.job AND b.candidate = p.job % 10 GROUP BY 1),
            z AS (SELECT candidate, max(node) + 1 AS size FROM s WHERE replicas > 0 GROUP BY 1)
            SELECT candidate, round(value, 8) AS value, size FROM v JOIN z USING (candidate)""",
    ),
    "pareto": (
        pareto,
        f"""WITH {FRONT} SELECT cluster, candidate, tag, value, size FROM f x
            WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.cluster = x.cluster AND y.size <= x.size AND y.value <= x.value AND (y.size < x.size OR y.value < x.value))""",
    ),
    "pick_under": (
        pick_under,
        f"""WITH {FRONT} SELECT cluster, candidate, value FROM f WHERE size <= cluster % 30 QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY value, candidate) = 1""",
    ),
    "desired_size": (
        desired_size,
        f"""WITH {FRONT}, k AS (SELECT cluster, utility BETWEEN 0.35::DOUBLE AND 0.65::DOUBLE AS keep FROM f WHERE size <= cluster % 30
                                QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY value, candidate, utility) = 1),
            a AS (SELECT cluster, candidate, utility FROM f WHERE utility >= 0.35::DOUBLE QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY abs(utility - 0.5::DOUBLE), candidate) = 1),
            b AS (SELECT f.cluster, max(f.size) AS size FROM f JOIN a ON f.cluster = a.cluster AND f.candidate >= a.candidate AND abs(f.utility - a.utility) <= 1e-8::DOUBLE + 1e-5::DOUBLE * abs(a.utility) GROUP BY 1),
            c AS (SELECT DISTINCT cluster FROM f)
            SELECT c.cluster, CASE WHEN coalesce(keep, FALSE) THEN c.cluster % 30 ELSE coalesce(b.size, c.cluster % 30) END AS size
            FROM c LEFT JOIN k ON c.cluster = k.cluster LEFT JOIN b ON c.cluster = b.cluster""",
    ),
    "active_jobs": (
        active_jobs,
        "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'Running' ELSE 'Pending' END AS phase FROM orders WHERE o_orderstatus IN ('O', 'P')",
    ),
    "spec_rules": (
        spec_rules,
        """WITH s AS (SELECT o_orderkey, o_orderkey % 70 AS len, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 6 - 1 END AS lo, CASE WHEN o_orderkey % 7 <> 0 THEN o_orderkey % 4 END AS hi FROM orders)
           SELECT o_orderkey, 'max_below_min' AS rule FROM s WHERE hi < coalesce(lo, 0) UNION ALL SELECT o_orderkey, 'max_below_one' FROM s WHERE hi < 1
           UNION ALL SELECT o_orderkey, 'min_negative' FROM s WHERE lo < 0 UNION ALL SELECT o_orderkey, 'name_too_long' FROM s WHERE len > 63""",
    ),
    "batch_rules": (
        batch_rules,
        """SELECT o_orderkey, 'max_below_batch' AS rule FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 50 < o_orderkey % 64
           UNION ALL SELECT o_orderkey, 'lower_above_batch' FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 40 > o_orderkey % 64
           UNION ALL SELECT o_orderkey, 'upper_below_batch' FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 90 < o_orderkey % 64""",
    ),
    "spec_changes": (
        spec_changes,
        """WITH h AS (SELECT o_custkey AS job, o_orderkey AS seq, o_orderpriority AS spec, lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS old_spec FROM orders)
           SELECT job, seq, spec, old_spec FROM h WHERE old_spec <> spec""",
    ),
    "job_info": (
        job_info,
        """WITH o AS (SELECT o_orderkey AS o, CASE WHEN o % 5 <> 0 THEN o % 3 ELSE 0 END AS lo, nullif(CASE WHEN o % 6 <> 0 THEN o % 9 END, 0) AS hi,
                      greatest(2 * CASE WHEN o % 7 <> 0 THEN o % 11 ELSE 0 END, 1) AS prof, o % 9 = 0 OR o % 10 <> 1 AS pre,
                      CASE WHEN o % 8 <> 0 THEN 32 + o % 5 * 16 END AS init, nullif(CASE WHEN o % 3 = 0 THEN o % 2 * 96 END, 0) AS mx, coalesce(nullif(o % 13 * 4, 0), 1) AS ml FROM orders),
           m AS (SELECT *, greatest(least(prof, coalesce(hi, prof)), lo) AS most, o % 4 <> 0 AND init IS NOT NULL AND pre AS modelled FROM o)
           SELECT o AS job, lo AS min_replicas, CASE WHEN modelled AND o % 2 = 0 AND coalesce(mx, init) < ml * most THEN coalesce(mx, init) // ml ELSE most END AS max_replicas,
                  pre::INT AS preemptible, (NOT modelled)::INT AS linear, CASE WHEN o % 3 = 1 THEN o % 17 ELSE 0 END::DOUBLE AS sqr, CASE WHEN o % 3 = 1 THEN o % 19 ELSE 1 END::DOUBLE AS var FROM m""",
    ),
    "pod_counts": (
        pod_counts,
        "SELECT l_orderkey AS job, CAST(count_if(l_linenumber <> 7 AND l_quantity > 10) AS BIGINT) AS ready, CAST(count_if(l_returnflag = 'A') AS BIGINT) AS scheduled FROM lineitem GROUP BY 1",
    ),
    "job_outcome": (
        job_outcome,
        """WITH p AS (SELECT l_orderkey AS job, l_linenumber || '-' || l_partkey AS pod, CASE WHEN l_orderkey % 3 = 0 THEN 'S' WHEN l_returnflag = 'N' THEN 'R' ELSE 'F' END AS ph,
                      l_linenumber % 4 < 2 OR (l_orderkey % 2 = 0 AND (l_linestatus = 'O' OR l_linenumber = 3)) AS mild FROM lineitem),
           g AS (SELECT job, count(*) AS n, bool_and(ph = 'S') AS ok, min(pod) FILTER (ph = 'F' AND NOT mild) AS fatal FROM p GROUP BY 1)
           SELECT job, CASE WHEN ok AND n = 4 + job % 2 THEN 'Succeeded' WHEN fatal IS NOT NULL THEN 'Failed' END AS outcome, CASE WHEN ok AND n = 4 + job % 2 THEN NULL ELSE fatal END AS pod FROM g""",
    ),
    "group_problems": (
        group_problems,
        """WITH g AS (SELECT l_orderkey AS job, bool_or(l_linenumber = 6 AND l_orderkey % 4 <> 0) AS missing, l_orderkey % 13 = 0 AS node,
                      (l_orderkey % 11 = 0 AND min(l_linenumber) FILTER (l_linenumber <> 6 OR l_orderkey % 4 = 0) <> max(l_linenumber) FILTER (l_linenumber <> 6 OR l_orderkey % 4 = 0))
                       OR bool_or(l_linenumber >= 4 + l_orderkey % 2) AS unlike FROM lineitem GROUP BY l_orderkey)
           SELECT job, CASE WHEN missing THEN 'annotations' WHEN node THEN 'node' ELSE 'inconsistent' END AS problem FROM g WHERE missing OR node OR unlike""",
    ),
    "completion_summary": (
        completion_summary,
        """WITH s AS (SELECT l_orderkey, max(l_shipdate) AS done FROM lineitem GROUP BY 1)
           SELECT o_orderstatus AS status, count(*) AS submitted, CAST(sum(epoch(done) - epoch(o_orderdate)) AS BIGINT) AS seconds FROM orders JOIN s ON o_orderkey = l_orderkey GROUP BY 1""",
    ),
    "job_listing": (
        job_listing,
        """WITH s AS (SELECT l_orderkey, max(l_shipdate) AS done FROM lineitem GROUP BY 1),
           t AS (SELECT o_orderkey AS job, o_orderstatus AS status, CAST(epoch(CASE WHEN o_orderstatus = 'F' THEN done ELSE TIMESTAMP '2005-01-01 00:01:30' END) - epoch(o_orderdate) AS BIGINT) AS took
                 FROM orders JOIN s ON o_orderkey = l_orderkey)
           SELECT job, status, CAST(floor(took / 60) AS BIGINT) AS minutes, took % 60 AS seconds FROM t""",
    ),
    "restarts": (
        restarts,
        """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
           h AS (SELECT event_id AS seq, user_id AS job, CAST(sum((event_type = 'signup')::INT) OVER w AS BIGINT) AS grp, lag(k % 6) OVER w AS was, k % 6 AS now FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
           SELECT seq, job, grp, coalesce((was <> now)::INT, 0) AS restart FROM h""",
    ),
    "phase_times": (
        phase_times,
        """WITH h AS (SELECT user_id AS job, CASE WHEN event_type = 'signup' THEN 'Starting' ELSE event_type END AS phase, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
           SELECT job, phase, count(*) AS times, round(coalesce(sum(epoch_us(nxt) - epoch_us(ts)), 0) / 1e6::DOUBLE, 6) AS seconds FROM h GROUP BY 1, 2""",
    ),
    "trial_names": (
        trial_names,
        "SELECT o_orderkey, replace(o_orderpriority, ' ', '_') AS base, CAST(o_orderkey % 8 AS INT) AS replicas, CAST(o_custkey % 5 AS INT) AS restarts, CAST(o_orderkey AS VARCHAR) AS id FROM orders",
    ),
    "time_parsing": (time_parsing, "SELECT event_id, epoch_us(ts) - 7200000000 AS micros FROM events"),
    "hint_fields": (
        hint_fields,
        """SELECT event_id, event_id AS init_batch_size, user_id AS upper, -1 AS max_batch_size, round(CASE WHEN event_id % 2 = 0 THEN value ELSE 1 END, 6) AS sqr,
                  round(CASE WHEN event_id % 2 = 0 THEN value * 2 ELSE 1 END, 6) AS var, round(value, 6) AS gamma FROM events""",
    ),
}
