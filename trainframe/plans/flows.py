"""Streams, files, snapshots and user functions run over the given tables."""

import pandas as pd
from pyspark.sql import functions as F

from trainframe.functions import perf
from trainframe.operators import perfmodel as M
from trainframe.operators import profiles as P
from trainframe.operators import resources as R
from trainframe.operators import sampling as S
from trainframe.plans.fleet import CAPACITY, PODS, _nodes, _pods
from trainframe.plans.ranking import BOUGHT, _bought, _pairs, draws_sql
from trainframe.plans.sampling import PADDED, _order
from trainframe.plans.telemetry import MODEL, REPORT, STEPS, _jobs, _progress, _steps
from trainframe.sources import readers as D
from trainframe.sources import sinks as K
from trainframe.session import scratch, table, written
from trainframe.streaming import jobs as T


def _event_stream(spark, sf):
    """Events as a stream of three micro-batches, each with events of all times, so that most are late."""
    e = table(spark, sf, "events")
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)
    path = scratch(spark, "events")
    e.repartition(3 * files, "event_id").write.parquet(path)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(path)


def _finish(query):
    query.awaitTermination()


def _planted(spark, sf):
    """Steps whose times come from a known model of each job, with up to 4 % of noise by event, and that model."""
    j, k = F.col("user_id"), F.get_json_object("props", "$.k").cast("int")
    model = F.struct(
        (0.04 + j % 7 * 0.02).alias("alpha_c"), (0.002 * (1 + j % 5)).alias("beta_c"), (0.05 + j % 3 * 0.03).alias("alpha_n"), (0.006 * (1 + j % 4)).alias("beta_n"),
        (0.02 + j % 6 * 0.005).alias("alpha_r"), (0.002 * (1 + j % 3)).alias("beta_r"), (1 + j % 9 * 0.25).alias("gamma"),
    )
    rows = table(spark, sf, "events").select(
        j.alias("job_id"), (1 + k % 2).alias("nodes"), (1 + k % 2 + k % 3).alias("replicas"), (8 * (1 + k % 4)).alias("local_bsz"), (F.col("event_type") == "view").alias("is_accum"),
        (1 + (F.col("event_id") * 7919 % 11 - 5) * 0.008).alias("noise"), model.alias("params"),
    )
    p = F.col("params")
    compute = perf.accum_time(p, F.col("local_bsz"))
    both = F.exp(perf.log_optim_time(p, compute, perf.network_time(p, F.col("nodes"), F.col("replicas"))))
    steps = rows.withColumn("step_time", F.when(F.col("is_accum"), compute).otherwise(both) * F.col("noise")).withColumn("sync_time", (both - compute) * F.col("noise"))
    return steps, rows.select("job_id", "params").dropDuplicates(["job_id"])


def fit_perf(spark, sf):
    """Per job: what its rows leave open, the loss of the planted model with that held, and whether the fit settled as low."""
    steps, models = _planted(spark, sf)
    means = written(P.profile_means(P.step_profile(steps)).filter("valid"), "means")
    held = M.held(means)
    p, tiny = F.col("params"), F.lit(perf.TINY)
    known = held.join(models, "job_id").withColumn("ar", F.when(F.col("no_within"), tiny).otherwise(p["alpha_r"])).withColumn("br", F.when(F.col("no_within") | F.col("no_growth"), tiny).otherwise(p["beta_r"]))
    known = known.withColumn("an", F.when(F.col("no_across"), F.col("ar") * M.ACROSS_NODES).otherwise(p["alpha_n"]))
    known = known.withColumn("bn", F.when(F.col("no_across"), F.col("br") * M.ACROSS_NODES).when(F.col("no_growth"), tiny).otherwise(p["beta_n"]))
    known = known.select("job_id", F.struct(p["alpha_c"].alias("alpha_c"), p["beta_c"].alias("beta_c"), F.col("an").alias("alpha_n"), F.col("bn").alias("beta_n"), F.col("ar").alias("alpha_r"), F.col("br").alias("beta_r"), p["gamma"].alias("gamma")).alias("params"))
    truth = M.fit_error(means, known).withColumnRenamed("loss", "truth_loss")
    out = M.fit_jobs(means).join(truth, "job_id").join(held, "job_id")
    flags = [F.col(c).cast("int").alias(c) for c in ("one_size", "no_across", "no_within", "no_growth", "settled")]
    return out.select("job_id", "configurations", *flags, (F.col("loss") <= 1.1 * F.col("truth_loss")).cast("int").alias("as_good"), F.round("truth_loss", 6).alias("truth_loss"))


def fit_error(spark, sf):
    means = P.profile_means(P.step_profile(_steps(spark, sf)))
    return M.fit_error(means, _jobs(spark, sf)).select("job_id", F.round("loss", 8).alias("loss"))


def reduce_custom(spark, sf):
    e = table(spark, sf, "events").select(F.floor(F.col("event_id") / 1500).alias("step"), "event_id", F.substring("event_type", 1, 1).alias("v"))
    return M.reduce_custom(e, ["step"], "event_id", "v", lambda a, b: a + b).select("step", F.md5("v").alias("digest"))


def collate(spark, sf):
    rows = S.batches(S.padded_shards(_order(spark, sf), 7, index=20), 100, 7)

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("slot")["o_orderkey"]
        return pd.DataFrame({"rank": pdf["rank"].head(1), "batch_id": pdf["batch_id"].head(1), "first": [p.iloc[0]], "last": [p.iloc[-1]], "n_rows": [len(p)]})

    return M.collate(rows.select("rank", "batch_id", "slot", "o_orderkey"), ["rank", "batch_id"], ends, "rank int, batch_id bigint, first bigint, last bigint, n_rows bigint")


def scalar_rows(spark, sf):
    p = _progress(spark, sf).withColumn("lr_factor", F.sqrt("gain")).withColumn("accum_scale", F.lit(1.0)).withColumn("accum_count", F.col("step") % 2)
    rows = K.scalar_rows(p, K.TRAINING_TAGS, F.when(F.col("step") % 3 == 0, "").when(F.col("step") % 3 == 1, "a").otherwise("b/"))
    path = scratch(spark, "scalars")
    K.write_scalars(rows, path)
    return spark.read.parquet(path).select("run", "tag", "step", F.round("value", 5).alias("value"))


def loader_scalars(spark, sf):
    """Batch size, local batch size and accumulation steps of a loader as scalar rows, under a prefix without its slash."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("step"), ((1 + k % 4) * 32 * (1 + k % 3)).alias("total_batch"), (32 * (1 + k % 3)).alias("local_bsz"), (k % 4).alias("accum_steps")
    )
    path = scratch(spark, "scalars")
    K.write_scalars(K.scalar_rows(rows, K.LOADER_TAGS, "loader"), path)
    return spark.read.parquet(path).select("run", "tag", "step", "value")


def stream_resume(spark, sf):
    """A stream stopped after some batches and started again from its checkpoint, with files added in between."""
    e = table(spark, sf, "events")
    feed, path, cp = scratch(spark, "feed"), scratch(spark, "resumed"), scratch(spark, "cp")
    parts = [e.filter(F.pmod("event_id", F.lit(4)) == i).repartition(2, "event_id") for i in range(4)]
    source = lambda: spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(feed).select("event_id", "user_id", "event_type")
    for part in parts[:2]:
        part.write.mode("append").parquet(feed)
    first = T.run_append(source(), path, cp, every="0 seconds")
    first.processAllAvailable()
    first.stop()
    for part in parts[2:]:
        part.write.mode("append").parquet(feed)
    _finish(T.run_append(source(), path, cp))
    seen = spark.read.parquet(path)
    return seen.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("distinct_ids"))


def ratings_file(spark, sf):
    """Interactions written as a tab-separated file with further columns and read back."""
    path = scratch(spark, "ratings")
    _bought(spark, sf).select("user", "item", F.lit(1), "o_orderdate").write.csv(path, sep="\t", header=False)
    return D.ratings(spark, path).groupBy("user", "item").agg(F.count("*").alias("n"))


def candidate_file(spark, sf):
    """Ranking candidates written as lines of pairs and negatives and read back."""
    from trainframe.operators import interactions as I

    pos = _pairs(spark, sf)
    truth = written(I.hold_out_last(_bought(spark, sf), "o_orderdate"), "truth")
    negs = I.negatives(truth, pos, I.cardinality(pos).select("item_num").scalar(), 9, seed=9)
    lines = negs.groupBy("user", "item").agg(F.sort_array(F.collect_list(F.struct("ng_no", "neg")))["neg"].alias("n"))
    line = F.concat(F.lit("("), F.col("user").cast("string"), F.lit(","), F.col("item").cast("string"), F.lit(")\t"), F.array_join(F.col("n").cast("array<string>"), "\t"))
    path = scratch(spark, "candidates")
    lines.select(line).write.text(path)
    return D.ranking_candidates(spark, path)


def corpus_lines(spark, sf):
    """Documents written as text and read back line by line."""
    path = scratch(spark, "corpus")
    table(spark, sf, "documents").select("lang", F.replace("text", F.lit("\r"), F.lit("\n")).alias("text")).write.partitionBy("lang").text(path)
    lines = D.corpus_lines(spark, f"{path}/*/*.txt")
    lang = F.regexp_extract("path", "lang=([a-z]+)", 1)
    return lines.filter("text <> ''").groupBy(lang.alias("lang"), "text").agg(F.count("*").alias("n")).select("lang", F.md5("text").alias("digest"), "n")


def job_file(spark, sf):
    """Orders written as nested job JSON and read back flat."""
    o = F.col("o_orderkey")
    doc = table(spark, sf, "orders").select(
        F.struct(o.cast("string").alias("name"), F.lit("train").alias("namespace"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("creationTimestamp"), F.lit(1).alias("other")).alias("metadata"),
        F.struct((o % 3).alias("minReplicas"), F.when(o % 2 == 0, o % 5).alias("maxReplicas")).alias("spec"),
        F.struct(F.col("o_orderstatus").alias("phase"), F.array(F.lit("n1"), F.lit("n1")).alias("allocation")).alias("status"),
    )
    path = scratch(spark, "jobs")
    doc.write.json(path)
    return D.jobs(spark, path).select(
        "job", F.date_format("created", "yyyy-MM-dd").alias("created"), "min_replicas", F.coalesce("max_replicas", F.lit(-1)).alias("max_replicas"), "phase", F.size("allocation").alias("replicas")
    )


# Records in a compressed file, which one task reads.
FILE_RECORDS = 1 << 20


def node_free_from_files(spark, sf):
    """Pods and nodes written as nested JSON, read back flat, and the capacity that is left."""
    box = lambda c: F.struct(c["name"].alias("name"), F.struct(c["requests"].alias("requests"), c["limits"].alias("limits")).alias("resources"))
    pod = _pods(spark, sf).select(
        F.struct(F.col("l_orderkey").cast("string").alias("name"), F.create_map(F.lit("job"), F.lit("j")).alias("labels")).alias("metadata"),
        F.struct(F.col("node").cast("string").alias("nodeName"), F.transform("containers", box).alias("containers")).alias("spec"), F.struct("phase").alias("status"),
    )
    node = _nodes(spark, sf).select(F.struct(F.col("node").cast("string").alias("name")).alias("metadata"), F.struct("allocatable").alias("status"))
    pod_path, node_path = scratch(spark, "pods"), scratch(spark, "nodes")
    for df, path in ((pod, pod_path), (node, node_path)):
        df.write.option("maxRecordsPerFile", FILE_RECORDS).json(path, compression="gzip")
    return R.node_free(D.nodes(spark, node_path), D.pods(spark, pod_path)).withColumn("node", F.col("node").cast("bigint"))


def snapshot_latest(spark, sf):
    """Three versions of a table of totals; the newest one is read back."""
    store = K.Snapshots(spark, scratch(spark, "states"))
    store.register("totals")
    o = table(spark, sf, "orders")
    for version in (0, 2, 10):
        store.save("totals", o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.lit(version).alias("version")), version)
    return store.latest("totals")


def stream_profile(spark, sf):
    # The batch plan's step columns apply to the stream as they are.
    k = F.get_json_object("props", "$.k").cast("int")
    time = F.col("value") + 1
    steps = _event_stream(spark, sf).select(
        F.col("user_id").alias("job_id"), (1 + k % 2).alias("nodes"), (1 + k % 2 + k % 3).alias("replicas"), (8 * (1 + k % 4)).alias("local_bsz"),
        (F.col("event_type") == "view").alias("is_accum"), time.alias("step_time"), (time * F.when(F.col("event_type") == "error", 0.5).otherwise(0.25)).alias("sync_time"),
    )
    path = scratch(spark, "profile")
    _finish(T.run_profile(steps, path, scratch(spark, "cp"), every=None))
    return T.current_profile(spark, path).select(*P.CONFIG, *[F.round(c, 6).alias(c) for c in ("accum_time", "optim_time", "sync_time")], "accum_count", "optim_count")


def stream_totals(spark, sf):
    """Every update is delivered twice, most of them days late, and counted once."""
    e = _event_stream(spark, sf).select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("update_id"), F.col("user_id").alias("run"), F.col("event_type").alias("key"), F.round(F.col("value") * 100).cast("bigint").alias("delta")
    )
    path = scratch(spark, "totals")
    _finish(T.run_totals(e.union(e), path, scratch(spark, "cp")))
    return T.current_totals(spark, path)


def stream_hints(spark, sf):
    """Events written as hint JSON files, read as a stream, newest hints kept per job."""
    e = table(spark, sf, "events")
    body = F.struct(F.col("value").alias("norm"), (F.col("value") * 2).alias("var"))
    feed = scratch(spark, "feed")
    e.select(F.col("user_id").cast("string").alias("job"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_id").alias("initBatchSize"), body.alias("gradParams"), F.lit(1).alias("other")).repartition(4, "seq").write.json(feed)
    store = K.Snapshots(spark, scratch(spark, "states"))
    _finish(T.run_latest_hints(D.hint_feed(spark, feed), store, scratch(spark, "cp")))
    out = store.latest("hints")
    return out.select("job", "seq", F.col("hints.initBatchSize").alias("init_batch"), F.round("hints.gradParams.var", 6).alias("var"))


def stream_phases(spark, sf):
    e = _event_stream(spark, sf).select(
        F.col("user_id").alias("job"), F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", "Starting").otherwise(F.col("event_type")).alias("phase"),
    )
    path = scratch(spark, "phases")
    _finish(T.run_phases(e, path, K.Snapshots(spark, scratch(spark, "states"), keep=2), scratch(spark, "cp")))
    return T.current_phases(spark, path).select("job", "phase", "from_ts", "to_ts")


def stream_new_jobs(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    e = _event_stream(spark, sf).select("event_id", F.when(F.col("event_type") == "signup", "ADDED").otherwise("MODIFIED").alias("type"), F.when(k % 3 == 0, F.lit(None)).otherwise(k % 3 == 1).alias("preemptible"))
    path = scratch(spark, "added")
    _finish(T.run_append(T.new_jobs(e), path, scratch(spark, "cp")))
    return spark.read.parquet(path).select("event_id")


LAST = "l AS (SELECT u, arg_max(i, (d, i)) AS i FROM b GROUP BY u)"

QUERIES = {
    "fit_perf": (
        fit_perf,
        """WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k, 1 + (event_id * 7919 % 11 - 5) * 0.008::DOUBLE AS noise FROM events),
        t AS (SELECT user_id AS job_id, 1 + k % 2 AS n, 1 + k % 2 + k % 3 AS r, 8 * (1 + k % 4) AS b, event_type = 'view' AS acc, noise, greatest(r - 2, 1e-8::DOUBLE) AS x,
                     0.04::DOUBLE + user_id % 7 * 0.02::DOUBLE + 0.002::DOUBLE * (1 + user_id % 5) * b AS ta, 0.05::DOUBLE + user_id % 3 * 0.03::DOUBLE AS an,
                     0.006::DOUBLE * (1 + user_id % 4) AS bn, 0.02::DOUBLE + user_id % 6 * 0.005::DOUBLE AS ar, 0.002::DOUBLE * (1 + user_id % 3) AS br, 1 + user_id % 9 * 0.25::DOUBLE AS g,
                     CASE WHEN n > 1 THEN an + bn * x WHEN r > 1 THEN ar + br * x ELSE 1e-8::DOUBLE * (1 + x) END AS tn, pow(pow(ta, g) + pow(tn, g), 1 / g) AS tt FROM e),
        c AS (SELECT job_id, n, r, b, any_value(ta) AS ta, any_value(an) AS an, any_value(bn) AS bn, any_value(ar) AS ar, any_value(br) AS br, any_value(g) AS g, any_value(x) AS x,
                     avg(noise * CASE WHEN acc THEN ta ELSE tt - (tt - ta) END) AS am, avg(noise * tt) FILTER (NOT acc) AS om FROM t GROUP BY 1, 2, 3, 4 HAVING count_if(NOT acc) > 0),
        h AS (SELECT job_id, count(*) AS configurations, (count(DISTINCT b) = 1)::INT AS one_size, (max(n) = 1)::INT AS no_across, (count_if(n = 1 AND r > 1) = 0)::INT AS no_within,
                     (max(r) <= 2)::INT AS no_growth, any_value(g) AS gamma, CASE WHEN no_within = 1 THEN 1e-8::DOUBLE ELSE any_value(ar) END AS har,
                     CASE WHEN no_within = 1 OR no_growth = 1 THEN 1e-8::DOUBLE ELSE any_value(br) END AS hbr, CASE WHEN no_across = 1 THEN 1.1::DOUBLE * har ELSE any_value(an) END AS han,
                     CASE WHEN no_across = 1 THEN 1.1::DOUBLE * hbr WHEN no_growth = 1 THEN 1e-8::DOUBLE ELSE any_value(bn) END AS hbn FROM c GROUP BY 1),
        w AS (SELECT c.*, h.*, CASE WHEN n > 1 THEN han + hbn * x WHEN r > 1 THEN har + hbr * x ELSE 1e-8::DOUBLE * (1 + x) END AS net FROM c JOIN h USING (job_id))
        SELECT job_id, configurations, one_size, no_across, no_within, no_growth, 1 AS settled, 1 AS as_good,
               round(sqrt(avg(pow(ln(ta) - ln(am), 2))) + sqrt(avg(pow(ln(pow(ta, g) + pow(net, g)) / g - ln(om), 2))) + any_value(0.001::DOUBLE * pow(g - 1, 2) + 0.01::DOUBLE * (pow(hbn / han, 2) + pow(hbr / har, 2))), 6) AS truth_loss
        FROM w GROUP BY ALL""",
    ),
    "fit_error": (
        fit_error,
        f"""WITH {STEPS}, {MODEL}, w AS (SELECT p.*, alpha_c, beta_c, alpha_n, beta_n, alpha_r, beta_r, gamma, (accum_time + optim_time - sync_time) / (accum_count + optim_count) AS am, optim_time / optim_count AS om,
                alpha_c + beta_c * local_bsz AS ta, greatest(replicas - 2, 1e-8::DOUBLE) AS x FROM p JOIN j USING (job_id) WHERE optim_count > 0),
            v AS (SELECT *, CASE WHEN nodes > 1 THEN alpha_n + beta_n * x WHEN replicas > 1 THEN alpha_r + beta_r * x ELSE 1e-8::DOUBLE * (1 + x) END AS tn FROM w)
            SELECT job_id, round(sqrt(avg(pow(ln(ta) - ln(am), 2))) + sqrt(avg(pow(ln(pow(ta, gamma) + pow(tn, gamma)) / gamma - ln(om), 2)))
                   + any_value(0.001::DOUBLE * pow(gamma - 1, 2) + 0.01::DOUBLE * (pow(beta_n / alpha_n, 2) + pow(beta_r / alpha_r, 2))), 8) AS loss FROM v GROUP BY 1""",
    ),
    "reduce_custom": (reduce_custom, "SELECT event_id // 1500 AS step, md5(string_agg(substr(event_type, 1, 1), '' ORDER BY event_id)) AS digest FROM events GROUP BY 1"),
    "collate": (
        collate,
        f"{PADDED} SELECT rank, k // 15 AS batch_id, arg_min(o_orderkey, k) AS first, arg_max(o_orderkey, k) AS last, count(*) AS n_rows FROM s GROUP BY 1, 2",
    ),
    "scalar_rows": (
        scalar_rows,
        f"""{REPORT}, p AS (SELECT *, CASE step % 3 WHEN 0 THEN '' WHEN 1 THEN 'a/' ELSE 'b/' END AS px FROM o)
            SELECT run, px || t AS tag, step, round(v, 5) AS value FROM p, LATERAL (VALUES ('Gradient_Norm_Sqr', sqr), ('Gradient_Variance', var), ('Gain', gain), ('Learning_Rate_Factor', sqrt(gain)),
                   ('Accum_Scale', 1.0::DOUBLE), ('Accum_Count', (step % 2)::DOUBLE), ('Progress', progress)) x(t, v) WHERE t <> 'Accum_Count' OR v > 0""",
    ),
    "loader_scalars": (
        loader_scalars,
        """WITH e AS (SELECT user_id AS run, event_id AS step, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
           SELECT run, 'loader/' || t AS tag, step, v::DOUBLE AS value FROM e, LATERAL (VALUES ('Total_Batch_Size', (1 + k % 4) * 32 * (1 + k % 3)), ('Local_Batch_Size', 32 * (1 + k % 3)), ('Accumulation_Steps', k % 4)) x(t, v)""",
    ),
    "ratings_file": (ratings_file, f"WITH {BOUGHT} SELECT u AS user, i AS item, count(*) AS n FROM b GROUP BY 1, 2"),
    "candidate_file": (
        candidate_file,
        f"WITH {BOUGHT}, {LAST}, {draws_sql('l', 9, 9)} SELECT u AS user, 0 AS position, i AS item FROM l UNION ALL SELECT u, k, neg FROM q",
    ),
    "corpus_lines": (
        corpus_lines,
        """WITH l AS (SELECT lang, trim(unnest(string_split(replace(text, chr(13), chr(10)), chr(10))), ' ' || chr(9)) AS t FROM documents)
           SELECT lang, md5(t) AS digest, count(*) AS n FROM l WHERE t <> '' GROUP BY lang, t""",
    ),
    "job_file": (
        job_file,
        """SELECT 'train/' || o_orderkey AS job, strftime(o_orderdate, '%Y-%m-%d') AS created, o_orderkey % 3 AS min_replicas,
                  CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 5 ELSE -1 END AS max_replicas, o_orderstatus AS phase, 2 AS replicas FROM orders""",
    ),
    "node_free_from_files": (node_free_from_files, f"WITH {PODS}, {CAPACITY} SELECT node, resource, amount FROM f WHERE amount > 0"),
    "snapshot_latest": (snapshot_latest, "SELECT o_custkey, count(*) AS n, 10 AS version FROM orders GROUP BY 1"),
    "stream_profile": (
        stream_profile,
        f"""WITH {STEPS} SELECT job_id, nodes, replicas, local_bsz, round(accum_time, 6) AS accum_time, round(optim_time, 6) AS optim_time, round(sync_time, 6) AS sync_time,
            CAST(accum_count AS BIGINT) AS accum_count, CAST(optim_count AS BIGINT) AS optim_count FROM p""",
    ),
    "stream_totals": (stream_totals, "SELECT user_id AS run, event_type AS key, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2"),
    "stream_hints": (
        stream_hints,
        """SELECT CAST(user_id AS VARCHAR) AS job, event_id AS seq, event_id AS init_batch, round(value * 2, 6) AS var FROM events
           QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""",
    ),
    "stream_phases": (
        stream_phases,
        """WITH h AS (SELECT user_id AS job, CASE WHEN event_type = 'signup' THEN 'Starting' ELSE event_type END AS phase, epoch_us(ts) AS from_ts,
                      lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS to_ts FROM events)
           SELECT job, phase, from_ts, to_ts FROM h WHERE to_ts IS NOT NULL""",
    ),
    "stream_resume": (stream_resume, "SELECT user_id, event_type, count(*) AS n, count(DISTINCT event_id) AS distinct_ids FROM events GROUP BY 1, 2"),
    "stream_new_jobs": (
        stream_new_jobs,
        "SELECT event_id FROM events WHERE event_type = 'signup' AND CAST(json_extract_string(props, '$.k') AS INT) % 3 <> 2",
    ),
}
