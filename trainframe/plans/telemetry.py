"""Step profiles, goodput search and gradient noise over ``events``, ``customer``, ``orders`` and ``embeddings``."""

from pyspark.sql import functions as F

from trainframe.functions import perf, rates
from trainframe.operators import goodput as G
from trainframe.operators import noise as Z
from trainframe.operators import profiles as P
from trainframe.session import table


def _steps(spark, sf):
    """Steps: a user is a job; 'view' rows accumulate gradients; times come from the event value."""
    time, k = F.col("value") + 1, F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"),
        (1 + k % 2).alias("nodes"),
        (1 + k % 2 + k % 3).alias("replicas"),
        (8 * (1 + k % 4)).alias("local_bsz"),
        (F.col("event_type") == "view").alias("is_accum"),
        time.alias("step_time"),
        (time * F.when(F.col("event_type") == "error", 0.5).otherwise(0.25)).alias("sync_time"),
    )


STEPS = """
k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
s AS (SELECT user_id AS job_id, 1 + k % 2 AS nodes, 1 + k % 2 + k % 3 AS replicas, 8 * (1 + k % 4) AS local_bsz, event_type = 'view' AS is_accum,
             value + 1 AS step_time, (value + 1) * CASE WHEN event_type = 'error' THEN 0.5 ELSE 0.25 END AS sync_time FROM k),
p AS (SELECT job_id, nodes, replicas, local_bsz, sum(CASE WHEN is_accum THEN step_time ELSE 0 END) AS accum_time, count_if(is_accum) AS accum_count,
             sum(CASE WHEN is_accum THEN 0 ELSE step_time END) AS optim_time, sum(CASE WHEN is_accum THEN 0 ELSE sync_time END) AS sync_time,
             count_if(NOT is_accum) AS optim_count FROM s GROUP BY 1, 2, 3, 4)"""


def step_profile(spark, sf):
    return P.step_profile(_steps(spark, sf)).select(
        *P.CONFIG, *[F.round(c, 6).alias(c) for c in ("accum_time", "optim_time", "sync_time")], "accum_count", "optim_count"
    )


def profile_means(spark, sf):
    return P.profile_means(P.step_profile(_steps(spark, sf))).select(
        *P.CONFIG, F.round("accum_mean", 8).alias("accum_mean"), F.round("optim_mean", 8).alias("optim_mean"), F.col("valid").cast("int").alias("valid")
    )


def max_profiled(spark, sf):
    return P.max_profiled(P.usable(P.step_profile(_steps(spark, sf))))


def gradient_params(spark, sf):
    r = table(spark, sf, "events").select(
        F.col("user_id").alias("job_id"), F.col("event_type").alias("model"), F.col("event_id").alias("step"), F.col("value").alias("sqr"), (F.col("value") * 2).alias("var")
    )
    return P.gradient_params(r, ["job_id"]).select("job_id", F.round("sqr", 6).alias("sqr"), F.round("var", 6).alias("var"))


def step_split(spark, sf):
    return P.step_split(_steps(spark, sf)).select("job_id", F.round("compute", 6).alias("compute"), F.round("sync", 6).alias("sync"))


def _jobs(spark, sf):
    """One model per customer, its parameters a formula of key and balance."""
    c = F.col("c_custkey")
    params = F.struct(
        (0.05 + c % 7 * 0.01 + F.col("c_acctbal") * 1e-7).alias("alpha_c"), (0.001 * (1 + c % 5)).alias("beta_c"), (0.02 + c % 3 * 0.01).alias("alpha_n"),
        (0.002 * (1 + c % 4)).alias("beta_n"), (0.005 * (1 + c % 6)).alias("alpha_r"), (0.0005 * (1 + c % 8)).alias("beta_r"), (1 + c % 9 * 0.25).alias("gamma"),
    )
    grad = F.struct((0.001 * (1 + c % 11)).alias("sqr"), (0.0005 * (1 + c % 13)).alias("var"))
    return table(spark, sf, "customer").select(
        c.alias("job_id"), params.alias("params"), grad.alias("grad"), (64 + c % 4 * 32).alias("init_batch"), (1024 + c % 3 * 512).alias("max_batch"),
        (16 + c % 2 * 8).alias("min_local"), F.when(c % 5 == 0, F.lit(None)).otherwise(256 + c % 3 * 64).cast("bigint").alias("max_local"), (c % 2 == 1).alias("accumulation"),
    )


def _asked(spark, sf):
    r = 1 + F.col("o_orderkey") % 8
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), F.least(1 + F.col("o_orderkey") % 3, r).alias("nodes"), r.alias("replicas")).distinct()


MODEL = """
j AS (SELECT c_custkey AS job_id, 0.05::DOUBLE + c_custkey % 7 * 0.01::DOUBLE + c_acctbal * 1e-7::DOUBLE AS alpha_c, 0.001::DOUBLE * (1 + c_custkey % 5) AS beta_c,
             0.02::DOUBLE + c_custkey % 3 * 0.01::DOUBLE AS alpha_n, 0.002::DOUBLE * (1 + c_custkey % 4) AS beta_n, 0.005::DOUBLE * (1 + c_custkey % 6) AS alpha_r,
             0.0005::DOUBLE * (1 + c_custkey % 8) AS beta_r, 1 + c_custkey % 9 * 0.25::DOUBLE AS gamma, 0.001::DOUBLE * (1 + c_custkey % 11) AS sqr,
             0.0005::DOUBLE * (1 + c_custkey % 13) AS var, 64 + c_custkey % 4 * 32 AS init, 1024 + c_custkey % 3 * 512 AS top, 16 + c_custkey % 2 * 8 AS lo,
             CASE WHEN c_custkey % 5 = 0 THEN 1024 + c_custkey % 3 * 512 ELSE 256 + c_custkey % 3 * 64 END AS hi, c_custkey % 2 = 1 AS acc FROM customer)"""

ASKED = """
q AS (SELECT DISTINCT o_custkey AS job_id, least(1 + o_orderkey % 3, 1 + o_orderkey % 8) AS n, 1 + o_orderkey % 8 AS r FROM orders)"""


def goodput_sql(rows: str, out: str) -> str:
    """CTEs evaluating rows (job columns, n, r, b, a) into thr, eff and good."""
    return f"""
{out}_t AS (SELECT *, alpha_c + beta_c * b AS ta, CASE WHEN n > 1 THEN alpha_n + beta_n * greatest(r - 2, 1e-8::DOUBLE) WHEN r > 1 THEN alpha_r + beta_r * greatest(r - 2, 1e-8::DOUBLE)
                   ELSE 1e-8::DOUBLE + 1e-8::DOUBLE * greatest(r - 2, 1e-8::DOUBLE) END AS tn, r * b * (a + 1) AS batch FROM {rows}),
{out} AS (SELECT *, batch / (a * ta + exp(ln(pow(ta, gamma) + pow(tn, gamma)) / gamma)) AS thr,
                 CASE WHEN var / (batch / init) + sqr > 0 THEN (var + sqr) / (var / (batch / init) + sqr) ELSE 1 END / (batch / init) AS eff, thr * eff AS good FROM {out}_t)"""


def search_sql(asked: str, out: str) -> str:
    """CTEs giving the best grid row per (job_id, n, r) of ``asked``."""
    return f"""
{out}_g AS (SELECT j.*, n, r, i, greatest(init, lo * r) AS first, CASE WHEN i = 0 THEN first WHEN i = 49 THEN top ELSE first * pow(top / first, i / 49.0::DOUBLE) END / r AS loc
          FROM {asked} JOIN j USING (job_id), range(50) g(i)),
{out}_a AS (SELECT *, CASE WHEN NOT acc THEN 0 ELSE CAST(greatest(ceil(loc / hi - 1e-8::DOUBLE) - 1, CASE WHEN r = 1 AND loc > init + 1e-8::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) END AS a FROM {out}_g),
{out}_b AS (SELECT *, least(hi, greatest(lo, CASE WHEN acc THEN CAST(ceil(loc / (a + 1) - 1e-8::DOUBLE) AS BIGINT) WHEN r = 1 THEN init ELSE CAST(ceil(loc - 1e-8::DOUBLE) AS BIGINT) END)) AS b FROM {out}_a),
{goodput_sql(out + '_b', out + '_e')},
{out} AS (SELECT * FROM {out}_e QUALIFY row_number() OVER (PARTITION BY job_id, n, r ORDER BY good DESC, i) = 1)"""


def goodput_grid(spark, sf):
    found = G.search(_asked(spark, sf).join(_jobs(spark, sf), "job_id"))
    return found.select("job_id", "nodes", "replicas", "local_bsz", "accum_steps", F.round("goodput", 4).alias("goodput"))


def speedup_table(spark, sf):
    idle = _jobs(spark, sf).select("job_id", F.lit(0).cast("bigint").alias("nodes"), F.lit(0).cast("bigint").alias("replicas"))
    return G.speedups(_asked(spark, sf).unionByName(idle), _jobs(spark, sf)).withColumn("speedup", F.round("speedup", 6))


def config_grid(spark, sf):
    g = G.evaluate(G.config_grid(_jobs(spark, sf), [1, 2, 4], [1, 2, 4, 8], [8, 16, 24], [0, 2]))
    cols = [F.round(c, 4).alias(c) for c in ("throughput", "goodput")]
    return g.select("job_id", "nodes", "replicas", "local_bsz", "accum_steps", *cols, F.round("efficiency", 6).alias("efficiency"), F.col("valid").cast("int").alias("valid"))


def batch_change(spark, sf):
    c = F.col("job_id")
    rows = _asked(spark, sf).join(_jobs(spark, sf), "job_id")
    rows = rows.withColumn("autoscale", c % 6 != 0).withColumn("current_bsz", F.when(c % 4 == 0, F.lit(None)).otherwise(16 + c % 7 * 16).cast("bigint"))
    rows = rows.withColumn("current_accum", (c % 3).cast("bigint"))
    return G.batch_change(rows).select("job_id", "nodes", "replicas", "next_bsz", "next_accum")


def recommend_workers(spark, sf):
    c = F.col("job_id")
    jobs = _jobs(spark, sf).withColumn("cluster", F.pmod(c, F.lit(5))).withColumn("current", 1 + c % 6)
    jobs = jobs.withColumn("params", F.when(c % 10 != 0, F.col("params")))
    slots = table(spark, sf, "nation").select(
        F.col("n_regionkey").cast("bigint").alias("cluster"), F.col("n_nationkey").alias("node_order"), (F.col("n_nationkey") % 4).cast("bigint").alias("capacity")
    )
    return G.recommend_workers(jobs, slots)


def pivot_scale(spark, sf):
    wide = G.throughput_by_scale(_jobs(spark, sf).withColumn("local_bsz", 32 + F.col("job_id") % 3 * 16))
    return wide.select("job_id", *[F.round(c, 4).alias(c) for c in wide.columns if c != "job_id"])


def series_product(spark, sf):
    e = table(spark, sf, "events").select(F.date_trunc("hour", "ts").alias("ts"), F.col("user_id").alias("job"), "event_type", "value")
    per = lambda kind: e.filter(F.col("event_type") == kind).groupBy("ts", "job").agg(F.max("value").alias("value"))
    out = G.series_product(per("view"), per("click"), ["ts", "job"])
    return out.select(F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "job", F.round("value", 6).alias("value"))


def lr_factors(spark, sf):
    j = _jobs(spark, sf)
    scale = 1 + F.col("job_id") % 16 * 0.5
    cols = [F.round(rates.rule(n)(F.col("grad.sqr"), F.col("grad.var"), scale), 9).alias(n) for n in ("adascale", "adam", "linear", "sqrt")]
    legw = rates.legw_scale(scale, F.col("job_id") % 50 * 10.0, F.lit(2), F.lit(1000), F.col("init_batch"))
    return j.select("job_id", *cols, F.round(legw, 9).alias("legw"))


def applied_rates(spark, sf):
    """Mean factor and mean rate per market segment over groups of two initial rates."""
    j = _jobs(spark, sf)
    factor = rates.adascale(F.col("grad.sqr"), F.col("grad.var"), 1 + F.col("job_id") % 16 * 0.5)
    rows = j.select((F.col("job_id") % 20).alias("step"), factor.alias("factor"), (0.1 / (1 + F.col("job_id") % 2)).alias("initial"))
    out = rows.groupBy("step").agg(F.avg("factor").alias("factor"), F.avg(F.col("factor") * F.col("initial")).alias("rate"))
    return out.select("step", F.round("factor", 9).alias("factor"), F.round("rate", 9).alias("rate"))


def _grads(spark, sf, mixed=False):
    """Embeddings as gradients: step = vec_id div 8, eight replicas, two parameter groups of 32 values."""
    v = F.col("vec_id")
    e = table(spark, sf, "embeddings").select(
        F.floor(v / 80000).alias("run"), F.floor(v / 8).alias("step"), (v % 8).alias("replica"),
        F.posexplode(F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))).alias("grp", "grad"),
    )
    return e.filter((F.col("step") % 5 < 3) | (F.col("replica") == 0)) if mixed else e


def gradient_norms(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding", F.transform("embedding", lambda x: x.cast("double") * x).alias("v"))
    pre = Z.adam_precondition(F.col("v"), F.col("vec_id") % 10)
    return e.select("vec_id", F.round(Z.squared_norm(F.col("embedding")), 6).alias("plain"), F.round(Z.squared_norm(F.col("embedding"), pre), 6).alias("adam"))


def noise_scale(spark, sf):
    return Z.noise_estimates(_grads(spark, sf)).select("run", "step", "grp", "scale", F.round("sqr", 9).alias("sqr"), F.round("var", 9).alias("var"))


def noise_finite(spark, sf):
    """Some steps have a gradient that is not a number or infinite in one group of one replica; these steps are left out."""
    one = (F.col("replica") == 2) & (F.col("grp") == 1)
    odd = F.when(one & (F.col("step") % 11 == 3), float("nan")).when(one & (F.col("step") % 13 == 5), float("inf")).when(one & (F.col("step") % 17 == 6), float("-inf"))
    g = _grads(spark, sf).withColumn("grad", F.transform(F.col("grad"), lambda x, i: F.when((i == 7) & odd.isNotNull(), odd).otherwise(x.cast("double"))))
    return Z.noise_estimates(g).select("run", "step", "grp", "scale", F.round("sqr", 9).alias("sqr"), F.round("var", 9).alias("var"))


def noise_rescaled(spark, sf):
    """Four replicas accumulate twice a step; in every third step the scale changes in between and the first pass is lost."""
    g = _grads(spark, sf).withColumns({"micro": F.floor(F.col("replica") / 4), "replica": F.col("replica") % 4})
    scale = F.when((F.col("step") % 3 == 0) & (F.col("micro") == 1), 6.0).otherwise(4.0)
    kept = Z.after_scale_change(g.withColumn("accum_scale", scale))
    return Z.noise_estimates(kept, "accum_scale").select("run", "step", "grp", "scale", F.round("sqr", 9).alias("sqr"), F.round("var", 9).alias("var"))


def lr_user_rule(spark, sf):
    """A rule of the user's own beside the built-in ones."""
    scale = 1 + F.col("job_id") % 16 * 0.5
    factor = rates.rule("log_gain")(F.col("grad.sqr"), F.col("grad.var"), scale)
    return _jobs(spark, sf).select("job_id", F.round(factor, 9).alias("factor"))


rates.register_rule("log_gain", lambda sqr, var, scale: 1 + F.ln(rates.gain(sqr, var, scale)) / 2)


def noise_mixed(spark, sf):
    m = Z.mixed_estimates(_grads(spark, sf, mixed=True))
    return m.select("run", "step", "grp", F.col("biased").cast("int").alias("biased"), "scale", F.round("sqr", 9).alias("sqr"), F.round("var", 9).alias("var"))


def noise_ema(spark, sf):
    a = Z.noise_average(Z.mixed_estimates(_grads(spark, sf, mixed=True)))
    return a.select("run", "step", "grp", "segment", F.round("sqr_avg", 8).alias("sqr_avg"), F.round("var_avg", 8).alias("var_avg"))


def _progress(spark, sf):
    return Z.progress(Z.reported(Z.noise_average(Z.noise_estimates(_grads(spark, sf)))))


def progress(spark, sf):
    return _progress(spark, sf).select("run", "step", F.round("sqr", 8).alias("sqr"), F.round("var", 8).alias("var"), F.round("gain", 6).alias("gain"), F.round("progress", 5).alias("progress"))


def epoch_ends(spark, sf):
    n = table(spark, sf, "embeddings").agg(F.count("*").alias("n")).scalar()
    return Z.epoch_ends(_progress(spark, sf), n, 50)


GRADS = """
g AS (SELECT vec_id // 80000 AS run, vec_id // 8 AS step, vec_id % 8 AS replica, (d - 1) // 32 AS grp, d, x::DOUBLE AS x
      FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS d FROM embeddings)),
"""

NORMS = """
l AS (SELECT run, step, grp, count(DISTINCT replica) AS n, sum(x * x) / count(DISTINCT replica) AS loc FROM f GROUP BY 1, 2, 3),
t AS (SELECT run, step, grp, sum(m * m) AS tot FROM (SELECT run, step, grp, d, avg(x) AS m FROM f GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
u AS (SELECT * FROM l JOIN t USING (run, step, grp)),
"""

EST = "e AS (SELECT run, step, grp, n::DOUBLE AS scale, (n * tot - loc) / (n - 1) AS sqr, (loc - tot) * n / (n - 1) AS var, 0 AS segment FROM u WHERE n > 1)"

EMA = """
a AS (SELECT *, pow(0.999::DOUBLE, scale) AS th, sum(scale * ln(0.999::DOUBLE)) OVER (PARTITION BY run, grp, segment ORDER BY step) AS lg FROM e WHERE sqr IS NOT NULL),
m AS (SELECT run, step, grp, segment, scale, sum((1 - th) * sqr * exp(-lg)) OVER w / sum((1 - th) * exp(-lg)) OVER w AS sqr_avg,
             sum((1 - th) * var * exp(-lg)) OVER w / sum((1 - th) * exp(-lg)) OVER w AS var_avg FROM a WINDOW w AS (PARTITION BY run, grp, segment ORDER BY step))"""

MIXED = f"""{GRADS} f AS (SELECT * FROM g WHERE step % 5 < 3 OR replica = 0), {NORMS}
c AS (SELECT *, lag(step) OVER w AS ps, lag(n) OVER w AS pn, lag(loc) OVER w AS pl FROM u WINDOW w AS (PARTITION BY run, grp ORDER BY step)),
h AS (SELECT c.run, c.step, c.grp, sum(((x.x + y.x) / 2) * ((x.x + y.x) / 2)) AS tot2 FROM c JOIN f x ON c.run = x.run AND c.step = x.step AND c.grp = x.grp
      JOIN f y ON c.run = y.run AND c.ps = y.step AND c.grp = y.grp AND x.d = y.d WHERE c.n = 1 AND c.pn = 1 GROUP BY 1, 2, 3),
b AS (SELECT c.*, tot2, (pl + loc) / 2 AS loc2 FROM c LEFT JOIN h USING (run, step, grp)),
e0 AS (SELECT run, step, grp, (n = 1)::INT AS biased, CASE WHEN n = 1 THEN 2 ELSE n END::DOUBLE AS scale,
             CASE WHEN n > 1 THEN (n * tot - loc) / (n - 1) ELSE 2 * tot2 - loc2 END AS sqr, CASE WHEN n > 1 THEN (loc - tot) * n / (n - 1) ELSE (loc2 - tot2) * 2 END AS var FROM b
      WHERE n > 1 OR TRUE),
e1 AS (SELECT run, step, grp, biased, scale, CASE WHEN biased = 1 AND NOT EXISTS (SELECT 1 FROM h WHERE h.run = e0.run AND h.step = e0.step AND h.grp = e0.grp) THEN NULL ELSE sqr END AS sqr,
             CASE WHEN biased = 1 AND NOT EXISTS (SELECT 1 FROM h WHERE h.run = e0.run AND h.step = e0.step AND h.grp = e0.grp) THEN NULL ELSE var END AS var FROM e0)"""

REPORT = f"""WITH {GRADS} f AS (SELECT * FROM g), {NORMS} {EST}, {EMA},
r AS (SELECT run, step, max(scale) AS scale, sum(greatest(sqr_avg, 0)) AS sqr, sum(greatest(var_avg, 1e-6::DOUBLE)) AS var FROM m GROUP BY 1, 2),
o AS (SELECT *, (var + sqr) / (var / scale + sqr) AS gain, sum((var + sqr) / (var / scale + sqr)) OVER (PARTITION BY run ORDER BY step) AS progress FROM r)"""

QUERIES = {
    "step_profile": (
        step_profile,
        f"""WITH {STEPS} SELECT job_id, nodes, replicas, local_bsz, round(accum_time, 6) AS accum_time, round(optim_time, 6) AS optim_time, round(sync_time, 6) AS sync_time,
            CAST(accum_count AS BIGINT) AS accum_count, CAST(optim_count AS BIGINT) AS optim_count FROM p""",
    ),
    "profile_means": (
        profile_means,
        f"""WITH {STEPS} SELECT job_id, nodes, replicas, local_bsz, round((accum_time + optim_time - sync_time) / (accum_count + optim_count), 8) AS accum_mean,
            round(optim_time / optim_count, 8) AS optim_mean, (optim_time >= sync_time)::INT AS valid FROM p WHERE optim_count > 0""",
    ),
    "max_profiled": (max_profiled, f"WITH {STEPS} SELECT job_id, max(replicas) AS max_profiled FROM p WHERE optim_count > 0 GROUP BY 1"),
    "gradient_params": (
        gradient_params,
        """WITH l AS (SELECT user_id AS job_id, event_type, arg_max(value, event_id) AS v FROM events GROUP BY 1, 2)
           SELECT job_id, round(sum(v), 6) AS sqr, round(sum(v * 2), 6) AS var FROM l GROUP BY 1""",
    ),
    "step_split": (
        step_split,
        f"WITH {STEPS} SELECT job_id, round((sum(step_time) - sum(sync_time)) / count(*), 6) AS compute, round(sum(sync_time) / count(*), 6) AS sync FROM s GROUP BY 1",
    ),
    "goodput_grid": (
        goodput_grid,
        f"WITH {MODEL}, {ASKED}, {search_sql('q', 'x')} SELECT job_id, n AS nodes, r AS replicas, b AS local_bsz, a AS accum_steps, round(good, 4) AS goodput FROM x",
    ),
    "speedup_table": (
        speedup_table,
        f"""WITH {MODEL}, {ASKED}, o AS (SELECT job_id, 1::BIGINT AS n, 1::BIGINT AS r FROM j), {search_sql('q', 'x')}, {search_sql('o', 'y')}
            SELECT job_id, x.n AS nodes, x.r AS replicas, round(x.good / y.good, 6) AS speedup FROM x JOIN y USING (job_id) UNION ALL SELECT job_id, 0, 0, 0.0 FROM j""",
    ),
    "config_grid": (
        config_grid,
        f"""WITH {MODEL}, w AS (SELECT j.*, n, r, b, a FROM j, (VALUES (1), (2), (4)) n(n), (VALUES (1), (2), (4), (8)) r(r), (VALUES (8), (16), (24)) b(b), (VALUES (0), (2)) a(a) WHERE n <= r),
            {goodput_sql('w', 'x')}
            SELECT job_id, n AS nodes, r AS replicas, b AS local_bsz, a AS accum_steps, round(thr, 4) AS throughput, round(eff, 6) AS efficiency, round(good, 4) AS goodput,
                   (batch >= init)::INT AS valid FROM x""",
    ),
    "batch_change": (
        batch_change,
        f"""WITH {MODEL}, {ASKED}, {search_sql('q', 'x')},
            c AS (SELECT j.*, n, r, CASE WHEN job_id % 4 = 0 THEN NULL ELSE 16 + job_id % 7 * 16 END AS b, job_id % 3 AS a FROM q JOIN j USING (job_id)), {goodput_sql('c', 'y')}
            SELECT x.job_id, x.n AS nodes, x.r AS replicas,
                   CASE WHEN x.job_id % 6 = 0 THEN (x.init + x.r - 1) // x.r WHEN y.b IS NULL OR x.good / greatest(y.good, 1e-8::DOUBLE) > 1.05::DOUBLE THEN x.b ELSE y.b END AS next_bsz,
                   CASE WHEN x.job_id % 6 = 0 THEN 0 WHEN y.b IS NULL OR x.good / greatest(y.good, 1e-8::DOUBLE) > 1.05::DOUBLE THEN x.a ELSE y.a END AS next_accum
            FROM x JOIN y ON x.job_id = y.job_id AND x.n = y.n AND x.r = y.r""",
    ),
    "recommend_workers": (
        recommend_workers,
        f"""WITH {MODEL}, d AS (SELECT n_regionkey AS cl, n_nationkey % 4 AS cap, CAST(sum(n_nationkey % 4) OVER w AS BIGINT) AS upto, count(*) OVER w AS used FROM nation WHERE n_nationkey % 4 > 0
                                WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)),
            z AS (SELECT cl, used, CAST(unnest(range(upto - cap + 1, upto + 1)) AS BIGINT) AS w FROM d),
            q AS (SELECT job_id, w AS n, w AS r FROM j JOIN z ON job_id % 5 = cl WHERE job_id % 10 <> 0),
            o AS (SELECT job_id, 1::BIGINT AS n, 1::BIGINT AS r FROM j), {search_sql('q', 'x')}, {search_sql('o', 'y')},
            v AS (SELECT x.job_id, 1 + x.job_id % 6 AS cur, x.n AS w, used, x.good / y.good AS sp FROM x JOIN y USING (job_id) JOIN z ON x.job_id % 5 = cl AND x.n = z.w),
            h AS (SELECT job_id, cur, coalesce(max(w) FILTER (sp / used >= 0.5), 0) AS best, coalesce(arg_max(sp, w) FILTER (sp / used >= 0.5), 0) AS bs, max(sp) FILTER (w = cur) AS now FROM v GROUP BY 1, 2)
            SELECT job_id, CASE WHEN coalesce(bs < now * 1.05::DOUBLE, FALSE) OR abs(best + 1 - cur) < 0.15::DOUBLE * cur THEN cur ELSE best END AS workers FROM h
            UNION ALL SELECT job_id, 1 FROM j WHERE job_id % 10 = 0""",
    ),
    "pivot_scale": (
        pivot_scale,
        f"""WITH {MODEL}, w AS (SELECT j.*, 1 AS n, r, 32 + job_id % 3 * 16 AS b, 0 AS a FROM j, range(1, 17) z(r)), {goodput_sql('w', 'x')}
            SELECT job_id, {', '.join(f'max(round(thr, 4)) FILTER (r = {i}) AS replicas_{i}' for i in range(1, 17))} FROM x GROUP BY 1""",
    ),
    "series_product": (
        series_product,
        """WITH m AS (SELECT date_trunc('hour', ts) AS h, user_id AS job, max(value) FILTER (event_type = 'view') AS a, max(value) FILTER (event_type = 'click') AS b FROM events GROUP BY 1, 2)
           SELECT strftime(h, '%Y-%m-%d %H') AS hour, job, round(a * b, 6) AS value FROM m WHERE a IS NOT NULL AND b IS NOT NULL""",
    ),
    "lr_factors": (
        lr_factors,
        f"""WITH {MODEL}, k AS (SELECT *, 1 + job_id % 16 * 0.5::DOUBLE AS sc, (greatest(var, 1e-6) + sqr) / (greatest(var, 1e-6) / (1 + job_id % 16 * 0.5::DOUBLE) + sqr) AS ada,
                                       2 * (1 + job_id % 16 * 0.5::DOUBLE) * 1000 / init AS steps FROM j)
            SELECT job_id, round(ada, 9) AS adascale, round(pow(ada, 0.5), 9) AS adam, round(sc, 9) AS linear, round(sqrt(sc), 9) AS sqrt,
                   round(sqrt(sc) * CASE WHEN job_id % 50 * 10 < steps THEN job_id % 50 * 10 / steps ELSE 1 END, 9) AS legw FROM k""",
    ),
    "applied_rates": (
        applied_rates,
        f"""WITH {MODEL}, k AS (SELECT job_id, (var + sqr) / (var / (1 + job_id % 16 * 0.5::DOUBLE) + sqr) AS ada, 0.1::DOUBLE / (1 + job_id % 2) AS initial FROM j)
            SELECT job_id % 20 AS step, round(avg(ada), 9) AS factor, round(avg(ada * initial), 9) AS rate FROM k GROUP BY 1""",
    ),
    "gradient_norms": (
        gradient_norms,
        """WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(embedding) AS f FROM embeddings)
           SELECT vec_id, round(sum(x * x), 6) AS plain,
                  round(sum(pow(x / CASE WHEN vec_id % 10 < 5 THEN 1 ELSE sqrt(x * x) / sqrt(1 - pow(0.999::DOUBLE, vec_id % 10)) + 1e-8::DOUBLE END, 2)), 6) AS adam FROM c GROUP BY 1""",
    ),
    "noise_scale": (
        noise_scale,
        f"WITH {GRADS} f AS (SELECT * FROM g), {NORMS} {EST} SELECT run, step, grp, scale, round(sqr, 9) AS sqr, round(var, 9) AS var FROM e",
    ),
    "noise_finite": (
        noise_finite,
        f"""WITH {GRADS} f AS (SELECT * FROM g WHERE step % 11 <> 3 AND step % 13 <> 5 AND step % 17 <> 6 OR step NOT IN (SELECT step FROM g WHERE replica = 2 AND grp = 1)), {NORMS} {EST}
            SELECT run, step, grp, scale, round(sqr, 9) AS sqr, round(var, 9) AS var FROM e""",
    ),
    "noise_rescaled": (
        noise_rescaled,
        f"""WITH {GRADS} f AS (SELECT * FROM g WHERE step % 3 <> 0 OR replica >= 4 OR NOT EXISTS (SELECT 1 FROM g h WHERE h.step = g.step AND h.replica >= 4)), {NORMS}
            p AS (SELECT run, step, count(DISTINCT replica % 4) AS r, CASE WHEN step % 3 = 0 AND max(replica) >= 4 THEN 6 ELSE 4 END AS s FROM f GROUP BY 1, 2),
            e AS (SELECT run, step, grp, s * n / r::DOUBLE AS scale, (n * tot - loc) / (n - 1) AS sqr, (loc - tot) * scale / (n - 1) AS var FROM u JOIN p USING (run, step) WHERE n > 1)
            SELECT run, step, grp, scale, round(sqr, 9) AS sqr, round(var, 9) AS var FROM e""",
    ),
    "lr_user_rule": (
        lr_user_rule,
        f"WITH {MODEL} SELECT job_id, round(1 + ln((var + sqr) / (var / (1 + job_id % 16 * 0.5::DOUBLE) + sqr)) / 2, 9) AS factor FROM j",
    ),
    "noise_mixed": (noise_mixed, f"WITH {MIXED} SELECT run, step, grp, biased, scale, round(sqr, 9) AS sqr, round(var, 9) AS var FROM e1"),
    "noise_ema": (
        noise_ema,
        f"""WITH {MIXED}, e2 AS (SELECT *, coalesce(lag(biased) OVER (PARTITION BY run, grp ORDER BY step), 0) = 1 AND biased = 0 AS restart FROM e1),
            e AS (SELECT *, CAST(sum(restart::INT) OVER (PARTITION BY run, grp ORDER BY step) AS BIGINT) AS segment FROM e2), {EMA}
            SELECT run, step, grp, segment, round(sqr_avg, 8) AS sqr_avg, round(var_avg, 8) AS var_avg FROM m""",
    ),
    "progress": (
        progress,
        f"{REPORT} SELECT run, step, round(sqr, 8) AS sqr, round(var, 8) AS var, round(gain, 6) AS gain, round(progress, 5) AS progress FROM o",
    ),
    "epoch_ends": (
        epoch_ends,
        f"""{REPORT}, s AS (SELECT run, step, lag(progress, 1, 0) OVER (PARTITION BY run ORDER BY step) AS seen FROM o),
            n AS (SELECT count(*) AS n FROM embeddings),
            c AS (SELECT run, e AS epoch, min(step) AS c FROM s, n, range(10000) z(e) WHERE seen >= n * (e + 1) / 50.0::DOUBLE GROUP BY 1, 2)
            SELECT run, epoch, epoch + max(c - epoch) OVER (PARTITION BY run ORDER BY epoch) AS end_step FROM c""",
    ),
}
