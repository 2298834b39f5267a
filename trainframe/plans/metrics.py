"""Accumulated statistics, scores and features over the given tables."""

from pyspark.sql import functions as F

from trainframe.operators import accumulate as A
from trainframe.operators import answers as N
from trainframe.operators import features as X
from trainframe.session import table

def _cents():
    return F.round(F.col("value") * 100).cast("bigint")



def _log(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("run"),
        F.dayofmonth("ts").alias("epoch"),
        F.floor(F.col("event_id") / 7).alias("sync_no"),
        (F.col("event_id") % 7 % 3).alias("attempt"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "signup", "clear").otherwise("add").alias("op"),
        F.col("event_type").alias("key"),
        _cents().alias("delta"),
    )


LOG = """
l AS (SELECT user_id AS run, day(ts) AS epoch, event_id // 7 AS sync_no, event_id % 7 % 3 AS attempt, event_id AS seq,
             CASE WHEN event_type = 'signup' THEN 'clear' ELSE 'add' END AS op, event_type AS key, CAST(round(value * 100) AS BIGINT) AS delta FROM events)"""


def accumulate(spark, sf):
    return A.accumulate(_log(spark, sf).withColumn("sync_no", F.floor(F.col("seq") / 1000)))


def accumulate_replay(spark, sf):
    return A.accumulate_once(_log(spark, sf).withColumn("run", F.col("run") % 5))


def accumulate_loops(spark, sf):
    """As the replayed log, with every third sync made inside a loop."""
    return A.accumulate_loops(_log(spark, sf).withColumns({"run": F.col("run") % 5, "in_loop": F.col("sync_no") % 3 == 0}))


def carried_totals(spark, sf):
    return A.carried_totals(_log(spark, sf)).select("run", "segment", "sync_no", "key", "total")


def final_totals(spark, sf):
    return A.final_totals(_log(spark, sf))


def reduce_vectors(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    out = A.reduce_vectors(e, ["label"], "v")
    return out.select("label", F.posexplode("v").alias("dim", "x")).select("label", "dim", F.round("x", 6).alias("x"))


def reduce_counters(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_suppkey",
        F.create_map(F.concat(F.lit("flag_"), "l_returnflag"), F.lit(1), F.concat(F.lit("status_"), "l_linestatus"), F.col("l_linenumber")).alias("counter"),
    )
    return A.reduce_counters(li, ["l_suppkey"], "counter")


def reduce_sets(spark, sf):
    e = table(spark, sf, "events").select(F.floor(F.col("event_id") / 1000).alias("step"), F.array("event_type", F.concat("event_type", F.lit("_seen"))).alias("m"))
    return A.reduce_sets(e, ["step"], "m")


def any_flag(spark, sf):
    e = table(spark, sf, "events").withColumn("step", F.floor(F.col("event_id") / 3))
    return A.any_flag(e, ["step"], F.col("event_type") == "error").select("step", F.col("any_flag").cast("int").alias("any_flag"))


def leader_value(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"))
    li = li.withColumn("rank", F.col("l_linenumber") - 1)
    return A.leader_value(li, ["l_orderkey"], "rank", "q").select("l_orderkey", "rank", "q", "leader_q")


def accuracy_by_lang(spark, sf):
    joined = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    loss = F.abs(F.col("quality") - F.col("toxic"))
    correct = F.when(F.col("quality") == F.col("toxic"), 1).otherwise(0)
    out = A.weighted_scores(joined, ["lang"], loss, F.lit(1), correct)
    return out.select("lang", "total", F.round("loss", 9).alias("loss"), F.round("accuracy", 9).alias("accuracy"))


def weighted_loss(spark, sf):
    li = table(spark, sf, "lineitem")
    ok = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
    out = A.weighted_scores(li, ["l_suppkey"], F.col("l_discount"), F.col("l_quantity"), ok)
    return out.select("l_suppkey", "total", F.round("loss", 9).alias("loss"), F.round("accuracy", 9).alias("accuracy"))


def argmax_accuracy(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", A.argmax(F.col("embedding")).alias("guess"))
    return e.select("vec_id", "guess", F.when(F.col("guess") == F.col("label"), 1).otherwise(0).alias("correct"))


def replica_mean(spark, sf):
    per = table(spark, sf, "events").groupBy(F.dayofmonth("ts").alias("epoch"), (F.col("event_id") % 4).alias("replica")).agg(
        (F.sum(_cents()) / F.count("*")).alias("loss")
    )
    return A.replica_mean(per, ["epoch"], F.col("loss")).select("epoch", F.round("mean", 6).alias("mean"))


def loss_over_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    n = li.agg(F.count("*").alias("n")).scalar()
    out = A.loss_over(li, ["l_returnflag"], F.col("l_discount"), n)
    return out.select("l_returnflag", F.round("loss", 9).alias("loss"), F.round("perplexity", 9).alias("perplexity"))


def loss_over_batches(spark, sf):
    li = table(spark, sf, "lineitem")
    n = li.agg(F.count("*").alias("n")).scalar()
    out = A.loss_over(li, ["l_returnflag"], F.col("l_discount"), (n - 1) / 35 / 20 / 4)
    return out.select("l_returnflag", F.round("loss", 6).alias("loss"))


def logging_windows(spark, sf):
    e = table(spark, sf, "events").select((F.col("event_id") % 4).alias("run"), F.floor(F.col("event_id") / 4).alias("i"), _cents().alias("c"))
    out = A.logging_windows(e, ["run"], "i", 50, {"loss": F.col("c"), "seconds": F.col("c") % 17})
    return out.select("run", "log_window", F.round("loss", 6).alias("loss"), F.round("seconds", 6).alias("seconds"))


def best_so_far(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", "value")
    up = A.best_so_far(e, ["user_id"], "event_id", "value", "max").withColumn("mode", F.lit("max"))
    down = A.best_so_far(e, ["user_id"], "event_id", "value", "min").withColumn("mode", F.lit("min"))
    return up.unionByName(down)


def trial_summary(spark, sf):
    return A.final_metrics(_trials(spark, sf)).select("trial", "metric", "iterations", F.round("value", 6).alias("value"))


def best_trial(spark, sf):
    t = _trials(spark, sf).withColumn("grp", F.col("trial") % 10)
    out = A.best_trial(t, ["grp"], "view", "max").withColumn("mode", F.lit("max"))
    return out.unionByName(A.best_trial(t, ["grp"], "view", "min").withColumn("mode", F.lit("min")))


def _trials(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("trial"), F.col("event_id").alias("iter"), F.col("event_type").alias("metric"), "value"
    )


def _answers(spark, sf):
    c = table(spark, sf, "conversations")
    pred = c.filter("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("prediction"))
    refs = c.filter("role = 'user'").select(
        "conv_id", F.explode(F.array(F.struct((F.col("turn") + 1).alias("t"), F.lit(0).alias("r")), F.struct((F.col("turn") - 1).alias("t"), F.lit(1).alias("r")))).alias("u"), "text"
    )
    refs = refs.select("conv_id", F.col("u.t").alias("turn"), F.col("u.r").alias("ref_no"), F.col("text").alias("answer"))
    return N.with_references(pred, refs, ["conv_id", "turn"])


def _part_names(spark, sf):
    """Each part's name is predicted by its neighbours' names, written another way."""
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    pred = p.select("p_partkey", F.col("p_name").alias("prediction"))
    refs = p.select(
        F.explode(F.array(
            F.struct((F.col("p_partkey") - 1).alias("p_partkey"), F.concat(F.lit("The "), "p_name", F.lit("!")).alias("answer")),
            F.struct((F.col("p_partkey") + 1).alias("p_partkey"), F.upper("p_name").alias("answer")),
        )).alias("r")
    ).select("r.*")
    return N.with_references(pred, refs, ["p_partkey"])


def exact_match(spark, sf):
    return N.exact_match_each(_part_names(spark, sf), ["p_partkey"])


def exact_match_score(spark, sf):
    return N.exact_match(_part_names(spark, sf), ["p_partkey"]).select("questions", F.round("exact_match", 6).alias("exact_match"))


def answers_match(spark, sf):
    return N.exact_match_each(_answers(spark, sf), ["conv_id", "turn"])


def normalized_answers(spark, sf):
    from trainframe.functions.text import normalize_answer

    c = table(spark, sf, "conversations")
    return c.select("conv_id", "turn", normalize_answer(F.col("text")).alias("norm"))


def _token_pairs(spark, sf):
    words = lambda c: F.array_remove(F.split(c, "[ \\n]+"), "")
    return _answers(spark, sf).select(
        "conv_id", "turn", "ref_no", words("prediction").alias("prediction_tokens"), words("answer").alias("answer_tokens")
    )


def token_f1(spark, sf):
    return N.token_f1_each(_token_pairs(spark, sf), ["conv_id", "turn"]).select("conv_id", "turn", F.round("f1", 9).alias("f1"))


def token_f1_score(spark, sf):
    return N.token_f1(_token_pairs(spark, sf), ["conv_id", "turn"]).select("questions", F.round("f1", 6).alias("f1"))


def token_f1_missing(spark, sf):
    """Every fifth turn has no prediction and every seventh conversation no answers: null sides, not empty texts."""
    p = _token_pairs(spark, sf)
    gone = {"prediction_tokens": (F.col("conv_id") + F.col("turn")) % 5 == 0, "answer_tokens": F.col("conv_id") % 7 == 0}
    p = p.withColumns({c: F.when(~cond, F.col(c)) for c, cond in gone.items()})
    return N.token_f1_each(p, ["conv_id", "turn"]).select("conv_id", "turn", F.round("f1", 9).alias("f1"))


def channel_stats(spark, sf):
    out = X.channel_stats(table(spark, sf, "embeddings").select("embedding"), "embedding", 4)
    return out.select("channel", F.round("mean", 9).alias("mean"), F.round("mean_std", 9).alias("mean_std"), F.round("global_std", 9).alias("global_std"))


def standardize(spark, sf):
    e = table(spark, sf, "embeddings")
    out = X.standardize(F.col("embedding"), [0.1, 0.0, -0.1, 0.2], [0.5, 0.25, 2.0, 1.0])
    return e.select("vec_id", F.posexplode(out).alias("dim", "x")).select("vec_id", "dim", F.round("x", 9).alias("x"))


def poly_features(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", X.polynomial(F.col("l_discount"), 4).alias("p"))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *[F.round(F.col("p")[i], 12).alias(f"x{i + 1}") for i in range(4)])


PUNCT = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"


def norm_sql(text: str) -> str:
    """SQL of answer normalisation: articles are dropped as whole words after punctuation is gone."""
    bare = f"translate(lower({text}), {PUNCT}, '')"
    return f"array_to_string(list_filter(string_split_regex({bare}, '\\s+'), lambda t: t NOT IN ('', 'a', 'an', 'the')), ' ')"


ANSWERS = """
a AS (SELECT p.conv_id, p.turn, CASE WHEN u.turn = p.turn - 1 THEN 0 ELSE 1 END AS ref_no, p.text AS prediction, u.text AS answer
      FROM conversations p JOIN conversations u ON p.conv_id = u.conv_id AND abs(p.turn - u.turn) = 1 WHERE p.role = 'assistant' AND u.role = 'user')"""

PARTS = f"""WITH a AS (SELECT p.p_partkey, p.p_name AS prediction, CASE WHEN r.p_partkey > p.p_partkey THEN 'The ' || r.p_name || '!' ELSE upper(r.p_name) END AS answer
          FROM part p JOIN part r ON r.p_partkey = p.p_partkey + 1 OR r.p_partkey = p.p_partkey - 1),
e AS (SELECT p_partkey, max(({norm_sql('prediction')} = {norm_sql('answer')})::INT) AS em FROM a GROUP BY 1)"""

F1 = f"""WITH {ANSWERS},
w AS (SELECT conv_id, turn, ref_no, list_filter(string_split_regex(prediction, '[ \\n]+'), lambda t: t <> '') AS p,
             list_filter(string_split_regex(answer, '[ \\n]+'), lambda t: t <> '') AS r FROM a),
x AS (SELECT conv_id, turn, ref_no, token, sum(i) AS np, sum(1 - i) AS nr FROM (
        SELECT conv_id, turn, ref_no, unnest(p) AS token, 1 AS i FROM w UNION ALL SELECT conv_id, turn, ref_no, unnest(r), 0 FROM w) GROUP BY ALL),
o AS (SELECT conv_id, turn, ref_no, sum(least(np, nr)) AS same FROM x GROUP BY ALL),
f AS (SELECT conv_id, turn, max(CASE WHEN len(p) = 0 AND len(r) = 0 THEN 1.0::DOUBLE WHEN coalesce(same, 0) = 0 THEN 0 ELSE 2 * same / (len(p) + len(r)) END) AS f1
      FROM w LEFT JOIN o USING (conv_id, turn, ref_no) GROUP BY 1, 2)"""

QUERIES = {
    "accumulate": (
        accumulate,
        f"WITH {LOG} SELECT run, epoch, seq // 1000 AS sync_no, key, CAST(sum(delta) AS BIGINT) AS value FROM l GROUP BY ALL",
    ),
    "accumulate_replay": (
        accumulate_replay,
        f"""WITH {LOG}, m AS (SELECT *, min(attempt) OVER (PARTITION BY run % 5, epoch, sync_no) AS first FROM l)
            SELECT run % 5 AS run, epoch, sync_no, key, CAST(sum(delta) AS BIGINT) AS value FROM m WHERE attempt = first GROUP BY ALL""",
    ),
    "accumulate_loops": (
        accumulate_loops,
        f"""WITH {LOG}, m AS (SELECT *, min(attempt) OVER (PARTITION BY run % 5, epoch, sync_no) AS first FROM l)
            SELECT run % 5 AS run, epoch, sync_no, attempt, key, CAST(sum(delta) AS BIGINT) AS value FROM m WHERE sync_no % 3 = 0 OR attempt = first GROUP BY ALL""",
    ),
    "carried_totals": (
        carried_totals,
        f"""WITH {LOG}, s AS (SELECT *, CAST(sum((op = 'clear')::INT) OVER (PARTITION BY run ORDER BY seq) AS BIGINT) AS segment FROM l),
            g AS (SELECT run, segment, sync_no, key, sum(delta) AS d FROM s WHERE op = 'add' GROUP BY ALL)
            SELECT run, segment, sync_no, key, CAST(sum(d) OVER (PARTITION BY run, segment, key ORDER BY sync_no) AS BIGINT) AS total FROM g""",
    ),
    "final_totals": (
        final_totals,
        f"""WITH {LOG}, c AS (SELECT run, max(seq) AS last FROM l WHERE op = 'clear' GROUP BY 1)
            SELECT l.run, key, CAST(sum(delta) AS BIGINT) AS total FROM l LEFT JOIN c ON l.run = c.run WHERE op = 'add' AND seq > coalesce(last, -1) GROUP BY ALL""",
    ),
    "reduce_vectors": (
        reduce_vectors,
        """WITH c AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
           SELECT label, dim, round(sum(x), 6) AS x FROM c GROUP BY 1, 2""",
    ),
    "reduce_counters": (
        reduce_counters,
        """SELECT l_suppkey, 'flag_' || l_returnflag AS key, count(*) AS count FROM lineitem GROUP BY 1, 2
           UNION ALL SELECT l_suppkey, 'status_' || l_linestatus, CAST(sum(l_linenumber) AS BIGINT) FROM lineitem GROUP BY 1, 2""",
    ),
    "reduce_sets": (
        reduce_sets,
        """SELECT DISTINCT event_id // 1000 AS step, event_type AS member FROM events
           UNION ALL SELECT DISTINCT event_id // 1000, event_type || '_seen' FROM events""",
    ),
    "any_flag": (any_flag, "SELECT event_id // 3 AS step, max((event_type = 'error')::INT) AS any_flag FROM events GROUP BY 1"),
    "leader_value": (
        leader_value,
        """WITH l AS (SELECT l_orderkey, l_linenumber - 1 AS rank, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)
           SELECT a.l_orderkey, a.rank, a.q, b.q AS leader_q FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND b.rank = 0""",
    ),
    "accuracy_by_lang": (
        accuracy_by_lang,
        """SELECT lang, count(*) AS total, round(avg(abs(quality - toxic)), 9) AS loss, round(avg((quality = toxic)::INT), 9) AS accuracy
           FROM labels JOIN documents USING (doc_id) GROUP BY 1""",
    ),
    "weighted_loss": (
        weighted_loss,
        """SELECT l_suppkey, sum(l_quantity) AS total, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS loss,
                  round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) / sum(l_quantity), 9) AS accuracy FROM lineitem GROUP BY 1""",
    ),
    "argmax_accuracy": (
        argmax_accuracy,
        """WITH g AS (SELECT vec_id, label, list_position(embedding, list_max(embedding)) - 1 AS guess FROM embeddings)
           SELECT vec_id, guess, (guess = label)::INT AS correct FROM g""",
    ),
    "replica_mean": (
        replica_mean,
        """WITH r AS (SELECT day(ts) AS epoch, event_id % 4 AS r, sum(CAST(round(value * 100) AS BIGINT)) / count(*) AS loss FROM events GROUP BY 1, 2)
           SELECT epoch, round(avg(loss), 6) AS mean FROM r GROUP BY 1""",
    ),
    "loss_over_rows": (
        loss_over_rows,
        """WITH l AS (SELECT l_returnflag, sum(l_discount) / (SELECT count(*) FROM lineitem) AS loss FROM lineitem GROUP BY 1)
           SELECT l_returnflag, round(loss, 9) AS loss, round(exp(loss), 9) AS perplexity FROM l""",
    ),
    "loss_over_batches": (
        loss_over_batches,
        "SELECT l_returnflag, round(sum(l_discount) / (((SELECT count(*) FROM lineitem) - 1) / 35 / 20 / 4), 6) AS loss FROM lineitem GROUP BY 1",
    ),
    "logging_windows": (
        logging_windows,
        """WITH e AS (SELECT event_id % 4 AS run, event_id // 4 AS i, CAST(round(value * 100) AS BIGINT) AS c FROM events),
           w AS (SELECT *, greatest((i + 49) // 50, 1) AS log_window FROM e)
           SELECT run, log_window, round(sum(c) / 50, 6) AS loss, round(sum(c % 17) / 50, 6) AS seconds FROM w GROUP BY 1, 2 HAVING max(i) = log_window * 50""",
    ),
    "best_so_far": (
        best_so_far,
        """WITH b AS (SELECT user_id, event_id, value, max(value) OVER w AS hi, min(value) OVER w AS lo FROM events
                      WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
           SELECT user_id, event_id, value, 'max' AS mode FROM b WHERE hi IS NULL OR value > hi
           UNION ALL SELECT user_id, event_id, value, 'min' FROM b WHERE lo IS NULL OR value < lo""",
    ),
    "trial_summary": (
        trial_summary,
        """SELECT user_id AS trial, event_type AS metric, max(event_id) AS iterations, round(arg_max(value, event_id), 6) AS value FROM events GROUP BY 1, 2""",
    ),
    "best_trial": (
        best_trial,
        """WITH l AS (SELECT user_id % 10 AS grp, user_id AS trial, arg_max(value, event_id) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2),
           r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY value DESC, trial) AS hi, row_number() OVER (PARTITION BY grp ORDER BY value, trial) AS lo,
                        count(*) OVER (PARTITION BY grp) AS trials FROM l)
           SELECT grp, trial, value, trials, 'max' AS mode FROM r WHERE hi = 1 UNION ALL SELECT grp, trial, value, trials, 'min' FROM r WHERE lo = 1""",
    ),
    "normalized_answers": (normalized_answers, f"SELECT conv_id, turn, {norm_sql('text')} AS norm FROM conversations"),
    "exact_match": (exact_match, f"{PARTS} SELECT p_partkey, em FROM e"),
    "exact_match_score": (exact_match_score, f"{PARTS} SELECT count(*) AS questions, round(100 * avg(em), 6) AS exact_match FROM e"),
    "answers_match": (
        answers_match,
        f"WITH {ANSWERS} SELECT conv_id, turn, max(({norm_sql('prediction')} = {norm_sql('answer')})::INT) AS em FROM a GROUP BY 1, 2",
    ),
    "token_f1": (token_f1, f"{F1} SELECT conv_id, turn, round(f1, 9) AS f1 FROM f"),
    "token_f1_score": (token_f1_score, f"{F1} SELECT count(*) AS questions, round(100 * avg(f1), 6) AS f1 FROM f"),
    "token_f1_missing": (
        token_f1_missing,
        f"""{F1.replace("list_filter(string_split_regex(prediction", "CASE WHEN (conv_id + turn) % 5 = 0 THEN [] ELSE list_filter(string_split_regex(prediction").replace("t <> '') AS p", "t <> '') END AS p").replace("list_filter(string_split_regex(answer", "CASE WHEN conv_id % 7 = 0 THEN [] ELSE list_filter(string_split_regex(answer").replace("t <> '') AS r", "t <> '') END AS r")}
            SELECT conv_id, turn, round(f1, 9) AS f1 FROM f""",
    ),
    "channel_stats": (
        channel_stats,
        """WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1) // 16 AS channel FROM embeddings),
           r AS (SELECT vec_id, channel, avg(x) AS m, stddev_samp(x) AS s FROM c GROUP BY 1, 2),
           g AS (SELECT channel, stddev_samp(x) AS gs FROM c GROUP BY 1)
           SELECT channel, round(avg(m), 9) AS mean, round(avg(s), 9) AS mean_std, round(any_value(gs), 9) AS global_std FROM r JOIN g USING (channel) GROUP BY 1""",
    ),
    "standardize": (
        standardize,
        """WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings)
           SELECT vec_id, dim, round((x - ([0.1, 0.0, -0.1, 0.2]::DOUBLE[])[dim // 16 + 1]) / ([0.5, 0.25, 2.0, 1.0]::DOUBLE[])[dim // 16 + 1], 9) AS x FROM c""",
    ),
    "poly_features": (
        poly_features,
        """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(l_discount, 12) AS x1, round(pow(l_discount, 2), 12) AS x2,
                  round(pow(l_discount, 3), 12) AS x3, round(pow(l_discount, 4), 12) AS x4 FROM lineitem""",
    ),
}
