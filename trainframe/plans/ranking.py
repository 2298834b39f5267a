"""Recommendation data over ``orders`` and ``lineitem``: customers are users, parts are items."""

from pyspark.sql import functions as F

from trainframe.operators import interactions as I
from trainframe.operators import ranking as R
from trainframe.operators.position import seeded_draw
from trainframe.session import sized, table, written


def _orders_and_lines(spark, sf):
    """Orders and their lines, dealt alike to as many tasks as the number of lines asks for, and that number."""
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("user"), "o_orderdate")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").alias("item"))
    n = li.count()
    return sized(o, n, "o_orderkey"), sized(li, n, "o_orderkey"), n


def _bought(spark, sf):
    o, li, _ = _orders_and_lines(spark, sf)
    return o.join(li, "o_orderkey")


def _item_num(df):
    return I.cardinality(df).select("item_num").scalar()


def _pairs(spark, sf):
    """Distinct pairs, stored once for the several reads of the sampling; sorted, so that they compress."""
    return written(distinct_interactions(spark, sf).sortWithinPartitions("user", "item"), "pairs")


def distinct_interactions(spark, sf):
    o, li, n = _orders_and_lines(spark, sf)
    return I.distinct_interactions(o.join(li, "o_orderkey"), n)


def cardinality(spark, sf):
    return I.cardinality(_bought(spark, sf))


def _negatives(spark, sf, num_ng):
    pos = _pairs(spark, sf)
    return I.negatives(pos, pos, _item_num(pos), num_ng, seed=3)


def negatives(spark, sf):
    return _negatives(spark, sf, 4)


def negatives_are_new(spark, sf):
    """Drawn items that the user did interact with, counted per user: all zero."""
    pos = _pairs(spark, sf)
    n = 5 * pos.count()
    negs = sized(I.negatives(pos, pos, _item_num(pos), 4, seed=3), n, "user", "neg")
    seen = sized(pos.withColumnRenamed("item", "neg").withColumn("seen", F.lit(1)), n, "user", "neg")
    return negs.join(seen, ["user", "neg"], "left").groupBy("user").agg(
        F.count("*").alias("drawn"), F.coalesce(F.sum("seen"), F.lit(0)).alias("clashes")
    )


def train_triples(spark, sf):
    pos = _pairs(spark, sf)
    return I.train_triples(pos, I.negatives(pos, pos, _item_num(pos), 4, seed=3))


def _truth(spark, sf):
    """Each user's last item. An order has one date, so only its largest item can be the last; fewer rows go to the users."""
    o, li, _ = _orders_and_lines(spark, sf)
    lasts = o.join(li.groupBy("o_orderkey").agg(F.max("item").alias("item")), "o_orderkey")
    return written(I.hold_out_last(lasts, "o_orderdate"), "truth")


def _scored(spark, sf):
    pos = _pairs(spark, sf)
    truth = _truth(spark, sf)
    negs = I.negatives(truth, pos, _item_num(pos), 99, seed=9)
    cand = I.candidates(truth, negs)
    a, b = (seeded_draw(s, "user", "item") / F.lit(float(2**60)) for s in ("a", "b"))
    return cand.withColumn("score", R.blend(a, b))


def score_blend(spark, sf):
    return _scored(spark, sf).select("user", "position", "item", F.round("score", 9).alias("score"))


def top_k(spark, sf):
    return R.top_k(_scored(spark, sf), 10).select("user", "rank", "item", "position")


def user_metrics(spark, sf):
    return R.user_metrics(_scored(spark, sf), 10).select("user", "hit", F.round("ndcg", 9).alias("ndcg"))


def ranking_metrics(spark, sf):
    m = R.ranking_metrics(_scored(spark, sf), 10)
    return m.select("users", F.round("hit_rate", 9).alias("hit_rate"), F.round("ndcg", 9).alias("ndcg"))


BOUGHT = """
b AS (SELECT o_custkey AS u, l_partkey AS i, o_orderdate AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
p AS (SELECT DISTINCT u, i FROM b),
m AS (SELECT max(i) + 1 AS item_num FROM b),
g AS (SELECT u, list(i ORDER BY i) AS ps FROM p GROUP BY u)"""


def draws_sql(rows: str, seed: int, num: int) -> str:
    """CTEs that take each row's draws to the r-th missing item by counting over the user's sorted items."""
    return f"""
f AS (SELECT x.u, x.i, k, ps, ('0x' || substr(md5('{seed}|' || x.u || '|' || x.i || '|' || k), 1, 15))::BIGINT % (item_num - len(ps)) AS r
      FROM {rows} x JOIN g ON x.u = g.u, m, range(1, {num + 1}) z(k) WHERE item_num > len(ps)),
q AS (SELECT u, i, k, r + len(list_filter(ps, lambda v, j: v - (j - 1) <= r)) AS neg FROM f)"""


SCORED = f"""WITH {BOUGHT},
l AS (SELECT u, arg_max(i, (d, i)) AS i FROM b GROUP BY u), {draws_sql('l', 9, 99)},
c AS (SELECT u, 0 AS position, i FROM l UNION ALL SELECT u, k, neg FROM q),
s AS (SELECT *, 0.5::DOUBLE * (('0x' || substr(md5('a|' || u || '|' || i), 1, 15))::BIGINT / 1152921504606846976::DOUBLE)
              + 0.5::DOUBLE * (('0x' || substr(md5('b|' || u || '|' || i), 1, 15))::BIGINT / 1152921504606846976::DOUBLE) AS score FROM c),
t AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, position) - 1 AS rank FROM s),
h AS (SELECT u, max((position = 0 AND rank < 10)::INT) AS hit, max(CASE WHEN position = 0 AND rank < 10 THEN 1 / log2(rank + 2) ELSE 0 END) AS ndcg FROM t GROUP BY u)"""

QUERIES = {
    "ranking_metrics": (
        ranking_metrics,
        f"{SCORED} SELECT count(*) AS users, round(avg(hit), 9) AS hit_rate, round(avg(ndcg), 9) AS ndcg FROM h",
    ),
    "user_metrics": (user_metrics, f"{SCORED} SELECT u AS user, hit, round(ndcg, 9) AS ndcg FROM h"),
    "top_k": (top_k, f"{SCORED} SELECT u AS user, rank, i AS item, position FROM t WHERE rank < 10"),
    "score_blend": (score_blend, f"{SCORED} SELECT u AS user, position, i AS item, round(score, 9) AS score FROM s"),
    "distinct_interactions": (distinct_interactions, f"WITH {BOUGHT} SELECT u AS user, i AS item FROM p"),
    "cardinality": (cardinality, f"WITH {BOUGHT} SELECT max(u) + 1 AS user_num, max(i) + 1 AS item_num FROM b"),
    "negatives": (negatives, f"WITH {BOUGHT}, {draws_sql('p', 3, 4)} SELECT u AS user, i AS item, k AS ng_no, neg FROM q"),
    "negatives_are_new": (
        negatives_are_new,
        f"""WITH {BOUGHT}, {draws_sql('p', 3, 4)} SELECT q.u AS user, count(*) AS drawn, count(p.u) AS clashes
            FROM q LEFT JOIN p ON q.u = p.u AND q.neg = p.i GROUP BY 1""",
    ),
    "train_triples": (
        train_triples,
        f"WITH {BOUGHT}, {draws_sql('p', 3, 4)} SELECT u AS user, i AS item, 1 AS label FROM p UNION ALL SELECT u, neg, 0 FROM q",
    ),
}
