"""Orders, shards, batches and splits over ``orders`` and ``documents``."""

from pyspark.sql import functions as F

from trainframe.operators import sampling as S
from trainframe.operators.blocked import step_block
from trainframe.session import table, written

SHUFFLED = """
o AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('7|2|0|' || o_orderkey), o_orderkey) - 1 AS pos,
             count(*) OVER () AS n FROM orders)"""

PADDED = f"""WITH {SHUFFLED},
b AS (SELECT *, 20 % n AS base FROM o),
s AS (SELECT o_orderkey, pos, n - base AS m, (pos - base) % 7 AS rank, (pos - base) // 7 AS k, 0 AS pad FROM b WHERE pos >= base
      UNION ALL
      SELECT o_orderkey, pos, n - base, pos, (n - base + 6) // 7 - 1, 1 FROM b
      WHERE pos < 7 AND (n - base) % 7 <> 0 AND pos >= (n - base) % 7)"""


def _order(spark, sf):
    return S.epoch_shuffle(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", seed=7, epoch=2)


def epoch_shuffle(spark, sf):
    return _order(spark, sf).select("o_orderkey", "pos", "n")


def epochs_shuffle(spark, sf):
    keys = table(spark, sf, "orders").select("o_orderkey")
    return S.epochs_shuffle(keys, "o_orderkey", [0, 1, 2], seed=7).select("epoch", "o_orderkey", "pos")


def natural_order(spark, sf):
    return S.natural_order(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", "pos")


def shards(spark, sf):
    return S.strided_shards(_order(spark, sf), 7, index=20).select("o_orderkey", "rank", "k")


def shards_padded(spark, sf):
    out = S.padded_shards(_order(spark, sf), 7, index=20)
    return out.select("o_orderkey", "rank", "k", F.col("pad").cast("int").alias("pad"))


def batches(spark, sf):
    out = S.batches(S.padded_shards(_order(spark, sf), 7, index=20), 100, 7)
    return out.select("o_orderkey", "rank", "batch_id", "slot")


def batches_drop_last(spark, sf):
    out = S.batches(S.padded_shards(_order(spark, sf), 7, index=20), 100, 7, drop_last=True)
    return out.groupBy("rank", "batch_id").agg(F.count("*").alias("n_rows"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))


def _segments(spark, sf):
    n = table(spark, sf, "orders").agg(F.count("*").alias("n")).scalar()
    r = F.col("r_regionkey").cast("bigint")
    runs = table(spark, sf, "region").withColumn("run", F.explode(F.array(F.lit(0), F.lit(1))))
    short = F.when(r < 4, F.floor(n * 3 / 1280))
    segs = runs.select("run", r.alias("seg"), (1 + 2 * r).alias("replicas"), F.when(F.col("run") == 0, short).otherwise(F.floor(n / 50) + r).alias("batches"))
    return S.resume_plan(segs, n, 64)


def resume_plan(spark, sf):
    return _segments(spark, sf).select("run", "seg", "replicas", "batches", "start", "end")


def elastic_resume(spark, sf):
    parts = written(S.resume_passes(_segments(spark, sf)), "parts")
    orders = S.passes_shuffle(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", parts, seed=7, epoch=2)
    return S.elastic_resume(orders, parts).select("run", "seg", "pass_no", "batch_no", "rank", "slot", "pos", "o_orderkey")


# Run 0 ends with its first pass, run 1 goes through several. w: batches to the end of the pass, v: batches of a whole pass.
RESUME = """
c AS (SELECT count(*) AS n FROM orders),
g AS (SELECT run, CAST(r_regionkey AS BIGINT) AS seg, 1 + 2 * CAST(r_regionkey AS BIGINT) AS replicas,
             CASE WHEN run = 1 THEN n // 50 + r_regionkey WHEN r_regionkey < 4 THEN n * 3 // 1280 END AS asked, n
      FROM region, c, (VALUES (0), (1)) AS r(run)),
h AS (SELECT *, replicas * ((64 + replicas - 1) // replicas) AS size, (n + replicas * ((64 + replicas - 1) // replicas) - 1) // (replicas * ((64 + replicas - 1) // replicas)) AS v FROM g),
e AS (SELECT run, -1::BIGINT AS seg, 0::BIGINT AS replicas, 0::BIGINT AS batches, 0::BIGINT AS w, 0::BIGINT AS v, 1::BIGINT AS size, 1::BIGINT AS n, 0::BIGINT AS "start", 0::BIGINT AS "end" FROM (VALUES (0), (1)) AS r(run)
      UNION ALL
      SELECT run, seg, replicas, b, w, v, size, n, s,
             CAST(CASE WHEN b < w THEN s + b * size
                       ELSE (s + w * size + n - 1) // n * n + (b - w) // v * ((v * size + n - 1) // n * n) + (b - w) % v * size END AS BIGINT)
      FROM (SELECT *, coalesce(asked, w) AS b
            FROM (SELECT h.*, e."end" AS s, (h.n - e."end" % h.n + h.size - 1) // h.size AS w FROM e JOIN h ON h.run = e.run AND h.seg = e.seg + 1))),
p AS (SELECT * FROM e WHERE seg >= 0),
q AS (SELECT *, CASE WHEN j = 0 THEN "start" ELSE ("start" + w * size + n - 1) // n * n + (j - 1) * ((v * size + n - 1) // n * n) END AS here,
             CASE WHEN j = 0 THEN 0 ELSE w + (j - 1) * v END AS b0
      FROM (SELECT *, unnest(range(1 + greatest(batches - w + v - 1, 0) // v)) AS j FROM p)),
t AS (SELECT run, seg, replicas, here // n AS pass_no, here % n AS base, b0, least(n, here % n + (batches - b0) * size) AS upto, size FROM q)"""

PASSES = """
o AS (SELECT pass_no, o_orderkey, row_number() OVER (PARTITION BY pass_no ORDER BY md5('7|2|' || pass_no || '|' || o_orderkey), o_orderkey) - 1 AS pos
      FROM orders, (SELECT DISTINCT pass_no FROM t))"""


def split_files(spark, sf):
    return S.split_files(table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


def split_ordered(spark, sf):
    return S.split_ordered(table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


def truncate_whole(spark, sf):
    return S.truncate_whole(_order(spark, sf), 64).select("o_orderkey", "pos")


def _loops(spark, sf):
    d = F.col("o_orderdate")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("run"),
        F.year(d).alias("epoch"),
        F.month(d).alias("loop_no"),
        "o_orderstatus",
    )


def skip_finished(spark, sf):
    loops = _loops(spark, sf)
    planned = loops.select("run", "epoch", "loop_no").distinct()
    return S.skip_finished(planned, loops.filter("o_orderstatus = 'F' and epoch < 1997"))


def committed_steps(spark, sf):
    ev = table(spark, sf, "events").select(
        "user_id", "event_id", "event_type", (F.col("event_type") != "error").alias("is_training"), "value"
    )
    kept = S.committed_steps(ev, ["user_id", "event_type"], "event_id", step_block("event_id"))
    return kept.select("event_id", "user_id", "event_type")


QUERIES = {
    "epoch_shuffle": (epoch_shuffle, f"WITH {SHUFFLED} SELECT o_orderkey, pos, n FROM o"),
    "epochs_shuffle": (
        epochs_shuffle,
        """SELECT e AS epoch, o_orderkey,
                  row_number() OVER (PARTITION BY e ORDER BY md5('7|' || e || '|0|' || o_orderkey), o_orderkey) - 1 AS pos
           FROM orders, range(3) r(e)""",
    ),
    "natural_order": (natural_order, "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders"),
    "shards": (
        shards,
        f"WITH {SHUFFLED} SELECT o_orderkey, (pos - 20 % n) % 7 AS rank, (pos - 20 % n) // 7 AS k FROM o WHERE pos >= 20 % n",
    ),
    "shards_padded": (shards_padded, f"{PADDED} SELECT o_orderkey, rank, k, pad FROM s"),
    "batches": (batches, f"{PADDED} SELECT o_orderkey, rank, k // 15 AS batch_id, k % 15 AS slot FROM s"),
    "batches_drop_last": (
        batches_drop_last,
        f"""{PADDED} SELECT rank, k // 15 AS batch_id, count(*) AS n_rows, min(o_orderkey) AS lo, max(o_orderkey) AS hi
            FROM s WHERE (k // 15 + 1) * 15 <= (m + 6) // 7 GROUP BY 1, 2""",
    ),
    "resume_plan": (resume_plan, f'WITH RECURSIVE {RESUME} SELECT run, seg, replicas, batches, "start", "end" FROM p'),
    "elastic_resume": (
        elastic_resume,
        f"""WITH RECURSIVE {RESUME}, {PASSES}
            SELECT run, seg, pass_no, b0 + (pos - base) // size AS batch_no, (pos - base) % size % replicas AS rank,
                   (pos - base) % size // replicas AS slot, pos, o_orderkey
            FROM o JOIN t USING (pass_no) WHERE pos >= base AND pos < upto""",
    ),
    "split_files": (
        split_files,
        """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('1000|' || doc_id), doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
           SELECT doc_id, CASE WHEN pos < n // 20 * 17 THEN 'train' WHEN pos < n // 20 * 18 THEN 'test' ELSE 'valid' END AS split FROM o""",
    ),
    "split_ordered": (
        split_ordered,
        """WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
           SELECT doc_id, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' WHEN pos < floor(n * 0.9::DOUBLE) THEN 'valid' ELSE 'test' END AS split FROM o""",
    ),
    "truncate_whole": (truncate_whole, f"WITH {SHUFFLED} SELECT o_orderkey, pos FROM o WHERE pos < n // 64 * 64"),
    "skip_finished": (
        skip_finished,
        """WITH l AS (SELECT o_custkey AS run, year(o_orderdate) AS epoch, month(o_orderdate) AS loop_no, o_orderstatus FROM orders),
           d AS (SELECT run, max(epoch * 100 + loop_no) AS last FROM l WHERE o_orderstatus = 'F' AND epoch < 1997 GROUP BY run)
           SELECT DISTINCT l.run, epoch, loop_no FROM l LEFT JOIN d ON l.run = d.run WHERE last IS NULL OR epoch * 100 + loop_no > last""",
    ),
    "committed_steps": (
        committed_steps,
        """SELECT event_id, user_id, event_type FROM (
             SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS idx FROM events)
           WHERE idx >= 1 AND event_type <> 'error'""",
    ),
}
