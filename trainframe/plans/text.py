"""Vocabulary, token streams, windows, masked batches and pairs over ``documents`` and ``conversations``."""

from pyspark.sql import functions as F

from trainframe.functions.text import tokenize
from trainframe.operators import dictionary as D
from trainframe.operators import sequences as Q
from trainframe.operators import vocabulary as V
from trainframe.session import spread, table


def tokens_sql(text: str) -> str:
    """SQL of the token rule, for DuckDB."""
    return (
        f"list_filter(string_split_regex(regexp_replace(regexp_replace(replace(lower({text}), '\"', ''), '<br />|[;:]', ' ', 'g'),"
        f" '([.,()!?''])', ' \\1 ', 'g'), '[ \\t\\n\\r\\f\\x0B]+'), lambda t: t <> '')"
    )


DOC_TOKENS = f"""
d AS (SELECT doc_id, {tokens_sql('text')} AS tokens FROM documents),
t AS (SELECT doc_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS i FROM d)"""

VOCAB = """
v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) + 4 AS token_id, count(*) AS freq FROM t
      WHERE token NOT IN ('<unk>', '<pad>', '<MASK>', '<cls>', '<sep>') GROUP BY token
      UNION ALL SELECT s, i, 0 FROM (VALUES ('<unk>', 0), ('<pad>', 1), ('<MASK>', 2), ('<cls>', 3), ('<sep>', 4)) x(s, i))"""

STREAM = f"""{DOC_TOKENS}, {VOCAB},
n AS (SELECT count(*) AS n FROM t),
s AS (SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS stream_pos, coalesce(token_id, 0) AS token_id FROM t LEFT JOIN v USING (token))"""


def _docs(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return docs.select("doc_id", tokenize(F.col("text")).alias("tokens"))


def _blocks(spark, sf):
    """Tokens of all documents, stored once as block dictionaries: for the vocabulary, for places and for the lookup."""
    return D.encode_blocks(_docs(spark, sf), ["doc_id"])


def _vocab(blocks):
    return V.build_vocabulary(D.word_counts(blocks), freq="freq")


def _stream(spark, sf):
    blocks = _blocks(spark, sf)
    return D.decode_blocks(blocks, _vocab(blocks), order="doc_id")


def tokens_per_document(spark, sf):
    return _docs(spark, sf).select("doc_id", F.size("tokens").alias("n_tokens"), F.md5(F.concat_ws(" ", "tokens")).alias("digest"))


def long_documents(spark, sf):
    return V.long_enough(_docs(spark, sf), F.col("tokens"), 100).select("doc_id", F.size("tokens").alias("n_tokens"))


def vocabulary(spark, sf):
    """Read once and only counted, so the tokens are counted as they come and nothing is stored."""
    return V.build_vocabulary(V.each_token(_docs(spark, sf)))


def token_ids(spark, sf):
    blocks = _blocks(spark, sf)
    ids = D.decode_blocks(blocks, _vocab(blocks))
    by_place = F.zip_with("ids", F.sequence(F.lit(0).cast("bigint"), F.size("ids").cast("bigint") - 1), lambda t, i: t * i)
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    return ids.filter(F.size("ids") > 0).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), total("ids").alias("sum_ids"), total(by_place).alias("weighted"))


def token_stream(spark, sf):
    return Q.token_stream(_docs(spark, sf), "doc_id").select("stream_pos", "token")


def bptt_windows(spark, sf):
    w = Q.bptt_windows(Q.reshape_columns(_stream(spark, sf), 10, 1), 35, 3, current=70)
    return w.select("rank", "iteration", "col", F.concat_ws(" ", "text").alias("text"), F.concat_ws(" ", "target").alias("target"))


def masked_batches(spark, sf):
    b = Q.masked_batches(_stream(spark, sf), 20, 32, 0.15, mask_id=2, cls_id=3, seed=5)
    return b.select("batch_id", "row", F.concat_ws(" ", "ids").alias("ids"), F.col("masked").cast("int").alias("masked"))


def masked_targets(spark, sf):
    b = Q.masked_batches(_stream(spark, sf), 20, 32, 0.15, mask_id=2, cls_id=3, seed=5)
    return b.filter("masked").select("batch_id", "row", F.concat_ws(" ", "target").alias("target"))


def _halves(spark, sf):
    rows = spread(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    blocks = D.encode_blocks(rows.select("conv_id", "turn", tokenize(F.col("text")).alias("tokens")), ["conv_id", "turn"])
    return Q.sentence_halves(D.decode_blocks(blocks, _vocab(blocks)), ["conv_id", "turn"], seed=11)


def sentence_halves(spark, sf):
    return _halves(spark, sf).select("conv_id", "turn", F.concat_ws(" ", "first").alias("first"), F.concat_ws(" ", "second").alias("second"))


def sentence_pairs(spark, sf):
    p = Q.encode_pairs(Q.sentence_pairs(_halves(spark, sf), ["conv_id", "turn"], 0.5, seed=11), 64, 3, 4, 1)
    return p.select("conv_id", "turn", "label", F.concat_ws(" ", "ids").alias("ids"), F.concat_ws(" ", "types").alias("types"))


def rescaled_start(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.length("text").cast("bigint").alias("len"))
    cur = F.floor(F.col("len") / 3)
    old, new = F.ceil(F.col("len") / 8), F.ceil(F.col("len") / 5)
    return d.select("doc_id", Q.rescaled_start(F.least(cur, old), old, new).alias("start"))


MASKED = f"""WITH {STREAM},
c AS (SELECT stream_pos // 640 AS batch_id, stream_pos % 640 // 20 AS c, stream_pos % 640 % 20 AS r, token_id FROM s, n WHERE stream_pos < n // 640 * 640),
l AS (SELECT batch_id, r, string_agg(token_id, ' ' ORDER BY c) AS ids FROM c GROUP BY 1, 2),
m AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY md5('5|' || batch_id || '|' || r), r) <= 3 AS masked FROM l)"""

HALVES = f"""
d AS (SELECT conv_id, turn, {tokens_sql('text')} AS tokens FROM conversations),
t AS (SELECT conv_id, turn, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS i FROM d), {VOCAB},
w AS (SELECT conv_id, turn, list(token_id ORDER BY i) AS ids FROM t JOIN v USING (token) GROUP BY 1, 2),
h AS (SELECT *, ('0x' || substr(md5('11|' || conv_id || '|' || turn), 1, 15))::BIGINT % (len(ids) - 1) + 1 AS cut FROM w WHERE len(ids) > 1),
g AS (SELECT conv_id, turn, ids[1:cut] AS f, ids[cut + 1:] AS s FROM h)"""

QUERIES = {
    "tokens_per_document": (
        tokens_per_document,
        f"WITH {DOC_TOKENS} SELECT doc_id, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS digest FROM d",
    ),
    "long_documents": (long_documents, f"WITH {DOC_TOKENS} SELECT doc_id, len(tokens) AS n_tokens FROM d WHERE len(tokens) >= 100"),
    "vocabulary": (vocabulary, f"WITH {DOC_TOKENS}, {VOCAB} SELECT token, token_id, freq FROM v"),
    "token_ids": (
        token_ids,
        f"""WITH {DOC_TOKENS}, {VOCAB} SELECT doc_id, count(*) AS n_tokens, CAST(sum(coalesce(token_id, 0)) AS BIGINT) AS sum_ids,
            CAST(sum(coalesce(token_id, 0) * i) AS BIGINT) AS weighted FROM t LEFT JOIN v USING (token) GROUP BY 1""",
    ),
    "token_stream": (token_stream, f"WITH {DOC_TOKENS} SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS stream_pos, token FROM t"),
    "bptt_windows": (
        bptt_windows,
        f"""WITH {STREAM},
        z AS (SELECT (n + 9) // 10 AS len, n FROM n),
        p AS (SELECT stream_pos, token_id FROM s UNION ALL SELECT unnest(range(n, len * 10)), 1 FROM z),
        c AS (SELECT stream_pos % len AS r, stream_pos // len AS col, token_id, len FROM p, z),
        u AS (SELECT *, lead(token_id) OVER (PARTITION BY col ORDER BY r) AS nxt, (r - 70) // 35 AS seg FROM c),
        k AS (SELECT *, greatest(CAST(ceil((len - 140) / 105.0) AS BIGINT), 0) AS steps FROM u WHERE r >= 70 AND r < len - 1)
        SELECT seg % 3 AS rank, seg // 3 AS iteration, col, string_agg(token_id, ' ' ORDER BY r) AS text, string_agg(nxt, ' ' ORDER BY r) AS target
        FROM k WHERE seg // 3 < steps GROUP BY 1, 2, 3""",
    ),
    "masked_batches": (
        masked_batches,
        f"""{MASKED} SELECT batch_id, r + 1 AS row, CASE WHEN masked THEN rtrim(repeat('2 ', 32)) ELSE ids END AS ids, masked::INT AS masked FROM m
            UNION ALL SELECT DISTINCT batch_id, 0, rtrim(repeat('3 ', 32)), 0 FROM m""",
    ),
    "masked_targets": (masked_targets, f"{MASKED} SELECT batch_id, r + 1 AS row, ids AS target FROM m WHERE masked"),
    "sentence_halves": (
        sentence_halves,
        f"WITH {HALVES} SELECT conv_id, turn, array_to_string(f, ' ') AS first, array_to_string(s, ' ') AS second FROM g",
    ),
    "sentence_pairs": (
        sentence_pairs,
        f"""WITH {HALVES},
        a AS (SELECT *, row_number() OVER (ORDER BY md5('11.left|' || conv_id || '|' || turn), conv_id, turn) - 1 AS at1,
                     row_number() OVER (ORDER BY md5('11.right|' || conv_id || '|' || turn), conv_id, turn) - 1 AS at2, count(*) OVER () AS n FROM g),
        b AS (SELECT x.conv_id, x.turn, x.f, coalesce(y.f, x.s) AS s, CASE WHEN y.f IS NULL THEN 1 ELSE 0 END AS label
              FROM a x LEFT JOIN a y ON x.at1 = y.at2 AND x.at1 < floor(x.n * 0.5)),
        e AS (SELECT conv_id, turn, label, len(f) AS lf, (f || [4] || s || [4])[1:64] AS q FROM b)
        SELECT conv_id, turn, label, array_to_string([3] || q || list_transform(range(64 - len(q)), lambda x: 1), ' ') AS ids,
               array_to_string(list_transform(range(65), lambda x: CASE WHEN x < least(lf + 1, 64) + 1 THEN 0 ELSE 1 END), ' ') AS types FROM e""",
    ),
    "rescaled_start": (
        rescaled_start,
        """WITH l AS (SELECT doc_id, length(text) AS len, (length(text) + 7) // 8 AS o, (length(text) + 4) // 5 AS w FROM documents)
           SELECT doc_id, CASE WHEN o = 0 THEN least(len // 3, o) ELSE CAST(ceil(least(len // 3, o) * w / o) AS BIGINT) END AS start FROM l""",
    ),
}
