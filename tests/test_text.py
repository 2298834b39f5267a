import pytest
from pyspark.sql import functions as F

from trainframe.functions.text import normalize_answer, tokenize
from trainframe.operators import answers as N
from trainframe.operators import features as X
from trainframe.operators import sequences as Q
from trainframe.operators import vocabulary as V


def _one(spark, text, fn):
    return spark.createDataFrame([(text,)], "t string").select(fn(F.col("t")).alias("x")).first()["x"]


def test_tokenize(spark):
    assert _one(spark, 'He said: "Don\'t; stop." (Really?)<br />Yes!', tokenize) == ["he", "said", "don", "'", "t", "stop", ".", "(", "really", "?", ")", "yes", "!"]
    assert _one(spark, " \t\n", tokenize) == []


def test_normalize(spark):
    assert _one(spark, "The  Cat's (a) HAT, an éa theatre", normalize_answer) == "cats hat éa theatre"


def test_f1_and_exact_match(spark):
    rows = [
        (1, 0, ["a", "b", "b"], ["b", "b", "c", "d"]), (1, 1, ["a", "b", "b"], ["x"]),  # 2 of 3 and 2 of 4
        (2, 0, [], []), (3, 0, [], ["x"]), (4, 0, ["x"], ["y"]),
    ]
    df = spark.createDataFrame(rows, "q int, ref_no int, prediction_tokens array<string>, answer_tokens array<string>")
    got = {r["q"]: r["f1"] for r in N.token_f1_each(df, ["q"]).collect()}
    assert got[1] == pytest.approx(4 / 7) and (got[2], got[3], got[4]) == (1.0, 0.0, 0.0)
    pairs = spark.createDataFrame([(1, "The cat!", "dog"), (1, "The cat!", "a CAT"), (2, "x", "y")], "q int, prediction string, answer string")
    assert N.exact_match(pairs, ["q"]).first()["exact_match"] == 50.0


def test_vocabulary_and_lookup_beyond_the_head(spark):
    words = [w for w, n in (("b", 3), ("a", 3), ("z", 9), ("<pad>", 5), ("q", 1)) for _ in range(n)]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, token string")
    vocab = V.build_vocabulary(df.select("token"), specials=("<unk>", "<pad>")).cache()
    assert {r["token"]: (r["token_id"], r["freq"]) for r in vocab.collect()} == {"<unk>": (0, 0), "<pad>": (1, 0), "z": (2, 9), "a": (3, 3), "b": (4, 3), "q": (5, 1)}
    more = df.union(spark.createDataFrame([(99, "new")], df.schema))
    want = {r["i"]: r["token_id"] for r in V.lookup_ids(more, vocab).collect()}
    assert want[99] == 0 and len(want) == more.count()
    for head in (1, 3, 5):
        assert {r["i"]: r["token_id"] for r in V.lookup_ids(more, vocab, head=head).collect()} == want


def test_bptt_over_restart(spark):
    """500 equal tokens, batch 10, window 5: after one window on one replica, two replicas take nine steps."""
    stream = spark.range(500).select(F.col("id").alias("stream_pos"), F.lit(7).alias("token_id"), F.lit(500).cast("bigint").alias("n"))
    w = Q.bptt_windows(Q.reshape_columns(stream, 10, 1), 5, 1).toPandas()
    first = w[w["iteration"] == 0]
    assert len(first) == 10 and all(len(t) == 5 for t in first["text"])
    w = Q.bptt_windows(Q.reshape_columns(stream, 5, 1), 5, 2, current=10).toPandas()
    assert set(w["rank"]) == {0, 1} and w.groupby("rank")["iteration"].max().tolist() == [8, 8]
    assert {len(t) for t in w["text"]} == {4, 5}


@pytest.mark.parametrize("n,cols,bptt,replicas,cur", [(23, 4, 2, 2, 0), (23, 4, 2, 2, 1), (40, 3, 5, 1, 3), (7, 7, 3, 1, 0), (50, 3, 4, 3, 2)])
def test_bptt_brute_force(spark, n, cols, bptt, replicas, cur):
    stream = spark.range(n).select(F.col("id").alias("stream_pos"), (F.col("id") + 100).alias("token_id"), F.lit(n).cast("bigint").alias("n"))
    got = {(r["rank"], r["iteration"], r["col"]): (r["text"], r["target"]) for r in Q.bptt_windows(Q.reshape_columns(stream, cols, 1), bptt, replicas, cur).collect()}
    length = -(-n // cols)
    flat = [100 + i for i in range(n)] + [1] * (length * cols - n)
    want = {}
    steps = max(-(-(length - cur - bptt * (replicas - 1)) // (bptt * replicas)), 0)
    for rank in range(replicas):
        for it, i in enumerate(range(cur + bptt * rank, length, bptt * replicas)):
            size = min(bptt, length - i - 1)
            if it >= steps or size <= 0:
                continue
            for c in range(cols):
                col = flat[c * length : (c + 1) * length]
                want[(rank, it, c)] = (col[i : i + size], col[i + 1 : i + 1 + size])
    assert got == want


def test_pair_encoding(spark):
    df = spark.createDataFrame([(1, [5, 6], [7], 1), (2, [5] * 9, [7], 0)], "k int, first array<bigint>, second array<bigint>, label int")
    got = {r["k"]: (r["ids"], r["types"]) for r in Q.encode_pairs(df, 8, 3, 4, 1).collect()}
    assert got[1] == ([3, 5, 6, 4, 7, 4, 1, 1, 1], [0, 0, 0, 0, 1, 1, 1, 1, 1])
    assert got[2] == ([3] + [5] * 8, [0] * 9)


def test_pairs_swap_the_right_number(spark):
    df = spark.range(41).select("id", F.array(F.col("id"), F.col("id") + 1000).alias("ids"))
    halves = Q.sentence_halves(df, ["id"])
    out = Q.sentence_pairs(halves, ["id"], 0.5).toPandas()
    assert (out["label"] == 0).sum() == 20
    same = out[out["label"] == 1]
    assert all(s == [i + 1000] for i, s in zip(same["id"], same["second"].map(list)))
    assert all(s[0] < 1000 for s in out[out["label"] == 0]["second"])


def test_masks(spark):
    stream = spark.range(100).select(F.col("id").alias("stream_pos"), (F.col("id") + 10).alias("token_id"), F.lit(100).cast("bigint").alias("n"))
    b = Q.masked_batches(stream, 8, 4, 0.3, 2, 3).toPandas()
    assert b["batch_id"].nunique() == 3 and (b.groupby("batch_id")["masked"].sum() == 2).all()
    for r in b.itertuples():
        real = [r.batch_id * 32 + c * 8 + r.row - 1 + 10 for c in range(4)]
        assert list(r.ids) == ([3] * 4 if r.row == 0 else [2] * 4 if r.masked else real)
        assert not r.masked or list(r.target) == real


def test_argmax_and_polynomial(spark):
    from trainframe.operators.accumulate import argmax

    r = spark.range(1).select(argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("a"), X.polynomial(F.lit(2.0)).alias("p")).first()
    assert r["a"] == 1 and r["p"] == [2.0, 4.0, 8.0, 16.0]
