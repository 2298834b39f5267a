"""Block dictionaries and slices of the token stream: values against plain Python, and what the plans shuffle."""

import random

import pytest

from trainframe.operators import dictionary as D
from trainframe.operators import sequences as Q
from trainframe.operators import vocabulary as V

SCHEMA = "id long, kind string, tokens array<string>"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocab = [f"t{i}" for i in range(60)]
    out = [(i, None if i % 5 == 0 else "k", [rng.choice(vocab[: 2 + i % 59]) for _ in range(rng.choice([0, 1, 3, 40]))]) for i in range(0, 400, 3)]
    out += [(1000, "k", None), (1001, "k", []), (1002, "k", ["t1", None, "new"]), (1003, "k", ["hot"] * 700)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame([(f"t{i}", i + 5) for i in range(60)] + [("hot", 99)], "token string, token_id long")


@pytest.mark.parametrize("block_tokens", [1, 50, 1 << 20])
def test_ids_and_places(spark, rows, vocab, block_tokens):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    blocks = D.encode_blocks(df, ["id", "kind"], block_tokens=block_tokens)
    known = {f"t{i}": i + 5 for i in range(60)} | {"hot": 99}
    at, want = 0, {}
    total = sum(len(t or []) for _, _, t in rows)
    for i, kind, tokens in sorted(rows, key=lambda r: r[0]):
        want[i] = (kind, [known.get(t, 7) for t in tokens or []], at, total)
        at += len(tokens or [])
    got = {r["id"]: (r["kind"], r["ids"], r["start"], r["n"]) for r in D.decode_blocks(blocks, vocab, unk_id=7, order="id").collect()}
    assert got == want
    assert {r["id"]: r["ids"] for r in D.decode_blocks(blocks, vocab, unk_id=7).collect()} == {i: w[1] for i, w in want.items()}


def test_empty_table(spark, vocab):
    blocks = D.encode_blocks(spark.createDataFrame([], SCHEMA), ["id"])
    assert D.decode_blocks(blocks, vocab, order="id").count() == 0
    assert V.build_vocabulary(D.word_counts(blocks), freq="freq").count() == len(V.SPECIALS)


def test_vocabulary_of_blocks_equals_that_of_tokens(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    of_tokens = V.build_vocabulary(V.each_token(df)).collect()
    of_blocks = V.build_vocabulary(D.word_counts(D.encode_blocks(df, ["id"], block_tokens=100)), freq="freq").collect()
    assert sorted(map(tuple, of_blocks)) == sorted(map(tuple, of_tokens))


def test_no_token_becomes_a_row(spark, rows, vocab):
    """Every generated row is a distinct word of a block, a row's size, or a slice; tokens stay in arrays."""
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    blocks = D.encode_blocks(df, ["id"])
    assert D.word_counts(blocks).count() <= 3 * 62
    stream = D.decode_blocks(blocks, vocab, order="id")
    slices = Q.reshape_columns(stream, 4, 1)
    assert slices.count() <= len(rows) + 4
    n = sum(len(t or []) for _, _, t in rows)
    parts = Q.bptt_windows(slices, 35, 2)
    text = parts._jdf.queryExecution().executedPlan().toString()
    assert "posexplode(tokens" not in text and "explode(ids" not in text
    assert n > 1500 and parts.count() < n / 10


@pytest.mark.parametrize("cuts", [[0, 23], [0, 1, 2, 23], [0, 7, 7, 20, 23]])
def test_slices_of_any_pieces_give_the_same_windows(spark, cuts):
    """However the stream is cut into pieces, windows and batches are those of single tokens."""
    n = 23
    whole = spark.createDataFrame([(a, list(range(100 + a, 100 + b)), n) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], "start long, ids array<long>, n long")
    each = spark.createDataFrame([(i, 100 + i, n) for i in range(n)], "stream_pos long, token_id long, n long")
    for make in (
        lambda s: Q.bptt_windows(Q.reshape_columns(s, 4, 1), 2, 2, 1),
        lambda s: Q.bptt_windows(Q.reshape_columns(s, 3, 1), 5, 1, 3),
        lambda s: Q.masked_batches(s, 3, 2, 0.4, 2, 3),
    ):
        assert sorted(map(repr, make(whole).collect())) == sorted(map(repr, make(each).collect()))
