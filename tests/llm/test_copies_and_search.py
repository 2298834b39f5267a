"""Exact copies, importance resampling and ranked search against plain Python, on nulls, ties, repeated rows, long texts,
clashing columns and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.test_operators import SCHEMA, make_texts
from trainframe.llm import dualtree, exact, resample, terms, textscan

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(UPPER))


@pytest.fixture(scope="module")
def rows():
    texts = [*make_texts(), None, "", "x" * 5000, "ÄÖ" * 3000 + " İ ß", "a\x00b c", "ab" * 9000, "ab" * 9000, "ba" * 9000]
    out = [(i, t) for i, t in enumerate(texts)]
    out += [(3, "one"), (3, "one"), (None, "one"), (None, texts[8]), (None, "only here, without an id"), (None, "only here, without an id"), (7, texts[9])]
    random.Random(8).shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None, None, None, "z", None) for i, t in rows], SCHEMA).repartition(4)


def expected_copies(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep, sha, left = (max(known) if known else None), hashlib.sha256(t.encode()).hexdigest(), True
        for i in sorted(ids, key=lambda i: -1 if i is None else i, reverse=True):
            out.append((i, keep, len(ids), left, sha))
            left = False
    return out


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("primes", "huge"), [(exact.PRIMES, exact.HUGE), (exact.PRIMES, 700), ((251,), 700), ((3,), 40000)])
def test_exact_duplicates(spark, docs, rows, primes, huge):
    """Also with texts hashed in pieces, and with primes so small that different texts share a fingerprint."""
    got = exact.exact_duplicates(docs, primes=primes, huge=huge)
    assert plain(got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")) == sorted(expected_copies(rows), key=repr)
    assert exact.exact_duplicates(docs.limit(0)).count() == 0


def test_colliding_texts_are_found_by_comparison(spark, docs):
    table = np.full(exact.WORDS, 2**64 - 1, np.uint64)
    assert exact.differing(exact.carriers(docs, table, (3,), exact.HUGE)).count() > 0
    assert exact.differing(exact.carriers(docs, table, exact.PRIMES, exact.HUGE)).count() == 0


def test_fingerprints_combine():
    """The fingerprint of a text is the sum of the terms of any pieces of it, and the polynomial by definition."""
    rng = np.random.default_rng(1)
    for n in (1, 5, exact.CHUNK, exact.CHUNK + 1, 3 * exact.CHUNK + 17):
        data = rng.integers(0, 256, n).astype(np.uint8)
        whole = exact.terms(data, np.array([0, n]), np.array([0]))[:, 0]
        for prime, base, got in zip(exact.PRIMES, exact.BASES, whole, strict=True):
            h = 0
            for b in data.tolist():
                h = (h * base + b) % prime
            assert h == got
        cuts = np.unique(np.concatenate([[0, n], rng.integers(0, n + 1, 4)]))
        parts = exact.terms(data, cuts, n - cuts[1:])
        assert (parts.sum(1) % np.array(exact.PRIMES, np.uint64) == whole).all()


def test_hot_group_is_one_group(spark):
    rows = [(i, "the same text " * 20) for i in range(3000)] + [(i, f"text {i}") for i in range(3000, 4000)]
    got = exact.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(16))
    kept = {r["doc_id"] for r in got.where("kept").collect()}
    assert kept == {2999, *range(3000, 4000)} and got.where("group_size = 3000").count() == 3000


@pytest.mark.parametrize("size", [0, 1, 4000])
def test_checksums(size):
    rng = random.Random(size)
    made = [bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 2, 3, 9, 30, 255, 256, 257, 900]))) for _ in range(size)]
    assert resample.checksums(pa.array(made, pa.binary())).tolist() == [zlib.crc32(x) for x in made]


@pytest.mark.parametrize("longest", [1, 3])
def test_features_in_order(longest):
    texts = make_texts()
    for run, (bucket, first) in enumerate(resample.features(pa.array(texts), longest, 997), 1):
        for i, t in enumerate(texts):
            w = words(t)
            assert bucket[first[i] : first[i + 1]].tolist() == [zlib.crc32(" ".join(w[j : j + run]).encode()) % 997 for j in range(len(w) - run + 1)]


def expected_draw(rows, target, longest, buckets, least, percent):
    grams = lambda t: [" ".join(w[j : j + n]) for w in [words(t)] for n in range(1, longest + 1) for j in range(len(w) - n + 1)]
    at = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = collections.Counter(at(f) for _, x in rows for f in grams(x)), collections.Counter(at(f) for x in target for f in grams(x))
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t)))
    out = []
    for i, x in rows:
        weight = sum(gain(at(f)) for f in grams(x))
        h = None if i is None else int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(grams(x)), weight, score, None, len(words(x))])
    able = sorted((r for r in out if r[0] is not None and r[5] >= least), key=lambda r: (-r[3], r[0], r[2], r[1]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize(("longest", "percent"), [(1, 10), (2, 60)])
def test_resampling(spark, docs, rows, longest, percent):
    target = [*make_texts()[8:14], None, "", "Other words 12"]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, doc_id string")
    got = resample.resampled(docs, frame, longest=longest, percent=percent)
    assert plain(got.select("doc_id", "n_features", "weight", "score", "rank")) == expected_draw(rows, target, longest, 10000, 20, percent)


def test_resampling_of_empty_tables(spark, docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample.resampled(docs.limit(0), none).count() == 0
    got = resample.resampled(docs, none)
    assert plain(got.select("doc_id", "n_features", "weight", "score", "rank")) == expected_draw(rows, [], 1, 10000, 20, 10)


def expected_ranks(rows, items, k):
    texts = [(i, words(t)) for i, t in rows]
    texts = [(i, w) for i, w in texts if w]
    n, total = len(texts), sum(len(w) for _, w in texts)
    df = collections.Counter(x for _, w in texts for x in set(w))
    tfs = [(i, len(w), collections.Counter(w)) for i, w in texts if i is not None]
    out = []
    for item, text in set(items):
        scored = []
        for i, size, tf in tfs:
            m = 100 - 90 + 90 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1000000000 * tf[x] // (1000 * tf[x] + 8 * m)) for x in set(words(text)) if tf[x])
            if score > 0:
                scored.append((-score, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "item_bytes", "seeds", "group"), [(10, 1 << 20, 4096, 8192), (3, 300, 10, 8192), (10, 1 << 20, 0, 20)])
def test_ranked_search(spark, docs, rows, monkeypatch, k, item_bytes, seeds, group):
    """Also with several blocks of items, few or no seeds, and many small groups."""
    monkeypatch.setattr(dualtree, "SEEDS", seeds)
    monkeypatch.setattr(dualtree, "GROUP", group)
    texts = make_texts()
    items = [(i, t) for i, t in enumerate([*texts[:20], "nowhere found", texts[8][:90], "é ß " + texts[20][:200]])] + [(5, texts[5]), (None, texts[9]), (1, texts[11])]
    frame = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int")
    got = dualtree.ranked(docs, frame, k=k, item_bytes=item_bytes)
    assert plain(got.select("item_id", "rank", "doc_id", "score")) == expected_ranks(rows, items, k)


def test_ranked_search_of_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dualtree.ranked(docs, none).count() == 0
    one = spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string")
    assert dualtree.ranked(docs.limit(0), one).count() == 0


def test_node_pairs_prune():
    """Over documents on separate subjects, an item scores few of them exactly and still gets the best ones of all."""
    rng = np.random.default_rng(5)
    subjects, per = 40, 100
    n_terms = subjects * 20
    ids, term = np.arange(subjects * per), np.concatenate([s * 20 + np.sort(rng.choice(20, 8, replace=False)) for s in range(subjects) for _ in range(per)])
    first = np.arange(0, len(term) + 1, 8)
    coord = dualtree.coordinates(np.repeat(rng.integers(8, 90, len(ids)), 8), rng.integers(1, 4, len(term)), len(ids), 40 * len(ids))
    vocab = [f"w{x:03d}" for x in range(n_terms)]
    items = dualtree.Items(list(range(subjects)), [" ".join(vocab[s * 20 : s * 20 + 6]) for s in range(subjects)] + [" ".join(vocab)])
    place = {w.as_py().decode(): i for i, w in enumerate(items.words)}
    term = np.array([place[vocab[t]] for t in term])
    items.terms, items.ids = items.terms[:subjects], items.ids[:subjects]
    items.weigh(np.bincount(term, minlength=n_terms), len(ids))
    order = np.random.default_rng(1).permutation(len(ids))
    shuffled = np.concatenate([np.arange(8) + 8 * r for r in order])
    group, best = dualtree.Group(ids[order], coord[shuffled], term[shuffled], first, items.weight), dualtree.Best(np.ones(subjects, np.int64), 10)
    group.search(items, best)
    assert group.scored < 0.1 * subjects * len(ids)
    for i, t in enumerate(items.terms):
        dense = np.zeros(n_terms, np.int64)
        dense[t] = items.weight[t]
        score = np.add.reduceat(coord * dense[term], first[:-1])
        want = np.lexsort((ids, -score))[:10]
        assert best.doc[i].tolist() == ids[want].tolist() and best.score[i].tolist() == score[want].tolist()


def test_words_of_bytes():
    texts = make_texts()
    found, index, first = terms.words(pa.array(texts))
    got = [[found[int(x)].as_py().decode() for x in index[a:b]] for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == [words(t) for t in texts]
    assert textscan.LOWER[65] == 97
