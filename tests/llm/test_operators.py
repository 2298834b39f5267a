"""Every corpus operator on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns,
against plain Python; and on an empty table."""

import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from trainframe.llm import bwt, crf, forest, huffman, langid, mixing, packing, pq, template, textscan, tokens, warc
from trainframe.llm.queries import bpe_path

WORD = "[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, rank int, size string, at double"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(WORD, t or "")


def make_texts():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    base = [" ".join(rng.choice(vocab) for _ in range(120)) for _ in range(6)]
    texts = [None, "", " \t\n", "one", "Two words", "two WORDS", "three little words", "中文 don't 'tis x'll  \n\n y\x1cz ÷ 3.14"]
    for b in base:
        w = b.split()
        texts += [b, b, b.upper(), " ".join(w[:60] + ["new"] + w[60:]), " ".join(w[:20]), "start " + b[100:300] + " end"]
    texts += [" ".join(rng.choice(vocab) for _ in range(9000)), "\n".join(["same line here"] * 12), base[0] + "\n" + base[1]]
    return texts


@pytest.fixture(scope="module")
def rows():
    texts = make_texts()
    ids = list(range(len(texts)))
    random.Random(5).shuffle(ids)
    return [(i, t, None if i % 7 == 0 else "xy"[i % 2], None if i % 5 == 0 else f"s{i % 3}", None, None, None, "z", None) for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def by_id(df, key="doc_id"):
    got = [r.asDict() for r in df.collect()]
    out = {r[key]: r for r in got}
    assert len(out) == len(got)
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_tokens_equal_library(library):
    rng = random.Random(1)
    parts = ["'s", "'t", "'re", "'ll", "'", "''", " ", "  ", "\n", "\t\n", "a", "B", "ß", "é", "÷", "×", "3", "42", ".", "!!", "’", "中", "\x1c", "don't", "'d ", "\r\n", "<|endoftext|>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [None]
    ids, offs = tokens.encoder(bpe_path()).encode(pa.array(texts))
    assert all(list(ids[offs[i] : offs[i + 1]]) == library(t) for i, t in enumerate(texts))


def test_huffman_files(spark, docs, none, rows, library):
    folder, lengths = huffman.encode_documents(docs, bpe_path(), 2)
    got, at = by_id(huffman.read_blocks(spark, folder, lengths, with_ids=True)), 0
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        ids = library(t) + [2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"], got[i]["ids"]) == (at, len(ids), crc(ids), ids)
        at += len(ids)
    folder, lengths = huffman.encode_documents(none, bpe_path(), 2)
    assert huffman.read_blocks(spark, folder, lengths).count() == 0


@pytest.mark.parametrize("limit", [11, 14, 30])
def test_code_lengths(limit):
    counts = np.bincount(np.random.default_rng(2).zipf(1.2, 20000) % 1500)
    size = huffman.code_lengths(counts, limit)
    assert size.max() <= limit and abs((2.0 ** -size[counts > 0].astype(float)).sum() - 1) < 1e-9
    import heapq

    heap = [(int(c), i, (i,)) for i, c in enumerate(counts) if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        cost += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], a[1], ()))
    assert (counts * size).sum() >= cost and (limit < 30 or (counts * size).sum() == cost)


def test_template(spark):
    pages, want = [], {}
    for i in range(8):
        body = [f"Title {i} &amp; more", f"First   paragraph\n{i} &lt;x&gt;.", f"Second {i}"]
        art = f"<h1>{body[0]}</h1><p><b>{body[1]}<br><p>{body[2]}<div class='ad'>buy</div>"
        if i % 2:
            art += "<section id=comments><p>reader says hi</p></section>"
        page = f"<html><head><title>t{i}</title></head><body><nav><a href=x>Menu {i}</a></nav><form>q</form><article>{art}<p>Always the same</p></article><aside>side</aside><footer>f{i}</footer>"
        pages.append((i, "http://a.example/x", page, "clash"))
        want[i] = "\n".join(" ".join(html.unescape(b).split()) for b in body)
    plain = "<html><body><div id=top>Menu</div><div><p>Long text of page {} goes on and on.</p><p>More of {}.</p></div><div id=end>Imprint</div></body></html>"
    for i in range(10, 16):
        pages.append((i, "http://b.example/", plain.format(i, i), None))
        want[i] = f"Long text of page {i} goes on and on.\nMore of {i}."
    pages += [(20, None, None, None), (21, "", "", None), (22, "bad", "just text <i>a", None), (23, "http://c.example", "<article>x" + " y" * 50000, None), (24, "http://c.example", "<nav>menu<article><p>text", None)]
    want |= {20: "", 21: "", 22: "just text a", 23: "x" + " y" * 50000, 24: "text"}
    got = by_id(template.main_text(spark.createDataFrame(pages, "page_id long, url string, html string, root string")), "page_id")
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert template.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def components_of(links, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("k", [4, 5])
def test_forest(docs, none, rows, k):
    sets = {}
    for i, t, *_ in rows:
        w = words((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    root = components_of(links, sets)
    got = by_id(forest.near_duplicates(docs, k=k))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}
    if k == 5:
        left = forest.deduplicated(docs)
        assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {i for i in sets if root[i] == i}
        assert forest.near_duplicates(none).count() == 0


def test_passages(spark, docs, none, rows):
    first, n = {}, 50
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        for j in range(len(b) - n + 1):
            first.setdefault(b[j : j + n], i)
    want = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - n + 1):
            if first[b[j : j + n]] < i:
                gone[j : j + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        want[i] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest(), kept)
    got = by_id(bwt.removal(docs))
    assert {i: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for i, r in got.items()} == {i: w[:4] for i, w in want.items()}
    cut = by_id(bwt.cut_documents(docs))
    for i, t, *_ in rows:
        assert cut[i]["text"] == (want[i][4].decode("utf-8", "ignore") if want[i][1] else t)
    assert bwt.removal(none).count() == 0 and bwt.cut_documents(none).count() == 0


def test_packing(docs, none, rows, library):
    got = [r.asDict() for r in packing.pack(packing.pieces(docs, bpe_path(), 0)).collect()]
    parts, bins = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        parts[r["doc_id"]].append(r)
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, t, *_ in rows:
        ids, at = library(t) + [0], 0
        for k, r in enumerate(sorted(parts[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"], r["ids_crc32"]) == (k, at, crc(ids[at : at + r["length"]])) and (k == 0 or r["length"] == 2048)
            at += r["length"]
        assert at == len(ids)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(packing.pieces(none, bpe_path(), 0)).count() == 0


@pytest.mark.parametrize("kind", ["wide", "short", "exact"])
def test_plan_is_close_to_the_bound(kind):
    rng = np.random.default_rng(4)
    length = {"wide": rng.integers(1, 2048, 30000), "short": np.minimum(np.exp(rng.normal(5.5, 1, 40000)).astype(int) + 1, 2048), "exact": np.repeat([700, 700, 648], 500)}[kind]
    _, n = packing.plan(np.bincount(length, minlength=2049))
    assert n <= 1.03 * max(np.ceil(length.sum() / 2048), (length > 1024).sum())


def test_mixing(docs, none, rows):
    got = by_id(mixing.mixed_counts(docs, block=64))
    size, total = {i: len(words(t)) for i, t, *_ in rows}, collections.Counter()
    taken = collections.Counter()
    for i, _, _, s, *_ in rows:
        total[s] += size[i]
        taken[s] += got[i]["taken"]
        assert got[i]["size"] == size[i] and 0 <= got[i]["taken"] <= 2 * size[i]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    target, left, open_ = {}, 1.5 * sum(total.values()), list(order)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    while True:
        over = [s for s in open_ if left * weight[s] / sum(weight[o] for o in open_) > 2 * total[s]]
        if not over:
            break
        target |= {s: 2.0 * total[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ = [s for s in open_ if s not in over]
    target |= {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
    for i, _, _, s, *_ in rows:
        assert got[i]["source_size"] == total[s] and abs(got[i]["target"] - target[s]) < 1e-6
    assert all(abs(taken[s] - target[s]) <= 1 for s in total)
    assert got == by_id(mixing.mixed_counts(docs.repartition(5), block=64))
    mixed = collections.Counter()
    for r in mixing.mixed_documents(docs, block=64).collect():
        mixed[r["doc_id"]] += len(words(r["text"]))
    assert mixed == {i: r["taken"] for i, r in got.items() if r["taken"]}
    assert mixing.mixed_counts(none).count() == 0 and mixing.mixed_documents(none).count() == 0


def test_warc(spark):
    long = "<p>" + "é" * 200
    pages = [(5, "http://a/\r\nb", long, 1), (2, None, long, 2), (9, "u", long, 3), (1, "v", "short", 4), (3, "v", "short", 5), (4, "v", None, 6), (6, "w", "a\r\n\r\nWARC/1.1" * 20, 7)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, refers_to long")
    got = by_id(warc.round_trip(df), "page_id")
    for i, _, h, _ in pages:
        raw = (h or "").encode()
        again = h == long and i != 2
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", 2 if again else None)
    folder = warc.scratch(spark, "warc")
    index = warc.write_archives(df, folder)
    one = warc.read_records(index.where("page_id = 6"), folder, with_payload=True).collect()
    assert [r["html"] for r in one] == [pages[-1][2]]
    assert warc.round_trip(df.limit(0)).count() == 0
    other = "<i>" + "x" * 200
    twice = spark.createDataFrame([(1, "a", long), (1, "a", other), (5, "b", long), (5, "b", other), (5, "b", long), (None, "c", long)], "page_id long, url string, html string")
    got = collections.Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(twice).collect())
    assert got == {(1, 403, "response", None): 1, (1, 203, "response", None): 1, (5, 403, "revisit", 1): 2, (5, 203, "revisit", 1): 1, (None, 403, "response", None): 1}
    assert warc.coalesced([0, 10, 500], [10, 5, 20], gap=100) == [(0, 15), (500, 520)]


def test_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 12))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, base[:20] + rng.normal(size=(20, 12)) * 0.15, base[:5]]))]
    rows += [(100, None, 1), (101, [0.0] * 12, 1), (102, [float("nan")] * 12, 1), (103, [1.0, None], 1), (104, [float("inf"), 1.0], 1), (105, [1.0], 1), (106, [2.0], 1), (107, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    fine = {i: np.pad(np.array(v, float), (0, 12 - len(v))) for i, v, _ in rows if i < 100 or i in (105, 106)}
    links = [(a, b) for a in fine for b in fine if a < b and fine[a] @ fine[b] / np.linalg.norm(fine[a]) / np.linalg.norm(fine[b]) >= 0.9]
    root, n = components_of(links, [r[0] for r in rows]), collections.Counter(x for link in links for x in link)
    got = by_id(pq.vector_duplicates(df), "vec_id")
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (n[i], root[i], root[i] == i) for i in root}
    assert pq.vector_duplicates(df.limit(0)).count() == 0


def test_language(spark, docs, none, rows):
    rng = random.Random(8)
    texts = {"aa": "abcd ", "bb": "abce ", "yy": "wxyz ", "zz": "wxyv "}
    made = [(i, "".join(rng.choice(texts[k]) for _ in range(200)), k, "s", 0) for i, k in enumerate(list(texts) * 60)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, score long")
    got = by_id(langid.identify(df, langid.fit(df)))
    held = {i for i, *_ in made if zlib.crc32(str(i).encode()) % 5 == 0}
    assert {i for i, r in got.items() if r["held_out"]} == held
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert sum(got[i]["lang_pred"] == k for i, _, k, *_ in made if i in held) >= 0.95 * len(held)
    model = langid.fit(docs)
    got = by_id(langid.identify(docs, model))
    assert all((got[i]["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", t or "")) for i, t, *_ in rows)
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(none)).collect()} == {"und"} and langid.identify(none, model).count() == 0


def test_language_of_a_text_does_not_depend_on_its_neighbours(rows, monkeypatch):
    texts = [t for _, t, *_ in rows]
    weights = np.random.default_rng(4).normal(size=(langid.FEATURES, 3)).astype(np.float32)

    def brute(t):
        c = [32 if b < 128 and not chr(b).isalpha() else b for b in (t or "").translate(LOWER).encode()]
        total = np.zeros(3)
        for i in range(len(c)):
            for n in langid.ORDERS:
                h = n
                for b in (c[i : i + n] + [32] * n)[:n]:
                    h = h * 0x01000193 % 2**32 ^ b
                total += weights[(h * 0x9E3779B1 % 2**32) >> (33 - langid.FEATURES.bit_length())]
        return total / max(len(c) * len(langid.ORDERS), 1)

    want = np.stack([brute(t) for t in texts])
    assert np.allclose(langid._scores(*textscan.flat(pa.array(texts)), weights), want, atol=1e-4)
    shares = np.stack(list(langid._shares(pa.array(texts))))
    assert np.allclose(shares @ weights, want, atol=1e-4)
    monkeypatch.setattr(langid, "PIECE_BYTES", 1000)
    together = langid._scores(*textscan.flat(pa.array(texts)), weights)
    alone = np.concatenate([langid._scores(*textscan.flat(pa.array([t], pa.string())), weights) for t in texts])
    assert np.allclose(together, alone, atol=1e-6)


def test_quality(spark, docs, none, rows):
    labels = spark.createDataFrame([(i, None if i % 9 == 0 else int(i % 3 > 0), 0) for i, *_ in rows] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    for field in (crf.fit(docs, labels), crf.fit(docs, labels.limit(0))):
        got = by_id(crf.rules(docs, field))
        for i, t, *_ in rows:
            w, t = words(t), t or ""
            seen = collections.Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
            cover = {j + d for j in range(len(w) - 4) if seen[tuple(w[j : j + 5])] > 1 for d in range(5)}
            lines = [x for x in t.split("\n") if words(x)]
            failed = len(w) < 10 or 100 * len(cover) > 20 * len(w)
            r = got[i]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), failed)
            assert not (failed and r["kept"])
        assert {r["doc_id"] for r in crf.kept_documents(docs, field).collect()} == {i for i, r in got.items() if r["kept"]}
    assert crf.rules(none, crf.fit(none, labels)).count() == 0


def test_viterbi_and_gradient_by_enumeration():
    import itertools

    rng = np.random.default_rng(9)
    first = np.array([0, 3, 3, 4, 8])
    x, y = rng.normal(size=(8, crf.FEATURES)), rng.integers(0, 2, 8)
    field = crf.Field()
    field.w, field.t = rng.normal(size=field.w.shape), rng.normal(size=field.t.shape)

    def score(a, b, labels):
        return sum((x[a + i] @ field.w)[v] for i, v in enumerate(labels)) + sum(field.t[p, q] for p, q in zip(labels, labels[1:], strict=False))

    def likelihood():
        return sum(score(a, b, tuple(y[a:b])) - np.logaddexp.reduce([score(a, b, v) for v in itertools.product((0, 1), repeat=b - a)]) for a, b in zip(first, first[1:], strict=False) if b > a)

    best = np.concatenate([max(itertools.product((0, 1), repeat=b - a), key=lambda v: score(a, b, v)) for a, b in zip(first, first[1:], strict=False)])
    assert (field.viterbi(x, first) == best).all()
    gw, gt = field.gradient(x, y, first)
    for array, grad, at in ((field.w, gw, (2, 1)), (field.w, gw, (5, 0)), (field.t, gt, (0, 1)), (field.t, gt, (1, 1))):
        up = likelihood()
        array[at] += 1e-5
        assert abs((likelihood() - up) / 1e-5 - grad[at]) < 1e-3
        array[at] -= 1e-5


def test_rows_without_an_id(spark):
    df = spark.createDataFrame([(None, "alpha beta gamma delta " * 20, "x", "s", 1), (1, "alpha beta gamma delta " * 20, "x", "s", 1), (1, "alpha beta gamma delta " * 20, "x", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r["doc_id"] is None, r["component_id"], r["kept"]) for r in forest.near_duplicates(df).collect()) == [(False, 1, True), (False, 1, True), (True, None, True)]
    got = sorted(((r["doc_id"] is None, r["n_removed"] > 0) for r in bwt.removal(df).collect()))
    assert got == [(False, False), (False, False), (True, True)]
    folder, lengths = huffman.encode_documents(df, bpe_path(), 2)
    assert [r["doc_id"] for r in huffman.read_blocks(spark, folder, lengths).orderBy("start").collect()] == [None, 1, 1]
    assert packing.pack(packing.pieces(df, bpe_path(), 0)).count() == 3
    assert mixing.mixed_counts(df).count() == 3 and langid.identify(df, langid.fit(df)).count() == 3
    assert crf.rules(df, crf.Field()).count() == 3


def test_word_counts():
    assert textscan.word_counts(pa.array(["a b", None, "", " x y ", "\x1ca"])).tolist() == [2, 0, 0, 1, 1]
