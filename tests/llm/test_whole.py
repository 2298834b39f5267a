"""Cases in which an operator once did less than its whole job."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.test_operators import by_id, components_of
from trainframe.llm import bwt, crf, forest, mixing, pq, template, tokens
from trainframe.llm.queries import bpe_path


def test_forest_in_a_hot_group(spark):
    """Near copies of one text, just too far from each other, of which each has about one true partner."""
    rng = random.Random(2)
    ids, rows = rng.sample(range(1000), 300), []
    for i in range(0, 300, 2):
        common = rng.sample(range(5, 995, 5), 3)
        for j in (i, i + 1):
            w = [f"w{x}" for x in range(1000)]
            for at in common + rng.sample(sorted(set(range(5, 995, 5)) - set(common)), 10):
                w[at] = f"x{i if at in common else ids[j]}y{at}"
            rows.append((ids[j], " ".join(w)))
    sets = {i: {tuple(w[j : j + 5]) for j in range(996)} for i, w in ((i, t.split()) for i, t in rows)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = components_of(links, sets)
    got = by_id(forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=5))
    assert {i: r["component_id"] for i, r in got.items()} == root


def test_texts_with_an_added_token():
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe_path())
    texts = ["hello <|endoftext|> world", "plain text", None, "<|endoftext|>", "é<|endoftext|><|endoftext|>x", "<|endoftext", "|>", "中 <|endoftext|>"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    ((_, ids, offs),) = tokens.encoded(batch, "text", bpe_path())
    assert [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:], strict=True)] == [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_cut_rows_of_equal_id_and_length(spark):
    copied = "a passage of more than fifty bytes that an earlier document holds, too. "
    texts = [copied + "x" * 40, copied + "y" * 40, "".join(chr(97 + i % 23) for i in range(7, 7 + len(copied) + 40)), copied + "z" * 40]
    rows = [(0, copied)] + [(None, t) for t in texts] + [(5, t) for t in texts[:3]]
    got = sorted((r["doc_id"] or -1, r["text"]) for r in bwt.cut_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["doc_id"] != 0)
    mine = ["x" * 40, "y" * 40, texts[2], "z" * 40]
    want = [(5, t) for t in mine[:3]] + [(-1, t) for t in ("z" * 40,)]
    assert [t for i, t in got if i == 5] == sorted(t for i, t in want if i == 5)
    assert "z" * 40 in [t for i, t in got if i == -1]


def test_vectors_of_low_rank(spark):
    """Partners at cosines just over 0.9 in eight dimensions of 32, over many lists: every ordered pair counts."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=x.shape)
    off -= (off * x).sum(1, keepdims=True) * x
    x = np.concatenate([x, 0.91 * x + np.sqrt(1 - 0.91**2) * off / np.linalg.norm(off, axis=1, keepdims=True)])
    x = x @ np.linalg.qr(rng.normal(size=(32, 8)))[0].T
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = (x @ x.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert [r["n_links"] for r in pq.vector_duplicates(df).orderBy("vec_id").collect()] == want.tolist()


def test_vectors_by_measured_margin(spark):
    """A margin for most partners: no link below the cosine, both ends of a link count it, and recall is near what was asked for."""
    rng = np.random.default_rng(4)
    for rank in (8, 32):
        x = rng.normal(size=(3000, rank))
        x = np.concatenate([x, x + rng.normal(size=x.shape) * 0.4])
        x = x @ np.linalg.qr(rng.normal(size=(32, rank)))[0].T
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= 0.9
        np.fill_diagonal(near, False)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = np.array([r["n_links"] for r in pq.vector_duplicates(df, recall=0.99).orderBy("vec_id").collect()])
        assert (got <= near.sum(1)).all() and got.sum() % 2 == 0 and got.sum() >= 0.97 * near.sum()
        sample = x[rng.permutation(len(x))]
        centres, _ = pq.fit(sample, 23)
        assert pq.margin_of(sample, centres, 0.9, 0.9) < pq.margin_of(sample, centres, 0.9, 0.99) < pq.margin_of(sample, centres, 0.9, 1.0)
    assert pq.margin_of(sample[:5], centres, 0.9, 0.99) == pq.margin_of(sample, centres, 0.9, 1.0)


def test_forest_at_another_threshold(spark):
    """A pair of similarity 0.74 is linked at 70 percent and not at 80."""
    w = [f"w{i}" for i in range(300)]
    v = list(w)
    for at in range(10, 300, 33):
        v[at] = f"x{at}"
    a, b = ({tuple(t[j : j + 5]) for j in range(296)} for t in (w, v))
    assert 0.7 < len(a & b) / len(a | b) < 0.8
    df = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(v))], "doc_id long, text string")
    got = {p: by_id(forest.near_duplicates(df, percent=p))[2]["component_id"] for p in (70, 80)}
    assert got == {70: 1, 80: 2}


def test_forest_rows_of_equal_id(spark):
    """Rows of one doc_id are one node, whatever texts they have."""
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    df = spark.createDataFrame([(0, a), (1, a), (1, b), (7, b), (8, "c d e")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"]) for r in forest.near_duplicates(df).collect()}
    assert got == {(0, 0), (1, 0), (7, 0), (8, 8)}


def test_forest_descends_in_large_regions(spark, monkeypatch):
    """Regions of many blocks, found by longer prefixes first, give the components of all pairs."""
    monkeypatch.setattr(forest, "BLOCK", 16)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(260):
        w = list(base)
        for at in rng.sample(range(120), rng.choice([1, 2, 3, 5, 7])):
            w[at] = f"x{rng.randrange(6)}y{at}"
        rows.append((i, " ".join(w)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(116)} for i, t in rows}
    links = [(x, y) for x in sets for y in sets if x < y and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y])]
    got = by_id(forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), k=5))
    assert {i: r["component_id"] for i, r in got.items()} == components_of(links, sets)


def test_labels_of_lines_vary_inside_a_document():
    """Documents are labelled, lines are not: clean lines of bad texts are content, a boilerplate tail of a good text is marked and the text kept."""
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdeilnorst"), rng.integers(2, 9))) for _ in range(400)]

    def prose():
        return " ".join(rng.choice(words, rng.integers(9, 16))).capitalize() + "."

    def junk():
        return " | ".join(w + "$$$" for w in rng.choice(words, rng.integers(3, 6)))

    texts, good = [], []
    for i in range(120):
        n = int(rng.integers(5, 9))
        texts.append("\n".join([prose() for _ in range(n)] + [junk()] * (i % 3 == 0) if i % 2 else [prose()] * (i % 4 == 0) + [junk() for _ in range(n)]))
        good.append(i % 2)
    s = crf.Scan(pa.array(texts))
    field = crf.fit_lines(s.x, s.line_chars, np.array(good), s.line_first)
    tail, head = [prose() for _ in range(6)] + [junk(), junk()], [prose()] + [junk() for _ in range(7)]
    texts = pa.array(["\n".join(tail), "\n".join(head), "\n".join(tail[:6]), ""])
    s = crf.Scan(texts)
    assert field.viterbi(s.x, s.line_first).tolist() == [1] * 6 + [0] * 2 + [1] + [0] * 7 + [1] * 6
    assert crf.judged(texts, field)[2].tolist() == [True, False, True, False]


def test_line_labels_keep_to_the_share_of_their_document():
    content = np.array([0.9, 0.1, 0.2, 0.3, 0.1, 0.8, 0.9, 0.7])
    chars, first = np.array([10, 10, 10, 10, 40, 5, 5, 5]), np.array([0, 4, 4, 8])
    assert crf.relabelled(content, chars, np.array([1, 0, 0]), first).tolist() == [1, 0, 0, 1, 0, 1, 1, 1]
    assert crf.relabelled(content, chars, np.array([1, 0, 1]), first).tolist() == [1, 0, 0, 1, 1, 1, 1, 1]
    assert crf.relabelled(content[:4], chars[:4], np.array([0]), np.array([0, 4])).tolist() == [1, 0, 0, 0]


def test_schedule_decides_the_mix(spark):
    """Slots by golden-ratio points in plain Python; blocks stand where these say, every prefix is near the weights, rows are written by first slot."""
    rng, block = random.Random(2), 16
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.choice([0, 1, 3, 30, 200]))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    sizes = mixing.document_sizes(docs)
    sources = mixing.targets_of(sizes)
    known = sorted((r for r in sources.collect() if r["words"] > 0), key=lambda r: r["sid"])
    need = {r["sid"]: -(-r["words"] // block) for r in known}
    total, slots, ends = sum(need.values()), {}, np.cumsum(list(need.values())) / sum(need.values())
    given = dict.fromkeys(need, 0)
    for i in range(total + 64):
        sid = list(need)[min(int(np.searchsorted(ends, (i * mixing.GOLDEN) % 1, "right")), len(need) - 1)]
        if given[sid] < need[sid]:
            slots[i] = (sid, given[sid])
            given[sid] += 1
    late = total + 64
    for sid, n in need.items():
        for k in range(given[sid], n):
            slots[late] = (sid, k)
            late += 1
    assert {r["slot"]: (r["sid"], r["k"]) for r in mixing.schedule(sources, block).collect()} == slots
    mixed = mixing.mix(sizes, sources, block=block).collect()
    words, first = {}, {}
    for r in mixed:
        words[r["slot"]] = words.get(r["slot"], 0) + r["hi"] - r["lo"]
        first[r["doc_id"], r["nth"]] = min(first.get((r["doc_id"], r["nth"]), r["slot"]), r["slot"])
    assert words == {i: min(block, next(r["words"] for r in known if r["sid"] == s) - k * block) for i, (s, k) in slots.items()}
    run = dict.fromkeys(need, 0)
    for n, i in enumerate(sorted(i for i in slots if i < total), 1):
        run[slots[i][0]] += 1
        assert all(abs(run[s] - n * need[s] / total) <= 3 + np.log2(n) for s in need)
    rows = mixing.mixed_counts(docs, block=block).collect()
    assert sorted((r["doc_id"], r["first_slot"]) for r in rows if r["taken"]) == sorted((d, i) for (d, _), i in first.items())
    got = [r["doc_id"] for r in mixing.mixed_documents(docs, block=block).select("doc_id").collect()]
    turns = {}
    for r in mixed:
        turns[r["doc_id"], r["nth"], r["pass"]] = min(turns.get((r["doc_id"], r["nth"], r["pass"]), r["slot"]), r["slot"])
    assert len(got) == len(turns)
    passes = [got[:i].count(d) for i, d in enumerate(got)]
    order = [turns[d, 1, p] for d, p in zip(got, passes, strict=True)]
    assert order == sorted(order)


def test_slots_of_pages_without_marks(spark):
    """Title, lead, subtitle and second part are all main text; menu, imprint and a notice on most pages are constant, whatever other pages look like."""
    menu, imprint = "<div><ul><li>Home</li><li>News</li></ul></div>", "<div><p>Imprint of the paper</p><p>All rights reserved</p></div>"
    notice = "<div><p>We moved</p><p>to a new</p><p>house</p></div>"

    def page(i, extra=""):
        return f"<html><body>{menu}<div><h1>Title {i}</h1><p>Lead of {i}.</p>{extra}<h2>Sub {i}</h2><p>Second part {i} is here too.</p></div>{imprint}</body></html>"

    def want(i):
        return f"Title {i}\nLead of {i}.\nSub {i}\nSecond part {i} is here too."

    hosts = {"six": [page(i) for i in range(6)], "four": [page(i) for i in range(4)], "empty": [page(i) for i in range(6)] + ["", None], "odd": [page(i) for i in range(6)] + ["<p>Other</p>"]}
    hosts["notice"] = [page(i, notice if i % 3 else "") for i in range(9)]
    texts = {h: [want(i) for i in range(len(p))] for h, p in hosts.items()}
    texts["empty"][6:] = ["", ""]
    texts["odd"][6] = "Other"
    hosts["equal"] = [page(1)] * 6
    texts["equal"] = [f"Home\nNews\n{want(1)}\nImprint of the paper\nAll rights reserved"] * 6
    story = "".join(f"<p>Part {k} of a story that all pages of this host print.</p>" for k in range(5))
    hosts["copied"] = [f"<html><body>{menu}<article><h1>Edition {i}</h1>{story}</article></body></html>" for i in range(6)]
    texts["copied"] = ["\n".join([f"Edition {i}", *(f"Part {k} of a story that all pages of this host print." for k in range(5))]) for i in range(6)]
    rows = [(n, f"http://{h}.example.com/{i}", p) for n, (h, i, p) in enumerate((h, i, p) for h in hosts for i, p in enumerate(hosts[h]))]
    got = by_id(template.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")), "page_id")
    assert [got[n]["text"] for n, *_ in rows] == [t for h in hosts for t in texts[h]]


def test_classes_by_brute_force(spark):
    """Root and nested classes equal those of whole occurrence vectors."""
    rng = random.Random(5)
    pages = []
    for i in range(40):
        parts = ["<div><p>a</p><p>b</p><p>c</p></div>"] + ["<div><p>d</p><p>e</p><p>f</p></div>"] * (i % 4 > 0) + ["<div><p>g</p><p>h</p><p>i</p></div>"] * (i % 3 == 0) + [f"<p>{rng.random()}</p>"]
        pages.append((i, "http://x.example/", "".join(parts)))
    vectors = {}
    for i, _, source in pages:
        for token, n in Counter(t[0] for t in template.Page(source).tokens if t[0]).items():
            vectors.setdefault(token, [0] * 40)[i] = n
    classes = {}
    for token, v in vectors.items():
        classes.setdefault(tuple(v), set()).add(token)
    valid = {v: c for v, c in classes.items() if sum(n > 0 for n in v) >= template.SUPPORT and len(c) >= template.LARGE}
    top = max((v for v in valid if max(v) == 1), key=lambda v: (sum(v), len(valid[v])))
    row = template.templates(spark.createDataFrame(pages, "page_id long, url string, html string")).first()
    assert set(row["root"]) == valid[top]
    assert {frozenset(c) for c in row["nested"] or []} == {frozenset(c) for v, c in valid.items() if v != top and 2 * sum(n > 0 for n in v) >= sum(top)}


def test_texts_are_numbered_without_a_shuffle_unless_ids_repeat(spark):
    """Only texts of repeated doc_ids meet the window; with many of them all do. Both ways number alike, null ids too."""
    rows = [(i, f"t{i}", "a") for i in range(40)] + [(3, "other", "b"), (3, "x", "a"), (None, "n", "a"), (None, "m", "b"), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = mixing.document_sizes(docs)
    got = mixing._numbered_rows(docs, sizes)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange hashpartitioning" not in plan.split("Window")[0]
    key = lambda df: sorted(map(str, df.collect()))
    assert key(got) == key(mixing._numbered_rows(docs, sizes, few=0))
    assert key(sizes.select("doc_id", "source", "nth")) == key(got.select("doc_id", "source", F.col("_nth").alias("nth")))
    assert mixing.mixed_documents(docs).agg(F.count_distinct("doc_id")).first()[0] == mixing.mixed_counts(docs).where("taken > 0").agg(F.count_distinct("doc_id")).first()[0]


def test_runs_part_by_part(monkeypatch):
    """Runs and their hashes do not depend on the parts, and a large chunk takes little memory beside its runs."""
    rng = np.random.default_rng(5)
    data = rng.integers(97, 123, 4 << 20, dtype=np.uint8)
    sizes = rng.integers(0, 3000, 2000)
    sizes[[3, 700]] = 0, 20000
    ends = np.cumsum(sizes)
    few = data[: ends[-1]]

    def all_of():
        first, count, m, doc = bwt.runs(few, ends)
        return first, count, m, doc, bwt.run_hashes(few, ends, first, count + bwt.LENGTH - 1)

    expected = all_of()
    for part in (1, 5000, 1 << 40):
        monkeypatch.setattr(bwt, "SLICE_BYTES", part)
        for a, b in zip(all_of(), expected, strict=True):
            assert a.dtype == b.dtype and np.array_equal(a, b)
    monkeypatch.undo()
    assert [len(a) for a in bwt.runs(few[:0], ends[:0])] == [0] * 4
    tracemalloc.start()
    first, count, _, _ = bwt.runs(data, np.arange(4096, len(data) + 1, 4096))
    bwt.run_hashes(data, np.arange(4096, len(data) + 1, 4096), first, count + bwt.LENGTH - 1)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 12 * len(data)


def test_open_strings_only(spark, monkeypatch):
    """Strings that share a smallest gram by chance stay out of the transforms; the others get the smallest doc_id there."""
    rng = np.random.default_rng(8)
    letters = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes()
    common, passage, seen, kept = letters(30), letters(90), [], bwt.repeated
    chance = [letters(rng.integers(20, 200)) + common + letters(rng.integers(20, 200)) for _ in range(200)]
    copied = [letters(40) + passage[i % 30 : 60 + i % 31] + letters(i) + passage[:55] for i in range(60)]
    even = [b"ab" * 100, b"a" * 300, b"a" * 300 + b"ab" * 30, b"abcdefghijklmnopqrstuvwxyz0123456789" * 9, letters(30) + b"abcdefghijklmnopqrstuvwxyz0123456789" * 4]

    def transform(text, length):
        seen.append(len(text))
        return kept(text, length)

    monkeypatch.setattr(bwt, "repeated", transform)
    for block in (1 << 18, 1000):  # one transform, and several
        monkeypatch.setattr(bwt, "TRANSFORM_BYTES", block)
        for texts, open_ in ((chance, 0), (chance + copied + even, 1)):
            data = np.frombuffer(b"".join(texts), np.uint8)
            first, count, m, doc = bwt.runs(data, np.cumsum([len(t) for t in texts]))
            size = count + bwt.LENGTH - 1
            assert len(np.unique(m)) < len(m) - 100
            where = bwt._ranges(first, count)
            string = [data[x : x + bwt.LENGTH].tobytes() for x in where]
            least = {}
            for s, d in zip(string, np.repeat(doc, count).tolist(), strict=True):
                least[s] = min(d, least.get(s, d))
            # equal runs count once with their smallest doc_id, as groups see them
            text = data[bwt._ranges(first, size)]
            keys = [data[x : x + k].tobytes() for x, k in zip(first, size, strict=True)]
            own = np.array([least_of for least_of in map({k: d for k, d in zip(keys[::-1], doc[::-1].tolist(), strict=True)}.get, keys)])
            seen.clear()
            got = bwt.earliest(text, size, own)
            assert got.tolist() == [least[s] for s in string]
            assert (len(seen) > 0) == bool(open_) and (len(seen) > 1) == (open_ and block == 1000) and sum(seen) < open_ * len(text) / 2 + 1
    monkeypatch.undo()
    rows = [(i, t.decode()) for i, t in enumerate(copied + even)] + [(90, "a" * 70000), (91, "b" + "a" * 80000), (92, "a" * 69999 + "c" + copied[5].decode())]
    first = {}
    for i, t in rows:
        for j in range(len(t) - 49):
            first.setdefault(t[j : j + 50], i)
    want = {}
    for i, t in rows:
        gone = bytearray(len(t))
        for j in range(len(t) - 49):
            if first[t[j : j + 50]] < i:
                gone[j : j + 50] = b"\1" * 50
        want[i] = sum(gone)
    assert {r["doc_id"]: r["n_removed"] for r in bwt.removal(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want
