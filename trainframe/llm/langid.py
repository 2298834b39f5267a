"""Language of whole texts: families first, then one-versus-one linear support vector machines inside the family.

Features are shares of hashed byte n-grams of letters (A-Z lowered, everything but letters a blank). Training takes
about ``PER_LANGUAGE`` texts of each language, chosen by a hash of doc_id; the bound is a parameter. Languages with
close mean features join a family until there are about as many families as the square root of the number of languages. One machine per family
separates it from the rest; inside a family one machine per pair of languages votes. All machines are rows of one weight
table, so a text is scored in one pass over its bytes.

A null text or one without a letter is ``und`` with score 0. Without any training text everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainframe.llm import textscan as T

PER_LANGUAGE, FEATURES, ORDERS, PIECE_BYTES = 300, 1 << 13, (1, 2, 3), 1 << 20
MOST_BROADCAST = 10_000  # languages; their number is known before the join
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[0x80:] = np.arange(0x80, 0x100)


def grams(data: np.ndarray, offs: np.ndarray) -> Iterator[np.ndarray]:
    """Feature numbers of all n-grams of each order, aligned with the byte they begin at. Behind its end a text goes on with blanks."""
    gap = max(ORDERS) - 1
    at = np.arange(len(data)) + gap * np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    c = np.full(len(data) + gap * (len(offs) - 1), 32, np.uint32)
    c[at] = _FOLD[data]
    for n in ORDERS:
        h = np.full(len(at), n, np.uint32)
        for j in range(n):
            h = h * np.uint32(0x01000193) ^ c[at + j]
        yield (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - FEATURES.bit_length() + 1)


def _cut(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of rows (first, end, bytes, offsets) of bounded size; a longer text comes in pieces of ``PIECE_BYTES``, counted from its start."""
    row = 0
    while row < len(offs) - 1:
        to = max(row + 1, int(np.searchsorted(offs, offs[row] + PIECE_BYTES, "right")) - 1)
        for lo in range(int(offs[row]), max(int(offs[to]), int(offs[row]) + 1), PIECE_BYTES):
            hi = min(int(offs[to]), lo + PIECE_BYTES)
            yield row, to, data[lo:hi], offs[row : to + 1] - lo if to > row + 1 else np.array([0, hi - lo])
        row = to


def _scores(data: np.ndarray, offs: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Mean weight over the n-grams of each text, for every machine."""
    out = np.zeros((len(offs) - 1, weights.shape[1]))
    for row, to, part, at in _cut(data, offs):
        filled = np.flatnonzero(np.diff(at))
        if len(filled):
            for h in grams(part, at):
                out[row:to][filled] += np.add.reduceat(weights[h], at[:-1][filled], axis=0)
    return out / np.maximum(len(ORDERS) * np.diff(offs), 1)[:, None]


def _shares(texts: pa.Array) -> Iterator[np.ndarray]:
    """Share of every feature, text by text."""
    for text in texts:
        counts = np.zeros(FEATURES)
        for _, _, part, at in _cut(*T.flat(pa.array([text.as_py()], texts.type))):
            for h in grams(part, at):
                counts += np.bincount(h, minlength=FEATURES)
        yield counts / max(counts.sum(), 1)


def machine(x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Linear support vector machine through the origin: squared hinge loss, accelerated gradient steps, classes in balance."""
    w = v = np.zeros(x.shape[1])
    cost = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - 0.5 * (2 * penalty * v - 2 * ((cost * slack * y) @ x))
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def families_of(means: np.ndarray) -> list[list[int]]:
    groups = [[i] for i in range(len(means))]
    unit = means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
    near = unit @ unit.T
    while len(groups) > max(1, round(len(means) ** 0.5)):
        a, b = max(combinations(range(len(groups)), 2), key=lambda p: np.mean([near[i, j] for i in groups[p[0]] for j in groups[p[1]]]))
        groups[a] += groups.pop(b)
    return [sorted(g) for g in groups]


class Model:
    """Families of languages, and the weights of all machines side by side."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.names = sorted(set(langs))
        y = np.array([self.names.index(lang) for lang in langs], np.int64)
        self.families = families_of(np.stack([x[y == i].mean(0) for i in range(len(self.names))])) if self.names else []
        x = x.astype(np.float64)
        length = np.linalg.norm(x, axis=1, keepdims=True)
        self.scale = 1 / float(np.mean(length)) if len(x) else 1.0
        x = x / np.maximum(length, 1e-12)
        of = np.zeros(max(len(self.names), 1), np.int64)
        for f, group in enumerate(self.families):
            of[group] = f
        weights = [machine(x, np.where(of[y] == f, 1.0, -1.0)) for f in range(len(self.families))] if len(self.families) > 1 else []
        self.pairs = [p for group in self.families for p in combinations(group, 2)]
        for a, b in self.pairs:
            pick = (y == a) | (y == b)
            weights.append(machine(x[pick], np.where(y[pick] == a, 1.0, -1.0)))
        self.weights = (np.stack(weights, 1) if weights else np.zeros((FEATURES, 0))).astype(np.float32)

    def predict(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language of each text, and a score from 0 to 1 by the narrowest margin on the way."""
        s = _scores(data, offs, self.weights) * self.scale
        n = len(s)
        lang, margin = np.zeros(n, np.int64), np.full(n, 4.0)
        k = len(self.families) if len(self.families) > 1 else 0
        family = s[:, :k].argmax(1) if k else np.zeros(n, np.int64)
        if k:
            top = np.sort(s[:, :k], 1)
            margin = np.minimum(margin, (top[:, -1] - top[:, -2]) / 2)
        for f, group in enumerate(self.families):
            mine = family == f
            votes = np.zeros((int(mine.sum()), len(group)))
            for j, (a, b) in enumerate(self.pairs):
                if a in group:
                    got = s[mine, k + j]
                    votes[:, group.index(a)] += (got >= 0) + 0.1 * np.tanh(got)
                    votes[:, group.index(b)] += (got < 0) - 0.1 * np.tanh(got)
            best = votes.argmax(1)
            lang[mine] = np.array(group)[best]
            for j, (a, b) in enumerate(self.pairs):
                if a in group:
                    ours = np.where(np.array(group)[best] == a, s[mine, k + j], np.where(np.array(group)[best] == b, -s[mine, k + j], 4.0))
                    margin[mine] = np.minimum(margin[mine], ours)
        return lang, 1 / (1 + np.exp(-2 * margin))


def held_out() -> object:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """Train on a sample of the rows that are not held out. Its expected size, per_language texts of each language, is what the driver gets."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return Model(np.zeros((0, FEATURES)), [])
    rates = docs.sparkSession.createDataFrame([(k, min(1.0, per_language / n)) for k, n in counts.items()], "lang string, rate double")
    rates = F.broadcast(rates) if len(counts) <= MOST_BROADCAST else rates
    drawn = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 30)) < F.col("rate") * (1 << 30)

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", 1 << 20):
                got = [(np.flatnonzero(r).astype("<u2").tobytes(), r[r > 0].astype("<f4").tobytes()) for r in _shares(part.column("text"))]
                at, share = zip(*got, strict=True)
                yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(at, pa.binary()), pa.array(share, pa.binary())], ["lang", "at", "share"])

    got = rows.join(rates, "lang").where(drawn).where(F.col("text").rlike("\\p{L}")).select("lang", "text").mapInArrow(shares, "lang string, at binary, share binary").collect()
    got = sorted(got, key=lambda r: (r["lang"], bytes(r["share"])))
    x = np.zeros((len(got), FEATURES), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["share"], "<f4")
    return Model(x, [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text", 1 << 20):
                texts = part.column("text")
                data, offs = T.flat(texts)
                lettered = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                lang, score = model.predict(data, offs)
                known = lettered & (len(model.names) > 0)
                names = [model.names[k] if ok else "und" for k, ok in zip(lang.tolist(), known.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(np.where(known, score, 0.0))], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
