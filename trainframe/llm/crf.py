"""Quality rules: a linear-chain conditional random field labels each line content or boilerplate.

The field is trained on whole texts of a bounded sample of labelled documents (``PER_CLASS`` of good and of bad quality,
of at most ``LINES`` lines each). Only documents have labels; those of their lines are latent and tied to them by the share of content
characters: at least ``SHARE`` in a good document, less in a bad one. Lines start with their document's label and weights that see no neighbours; then, in turns, lines that
the weights hold for the other label change to it, surest first, as far as the document's share allows, and the field is trained anew, from the second turn on as a chain. Viterbi
decoding labels the lines of every text; a document is kept when at least ``SHARE`` of its characters are in content lines. The plain counts
(words, symbols, repeated lines and word windows) are exact per document, and documents that fail them go first.

Null texts have no words and fail. Documents without a line that has a word fail. Other columns pass through untouched.
Without labelled documents the field knows nothing and every line counts as content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainframe.llm import textscan as T

PER_CLASS, LINES, SHARE, TURNS = 500, 200, 0.5, 3
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CONT = np.zeros(256, bool)
_CONT[0x80:0xC0] = True


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_KINDS = [_SYMBOL, _class(b"|"), _class(bytes(range(65, 91))), _class(bytes(range(48, 58))), _class(b"!?"), _class(b".,;:")]
_END = _class(b".!?")
FEATURES = 24


class Scan:
    """Words, lines and counts of a small array of texts."""

    def __init__(self, texts: pa.Array):
        data, offs = T.flat(texts)
        self.data, self.offs = data, offs
        starts, ends, first = T.words(data, offs)
        self.first = first
        n = np.diff(first)
        row = np.repeat(np.arange(len(n)), n)
        h = T.span_hash(data, starts, ends)
        points = np.concatenate([[0], np.cumsum(~_CONT[data])])
        self.n_words = n
        word_chars = np.concatenate([[0], np.cumsum(points[ends] - points[starts])])
        self.word_chars = word_chars[first[1:]] - word_chars[first[:-1]]
        symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
        self.n_symbols = symbols[offs[1:]] - symbols[offs[:-1]]
        # words in windows of five that occur twice
        win, at = T.windows(h, first, 5)
        twice = at[self._again(win, row[at], every=True)]
        cover = np.zeros(len(h) + 1, np.int64)
        np.add.at(cover, twice, 1)
        np.add.at(cover, twice + 5, -1)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(cover[:-1]) > 0)])
        self.n_repeat_words = covered[first[1:]] - covered[first[:-1]]
        # lines with a word
        ls, le, _ = T.spans(data != 0x0A, offs)
        a, b = np.searchsorted(starts, ls), np.searchsorted(starts, le)
        ls, le, a, b = ls[b > a], le[b > a], a[b > a], b[b > a]
        self.line_row = np.searchsorted(offs, ls, "right") - 1
        repeated = self._again(T.span_hash(data, ls, le), self.line_row, every=False)
        self.n_dup_lines = np.bincount(self.line_row[repeated], minlength=len(n))
        self.line_first = np.searchsorted(self.line_row, np.arange(len(n) + 1))
        self.line_chars = points[le] - points[ls]
        self.x = self._features(ls, le, a, b, h, ends, repeated)

    @staticmethod
    def _again(h: np.ndarray, row: np.ndarray, every: bool) -> np.ndarray:
        """Which hashes their row has more than once: all of them, or all but the first."""
        key = T.mix(h + row.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        out = np.zeros(len(key), bool)
        out[order[1:][same]] = True
        if every:
            out[order[:-1][same]] = True
        return out

    def _features(self, ls, le, a, b, h, ends, repeated) -> np.ndarray:
        """Presence features of lines."""
        data, words = self.data, np.maximum(b - a, 1)
        size = np.maximum(self.line_chars, 1)
        shares = []
        for kind in _KINDS:
            run = np.concatenate([[0], np.cumsum(kind[data])])
            shares.append((run[le] - run[ls]) / size)
        symbol, pipe, upper, digit, shout, stops = shares
        same = np.concatenate([[0, 0], np.cumsum(h[1:] == h[:-1])]) if len(h) > 1 else np.zeros(len(h) + 1, np.int64)
        echo = (same[b] - same[np.minimum(a + 1, b)]) / words
        mean = size / words
        last = data[np.maximum(ends[b - 1] - 1, 0)] if len(b) else np.zeros(0, np.uint8)
        lines = np.diff(self.line_first)[self.line_row] if len(ls) else np.zeros(0, np.int64)
        return np.stack(
            [
                np.ones(len(ls)), words < 3, (words >= 3) & (words < 8), words >= 20, words >= 60,
                symbol > 0.02, symbol > 0.08, symbol > 0.2, pipe > 0.02, pipe > 0.08,
                upper > 0.15, upper > 0.5, digit > 0.05, digit > 0.2, shout > 0.03, shout > 0.1,
                stops == 0, stops > 0.08, _END[last], repeated, echo > 0.1, echo > 0.5, mean > 9, lines <= 2,
            ],
            1,
        ).astype(np.float64)


def _steps(first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For step k the rows that have more than k lines (longest first) and the index of that line."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    for k in range(int(n.max(initial=0))):
        rows = order[: np.searchsorted(-n[order], -k, "left")]
        yield rows, first[rows] + k


class Field:
    """Weights of line features per label (0 boilerplate, 1 content) and of label pairs."""

    def __init__(self):
        self.w, self.t = np.zeros((FEATURES, 2)), np.zeros((2, 2))

    def viterbi(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Most likely label of every line; ties go to content."""
        u = x @ self.w
        best = np.zeros((len(first) - 1, 2))
        back = np.zeros((len(x), 2), np.int8)
        for k, (rows, at) in enumerate(_steps(first)):
            if k == 0:
                best[rows] = u[at]
                continue
            s = best[rows][:, :, None] + self.t
            back[at] = np.where(s[:, 1] >= s[:, 0], 1, 0)
            best[rows] = s.max(1) + u[at]
        out = np.zeros(len(x), np.int8)
        label = (best[:, 1] >= best[:, 0]).astype(np.int8)
        for rows, at in reversed(list(_steps(first))):
            out[at] = label[rows]
            label[rows] = back[at, label[rows]]
        return out

    def _marginals(self, u: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums over labellings up to each line and behind it, and the probability of both labels of each line."""
        steps = list(_steps(first))
        f, g = np.zeros((len(u), 2)), np.zeros((len(u), 2))
        for k, (_, at) in enumerate(steps):
            f[at] = u[at] if k == 0 else u[at] + np.logaddexp(f[at - 1, 0][:, None] + self.t[0], f[at - 1, 1][:, None] + self.t[1])
        for k in range(len(steps) - 1, 0, -1):
            at = steps[k][1]
            z = u[at] + g[at]
            g[at - 1] = np.logaddexp(self.t[:, 0] + z[:, :1], self.t[:, 1] + z[:, 1:])
        p = f + g
        return f, g, np.exp(p - np.logaddexp(p[:, 0], p[:, 1])[:, None])

    def content(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability that a line is content."""
        return self._marginals(x @ self.w, first)[2][:, 1]

    def gradient(self, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradient of the conditional log-likelihood by the forward and backward recursions."""
        u = x @ self.w
        f, g, p = self._marginals(u, first)
        inner = np.setdiff1d(np.arange(len(x)), first[:-1])
        pair = f[inner - 1][:, :, None] + self.t + (u[inner] + g[inner])[:, None, :]
        pair = np.exp(pair - np.logaddexp.reduce(pair.reshape(-1, 4), 1)[:, None, None])
        truth = np.zeros_like(p)
        truth[np.arange(len(y)), y] = 1
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[inner - 1], y[inner]), 1)
        return x.T @ (truth - p), seen - pair.sum(0)

    def train(self, x: np.ndarray, y: np.ndarray, first: np.ndarray, rounds: int = 80, rate: float = 0.2, chain: bool = True) -> Field:
        """Steps scaled by running moments; documents of either label weigh what their lines weigh. Without ``chain`` pairs of labels keep their weights."""
        m, v = [np.zeros_like(self.w), np.zeros_like(self.t)], [np.zeros_like(self.w), np.zeros_like(self.t)]
        for k in range(1, rounds + 1):
            for i, (p, g) in enumerate(zip((self.w, self.t)[: 1 + chain], self.gradient(x, y, first))):
                g = g / max(len(x), 1) - 1e-3 * p
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.99 * v[i] + 0.01 * g * g
                p += rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8)
        return self


def relabelled(content: np.ndarray, chars: np.ndarray, good: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels of lines: as likely as they can be with each document's share of content characters on the side of its own label."""
    row = np.repeat(np.arange(len(good)), np.diff(first))
    total = np.bincount(row, weights=chars, minlength=len(good))
    own = good[row]
    other = np.where(own == 1, 1 - content, content)  # how sure the line is of the other label
    order = np.lexsort((np.arange(len(row)), -other, row))
    size = np.where(other > 0.5, chars, 0)[order]
    run = np.cumsum(size)
    moved = run - np.concatenate([[0], run])[first[:-1]][row[order]]
    room = np.where(good == 1, (1 - SHARE) * total, np.nextafter(SHARE * total, 0))[row[order]]
    out = own.astype(np.int64).copy()
    flip = order[(other[order] > 0.5) & (moved <= room)]
    out[flip] = 1 - out[flip]
    return out


def fit_lines(x: np.ndarray, chars: np.ndarray, good: np.ndarray, first: np.ndarray) -> Field:
    """The field of documents with labels and lines without."""
    field = Field().train(x, np.repeat(good, np.diff(first)), first, chain=False)
    for _ in range(TURNS):
        y = relabelled(field.content(x, first), chars, good, first)
        field = Field().train(x, y, first)
    return field


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Field:
    """Train on a hashed sample of labelled documents; the driver gets the line features of at most about 2 * per_class documents."""
    spark = docs.sparkSession
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    field = Field()
    if len(counts) < 2:
        return field
    rate = F.when(F.col("quality") == 1, min(1.0, per_class / counts[1])).otherwise(min(1.0, per_class / counts[0]))
    drawn = known.where(F.pmod(F.xxhash64(F.lit(23), "doc_id"), F.lit(1 << 30)) < rate * (1 << 30)).collect()
    sample = spark.createDataFrame([tuple(r) for r in drawn], "doc_id long, quality int")

    # one text of each doc_id, so that a repeated id brings no more rows than another
    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                s = Scan(part.column("text"))
                rows = [s.x[a:b].astype(np.uint8).tobytes() if b - a <= LINES else b"" for a, b in zip(s.line_first[:-1], s.line_first[1:], strict=True)]
                chars = [s.line_chars[a:b].astype("<i8").tobytes() if b - a <= LINES else b"" for a, b in zip(s.line_first[:-1], s.line_first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(rows, pa.binary()), pa.array(chars, pa.binary())], ["doc_id", "quality", "x", "chars"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("doc_id", "quality", "text")
    scanned = read.mapInArrow(lines, "doc_id long, quality int, x binary, chars binary").where("length(x) > 0")
    got = scanned.groupBy("doc_id", "quality").agg(F.min(F.struct("x", "chars")).alias("s")).select("doc_id", "quality", "s.x", "s.chars").collect()
    got = sorted(got, key=lambda r: r["doc_id"])
    if not got:
        return field
    xs = [np.frombuffer(r["x"], np.uint8).reshape(-1, FEATURES) for r in got]
    first = np.concatenate([[0], np.cumsum([len(x) for x in xs])])
    chars = np.concatenate([np.frombuffer(r["chars"], "<i8") for r in got])
    return fit_lines(np.concatenate(xs).astype(np.float64), chars, np.array([r["quality"] for r in got], np.int64), first)


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def judged(texts: pa.Array, field: Field) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The plain counts, what they reject and what is kept in the end."""
    s = Scan(texts)
    failed = (s.n_words < 10) | (100 * s.n_repeat_words > 20 * s.n_words)
    content = field.viterbi(s.x, s.line_first).astype(bool) if len(s.x) else np.zeros(0, bool)
    total = np.bincount(s.line_row, weights=s.line_chars, minlength=len(failed))
    good = np.bincount(s.line_row[content], weights=s.line_chars[content], minlength=len(failed))
    return [getattr(s, c) for c in COLUMNS], failed, ~failed & (good >= SHARE * total)


def rules(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                counts, failed, kept = judged(part.column("text"), field)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(failed), pa.array(kept)], ["doc_id", *COLUMNS, "base_failed", "kept"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, kept boolean")


def kept_documents(docs: DataFrame, field: Field) -> DataFrame:
    """The documents that pass, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, batch.schema.names[at]):
                yield part.filter(pa.array(judged(part.column(at), field)[2]))

    return docs.mapInArrow(run, docs.schema)
