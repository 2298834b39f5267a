"""Vectorised scans over the UTF-8 bytes of a column of texts: words, lines, hashes of spans.

Everything works on slices of a few megabytes, so memory does not grow with the batch Spark hands over.
A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
U = np.uint64

_rng = np.random.default_rng(20240229)
BYTE_CODES = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64) | U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(MULT, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    got = _powers.get(kind)
    if got is None or len(got) < n:
        size = max(n, 1 << 16)
        got = np.full(size, MULT if kind == "up" else _INVERSE, dtype=np.uint64)
        got[0] = 1
        np.cumprod(got, out=got)
        if size <= 4 * SLICE_BYTES:  # a very long text must not stay in a worker's memory
            _powers[kind] = got
    return got


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of each hash (finaliser with two multiplications)."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary array; nulls become empty."""
    kind = pa.large_binary()
    a = texts.cast(pa.large_string()) if pa.types.is_string(texts.type) else texts
    a = a.fill_null("" if pa.types.is_large_string(a.type) else b"") if a.null_count else a
    a = a.cast(kind)
    offs = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int64)
    raw = a.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of each part have about ``limit`` bytes; a longer single text is a part of its own."""
    if not batch.num_rows:
        return
    _, offs = flat(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of data[start:end] for each span; equal bytes give equal hashes wherever they stand."""
    n = len(data)
    run = np.empty(n + 1, dtype=np.uint64)
    run[0] = 0
    np.cumsum(BYTE_CODES[data] * _power("up", max(n, 1))[:n], out=run[1:])
    return mix((run[ends] - run[starts]) * _power("down", n + 1)[starts])


def spans(inside: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of ``inside`` that do not cross rows, and for each row the first of its runs."""
    n = len(inside)
    cut = np.zeros(n + 1, dtype=bool)
    cut[offs] = True
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(n, dtype=bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: starts, ends and for each row the index of its first word (one more at the end)."""
    return spans(~SPACE[data], offs)


def word_counts(texts: pa.Array) -> np.ndarray:
    """Words of each text."""
    data, offs = flat(texts)
    return np.diff(words(data, offs)[2])


def windows(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words inside a row, and the index of each window's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(row[:n] == row[k - 1 :])
    h = hashes[at]
    for j in range(1, k):
        h = h * U(MULT) + hashes[at + j]
    return mix(h), at


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct k-word shingle hashes; A-Z are lower-cased.

    A text with fewer words has one shingle, its whole word sequence; one without words has none.
    """
    data, offs = flat(texts)
    data = LOWER[data]
    starts, ends, first = words(data, offs)
    h = span_hash(data, starts, ends)
    win, at = windows(h, first, k)
    bound = np.searchsorted(at, first)
    for i in range(len(offs) - 1):
        n = first[i + 1] - first[i]
        if n >= k:
            yield np.unique(win[bound[i] : bound[i + 1]])
        elif n:
            x = U(n)
            with np.errstate(over="ignore"):
                for w in h[first[i] : first[i + 1]]:
                    x = x * U(MULT) + w
            yield mix(np.array([x], dtype=np.uint64))
        else:
            yield np.zeros(0, np.uint64)
