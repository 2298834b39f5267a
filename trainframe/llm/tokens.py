"""Token ids of whole texts by the tokenizers library.

Byte-level BPE never merges across the pieces of its splitting pattern, so a piece has the same ids wherever it stands.
Texts of plain letters are split here with array operations, and the library encodes each distinct piece once; its
ids are kept in the worker for later batches. Any text with a character outside ASCII and Latin-1 letters, or with an added
token of the vocabulary, goes through the library whole. Both ways give the library's own ids.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from trainframe.llm import textscan as T

#: Distinct pieces a worker remembers; beyond it the memory starts anew. It changes speed only.
REMEMBERED = 1_500_000
_LETTER, _DIGIT, _SPACE, _OTHER = 0, 1, 2, 3
_CLASS = np.full(256, _OTHER, dtype=np.uint8)
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[0x20, *range(0x09, 0x0E)]] = _SPACE
_CLASS[0x80:0xC0] = _CLASS[0xC3] = _LETTER  # both bytes of U+00C0 to U+00FF
_open: dict[tuple[str, bool], "Encoder"] = {}


def encoder(path: str, added: bool = False) -> "Encoder":
    if (path, added) not in _open:
        _open[path, added] = Encoder(path, added)
    return _open[path, added]


def plain_rows(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows whose every character is ASCII (no separators 1C to 1F) or a Latin-1 letter."""
    bad = (data >= 0xC4) | (data == 0xC2) | ((data >= 0x1C) & (data <= 0x1F)) | (data == 0xC0) | (data == 0xC1)
    at = np.flatnonzero(data == 0xC3)
    if len(at):
        at = at[at + 1 < len(data)]
        bad[at[(data[at + 1] == 0x97) | (data[at + 1] == 0xB7)]] = True
    hits = np.flatnonzero(bad)
    return np.diff(np.searchsorted(hits, offs)) == 0


def pieces(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every piece of plain texts, and for each row the index of its first piece."""
    n = len(data)
    kind = _CLASS[data]
    start = np.zeros(n + 1, dtype=bool)
    start[1:n] = kind[1:] != kind[:-1]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    start[:n] |= edge[:n]
    # the last character of white space before something else: a blank joins it, any other stands alone
    begins = np.flatnonzero(start[:n] & ~edge[:n] & (kind != _SPACE))
    begins = begins[kind[begins - 1] == _SPACE]
    blank = data[begins - 1] == 0x20
    start[begins[blank]] = False
    start[begins - 1] = True
    # 's 't 'm 'd 're 've 'll after anything but a blank
    quote = np.flatnonzero(data == 0x27)
    quote = quote[start[quote]]
    quote = quote[quote + 1 < n]
    quote = quote[start[quote + 1] & ~edge[quote + 1] & (kind[quote + 1] == _LETTER)]
    if len(quote):
        one = data[quote + 1]
        two = np.where(quote + 2 < n, data[np.minimum(quote + 2, n - 1)], 0)
        two = np.where(edge[np.minimum(quote + 2, n)], 0, two)
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        pair = (np.isin(one, np.frombuffer(b"rv", np.uint8)) & (two == 0x65)) | ((one == 0x6C) & (two == 0x6C))
        for hit, width in ((quote[short], 2), (quote[pair], 3)):
            start[hit + 1] = False
            after = hit + width
            start[after] = True
    at = np.flatnonzero(start[:n])
    return at, np.searchsorted(at, offs)


class Encoder:
    """The library on whole texts. ``added``: added tokens such as <|endoftext|> in a text get their own ids, as by the
    library's default, which the operators use; otherwise they are text like any other."""

    def __init__(self, path: str, added: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = not added
        self.added = [t.content.encode() for t in self.lib.get_added_tokens_decoder().values()] if added else []
        self.size = self.lib.get_vocab_size()
        self.newline = self.lib.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.keys, self.at, self.len = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for i in range(0, len(texts), 64):
            out += [np.array(e.ids, dtype=np.uint32) for e in self.lib.encode_batch_fast(texts[i : i + 64], add_special_tokens=False)]
        return out

    def _learn(self, keys: np.ndarray, strings: list[str]) -> None:
        """Add the ids of new pieces. Pieces on one line each are encoded together; a newline's id parts them."""
        joint = [i for i, s in enumerate(strings) if "\n" not in s and not s.isspace()] if len(self.newline) == 1 else []
        single = sorted(set(range(len(strings))) - set(joint))
        got: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(strings)
        for i in range(0, len(joint), 512):
            part = joint[i : i + 512]
            ids = np.array(self.lib.encode_batch_fast(["".join(strings[j] + "\n" for j in part) + "x"], add_special_tokens=False)[0].ids, np.uint32)[:-1]
            ends = np.flatnonzero(ids == self.newline[0])
            if len(ends) != len(part):
                single += part
                continue
            lo = 0
            for j, hi in zip(part, ends.tolist(), strict=True):
                got[j] = ids[lo:hi]
                lo = hi + 1
        for j, ids in zip(single, self.whole([strings[j] for j in single]), strict=True):
            got[j] = ids
        if len(self.keys) + len(keys) > REMEMBERED:
            self.forget()
        size = np.array([len(g) for g in got], dtype=np.int64)
        at = len(self.ids) + np.cumsum(size) - size
        self.ids = np.concatenate([self.ids, *got])
        to = np.searchsorted(self.keys, keys)  # both are sorted
        self.keys, self.at, self.len = np.insert(self.keys, to, keys), np.insert(self.at, to, at), np.insert(self.len, to, size)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.keys, keys)
        i = np.minimum(i, max(len(self.keys) - 1, 0))
        return i, (self.keys[i] == keys) if len(self.keys) else np.zeros(len(keys), bool)

    def plain(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain texts and their row offsets."""
        starts, first = pieces(data, offs)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        ends = np.append(starts[1:], len(data))
        h = T.span_hash(data, starts, ends)
        keys, one, back = np.unique(h, return_index=True, return_inverse=True)
        i, known = self._find(keys)
        if not known.all():
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            strings = [raw[a:b].decode() for a, b in zip(starts[one[new]].tolist(), ends[one[new]].tolist(), strict=True)]
            if len(self.keys) + len(new) > REMEMBERED:
                self.forget()
                new = np.arange(len(keys))
                strings = [raw[a:b].decode() for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
            self._learn(keys[new], strings)
            i, known = self._find(keys)
        at, size = self.at[i][back], self.len[i][back]
        to = np.cumsum(size)
        pos = np.arange(to[-1]) + np.repeat(at - (to - size), size)
        to = np.concatenate([[0], to])
        return self.ids[pos], to[first]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a small array, one after another, and row offsets. Null is empty."""
        data, offs = T.flat(texts)
        easy = plain_rows(data, offs)
        raw = data.tobytes() if self.added else b""
        for content in self.added:  # texts that hold an added token go through the library whole
            at = raw.find(content)
            while at >= 0:
                easy[np.searchsorted(offs, at, "right") - 1] = False
                at = raw.find(content, at + 1)
        if easy.all():
            return self.plain(data, offs)
        rows: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        hard = np.flatnonzero(~easy)
        for j, ids in zip(hard, self.whole([texts[int(j)].as_py() for j in hard]), strict=True):
            rows[j] = ids
        if easy.any():
            sub = texts.filter(pa.array(easy))
            ids, to = self.plain(*T.flat(sub))
            for k, j in enumerate(np.flatnonzero(easy)):
                rows[j] = ids[to[k] : to[k + 1]]
        size = np.array([len(r) for r in rows])
        return np.concatenate(rows), np.concatenate([[0], np.cumsum(size)])


def encoded(batch: pa.RecordBatch, column: str, path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with the ids and row offsets of their texts."""
    e = encoder(path, added=True)
    for part in T.slices(batch, column):
        yield part, *e.encode(part.column(part.schema.get_field_index(column)))


def crc32_rows(ids: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each row's ids as little-endian unsigned 32-bit integers."""
    import zlib

    raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
    return np.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], dtype=np.int64)
