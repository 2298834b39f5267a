"""Lower-cased words of letters, digits and all characters beyond ASCII, as bytes.

Lower-casing touches A-Z only, so the classes ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after it and
``[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]`` before it find the same words. Both contain every byte of a character
beyond ASCII, so UTF-8 texts are scanned byte by byte.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from trainframe.llm import textscan as T

WORD = np.ones(256, dtype=bool)
WORD[:0x30] = WORD[0x3A:0x61] = WORD[0x7B:0x80] = False


def spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of the words, and for each text the index of its first word (one more at the end)."""
    data, offs = T.flat(texts)
    data = T.LOWER[data]
    return data, *T.spans(WORD[data], offs)


def packed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The given spans as one array of byte strings."""
    offs = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    at = np.arange(offs[-1]) + np.repeat(starts - offs[:-1], ends - starts)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offs), pa.py_buffer(np.ascontiguousarray(data[at]))])


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, for each word of the texts its place among them, and for each text the index of its first word."""
    data, starts, ends, first = spans(texts)
    coded = packed(data, starts, ends).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), first
