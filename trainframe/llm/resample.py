"""Target-distribution importance resampling of documents over hashed word runs.

Features are runs of up to ``longest`` words, joined by one space and hashed into buckets by CRC-32. The gain of a bucket
compares its share in the target texts with that in the documents; a document's weight is the sum over its features, and
seeded Gumbel noise makes the highest scores a draw without replacement.

In every slice of texts the distinct features are grouped by length into matrices of bytes; all checksums of a matrix are
updated column by column through one table and scattered back. Features longer than ``LONGEST`` bytes, of which a slice
has few, go one at a time. Texts are scanned twice, once for the counts of all documents and once for the weights, so
between the scans there are only the counts of the buckets.

A null text has no features. A null doc_id has no noise: its score is null and it is never drawn, but its words count.
Rows of equal doc_id are scored each for itself. Other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainframe.llm import terms as W
from trainframe.llm import textscan as T
from trainframe.llm.store import stored
from trainframe.operators.position import sorted_position

LONGEST = 256


def _crc_table() -> np.ndarray:
    at = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        at = np.where(at & 1, (at >> 1) ^ np.uint32(0xEDB88320), at >> 1)
    return at


CRC = _crc_table()


def checksums(features: pa.Array) -> np.ndarray:
    """Unsigned CRC-32 of each byte string, in matrices of equal length."""
    data, offs = T.flat(features)
    size = np.diff(offs)
    out = np.zeros(len(size), np.uint32)
    order = np.argsort(size, kind="stable")
    lengths, first = np.unique(size[order], return_index=True)
    for length, rows in zip(lengths.tolist(), np.split(order, first[1:]), strict=False):  # splitting nothing gives one part
        if length > LONGEST:
            out[rows] = [zlib.crc32(data[offs[r] : offs[r + 1]]) for r in rows]
            continue
        matrix = data[offs[rows][:, None] + np.arange(length)]
        crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
        for column in range(length):
            crc = CRC[(crc ^ matrix[:, column]) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
        out[rows] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def features(texts: pa.Array, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1, 2, .. words: the buckets of all features of the texts in order, and where each text's begin (one more at the end)."""
    data, starts, ends, first = W.spans(texts)
    size = ends - starts
    line = np.full(int(size.sum()) + len(size), 0x20, np.uint8)  # words with one space behind each
    begin = np.cumsum(size + 1) - size - 1
    if len(size):
        line[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = data[np.arange(int(size.sum())) + np.repeat(starts - (np.cumsum(size) - size), size)]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    for run in range(1, longest + 1):
        n = max(len(size) - run + 1, 0)
        at = np.flatnonzero(row[:n] == row[run - 1 :]) if n else np.zeros(0, np.int64)
        last = at + run - 1
        coded = W.packed(line, begin[at], begin[last] + size[last]).dictionary_encode()
        bucket = (checksums(coded.dictionary) % np.uint32(buckets)).astype(np.int64)
        yield bucket[coded.indices.to_numpy(zero_copy_only=False)] if len(at) else np.zeros(0, np.int64), np.searchsorted(at, first)


def bucket_counts(docs: DataFrame, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts by bucket; a task sends at most one row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in T.slices(batch, "text"):
                for found, _ in features(part.column("text"), longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    got = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in got:  # at most `buckets` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of smoothed shares, for each bucket."""
    s_all, t_all = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((float(t) + 1) * s_all / ((float(s) + 1) * t_all))) for s, t in zip(source, target, strict=True)], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, longest: int) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            for part in T.slices(batch, "text"):
                n_words = n = weight = np.zeros(part.num_rows, np.int64)
                for nth, (found, first) in enumerate(features(part.column("text"), longest, len(gain))):
                    n_words = np.diff(first) if nth == 0 else n_words
                    n = n + np.diff(first)
                    run = np.concatenate([[0], np.cumsum(gain[found])])
                    weight = weight + run[first[1:]] - run[first[:-1]]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c.astype(np.int64)) for c in (n_words, n, weight))], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10000, least: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row; rank is null unless the row is drawn.

    Of the rows with at least ``least`` words the given percentage is drawn, highest scores first, ties to the smaller doc_id.
    """
    gain = gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256)
    uniform = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))
    scored = stored(weighted(docs, gain, longest).withColumn("score", F.col("weight") + noise), "scored")
    able = F.coalesce((F.col("n_words") >= least) & F.col("doc_id").isNotNull(), F.lit(False))
    out = ["doc_id", "n_features", "weight", "score"]
    drawn = scored.where(able).count() * percent // 100
    placed = sorted_position(scored.where(able).select(*out), [F.desc("score"), "doc_id", "weight", "n_features"], out="_pos")
    rank = F.when(F.col("_pos") < drawn, F.col("_pos") + 1)
    return placed.select(*out, rank.cast("long").alias("rank")).unionByName(scored.where(~able).select(*out, F.lit(None).cast("long").alias("rank")))
