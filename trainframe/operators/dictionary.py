"""Block dictionaries: token arrays as local numbers, so that only distinct tokens of a block meet a vocabulary.

A block is a run of rows with at most ``BLOCK_TOKENS`` tokens (or one longer row). It is one row of a stored table: the
rows' keys and sizes, the local number of every token, and the distinct tokens with their counts. Building a vocabulary
reads the counts, a lookup joins the distinct tokens and brings back one array of ids per block, and the numbers are
replaced inside the row. No token of the texts becomes a row of its own, and a token that makes up a third of the texts
is one row for each block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from trainframe.operators.position import prefix_sum
from trainframe.session import written

BLOCK_TOKENS = 1 << 20


def _cuts(offs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with at most ``limit`` tokens, or one row."""
    at = 0
    while at < len(offs) - 1:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, to
        at = to


def encode_blocks(df: DataFrame, keys: Sequence[str], tokens: str = "tokens", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(block, keys, sizes, local, words, counts): one row per block, stored once. A null array has no tokens; a null token has local number -1."""
    keys = list(keys)
    rows = df.select(*keys, tokens)
    kinds = S.StructType([rows.schema[k] for k in keys])
    schema = S.StructType(
        [
            S.StructField("block", S.LongType()),
            S.StructField("keys", S.ArrayType(kinds)),
            S.StructField("sizes", S.ArrayType(S.IntegerType())),
            S.StructField("local", S.ArrayType(S.IntegerType())),
            S.StructField("words", S.ArrayType(S.StringType())),
            S.StructField("counts", S.ArrayType(S.LongType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 33
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        for batch in batches:
            lists = batch.column(len(keys))
            offs = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(lists).fill_null(0).to_numpy())])
            words = lists.flatten()
            for a, b in _cuts(offs, block_tokens):
                coded = words.slice(offs[a], offs[b] - offs[a]).dictionary_encode()
                local = coded.indices.fill_null(-1).cast(pa.int32())
                counts = np.bincount(local.to_numpy(zero_copy_only=False) + 1, minlength=len(coded.dictionary) + 1)[1:]
                held = pa.StructArray.from_arrays([c.slice(a, b - a) for c in batch.columns[: len(keys)]], keys)
                columns = [pa.array([block]), one(held), one(pa.array(np.diff(offs[a : b + 1]), pa.int32())), one(local), one(coded.dictionary), one(pa.array(counts, pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, schema.names)
                block += 1

    return written(rows.mapInArrow(run, schema), "blocks")


def word_counts(blocks: DataFrame) -> DataFrame:
    """(token, freq) of each distinct token of each block."""
    return blocks.select(F.explode(F.arrays_zip("words", "counts")).alias("w")).select(F.col("w.words").alias("token"), F.col("w.counts").alias("freq"))


def row_starts(blocks: DataFrame, key: str) -> DataFrame:
    """(block, starts, n): where the rows' tokens start when all rows are strung together in ``key`` order, and the length of all."""
    sizes = blocks.select("block", F.posexplode(F.arrays_zip("keys", "sizes")).alias("i", "r")).select("block", "i", F.col(f"r.keys.{key}").alias("_key"), F.col("r.sizes").cast("bigint").alias("_size"))
    placed = prefix_sum(sizes, "_key", F.col("_size"), out="_start", total="n")
    return placed.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("i", "_start")))["_start"].alias("starts"), F.max("n").alias("n"))


def decode_blocks(blocks: DataFrame, vocab: DataFrame, unk_id: int = 0, order: str | None = None) -> DataFrame:
    """(keys.., ids) of every row, ids from the vocabulary (token, token_id); unknown tokens get ``unk_id``.

    ``order`` names a unique numeric key; rows then also have ``start``, their place in the stream of all tokens, and its length ``n``.
    """
    words = blocks.select("block", F.posexplode("words").alias("place", "token"))
    found = words.join(vocab.select("token", "token_id"), "token", "left")
    unknown = F.lit(unk_id).cast("bigint")
    ids = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce(F.col("token_id").cast("bigint"), unknown).alias("id"))))["id"].alias("ids"))
    rows = blocks.select("block", "keys", "sizes", "local").join(ids, "block", "left")
    fields = [*blocks.schema["keys"].dataType.elementType.fields, S.StructField("ids", S.ArrayType(S.LongType()))]
    if order:
        rows = rows.join(row_starts(blocks, order), "block")
        fields += [S.StructField("start", S.LongType()), S.StructField("n", S.LongType())]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                part = {c: row.column(c).flatten() for c in ("keys", "sizes", "local", *(["starts"] if order else []))}
                words = row.column("ids").flatten().to_numpy()
                known = np.append(words, unk_id)  # local number -1
                taken = known[part["local"].to_numpy()]
                offs = np.concatenate([[0], np.cumsum(part["sizes"].to_numpy())]).astype(np.int32)
                columns = [*part["keys"].flatten(), pa.ListArray.from_arrays(pa.array(offs), pa.array(taken, pa.int64()))]
                if order:
                    columns += [part["starts"], pa.array(np.full(len(offs) - 1, row.column("n")[0].as_py()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.drop("block").mapInArrow(run, S.StructType(fields))
