"""Mixing sources to target weights by a low-discrepancy schedule.

Targets: sources in code point order, null last, share a budget by weight; a source gives at most ``passes`` times its
size and the excess is shared among the others. Each source's documents stand in a seeded order as one stream of words,
cut into blocks of equal size (the last one shorter). Slot i of the schedule belongs to the source whose stretch of the
cumulative weights holds the fraction of i times the golden ratio; the k-th slot of a source takes its k-th block, going
round its stream again where the target asks for it. A source leaves the schedule with the slot in which it meets its target; that slot holds the rest only, and
what no slot holds is not taken. Should the points leave a source short of slots, its last ones follow at the end. The documents of the mix are written by their first slot.

Only the totals per source reach the driver. Positions in a stream and ranks of slots come from sums per block, so a
source with a third of all rows is split. Null texts have no words and are never taken. Rows with equal doc_id count
as documents of their own. An empty table gives an empty mix.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trainframe.llm import textscan as T
from trainframe.llm.store import shuffle_partitions, stored

BLOCK_WORDS = 1024
SCHEDULE_CHUNK = 1 << 14
GOLDEN = 0.6180339887498949
FEW_IDS = 1 << 16


def document_sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and nth, which tells rows of equal doc_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(T.word_counts(part.column("text"))), part.column("mark")], ["doc_id", "source", "size", "mark"])

    sizes = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), "text", mark_of().alias("mark")).mapInArrow(run, "doc_id long, source string, size long, mark long")
    return stored(sizes.withColumn("nth", numbered("source", "mark")).drop("mark"), "sizes")


def mark_of():
    return F.xxhash64("text")


def numbered(*order: str):
    """Number of a row among those of its doc_id; the same wherever it is computed."""
    return F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))


def source_targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[int] = (3, 1, 2), share: Fraction = Fraction(3, 2), passes: int = 2) -> list[tuple[str | None, int, float, int]]:
    """source, size, target, words to take, in code point order with null last."""
    rows = sorted(sizes, key=lambda r: (r[0] is None, r[0] or ""))
    weight = [weights[i % len(weights)] for i in range(len(rows))]
    target = [Fraction(0)] * len(rows)
    left, open_ = share * sum(n for _, n in rows), list(range(len(rows)))
    while open_:
        total = sum(weight[i] for i in open_)
        over = [i for i in open_ if left * weight[i] > passes * rows[i][1] * total]
        if not over:
            for i in open_:
                target[i] = left * weight[i] / total
            break
        for i in over:
            target[i] = Fraction(passes * rows[i][1])
        left -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return [(s, n, float(t), int(t + Fraction(1, 2))) for (s, n), t in zip(rows, target, strict=True)]


def targets_of(sizes: DataFrame, **kw) -> DataFrame:
    """The source table: source, sid, source_size, target, words."""
    got = [(r["source"], r["n"]) for r in sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    rows = [(s, i, n, t, w) for i, (s, n, t, w) in enumerate(source_targets(got, **kw))]
    return sizes.sparkSession.createDataFrame(rows, "source string, sid int, source_size long, target double, words long")


def streams(sizes: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Place of each document in its source's stream: at (words before it)."""
    n = sizes.count()
    bits = max(4, int(np.ceil(np.log2(n / 1024 + 1))))
    df = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    df = df.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "nth")).withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    per = df.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("sid", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "doc_id", "nth").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return df.join(base, ["sid", "bucket"]).withColumn("at", F.col("base") + F.col("within")).drop("h", "bucket", "base", "within")


def schedule(sources: DataFrame, block: int) -> DataFrame:
    """slot, sid, k and length: the first words of the k-th block of a source stand in this slot, so many of them."""
    spark = sources.sparkSession
    rows = [r for r in sources.orderBy("sid").collect() if r["words"] > 0]
    slots = [-(-r["words"] // block) for r in rows]
    if not rows:
        return spark.createDataFrame([], "slot long, sid int, k long, length long")
    ends = np.cumsum(slots) / sum(slots)
    sids, need = np.array([r["sid"] for r in rows]), np.array(slots)
    by_sid = np.zeros(int(sids.max()) + 1, np.int64)
    by_sid[sids] = need

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column("id").to_numpy()
            at = np.minimum(np.searchsorted(ends, np.modf(i * GOLDEN)[0], "right"), len(ends) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(sids[at].astype(np.int32)), pa.array(i // SCHEDULE_CHUNK)], ["slot", "sid", "chunk"])

    total = int(need.sum())
    drawn = spark.range(total + 64).mapInArrow(draw, "slot long, sid int, chunk long")
    per = stored(drawn.groupBy("sid", "chunk").count(), "slots")
    earlier = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("sid", "chunk", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("r", rank).join(base, ["sid", "chunk"]).select("slot", "sid", (F.col("r") + F.col("base")).alias("k"))
    got = {r["sid"]: r["n"] for r in per.groupBy("sid").agg(F.sum("count").alias("n")).collect()}
    have = {int(s): min(int(n), int(got.get(int(s), 0))) for s, n in zip(sids, need, strict=True)}
    short = np.cumsum([0] + [int(n) - have[int(s)] for s, n in zip(sids, need, strict=True)]).tolist()
    limits = spark.createDataFrame([(int(s), int(n), have[int(s)], total + 64 + at, int(r["words"])) for s, n, at, r in zip(sids, need, short, rows)], "sid int, need long, got long, late long, words long")
    length = F.least(F.lit(block), F.col("words") - F.col("k") * block).alias("length")
    kept = ranked.join(F.broadcast(limits), "sid").where("k < need").select("slot", "sid", "k", length)
    rest = limits.where("got < need").withColumn("k", F.explode(F.sequence("got", F.col("need") - 1)))
    return kept.unionByName(rest.select((F.col("late") + F.col("k") - F.col("got")).alias("slot"), "sid", "k", length))


def mix(sizes: DataFrame, sources: DataFrame, block: int = BLOCK_WORDS, passes: int = 2, seed: int = 1) -> DataFrame:
    """The mix: slot, doc_id, nth, pass, and the words [lo, hi) of the document that stand in this slot."""
    placed = streams(sizes, sources, seed).where("size > 0")
    turns = placed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1)))).withColumn("from", F.col("at") + F.col("pass") * F.col("source_size"))
    turns = turns.withColumn("to", F.col("from") + F.col("size"))
    parts = turns.withColumn("k", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))))
    lo, hi = F.greatest("from", F.col("k") * block) - F.col("from"), F.least("to", F.col("k") * block + F.col("length")) - F.col("from")
    return parts.join(schedule(sources, block), ["sid", "k"]).select("slot", "sid", "doc_id", "nth", "pass", lo.alias("lo"), hi.alias("hi")).where("lo < hi")


def mixed_counts(docs: DataFrame, **kw) -> DataFrame:
    """Per document what the mix takes of it, and the first slot that holds some (null: none)."""
    sizes = document_sizes(docs)
    sources = targets_of(sizes)
    taken = mix(sizes, sources, **kw).groupBy("doc_id", "nth").agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"), F.min("slot").alias("first_slot"))
    every = sizes.join(sources, sizes["source"].eqNullSafe(sources["source"])).drop(sources["source"])
    got = every["doc_id"].eqNullSafe(taken["doc_id"]) & (every["nth"] == taken["nth"])
    return every.join(taken, got, "left").select(every["doc_id"], "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")


def _numbered_rows(docs: DataFrame, sizes: DataFrame, few: int = FEW_IDS) -> DataFrame:
    """The documents with _nth. Only texts whose doc_id comes again are shuffled for it, or all, where more than ``few`` ids do."""
    again = stored(sizes.where("nth > 1").select(F.col("doc_id").alias("_again")).distinct(), "again")
    every = docs.withColumn("_nth", F.lit(1))
    number = lambda df: df.withColumn("_source", F.col("source").cast("string")).withColumn("_mark", mark_of()).withColumn("_nth", numbered("_source", "_mark")).drop("_source", "_mark")
    if again.count() > few:
        return number(docs)
    same = docs["doc_id"].cast("long").eqNullSafe(again["_again"])
    return every.join(F.broadcast(again), same, "left_anti").unionByName(number(docs.join(F.broadcast(again), same, "left_semi")))


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """The documents of the mix, with their columns, in the order of their first slots: whole, or the words taken of them; a second pass repeats a row."""
    sizes = document_sizes(docs)
    sources = targets_of(sizes)
    turns = mix(sizes, sources, **kw).groupBy("doc_id", "nth", "pass").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"), F.min("slot").alias("_slot"))
    rows = _numbered_rows(docs, sizes)
    names = docs.columns
    joined = rows.join(turns, rows["doc_id"].cast("long").eqNullSafe(turns["doc_id"]) & (rows["_nth"] == turns["nth"])).select(*[rows[c] for c in names], "_lo", "_hi", "_slot", turns["nth"].alias("_nth"))
    at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                data, offs = T.flat(part.column(at))
                starts, ends, first = T.words(data, offs)
                lo, hi = part.column("_lo").to_numpy() + first[:-1], part.column("_hi").to_numpy() + first[:-1]
                a = np.where(lo == first[:-1], offs[:-1], starts[lo])
                b = np.where(hi == first[1:], offs[1:], ends[hi - 1])
                raw = data.tobytes()
                texts = pa.array([raw[x:y].decode() for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.string())
                cols = [texts if i == at else part.column(i) for i in range(len(names))]
                if "n_chars" in names:
                    i = names.index("n_chars")
                    cols[i] = pa.array([len(t) for t in texts.to_pylist()], cols[i].type)
                yield pa.RecordBatch.from_arrays(cols, names)

    # ranges of slots hold as many words each; their number is known, so nothing is sampled to cut them
    parts, block = shuffle_partitions(docs), kw.get("block", BLOCK_WORDS)
    slots = sources.agg(F.sum(F.ceil(F.col("words") / block))).first()[0] or 1
    dealt = joined.repartitionById(parts, F.least(F.lit(parts - 1), F.floor(F.col("_slot") * parts / slots)).cast("int"))
    return dealt.sortWithinPartitions("_slot", "doc_id", "_nth", "_lo").mapInArrow(cut, docs.schema)


