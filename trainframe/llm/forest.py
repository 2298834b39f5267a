"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set holds hashes of its distinct k-word shingles. Documents of equal sets fold to the smallest doc_id.
The forest has ``TREES`` orders of the signature columns; in each, all signatures are range-sorted as prefixes of
``DEPTH`` columns, and a document's candidates are its next ``NEIGHBOURS`` documents whose common prefix has at least
``LEAST_DEPTH`` columns. Sorting adapts the depth by itself: in a dense region neighbours share long prefixes, in a
thin one short ones. A common region, however large, is a run of the sort and may spread over many tasks; the rows at
the borders of tasks are paired in a step of their own. Candidates whose signatures agree in clearly too few columns
are left out, the others are confirmed on full sets, best ones first; pairs inside a component found so far add nothing
to it and are not confirmed again.

Then a second search goes through every region (documents of a tree with a common prefix of ``LEAST_DEPTH`` columns) that
is larger than the window and holds more than one component. While regions are larger than ``DESCEND`` blocks, it descends: the depth
doubles, and the shallow regions are searched last, across the components that are left by then. A region is cut into blocks
by number and by bytes; members outside its most common component meet all its members with their full sets, so a pair is
decided where it is found. A block returns one link per component to the smallest it was joined with, never pairs.

No words or a null text: an empty set, linked with nothing, kept. A null doc_id is linked with nothing and kept. Rows
of equal doc_id are one node: their sets are linked with each other. Other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trainframe.llm import textscan as T
from trainframe.llm.components import components
from trainframe.llm.store import shuffle_partitions, stored

COLUMNS, TREES, DEPTH, LEAST_DEPTH, NEIGHBOURS = 128, 16, 16, 3, 2
#: Rows on a side of a block in the second search, and about as many shingles of theirs.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 21
#: Blocks on a side of a region from which a pass over longer prefixes costs less than comparing them all.
DESCEND = 8


def least_share(percent: int) -> float:
    """Share of equal signature columns below which a pair is not confirmed: 4.25 standard deviations below the similarity."""
    p = percent / 100
    return p - 4.25 * (p * (1 - p) / COLUMNS) ** 0.5


_rng = np.random.default_rng(7)
_A = _rng.integers(1, 2**63, COLUMNS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, COLUMNS, dtype=np.uint64)


def signature(shingles: np.ndarray) -> bytes:
    """MinHash of a set in COLUMNS 16-bit columns."""
    low = np.full(COLUMNS, 2**64 - 1, np.uint64)
    for at in range(0, len(shingles), 512):
        low = np.minimum(low, (shingles[at : at + 512, None] * _A + _B).min(0))
    return (T.mix(low) >> np.uint64(48)).astype(">u2").tobytes()


def document_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, two fingerprints of the whole set, signature (null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                sets = list(T.shingle_sets(part.column("text"), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                        pa.array(np.array([T.mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)),
                        pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "f1", "f2", "sig"],
                )

    schema = "doc_id long, n_shingles long, f1 long, f2 long, sig binary"
    return stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema), "sets")


def _neighbours(ids: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows up to NEIGHBOURS apart in a sorted run whose keys agree in the tree and LEAST_DEPTH columns."""
    a, b, head = [], [], 1 + 2 * LEAST_DEPTH
    for step in range(1, NEIGHBOURS + 1):
        same = (keys[step:, :head] == keys[:-step, :head]).all(1) & (ids[step:] != ids[:-step])
        a.append(np.minimum(ids[step:], ids[:-step])[same])
        b.append(np.maximum(ids[step:], ids[:-step])[same])
    return np.concatenate(a), np.concatenate(b)


def candidates(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of neighbouring documents in any of the trees; sets needs doc_id and sig."""
    width = 1 + 2 * DEPTH
    twice = F.concat("sig", "sig")
    step = 2 * COLUMNS // TREES
    keys = F.array(*[F.concat(F.lit(bytes([t])), F.substring(twice, t * step + 1, 2 * DEPTH)) for t in range(TREES)])
    rows = sets.select("doc_id", F.explode(keys).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seen, names = TaskContext.get().partitionId(), 0, ["a", "b", "key", "task", "nth"]
        ids, keys = np.zeros(0, np.int64), np.zeros((0, width), np.uint8)

        def edge(ids: np.ndarray, keys: np.ndarray, nth: int) -> pa.RecordBatch:
            n = len(ids)
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(n, pa.int64()), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([task] * n, pa.int32()), pa.array(nth + np.arange(n))], names)

        for batch in batches:
            raw, _ = T.flat(batch.column("key"))
            new, more = batch.column("doc_id").to_numpy(), raw.reshape(-1, width)
            if seen < NEIGHBOURS:
                head = min(len(new), NEIGHBOURS - seen)
                yield edge(new[:head], more[:head], seen)
            old = len(ids)
            ids, keys = np.concatenate([ids, new]), np.concatenate([keys, more])
            a, b = _neighbours(ids, keys)
            n = len(a)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names)
            seen += len(ids) - old
            ids, keys = ids[-NEIGHBOURS:], keys[-NEIGHBOURS:]
        if seen > NEIGHBOURS:
            n = min(len(ids), seen - NEIGHBOURS)
            yield edge(ids[-n:], keys[-n:], seen - n)

    schema = "a long, b long, key binary, task int, nth long"
    found = rows.repartitionByRange(shuffle_partitions(sets), "key", "doc_id").sortWithinPartitions("key", "doc_id").mapInArrow(run, schema)
    found = stored(found, "forest")

    def border(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All border rows of the sort in order: a few per task of the step before."""
        got = list(batches)
        if got:
            t = pa.Table.from_batches(got)
            raw, _ = T.flat(t.column("key").combine_chunks())
            a, b = _neighbours(t.column("a").to_numpy(), raw.reshape(-1, width))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    borders = found.where("key is not null").select("task", "nth", "a", "key").repartition(1).sortWithinPartitions("task", "nth").mapInArrow(border, "a long, b long")
    return found.where("key is null").select("a", "b").unionByName(borders).distinct()


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose signatures agree in enough columns, with that share; sizes that forbid the similarity go too."""
    sig = sets.select("doc_id", "n_shingles", "sig")
    both = pairs.join(sig.toDF("a", "n", "sa"), "a").join(sig.toDF("b", "m", "sb"), "b").where(f"100 * least(n, m) >= {int(percent)} * greatest(n, m)").select("a", "b", "sa", "sb")

    least = least_share(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (T.flat(batch.column(c))[0].view(">u2").reshape(-1, COLUMNS) for c in ("sa", "sb"))
            share = (x == y).mean(1) if len(x) else np.zeros(0)
            keep = pa.array(share >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(share).filter(keep)], ["a", "b", "share"])

    return stored(both.mapInArrow(run, "a long, b long, share double"), "likely")


def _sets_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    raw, offs = T.flat(table.column("shingles").combine_chunks())
    return raw.view(np.uint64), offs // 8


def _meet(block: pa.Table, depth: int, percent: int) -> pa.Table:
    """Components (a) of a block that pairs of a query and a member join with a smaller one (b), confirmed on full sets.

    A pair is compared in the first tree that brings both together, and not if this block has joined both already.
    """
    side = block.column("side").to_numpy()
    theirs, mine = block.filter(pa.array(side == 1)), block.filter(pa.array(side == 0))
    if not theirs.num_rows or not mine.num_rows:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    x, y = (T.flat(t.column("sig").combine_chunks())[0].view(">u2").astype(np.uint16).reshape(-1, COLUMNS) for t in (theirs, mine))
    (q, qc), (m, mc) = ([t.column(c).to_numpy() for c in ("doc_id", "comp")] for t in (theirs, mine))
    (mine_h, at_m), (their_h, at_q) = _sets_of(mine), _sets_of(theirs)
    known, place = np.unique(mine_h, return_inverse=True)
    n, k = np.diff(at_q), np.diff(at_m)
    tree, main = block.column("key")[0].as_py()[0], block.column("main")[0].as_py()
    heads = (np.arange(tree)[:, None] * (COLUMNS // TREES) + np.arange(depth)) % COLUMNS
    comps, index = np.unique(np.concatenate([qc, mc]), return_inverse=True)
    label, qi, mi = np.arange(len(comps)), index[: len(q)], index[len(q) :]
    has, least = np.zeros(len(known), bool), least_share(percent) * COLUMNS
    yt = np.ascontiguousarray(y.T)
    for at in range(0, len(q), 128):
        to = slice(at, at + 128)
        same = np.zeros((len(q[to]), len(m)), np.uint8)
        for c in range(COLUMNS):
            same += x[to, c, None] == yt[c][None]
        low, high = np.minimum(n[to, None], k[None]), np.maximum(n[to, None], k[None])
        good = (same >= least) & (qc[to, None] != mc[None]) & (100 * low >= percent * high)
        good &= (mc[None] == main) | (q[to, None] < m[None])  # two queries meet once
        for i in np.flatnonzero(good.any(1)):
            j = np.flatnonzero(good[i] & (label[mi] != label[qi[at + i]]))
            for h in heads:
                j = j[(x[at + i, h] != y[j][:, h]).any(1)]
            if not len(j):
                continue
            mark = their_h[at_q[at + i] : at_q[at + i + 1]]
            found = np.minimum(np.searchsorted(known, mark), len(known) - 1)
            found = found[known[found] == mark]
            has[found] = True
            starts = np.cumsum(k[j]) - k[j]
            inter = np.add.reduceat(has[place[np.repeat(at_m[j] - starts, k[j]) + np.arange(k[j].sum())]].astype(np.int64), starts)
            has[found] = False
            j = j[100 * inter >= percent * (n[at + i] + k[j] - inter)]
            if len(j):
                join = np.unique(np.append(label[mi[j]], label[qi[at + i]]))
                label[np.isin(label, join)] = join[0]
    moved = label != np.arange(len(comps))
    return pa.table({"a": comps[moved], "b": comps[label[moved]]})


def placed(nodes: DataFrame, tree: DataFrame | None) -> DataFrame:
    """Nodes with the component found for them so far."""
    if tree is None:
        return nodes.withColumn("comp", F.col("doc_id"))
    return nodes.join(tree.toDF("doc_id", "root"), "doc_id", "left").withColumn("comp", F.coalesce("root", "doc_id")).drop("root")


def tree_rows(nodes: DataFrame, depth: int) -> DataFrame:
    """Each node with its prefix in each tree."""
    twice, step = F.concat("sig", "sig"), 2 * COLUMNS // TREES
    keys = F.array(*[F.concat(F.lit(bytes([t])), F.substring(twice, t * step + 1, 2 * depth)) for t in range(TREES)])
    return nodes.select("doc_id", "comp", "n_shingles", F.explode(keys).alias("key"))


def open_regions(nodes: DataFrame, depth: int) -> DataFrame:
    """Prefixes of several components and more documents than the window, with their main component and numbers of blocks."""
    per = tree_rows(nodes, depth).groupBy("key", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    regions = per.groupBy("key").agg(F.sum("n").alias("size"), F.sum("w").alias("weight"), F.max(F.struct("n", "comp", "w")).alias("most"), F.count("*").alias("comps"))
    # in a region of up to NEIGHBOURS + 1 documents every pair was a candidate already
    regions = regions.where((F.col("size") > NEIGHBOURS + 1) & (F.col("comps") > 1))
    blocks = lambda n, w: F.ceil(F.greatest(n / BLOCK, w / BLOCK_SHINGLES)).cast("int")
    rest = blocks(F.col("size") - F.col("most.n"), F.col("weight") - F.col("most.w"))
    return stored(regions.select("key", "size", F.col("most.comp").alias("main"), blocks(F.col("size"), F.col("weight")).alias("mb"), rest.alias("qb")), "regions")


def region_links(nodes: DataFrame, regions: DataFrame, depth: int, percent: int) -> DataFrame:
    """Links (a, b) between components of the same region that a pair of the wanted similarity joins."""
    # full sets meet the rows of these regions only, not those of all keys
    inside = tree_rows(nodes, depth).select("doc_id", "key").join(regions.drop("size").hint("merge"), "key").join(nodes.hint("merge"), "doc_id")
    hashed, names = F.xxhash64("doc_id"), ["key", "main", "m", "q", "side", "doc_id", "comp", "sig", "shingles"]
    members = inside.withColumn("m", F.pmod(hashed, "mb").cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qb") - 1))).withColumn("side", F.lit(0)).select(names)
    queries = inside.where("comp != main").withColumn("q", F.pmod(hashed, "qb").cast("int")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("mb") - 1))).withColumn("side", F.lit(1)).select(names)
    met = members.unionByName(queries).groupBy("key", "m", "q").applyInArrow(lambda block: _meet(block, depth, percent), "a long, b long")
    return stored(met, "met")


def searched(docs: DataFrame, reps: DataFrame, tree: DataFrame | None, k: int, percent: int) -> DataFrame | None:
    """Components after the second search: large regions by longer prefixes first, then by shorter ones."""
    nodes = stored(placed(reps.select("doc_id", "n_shingles", "sig"), tree), "nodes")
    regions = open_regions(nodes, LEAST_DEPTH)
    largest = regions.agg(F.max("size")).first()[0]
    if largest is None:
        return tree
    ids = stored(tree_rows(nodes, LEAST_DEPTH).select("doc_id", "key").join(regions.select("key").hint("merge"), "key").select("doc_id").distinct(), "inside")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.tobytes() for x in T.shingle_sets(part.column("text"), k)], pa.binary())], ["doc_id", "shingles"])

    # a merge at every size: the list of ids grows with the documents, so the plan must not lean on its being small
    texts = docs.select(F.col("doc_id").cast("long"), "text").join(ids.hint("merge"), "doc_id").select("doc_id", "text")
    members = stored(nodes.drop("comp").join(texts.mapInArrow(run, "doc_id long, shingles binary").hint("merge"), "doc_id"), "members")
    depths = [LEAST_DEPTH]
    while largest > DESCEND * BLOCK and 2 * depths[-1] <= DEPTH:
        depths.append(2 * depths[-1])
        regions = open_regions(placed(members, tree), depths[-1])
        largest = regions.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    for at, depth in enumerate(reversed(depths)):
        nodes = placed(members, tree)
        if at:
            regions = open_regions(nodes, depth)
        met = region_links(nodes, regions, depth, percent)
        if not met.isEmpty():
            tree = grown(tree, met)
    return tree


def confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Components (a, b) of the pairs whose full sets have at least the given similarity; pairs has a, b and their components ca, cb."""
    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("ca", "cb", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.slices(batch, "ta", T.SLICE_BYTES // 2):
                keep = []
                for x, y in zip(T.shingle_sets(part.column("ta"), k), T.shingle_sets(part.column("tb"), k), strict=True):
                    inter = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(inter > 0 and 100 * inter >= percent * (len(x) + len(y) - inter))
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column("ca").filter(keep), part.column("cb").filter(keep)], ["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def grown(tree: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components with those that links between their roots, or nodes without one, join. Only the links are contracted."""
    more = components(links)
    if tree is None:
        return stored(more, "components")
    more = stored(more, "joins")
    moved = tree.join(more.toDF("root", "_up"), "root", "left").select("id", F.coalesce("_up", "root").alias("root"))
    return stored(moved.unionByName(more.join(tree.select("id"), "id", "left_anti")), "components")


def joined(docs: DataFrame, pairs: DataFrame, tree: DataFrame | None, k: int, percent: int) -> DataFrame | None:
    """Components with those that the pairs (a, b, share) add."""
    if pairs.isEmpty():
        return tree
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    # a merge at every size: the list of ids grows with the documents, so the plan must not lean on its being small
    texts = stored(docs.select(F.col("doc_id").cast("long"), "text").join(ids.hint("merge"), "doc_id"), "texts")

    def across(left: DataFrame) -> DataFrame:
        """Pairs of different components, with these."""
        left = left.select("a", "b", "share", F.col("a").alias("ca"), F.col("b").alias("cb"))
        for side in ("a", "b") if tree is not None else ():
            left = left.join(tree.toDF(side, "_root"), side, "left").withColumn(f"c{side}", F.coalesce("_root", side)).drop("_root")
        return stored(left.where("ca != cb").select("a", "b", "share", "ca", "cb"), "left")

    left = across(pairs)
    for most in (1, 3, None):  # the best candidate of each document, then a few, then all that still join components
        if left.isEmpty():
            break
        todo = left
        if most:
            ends = left.select("*", F.explode(F.array("a", "b")).alias("end"))
            rank = F.row_number().over(Window.partitionBy("end").orderBy(F.desc("share"), "a", "b"))
            todo = stored(ends.withColumn("rank", rank).where(F.col("rank") <= most).select(left.columns).distinct(), "todo")
        new = stored(confirmed(todo, texts, k, percent), "links")
        if not new.isEmpty():
            tree = grown(tree, new)
        if most:
            left = across(left.join(todo, ["a", "b"], "left_anti"))
    return tree


def repeated(rows: DataFrame) -> DataFrame | None:
    """Components by the sets of rows of equal doc_id; nothing if each doc_id has one set."""
    several = stored(rows.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("last")).where("a < last"), "repeated")
    if several.isEmpty():
        return None
    return grown(None, rows.join(several, "doc_id").where("rep > a").select("a", F.col("rep").alias("b")).distinct())


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    sets = document_sets(docs, k)
    folded = sets.where("doc_id is not null and sig is not null").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("last"), F.first("sig").alias("sig"))
    reps = stored(folded.select(F.col("rep").alias("doc_id"), "n_shingles", "sig", "f1", "f2", "last"), "reps")
    copies = reps.where("last > doc_id").select(F.col("doc_id").alias("rep"), "n_shingles", "f1", "f2")
    out = sets.select("doc_id", "n_shingles", "f1", "f2").join(copies, ["f1", "f2", "n_shingles"], "left").withColumn("rep", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")))
    out = stored(out.select("doc_id", "n_shingles", "rep"), "rows")
    tree = joined(docs, likely(candidates(reps), reps, percent), repeated(out), k, percent)
    tree = searched(docs, reps, tree, k, percent)
    if tree is not None:
        out = out.join(tree.toDF("rep", "root"), "rep", "left")
    else:
        out = out.withColumn("root", F.lit(None).cast("long"))
    component = F.coalesce("root", "rep")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which one of each group stays, with their columns; of rows with equal doc_id all stay or go."""
    gone = near_duplicates(docs, k, percent).where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == F.col("_gone"), "left_anti")
