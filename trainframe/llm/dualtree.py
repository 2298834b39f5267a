"""Ranked lexical search of all documents for every item by two trees with coordinate maxima.

A document has a coordinate for each term, how much the term counts in it, and an item one for each of its terms, the
term's weight; the score is their product summed over terms, in whole numbers. Texts are read once and become sparse
vectors over the items' terms. In each task, documents come in groups ordered by their best term and get a binary tree
over leaves of ``LEAF`` documents; items have a tree of their own. A node holds for each term the largest coordinate
below it, so the product of two nodes bounds every score between them. Both trees are walked from the top, level by
level, and a pair of nodes goes when its bound is below the weakest k-th score of the node's items; the documents of
leaves that are left are scored exactly, best bounds first. Ties with a k-th score are never pruned.

The k-th scores begin with those of at most about ``SEEDS`` documents, ranked by the same search: they are lower bounds
of the final ones and only decide how much is pruned. Each task returns its best k documents of each item; a window
ranks them.

Items come in blocks of ``ITEM_BYTES`` bytes of text (and one item at most beyond), so what a task holds does not grow
with their number: each block is a search of its own. A null or wordless item or document has no terms and never meets.
A document with a null doc_id counts in the statistics but cannot be returned. Rows of equal doc_id are ranked each for
itself; items equal in item_id and text are one. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trainframe.llm import terms as W
from trainframe.llm import textscan as T
from trainframe.llm.store import stored
from trainframe.operators.position import prefix_sum

LEAF, ITEM_BYTES, SEEDS = 16, 1 << 20, 4096
#: Bytes of the coordinate maxima of a group's leaves, and the most documents of a group.
TREE_BYTES, GROUP = 64 << 20, 8192


class Items:
    """The items of a block: their terms, weights and tree."""

    def __init__(self, item_ids: list, texts: list[str | None]):
        words, index, first = W.words(pa.array(texts, pa.string()))
        self.words, self.ids = words, item_ids
        self.terms = [np.unique(index[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]

    def weigh(self, df: np.ndarray, n: int) -> None:
        """Term weights from document frequencies, and the item tree: nodes as (first, last item in order, terms, maxima)."""
        self.weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)
        top = [t[np.argmax(self.weight[t])] if len(t) else -1 for t in self.terms]
        self.order = sorted(range(len(self.ids)), key=lambda i: (top[i], i))


def block_items(items: DataFrame, bytes_per_block: int = ITEM_BYTES) -> DataFrame:
    """item_id, text and block of every distinct item: blocks hold about equal bytes of text."""
    size = F.length(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).cast("long") + 1
    rows = stored(items.select("item_id", "text").distinct().withColumn("size", size).withColumn("at", F.xxhash64("item_id", "text")), "items")
    at = rows.groupBy("at").agg(F.sum("size").alias("size"))
    placed = prefix_sum(at, "at", F.col("size"), out="before")
    return stored(rows.select("item_id", "text", "at").join(placed.select("at", F.floor(F.col("before") / bytes_per_block).alias("block")), "at"), "blocks")


def vectors(docs: DataFrame, items: Items) -> DataFrame:
    """doc_id, n, and the terms of the items (places among them, occurrences) of every document that has words."""
    shared = docs.sparkSession.sparkContext.broadcast(items.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for part in T.slices(batch, "text"):
                words, index, first = W.words(part.column("text"))
                n = np.diff(first)
                place = pa.compute.index_in(words, wanted).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[index]
                row = np.repeat(np.arange(len(n)), n)
                hit = place >= 0
                cell, times = np.unique(row[hit] * len(wanted) + place[hit], return_counts=True)
                at = np.searchsorted(cell // max(len(wanted), 1), np.arange(len(n) + 1))
                term, times = (cell % max(len(wanted), 1)).astype(np.int32), times.astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(v)) for v in (term, times)]
                got = pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), *lists], ["doc_id", "n", "terms", "times"])
                yield got.filter(pa.array(n > 0))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(run, "doc_id long, n long, terms array<int>, times array<int>"), "vectors")


def document_frequencies(vecs: DataFrame, n_terms: int) -> np.ndarray:
    """Documents that hold each term; a task sends one row for each term at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=n_terms)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["term", "n"])

    out = np.zeros(n_terms, np.int64)
    for r in vecs.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


class Best:
    """The k best documents of each item so far, and the score that a further one needs."""

    def __init__(self, floor: np.ndarray, k: int):
        self.k, self.floor = k, floor.copy()
        self.score = [np.zeros(0, np.int64) for _ in floor]
        self.doc = [np.zeros(0, np.int64) for _ in floor]

    def add(self, item: int, score: np.ndarray, doc: np.ndarray) -> None:
        good = score >= self.floor[item]
        if good.any():
            score, doc = np.concatenate([self.score[item], score[good]]), np.concatenate([self.doc[item], doc[good]])
            order = np.lexsort((doc, -score))[: self.k]
            self.score[item], self.doc[item] = score[order], doc[order]
            if len(order) == self.k:
                self.floor[item] = max(self.floor[item], self.score[item][-1])


class Group:
    """Some documents with their coordinates, in the order of their best terms, and the tree over them."""

    def __init__(self, ids: np.ndarray, coord: np.ndarray, term: np.ndarray, first: np.ndarray, weight: np.ndarray):
        gain = weight[term] * coord
        row = np.repeat(np.arange(len(ids)), np.diff(first))
        best = np.lexsort((-gain, row))[first[:-1]]  # every document has a term here
        order = np.lexsort((ids, term[best]))
        size = np.diff(first)[order]
        self.ids, self.first = ids[order], np.concatenate([[0], np.cumsum(size)])
        at = np.arange(self.first[-1]) + np.repeat(first[:-1][order] - self.first[:-1], size)
        self.coord, self.term = coord[at], term[at]
        leaves = -(-len(ids) // LEAF)
        low = np.zeros((leaves, len(weight)))
        np.maximum.at(low, (np.repeat(np.arange(len(ids)), size) // LEAF, self.term), self.coord)
        self.levels = [low]  # leaves first, then their parents, up to one root
        while len(self.levels[-1]) > 1:
            x = self.levels[-1]
            up = x[::2].copy()
            np.maximum(up[: len(x) // 2], x[1::2], out=up[: len(x) // 2])
            self.levels.append(up)
        self.scored = 0

    def bounds(self, level: int, nodes: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores between an item node and document nodes, rounding included."""
        return self.levels[level][nodes[:, None], terms[None]] @ weights * (1 + 1e-9)

    def exact(self, leaves: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the documents of some leaves."""
        rows = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
        rows = rows[rows < len(self.ids)]
        size = self.first[rows + 1] - self.first[rows]
        at = np.arange(size.sum()) + np.repeat(self.first[rows] - (np.cumsum(size) - size), size)
        self.scored += len(rows)
        return np.add.reduceat(self.coord[at] * dense[self.term[at]], np.cumsum(size) - size), self.ids[rows]

    def search(self, items: Items, best: Best) -> None:
        """Walk both trees from their roots; item nodes are ranges of the item order."""
        top = len(self.levels) - 1
        stack = [(0, len(items.order), top, np.zeros(1, np.int64))]
        while stack:
            a, b, level, nodes = stack.pop()
            mine = [items.order[i] for i in range(a, b)]
            if b - a == 1:
                terms, weights = items.terms[mine[0]], items.weight[items.terms[mine[0]]].astype(float)
            else:  # a term's maximum over the items that have it is its weight
                terms = np.unique(np.concatenate([items.terms[i] for i in mine]))
                weights = items.weight[terms].astype(float)
            need = min(best.floor[i] for i in mine)
            bound = self.bounds(level, nodes, terms, weights)
            left = bound >= need
            nodes, bound = nodes[left], bound[left]
            if not len(nodes):
                continue
            if b - a == 1 and level == 0:
                self.score_leaves(items, mine[0], nodes, bound, best)
                continue
            if level:
                nodes = np.unique(np.concatenate([2 * nodes, 2 * nodes + 1]))
                nodes, level = nodes[nodes < len(self.levels[level - 1])], level - 1
            half = (a + b) // 2
            stack += [(a, b, level, nodes)] if b - a == 1 else [(half, b, level, nodes), (a, half, level, nodes)]

    def score_leaves(self, items: Items, item: int, leaves: np.ndarray, bound: np.ndarray, best: Best) -> None:
        dense = np.zeros(len(items.weight), np.int64)
        dense[items.terms[item]] = items.weight[items.terms[item]]
        order, step, at = np.argsort(-bound, kind="stable"), 2, 0
        while at < len(order) and bound[order[at]] >= best.floor[item]:
            best.add(item, *self.exact(leaves[order[at : at + step]], dense))
            at, step = at + step, 2 * step


def coordinates(n: np.ndarray, tf: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """How much a term counts in a document of n terms that holds it tf times."""
    return 1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * n * n_docs // n_terms))


def searched(vecs: DataFrame, items: Items, n_docs: int, n_terms: int, floor: np.ndarray, k: int) -> DataFrame:
    """Of each task the k best documents of every item (item, doc_id, score) that reach the item's floor."""
    shared = vecs.sparkSession.sparkContext.broadcast((items, floor))  # bounded by ITEM_BYTES of text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, floor = shared.value
        best, most = Best(floor, k), LEAF * max(8, TREE_BYTES // (8 * max(len(items.weight), 1)) // LEAF)
        for batch in batches:
            for at in range(0, batch.num_rows, min(GROUP, most)):
                part = batch.slice(at, min(GROUP, most))
                lists = part.column("terms")
                first = lists.offsets.to_numpy().astype(np.int64)
                term, times = lists.flatten().to_numpy().astype(np.int64), part.column("times").flatten().to_numpy().astype(np.int64)
                coord = coordinates(np.repeat(part.column("n").to_numpy(), np.diff(first)), times, n_docs, n_terms)
                Group(part.column("doc_id").to_numpy(), coord, term, first - first[0], items.weight).search(items, best)
        of = np.repeat(np.arange(len(floor)), [len(s) for s in best.score])
        columns = [of, np.concatenate([*best.doc, np.zeros(0, np.int64)]), np.concatenate([*best.score, np.zeros(0, np.int64)])]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item", "doc_id", "score"])

    able = vecs.where("doc_id is not null and size(terms) > 0").select("doc_id", "n", "terms", "times")
    found = able.mapInArrow(run, "item long, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _block(docs: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Ranked documents of one block of items."""
    spark = docs.sparkSession
    got = sorted(rows.collect(), key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"] or ""))  # ITEM_BYTES of text
    items = Items([r["item_id"] for r in got], [r["text"] for r in got])
    vecs = vectors(docs, items)
    n_docs, n_terms = (v or 0 for v in vecs.agg(F.count("*"), F.sum("n")).first())
    items.weigh(document_frequencies(vecs, len(items.words)), n_docs)
    floor = np.ones(len(got), np.int64)
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(min(1.0, SEEDS / max(n_docs, 1)) * (1 << 30))
    for r in searched(vecs.where(share), items, n_docs, n_terms, floor, k).where(F.col("rank") == k).select("item", "score").collect():
        floor[r["item"]] = r["score"]
    names = spark.createDataFrame([(i, item) for i, item in enumerate(items.ids)], "item long, item_id long")
    found = searched(vecs, items, n_docs, n_terms, floor, k)
    return stored(found.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"), "ranked")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of the k highest-scoring documents of each item; fewer if fewer score above 0."""
    spark = docs.sparkSession
    placed = block_items(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), item_bytes)
    blocks = [r["block"] for r in placed.select("block").distinct().orderBy("block").toLocalIterator()]
    found = [_block(docs, placed.where(F.col("block") == b).select("item_id", "text"), k) for b in blocks]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
