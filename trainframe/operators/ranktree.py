"""First node in rank order that holds a request, by trees of the largest free amounts.

A block is up to ``BLOCK`` nodes of a cluster in rank order, one row with a binary tree for each resource: a tree node has
the largest free amount below it. A request goes down from the root, left before right, and turns back where some amount
is too small, so it sees about as many tree nodes as the tree is deep, not all nodes. The blocks' roots make blocks of
their own, one row for each million nodes, in which a request finds the blocks worth a visit. These it visits in rank
order, in rounds of 1, 4, 16, .. blocks, until one holds it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainframe.session import written

BLOCK = 1024
_TREE = "names array<string>, tree array<bigint>, ranks array<bigint>, nodes array<string>"


class Tree:
    """Largest free amounts over up to BLOCK entries in order; tree node 1 is the root, 2v and 2v + 1 are below v."""

    def __init__(self, names: list[str], flat: np.ndarray):
        self.place = {n: i for i, n in enumerate(names)}
        self.tree = flat.reshape(max(len(names), 1), -1) if len(flat) else np.zeros((1, 2), np.int64)
        self.width, self.seen = self.tree.shape[1] // 2, 0

    @staticmethod
    def build(free: list[dict[str, int]]) -> tuple[list[str], np.ndarray]:
        names = sorted({n for f in free for n in f})
        width = 1 << max(len(free) - 1, 0).bit_length()
        tree = np.zeros((len(names), 2 * width), np.int64)
        for i, f in enumerate(free):
            for j, n in enumerate(names):
                tree[j, width + i] = f.get(n) or 0
        for v in range(width - 1, 0, -1):
            tree[:, v] = np.maximum(tree[:, 2 * v], tree[:, 2 * v + 1])
        return names, tree.ravel()

    def fits(self, need: dict[str, int]) -> Iterator[int]:
        """Entries whose amounts are at least those needed, in order. A request for nothing fits nowhere."""
        if not any(v > 0 for v in need.values()) or any(v > 0 and n not in self.place for n, v in need.items()):
            return
        asked = [(self.tree[self.place[n]], v) for n, v in need.items() if v > 0]
        stack = [1]
        while stack:
            v = stack.pop()
            self.seen += 1
            if all(t[v] >= x for t, x in asked):
                if v >= self.width:
                    yield v - self.width
                else:
                    stack += [2 * v + 1, 2 * v]


def trees(entries: DataFrame) -> DataFrame:
    """(cluster, block, names, tree, ranks, nodes) of (cluster, rank, node, free): one row for BLOCK entries."""
    kind = entries.schema["cluster"].dataType.simpleString()
    cells = F.struct("rank", "node", F.map_entries("free").alias("free"))
    rows = entries.withColumn("block", F.floor(F.col("rank") / BLOCK)).groupBy("cluster", "block").agg(F.sort_array(F.collect_list(cells)).alias("e"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for e in batch.column("e").to_pylist():
                names, flat = Tree.build([{x["key"]: x["value"] for x in r["free"] or []} for r in e])
                made.append((names, flat, [r["rank"] for r in e], [r["node"] for r in e]))
            kinds = (pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([m[i] for m in made], t) for i, t in enumerate(kinds))], ["cluster", "block", "names", "tree", "ranks", "nodes"])

    return rows.mapInArrow(run, f"cluster {kind}, block bigint, {_TREE}")


def roots(blocks: DataFrame) -> DataFrame:
    """(cluster, rank, node, free) of the blocks themselves: their number and the largest free amounts in them."""
    width = (F.size("tree") / F.greatest(F.size("names"), F.lit(1))).cast("int")
    top = F.transform("names", lambda n, i: F.col("tree")[i * width + 1])
    return blocks.select("cluster", F.col("block").alias("rank"), F.col("block").cast("string").alias("node"), F.map_from_arrays("names", top).alias("free"))


def _packed(requests: DataFrame, by: list[str]) -> DataFrame:
    """Requests of the same keys in arrays, as many as a batch holds: a tree is sent once for each array."""
    fields = {f.name: f.dataType.simpleString() for f in requests.schema.fields}
    rest = [c for c in fields if c not in by]
    schema = ", ".join(f"{k} {fields[k]}" for k in by) + ", asked array<struct<" + ", ".join(f"{c}:{fields[c]}" for c in rest) + ">>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            groups: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in by), strict=True)):
                groups.setdefault(key, []).append(i)
            if groups:
                order, size = [i for rows in groups.values() for i in rows], [len(rows) for rows in groups.values()]
                asked = pa.StructArray.from_arrays([batch.column(c).take(pa.array(order)) for c in rest], rest)
                heads = [pa.array([key[i] for key in groups], batch.column(k).type) for i, k in enumerate(by)]
                yield pa.RecordBatch.from_arrays([*heads, pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), asked)], [*by, "asked"])

    return requests.mapInArrow(run, schema)


def _searched(packed: DataFrame, blocks: DataFrame, by: list[str], most: int | None) -> DataFrame:
    """(cluster, shape, need, hits): entries that fit each request, in rank order; at most ``most`` of them."""
    shape = dict(packed.select(F.explode("asked").alias("a")).select("a.shape").dtypes)["shape"]
    cluster = packed.schema["cluster"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ranks, nodes = (row.column(c)[0].as_py() for c in ("ranks", "nodes"))
                tree = Tree(row.column("names")[0].as_py(), row.column("tree").flatten().to_numpy())
                asked = row.column("asked").flatten()
                shapes, needs = asked.field("shape"), asked.field("need")
                hits = []
                for s, n in zip(shapes.to_pylist(), needs.to_pylist(), strict=True):
                    found = []
                    for leaf in tree.fits({x["key"]: (x["value"] or 0) * n for x in s}):
                        found.append({"rank": ranks[leaf], "node": nodes[leaf]})
                        if len(found) == most:
                            break
                    hits.append(found)
                kind = pa.list_(pa.struct([("rank", pa.int64()), ("node", pa.string())]))
                head = pa.array([row.column("cluster")[0].as_py()] * len(hits), row.column("cluster").type)
                yield pa.RecordBatch.from_arrays([head, shapes, needs, pa.array(hits, kind)], ["cluster", "shape", "need", "hits"])

    met = packed.join(blocks, by).select("cluster", "asked", "names", "tree", "ranks", "nodes")
    return met.mapInArrow(run, f"cluster {cluster}, shape {shape}, need bigint, hits array<struct<rank:bigint,node:string>>")


def first_nodes(requests: DataFrame, ranked_nodes: DataFrame) -> DataFrame:
    """(cluster, shape, need, rank, node) of the requests that some node holds ``need`` times; the first one by rank.

    ``shape`` is an array of (key, value) amounts. Equal requests should come once.
    """
    nodes = ranked_nodes.select("cluster", F.col("rank").cast("bigint").alias("rank"), F.col("node").cast("string").alias("node"), F.col("free").cast("map<string,bigint>").alias("free"))
    blocks = written(trees(nodes), "blocks")
    tops = trees(roots(blocks)).drop("block")
    asked = requests.filter("cluster is not null and shape is not null").select("cluster", "shape", F.col("need").cast("bigint").alias("need"))
    key = ["cluster", "shape", "need"]
    worth = _searched(_packed(asked, ["cluster"]), tops, ["cluster"], None)  # one row for each million nodes
    worth = worth.groupBy(*key).agg(F.sort_array(F.flatten(F.collect_list("hits")))["rank"].alias("worth"))
    left, answers, share = written(worth.filter(F.size("worth") > 0), "worth"), [], 1
    while not left.isEmpty():
        each = left.select(*key, F.explode(F.slice("worth", 1, share)).alias("block"))
        found = _searched(_packed(each, ["cluster", "block"]), blocks, ["cluster", "block"], 1)
        best = written(found.filter(F.size("hits") > 0).groupBy(*key).agg(F.min(F.col("hits")[0]).alias("b")), "found")
        answers.append(best)
        rest = left.join(best, key, "left_anti").select(*key, F.slice("worth", share + 1, 1 << 30).alias("worth"))
        left, share = written(rest.filter(F.size("worth") > 0), "worth"), 4 * share
    if not answers:
        return left.select(*key, F.lit(None).cast("bigint").alias("rank"), F.lit(None).cast("string").alias("node"))
    out = answers[0]
    for more in answers[1:]:
        out = out.unionByName(more)
    return out.select(*key, "b.rank", "b.node")
