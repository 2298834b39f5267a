"""First fits by trees over ranked nodes: against a scan, and how many tree nodes a request sees."""

import random

import pytest

from trainframe.operators import ranktree as R


def scan(nodes, shape, need):
    if not any(v > 0 for v in shape.values()):
        return None
    return next((r for r, free in nodes if all((free.get(k) or 0) >= v * need for k, v in shape.items())), None)


@pytest.mark.parametrize("block", [2, 4, 1024])
def test_first_nodes(spark, monkeypatch, block):
    """Several resources, so that a subtree with large enough maxima may still hold no node that fits."""
    monkeypatch.setattr(R, "BLOCK", block)
    rng = random.Random(block)
    nodes = [(c, r, {k: rng.randint(0, 9) for k in rng.sample(["cpu", "mem", "gpu"], rng.randint(0, 3))}) for c in ("a", "b") for r in range(40)]
    shapes = [{k: rng.randint(0, 9) for k in rng.sample(["cpu", "mem", "gpu", "none"], rng.randint(0, 3))} for _ in range(60)]
    asked = {(c, tuple(sorted(s.items())), need) for c in ("a", "b", "empty") for s in shapes for need in (1, 2)}
    df = spark.createDataFrame([(c, r, f"n{r}", f) for c, r, f in nodes], "cluster string, rank int, node string, free map<string,int>").repartition(3)
    req = spark.createDataFrame([(c, list(s), n) for c, s, n in asked], "cluster string, shape array<struct<key:string,value:bigint>>, need int").repartition(3)
    got = {(r["cluster"], tuple((x["key"], x["value"]) for x in r["shape"]), r["need"]): (r["rank"], r["node"]) for r in R.first_nodes(req, df).collect()}
    want = {}
    for c, s, n in asked:
        hit = scan([(r, f) for cl, r, f in nodes if cl == c], dict(s), n)
        if hit is not None:
            want[c, s, n] = (hit, f"n{hit}")
    assert got == want and len(want) > 20


def test_no_nodes_and_no_requests(spark):
    nodes = spark.createDataFrame([], "cluster string, rank int, node string, free map<string,int>")
    req = spark.createDataFrame([("a", [("cpu", 1)], 1), (None, None, 1)], "cluster string, shape array<struct<key:string,value:bigint>>, need int")
    assert R.first_nodes(req, nodes).count() == 0 and R.first_nodes(req.limit(0), nodes).count() == 0


@pytest.mark.parametrize("n", [64, 1024])
def test_tree_nodes_seen_grow_with_the_logarithm(n):
    """A request sees about twice the depth of the tree, whichever node holds it, not all nodes before it."""
    free = [{"cpu": i} for i in range(n)]
    tree = R.Tree(*R.Tree.build(free))
    for need in range(1, n, 7):
        tree.seen = 0
        assert next(tree.fits({"cpu": need})) == need
        assert tree.seen <= 2 * (n.bit_length() - 1) + 1
    tree.seen = 0
    assert list(tree.fits({"cpu": n})) == [] and tree.seen == 1
