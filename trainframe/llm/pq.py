"""Near-duplicate vectors by product quantisation.

Equal vectors fold to one with a count. Coarse centroids and the codebooks of ``PARTS`` subspaces are fitted on a bounded
sample (``SAMPLE`` vectors); every vector is indexed: it stands in the list of its nearest centroid with the codes of its residual and the exact
size of its coding error. A query probes each list whose border is no farther than a margin. With ``recall`` 1 that is as far as a partner
at the least similarity can be, so no pair is missed; below 1 the margin is the one at which that share of test partners is found from either end: partners
at exactly the least cosine, made of sampled vectors in the direction of other sampled ones, and true partners in the sample by brute force (the larger of both margins).
A pair that only one end finds counts for both. In a list, distances come from look-up tables per query;
a member stays if the distance less its coding error allows the similarity, which loses nothing; those are ranked by their exact cosine
in double precision. Lists are cut into blocks of members and of queries, so a hot list is many tasks; a task returns
counts per query and one link per vector to the smallest of its local component, never all pairs.

Null, zero, or non-finite vectors, and those with null components, link with nothing, and form their own component.
A vector shorter than others is continued by zeros. Every row counts as a vector, repeated vec_ids too. A null vec_id is not linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainframe.llm.components import components
from trainframe.llm.store import stored

SAMPLE, PARTS, CODES, PER_LIST, MOST_LISTS, TESTED = 16384, 8, 64, 256, 1024, 4096
BLOCK = 2048


def kmeans(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([((c * c).sum(1) - 2 * x[i : i + 4096] @ c.T).argmin(1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def padded(column: pa.Array, d: int) -> np.ndarray:
    """Vectors as rows, short ones continued by zeros."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), d))
    out[np.repeat(np.arange(len(column)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in double precision; large and small values neither overflow nor vanish."""
    if not len(rows):
        return rows
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _codes(residual: np.ndarray, books: np.ndarray) -> np.ndarray:
    step = books.shape[2]
    return np.stack([nearest(residual[:, i * step : (i + 1) * step], books[i]) for i in range(len(books))], 1).astype(np.uint8)


def fit(sample: np.ndarray, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Coarse centroids, and one codebook per subspace."""
    centres = kmeans(sample, lists)
    residual = sample - centres[nearest(sample, centres)]
    step = sample.shape[1] // PARTS
    return centres, np.stack([kmeans(residual[:, i * step : (i + 1) * step], CODES) if len(residual) >= CODES else np.resize(residual[:, i * step : (i + 1) * step], (CODES, step)) for i in range(PARTS)])


def beyond(x: np.ndarray, own: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """How far each vector is from the border of each list; 0 for its own."""
    size = (centres**2).sum(1)
    far = size[None] - 2 * x @ centres.T
    gaps = np.sqrt(np.maximum(size[own][:, None] + size[None] - 2 * centres[own] @ centres.T, 1e-12))
    out = (far - far[np.arange(len(x)), own][:, None]) / (2 * gaps)
    out[np.arange(len(x)), own] = 0
    return out


def margin_of(sample: np.ndarray, centres: np.ndarray, least: float, recall: float, seed: int = 9) -> float:
    """Smallest margin that finds the given share of test partners; the widest one where the sample has too few to tell."""
    widest = float(np.sqrt(2 - 2 * least) + 1e-6)  # between two unit vectors at the least cosine
    if recall >= 1:
        return widest
    x = sample[:TESTED]
    off = np.random.default_rng(seed).permutation(sample)[: len(x)]
    off = off - (off * x).sum(1, keepdims=True) * x
    size = np.sqrt((off * off).sum(1))
    a = x[size > 1e-6]
    b = least * a + np.sqrt(1 - least * least) * off[size > 1e-6] / size[size > 1e-6, None]
    true = [(i + q, m) for i in range(0, len(x), 256) for q, m in [np.nonzero(x[i : i + 256] @ sample.T >= least)]]
    q, m = (np.concatenate([t[k] for t in true]) if true else np.zeros(0, np.int64) for k in (0, 1))
    q, m = q[q != m], m[q != m]
    out = 0.0
    for left, right, must in ((a, b, True), (sample[q], sample[m], False)):
        need = []
        for at in range(0, len(left), 4096):
            u, v = left[at : at + 4096], right[at : at + 4096]
            own_u, own_v, rows = nearest(u, centres), nearest(v, centres), np.arange(len(u))
            need.append(np.minimum(beyond(u, own_u, centres)[rows, own_v], beyond(v, own_v, centres)[rows, own_u]))
        need = np.sort(np.concatenate(need)) if need else np.zeros(0)
        at = int(np.ceil(recall * (len(need) + 1))) - 1
        if at < len(need):
            out = max(out, float(need[at]))
        elif must:
            return widest
    return min(out, widest)


def links_of(queries: np.ndarray, members: np.ndarray, codes: np.ndarray, error: np.ndarray, centre: np.ndarray, books: np.ndarray, least: float) -> np.ndarray:
    """Which queries and members of a list have at least the given cosine."""
    reach = np.sqrt(2 - 2 * least) + 1e-6
    step = books.shape[2]
    residual = (queries - centre).astype(np.float32)
    far = np.zeros((len(queries), len(members)), np.float32)
    for i, book in enumerate(books):
        part = residual[:, i * step : (i + 1) * step]
        table = ((part[:, None, :] - book[None].astype(np.float32)) ** 2).sum(2)
        far += table[:, codes[:, i]]
    near = np.sqrt(far) - error[None].astype(np.float32) <= reach + 1e-3
    out = np.zeros(near.shape, bool)
    if near.mean() > 0.02:
        out = near & (queries @ members.T >= least)
    else:
        q, m = np.nonzero(near)
        for at in range(0, len(q), 65536):
            a, b = q[at : at + 65536], m[at : at + 65536]
            out[a, b] = np.einsum("ij,ij->i", queries[a], members[b]) >= least
    return out


def local_roots(linked: np.ndarray, q_ids: np.ndarray, m_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest id in the component of each query and member by the links of this block."""
    q, m = q_ids.copy(), m_ids.copy()
    while True:
        new_m = np.minimum(m, np.where(linked, q[:, None], 2**63 - 1).min(0, initial=2**63 - 1))
        new_q = np.minimum(q, np.where(linked, new_m[None], 2**63 - 1).min(1, initial=2**63 - 1))
        if (new_m == m).all() and (new_q == q).all():
            return q, m
        q, m = new_q, new_m


def seen_back(homes: np.ndarray, probes: pa.Array, here: int) -> np.ndarray:
    """Whether a member of this list, asked by a query, meets it as a query too: in the query's own list, if it probes that."""
    lists, at = np.unique(homes, return_inverse=True)
    sizes = pa.compute.list_value_length(probes).to_numpy(zero_copy_only=False).astype(np.int64)
    asked = probes.flatten().to_numpy(zero_copy_only=False)
    place = np.minimum(np.searchsorted(lists, asked), len(lists) - 1)
    hit = lists[place] == asked
    out = np.zeros((len(probes), len(lists)), bool)
    out[np.repeat(np.arange(len(probes)), sizes)[hit], place[hit]] = True
    return out[:, at].T | (homes == here)[:, None]


def vector_duplicates(vectors: DataFrame, least: float = 0.9, recall: float = 1.0) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    e = F.col("embedding")
    fine = F.col("vec_id").isNotNull() & e.isNotNull() & ~F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), e.cast("array<double>").alias("embedding")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    rows = rows.withColumn("h1", F.xxhash64("embedding")).withColumn("h2", F.xxhash64(F.lit(1), "embedding"))
    folded = rows.where("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"))
    reps = stored(folded, "vectors")
    head = reps.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if not head["n"]:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    d = -(-head["d"] // PARTS) * PARTS
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"  # as exact as the input
    sample = reps.select("rep", "embedding").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("embedding").toArrow()
    known = unit(padded(sample.column(0).combine_chunks(), d))
    centres, books = fit(known, max(1, min(MOST_LISTS, head["n"] // PER_LIST)))
    margin = margin_of(known, centres, least, recall)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                raw = padded(part.column("embedding"), d)
                x = unit(raw)
                own = nearest(x, centres)
                residual = x - centres[own]
                codes = _codes(residual, books)
                error = np.sqrt(((residual - np.concatenate([books[i][codes[:, i]] for i in range(PARTS)], 1)) ** 2).sum(1))
                probes = [np.flatnonzero(b).tolist() for b in beyond(x, own, centres) <= margin]
                yield pa.RecordBatch.from_arrays([part.column("rep"), part.column("copies"), pa.array([v.tobytes() for v in raw.astype(kind)], pa.binary()), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(probes, pa.list_(pa.int32()))], ["id", "copies", "vec", "list", "code", "error", "probes"])

    indexed = stored(reps.mapInArrow(index, "id long, copies long, vec binary, list int, code binary, error double, probes array<int>"), "index")
    members = {r["list"]: r["count"] for r in indexed.groupBy("list").count().collect()}
    asked = {r["list"]: r["count"] for r in indexed.select(F.explode("probes").alias("list")).groupBy("list").count().collect()}
    cuts = spark.createDataFrame([(int(k), -(-members[k] // BLOCK), -(-asked.get(k, 1) // BLOCK)) for k in members], "list int, mb int, qb int")
    hashed = F.xxhash64("id")
    side_m = indexed.join(F.broadcast(cuts), "list").select("list", F.pmod(hashed, "mb").cast("int").alias("m"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q"), F.lit(0).alias("side"), "id", "copies", "vec", "code", "error", F.col("list").alias("home"), "probes")
    side_q = indexed.select("id", "copies", "vec", F.col("list").alias("home"), F.explode("probes").alias("list")).join(F.broadcast(cuts), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), F.pmod(hashed, "qb").cast("int").alias("q"), F.lit(1).alias("side"), "id", "copies", "vec", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("error"), "home", F.lit(None).cast("array<int>").alias("probes"))

    def compare(block: pa.Table) -> pa.Table:
        side = block.column("side").to_numpy()
        mine, theirs = block.filter(pa.array(side == 0)), block.filter(pa.array(side == 1))
        none = pa.table({"id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not mine.num_rows or not theirs.num_rows:
            return none
        x, y = (unit(np.frombuffer(b"".join(t.column("vec").to_pylist()), kind).astype(np.float64).reshape(-1, d)) for t in (theirs, mine))
        codes = np.frombuffer(b"".join(mine.column("code").to_pylist()), np.uint8).reshape(-1, PARTS)
        linked = links_of(x, y, codes, mine.column("error").to_numpy(), centres[block.column("list")[0].as_py()], books, least)
        q_ids, m_ids = theirs.column("id").to_numpy(), mine.column("id").to_numpy()
        linked &= q_ids[:, None] != m_ids[None]
        q_any, m_any = linked.any(1), linked.any(0)
        if not q_any.any():
            return none
        n = linked @ mine.column("copies").to_numpy()
        once = linked & ~seen_back(theirs.column("home").to_numpy(), mine.column("probes").combine_chunks(), block.column("list")[0].as_py())
        n_back = theirs.column("copies").to_numpy() @ once
        linked = linked[q_any][:, m_any]
        q_root, m_root = local_roots(linked, q_ids[q_any], m_ids[m_any])
        return pa.table({"id": np.concatenate([q_ids[q_any], m_ids[m_any]]), "n": np.concatenate([n[q_any], n_back[m_any]]), "root": np.concatenate([q_root, m_root])})

    found = stored(side_m.unionByName(side_q).groupBy("list", "m", "q").applyInArrow(compare, "id long, n long, root long"), "found")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    tree = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per = reps.select("h1", "h2", "rep", "copies").join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(tree.withColumnRenamed("id", "rep"), "rep", "left")
    per = per.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component"))
    out = rows.where("fine").select("vec_id", "h1", "h2").join(per, ["h1", "h2"]).select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
