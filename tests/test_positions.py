import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from trainframe.operators import noise as Z
from trainframe.operators import position as P
from trainframe.operators.blocked import running, step_block


def test_hash_position_is_dense_and_independent_of_partitions(spark):
    df = spark.range(5000)
    a = P.hash_position(df, P.seeded_key(1, "id"), ["id"], total="n").toPandas().sort_values("id")
    b = P.hash_position(df.repartition(13), P.seeded_key(1, "id"), ["id"], digits=1).toPandas().sort_values("id")
    assert sorted(a["pos"]) == list(range(5000)) and (a["pos"].values == b["pos"].values).all() and (a["n"] == 5000).all()
    assert not (a["pos"].values == P.hash_position(df, P.seeded_key(2, "id"), ["id"]).toPandas().sort_values("id")["pos"].values).all()


@pytest.mark.parametrize("buckets", [2, 7, 300])
def test_prefix_sum_with_clustered_keys(spark, buckets):
    rng = np.random.default_rng(0)
    keys = np.unique(np.concatenate([rng.integers(0, 50, 40), rng.integers(10**12, 10**12 + 500, 300), [-(10**15), 10**17]]))
    pdf = pd.DataFrame({"k": keys, "v": rng.integers(0, 9, len(keys))})
    got = P.prefix_sum(spark.createDataFrame(pdf), "k", F.col("v"), buckets, total="n").toPandas().sort_values("k")
    assert (got["pos"].values == pdf["v"].cumsum().values - pdf["v"].values).all() and (got["n"] == pdf["v"].sum()).all()


def test_sorted_position_with_one_hot_leading_key(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 10 < 8, 1).otherwise(F.col("id") % 7).alias("k"))
    got = P.sorted_position(df, [F.col("k").desc(), "id"]).toPandas()
    want = got.sort_values(["k", "id"], ascending=[False, True])
    assert list(want["pos"]) == list(range(4000))


@pytest.mark.parametrize("size", [1, 3, 1000])
@pytest.mark.parametrize("exclusive", [False, True])
def test_running_equals_plain_window(spark, size, exclusive):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.choice([0, 0, 0, 1, 2], 300), "t": rng.permutation(300), "v": rng.integers(-50, 50, 300)})
    df = spark.createDataFrame(pdf)
    v = F.when(F.col("v") % 5 != 0, F.col("v"))
    out = running(df, ["g"], ["t"], step_block("t", size), sums={"s": v}, maxs={"hi": v}, mins={"lo": v}, lags={"was": v}, leads={"nxt": v}, exclusive=exclusive)
    got = out.toPandas().sort_values(["g", "t"]).reset_index(drop=True)
    pdf["x"] = pdf["v"].where(pdf["v"] % 5 != 0)
    for _, p in pdf.sort_values(["g", "t"]).groupby("g"):
        mine = got[got["t"].isin(p["t"])]
        x = list(p["x"])
        for i in range(len(x)):
            seen = [a for a in x[: i if exclusive else i + 1] if not np.isnan(a)]
            row = mine.iloc[i]
            for name, f in (("s", sum), ("hi", max), ("lo", min)):
                assert (pd.isna(row[name]) and not seen) or row[name] == f(seen)
            for name, j in (("was", i - 1), ("nxt", i + 1)):
                want = x[j] if 0 <= j < len(x) else np.nan
                assert (pd.isna(row[name]) and np.isnan(want)) or row[name] == want


@pytest.mark.parametrize("scale", [1.0, 40.0, 900.0])
def test_decayed_average_over_many_anchors(spark, scale):
    """Total log-decay far beyond the range of doubles, against a plain loop."""
    rng = np.random.default_rng(2)
    n = 3000
    pdf = pd.DataFrame({"run": 0, "step": range(n), "v": rng.normal(5, 2, n), "sc": scale * rng.uniform(0.5, 1.5, n)})
    df = spark.createDataFrame(pdf)
    out = Z.decayed_average(df, ["run"], "step", F.pow(F.lit(0.999), F.col("sc")), {"a": F.col("v")}, block=step_block("step", 97))
    got = out.toPandas().sort_values("step")["a"].values
    b = u = 0.0
    want = []
    for v, s in zip(pdf["v"], pdf["sc"]):
        t = 0.999**s
        b, u = t * b + (1 - t) * v, t * u + (1 - t)
        want.append(b / u)
    assert np.allclose(got, want, rtol=1e-9)


def test_null_group_key_fails_instead_of_vanishing(spark):
    df = spark.createDataFrame([(1, 1), (None, 2)], "g int, t int")
    with pytest.raises(Exception, match="null group or order key"):
        running(df, ["g"], ["t"], step_block("t"), sums={"s": F.col("t")}).collect()
