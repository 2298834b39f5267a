"""Throughput-model fits per job, fit errors, and user-defined reductions over groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainframe.functions import perf
from trainframe.session import for_compute

# Start, lower and upper bounds in parameter order, penalty weights, and the factor by which
# network parameters across nodes exceed those within a node when only the latter were seen.
START = np.array([0.1, 0.01, 0.1, 0.01, 0.1, 0.01, 1.001])
LOWER = np.array([1e-8] * 6 + [1.0])
UPPER = np.array([np.inf] * 6 + [10.0])
GAMMA_WEIGHT, GROWTH_WEIGHT = 1e-3, 1e-2
ACROSS_NODES = 1.1

FIT_SCHEMA = "job_id bigint, " + ", ".join(f"{p} double" for p in perf.PARAMS) + ", loss double, settled boolean"
ROUNDS = 1000

# Jobs stepped together, and their configurations with padding: some 10 MB in a line search.
FIT_BLOCK, FIT_CELLS = 256, 1 << 14


def fit_loss(p: np.ndarray, nodes, replicas, bsz, accum, optim, share=None) -> np.ndarray:
    """Objective for one or many parameter rows at once: log errors of both times plus two penalties.

    The data broadcast against ``p`` without its last axis; ``share`` weighs the rows (zero for padding), evenly by default.
    """
    ac, bc, an, bn, ar, br, g = (x[..., None] for x in np.moveaxis(np.asarray(p, float), -1, 0))
    extra = np.maximum(replicas - 2, perf.TINY)
    across, within = nodes > 1, (nodes <= 1) & (replicas > 1)
    net = np.where(across, an + bn * extra, np.where(within, ar + br * extra, perf.TINY * (1 + extra)))
    comp = ac + bc * bsz
    log_comp = np.log(comp)
    both = np.logaddexp(g * log_comp, g * np.log(net)) / g
    mean = (lambda e: np.mean(e, -1)) if share is None else (lambda e: np.sum(e * share, -1))
    err = np.sqrt(mean((log_comp - np.log(accum)) ** 2)) + np.sqrt(mean((both - np.log(optim)) ** 2))
    growth = (bn / an) ** 2 + (br / ar) ** 2
    return err + GAMMA_WEIGHT * (g[..., 0] - 1) ** 2 + GROWTH_WEIGHT * growth[..., 0]


def minimize_all(f: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, lo: np.ndarray, hi: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Projected BFGS inside a box for many problems side by side, each with a state of its own.

    ``f`` takes points (problems, points, dims) and the numbers of the problems. Gradients are central differences.
    A problem leaves the block once it settles: no step gains more than a part in 100,000. Returns the best points and
    which problems settled before the rounds ran out.
    """
    n, dims = x.shape
    x, move, eye, sizes = x.copy(), hi > lo, np.eye(dims), 0.5 ** np.arange(30)
    dot = lambda a, b: np.einsum("...d,...d->...", a, b)

    def gradient(at, x):
        step = 1e-6 * move[at][:, :, None] * eye
        v = f(np.concatenate([x[:, None] + step, x[:, None] - step], 1), at)
        return np.where(move[at], (v[:, :dims] - v[:, dims:]) / 2e-6, 0.0)

    at = np.arange(n)
    fx, g, h = f(x[:, None], at)[:, 0], gradient(at, x), np.tile(eye, (n, 1, 1))
    quiet, settled, plain = np.zeros(n, int), np.zeros(n, bool), np.ones(n, bool)  # plain: h is the identity
    for _ in range(rounds):
        free = move & ~((x <= lo) & (g > 0)) & ~((x >= hi) & (g < 0))
        settled |= np.max(np.where(free, np.abs(g), 0.0), 1) < 1e-9
        at = np.flatnonzero(~settled)
        if not len(at):
            break
        fr, gr = free[at], np.where(free[at], g[at], 0.0)
        d = np.where(fr, -np.einsum("jab,jb->ja", h[at], gr), 0.0)
        up = dot(d, g[at]) >= 0
        d[up], h[at[up]], plain[at[up]] = -gr[up], eye, True
        good, tries, values = np.zeros((len(at), 30), bool), np.zeros((len(at), 30, dims)), np.zeros((len(at), 30))
        rest = np.arange(len(at))
        for part in (slice(0, 4), slice(4, 30)):  # most steps are taken at one of the first sizes
            to = at[rest]
            t = np.clip(x[to][:, None] + sizes[part][:, None] * np.clip(d[rest], -3, 3)[:, None], lo[to][:, None], hi[to][:, None])
            v = f(t, to)
            tries[rest, part], values[rest, part] = t, v
            good[rest, part] = v < fx[to][:, None] + 1e-4 * dot(t - x[to][:, None], g[to][:, None])
            rest = rest[~good[rest].any(1)]
            if not len(rest):
                break
        stuck = at[rest]
        settled[stuck[plain[stuck]]] = True
        h[stuck], plain[stuck] = eye, True
        on = np.flatnonzero(good.any(1))
        if not len(on):
            continue
        to, i = at[on], np.argmax(good[on], 1)
        new, value = tries[on, i], values[on, i]
        s, gn = new - x[to], gradient(to, new)
        y = gn - g[to]
        sy = dot(s, y)
        curved = sy > 1e-12
        r = 1 / np.where(curved, sy, 1.0)
        v = eye - r[:, None, None] * s[:, :, None] * y[:, None, :]
        hn = v @ h[to] @ np.swapaxes(v, 1, 2) + r[:, None, None] * s[:, :, None] * s[:, None, :]
        h[to] = np.where(curved[:, None, None], hn, h[to])
        plain[to] &= ~curved
        quiet[to] = np.where(fx[to] - value < 1e-5 * (1e-3 + fx[to]), quiet[to] + 1, 0)
        x[to], fx[to], g[to] = new, value, gn
        settled[to[quiet[to] > 2]] = True
    return x, settled


def fit_models(data: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters, losses and whether the search settled for many jobs at once.

    Each job gives (nodes, replicas, local_bsz, accum, optim). Jobs are padded to the most rows and stepped together.
    What a job's rows say nothing about is held fixed.
    """
    jobs, most = len(data), max(len(d[0]) for d in data)
    x, lo, hi = (np.tile(v, (jobs, 1)) for v in (START, LOWER, UPPER))
    block, share = np.ones((5, jobs, 1, most)), np.zeros((jobs, 1, most))
    across = np.zeros(jobs, bool)
    for j, rows in enumerate(data):
        nodes, replicas, bsz, accum, _ = rows = [np.asarray(a, float) for a in rows]
        block[:, j, 0, : len(nodes)], share[j, 0, : len(nodes)] = rows, 1 / len(nodes)
        across[j] = (nodes > 1).any()
        if len(np.unique(bsz)) == 1:
            x[j, 0] = lo[j, 0] = hi[j, 0] = accum.mean() / 2
        for i in ([] if across[j] else [2, 3]) + ([] if ((nodes == 1) & (replicas > 1)).any() else [4, 5]) + ([] if (replicas > 2).any() else [3, 5]):
            x[j, i] = lo[j, i] = hi[j, i] = LOWER[i]
    # The six times span many sizes, so they are searched by their logarithm; gamma as it is.
    to_log = lambda p: np.concatenate([np.log(p[..., :6]), p[..., 6:]], -1)
    to_params = lambda z: np.concatenate([np.exp(z[..., :6]), z[..., 6:]], -1)
    best, settled = minimize_all(lambda z, at: fit_loss(to_params(z), *block[:, at], share[at]), to_log(x), to_log(lo), to_log(hi))
    out = np.clip(to_params(best), lo, hi)
    for a, b in ((2, 4), (3, 5)):
        out[:, a] = np.where(across, out[:, a], np.maximum(out[:, a], ACROSS_NODES * out[:, b]))
    return out, fit_loss(out[:, None], *block, share)[:, 0], settled


def fit_params(nodes, replicas, bsz, accum, optim) -> np.ndarray:
    """Best parameters for measured mean times of one job."""
    return fit_model(nodes, replicas, bsz, accum, optim)[0]


def fit_model(nodes, replicas, bsz, accum, optim) -> tuple[np.ndarray, bool]:
    """``fit_params`` and whether the search settled within ROUNDS rounds."""
    params, _, settled = fit_models([(nodes, replicas, bsz, accum, optim)])
    return params[0], bool(settled[0])


def held(means: DataFrame) -> DataFrame:
    """(job_id, configurations, one_size, no_across, no_within, no_growth): what each job's rows leave undetermined.

    With one local batch size the constant compute time is held, without replicas across nodes, within a node, or
    beyond two, the parameters of that part of the network.
    """
    n, r = F.col("nodes"), F.col("replicas")
    return means.groupBy("job_id").agg(
        F.count("*").alias("configurations"), (F.count_distinct("local_bsz") == 1).alias("one_size"), (~F.bool_or(n > 1)).alias("no_across"),
        (~F.bool_or((n == 1) & (r > 1))).alias("no_within"), (~F.bool_or(r > 2)).alias("no_growth"),
    )


def fit_jobs(means: DataFrame) -> DataFrame:
    """One model per job from (job_id, nodes, replicas, local_bsz, accum_mean, optim_mean) rows.

    The input is the aggregated profile, so a job has one entry per distinct configuration, however many steps it ran.
    Jobs come as rows with their entries in arrays; up to ``FIT_BLOCK`` of them are fitted side by side, those of about
    equal length together. ``settled`` is false where the search stopped at its limit of rounds.
    """
    columns = ["nodes", "replicas", "local_bsz", "accum_mean", "optim_mean"]

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pa.compute.list_value_length(batch.column("nodes")).to_numpy()
            order, at = np.argsort(size, kind="stable"), 0
            while at < len(order):
                fits = size[order[at : at + FIT_BLOCK]] * np.arange(1, len(order[at : at + FIT_BLOCK]) + 1) <= FIT_CELLS
                part = batch.take(pa.array(order[at : at + max(1, int(fits.sum()))]))
                at += part.num_rows
                params, loss, settled = fit_models(list(zip(*([x.values.to_numpy() for x in part.column(c)] for c in columns), strict=True)))
                yield pa.RecordBatch.from_arrays([part.column("job_id"), *(pa.array(p) for p in params.T), pa.array(loss), pa.array(settled)], ["job_id", *perf.PARAMS, "loss", "settled"])

    entry = F.struct(*[F.col(c).cast("double").alias(c) for c in columns])
    jobs = for_compute(means, "job_id").groupBy(F.col("job_id").cast("bigint").alias("job_id")).agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return jobs.select("job_id", *[F.col("e")[c].alias(c) for c in columns]).mapInArrow(fit, FIT_SCHEMA)


def fit_error(means: DataFrame, params: DataFrame) -> DataFrame:
    """(job_id, loss): the fit objective of given parameters, all in column expressions."""
    rows = means.join(params.select("job_id", "params"), "job_id")
    p, n, r = F.col("params"), F.col("nodes"), F.col("replicas")
    comp = perf.accum_time(p, F.col("local_bsz"))
    both = perf.log_optim_time(p, comp, perf.network_time(p, n, r))
    sq = lambda a, b: F.avg(F.pow(a - F.ln(b), 2))
    per = rows.groupBy("job_id").agg(
        sq(F.ln(comp), F.col("accum_mean")).alias("_a"), sq(both, F.col("optim_mean")).alias("_o"), F.any_value("params").alias("params")
    )
    growth = F.pow(p["beta_n"] / p["alpha_n"], 2) + F.pow(p["beta_r"] / p["alpha_r"], 2)
    return per.select("job_id", (F.sqrt("_a") + F.sqrt("_o") + GAMMA_WEIGHT * F.pow(p["gamma"] - 1, 2) + GROWTH_WEIGHT * growth).alias("loss"))


def reduce_custom(df: DataFrame, by: Sequence[str], rank: str, value: str, fn: Callable, block: int = 1024, parts: int | None = None) -> DataFrame:
    """Fold ``value`` in rank order with any associative function; it need not commute.

    Rows are range-partitioned on (group, rank), so a task has contiguous runs and folds each in one pass with one value
    in memory: a group of all rows is folded by all tasks. What is left, one value for each group and partition, is
    folded by neighbouring partitions, ``block`` at a time, on as many levels as the number of partitions asks for.
    ``parts`` is that number, by default the shuffle partitions.
    """
    by = list(by)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    keys = "".join(f"{k} {kinds[k]}, " for k in by)
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def fold(place: str | None) -> Callable:
        """Runs of equal keys to one value each; ``place`` is the column that tells what the value stands for, by default the task."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            task, last, total, kind = TaskContext.get().partitionId(), None, None, None

            def out(made: list[tuple]) -> pa.RecordBatch:
                columns = [pa.array([m[0][i] for m in made], kind.field(k).type) for i, k in enumerate(by)]
                columns.append(pa.array([task if place is None else m[0][-1] for m in made], pa.int64()))
                return pa.RecordBatch.from_arrays([*columns, pa.array([m[1] for m in made], kind.field(value).type)], [*by, "_part", value])

            for batch in batches:
                kind, made = batch.schema, []
                heads = zip(*(batch.column(k).to_pylist() for k in by + ([place] if place else [])), strict=True) if by or place else [()] * batch.num_rows
                for key, v in zip(heads, batch.column(value).to_pandas(), strict=True):
                    if last is None or key != last[0]:
                        if last is not None:
                            made.append((last[0], total))
                        last, total = (key,), v
                    else:
                        total = fn(total, v)
                if made:
                    yield out(made)
            if last is not None:
                yield out([(last[0], total)])

        return run

    schema = f"{keys}_part bigint, {value} {kinds[value]}"
    rows = df.select(*by, F.col(rank).cast("bigint").alias("_at"), value)
    left = rows.repartitionByRange(parts, *by, "_at").sortWithinPartitions(*by, "_at").mapInArrow(fold(None), schema)
    while parts > 1:
        parts = -(-parts // block)
        near = left.withColumn("_next", F.floor(F.col("_part") / block))
        left = near.repartition(*by, "_next").sortWithinPartitions(*by, "_next", "_part").mapInArrow(fold("_next"), schema)
    return left.drop("_part")


def collate(batches: DataFrame, by: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a user's function to each batch; a batch has the bounded size it was cut to."""
    return for_compute(batches, *by).groupBy(*by).applyInPandas(fn, schema)
