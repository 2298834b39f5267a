"""Gradient noise statistics: norms, noise-scale estimates, decayed averages and training progress."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trainframe.functions.rates import gain
from trainframe.operators.blocked import running, step_block
from trainframe.operators.vectors import mean_square
from trainframe.session import checkpointed

# Smoothing per unit of scale and the floor of the reported variance.
SMOOTHING = 0.999
MIN_VAR = 1e-6

# Log-decay covered by one anchor block: e**300 is far from overflow, and e**-300 far below rounding.
ANCHOR = 300.0


def squared_norm(grad: Column, precondition: Column | None = None) -> Column:
    """Sum of squares in double precision, after element-wise division by ``precondition``."""
    g = grad if precondition is None else F.zip_with(grad, precondition, lambda x, p: x.cast("double") / p)
    return F.aggregate(g, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def adam_precondition(second_moment: Column, step: Column, beta2: float = 0.999, eps: float = 1e-8) -> Column:
    """Denominator of Adam from step 5 on, ones before."""
    root = F.sqrt(1 - F.pow(F.lit(beta2), step))
    return F.transform(second_moment, lambda v: F.when(step < 5, F.lit(1.0)).otherwise(F.sqrt(v.cast("double")) / root + eps))


def mean_gradient_norm(grads: DataFrame, by: Sequence[str]) -> DataFrame:
    """Squared norm of the mean gradient per group, averaged per dimension before squaring. Null gradients are skipped."""
    return mean_square(grads.withColumn("grad", F.col("grad").cast("array<double>")), by, "grad", "total_sqr")


def after_scale_change(grads: DataFrame, order: str = "micro", scale: str = "accum_scale") -> DataFrame:
    """Drop what a step had accumulated before its ``scale`` last changed; ``order`` numbers the gradients of a replica.

    Two scales are the same within a part in 100,000.
    """
    by = ["run", "step"]
    last = grads.groupBy(*by).agg(F.max_by(scale, order).alias("_last"))
    rows = grads.join(last, by)
    other = F.abs(F.col(scale) - F.col("_last")) > 1e-8 + 1e-5 * F.abs("_last")
    reset = rows.groupBy(*by).agg(F.max(F.when(other, F.col(order))).alias("_reset"))
    return rows.join(reset, by).filter(F.col("_reset").isNull() | (F.col(order) > F.col("_reset"))).drop("_last", "_reset")


def step_norms(grads: DataFrame, scale: Column | None = None) -> DataFrame:
    """(run, step, grp, count, scale, local_sqr, total_sqr) without steps where any group is not finite.

    ``scale`` is an aggregate over the gradients of a step, by default their number.
    """
    by = ["run", "step", "grp"]
    count = F.count(F.lit(1))
    held = (count if scale is None else scale).cast("double")
    local = grads.groupBy(*by).agg(count.alias("count"), held.alias("scale"), F.avg(squared_norm(F.col("grad"))).alias("local_sqr"))
    both = local.join(mean_gradient_norm(grads, by), by)
    finite = ~F.isnan("total_sqr") & (F.abs("total_sqr") < F.lit(float("inf")))
    good = F.min(finite.cast("int")).over(Window.partitionBy("run", "step"))
    return both.withColumn("_good", good).filter("_good = 1").drop("_good")


def estimate(count: Column, scale: Column, local_sqr: Column, total_sqr: Column) -> tuple[Column, Column]:
    """Unbiased squared norm of the true gradient and trace of its covariance."""
    return (count * total_sqr - local_sqr) / (count - 1), (local_sqr - total_sqr) * scale / (count - 1)


def step_scale(accum_scale: str) -> Column:
    """Scale of a step: that of one accumulation over all replicas, times the accumulations of the step.

    ``accum_scale`` names a column that has the replicas in it already, so the number of gradients of a step is divided
    by its replicas.
    """
    return F.max(accum_scale) * F.count(F.lit(1)) / F.size(F.collect_set("replica"))


def noise_estimates(grads: DataFrame, accum_scale: str | None = None) -> DataFrame:
    """(run, step, grp, biased, restart, scale, sqr, var) per step with several gradients.

    Without ``accum_scale`` a step's scale is its number of gradients, else see ``step_scale``.
    """
    norms = step_norms(grads, step_scale(accum_scale) if accum_scale else None).filter("count > 1")
    scale = F.col("scale")
    sqr, var = estimate(F.col("count"), scale, F.col("local_sqr"), F.col("total_sqr"))
    off = F.lit(False)
    return norms.select(
        "run", "step", "grp", off.alias("biased"), off.alias("restart"), scale.alias("scale"), sqr.alias("sqr"), var.alias("var")
    )


def mixed_estimates(grads: DataFrame) -> DataFrame:
    """As ``noise_estimates``, and steps with one gradient are compared with the step before; the scale is the number of gradients compared.

    That needs the previous kept step of the run to have one gradient too; otherwise the row has null
    estimates. ``restart`` marks the first step with several gradients after steps with one.
    """
    by = ["run", "step", "grp"]
    norms = checkpointed(step_norms(grads))  # one row per step and group
    single = norms.filter("count = 1").select(*by).join(grads.select(*by, "grad"), by)
    rows = norms.join(single, by, "left")
    rows = running(rows, ["run", "grp"], ["step"], step_block("step"), lags={"_prev": F.col("grad")})
    mean = F.zip_with("_prev", "grad", lambda a, b: (a.cast("double") + b.cast("double")) / 2)
    one = F.col("count") == 1
    local = F.when(one, (squared_norm(F.col("_prev")) + F.col("local_sqr")) / 2).otherwise(F.col("local_sqr"))
    total = F.when(one, squared_norm(mean)).otherwise(F.col("total_sqr"))
    n = F.when(one, F.lit(2)).otherwise(F.col("count"))
    scale = n.cast("double")
    sqr, var = estimate(n, scale, local, total)
    restart = ~one & F.col("_prev").isNotNull()
    return rows.select(*by, one.alias("biased"), restart.alias("restart"), scale.alias("scale"), sqr.alias("sqr"), var.alias("var"))


def decayed_average(
    df: DataFrame, by: Sequence[str], order: str, theta: Column, values: Mapping[str, Column], block: Column | None = None
) -> DataFrame:
    """Bias-corrected moving averages with a decay of its own per row, b = theta * b + (1 - theta) * v.

    With L the running sum of ln(theta), b is a running sum of (1 - theta) * v * e**-L, times e**L. Rows
    are cut where -L passes multiples of 300, so no exponent overflows, and each cut carries in the
    average at the end of the previous ones. Both sums run in blocks, never over a whole run at once.
    """
    by = list(by)
    block = step_block(order) if block is None else block
    names = {k: f"_v{i}" for i, k in enumerate(values)}
    rows = df.select("*", theta.alias("_theta"), *[values[k].alias(names[k]) for k in values])
    rows = running(rows, by, [order], block, sums={"_log": F.ln("_theta")})
    rows = rows.withColumn("_anchor", F.floor(-F.col("_log") / ANCHOR)).withColumn("_rel", F.col("_log") + F.col("_anchor") * ANCHOR)
    for v in names.values():
        rows = rows.withColumn(v, (1 - F.col("_theta")) * F.col(v) * F.exp(-F.col("_rel")))
    ends = rows.groupBy(*by, "_anchor").agg(F.min("_rel").alias("_end"), *[F.sum(v).alias(v) for v in names.values()])
    ends = ends.select(
        *by, "_anchor", (F.col("_end") - F.col("_anchor") * ANCHOR).alias("_upto"),
        *[(F.col(v) * F.exp("_end")).alias(v) for v in names.values()],
    )
    w = Window.partitionBy(*by).orderBy("_anchor")
    gap = F.exp(F.lag("_upto", 1).over(w) - F.lag("_upto", 2).over(w))
    carry = ends.select(
        *by, "_anchor", F.lag("_upto").over(w).alias("_from"),
        *[(F.lag(v).over(w) + F.coalesce(F.lag(v, 2).over(w) * gap, F.lit(0.0))).alias("_c" + v) for v in names.values()],
    )
    upto = Window.partitionBy(*by, "_anchor").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(v).over(upto).alias("_l" + v) for v in names.values()])
    both = local.join(carry, [*by, "_anchor"])
    out = []
    for k, v in names.items():
        carried = F.coalesce(F.col("_c" + v) * F.exp(F.col("_log") - F.col("_from")), F.lit(0.0))
        out.append(((F.col("_l" + v) * F.exp("_rel") + carried) / -F.expm1("_log")).alias(k))
    return both.select(*df.columns, *out)


def noise_average(estimates: DataFrame) -> DataFrame:
    """(run, step, grp, sqr_avg, var_avg): averages restart when a run goes from one to several gradients per step."""
    rows = checkpointed(estimates)
    rows = running(rows, ["run", "grp"], ["step"], step_block("step"), sums={"segment": F.col("restart").cast("int")})
    rows = checkpointed(rows.filter(F.col("sqr").isNotNull()))
    theta = F.pow(F.lit(SMOOTHING), F.col("scale"))
    out = decayed_average(rows, ["run", "grp", "segment"], "step", theta, {"sqr_avg": F.col("sqr"), "var_avg": F.col("var")})
    return out.select("run", "step", "grp", "segment", "scale", "sqr_avg", "var_avg")


def reported(averages: DataFrame) -> DataFrame:
    """(run, step, scale, sqr, var): groups summed, negative norms as 0 and variances not below 1e-6."""
    return averages.groupBy("run", "step").agg(
        F.max("scale").alias("scale"),
        F.sum(F.greatest("sqr_avg", F.lit(0.0))).alias("sqr"),
        F.sum(F.greatest("var_avg", F.lit(MIN_VAR))).alias("var"),
    )


def progress(stats: DataFrame) -> DataFrame:
    """Adds the step's gain and the running sum of gains."""
    rows = checkpointed(stats).withColumn("gain", gain(F.col("sqr"), F.col("var"), F.col("scale")))
    return running(rows, ["run"], ["step"], step_block("step"), sums={"progress": F.col("gain")})


def epoch_ends(steps: DataFrame, rows: Column, batch: int) -> DataFrame:
    """(run, epoch, end_step): epoch e ends at the first step that has seen progress of rows * (e + 1) / batch.

    A step sees the progress of the step before it, and every epoch has at least one step. ``steps``
    holds (run, step, progress).
    """
    rows_of = running(checkpointed(steps), ["run"], ["step"], step_block("step"), lags={"_was": F.col("progress")}, leads={"_next": F.col("step")})
    done = lambda c: F.floor(F.coalesce(c, F.lit(0.0)) * batch / rows)
    now, before = done(F.col("progress")), done(F.col("_was"))
    crossed = rows_of.filter((now > before) & F.col("_next").isNotNull())
    crossed = crossed.select("run", F.col("_next").alias("step"), F.explode(F.sequence(before, now - 1)).alias("epoch"))
    late = running(crossed.withColumn("_late", F.col("step") - F.col("epoch")), ["run"], ["epoch"], step_block("epoch"), maxs={"_most": F.col("_late")})
    return late.select("run", "epoch", (F.col("epoch") + F.col("_most")).alias("end_step"))
