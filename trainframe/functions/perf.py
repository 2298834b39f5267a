"""Step-time and goodput model as column expressions.

A model is a struct column of seven doubles. Time of one step is a p-norm of compute time, linear in
the local batch, and network time, which depends on whether replicas share a node.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameter names in order, the stand-in for "no cost", and the size of the batch grid.
PARAMS = ("alpha_c", "beta_c", "alpha_n", "beta_n", "alpha_r", "beta_r", "gamma")
TINY = 1e-8
GRID = 50


def accum_time(p: Column, local_bsz: Column) -> Column:
    """Forward and backward time of one local batch."""
    return p["alpha_c"] + p["beta_c"] * local_bsz


def network_time(p: Column, nodes: Column, replicas: Column) -> Column:
    """Gradient exchange time over the slowest link, growing with replicas beyond two."""
    extra = F.greatest(replicas - 2, F.lit(TINY))
    return (
        F.when(nodes > 1, p["alpha_n"] + p["beta_n"] * extra)
        .when(replicas > 1, p["alpha_r"] + p["beta_r"] * extra)
        .otherwise(TINY + TINY * extra)
    )


def log_optim_time(p: Column, accum: Column, network: Column) -> Column:
    return F.ln(F.pow(accum, p["gamma"]) + F.pow(network, p["gamma"])) / p["gamma"]


def throughput(
    p: Column, nodes: Column, replicas: Column, local_bsz: Column, accum_steps: Column, network: Column | None = None
) -> Column:
    """Rows per second. ``network`` may hold the precomputed network time."""
    accum = accum_time(p, local_bsz)
    optim = F.exp(log_optim_time(p, accum, network_time(p, nodes, replicas) if network is None else network))
    return replicas * local_bsz * (accum_steps + 1) / (accum_steps * accum + optim)


def efficiency(grad: Column, init_batch: Column, batch: Column) -> Column:
    """Progress per row relative to the initial batch size; ``grad`` holds sqr and var."""
    scale = batch / init_batch
    below = grad["var"] / scale + grad["sqr"]
    return F.when(below > 0, (grad["var"] + grad["sqr"]) / below).otherwise(F.lit(1.0)) / scale


def goodput(
    p: Column, grad: Column, init_batch: Column, nodes: Column, replicas: Column, local_bsz: Column, accum_steps: Column,
    network: Column | None = None,
) -> Column:
    """Throughput times efficiency."""
    batch = replicas * local_bsz * (accum_steps + 1)
    return throughput(p, nodes, replicas, local_bsz, accum_steps, network) * efficiency(grad, init_batch, batch)
