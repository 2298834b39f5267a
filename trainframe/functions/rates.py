"""Learning-rate factors and gradient-noise gain as column expressions, and a place to add rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def gain(sqr: Column, var: Column, scale: Column) -> Column:
    return (var + sqr) / (var / scale + sqr)


def adascale(sqr: Column, var: Column, scale: Column) -> Column:
    return gain(F.greatest(sqr, F.lit(0.0)), F.greatest(var, F.lit(1e-6)), scale)


def adam_scale(sqr: Column, var: Column, scale: Column, power: float = 0.5) -> Column:
    return F.pow(adascale(sqr, var, scale), power)


def linear_scale(sqr: Column, var: Column, scale: Column) -> Column:
    return scale.cast("double")


def sqrt_scale(sqr: Column, var: Column, scale: Column) -> Column:
    return F.sqrt(scale)


def legw_scale(scale: Column, progress: Column, warmup_epochs: Column, data_size: Column, batch: Column) -> Column:
    """Square root of scale, ramped up linearly over the warm-up."""
    steps = warmup_epochs * scale * data_size / batch
    return F.sqrt(scale) * F.when(progress < steps, progress / steps).otherwise(F.lit(1.0))


Rule = Callable[[Column, Column, Column], Column]
_rules: dict[str, Rule] = {}


def register_rule(name: str, rule: Rule) -> None:
    """Add a rule (sqr, var, scale) -> factor. A name can be taken once."""
    if name in _rules:
        raise ValueError(f"rule exists: {name}")
    _rules[name] = rule


def rule(name: str) -> Rule:
    return _rules[name]


for _name, _rule in (("adascale", adascale), ("adam", adam_scale), ("linear", linear_scale), ("sqrt", sqrt_scale)):
    register_rule(_name, _rule)
