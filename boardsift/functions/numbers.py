"""Angles, scores and probabilities as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrapped(angle: Column, period: float = 180.0) -> Column:
    """Into [-period/2, period/2)."""
    return F.pmod(angle + period / 2, F.lit(period)) - period / 2


def axis_gap(a: Column, b: Column) -> Column:
    """Difference of two axes, which have no direction."""
    return F.abs(wrapped(a - b))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities of an array of logits."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def ranked(labels: Column, values: Column, k: int) -> Column:
    """The k largest values with their labels, the earlier of equals first."""
    rows = F.transform(F.arrays_zip(labels.alias("label"), values.alias("value")), lambda x, i: F.struct((-x["value"]).alias("o"), i.alias("i"), x["label"].alias("label"), x["value"].alias("value")))
    return F.transform(F.slice(F.array_sort(rows), 1, k), lambda x: F.struct(x["label"].alias("label"), x["value"].alias("probability")))


def peak_offset(before: Column, at: Column, after: Column) -> Column:
    """Sub-step place of the top of the parabola through three points, at most one step away."""
    bend = before - 2 * at + after
    return F.when(F.abs(bend) < 1e-12, 0.0).otherwise(F.least(F.greatest(0.5 * (before - after) / bend, F.lit(-1.0)), F.lit(1.0)))


def decision(top: Column, accept, review) -> Column:
    return F.when(top >= accept, "accept").when(top >= review, "review").otherwise("unknown")


def merge_score(confidence: Column, border: Column, tile: Column, owner: Column, penalty: float = 0.10) -> Column:
    """Confidence, less what boxes at a tile's border and outside a tile's own part lose."""
    return confidence - F.when(border, penalty).otherwise(0.0) - F.when(tile & ~owner, penalty).otherwise(0.0)
