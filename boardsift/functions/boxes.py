"""Axis-aligned boxes as columns. A box is a struct x1, y1, x2, y2 of doubles; right and bottom are exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("x1", "y1", "x2", "y2")


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*(F.lit(v).cast("double").alias(k) if not isinstance(v, Column) else v.cast("double").alias(k) for k, v in zip(SIDES, (x1, y1, x2, y2), strict=True)))


def of(prefix: str = "") -> Column:
    """The box in columns <prefix>x1 .. <prefix>y2."""
    return box(*(F.col(prefix + k) for k in SIDES))


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def center_x(b: Column) -> Column:
    return (b["x1"] + b["x2"]) / 2


def center_y(b: Column) -> Column:
    return (b["y1"] + b["y2"]) / 2


def shifted(b: Column, dx, dy) -> Column:
    return box(b["x1"] + dx, b["y1"] + dy, b["x2"] + dx, b["y2"] + dy)


def clamped(b: Column, w, h) -> Column:
    """Cut to a frame of w by h."""

    def cut(v, most):
        return F.least(F.greatest(v, F.lit(0.0)), F.lit(most).cast("double") if not isinstance(most, Column) else most)

    return box(cut(b["x1"], w), cut(b["y1"], h), cut(b["x2"], w), cut(b["y2"], h))


def outward(b: Column) -> Column:
    """Integer pixels that cover the box."""
    return F.struct(F.floor(b["x1"]).cast("int").alias("x1"), F.floor(b["y1"]).cast("int").alias("y1"), F.ceil(b["x2"]).cast("int").alias("x2"), F.ceil(b["y2"]).cast("int").alias("y2"))


def meeting(a: Column, b: Column) -> Column:
    """Area that two boxes share."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    union = area(a) + area(b) - meeting(a, b)
    return F.when(union > 0, meeting(a, b) / union).otherwise(0.0)


def ios(a: Column, b: Column) -> Column:
    """Shared area over the smaller box."""
    small = F.least(area(a), area(b))
    return F.when(small > 0, meeting(a, b) / small).otherwise(0.0)


def touch(a: Column, b: Column) -> Column:
    """Whether the open boxes meet."""
    return (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])


def distance(x: Column, y: Column, b: Column) -> Column:
    """From a point to a box; 0 inside."""
    dx = F.greatest(b["x1"] - x, F.lit(0.0), x - b["x2"])
    dy = F.greatest(b["y1"] - y, F.lit(0.0), y - b["y2"])
    return F.hypot(dx, dy)


def hull(a: Column, b: Column) -> Column:
    return box(F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]), F.greatest(a["x2"], b["x2"]), F.greatest(a["y2"], b["y2"]))


def overlap(a: Column, b: Column) -> Column:
    return box(F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]), F.least(a["x2"], b["x2"]), F.least(a["y2"], b["y2"]))


def uncovered(a: Column, b: Column) -> Column:
    """Whether b leaves a slab of a, by sides alone: a join asks it of every candidate."""
    return (a["x1"] < a["x2"]) & (a["y1"] < a["y2"]) & ((a["x1"] < b["x1"]) | (b["x2"] < a["x2"]) | (a["y1"] < b["y1"]) | (b["y2"] < a["y2"]))


def without(a: Column, b: Column) -> Column:
    """The largest slab of a beside b: left, right, above, below, the first of equals; null if b covers a."""
    slabs = (
        box(a["x1"], a["y1"], F.least(b["x1"], a["x2"]), a["y2"]),
        box(F.greatest(b["x2"], a["x1"]), a["y1"], a["x2"], a["y2"]),
        box(a["x1"], a["y1"], a["x2"], F.least(b["y1"], a["y2"])),
        box(a["x1"], F.greatest(b["y2"], a["y1"]), a["x2"], a["y2"]),
    )
    # no functions over arrays, which Spark interprets; and short, as the JVM doesn't compile a join's loop of over 8,000 bytes
    whole = (F.when((x["x1"] < x["x2"]) & (x["y1"] < x["y2"]), F.struct(area(x).alias("size"), F.lit(-k).alias("rank"), x.alias("box"))) for k, x in enumerate(slabs))
    return F.greatest(*whole)["box"]


def halves(a: Column, b: Column) -> tuple[Column, Column]:
    """Two overlapping boxes cut at the middle of the overlap, along its shorter side."""
    ox = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    oy = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    mx = (F.greatest(a["x1"], b["x1"]) + F.least(a["x2"], b["x2"])) / 2
    my = (F.greatest(a["y1"], b["y1"]) + F.least(a["y2"], b["y2"])) / 2
    left, above = center_x(a) <= center_x(b), center_y(a) <= center_y(b)
    one = F.when(ox <= oy, F.when(left, box(a["x1"], a["y1"], mx, a["y2"])).otherwise(box(mx, a["y1"], a["x2"], a["y2"]))).otherwise(
        F.when(above, box(a["x1"], a["y1"], a["x2"], my)).otherwise(box(a["x1"], my, a["x2"], a["y2"]))
    )
    two = F.when(ox <= oy, F.when(left, box(mx, b["y1"], b["x2"], b["y2"])).otherwise(box(b["x1"], b["y1"], mx, b["y2"]))).otherwise(
        F.when(above, box(b["x1"], my, b["x2"], b["y2"])).otherwise(box(b["x1"], b["y1"], b["x2"], my))
    )
    return one, two


def turned(cx: Column, cy: Column, w: Column, h: Column, degrees: Column) -> Column:
    """Box around a rectangle turned about its centre."""
    c, s = F.abs(F.cos(F.radians(degrees))), F.abs(F.sin(F.radians(degrees)))
    rx, ry = (w * c + h * s) / 2, (w * s + h * c) / 2
    return box(cx - rx, cy - ry, cx + rx, cy + ry)
