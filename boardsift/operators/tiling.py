"""Tiles of a frame and what boxes owe to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def effective_tile(w: Column, h: Column, ratio: float = 0.64, least: int = 640, most: int = 1280) -> Column:
    return F.least(F.greatest(F.bround(F.greatest(w, h) * ratio, 0), F.lit(least)), F.lit(most)).cast("int")


def _axis(length: Column, tile: Column, overlap: float) -> Column:
    """Starts along one side: as few as keep the overlap, evenly spread."""
    steps = F.greatest(F.lit(1), F.ceil((length - tile) / (tile * (1 - overlap))).cast("int"))
    many = F.transform(F.sequence(F.lit(0), steps), lambda i: F.bround(i * (length - tile) / steps, 0).cast("int"))
    return F.when(length <= tile, F.array(F.lit(0))).otherwise(many)


def plan(w: Column, h: Column, tile: Column, overlap: float = 0.20) -> Column:
    """Tiles as structs, with the start of the part each one owns: halfway to the centre of its neighbour."""

    def starts(length):
        at, side = _axis(length, tile, overlap), F.least(length, tile)
        return F.transform(at, lambda s, i: F.struct(s.alias("a"), (s + side).alias("z"), F.when(i == 0, 0.0).otherwise((F.get(at, i - 1) + s + side) / 2).cast("double").alias("own")))

    across, down = starts(w), starts(h)
    return F.flatten(
        F.transform(across, lambda x: F.transform(down, lambda y: F.struct(x["a"].alias("x1"), y["a"].alias("y1"), x["z"].alias("x2"), y["z"].alias("y2"), x["own"].alias("own_x1"), y["own"].alias("own_y1"))))
    )


def inside(x: Column, y: Column, b: Column) -> Column:
    """In the half-open box."""
    return (x >= b["x1"]) & (x < b["x2"]) & (y >= b["y1"]) & (y < b["y2"])


def near_border(b: Column, tile: Column, w: int, h: int, margin) -> Column:
    """Whether a box comes near a side of its tile that isn't a side of the frame."""
    return (
        ((b["x1"] - tile["x1"] <= margin) & (tile["x1"] > 0))
        | ((b["y1"] - tile["y1"] <= margin) & (tile["y1"] > 0))
        | ((tile["x2"] - b["x2"] <= margin) & (tile["x2"] < w))
        | ((tile["y2"] - b["y2"] <= margin) & (tile["y2"] < h))
    )
