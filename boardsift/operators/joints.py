"""Regions of solder joints by a part's box and the shape of its terminals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from boardsift.functions import boxes as B

INNER, OUTER, ASIDE, LEAD_IN, LEAD_OUT, PAD = 0.30, 0.45, 0.20, 0.14, 0.26, 0.15


def _roi(position: str, *sides) -> Column:
    return F.struct(F.lit(position).alias("position"), B.box(*sides).alias("box"))


def two_terminal(b: Column) -> Column:
    """Both ends of the longer axis: over the body, past it, and beyond its sides."""
    w, h = B.width(b), B.height(b)
    flat = F.array(
        _roi("start", b["x1"] - OUTER * w, b["y1"] - ASIDE * h, b["x1"] + INNER * w, b["y2"] + ASIDE * h),
        _roi("end", b["x2"] - INNER * w, b["y1"] - ASIDE * h, b["x2"] + OUTER * w, b["y2"] + ASIDE * h),
    )
    tall = F.array(
        _roi("start", b["x1"] - ASIDE * w, b["y1"] - OUTER * h, b["x2"] + ASIDE * w, b["y1"] + INNER * h),
        _roi("end", b["x1"] - ASIDE * w, b["y2"] - INNER * h, b["x2"] + ASIDE * w, b["y2"] + OUTER * h),
    )
    return F.when(w >= h, flat).otherwise(tall)


def lead_bands(b: Column) -> Column:
    """A band over each side."""
    s = F.least(B.width(b), B.height(b))
    return F.array(
        _roi("top", b["x1"], b["y1"] - LEAD_OUT * s, b["x2"], b["y1"] + LEAD_IN * s),
        _roi("bottom", b["x1"], b["y2"] - LEAD_IN * s, b["x2"], b["y2"] + LEAD_OUT * s),
        _roi("left", b["x1"] - LEAD_OUT * s, b["y1"], b["x1"] + LEAD_IN * s, b["y2"]),
        _roi("right", b["x2"] - LEAD_IN * s, b["y1"], b["x2"] + LEAD_OUT * s, b["y2"]),
    )


def pad(b: Column) -> Column:
    w, h = B.width(b), B.height(b)
    return B.box(b["x1"] - PAD * w, b["y1"] - PAD * h, b["x2"] + PAD * w, b["y2"] + PAD * h)


def rois(b: Column, geometry: Column) -> Column:
    return F.when(geometry == "two_terminal", two_terminal(b)).when(geometry == "pad_only", F.array(F.struct(F.lit("pad").alias("position"), pad(b).alias("box")))).otherwise(lead_bands(b))
