"""Filters and gates as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boardsift.functions import boxes as B
from boardsift.functions.text import mapped

# Labels of detected terminals.
LEADS = ("pads", "pad", "pins", "pin", "lead", "leads")


def confident(confidence: Column, label: Column, by_class: dict[str, float], default: float) -> Column:
    return confidence >= F.coalesce(F.try_element_at(mapped(by_class), label), F.lit(default))


def plausible(b: Column, frame: float, least: float, most: float, aspect: float) -> Column:
    """Share of the frame and aspect ratio within limits."""
    share = B.area(b) / frame
    return share.between(least, most) & (F.greatest(B.width(b) / B.height(b), B.height(b) / B.width(b)) <= aspect)


def is_lead(label: Column) -> Column:
    return F.lower(F.trim(label)).isin(*LEADS)


def first_failure(rules: list[tuple[str, Column]], none: str = "ok") -> Column:
    out = F.lit(none)
    for name, failed in reversed(rules):
        out = F.when(failed, name).otherwise(out)
    return out


def all_failures(rules: list[tuple[str, Column]]) -> Column:
    return F.concat_ws("; ", *(F.when(failed, name) for name, failed in rules))


def names_any(c: Column, words: tuple[str, ...]) -> Column:
    return F.regexp_replace(F.lower(c), "[-_]", "").rlike("|".join(words))


def slot_status(missing: Column, measured: Column, placed: Column, alike: Column) -> Column:
    return (
        F.when(missing, "ng_missing").when(~measured, "review_unmeasurable").when(~placed & ~alike, "ng_position_appearance").when(~placed, "ng_position").when(~alike, "ng_appearance").otherwise("pass")
    )


def board_verdict(slots: DataFrame, by: list[str]) -> DataFrame:
    bad, open_ = F.bool_or(F.col("status").startswith("ng_")), F.bool_or(F.col("status").startswith("review"))
    return slots.groupBy(*by).agg(F.when(bad, "ng").when(open_, "review").otherwise("pass").alias("decision"), F.count("*").alias("slots"))


def upload(size: Column, w: Column, h: Column, most_bytes: int = 64 << 20, most_pixels: int = 50_000_000, least: tuple[int, int] = (1280, 960)) -> tuple[Column, Column]:
    """Whether an upload is accepted, and whether its resolution is lower than advised."""
    return (size <= most_bytes) & (w.cast("long") * h <= most_pixels), (w < least[0]) | (h < least[1])


def board_outline(share: Column, rectangularity: Column, whole_frame: Column) -> Column:
    """Whether an outline may be a board: its share of the frame, how much of its box it fills, and not simply the frame."""
    return share.between(0.08, 0.995) & ~whole_frame & (rectangularity >= 0.45)


def good_enough(classes: Column, accuracy: Column, weighted_f1: Column, least: float = 0.5) -> Column:
    return F.coalesce((F.size(classes) > 0) & (accuracy >= least) & (weighted_f1 >= least), F.lit(False))


def production(metrology: Column, anchors: Column, least_anchors: int, approved: Column, demo_slots: Column, detector: Column) -> Column:
    """All that a recipe needs to decide about products."""
    return metrology & (anchors >= least_anchors) & approved & ~demo_slots & F.coalesce(F.trim(detector) != "", F.lit(False))


def ab_advice(lost: Column, gained: Column, moved: Column, least: float = 0.02) -> Column:
    return F.when((lost > 0) & (moved < -least), "keep_a").when((gained > 0) & (moved > least), "prefer_b").otherwise("neutral")


def head(shape: Column) -> tuple[Column, Column]:
    """By its output's shape: whether a detector suppresses by itself, and how many boxes it gives at most."""
    own = (F.size(shape) == 3) & (F.element_at(shape, -1) == 6)
    return F.when(own, "internal").when(F.size(shape) == 3, "external").otherwise("unknown"), F.when(own, F.get(shape, F.lit(1)))


def stage_states(rows: DataFrame, key: str) -> DataFrame:
    """(key, stage, at: when it last ran) with `state`: waiting, done, or stale where an earlier stage ran later or not at all."""
    w = Window.partitionBy(key).orderBy("stage").rowsBetween(Window.unboundedPreceding, -1)
    stale = (F.coalesce(F.max("at").over(w), F.lit(-1)) > F.col("at")) | (F.count_if(F.col("at").isNull()).over(w) > 0)
    return rows.withColumn("state", F.when(F.col("at").isNull(), "waiting").when(stale, "stale").otherwise("done"))


def trainable(proposed: Column, status: Column) -> Column:
    """Labels proposed by a model need a reviewed manifest."""
    return ~proposed | F.coalesce(F.lower(F.trim(status)) == "reviewed", F.lit(False))


def made(mode: Column, model: Column, manifest: Column) -> Column:
    """What a factory makes, or why it doesn't: demo mode excludes a model, and a model goes with its manifest."""
    return (
        F.when((mode == "cv") & model.isNotNull(), "error: demo mode takes no model")
        .when(mode == "cv", "demo")
        .when(model.isNotNull() & manifest.isNull(), "error: model without manifest")
        .when(model.isNull() & manifest.isNotNull(), "error: manifest without model")
        .when(model.isNotNull(), "model")
        .otherwise("none")
    )
