"""Exported tables: columns in their fixed order, cells in their fixed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardsift.functions import text as T

# Columns of the exported tables, in order.
JOINTS = ("joint_id", "detection_id", "label", "kind", "position", "pin_index", "terminal_geometry", "angle", "x1", "y1", "x2", "y2", "detector_confidence", "source", "designator", "pin", "net", "filename", "defect_class")
VERDICTS = (
    "joint_id", "detection_id", "designator", "pin", "component_label", "scope", "label", "decision", "source", "probability", "rule_label", "model_label", "model_probability",
    "solder_ratio", "span_ratio", "specular_ratio", "contrast", "centroid_offset_ratio", "roi_width_px", "roi_height_px", "model_version", "reasons",
)
FINDINGS = ("kind", "severity", "designator", "detection_id", "expected_class", "observed_class", "shift_mm", "x1", "y1", "x2", "y2", "message")

#: Decimals of the columns that are numbers with a fixed form.
DIGITS = {"angle": 2, "x1": 2, "y1": 2, "x2": 2, "y2": 2, "detector_confidence": 4, "probability": 4, "model_probability": 4, "solder_ratio": 4, "span_ratio": 4, "specular_ratio": 4, "contrast": 4, "centroid_offset_ratio": 4, "shift_mm": 3}


def cell(c: Column, name: str = "", guard: bool = False) -> Column:
    """Text of one cell: nothing for null, fixed decimals, quoted where it must be."""
    c = F.format_string(f"%.{DIGITS[name]}f", c.cast("double")) if name in DIGITS else c.cast("string")
    c = T.guarded_cell(c) if guard else c
    c = F.when(c.rlike('[",\n\r]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    return F.coalesce(c, F.lit(""))


def lines(rows: DataFrame, keys: list[str], columns: tuple[str, ...], guard: bool = False) -> DataFrame:
    """The keys and `line`, the row's cells; columns that the rows lack are empty."""
    cells = [F.when(F.col(c).isNotNull(), cell(F.col(c), c, guard)).otherwise("") if c in rows.columns else F.lit("") for c in columns]
    return rows.select(*keys, F.concat_ws(",", *cells).alias("line"))


def joint_lines(joints: DataFrame, keys: list[str]) -> DataFrame:
    """Sheet to label joints in: where the crop of each is, and a blank to fill in."""
    folder = F.when(F.col("kind") == "body", "body_views").otherwise("joints")
    return lines(joints.withColumn("filename", F.concat(folder, F.lit("/"), "crop")), keys, JOINTS)


def verdict_lines(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    return lines(verdicts.withColumn("reasons", F.array_join("reasons", " | ")), keys, VERDICTS)


def finding_lines(findings: DataFrame, keys: list[str]) -> DataFrame:
    return lines(findings, keys, FINDINGS)


def classification_lines(rows: DataFrame, keys: list[str]) -> DataFrame:
    """decision, label, probability to 8 decimals and the ranking as JSON; `top_k` is an array of (label, probability)."""
    top = F.concat(F.lit("["), F.array_join(F.transform("top_k", lambda x: F.format_string('{"label": "%s", "probability": %.8f}', x["label"], x["probability"])), ", "), F.lit("]"))
    best = F.col("top_k")[0]
    cells = [F.col("decision"), best["label"], F.format_string("%.8f", best["probability"]), top]
    return rows.select(*keys, F.concat_ws(",", *(cell(c, guard=True) for c in cells)).alias("line"))


def finite_json(fields: dict[str, Column]) -> Column:
    """A JSON object; an error where a number in it isn't finite."""
    values = F.to_json(F.struct(*(c.alias(k) for k, c in fields.items())))
    bad = F.lit(False)
    for c in fields.values():
        bad = bad | F.coalesce(F.isnan(c.try_cast("double")) | (F.abs(c.try_cast("double")) == float("inf")), F.lit(False))
    return F.when(bad, F.raise_error(F.lit("a number that isn't finite can't be written"))).otherwise(values)
