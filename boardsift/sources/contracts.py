"""JSON documents that carry a version: read field by field, or turned away with a reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def status(json: Column, schema: str, version: str, required: tuple[str, ...], field: str = "schema_version") -> Column:
    """ok, malformed, wrong_version or missing:<field>. Types are strict: a text where a boolean belongs counts as missing."""
    doc = F.from_json(json, schema, {"mode": "PERMISSIVE"})
    out = F.when(F.get_json_object(json, "$").isNull(), "malformed").when(~doc.getField(field).eqNullSafe(F.lit(version)), "wrong_version")
    for name in required:
        out = out.when(doc.getField(name).isNull(), f"missing:{name}")
    return out.otherwise("ok")


def manifest_fault(json: Column, sha256: Column, most_bytes: int = 1 << 20) -> Column:
    """The first rule that a model's manifest breaks, or null.

    Size, readable, named classes that differ, a known task, thresholds from 0 to 1 in order, and the digest of the model file.
    """
    doc = F.from_json(json, "classes array<string>, task string, accept_threshold double, review_threshold double, sha256 string")
    classes, accept, review = doc.getField("classes"), doc.getField("accept_threshold"), doc.getField("review_threshold")
    return (
        F.when(F.octet_length(json) > most_bytes, "too_large")
        .when(F.get_json_object(json, "$").isNull(), "malformed")
        .when(classes.isNull() | (F.size(classes) == 0), "no_classes")
        .when(F.size(F.array_distinct(classes)) < F.size(classes), "repeated_class")
        .when(~F.coalesce(doc.getField("task").isin("component", "solder", "detector"), F.lit(False)), "unknown_task")
        .when(accept.isNull() | review.isNull() | ~accept.between(0, 1) | ~review.between(0, 1), "threshold_range")
        .when(review > accept, "threshold_order")
        .when(~doc.getField("sha256").eqNullSafe(sha256), "wrong_digest")
    )
