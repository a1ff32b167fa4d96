"""Defect evidence: coordinates and the fingerprint of the source they belong to, no pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def evidence(verdicts: DataFrame, boxes: DataFrame) -> DataFrame:
    """Rows that a person must look at."""
    kept = verdicts.where(F.col("decision").isin("review", "reject"))
    source = F.sha2(F.concat(F.lit("board"), F.col("board_id").cast("string")), 256)
    return kept.join(boxes, ["board_id", "no"]).select("board_id", "no", "label", *(F.col(k).cast("int").alias(k) for k in ("x1", "y1", "x2", "y2")), source.alias("source_sha256"))


def matched(sources: DataFrame, claimed: DataFrame) -> DataFrame:
    """Whether each source still has the claimed digest."""
    j = sources.select("doc_id", F.sha2("text", 256).alias("own")).join(claimed, "doc_id", "left")
    return j.select("doc_id", F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("own"), "changed").otherwise("ok").alias("status"))
