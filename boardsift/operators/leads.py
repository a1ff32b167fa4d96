"""Detected terminals and the parts they belong to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boardsift.functions import boxes as B
from boardsift.operators import gates
from boardsift.operators.joints import lead_bands
from boardsift.operators.spatial import touching


def assigned(detections: DataFrame, confidence: float = 0.35, reach: float = 1.2) -> DataFrame:
    """Each terminal with the body next to it, by distance over the body's longer side; of equals the first."""
    lead = gates.is_lead(F.col("label"))
    side = F.greatest(B.width(B.of()), B.height(B.of())) * reach * (1 + 1e-9) + 1e-6
    centre = B.box(B.center_x(B.of()), B.center_y(B.of()), B.center_x(B.of()) + 1e-6, B.center_y(B.of()) + 1e-6)
    leads = detections.where(lead & (F.col("confidence") >= confidence)).select("board_id", F.col("no").alias("lead_no"), B.of().alias("l"), centre.alias("c"))
    bodies = detections.where(~lead).select("board_id", "no", B.of().alias("b"), B.box(F.col("x1") - side, F.col("y1") - side, F.col("x2") + side, F.col("y2") + side).alias("near"))
    b = F.col("b")
    away = F.bround(B.distance(B.center_x(F.col("l")), B.center_y(F.col("l")), b) / F.greatest(B.width(b), B.height(b)), 9)
    j = touching(leads, bodies, "board_id", "c", "near").withColumn("d", away).where(F.col("d") <= reach)
    return j.groupBy("board_id", "lead_no").agg(F.min_by(F.struct("no", "l", "b"), F.struct("d", "no")).alias("m")).select("board_id", "lead_no", "m.no", "m.l", "m.b")


def fused(detections: DataFrame, pairs: DataFrame, ios: float = 0.30) -> DataFrame:
    """Detected terminals replace the derived regions that they cover; how many of each kind a board then has."""
    bodies = detections.where(~gates.is_lead(F.col("label"))).select("board_id", "no", F.explode(lead_bands(B.of())).alias("r")).where("r.position in ('top', 'bottom')")
    derived = bodies.select("board_id", "no", F.col("r.position").alias("position"), F.col("r.box").alias("box"))
    covered = derived.join(pairs.select("board_id", "no", "l"), ["board_id", "no"]).where(B.ios(F.col("box"), F.col("l")) >= ios).select("board_id", "no", "position").distinct()
    left = derived.join(covered, ["board_id", "no", "position"], "left_anti")
    return pairs.groupBy("board_id").agg(F.lit("detected").alias("source"), F.count("*").alias("n")).unionByName(left.groupBy("board_id").agg(F.lit("derived").alias("source"), F.count("*").alias("n")))
