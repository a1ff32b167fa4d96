"""Regions from placement data and from detections, made one set: pairing, findings, local correction, where each region comes from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boardsift.functions import boxes as B
from boardsift.functions import text as T
from boardsift.operators import reconcile

# Millimetres from which a part counts as shifted, and from which its place isn't believed; share of the pitch that a pad takes; pad size where no pitch is known.
SHIFTED, NOT_BELIEVED, PITCH_SHARE, PAD_MM, LEAST_PIXELS = 0.5, 2.0, 0.55, 0.8, 4.0


def pad_size(pitch: Column, scale: Column) -> Column:
    """Pixels of a pad's side, from the least distance between the part's pads in millimetres."""
    return F.greatest(F.lit(LEAST_PIXELS), F.when(pitch > 0, pitch * scale * PITCH_SHARE).otherwise(PAD_MM * scale))


def least_pitch(pads: DataFrame, keys: list[str], pad: str) -> DataFrame:
    """Least distance between two pads of a part; parts of one pad have none. Pads a part are few."""
    a = pads.select(*keys, F.col(pad).alias("_a"), F.col("x").alias("_ax"), F.col("y").alias("_ay"))
    j = pads.join(a, keys).where(F.col(pad) < F.col("_a"))
    return j.groupBy(*keys).agg(F.min(F.hypot(F.col("x") - F.col("_ax"), F.col("y") - F.col("_ay"))).alias("pitch"))


def geometry(pads: Column, part_class: Column) -> Column:
    """Two pads or more say what a part's terminals are like; else its class does."""
    return F.when(pads == 2, "two_terminal").when(pads > 2, "multi_pin").otherwise(T.terminals(part_class))


def usable(scale: Column, inliers: Column, residual: Column) -> Column:
    """Whether a registration may be applied."""
    return (scale > 0) & (inliers >= 0.35) & (residual <= 25)


def drive(placements: DataFrame, found: DataFrame, pads: DataFrame, boards: DataFrame, reach: float) -> DataFrame:
    """A row a region's origin or finding: board_id, kind, severity, cad_no, no, dx, dy (local correction in pixels), regions, source.

    boards: board_id, scale (pixels a millimetre), inliers, residual. Where a registration isn't usable, only what was
    detected counts. pads: board_id, cad_no, pads.
    """
    ok = boards.withColumn("usable", usable(F.col("scale"), F.col("inliers"), F.col("residual")))
    met = reconcile.met(placements, found, pads, ok.where("usable").select("board_id", "scale"), reach)
    c, n, pads_given = F.col("cad_no"), F.col("no"), F.coalesce(F.col("pads"), F.lit(0))
    both = c.isNotNull() & n.isNotNull()
    mm = F.hypot(F.col("dx"), F.col("dy")) / F.col("scale")
    believed = mm <= NOT_BELIEVED
    none, zero = F.lit(None).cast("int"), F.lit(0.0)

    def row(kind, severity, cad, no, x=zero, y=zero, regions=F.lit(0), source=F.lit(None).cast("string")):
        return F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), cad.alias("cad_no"), no.alias("no"), x.alias("dx"), y.alias("dy"), regions.cast("int").alias("regions"), source.alias("source"))

    source = F.when(pads_given > 0, "cad").otherwise("derived")
    terminals = T.terminals(F.col("label"))
    own = F.when(pads_given > 0, pads_given).when(terminals == "pad_only", 1).when(terminals == "two_terminal", 2).otherwise(4)
    parts = [
        F.when(both, row("matched", "ok", c, n, F.bround(F.when(believed, F.col("dx")).otherwise(0.0), 6), F.bround(F.when(believed, F.col("dy")).otherwise(0.0), 6), own, source)),
        F.when(both & (mm > SHIFTED), row("shifted_component", "review", c, n)),
        F.when(both & ~T.agree(F.col("part_class"), F.col("label")), row("class_mismatch", "info", c, n)),
        F.when(n.isNull(), row("missing_component", "defect", c, none, regions=pads_given, source=F.lit("cad_only_component"))),
        F.when(c.isNull(), row("unexpected_component", "info", none, n, source=F.lit("derived"))),
    ]
    rows = met.select("board_id", F.explode(F.array_compact(F.array(*parts))).alias("r")).select("board_id", "r.*")
    rejected = ok.where("not usable").select("board_id", row("registration_rejected", "warning", none, none).alias("r")).select("board_id", "r.*")
    return rows.unionByName(rejected)
