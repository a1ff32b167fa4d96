"""Verdicts on solder joints: rules on measurements, neighbours, and a model's opinion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Limits of the rules.
MISSING, INSUFFICIENT, EXCESS, SPAN, COLD_SPECULAR, COLD_CONTRAST, OFFSET = 0.04, 0.18, 0.80, 0.45, 0.010, 0.06, 0.55
BRIDGE_EDGE, BRIDGE_SPAN, MISSING_PART, ACCEPT, GUARD = 0.35, 0.85, 0.02, 0.80, 0.10


def joint_rule() -> tuple[Column, Column]:
    """Label and reason by the first rule that applies."""
    ratio, span = F.col("solder_ratio"), F.col("span_ratio")
    rules = [
        (ratio <= MISSING, "missing_solder", F.format_string("ratio %.3f", ratio)),
        (ratio < INSUFFICIENT, "insufficient_solder", F.format_string("ratio %.3f", ratio)),
        ((span < SPAN) & (ratio < EXCESS), "insufficient_solder", F.format_string("span %.3f", span)),
        (ratio > EXCESS, "excess_solder", F.format_string("ratio %.3f", ratio)),
        ((F.col("specular_ratio") < COLD_SPECULAR) & (F.col("contrast") < COLD_CONTRAST), "cold_joint", F.format_string("contrast %.3f", F.col("contrast"))),
        (F.col("centroid_offset_ratio") > OFFSET, "insufficient_solder", F.format_string("offset %.3f", F.col("centroid_offset_ratio"))),
    ]
    label, reason = F.lit("good"), F.lit("")
    for when, name, why in reversed(rules):
        label, reason = F.when(when, name).otherwise(label), F.when(when, why).otherwise(reason)
    return label, reason


def part_rule() -> Column:
    return F.when(F.col("solder_ratio") <= MISSING_PART, "missing_component").otherwise("ok")


def with_rules(features: DataFrame) -> DataFrame:
    label, reason = joint_rule()
    body = F.col("kind") == "body"
    return features.select("*", F.when(body, part_rule()).otherwise(label).alias("rule_label"), F.when(body, F.lit("")).otherwise(reason).alias("reason"))


def with_bridges(rows: DataFrame) -> DataFrame:
    """Neighbouring pins of one band whose facing edges are both covered: both are bridged."""
    band = F.regexp_replace("position", "_pin[^_]*$", "")
    w = W.partitionBy("board_id", "part_no", band).orderBy("pin_index", "no")

    def meets(other, mine, its):
        return (
            (F.abs(F.lead("pin_index").over(w) - F.col("pin_index")) == 1 if other == "next" else F.abs(F.col("pin_index") - F.lag("pin_index").over(w)) == 1)
            & (F.col(mine) >= BRIDGE_EDGE)
            & ((F.lead if other == "next" else F.lag)(its).over(w) >= BRIDGE_EDGE)
            & (F.col("span_ratio") >= BRIDGE_SPAN)
            & ((F.lead if other == "next" else F.lag)("span_ratio").over(w) >= BRIDGE_SPAN)
        )

    ahead, behind = meets("next", "edge_contact_end", "edge_contact_start"), meets("last", "edge_contact_start", "edge_contact_end")
    return rows.withColumn("bridged", F.coalesce(ahead, F.lit(False)) | F.coalesce(behind, F.lit(False)))


def with_tombstones(rows: DataFrame) -> DataFrame:
    """Of a part's two terminals one well wetted and the other bare: the weaker, of equals the second, is open."""
    w = W.partitionBy("board_id", "part_no")
    two = (F.count("*").over(w) == 2) & (F.max("solder_ratio").over(w) >= INSUFFICIENT) & (F.min("solder_ratio").over(w) <= MISSING)
    weakest = F.min(F.struct("solder_ratio", -F.col("no"))).over(w)
    return rows.withColumn("tombstone", (F.col("geometry") == "two_terminal") & two & (F.struct(F.col("solder_ratio"), -F.col("no")) == weakest))


def fused(rows: DataFrame) -> DataFrame:
    """Rules against a model: agreement is accepted, a conflict reviewed, and a bare joint never passes as good."""
    rule, model, p = F.col("rule_label"), F.col("model_label"), F.col("model_probability")
    fine = ("good", "ok")
    same = (rule == model) | (rule.isin(*fine) & model.isin(*fine))
    label = F.when(model.isNull(), rule).when(same, model).when(model.isin(*fine), rule).otherwise(model)
    decision = F.when(model.isNull(), F.when(rule.isin(*fine), "accept").otherwise("review")).when(same & (p >= ACCEPT), "accept").otherwise("review")
    source = F.when(model.isNull(), "rules").when(same, "agreement").otherwise("conflict")
    guard = model.isNotNull() & (F.col("kind") == "joint") & label.isin(*fine) & (F.col("solder_ratio") < GUARD)
    return rows.select(
        "*",
        F.when(guard, "insufficient_solder").otherwise(label).alias("label"),
        F.when(guard, "review").otherwise(decision).alias("decision"),
        F.when(guard, "guard").otherwise(source).alias("decided_by"),
    )


def graded(features: DataFrame) -> DataFrame:
    """Rules, bridges, tombstones, then the model if `model_label` is there."""
    rows = with_rules(features)
    rows = with_bridges(rows)
    joints = with_tombstones(rows.where("kind = 'joint'")).unionByName(rows.where("kind <> 'joint'").withColumn("tombstone", F.lit(False)))
    rule = F.when(F.col("kind") == "body", F.col("rule_label")).when(F.col("tombstone"), "missing_solder").when(F.col("bridged"), "solder_bridge").otherwise(F.col("rule_label"))
    rows = joints.withColumn("rule_label", rule)
    if "model_label" not in rows.columns:
        rows = rows.withColumns({"model_label": F.lit(None).cast("string"), "model_probability": F.lit(None).cast("double")})
    return fused(rows)
