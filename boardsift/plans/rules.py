"""Verdicts, decisions and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardsift.catalog import query
from boardsift.functions import boxes as B
from boardsift.operators import gates, grading
from boardsift.views import table, view

RULE = """CASE WHEN kind = 'body' THEN CASE WHEN solder_ratio <= 0.02 THEN 'missing_component' ELSE 'ok' END
  WHEN solder_ratio <= 0.04 THEN 'missing_solder' WHEN solder_ratio < 0.18 THEN 'insufficient_solder' WHEN span_ratio < 0.45 AND solder_ratio < 0.80 THEN 'insufficient_solder'
  WHEN solder_ratio > 0.80 THEN 'excess_solder' WHEN specular_ratio < 0.010 AND contrast < 0.06 THEN 'cold_joint' WHEN centroid_offset_ratio > 0.55 THEN 'insufficient_solder' ELSE 'good' END"""
MODEL = "CASE model_no WHEN 0 THEN 'good' WHEN 1 THEN 'insufficient_solder' WHEN 2 THEN 'missing_solder' WHEN 3 THEN 'excess_solder' WHEN 4 THEN 'ok' WHEN 5 THEN 'solder_bridge' END"
RULED = f"""WITH ru AS (SELECT *, {RULE} AS rl, {MODEL} AS ml, regexp_replace(position, '_pin[^_]*$', '') AS band FROM feat),
br AS (SELECT *, coalesce(abs(lead(pin_index) OVER w - pin_index) = 1 AND edge_contact_end >= 0.35 AND lead(edge_contact_start) OVER w >= 0.35 AND span_ratio >= 0.85 AND lead(span_ratio) OVER w >= 0.85, FALSE)
    OR coalesce(abs(pin_index - lag(pin_index) OVER w) = 1 AND edge_contact_start >= 0.35 AND lag(edge_contact_end) OVER w >= 0.35 AND span_ratio >= 0.85 AND lag(span_ratio) OVER w >= 0.85, FALSE) AS bridged
  FROM ru WINDOW w AS (PARTITION BY board_id, part_no, band ORDER BY pin_index, no)),
tb AS (SELECT *, kind = 'joint' AND geometry = 'two_terminal' AND count(*) OVER p = 2 AND max(solder_ratio) OVER p >= 0.18 AND min(solder_ratio) OVER p <= 0.04
    AND row_number() OVER (PARTITION BY board_id, part_no, kind ORDER BY solder_ratio, no DESC) = 1 AS tomb FROM br WINDOW p AS (PARTITION BY board_id, part_no, kind)),
fl AS (SELECT *, CASE WHEN kind = 'body' THEN rl WHEN tomb THEN 'missing_solder' WHEN bridged THEN 'solder_bridge' ELSE rl END AS rule_label FROM tb) """


def features(spark, sf_dir, model=False):
    f = view(spark, sf_dir, "feat")
    return f.withColumn("model_label", F.expr(MODEL)) if model else f.drop("model_no", "model_probability")


@query("R1 R2", f"SELECT board_id, no, rl AS rule_label FROM (SELECT *, {RULE} AS rl FROM feat) t", ("feat",))
def joint_rules(spark, sf_dir):
    return grading.with_rules(features(spark, sf_dir)).select("board_id", "no", "rule_label")


@query("W1", RULED + "SELECT board_id, no, bridged FROM br", ("feat",))
def solder_bridge(spark, sf_dir):
    return grading.with_bridges(features(spark, sf_dir)).select("board_id", "no", "bridged")


@query("W2", RULED + "SELECT board_id, no, tomb AS tombstone FROM tb WHERE kind = 'joint'", ("feat",))
def tombstone(spark, sf_dir):
    return grading.with_tombstones(features(spark, sf_dir).where("kind = 'joint'")).select("board_id", "no", "tombstone")


FUSED = RULED + """, sm AS (SELECT *, ml = rule_label OR (ml IN ('good','ok') AND rule_label IN ('good','ok')) AS same FROM fl),
lb AS (SELECT *, CASE WHEN ml IS NULL THEN rule_label WHEN same THEN ml WHEN ml IN ('good','ok') THEN rule_label ELSE ml END AS l0 FROM sm),
gd AS (SELECT *, ml IS NOT NULL AND kind = 'joint' AND l0 IN ('good','ok') AND solder_ratio < 0.10 AS guard FROM lb),
vd AS (SELECT board_id, no, kind, CASE WHEN guard THEN 'insufficient_solder' ELSE l0 END AS label,
  CASE WHEN guard THEN 'review' WHEN ml IS NULL THEN CASE WHEN rule_label IN ('good','ok') THEN 'accept' ELSE 'review' END WHEN same AND model_probability >= 0.80 THEN 'accept' ELSE 'review' END AS decision,
  CASE WHEN guard THEN 'guard' WHEN ml IS NULL THEN 'rules' WHEN same THEN 'agreement' ELSE 'conflict' END AS decided_by FROM gd) """


@query("R3 R4 M4", FUSED + "SELECT board_id, no, label, decision, decided_by FROM vd", ("feat",))
def fusion_decision(spark, sf_dir):
    return grading.graded(features(spark, sf_dir, True)).select("board_id", "no", "label", "decision", "decided_by")


@query("R4 A1 A22", RULED + "SELECT board_id, rule_label AS label, CASE WHEN rule_label IN ('good','ok') THEN 'accept' ELSE 'review' END AS decision, count(*) AS n FROM fl GROUP BY ALL", ("feat",))
def rules_verdict_counts(spark, sf_dir):
    return grading.graded(features(spark, sf_dir)).groupBy("board_id", "label", "decision").agg(F.count("*").alias("n"))


@query("A22", FUSED + """SELECT board_id, count(*) FILTER (decision = 'accept') AS accept, count(*) FILTER (decision = 'review') AS review, count(*) FILTER (decided_by = 'conflict') AS conflicts, count(*) FILTER (decided_by = 'guard') AS guarded FROM vd GROUP BY board_id""", ("feat",))
def decision_tallies(spark, sf_dir):
    g = grading.graded(features(spark, sf_dir, True))
    return g.groupBy("board_id").agg(*(F.count_if(F.col(c) == v).alias(name) for c, v, name in (("decision", "accept", "accept"), ("decision", "review", "review"), ("decided_by", "conflict", "conflicts"), ("decided_by", "guard", "guarded"))))


@query("F10", FUSED + """SELECT vd.board_id, vd.no, vd.label, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, CAST(x2 AS INT) AS x2, CAST(y2 AS INT) AS y2, sha256(CONCAT('board', CAST(vd.board_id AS VARCHAR))) AS source_sha256
FROM vd JOIN det ON vd.board_id = det.board_id AND vd.no = det.no WHERE decision IN ('review', 'reject')""", ("feat", "det"))
def evidence_filter(spark, sf_dir):
    from boardsift.sources.evidence import evidence

    verdicts = grading.graded(features(spark, sf_dir, True)).select("board_id", "no", "label", "decision")
    return evidence(verdicts, view(spark, sf_dir, "det").select("board_id", "no", *B.SIDES))


@query("F1", """SELECT board_id, no FROM det WHERE confidence >= CASE label WHEN 'led' THEN 0.85 WHEN 'ic' THEN 0.6 ELSE 0.75 END""", ("det",))
def class_threshold_filter(spark, sf_dir):
    return view(spark, sf_dir, "det").where(gates.confident(F.col("confidence"), F.col("label"), {"led": 0.85, "ic": 0.6}, 0.75)).select("board_id", "no")


@query("F3", """SELECT board_id, no FROM det WHERE (x2 - x1) * (y2 - y1) / 39000.0 BETWEEN 0.005 AND 0.03 AND greatest((x2 - x1) / (y2 - y1), (y2 - y1) / (x2 - x1)) <= 3""", ("det",))
def proposal_filter(spark, sf_dir):
    return view(spark, sf_dir, "det").where(gates.plausible(B.of(), 39000.0, 0.005, 0.03, 3)).select("board_id", "no")


@query("F7", "SELECT board_id, count(*) FILTER (label IN ('pads','pad','pins','pin','lead','leads')) AS leads, count(*) FILTER (label NOT IN ('pads','pad','pins','pin','lead','leads')) AS bodies FROM det GROUP BY board_id", ("det",))
def lead_body_split(spark, sf_dir):
    lead = gates.is_lead(F.col("label"))
    return view(spark, sf_dir, "det").groupBy("board_id").agg(F.count_if(lead).alias("leads"), F.count_if(~lead).alias("bodies"))


GATES = """SELECT board_id, no, CASE WHEN pin_index < 1 THEN 'anchors' WHEN solder_ratio < 0.3 THEN 'inliers' WHEN span_ratio < 0.2 THEN 'scale' WHEN contrast > 0.07 THEN 'residual' ELSE 'ok' END AS reason FROM feat"""


@query("F11", GATES, ("feat",))
def first_failed_gate(spark, sf_dir):
    c = F.col
    return view(spark, sf_dir, "feat").select("board_id", "no", gates.first_failure([("anchors", c("pin_index") < 1), ("inliers", c("solder_ratio") < 0.3), ("scale", c("span_ratio") < 0.2), ("residual", c("contrast") > 0.07)]).alias("reason"))


@query("F12 F13", """SELECT board_id, no, concat_ws('; ', CASE WHEN solder_ratio < 0.6 THEN 'score' END, CASE WHEN span_ratio < 0.5 THEN 'margin' END, CASE WHEN contrast > 0.05 THEN 'blob' END) AS failures FROM feat""", ("feat",))
def all_failed_gates(spark, sf_dir):
    c = F.col
    return view(spark, sf_dir, "feat").select("board_id", "no", gates.all_failures([("score", c("solder_ratio") < 0.6), ("margin", c("span_ratio") < 0.5), ("blob", c("contrast") > 0.05)]).alias("failures"))


@query("F14 F15", """SELECT board_id, no, CASE WHEN label = 'component_candidate' THEN 'demo' WHEN x2 <= x1 OR y2 <= y1 THEN 'empty' WHEN x2 > 230 OR y2 > 160 THEN 'outside' ELSE 'accepted' END AS status FROM det""", ("det",))
def recipe_rejection(spark, sf_dir):
    demo = F.col("label") == "component_candidate"
    status = gates.first_failure([("demo", demo), ("empty", (F.col("x2") <= F.col("x1")) | (F.col("y2") <= F.col("y1"))), ("outside", (F.col("x2") > 230) | (F.col("y2") > 160))], "accepted")
    return view(spark, sf_dir, "det").select("board_id", "no", status.alias("status"))


@query("F17 F16", """
WITH r AS (SELECT *, CASE WHEN width < 20 THEN 'too_narrow' WHEN height > 400 THEN 'out_of_range' WHEN n_chars IS NULL THEN 'not_numeric' WHEN row_number() OVER (PARTITION BY split, image, width ORDER BY doc_id) > 1 THEN 'duplicate' ELSE 'ok' END AS reason FROM sample)
SELECT split, reason, count(*) AS n FROM r GROUP BY ALL""", ("sample",))
def label_audit(spark, sf_dir):
    from boardsift.operators.datasets import audited

    return audited(view(spark, sf_dir, "sample"))


@query("F18 P33", """SELECT d.doc_id, CASE WHEN d.doc_id % 7 = 0 THEN 'missing' WHEN sha256(d.text) <> sha256(CASE WHEN d.doc_id % 5 = 0 THEN d.text || '!' ELSE d.text END) THEN 'changed' ELSE 'ok' END AS status FROM documents d""")
def fingerprint_match(spark, sf_dir):
    from boardsift.sources.evidence import matched

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    claimed = docs.where("doc_id % 7 <> 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return matched(docs, claimed)


@query("F19 A25", "SELECT board_id, count(*) FILTER (least(x2 - x1, y2 - y1) < 24) AS small, round_even(100.0 * count(*) FILTER (least(x2 - x1, y2 - y1) < 24) / count(*), 6) AS percent, min(least(x2 - x1, y2 - y1)) AS least_side FROM det GROUP BY board_id", ("det",))
def small_roi_report(spark, sf_dir):
    short = F.least(B.width(B.of()), B.height(B.of()))
    return view(spark, sf_dir, "det").groupBy("board_id").agg(F.count_if(short < 24).alias("small"), F.bround(100.0 * F.count_if(short < 24) / F.count("*"), 6).alias("percent"), F.min(short).alias("least_side"))


@query("R6 A24 A2", """
WITH s AS (SELECT board_id, part_no, CASE WHEN pin_index = 3 AND solder_ratio < 0.5 THEN 'ng_missing' WHEN solder_ratio < 0.05 THEN 'review_unmeasurable' WHEN span_ratio < 0.1 AND contrast > 0.06 THEN 'ng_position_appearance'
  WHEN span_ratio < 0.1 THEN 'ng_position' WHEN contrast > 0.075 THEN 'ng_appearance' ELSE 'pass' END AS status FROM feat)
SELECT board_id, part_no, CASE WHEN bool_or(starts_with(status, 'ng_')) THEN 'ng' WHEN bool_or(starts_with(status, 'review')) THEN 'review' ELSE 'pass' END AS decision, count(*) AS slots FROM s GROUP BY board_id, part_no""", ("feat",))
def board_decision(spark, sf_dir):
    f = view(spark, sf_dir, "feat")
    status = gates.slot_status((F.col("pin_index") == 3) & (F.col("solder_ratio") < 0.5), F.col("solder_ratio") >= 0.05, F.col("span_ratio") >= 0.1, F.when(F.col("span_ratio") < 0.1, F.col("contrast") <= 0.06).otherwise(F.col("contrast") <= 0.075))
    return gates.board_verdict(f.select("board_id", "part_no", status.alias("status")), ["board_id", "part_no"])
