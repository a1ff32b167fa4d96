"""Smaller operators, each with a query of its own."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boardsift.catalog import query
from boardsift.functions import boxes as B
from boardsift.functions import text as T
from boardsift.operators import fusion, gates
from boardsift.plans.joins import PAIRED
from boardsift.views import table, view

KEY = ["board_id", "no"]


@query("P47", """
WITH p AS (SELECT DISTINCT l_orderkey, l_linenumber, l_quantity AS x, CAST(l_partkey % 100 AS DOUBLE) AS y FROM lineitem),
m AS (SELECT a.l_orderkey, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS pitch FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber GROUP BY a.l_orderkey)
SELECT o_orderkey, round_even(greatest(4.0, CASE WHEN pitch > 0 THEN pitch * 3.5::DOUBLE * 0.55::DOUBLE ELSE 0.8::DOUBLE * 3.5::DOUBLE END), 6) AS size FROM orders LEFT JOIN m ON o_orderkey = l_orderkey""")
def pad_size(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_partkey") % 100).cast("double").alias("y")).distinct()
    o = table(spark, sf_dir, "orders").select("o_orderkey")
    j = o.join(fusion.least_pitch(li, ["l_orderkey"], "l_linenumber"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", F.bround(fusion.pad_size(F.col("pitch"), F.lit(3.5)), 6).alias("size"))


@query("P50", """
SELECT board_id, cad_no, CASE cad_no % 4 WHEN 2 THEN 'two_terminal' WHEN 3 THEN 'multi_pin' ELSE CASE WHEN part_class IN ('capacitor', 'resistor', 'diode', 'led', 'inductor', 'fuse') THEN 'two_terminal' WHEN part_class = 'pads' THEN 'pad_only' ELSE 'multi_pin' END END AS geometry,
  greatest(12.0, (cad_no % 4) * 2.5 * 3.5)::DOUBLE AS frame FROM cad""", ("cad",))
def reference_geometry(spark, sf_dir):
    """What terminals a placed part has, and how long the frame is that its regions are laid along."""
    pads = F.col("cad_no") % 4
    return view(spark, sf_dir, "cad").select("board_id", "cad_no", fusion.geometry(pads, F.col("part_class")).alias("geometry"), F.greatest(F.lit(12.0), pads * 2.5 * 3.5).alias("frame"))


@query("P52", """
SELECT o_orderkey AS line, CASE WHEN o_custkey % 2 = 0 THEN 'R' ELSE 'C' END || o_orderkey AS designator, CAST(o_custkey AS DOUBLE) AS x, CAST(o_orderkey % 97 AS DOUBLE) AS y, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_orderkey % 11 AS DOUBLE) END, 0) AS width, CAST(0 AS DOUBLE) AS height, CASE WHEN o_custkey % 2 = 0 THEN 'resistor' ELSE 'capacitor' END AS part_class
FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0""")
def bom_placements(spark, sf_dir):
    """Entries of a bill of material that have a position, as placements; sizes that aren't given are 0."""
    k = F.col("o_orderkey")
    bom = table(spark, sf_dir, "orders").select(k.alias("line"), F.concat(F.when(F.col("o_custkey") % 2 == 0, "R").otherwise("C"), k.cast("string")).alias("designator"), F.when(k % 3 != 0, F.col("o_custkey").cast("double")).alias("x"), F.when(k % 5 != 0, (k % 97).cast("double")).alias("y"), F.when(k % 4 == 0, (k % 11).cast("double")).alias("width"), F.lit(None).cast("double").alias("height"))
    return bom.where("x is not null and y is not null").na.fill(0.0, ["width", "height"]).withColumn("part_class", T.part_class(F.col("designator")))


@query("P56", """SELECT board_id, no AS slot, 'position' AS part, CASE WHEN no % 4 <> 0 THEN round_even(x1 / 8, 6) END AS v1, CASE WHEN no % 4 <> 0 THEN round_even(y1 / 8, 6) END AS v2, CASE WHEN no % 4 <> 0 THEN confidence END AS score FROM det
UNION ALL SELECT board_id, no, 'appearance', confidence, CAST(class_id AS DOUBLE), confidence FROM det WHERE no % 3 = 0""", ("det",))
def nested_flatten(spark, sf_dir):
    """Slots with their results inside, as a position table and an appearance table; what wasn't measured is null."""
    position = F.when(F.col("no") % 4 != 0, F.struct(F.bround(F.col("x1") / 8, 6).alias("dx"), F.bround(F.col("y1") / 8, 6).alias("dy"), F.col("confidence").alias("score")))
    look = F.when(F.col("no") % 3 == 0, F.struct(F.col("confidence").alias("ssim"), F.col("class_id").cast("double").alias("blobs")))
    run = view(spark, sf_dir, "det").groupBy("board_id").agg(F.collect_list(F.struct(F.col("no").alias("slot"), position.alias("position"), look.alias("appearance"))).alias("slots"))
    s = run.select("board_id", F.explode("slots").alias("s")).select("board_id", "s.*")
    a = s.select("board_id", "slot", F.lit("position").alias("part"), F.col("position.dx").alias("v1"), F.col("position.dy").alias("v2"), F.col("position.score").alias("score"))
    b = s.where("appearance is not null").select("board_id", "slot", F.lit("appearance").alias("part"), F.col("appearance.ssim").alias("v1"), F.col("appearance.blobs").alias("v2"), F.col("appearance.ssim").alias("score"))
    return a.unionByName(b)


@query("P57", """SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'opencv:demo' WHEN p_size % 5 = 1 THEN 'custom:custom' ELSE regexp_extract('/models/' || p_brand || '/' || p_name || '.onnx', '[^/]*$') || ':' || sha256(p_name) END AS identifier FROM part""")
def artifact_names(spark, sf_dir):
    """What made a result: the file's name and digest, or what kind of stand-in."""
    k, path = F.col("p_size") % 5, F.concat(F.lit("/models/"), "p_brand", F.lit("/"), "p_name", F.lit(".onnx"))
    file = F.concat_ws(":", F.element_at(F.split(path, "/"), -1), F.sha2("p_name", 256))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, F.concat_ws(":", F.lit("opencv"), F.lit("demo"))).when(k == 1, F.concat_ws(":", F.lit("custom"), F.lit("custom"))).otherwise(file).alias("identifier"))


@query("P60", """SELECT board_id, no, round_even(greatest(least(x2, 200) - greatest(x1, 50), 0) * greatest(least(y2, 140) - greatest(y1, 20), 0) / (150.0 * 120.0), 6) AS ratio FROM det""", ("det",))
def canvas_overlap(spark, sf_dir):
    """Share of a canvas that a convex outline covers, by clipping it side by side; boxes here, so that SQL can tell."""
    import pandas as pd
    from boardsift.operators.registration import clipped_area

    def kernel(frames):
        for f in frames:
            ratio = [clipped_area([(x1, y1), (x2, y1), (x2, y2), (x1, y2)], (50, 20, 200, 140)) / (150 * 120) for x1, y1, x2, y2 in f[list(B.SIDES)].itertuples(index=False)]
            yield f[KEY].assign(ratio=[round(r, 6) for r in ratio]) if len(f) else pd.DataFrame(columns=[*KEY, "ratio"])

    return view(spark, sf_dir, "det").select(*KEY, *B.SIDES).mapInPandas(kernel, "board_id int, no int, ratio double")


CONTOUR = "(x2 - x1) * (y2 - y1) / 1200.0"


@query("F4 T5", f"""
WITH c AS (SELECT board_id, no, {CONTOUR} AS share, 0.4 + (no % 7) * 0.1 AS fill, x1 <= 0 AND y1 <= 0 AS whole FROM det)
SELECT board_id, no, round_even(share * fill, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY round_even(share * fill, 9) DESC, no) AS r FROM c WHERE share BETWEEN 0.08 AND 0.995 AND NOT whole AND fill >= 0.45) t WHERE r = 1""", ("det",))
def board_contour(spark, sf_dir):
    """Outlines that may be a board: a plausible share of the frame, not all of it, nearly rectangular; the best of each image."""
    share, full = F.expr(CONTOUR), F.lit(0.4) + F.col("no") % 7 * 0.1
    d = view(spark, sf_dir, "det").where(gates.board_outline(share, full, (F.col("x1") <= 0) & (F.col("y1") <= 0)))
    best = d.groupBy("board_id").agg(F.max(F.struct(F.bround(share * full, 9).alias("s"), (-F.col("no")).alias("no"))).alias("b"))
    return best.select("board_id", (-F.col("b.no")).alias("no"), F.bround("b.s", 6).alias("score"))


@query("F9", "SELECT board_id, no, solder_ratio * 10 - 1 > 0 AND span_ratio >= 0.35 AND CAST(no AS DOUBLE) <= 25 AS usable FROM feat", ("feat",))
def registration_usable(spark, sf_dir):
    return view(spark, sf_dir, "feat").select(*KEY, fusion.usable(F.col("solder_ratio") * 10 - 1, F.col("span_ratio"), F.col("no").cast("double")).alias("usable"))


@query("F20", """SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'OpenCV-Candidate' WHEN 1 THEN 'cv_demo' WHEN 2 THEN 'Mock detector' ELSE 'yolo' END AS source, p_size % 4 <> 3 AS demo FROM part""")
def demo_sources(spark, sf_dir):
    k = F.col("p_size") % 4
    source = F.when(k == 0, "OpenCV-Candidate").when(k == 1, "cv_demo").when(k == 2, "Mock detector").otherwise("yolo")
    return table(spark, sf_dir, "part").select("p_partkey", source.alias("source"), gates.names_any(source, ("opencvcandidate", "demo", "mock")).alias("demo"))


@query("F21", """SELECT p_partkey, p_size % 3 <> 0 AND (p_size % 50) / 50.0 >= 0.5 AND (p_partkey % 100) / 100.0 >= 0.5 AS offered FROM part""")
def model_quality_gate(spark, sf_dir):
    """Models are offered if they name classes and their measured accuracy and weighted F1 reach a half."""
    classes = F.when(F.col("p_size") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", gates.good_enough(classes, F.col("p_size") % 50 / 50, F.col("p_partkey") % 100 / 100).alias("offered"))


@query("J15", """SELECT d.board_id, d.no, count(f.joint_id) AS joints, coalesce(string_agg(f.joint_id, ' ' ORDER BY f.joint_id), '') AS names FROM det d LEFT JOIN feat f ON f.board_id = d.board_id AND f.part_no = d.no AND f.kind = 'joint' GROUP BY d.board_id, d.no""", ("det", "feat"))
def joints_of_parts(spark, sf_dir):
    """Each part with all its joints."""
    f = view(spark, sf_dir, "feat").where("kind = 'joint'").groupBy("board_id", F.col("part_no").alias("no")).agg(F.count("*").alias("joints"), F.array_join(F.array_sort(F.collect_list("joint_id")), " ").alias("names"))
    return view(spark, sf_dir, "det").select(*KEY).join(f, KEY, "left").na.fill(0, ["joints"]).na.fill("", ["names"])


@query("J20", """
WITH w AS (SELECT doc_id, 'a' || (doc_id % 50) AS asset, sha256(text) AS digest FROM documents WHERE doc_id % 3 <> 0), h AS (SELECT doc_id, 'a' || (doc_id % 50) AS asset, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS digest FROM documents WHERE doc_id % 4 <> 0)
SELECT coalesce(w.doc_id, h.doc_id) AS doc_id, coalesce(w.asset, h.asset) AS asset, CASE WHEN h.doc_id IS NULL THEN 'missing' WHEN w.doc_id IS NULL THEN 'unexpected' ELSE 'changed' END AS fault FROM w FULL JOIN h ON w.doc_id = h.doc_id AND w.asset = h.asset WHERE w.doc_id IS NULL OR h.doc_id IS NULL OR w.digest <> h.digest""")
def asset_digests(spark, sf_dir):
    """Assets that a recipe names against those it has digests of: missing, unexpected, changed."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("a"), (F.col("doc_id") % 50).cast("string")).alias("asset"))
    wanted = d.where("doc_id % 3 <> 0").select("doc_id", "asset", F.sha2("text", 256).alias("want"))
    held = d.where("doc_id % 4 <> 0").select("doc_id", "asset", F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("have"))
    j = wanted.join(held, ["doc_id", "asset"], "full")
    return j.select("doc_id", "asset", F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "unexpected").when(F.col("want") != F.col("have"), "changed").alias("fault")).where("fault is not null")


@query("A20", "SELECT board_id, min(cx) AS x1, min(cy) AS y1, max(cx) AS x2, max(cy) AS y2, max(cx) - min(cx) AS width, max(cy) - min(cy) AS height FROM cad GROUP BY board_id", ("cad",))
def board_extent(spark, sf_dir):
    c = view(spark, sf_dir, "cad").groupBy("board_id").agg(F.min("cx").alias("x1"), F.min("cy").alias("y1"), F.max("cx").alias("x2"), F.max("cy").alias("y2"))
    return c.select("*", (F.col("x2") - F.col("x1")).alias("width"), (F.col("y2") - F.col("y1")).alias("height"))


@query("T7", """
WITH g AS (SELECT board_id, no, CASE WHEN label = 'pads' THEN 'joints' WHEN label = 'ic' THEN 'views' ELSE 'crops' END AS gallery, confidence FROM det)
SELECT board_id, no, gallery FROM (SELECT *, row_number() OVER (PARTITION BY board_id, gallery ORDER BY confidence DESC, no) AS r FROM g) t WHERE r <= CASE gallery WHEN 'crops' THEN 60 WHEN 'joints' THEN 40 ELSE 6 END""", ("det",))
def gallery_limits(spark, sf_dir):
    """The best of each gallery of a board: 60 crops, 40 joints, 6 views."""
    gallery = F.when(F.col("label") == "pads", "joints").when(F.col("label") == "ic", "views").otherwise("crops")
    place = F.row_number().over(W.partitionBy("board_id", "gallery").orderBy(F.desc("confidence"), "no"))
    g = view(spark, sf_dir, "det").withColumn("gallery", gallery).withColumn("place", place)
    return g.where(F.col("place") <= F.when(F.col("gallery") == "crops", 60).when(F.col("gallery") == "joints", 40).otherwise(6)).select(*KEY, "gallery")


@query("G7", """SELECT board_id, round_even(2.0 + board_id % 3 * 0.5, 6) AS scale, CAST(least(count(*), 5) AS INT) AS points, TRUE AS exact FROM cad WHERE cad_no <= 8 AND cx < 4000 GROUP BY board_id HAVING count(*) >= 2""", ("cad",))
def fiducial_registration(spark, sf_dir):
    """Marks whose places are known on the board and in the image: a known turn, scale and shift must come back."""
    import numpy as np
    import pandas as pd

    from boardsift.operators.registration import apply, from_fiducials, pixel_scale

    c = view(spark, sf_dir, "cad").where("cad_no <= 8 and cx < 4000").select("board_id", "cad_no", "cx", "cy")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        p = pdf.sort_values("cad_no", kind="stable")[["cx", "cy"]].to_numpy()[:5]
        if len(p) < 2:
            return pd.DataFrame(columns=["board_id", "scale", "points", "exact"])
        scale = 2.0 + pdf.board_id.iloc[0] % 3 * 0.5
        turn = scale * np.array([[np.cos(0.3), -np.sin(0.3)], [np.sin(0.3), np.cos(0.3)]])
        target = p @ turn.T + [30.0, 20.0]
        m, residual = from_fiducials(p, target)
        return pd.DataFrame([[pdf.board_id.iloc[0], round(pixel_scale(m.tolist()), 6), len(p), bool(residual < 1e-3 and np.allclose(apply(m, p), target, atol=1e-3))]], columns=["board_id", "scale", "points", "exact"])

    return c.groupBy("board_id").applyInPandas(kernel, "board_id int, scale double, points int, exact boolean")


@query("G8", PAIRED + """,
ok AS (SELECT DISTINCT board_id FROM det WHERE board_id % 5 <> 0),
q AS (SELECT mt.board_id, mt.cad_no, mt.no, part_class, label, (x1 + x2) / 2 - cx AS dx, (y1 + y2) / 2 - cy AS dy, mt.cad_no % 3 AS pads FROM mt JOIN ok ON mt.board_id = ok.board_id JOIN cad c ON mt.board_id = c.board_id AND mt.cad_no = c.cad_no JOIN det d ON mt.board_id = d.board_id AND mt.no = d.no)
SELECT board_id, 'matched' AS kind, 'ok' AS severity, cad_no, no, round_even(CASE WHEN sqrt(dx * dx + dy * dy) / 2 <= 2 THEN dx ELSE 0 END, 6) AS dx, round_even(CASE WHEN sqrt(dx * dx + dy * dy) / 2 <= 2 THEN dy ELSE 0 END, 6) AS dy,
  CAST(CASE WHEN pads > 0 THEN pads WHEN label = 'pads' THEN 1 WHEN label IN ('capacitor', 'resistor', 'diode', 'led', 'inductor', 'fuse') THEN 2 ELSE 4 END AS INT) AS regions, CASE WHEN pads > 0 THEN 'cad' ELSE 'derived' END AS source FROM q
UNION ALL SELECT board_id, 'shifted_component', 'review', cad_no, no, 0, 0, 0, NULL FROM q WHERE sqrt(dx * dx + dy * dy) / 2 > 0.5
UNION ALL SELECT board_id, 'class_mismatch', 'info', cad_no, no, 0, 0, 0, NULL FROM q WHERE part_class <> 'unknown' AND label <> 'component_candidate' AND part_class <> label
UNION ALL SELECT c.board_id, 'missing_component', 'defect', c.cad_no, NULL, 0, 0, c.cad_no % 3, 'cad_only_component' FROM cad c JOIN ok ON c.board_id = ok.board_id WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.board_id = c.board_id AND q.cad_no = c.cad_no)
UNION ALL SELECT d.board_id, 'unexpected_component', 'info', NULL, d.no, 0, 0, 0, 'derived' FROM det d JOIN ok ON d.board_id = ok.board_id WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.board_id = d.board_id AND q.no = d.no)
UNION ALL SELECT DISTINCT board_id, 'registration_rejected', 'warning', NULL::INT, NULL::INT, 0.0, 0.0, 0, NULL FROM det WHERE board_id % 5 = 0""", ("cad",))
def fusion_driver(spark, sf_dir):
    """Findings, local corrections and where regions come from, board by board; boards whose registration is poor keep what was detected."""
    cad, det = view(spark, sf_dir, "cad"), view(spark, sf_dir, "det")
    boards = det.select("board_id").distinct().select("board_id", F.lit(2.0).alias("scale"), F.when(F.col("board_id") % 5 == 0, 0.1).otherwise(0.9).alias("inliers"), F.lit(3.0).alias("residual"))
    pads = cad.select("board_id", "cad_no", (F.col("cad_no") % 3).alias("pads"))
    return fusion.drive(cad, det, pads, boards, 6.0)


@query("R8", """SELECT board_id, no, no % 2 = 0 AND no % 9 + 1 >= 3 AND no % 5 <> 0 AND label <> 'component_candidate' AND no % 7 <> 0 AS eligible FROM det""", ("det",))
def production_gate(spark, sf_dir):
    """Verified metrology, enough anchors, anchors of an approved origin, no slot found by a demo detector, and a named detector."""
    n = F.col("no")
    provenance, model = F.when(n % 5 == 0, "grid").otherwise("approved"), F.when(n % 7 != 0, "m.onnx:ab")
    return view(spark, sf_dir, "det").select(*KEY, gates.production(n % 2 == 0, n % 9 + 1, 3, provenance == "approved", F.col("label") == "component_candidate", model).alias("eligible"))


@query("R9", """SELECT board_id, CASE WHEN lost > 0 AND d < -0.02 THEN 'keep_a' WHEN gained > 0 AND d > 0.02 THEN 'prefer_b' ELSE 'neutral' END AS advice FROM (
  SELECT board_id, count(*) FILTER (no % 11 = 0) AS lost, count(*) FILTER (no % 13 = 0) AS gained, round_even(avg(CASE WHEN board_id % 3 = 0 THEN -0.01 * (no % 9) WHEN board_id % 3 = 1 THEN 0.01 * (no % 9) ELSE 0.001 * (no % 9) END::DOUBLE), 9) AS d FROM det GROUP BY board_id) t""", ("det",))
def ab_advice(spark, sf_dir):
    """Whether the other preprocessing is better: what it lost, what it gained, and how confidence moved."""
    n, b = F.col("no"), F.col("board_id") % 3
    moved = F.when(b == 0, -0.01 * (n % 9)).when(b == 1, 0.01 * (n % 9)).otherwise(0.001 * (n % 9))
    d = view(spark, sf_dir, "det").groupBy("board_id").agg(F.count_if(n % 11 == 0).alias("lost"), F.count_if(n % 13 == 0).alias("gained"), F.bround(F.avg(moved), 9).alias("d"))
    return d.select("board_id", gates.ab_advice(F.col("lost"), F.col("gained"), F.col("d")).alias("advice"))


@query("R10", """SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'internal' WHEN p_size % 3 = 1 THEN 'external' ELSE 'unknown' END AS nms, CASE WHEN p_size % 3 = 0 THEN p_size * 10 END AS max_det FROM part""")
def head_contract(spark, sf_dir):
    """What a detector's output shape says: (1, n, 6) has suppressed already, n boxes at most; (1, 4 + classes, anchors) hasn't."""
    k = F.col("p_size") % 3
    shape = F.when(k == 0, F.array(F.lit(1), F.col("p_size") * 10, F.lit(6))).when(k == 1, F.array(F.lit(1), F.lit(84), F.lit(8400))).otherwise(F.array(F.lit(1), F.lit(7)))
    nms, most = gates.head(shape.cast("array<int>"))
    return table(spark, sf_dir, "part").select("p_partkey", nms.alias("nms"), most.alias("max_det"))


STAGES_SQL = "['preprocess', 'align', 'locate', 'detect', 'crop', 'classify', 'grade']"


@query("R11", f"""
WITH r AS (SELECT user_id, event_id % 7 AS stage, event_id FROM events), s AS (SELECT u.user_id, i AS stage FROM (SELECT DISTINCT user_id FROM events) u, (SELECT unnest(range(0, 7)) AS i)),
l AS (SELECT s.user_id, s.stage, max(r.event_id) AS ran FROM s LEFT JOIN r ON r.user_id = s.user_id AND r.stage = s.stage GROUP BY s.user_id, s.stage),
m AS (SELECT *, max(ran) OVER (PARTITION BY user_id ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, count(*) FILTER (ran IS NULL) OVER (PARTITION BY user_id ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gaps FROM l)
SELECT user_id, {STAGES_SQL}[stage + 1] AS stage, CASE WHEN ran IS NULL THEN 'waiting' WHEN coalesce(before, -1) > ran OR gaps > 0 THEN 'stale' ELSE 'done' END AS state FROM m""")
def stage_status(spark, sf_dir):
    """A run of a stage makes all later ones stale until they run again."""
    names = F.array(*map(F.lit, ("preprocess", "align", "locate", "detect", "crop", "classify", "grade")))
    e = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 7).cast("int").alias("stage")).agg(F.max("event_id").alias("at"))
    users = table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("stage"))
    return gates.stage_states(users.join(e, ["user_id", "stage"], "left"), "user_id").select("user_id", names[F.col("stage")].alias("stage"), "state")


@query("R12", """
SELECT p_partkey, concat_ws('; ', CASE WHEN p_type NOT IN (SELECT DISTINCT p_type FROM part WHERE p_size > 45) THEN 'foreign_class' END, CASE WHEN p_size % 3 = 0 AND p_retailprice % 1 > 0.9 THEN 'bare_land_good' END, CASE WHEN p_size % 4 = 1 THEN 'external_weights' END) AS faults FROM part""")
def contract_probe(spark, sf_dir):
    """A trained model's faults: classes that the taxonomy lacks, a bare land called good, weights outside its file."""
    p = table(spark, sf_dir, "part")
    known = p.where("p_size > 45").select(F.col("p_type").alias("known")).distinct()
    j = p.join(known, F.col("p_type") == F.col("known"), "left")
    bare = F.when(F.col("p_size") % 3 == 0, F.col("p_retailprice") % 1)
    return j.select("p_partkey", gates.all_failures([("foreign_class", F.col("known").isNull()), ("bare_land_good", bare > 0.9), ("external_weights", F.col("p_size") % 4 == 1)]).alias("faults"))


@query("R13", """SELECT doc_id, split FROM sample WHERE doc_id % 6 IN (0, 5) OR doc_id % 6 = 4""", ("sample",))
def reviewed_labels(spark, sf_dir):
    """Labels that a model proposed count only once a person has reviewed their manifest; drawn ones always do."""
    k = F.col("doc_id") % 6
    s = view(spark, sf_dir, "sample").withColumns({"proposed": k < 4, "status": F.when(k == 0, " Reviewed ").when(k == 1, "draft").when(k == 2, "")})
    return s.where(gates.trainable(F.col("proposed"), F.col("status"))).select("doc_id", "split")


@query("R14", """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'demo' WHEN 1 THEN 'error: demo mode takes no model' WHEN 2 THEN 'model' WHEN 3 THEN 'error: model without manifest' WHEN 4 THEN 'error: manifest without model' ELSE 'none' END AS made FROM part""")
def factory_rules(spark, sf_dir):
    """What is made of a configuration: a demo detector, a model, nothing, or an error where it names half of a contract."""
    k = F.col("p_partkey") % 6
    mode = F.when(k.isin(0, 1), "cv").otherwise("auto")
    return table(spark, sf_dir, "part").select("p_partkey", gates.made(mode, F.when(k.isin(1, 2, 3), F.col("p_name")), F.when(k.isin(2, 4), F.col("p_brand"))).alias("made"))


@query("M6", """
WITH e AS (SELECT l_suppkey AS run, l_linenumber AS epoch, count(*) FILTER (l_discount > 0.05 AND l_tax < 0.03) AS esc, count(*) FILTER (l_discount > 0.05) AS bad, count(*) FILTER (l_discount <= 0.05 AND l_tax >= 0.06) AS fc, count(*) FILTER (l_discount <= 0.05) AS good FROM lineitem GROUP BY l_suppkey, l_linenumber),
s AS (SELECT run, epoch, round_even(2 * (1 - coalesce(esc / nullif(bad, 0), 0)) + 1 - coalesce(fc / nullif(good, 0), 0), 9) AS score FROM e)
SELECT run, epoch, score FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY score DESC, epoch) AS r FROM s) t WHERE r = 1""")
def best_checkpoint(spark, sf_dir):
    """The epoch of each training run that lets fewest defects escape, at twice the weight of false calls; the first of equals."""
    from boardsift.operators.metrics import checkpoint_score

    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("run"), F.col("l_linenumber").alias("epoch"), (F.col("l_discount") > 0.05).alias("defect"), F.when(F.col("l_discount") > 0.05, F.col("l_tax") < 0.03).otherwise(F.col("l_tax") >= 0.06).alias("wrong"))
    s = li.groupBy("run", "epoch").agg(F.bround(checkpoint_score(F.col("defect"), F.col("wrong")), 9).alias("score"))
    best = s.groupBy("run").agg(F.max(F.struct("score", (-F.col("epoch")).alias("epoch"))).alias("b"))
    return best.select("run", (-F.col("b.epoch")).alias("epoch"), F.col("b.score").alias("score"))


@query("D11", """
WITH m AS (SELECT source, split, CASE WHEN raw_label LIKE '%Raw%' THEN 'ignored' WHEN raw_label LIKE '%Toxic%' THEN 'unmapped' ELSE 'mapped' END AS status, raw_label, image FROM sample)
SELECT source, split, status, count(*) AS n, count(DISTINCT image) AS images, count(*) FILTER (status = 'mapped') < 15 AS thin FROM m GROUP BY source, split, status""", ("sample",))
def merge_audit(spark, sf_dir):
    """Sources merged under one taxonomy: what is mapped, ignored and unmapped in each source and split, and what is thin."""
    from boardsift.operators.datasets import mapped_labels

    s = view(spark, sf_dir, "sample").withColumnRenamed("raw_label", "raw")
    labels = s.select("raw").distinct()
    found = mapped_labels(s, labels.where("raw like '%Raw%'"), labels.where("raw not like '%Raw%' and raw not like '%Toxic%'").withColumn("name", F.col("raw")))
    out = found.groupBy("source", "split", "status").agg(F.count("*").alias("n"), F.count_distinct("image").alias("images"))
    return out.withColumn("thin", F.when(F.col("status") == "mapped", F.col("n") < 15).otherwise(True))
