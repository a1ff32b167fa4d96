"""Exports: whole rows of the tables that leave the engine, and what is read back of files that were written."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from boardsift import shared
from boardsift.catalog import query
from boardsift.functions import boxes as B
from boardsift.functions import text as T
from boardsift.operators import reconcile
from boardsift.plans.joins import PAIRED
from boardsift.sources import evidence, sinks, tables
from boardsift.views import table, view

KEY = ["board_id", "no"]


@query("K3", """
SELECT d.board_id, d.no, joint_id || ',' || detection_id || ',' || label || ',' || kind || ',' || position || ',' || CASE WHEN kind = 'body' THEN '' ELSE CAST(pin_index AS VARCHAR) END || ',' || geometry || ',' || format('{:.2f}', d.no * 1.5) || ',' || format('{:.2f},{:.2f},{:.2f},{:.2f}', x1, y1, x2, y2) || ',' || format('{:.4f}', confidence)
  || ',' || CASE WHEN d.no % 3 = 0 THEN 'cad' ELSE 'derived' END || ',' || CASE WHEN d.no % 3 = 0 THEN '"R' || d.no || ',x"' ELSE '' END || ',' || CASE WHEN d.no % 3 = 0 THEN CAST(pin_index AS VARCHAR) ELSE '' END || ',,' || CASE WHEN kind = 'body' THEN 'body_views' ELSE 'joints' END || '/' || joint_id || '.png,' AS line
FROM det d JOIN feat f ON d.board_id = f.board_id AND d.no = f.no""", ("det", "feat"))
def joints_csv(spark, sf_dir):
    cad = F.col("no") % 3 == 0
    f = view(spark, sf_dir, "feat").select(*KEY, "joint_id", "kind", "position", "pin_index", F.col("geometry").alias("terminal_geometry"))
    j = view(spark, sf_dir, "det").select(*KEY, "detection_id", "label", *B.SIDES, F.col("confidence").alias("detector_confidence")).join(f, KEY)
    j = j.withColumns({"pin": F.when(cad, F.col("pin_index")), "pin_index": F.when(F.col("kind") != "body", F.col("pin_index")), "angle": F.col("no") * 1.5, "source": F.when(cad, "cad").otherwise("derived"), "designator": F.when(cad, F.concat(F.lit("R"), F.col("no").cast("string"), F.lit(",x"))), "crop": F.concat("joint_id", F.lit(".png"))})
    return tables.joint_lines(j, KEY)


@query("K4", """
SELECT board_id, no, joint_id || ',d' || no || ',,' || pin_index || ',resistor,' || kind || ',' || CASE WHEN solder_ratio < 0.18 THEN 'insufficient_solder' ELSE 'good' END || ',' || CASE WHEN model_probability >= 0.8 THEN 'accept' ELSE 'review' END || ',rules,' || format('{:.4f}', model_probability) || ',good,' || CASE WHEN no % 4 = 0 THEN ',' ELSE 'good,' || format('{:.4f}', model_probability) END || ','
  || format('{:.4f},{:.4f},{:.4f},{:.4f},{:.4f}', solder_ratio, span_ratio, specular_ratio, contrast, centroid_offset_ratio) || ',24,' || no || ',v1,' || concat_ws(' | ', CASE WHEN solder_ratio < 0.18 THEN 'little solder' END, CASE WHEN contrast < 0.05 THEN 'dull' END) AS line
FROM feat""", ("feat",))
def verdicts_csv(spark, sf_dir):
    f = view(spark, sf_dir, "feat")
    little, dull = F.col("solder_ratio") < 0.18, F.col("contrast") < 0.05
    columns = {
        "detection_id": F.concat(F.lit("d"), F.col("no").cast("string")), "pin": F.col("pin_index"), "component_label": F.lit("resistor"), "scope": F.col("kind"), "label": F.when(little, "insufficient_solder").otherwise("good"),
        "decision": F.when(F.col("model_probability") >= 0.8, "accept").otherwise("review"), "source": F.lit("rules"), "probability": F.col("model_probability"), "rule_label": F.lit("good"), "model_label": F.when(F.col("no") % 4 != 0, "good"),
        "model_probability": F.when(F.col("no") % 4 != 0, F.col("model_probability")), "roi_width_px": F.lit(24), "roi_height_px": F.col("no"), "model_version": F.lit("v1"), "reasons": F.array_compact(F.array(F.when(little, "little solder"), F.when(dull, "dull"))),
    }
    return tables.verdict_lines(f.withColumns(columns), KEY)


@query("K5", PAIRED + """,
fd AS (SELECT 'missing' AS kind, 'error' AS severity, board_id, designator, NULL::INT AS no, part_class AS want, NULL::VARCHAR AS got, NULL::DOUBLE AS shift, NULL::DOUBLE AS x1, NULL::DOUBLE AS y1, NULL::DOUBLE AS x2, NULL::DOUBLE AS y2 FROM cad c WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.board_id = c.board_id AND mt.cad_no = c.cad_no)
UNION ALL SELECT 'shifted', 'review', c.board_id, designator, d.no, part_class, label, sqrt(pow(cx - (x1 + x2) / 2, 2) + pow(cy - (y1 + y2) / 2, 2)), x1, y1, x2, y2 FROM mt JOIN cad c ON mt.board_id = c.board_id AND mt.cad_no = c.cad_no JOIN det d ON mt.board_id = d.board_id AND mt.no = d.no WHERE sqrt(pow(cx - (x1 + x2) / 2, 2) + pow(cy - (y1 + y2) / 2, 2)) > 1.0)
SELECT board_id, kind || ',' || severity || ',' || designator || ',' || coalesce('d' || no, '') || ',' || want || ',' || coalesce(got, '') || ',' || coalesce(format('{:.3f}', round(shift, 6)), '') || ',' || coalesce(format('{:.2f},{:.2f},{:.2f},{:.2f}', x1, y1, x2, y2), ',,,') || ',' || kind || ': ' || designator AS line FROM fd""", ("cad",))
def findings_csv(spark, sf_dir):
    cad, det = view(spark, sf_dir, "cad"), view(spark, sf_dir, "det")
    found = reconcile.findings(cad, det, 6.0, 1.0).where("kind in ('missing', 'shifted')").select("board_id", "kind", "severity", "cad_no", "no")
    rows = found.join(cad, ["board_id", "cad_no"]).join(det.select(*KEY, "label", *B.SIDES), KEY, "left")
    shift = F.hypot(F.col("cx") - B.center_x(B.of()), F.col("cy") - B.center_y(B.of()))
    columns = {"detection_id": F.concat(F.lit("d"), F.col("no").cast("string")), "expected_class": F.col("part_class"), "observed_class": F.col("label"), "shift_mm": F.round(shift, 6), "message": F.concat("kind", F.lit(": "), "designator")}
    return tables.finding_lines(rows.withColumns(columns), ["board_id"])


@query("K7 P41", """
WITH p AS (SELECT board_id, no, 0.5 + (no % 4) * 0.125 AS p, label FROM det)
SELECT board_id, no, CASE WHEN p >= 0.75 THEN 'accept' ELSE 'review' END || ',' || CASE WHEN no % 6 = 0 THEN '''=' ELSE '' END || label || ',' || format('{:.8f}', p) || ',"[{""label"": ""' || CASE WHEN no % 6 = 0 THEN '=' ELSE '' END || label || '"", ""probability"": ' || format('{:.8f}', p) || '}, {""label"": ""other"", ""probability"": ' || format('{:.8f}', 1 - p) || '}]"' AS line FROM p""", ("det",))
def classifications_csv(spark, sf_dir):
    p = F.lit(0.5) + F.col("no") % 4 * 0.125
    label = F.when(F.col("no") % 6 == 0, F.concat(F.lit("="), "label")).otherwise(F.col("label"))
    d = view(spark, sf_dir, "det").select(*KEY, F.when(p >= 0.75, "accept").otherwise("review").alias("decision"), F.array(F.struct(label.alias("label"), p.alias("probability")), F.struct(F.lit("other").alias("label"), (1 - p).alias("probability"))).alias("top_k"))
    return tables.classification_lines(d, KEY)


@query("K8", """
SELECT board_id, '{"board_id":' || board_id || ',"source_sha256":"' || sha256('board' || board_id) || '","steps":[{"step":"detect","status":"done","latency_ms":' || count(*) || '},{"step":"grade","status":"' || CASE WHEN count(*) FILTER (label = 'pads') > 0 THEN 'done' ELSE 'skipped' END || '","latency_ms":' || sum(no) || '}],"detections":' || count(*) || '}' AS manifest FROM det GROUP BY board_id""", ("det",))
def ui_manifest(spark, sf_dir):
    """Provenance, steps with their status and time, and counts of one board."""
    d = view(spark, sf_dir, "det").groupBy("board_id").agg(F.count("*").alias("n"), F.sum("no").alias("s"), F.count_if(F.col("label") == "pads").alias("pads"))
    steps = F.array(F.struct(F.lit("detect").alias("step"), F.lit("done").alias("status"), F.col("n").alias("latency_ms")), F.struct(F.lit("grade").alias("step"), F.when(F.col("pads") > 0, "done").otherwise("skipped").alias("status"), F.col("s").alias("latency_ms")))
    digest = F.sha2(F.concat(F.lit("board"), F.col("board_id").cast("string")), 256)
    return d.select("board_id", F.to_json(F.struct("board_id", digest.alias("source_sha256"), steps.alias("steps"), F.col("n").alias("detections"))).alias("manifest"))


@query("K10", """
WITH l AS (SELECT board_id, no, CASE class_id WHEN 6 THEN 2 WHEN 2 THEN 1 WHEN 5 THEN 1 WHEN 7 THEN 1 ELSE 0 END AS k, x1, y1, x2, y2 FROM det WHERE x2 <= 230 AND y2 <= 170)
SELECT board_id, string_agg(k || ' ' || format('{:.6f} {:.6f} {:.6f} {:.6f}', (x1 + x2) / 2 / 250, (y1 + y2) / 2 / 250, (x2 - x1) / 250, (y2 - y1) / 250), chr(10) ORDER BY no) AS labels, count(*) FILTER (k = 0) AS two_terminal, count(*) FILTER (k = 1) AS multi_pin, count(*) FILTER (k = 2) AS pad_only FROM l GROUP BY board_id""", ("det",))
def pseudo_labels(spark, sf_dir):
    """A label file a board, classes by the topology of terminals, boxes that leave the image dropped, written and read back."""
    kinds = ("two_terminal", "multi_pin", "pad_only")
    d = view(spark, sf_dir, "det").where("x2 <= 230 and y2 <= 170").withColumn("k", F.array_position(F.array(*map(F.lit, kinds)), T.terminals(F.col("label"))).cast("int") - 1)
    lines = F.array_sort(F.collect_list(F.struct("no", sinks.yolo_line(F.col("k"), B.of(), 250, 250).alias("v"))))
    out = d.groupBy("board_id").agg(F.array_join(F.transform(lines, lambda x: x["v"]), "\n").alias("labels"), *(F.count_if(F.col("k") == i).alias(n) for i, n in enumerate(kinds)))
    return shared.written(out, "labels")


@query("K11", "SELECT board_id, count(*) AS slots, TRUE AS refused FROM det GROUP BY board_id", ("det",))
def published_recipes(spark, sf_dir):
    """Published as a whole; a second time is refused and changes nothing."""
    path = shared.folder(spark, "recipes")
    d = view(spark, sf_dir, "det").groupBy("board_id").agg(F.count("*").alias("slots"))
    sinks.publish(d, path)
    try:
        sinks.publish(d.withColumn("slots", F.lit(0).cast("long")), path)
        refused = False
    except AnalysisException:
        refused = True
    return spark.read.schema(d.schema).parquet(path).withColumn("refused", F.lit(refused))


@query("K12", """SELECT d.board_id, d.no, d.label, CAST(x1 AS INT) AS x1, CAST(y1 AS INT) AS y1, CAST(x2 AS INT) AS x2, CAST(y2 AS INT) AS y2, sha256('board' || d.board_id) AS source_sha256 FROM det d WHERE no % 3 <> 0""", ("det",))
def evidence_files(spark, sf_dir):
    """Evidence as JSON a board, in folders of boards, read back by its schema."""
    d = view(spark, sf_dir, "det")
    verdicts = d.select(*KEY, F.when(F.col("no") % 3 == 1, "review").when(F.col("no") % 3 == 2, "reject").otherwise("accept").alias("decision"))
    rows = evidence.evidence(verdicts, d)
    path = shared.folder(spark, "evidence")
    rows.withColumn("file", F.floor(F.col("board_id") / 40)).repartition("file").write.partitionBy("file").json(path)
    return spark.read.schema(rows.schema).json(path).select(*rows.columns)


@query("K13", """SELECT c_custkey, '{"width":' || (c_custkey % 4000) || ',"height":' || (c_custkey % 3000) || ',"name":"' || c_name || '"}' AS profile FROM customer""")
def profile_json(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", tables.finite_json({"width": F.col("c_custkey") % 4000, "height": F.col("c_custkey") % 3000, "name": F.col("c_name")}).alias("profile"))
