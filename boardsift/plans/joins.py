"""Joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardsift.catalog import query
from boardsift.functions import boxes as B
from boardsift.operators import reconcile
from boardsift.operators.spatial import touching
from boardsift.views import table, view


@query("J1", """SELECT d.board_id, d.no, f.joint_id, f.solder_ratio FROM det d LEFT JOIN feat f ON d.board_id = f.board_id AND d.no = f.no AND f.kind = 'body'""", ("det", "feat"))
def verdict_join(spark, sf_dir):
    f = view(spark, sf_dir, "feat").where("kind = 'body'").select("board_id", "no", "joint_id", "solder_ratio")
    return view(spark, sf_dir, "det").select("board_id", "no").join(f, ["board_id", "no"], "left")


@query("J2", """SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, o.o_orderpriority AS image, coalesce(CASE WHEN p.p_size < 25 THEN p.p_type END, 'unknown') AS category,
  CAST(trunc(l_quantity * 1.5) AS INT) AS x2 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON l.l_partkey = p.p_partkey AND p.p_size < 25""")
def coco_join(spark, sf_dir):
    li, o, p = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"]).join(p.where("p_size < 25").select("p_partkey", "p_type"), li["l_partkey"] == F.col("p_partkey"), "left")
    return j.select("l_orderkey", "l_linenumber", "l_partkey", F.col("o_orderpriority").alias("image"), F.coalesce("p_type", F.lit("unknown")).alias("category"), (F.col("l_quantity") * 1.5).cast("int").alias("x2"))


@query("J3", """
WITH i(raw) AS (VALUES ('de-Toxic!'), ('en Raw')), m(raw, name) AS (VALUES ('en', 'english'), ('en Raw', 'english'), ('de', 'german'))
SELECT doc_id, CASE WHEN i.raw IS NOT NULL THEN 'ignored' WHEN m.name IS NOT NULL THEN 'mapped' ELSE 'unmapped' END AS status, m.name AS label FROM sample s LEFT JOIN i ON s.raw_label = i.raw LEFT JOIN m ON s.raw_label = m.raw""", ("sample",))
def label_map_status(spark, sf_dir):
    from boardsift.operators.datasets import mapped_labels

    ignored = spark.createDataFrame([("de-Toxic!",), ("en Raw",)], "raw string")
    names = spark.createDataFrame([("en", "english"), ("en Raw", "english"), ("de", "german")], "raw string, name string")
    return mapped_labels(view(spark, sf_dir, "sample").withColumnRenamed("raw_label", "raw"), ignored, names).select("doc_id", "status", F.col("name").alias("label"))


PAIRED = """WITH {r} pr AS (SELECT c.board_id, cad_no, d.no, part_class, label,
  round_even(sqrt(pow(cx - (x1 + x2) / 2, 2) + pow(cy - (y1 + y2) / 2, 2)), 9) + CASE WHEN part_class IN ('unknown') OR label IN ('component_candidate') OR part_class = label THEN 0 ELSE 3 END AS cost
  FROM cad c JOIN det d ON c.board_id = d.board_id AND pow(cx - (x1 + x2) / 2, 2) + pow(cy - (y1 + y2) / 2, 2) <= 36),
rk AS (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY cost, cad_no, no) AS r FROM pr),
gr AS (SELECT board_id, 0::BIGINT AS r, []::INT[] AS ua, []::INT[] AS ub FROM (SELECT DISTINCT board_id FROM rk)
  UNION ALL SELECT g.board_id, k.r, CASE WHEN list_contains(ua, k.cad_no) OR list_contains(ub, k.no) THEN ua ELSE list_append(ua, k.cad_no) END, CASE WHEN list_contains(ua, k.cad_no) OR list_contains(ub, k.no) THEN ub ELSE list_append(ub, k.no) END
  FROM gr g JOIN rk k ON g.board_id = k.board_id AND k.r = g.r + 1),
mt AS (SELECT board_id, unnest(ua) AS cad_no, unnest(ub) AS no FROM (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY r DESC) AS z FROM gr) t WHERE z = 1) """.replace("{r} ", "RECURSIVE ")


def both(spark, sf_dir):
    return view(spark, sf_dir, "cad"), view(spark, sf_dir, "det")


@query("J4 J5 G3", PAIRED + "SELECT board_id, cad_no, no FROM mt", ("cad",))
def bom_position_match(spark, sf_dir):
    return reconcile.matched(*both(spark, sf_dir), 6.0)


@query("J6 J7 G10 T2", PAIRED + """
SELECT board_id, 'missing' AS kind, 'error' AS severity, cad_no, NULL::INT AS no FROM cad c WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.board_id = c.board_id AND mt.cad_no = c.cad_no)
UNION ALL SELECT board_id, 'unexpected', 'error', NULL, no FROM det d WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.board_id = d.board_id AND mt.no = d.no)
UNION ALL SELECT mt.board_id, 'class_mismatch', 'warning', mt.cad_no, mt.no FROM mt JOIN cad c ON mt.board_id = c.board_id AND mt.cad_no = c.cad_no JOIN det d ON mt.board_id = d.board_id AND mt.no = d.no WHERE part_class <> 'unknown' AND label <> 'component_candidate' AND part_class <> label
UNION ALL SELECT mt.board_id, 'shifted', 'review', mt.cad_no, mt.no FROM mt JOIN cad c ON mt.board_id = c.board_id AND mt.cad_no = c.cad_no JOIN det d ON mt.board_id = d.board_id AND mt.no = d.no WHERE sqrt(pow(cx - (x1 + x2) / 2, 2) + pow(cy - (y1 + y2) / 2, 2)) > 1.0""", ("cad",))
def cad_findings(spark, sf_dir):
    return reconcile.findings(*both(spark, sf_dir), 6.0, 1.0)


LEADS = """WITH ld AS (SELECT board_id, no AS lead_no, (x1 + x2) / 2 AS lx, (y1 + y2) / 2 AS ly FROM det WHERE label = 'pads' AND confidence >= 0.6),
bd AS (SELECT board_id, no, x1, y1, x2, y2, greatest(x2 - x1, y2 - y1) AS side FROM det WHERE label <> 'pads'),
ds AS (SELECT l.board_id, lead_no, b.no, round_even(sqrt(pow(greatest(x1 - lx, 0, lx - x2), 2) + pow(greatest(y1 - ly, 0, ly - y2), 2)) / side, 9) AS d FROM ld l JOIN bd b ON l.board_id = b.board_id),
nr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY board_id, lead_no ORDER BY d, no) AS r FROM ds WHERE d <= 0.2) t WHERE r = 1) """


def nearest_body(spark, sf_dir):
    from boardsift.operators.leads import assigned

    return assigned(view(spark, sf_dir, "det"), 0.6, 0.2)


@query("J8", LEADS + "SELECT board_id, lead_no, no FROM nr", ("det",))
def lead_assign(spark, sf_dir):
    return nearest_body(spark, sf_dir).select("board_id", "lead_no", "no")


@query("J9 G9", LEADS + """,
rois AS (SELECT board_id, no, 'top' AS position, x1, y1 - 0.26 * least(x2 - x1, y2 - y1) AS y1, x2, y1 + 0.14 * least(x2 - x1, y2 - y1) AS y2 FROM bd UNION ALL SELECT board_id, no, 'bottom', x1, y2 - 0.14 * least(x2 - x1, y2 - y1), x2, y2 + 0.26 * least(x2 - x1, y2 - y1) FROM bd),
hit AS (SELECT r.board_id, r.no, position, bool_or(greatest(least(r.x2, d.x2) - greatest(r.x1, d.x1), 0) * greatest(least(r.y2, d.y2) - greatest(r.y1, d.y1), 0) / least((r.x2 - r.x1) * (r.y2 - r.y1), (d.x2 - d.x1) * (d.y2 - d.y1)) >= 0.30) AS covered
  FROM rois r JOIN nr ON r.board_id = nr.board_id AND r.no = nr.no JOIN det d ON d.board_id = nr.board_id AND d.no = nr.lead_no GROUP BY ALL)
SELECT r.board_id, 'detected' AS source, count(*) AS n FROM nr r GROUP BY r.board_id
UNION ALL SELECT r.board_id, 'derived', count(*) FROM rois r LEFT JOIN hit h ON r.board_id = h.board_id AND r.no = h.no AND r.position = h.position WHERE NOT coalesce(covered, FALSE) GROUP BY r.board_id""", ("det",))
def lead_fusion(spark, sf_dir):
    from boardsift.operators.leads import fused

    return fused(view(spark, sf_dir, "det"), nearest_body(spark, sf_dir))


@query("J11 G4", """SELECT c.board_id, cad_no AS slot, d.no FROM cad c JOIN det d ON c.board_id = d.board_id WHERE (x1 + x2) / 2 >= cx - 6 AND (x1 + x2) / 2 < cx + 6 AND (y1 + y2) / 2 >= cy - 6 AND (y1 + y2) / 2 < cy + 6""", ("cad",))
def slot_edges(spark, sf_dir):
    from boardsift.operators.golden import edges

    return edges(view(spark, sf_dir, "cad"), view(spark, sf_dir, "det"), 6.0).select("board_id", "slot", "no")


@query("J16", """SELECT c.board_id, count(*) AS seeds FROM cad c JOIN det d ON c.board_id = d.board_id AND c.part_class = d.label GROUP BY c.board_id""", ("cad",))
def seed_pairs(spark, sf_dir):
    c = view(spark, sf_dir, "cad").groupBy("board_id", F.col("part_class").alias("label")).agg(F.count("*").alias("m"))
    d = view(spark, sf_dir, "det").groupBy("board_id", "label").agg(F.count("*").alias("n"))  # counts meet, not pairs
    return c.join(d, ["board_id", "label"]).groupBy("board_id").agg(F.sum(F.col("m") * F.col("n")).alias("seeds"))


@query("J17", """SELECT a.board_id, a.no AS a_no, b.no AS b_no FROM det a JOIN det b ON a.board_id = b.board_id AND a.no < b.no AND floor(a.no / 4) <> floor(b.no / 4) AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2""", ("det",))
def neighbour_pairs(spark, sf_dir):
    d = view(spark, sf_dir, "det").select("board_id", "no", F.floor(F.col("no") / 4).alias("part"), B.of().alias("b"))
    a, b = (d.select("board_id", F.col("no").alias(f"{k}_no"), F.col("part").alias(f"{k}_part"), F.col("b").alias(k)) for k in "ab")
    return touching(a, b, "board_id", "a", "b").where((F.col("a_no") < F.col("b_no")) & (F.col("a_part") != F.col("b_part"))).select("board_id", "a_no", "b_no")


@query("J19", """SELECT c.board_id, cad_no, coalesce(f.position, 'none') AS position FROM cad c LEFT JOIN feat f ON c.board_id = f.board_id AND c.cad_no = f.no AND f.pin_index < 2""", ("cad", "feat"))
def slot_overlay(spark, sf_dir):
    f = view(spark, sf_dir, "feat").where("pin_index < 2").select("board_id", F.col("no").alias("cad_no"), "position")
    return view(spark, sf_dir, "cad").select("board_id", "cad_no").join(f, ["board_id", "cad_no"], "left").na.fill("none", ["position"])
