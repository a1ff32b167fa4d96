"""Projections and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardsift.catalog import query
from boardsift.functions import boxes as B
from boardsift.functions import numbers as N
from boardsift.functions import text as T
from boardsift.operators.spatial import touching
from boardsift.views import table, view

KEY = ["board_id", "no"]


@query("P1 P5", "SELECT board_id, no, x2 - x1 AS w, y2 - y1 AS h, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, (x2 - x1) * (y2 - y1) AS area FROM det", ("det",))
def box_metrics(spark, sf_dir):
    b = B.of()
    return view(spark, sf_dir, "det").select(*KEY, B.width(b).alias("w"), B.height(b).alias("h"), B.center_x(b).alias("cx"), B.center_y(b).alias("cy"), B.area(b).alias("area"))


@query("P2 P3 P4 F2", """
SELECT board_id, no, CAST(floor(a) AS INT) AS x1, CAST(floor(b) AS INT) AS y1, CAST(ceil(c) AS INT) AS x2, CAST(ceil(d) AS INT) AS y2 FROM (
  SELECT board_id, no, least(greatest(x1 - 20.5, 0), 180) AS a, least(greatest(y1 + 4.25, 0), 130) AS b, least(greatest(x2 - 20.5, 0), 180) AS c, least(greatest(y2 + 4.25, 0), 130) AS d FROM det) t
WHERE c > a AND d > b""", ("det",))
def box_clip(spark, sf_dir):
    d = view(spark, sf_dir, "det").withColumn("b", B.clamped(B.shifted(B.of(), -20.5, 4.25), 180, 130))
    return d.where((B.width(F.col("b")) > 0) & (B.height(F.col("b")) > 0)).select(*KEY, B.outward(F.col("b")).alias("o")).select(*KEY, "o.*")


PAIRS = """
WITH p AS (SELECT a.board_id, a.no AS a_no, b.no AS b_no, a.x1 ax1, a.y1 ay1, a.x2 ax2, a.y2 ay2, b.x1 bx1, b.y1 by1, b.x2 bx2, b.y2 by2,
  greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS i,
  (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ba
  FROM det a JOIN det b ON a.board_id = b.board_id AND a.no < b.no AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2) """


def met(spark, sf_dir):
    """Overlapping boxes of a board."""
    d = view(spark, sf_dir, "det").select("board_id", "no", B.of().alias("b"))
    a, b = (d.select("board_id", F.col("no").alias(f"{k}_no"), F.col("b").alias(k)) for k in "ab")
    return touching(a, b, "board_id", "a", "b").where(F.col("a_no") < F.col("b_no"))


@query("P6 P7 P11", PAIRS + "SELECT board_id, a_no, b_no, round_even(i / (aa + ba - i), 9) AS iou, round_even(i / least(aa, ba), 9) AS ios FROM p", ("det",))
def iou_pairs(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return met(spark, sf_dir).select("board_id", "a_no", "b_no", F.bround(B.iou(a, b), 9).alias("iou"), F.bround(B.ios(a, b), 9).alias("ios"))


@query("P8", "SELECT board_id, no, round_even(sqrt(pow(greatest(x1 - 100, 0, 100 - x2), 2) + pow(greatest(y1 - 75, 0, 75 - y2), 2)), 6) AS distance FROM det", ("det",))
def point_to_box(spark, sf_dir):
    return view(spark, sf_dir, "det").select(*KEY, F.bround(B.distance(F.lit(100.0), F.lit(75.0), B.of()), 6).alias("distance"))


@query("P9", PAIRS + """, s AS (
  SELECT board_id, a_no, b_no, u.k, u.x1, u.y1, u.x2, u.y2 FROM (SELECT *, unnest([
    {'k': 1, 'x1': ax1, 'y1': ay1, 'x2': least(bx1, ax2), 'y2': ay2}, {'k': 2, 'x1': greatest(bx2, ax1), 'y1': ay1, 'x2': ax2, 'y2': ay2},
    {'k': 3, 'x1': ax1, 'y1': ay1, 'x2': ax2, 'y2': least(by1, ay2)}, {'k': 4, 'x1': ax1, 'y1': greatest(by2, ay1), 'x2': ax2, 'y2': ay2}]) AS u FROM p) t
  WHERE u.x2 > u.x1 AND u.y2 > u.y1),
r AS (SELECT *, row_number() OVER (PARTITION BY board_id, a_no, b_no ORDER BY (x2 - x1) * (y2 - y1) DESC, k) AS n FROM s)
SELECT board_id, a_no, b_no, x1, y1, x2, y2 FROM r WHERE n = 1""", ("det",))
def box_cut(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return met(spark, sf_dir).where(B.uncovered(a, b)).select("board_id", "a_no", "b_no", B.without(a, b).alias("c")).select("board_id", "a_no", "b_no", "c.*")


@query("P10", PAIRS + """
SELECT board_id, a_no, b_no,
  CASE WHEN v AND NOT l THEN mx ELSE ax1 END AS ax1, CASE WHEN NOT v AND NOT t THEN my ELSE ay1 END AS ay1,
  CASE WHEN v AND l THEN mx ELSE ax2 END AS ax2, CASE WHEN NOT v AND t THEN my ELSE ay2 END AS ay2,
  CASE WHEN v AND l THEN mx ELSE bx1 END AS bx1, CASE WHEN NOT v AND t THEN my ELSE by1 END AS by1,
  CASE WHEN v AND NOT l THEN mx ELSE bx2 END AS bx2, CASE WHEN NOT v AND NOT t THEN my ELSE by2 END AS by2
FROM (SELECT *, least(ax2, bx2) - greatest(ax1, bx1) <= least(ay2, by2) - greatest(ay1, by1) AS v, ax1 + ax2 <= bx1 + bx2 AS l, ay1 + ay2 <= by1 + by2 AS t,
  (greatest(ax1, bx1) + least(ax2, bx2)) / 2 AS mx, (greatest(ay1, by1) + least(ay2, by2)) / 2 AS my FROM p) q""", ("det",))
def box_split(spark, sf_dir):
    one, two = B.halves(F.col("a"), F.col("b"))
    d = met(spark, sf_dir).select("board_id", "a_no", "b_no", one.alias("p"), two.alias("q"))
    return d.select("board_id", "a_no", "b_no", *(F.col(f"p.{k}").alias(f"a{k}") for k in B.SIDES), *(F.col(f"q.{k}").alias(f"b{k}") for k in B.SIDES))


@query("P12", PAIRS + """
SELECT board_id, a_no, b_no, (greatest(ax2, bx2) - least(ax1, bx1)) * (greatest(ay2, by2) - least(ay1, by1)) AS union_area, i AS overlap_area FROM p""", ("det",))
def box_merge(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return met(spark, sf_dir).select("board_id", "a_no", "b_no", B.area(B.hull(a, b)).alias("union_area"), B.area(B.overlap(a, b)).alias("overlap_area"))


@query("P13 I13", """
SELECT board_id, no, round_even(cx - rx, 6) AS x1, round_even(cy - ry, 6) AS y1, round_even(cx + rx, 6) AS x2, round_even(cy + ry, 6) AS y2 FROM (
  SELECT board_id, no, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy,
    ((x2 - x1) * abs(cos(radians(no % 180))) + (y2 - y1) * abs(sin(radians(no % 180)))) / 2 AS rx,
    ((x2 - x1) * abs(sin(radians(no % 180))) + (y2 - y1) * abs(cos(radians(no % 180)))) / 2 AS ry FROM det) t""", ("det",))
def rotated_box(spark, sf_dir):
    b = B.of()
    d = view(spark, sf_dir, "det").select(*KEY, B.turned(B.center_x(b), B.center_y(b), B.width(b), B.height(b), F.col("no") % 180).alias("t"))
    return d.select(*KEY, *(F.bround(f"t.{k}", 6).alias(k) for k in B.SIDES))


@query("P14 P55", """
SELECT board_id, no, least(greatest(x1 - p, 0), 260) AS x1, least(greatest(y1 - p, 0), 180) AS y1, least(greatest(x2 + p, 0), 260) AS x2, least(greatest(y2 + p, 0), 180) AS y2,
  round_even((x2 - x1) * (y2 - y1) / (260.0 * 180.0), 4) AS coverage
FROM (SELECT *, greatest(round_even(greatest(x2 - x1, y2 - y1) * 0.15, 0), 0) AS p FROM det) t""", ("det",))
def crop_expand(spark, sf_dir):
    b = B.of()
    d = view(spark, sf_dir, "det").withColumn("p", F.greatest(F.bround(F.greatest(B.width(b), B.height(b)) * 0.15, 0), F.lit(0.0)))
    grown = B.clamped(B.box(F.col("x1") - F.col("p"), F.col("y1") - F.col("p"), F.col("x2") + F.col("p"), F.col("y2") + F.col("p")), 260, 180)
    return d.select(*KEY, grown.alias("g"), F.bround(B.area(b) / (260.0 * 180.0), 4).alias("coverage")).select(*KEY, "g.*", "coverage")


@query("P15 P16 D10 D14", """
WITH c AS (SELECT *, greatest(round_even(0.35 * greatest(x2 - x1, y2 - y1), 0), 6) AS m FROM det WHERE label NOT IN ('pads', 'pins')),
w AS (SELECT *, x1 - m AS wx1, y1 - m AS wy1, x2 + m AS wx2, y2 + m AS wy2 FROM c),
j AS (SELECT w.board_id, w.no, d.no AS lead_no, d.x1, d.y1, d.x2, d.y2, wx1, wy1,
  greatest(d.x1, wx1) AS cx1, greatest(d.y1, wy1) AS cy1, least(d.x2, wx2) AS cx2, least(d.y2, wy2) AS cy2
  FROM w JOIN det d ON w.board_id = d.board_id AND d.label = 'pads' AND d.x1 < wx2 AND wx1 < d.x2 AND d.y1 < wy2 AND wy1 < d.y2)
SELECT board_id, no, lead_no, cx1 - wx1 AS x1, cy1 - wy1 AS y1, cx2 - wx1 AS x2, cy2 - wy1 AS y2
FROM j WHERE (cx2 - cx1) * (cy2 - cy1) >= 0.55 * ((x2 - x1) * (y2 - y1))""", ("det",))
def crop_window(spark, sf_dir):
    d, b = view(spark, sf_dir, "det"), B.of()
    m = F.greatest(F.bround(F.lit(0.35) * F.greatest(B.width(b), B.height(b)), 0), F.lit(6.0))
    windows = d.where("label not in ('pads', 'pins')").select(*KEY, B.box(F.col("x1") - m, F.col("y1") - m, F.col("x2") + m, F.col("y2") + m).alias("w"))
    leads = d.where("label = 'pads'").select("board_id", F.col("no").alias("lead_no"), b.alias("l"))
    w, lead, c = F.col("w"), F.col("l"), F.col("c")
    j = touching(windows, leads, "board_id", "w", "l").withColumn("c", B.overlap(lead, w)).where(B.area(c) >= F.lit(0.55) * B.area(lead))
    return j.select(*KEY, "lead_no", B.shifted(c, -w["x1"], -w["y1"]).alias("o")).select(*KEY, "lead_no", "o.*")


@query("P17 P18 P19", """
SELECT board_id, no, round_even((2.0 * cx + 0.5 * cy + 10) / (0.0001 * cx + 0.0002 * cy + 1), 6) AS px, round_even((-0.5 * cx + 2.0 * cy + 20) / (0.0001 * cx + 0.0002 * cy + 1), 6) AS py,
  round_even(sqrt(abs(2.0 * 2.0 + 0.5 * 0.5)), 9) AS px_per_mm, round_even(degrees(atan2(-0.5, 2.0)), 9) AS angle
FROM (SELECT board_id, no, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM det) t""", ("det",))
def project_points(spark, sf_dir):
    from boardsift.operators.registration import angle, pixel_scale, projected

    m = [[2.0, 0.5, 10.0], [-0.5, 2.0, 20.0], [0.0001, 0.0002, 1.0]]
    px, py = projected(m, B.center_x(B.of()), B.center_y(B.of()))
    return view(spark, sf_dir, "det").select(*KEY, F.bround(px, 6).alias("px"), F.bround(py, 6).alias("py"), F.bround(F.lit(pixel_scale(m)), 9).alias("px_per_mm"), F.bround(F.lit(angle(m)), 9).alias("angle"))


@query("P20", """
SELECT board_id, no, a - 180 * floor((a + 90) / 180.0) AS wrapped, abs((a - 37) - 180 * floor((a - 37 + 90) / 180.0)) AS gap FROM (SELECT board_id, no, CAST((no * 37) % 720 - 360 AS DOUBLE) AS a FROM det) t""", ("det",))
def periodic_angle(spark, sf_dir):
    a = ((F.col("no") * 37) % 720 - 360).cast("double")
    return view(spark, sf_dir, "det").select(*KEY, N.wrapped(a).alias("wrapped"), N.axis_gap(a, F.lit(37.0)).alias("gap"))


@query("P21 R7", """
SELECT board_id, cad_no, round_even(dx / 40, 9) AS dx_mm, round_even(dy / 42, 9) AS dy_mm, abs(dx / 40) <= 0.05 AND abs(dy / 42) <= 0.04 AS position_ok
FROM (SELECT c.board_id, cad_no, c.cx - (x1 + x2) / 2 AS dx, c.cy - (y1 + y2) / 2 AS dy FROM cad c JOIN det d ON c.board_id = d.board_id AND c.cad_no = d.no) t""", ("cad",))
def displacement_mm(spark, sf_dir):
    j = view(spark, sf_dir, "cad").join(view(spark, sf_dir, "det").withColumnRenamed("no", "cad_no"), ["board_id", "cad_no"])
    dx, dy = (F.col("cx") - B.center_x(B.of())) / 40, (F.col("cy") - B.center_y(B.of())) / 42
    return j.select("board_id", "cad_no", F.bround(dx, 9).alias("dx_mm"), F.bround(dy, 9).alias("dy_mm"), ((F.abs(dx) <= 0.05) & (F.abs(dy) <= 0.04)).alias("position_ok"))


@query("P22", "SELECT p_partkey, regexp_replace(lower(trim(p_brand || ' / ' || p_type)), '[^a-z0-9]', '', 'g') AS k FROM part")
def header_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.plain_key(F.concat("p_brand", F.lit(" / "), "p_type")).alias("k"))


CELL = "CASE p_partkey % 7 WHEN 0 THEN CAST(p_size AS VARCHAR(9)) || ',5mm' WHEN 1 THEN '-' || CAST(p_size AS VARCHAR(9)) || 'mil' WHEN 2 THEN ' ' || CAST(p_size AS VARCHAR(9)) || '.25 in' WHEN 3 THEN 'n/a' WHEN 4 THEN CAST(p_size AS VARCHAR(9)) || 'e1cm' WHEN 5 THEN '' ELSE '.5' END"


@query("P23 P24", f"""
SELECT p_partkey, round_even(coalesce(CAST(nullif(regexp_extract(replace(trim(c), ',', '.'), '^[-+]?\\d*\\.?\\d+(?:[eE][-+]?\\d+)?'), '') AS DOUBLE), 0) *
  CASE regexp_extract(lower(trim(c)), '([a-z]+)$', 1) WHEN 'mm' THEN 1.0 WHEN 'mil' THEN 0.0254 WHEN 'in' THEN 25.4 WHEN 'cm' THEN 10.0 ELSE 1.0 END, 9) AS mm
FROM (SELECT p_partkey, {CELL} AS c FROM part) t""")
def unit_parse(spark, sf_dir):
    c = table(spark, sf_dir, "part").select("p_partkey", F.expr(CELL.replace("VARCHAR(9)", "STRING")).alias("c"))
    return c.select("p_partkey", F.bround(T.number(F.col("c")) * T.unit_scale(F.col("c")), 9).alias("mm"))


@query("P25", """SELECT c_custkey, CASE WHEN w IN ('top','t','1','front','topside','top side','smd_top') THEN 'top' WHEN w IN ('bottom','b','2','back','bot','bottomside','smd_bottom') THEN 'bottom' ELSE 'top' END AS side
FROM (SELECT c_custkey, lower(trim(CASE c_custkey % 6 WHEN 0 THEN ' Bot' WHEN 1 THEN 'TOP ' WHEN 2 THEN 'Back' WHEN 3 THEN '2' WHEN 4 THEN 'x' ELSE '' END)) AS w FROM customer) t""")
def side_name(spark, sf_dir):
    word = F.expr("CASE c_custkey % 6 WHEN 0 THEN ' Bot' WHEN 1 THEN 'TOP ' WHEN 2 THEN 'Back' WHEN 3 THEN '2' WHEN 4 THEN 'x' END")
    return table(spark, sf_dir, "customer").select("c_custkey", T.side(word).alias("side"))


DESIGNATOR = "CONCAT(CASE p_partkey % 12 WHEN 0 THEN 'LED' WHEN 1 THEN 'L' WHEN 2 THEN 'Rx' WHEN 3 THEN 'cn' WHEN 4 THEN 'XTAL' WHEN 5 THEN 'ZZ' WHEN 6 THEN 'TPQ' WHEN 7 THEN '9' WHEN 8 THEN 'POTS' WHEN 9 THEN 'conn' WHEN 10 THEN 'u' ELSE 'DSX' END, CAST(p_partkey AS VARCHAR(9)))"
PREFIXES = ", ".join(f"('{k}', '{v}')" for k, v in T.DESIGNATOR_CLASSES.items())


@query("P26", f"""
WITH d AS (SELECT p_partkey, {DESIGNATOR} AS designator FROM part), m(prefix, part_class) AS (VALUES {PREFIXES}),
j AS (SELECT p_partkey, part_class, row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC) AS n FROM d JOIN m ON starts_with(upper(regexp_extract(designator, '^[A-Za-z]+')), prefix))
SELECT d.p_partkey, designator, part_class FROM d LEFT JOIN j ON d.p_partkey = j.p_partkey AND n = 1""")
def designator_class(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.expr(DESIGNATOR.replace("VARCHAR(9)", "STRING")).alias("designator"))
    return d.select("*", T.part_class(F.col("designator")).alias("part_class"))


@query("P27", """
SELECT c.board_id, cad_no, part_class NOT IN ('', 'component', 'component_candidate', 'candidate', 'object', 'unknown') AS informative,
  part_class IN ('unknown') OR label IN ('component_candidate') OR part_class = label AS agrees
FROM cad c JOIN det d ON c.board_id = d.board_id AND cad_no = no""", ("cad",))
def label_agreement(spark, sf_dir):
    j = view(spark, sf_dir, "cad").join(view(spark, sf_dir, "det").withColumnRenamed("no", "cad_no"), ["board_id", "cad_no"])
    return j.select("board_id", "cad_no", T.informative(F.col("part_class")).alias("informative"), T.agree(F.col("part_class"), F.col("label")).alias("agrees"))


@query("P28 P53", """
SELECT board_id, no, CASE WHEN label IN ('capacitor','resistor','diode','led','inductor','fuse') THEN 'two_terminal' WHEN label = 'pads' THEN 'pad_only' ELSE 'multi_pin' END AS geometry,
  CASE WHEN no % 9 = 0 THEN 'auto' WHEN x2 - x1 >= y2 - y1 THEN 'horizontal' ELSE 'vertical' END AS axis FROM det""", ("det",))
def terminal_geometry(spark, sf_dir):
    b = B.of()
    axis = F.when(F.col("no") % 9 == 0, "auto").when(B.width(b) >= B.height(b), "horizontal").otherwise("vertical")
    return view(spark, sf_dir, "det").select(*KEY, T.terminals(F.col("label")).alias("geometry"), axis.alias("axis"))


CELLS = "CONCAT('R', CAST(c_custkey AS VARCHAR(9)), ', C', CAST(c_custkey AS VARCHAR(9)), ';CONN 1   U', CAST(c_custkey % 50 AS VARCHAR(9)), ' ,;')"


@query("P29", f"SELECT c_custkey, trim(d) AS designator FROM (SELECT c_custkey, unnest(regexp_split_to_array({CELLS}, '[,;]|\\s{{2,}}')) AS d FROM customer) t WHERE trim(d) <> ''")
def designator_split(spark, sf_dir):
    c = F.expr(CELLS.replace("VARCHAR(9)", "STRING"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.explode(T.designators(c)).alias("designator"))


@query("P30", "SELECT doc_id, trim(regexp_replace(lower(raw_label), '[^a-z0-9]+', '_', 'g'), '_') AS label FROM sample", ("sample",))
def label_normalise(spark, sf_dir):
    return view(spark, sf_dir, "sample").select("doc_id", T.plain_label(F.col("raw_label")).alias("label"))


FILE = "CONCAT('a/b/board', CAST(doc_id % 90 AS VARCHAR(9)), CASE doc_id % 3 WHEN 0 THEN '_jpg.rf.0a1b2c3d' WHEN 1 THEN '.RF.ABCDEF' ELSE '' END, '.png')"


@query("P31", f"SELECT doc_id, regexp_replace(regexp_replace(regexp_extract({FILE}, '[^/]*$'), '\\.[^.]*$', ''), '(?i)(_(jpe?g|png|bmp))?\\.rf\\.[0-9a-f]{{6,}}$', '') AS g FROM documents")
def source_group(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.source_group(F.expr(FILE.replace("VARCHAR(9)", "STRING"))).alias("g"))


@query("P32 W12", "SELECT p_partkey, format('{:04d}_', p_partkey) || CASE WHEN w = '' THEN 'item' ELSE w END AS name FROM (SELECT p_partkey, substr(trim(regexp_replace(p_name || '/é #' || p_type, '[^A-Za-z0-9_.-]+', '_', 'g'), '._'), 1, 24) AS w FROM part) t")
def safe_filename(spark, sf_dir):
    name = T.safe_name(F.concat("p_name", F.lit("/é #"), "p_type"), 24)
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(F.format_string("%04d_", "p_partkey"), name).alias("name"))


@query("P33 D9", "SELECT doc_id, sha256(text) AS digest, sha256(CONCAT('{\"doc_id\":', CAST(doc_id AS VARCHAR), ',\"source\":\"', source, '\"}')) AS record_digest FROM documents")
def content_digest(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), F.sha2(F.to_json(F.struct("doc_id", "source")), 256).alias("record_digest"))


@query("P34 S19", """SELECT event_id, CAST(coalesce(props ->> '$.model.k', props ->> '$.k', '-1') AS INT) AS k, coalesce(props ->> '$.name', event_type) AS name FROM events""")
def json_dig(spark, sf_dir):
    def first(*paths):
        return F.coalesce(*(F.get_json_object("props", p) for p in paths))

    return table(spark, sf_dir, "events").select("event_id", F.coalesce(first("$.model.k", "$.k"), F.lit("-1")).cast("int").alias("k"), F.coalesce(first("$.name"), "event_type").alias("name"))


def logits(spark, sf_dir):
    z = view(spark, sf_dir, "logit").groupBy("board_id", "no").agg(F.array_sort(F.collect_list(F.struct("k", "z"))).alias("kz"))
    return z.select("board_id", "no", F.col("kz.z").alias("z"))


SOFT = """WITH m AS (SELECT *, max(z) OVER (PARTITION BY board_id, no) AS top FROM logit),
e AS (SELECT *, exp((z - top) / 1.5) AS e FROM m), p AS (SELECT *, e / sum(e) OVER (PARTITION BY board_id, no) AS p FROM e),
r AS (SELECT *, row_number() OVER (PARTITION BY board_id, no ORDER BY z DESC, k) AS rank FROM p) """


@query("P35 W7 M3", SOFT + "SELECT board_id, no, CAST(rank AS INT) AS rank, k AS label, round_even(p, 9) AS probability FROM r WHERE rank <= 3", ("logit",))
def softmax_topk(spark, sf_dir):
    d = logits(spark, sf_dir).select("board_id", "no", F.posexplode(N.ranked(F.array(*map(F.lit, range(5))), N.softmax(F.col("z"), 1.5), 3)).alias("i", "c"))
    return d.select("board_id", "no", (F.col("i") + 1).alias("rank"), F.col("c.label").alias("label"), F.bround("c.probability", 9).alias("probability"))


@query("P41 R5", SOFT + """, t AS (SELECT board_id, no, string_agg('c' || k || ':' || format('{:.3f}', p), ' | ' ORDER BY rank) AS top, max(p) FILTER (rank = 1) AS best FROM r WHERE rank <= 3 GROUP BY ALL)
SELECT board_id, no, top, CASE WHEN best >= 0.85 THEN 'accept' WHEN best >= 0.5 THEN 'review' ELSE 'unknown' END AS decision FROM t""", ("logit",))
def classify_decision(spark, sf_dir):
    d = logits(spark, sf_dir).select("board_id", "no", N.ranked(F.array(*map(F.lit, range(5))), N.softmax(F.col("z"), 1.5), 3).alias("t"))
    top = F.array_join(F.transform("t", lambda c: F.format_string("c%d:%.3f", c["label"], c["probability"])), " | ")
    return d.select("board_id", "no", top.alias("top"), N.decision(F.col("t")[0]["probability"], 0.85, 0.5).alias("decision"))


@query("P36 F5 F6", """
SELECT board_id, no, own, border, round_even(confidence - CASE WHEN border THEN 0.10 ELSE 0 END - CASE WHEN pass = 'tile' AND NOT own THEN 0.10 ELSE 0 END, 9) AS score FROM (
  SELECT *, (x1 + x2) / 2 >= tx1 + 20 AND (x1 + x2) / 2 < tx2 - 20 AND (y1 + y2) / 2 >= ty1 + 20 AND (y1 + y2) / 2 < ty2 - 20 AS own,
    pass = 'tile' AND ((x1 - tx1 <= 4.2 AND tx1 > 0) OR (y1 - ty1 <= 4.2 AND ty1 > 0) OR (tx2 - x2 <= 4.2 AND tx2 < 260) OR (ty2 - y2 <= 4.2 AND ty2 < 180)) AS border FROM tile) t""", ("tile",))
def merge_score(spark, sf_dir):
    from boardsift.operators.tiling import inside, near_border

    t = view(spark, sf_dir, "tile")
    own = inside(B.center_x(B.of()), B.center_y(B.of()), B.box(F.col("tx1") + 20, F.col("ty1") + 20, F.col("tx2") - 20, F.col("ty2") - 20))
    border = (F.col("pass") == "tile") & near_border(B.of(), B.of("t"), 260, 180, 4.2)
    t = t.select(*KEY, own.alias("own"), border.alias("border"), "confidence", (F.col("pass") == "tile").alias("tiled"))
    return t.select(*KEY, "own", "border", F.bround(N.merge_score(F.col("confidence"), F.col("border"), F.col("tiled"), F.col("own")), 9).alias("score"))


@query("P37", """SELECT board_id, no, CASE WHEN no % 3 <> 0 THEN round_even(100 * (1 - (x2 - x1 - 4) * (y2 - y1 - 2) / ((x2 - x1) * (y2 - y1))), 1) END AS shrink FROM det""", ("det",))
def shrink_percent(spark, sf_dir):
    b = B.of()
    now = (B.width(b) - 4) * (B.height(b) - 2)
    return view(spark, sf_dir, "det").select(*KEY, F.when(F.col("no") % 3 != 0, F.bround(100 * (1 - now / B.area(b)), 1)).alias("shrink"))


@query("P38", """SELECT board_id, no, round_even(CASE WHEN abs(a - 2 * b + c) < 1e-12 THEN 0 ELSE least(greatest(0.5 * (a - c) / (a - 2 * b + c), -1), 1) END, 9) AS offset_px
FROM (SELECT board_id, no, solder_ratio AS a, span_ratio + 1 AS b, edge_contact_end AS c FROM feat) t""", ("feat",))
def peak_offset(spark, sf_dir):
    return view(spark, sf_dir, "feat").select(*KEY, F.bround(N.peak_offset(F.col("solder_ratio"), F.col("span_ratio") + 1, F.col("edge_contact_end")), 9).alias("offset_px"))


@query("P39", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS stamp, strftime(ts, '%Y-%m-%d') AS day FROM events")
def iso_stamp(spark, sf_dir):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", F.concat(stamp, F.lit("+00:00")).alias("stamp"), F.substring(stamp, 1, 10).alias("day"))


@query("P40", "SELECT event_id, CASE event_type WHEN 'click' THEN 'Missing part' WHEN 'view' THEN 'Extra part' ELSE event_type END AS shown FROM events")
def display_label(spark, sf_dir):
    names = T.mapped({"click": "Missing part", "view": "Extra part"})
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.try_element_at(names, "event_type"), "event_type").alias("shown"))


@query("P42 P43", """
WITH c AS (SELECT *, x2 - x1 >= y2 - y1 AS flat, x2 - x1 AS w, y2 - y1 AS h FROM det WHERE label IN ('capacitor','resistor','diode','led','inductor','fuse')),
r AS (SELECT board_id, no, 'start' AS position, CASE WHEN flat THEN x1 - 0.45 * w ELSE x1 - 0.20 * w END AS x1, CASE WHEN flat THEN y1 - 0.20 * h ELSE y1 - 0.45 * h END AS y1,
    CASE WHEN flat THEN x1 + 0.30 * w ELSE x2 + 0.20 * w END AS x2, CASE WHEN flat THEN y2 + 0.20 * h ELSE y1 + 0.30 * h END AS y2 FROM c
  UNION ALL SELECT board_id, no, 'end', CASE WHEN flat THEN x2 - 0.30 * w ELSE x1 - 0.20 * w END, CASE WHEN flat THEN y1 - 0.20 * h ELSE y2 - 0.30 * h END,
    CASE WHEN flat THEN x2 + 0.45 * w ELSE x2 + 0.20 * w END, CASE WHEN flat THEN y2 + 0.20 * h ELSE y2 + 0.45 * h END FROM c)
SELECT board_id, no, position, round_even(x1, 6) AS x1, round_even(y1, 6) AS y1, round_even(x2, 6) AS x2, round_even(y2, 6) AS y2 FROM r""", ("det",))
def two_terminal_rois(spark, sf_dir):
    from boardsift.operators.joints import two_terminal

    d = view(spark, sf_dir, "det").where(T.terminals(F.col("label")) == "two_terminal").select(*KEY, F.explode(two_terminal(B.of())).alias("r"))
    return d.select(*KEY, F.col("r.position").alias("position"), *(F.bround(F.col("r.box")[k], 6).alias(k) for k in B.SIDES))


@query("P42 I12", """
WITH c AS (SELECT *, least(x2 - x1, y2 - y1) AS s FROM det WHERE label IN ('ic', 'connector', 'component_candidate')),
r AS (SELECT board_id, no, 'top' AS position, x1 AS x1, y1 - 0.26 * s AS y1, x2 AS x2, y1 + 0.14 * s AS y2 FROM c
  UNION ALL SELECT board_id, no, 'bottom', x1, y2 - 0.14 * s, x2, y2 + 0.26 * s FROM c UNION ALL SELECT board_id, no, 'left', x1 - 0.26 * s, y1, x1 + 0.14 * s, y2 FROM c
  UNION ALL SELECT board_id, no, 'right', x2 - 0.14 * s, y1, x2 + 0.26 * s, y2 FROM c)
SELECT board_id, no, position, round_even(x1, 6) AS x1, round_even(y1, 6) AS y1, round_even(x2, 6) AS x2, round_even(y2, 6) AS y2 FROM r""", ("det",))
def multi_pin_rois(spark, sf_dir):
    from boardsift.operators.joints import lead_bands

    d = view(spark, sf_dir, "det").where(T.terminals(F.col("label")) == "multi_pin").select(*KEY, F.explode(lead_bands(B.of())).alias("r"))
    return d.select(*KEY, F.col("r.position").alias("position"), *(F.bround(F.col("r.box")[k], 6).alias(k) for k in B.SIDES))


@query("P42 P46", """
WITH c AS (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM det WHERE label = 'pads')
SELECT board_id, no, round_even(x1 - 0.15 * w, 6) AS x1, round_even(y1 - 0.15 * h, 6) AS y1, round_even(x2 + 0.15 * w, 6) AS x2, round_even(y2 + 0.15 * h, 6) AS y2 FROM c""", ("det",))
def pad_only_rois(spark, sf_dir):
    from boardsift.operators.joints import pad

    d = view(spark, sf_dir, "det").where("label = 'pads'").select(*KEY, pad(B.of()).alias("r"))
    return d.select(*KEY, *(F.bround(F.col("r")[k], 6).alias(k) for k in B.SIDES))


@query("P44 P45 I3", """
WITH f AS (SELECT p_partkey, 700 + p_size * 40 AS w, 500 + p_size * 25 AS h FROM part),
t AS (SELECT *, CAST(least(greatest(round_even(greatest(w, h) * 0.64, 0), 640), 1280) AS INT) AS t FROM f),
s AS (SELECT *, greatest(1, CAST(ceil((w - t) / (t * 0.8)) AS INT)) AS sx, greatest(1, CAST(ceil((h - t) / (t * 0.8)) AS INT)) AS sy FROM t WHERE greatest(w, h) > 1.25 * t),
x AS (SELECT p_partkey, i, CASE WHEN w <= t THEN 0 ELSE CAST(round_even(i * (w - t) / sx, 0) AS INT) END AS x1, least(w, t) AS tw FROM (SELECT *, unnest(range(0, CASE WHEN w <= t THEN 1 ELSE sx + 1 END)) AS i FROM s)),
y AS (SELECT p_partkey, j, CASE WHEN h <= t THEN 0 ELSE CAST(round_even(j * (h - t) / sy, 0) AS INT) END AS y1, least(h, t) AS th FROM (SELECT *, unnest(range(0, CASE WHEN h <= t THEN 1 ELSE sy + 1 END)) AS j FROM s)),
xo AS (SELECT *, coalesce((lag(x1) OVER (PARTITION BY p_partkey ORDER BY i) + x1 + tw) / 2, 0) AS ox1 FROM x),
yo AS (SELECT *, coalesce((lag(y1) OVER (PARTITION BY p_partkey ORDER BY j) + y1 + th) / 2, 0) AS oy1 FROM y)
SELECT xo.p_partkey, x1, y1, x1 + tw AS x2, y1 + th AS y2, CAST(ox1 AS DOUBLE) AS own_x1, CAST(oy1 AS DOUBLE) AS own_y1 FROM xo JOIN yo ON xo.p_partkey = yo.p_partkey""")
def tile_plan(spark, sf_dir):
    from boardsift.operators.tiling import effective_tile, plan

    f = table(spark, sf_dir, "part").select("p_partkey", (F.lit(700) + F.col("p_size") * 40).alias("w"), (F.lit(500) + F.col("p_size") * 25).alias("h"))
    f = f.withColumn("t", effective_tile(F.col("w"), F.col("h"))).where(F.greatest("w", "h") > 1.25 * F.col("t"))
    tiles = f.select("p_partkey", F.explode(plan(F.col("w"), F.col("h"), F.col("t"))).alias("x"))
    return tiles.select("p_partkey", "x.x1", "x.y1", "x.x2", "x.y2", "x.own_x1", "x.own_y1")


@query("P48", """
SELECT board_id, count(*) AS parts, min(cx) AS x1, max(cx) AS x2, min(cy) AS y1, max(cy) AS y2, round_even(sqrt(pow(max(cx) - min(cx), 2) + pow(max(cy) - min(cy), 2)), 6) AS span,
  CASE WHEN count(*) = 2 THEN 'two_terminal' WHEN count(*) > 2 THEN 'multi_pin' ELSE 'class' END AS geometry
FROM cad WHERE cx < 4000 GROUP BY board_id""", ("cad",))
def cad_extent(spark, sf_dir):
    c = view(spark, sf_dir, "cad").where("cx < 4000").groupBy("board_id").agg(F.count("*").alias("parts"), F.min("cx").alias("x1"), F.max("cx").alias("x2"), F.min("cy").alias("y1"), F.max("cy").alias("y2"))
    geometry = F.when(F.col("parts") == 2, "two_terminal").when(F.col("parts") > 2, "multi_pin").otherwise("class")
    return c.select("*", F.bround(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")), 6).alias("span"), geometry.alias("geometry"))


@query("P49 P58", "SELECT board_id, no, least(greatest(floor(x1) - 3, 0), 260) AS x1, least(greatest(floor(y1) - 3, 0), 180) AS y1, least(greatest(ceil(x2) + 3, 0), 260) AS x2, least(greatest(ceil(y2) + 3, 0), 180) AS y2 FROM det", ("det",))
def slot_roi(spark, sf_dir):
    o = view(spark, sf_dir, "det").select(*KEY, B.outward(B.of()).alias("o"))
    grown = B.clamped(B.box(F.col("o.x1") - 3, F.col("o.y1") - 3, F.col("o.x2") + 3, F.col("o.y2") + 3), 260, 180)
    return o.select(*KEY, grown.alias("g")).select(*KEY, "g.*")


@query("P51", "SELECT board_id, cad_no, CONCAT('cad:', designator) AS joint_source, CONCAT('model.onnx:', sha256(designator)) AS detector, cx AS x_mm, CAST(0 AS DOUBLE) AS width_mm FROM cad WHERE cx < 4000", ("cad",))
def placement_rows(spark, sf_dir):
    c = view(spark, sf_dir, "cad").where("cx < 4000")
    return c.select("board_id", "cad_no", F.concat(F.lit("cad:"), "designator").alias("joint_source"), F.concat_ws(":", F.lit("model.onnx"), F.sha2("designator", 256)).alias("detector"), F.col("cx").alias("x_mm"), F.lit(0.0).alias("width_mm"))


@query("P54", """SELECT board_id, no, CAST(least(round_even(x1, 0), 219) AS INT) AS x1, CAST(least(round_even(y1, 0), 149) AS INT) AS y1, CAST(greatest(least(round_even(x2 * 0.5, 0), 220), least(round_even(x1, 0), 219) + 1) AS INT) AS x2, CAST(greatest(least(round_even(y2, 0), 150), least(round_even(y1, 0), 149) + 1) AS INT) AS y2, confidence AS score FROM det""", ("det",))
def record_coercion(spark, sf_dir):
    """Boxes and scores under any of their names, brought into the image."""
    from boardsift.operators.records import coerced

    d = view(spark, sf_dir, "det")
    box = F.struct("x1", "y1", (F.col("x2") * 0.5).alias("x2"), "y2")
    raw = d.select(*KEY, F.when(F.col("no") % 2 == 0, F.to_json(F.struct(box.alias("xyxy"), F.col("confidence").alias("prob")))).otherwise(F.to_json(F.struct(box.alias("bounds"), F.col("confidence").alias("score")))).alias("j"))
    return coerced(raw, "j", KEY, 220, 150)


@query("P59", """
SELECT board_id, no, CAST(class_id AS VARCHAR) || ' ' || format('{:.6f} {:.6f} {:.6f} {:.6f}', (x1 + x2) / 2 / 250, (y1 + y2) / 2 / 250, (x2 - x1) / 250, (y2 - y1) / 250) AS line FROM det WHERE x2 <= 250 AND y2 <= 250""", ("det",))
def yolo_lines(spark, sf_dir):
    from boardsift.sources.sinks import yolo_line

    return view(spark, sf_dir, "det").where("x2 <= 250 and y2 <= 250").select(*KEY, yolo_line(F.col("class_id"), B.of(), 250, 250).alias("line"))
