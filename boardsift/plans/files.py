"""Parsing and export of files as columns of text."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boardsift.catalog import query
from boardsift.functions import boxes as B
from boardsift.functions import text as T
from boardsift.sources import readers, sinks
from boardsift.views import table, view


@query("S6 W11", """
WITH t AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN 'P  UNITS CUST ' || (conv_id % 3) ELSE '317NET' || lpad(CAST(turn AS VARCHAR), 11, '0') || '   R' || (turn + 1) || '   -' || (turn % 4) || '     A01X+0' || (turn * 100) || 'Y-0' || (conv_id % 1000) END AS v FROM conversations),
u AS (SELECT *, last_value(CASE regexp_extract(v, '^P\\s+UNITS\\s+CUST\\s+(\\d)', 1) WHEN '0' THEN 0.00254 WHEN '1' THEN 0.001 WHEN '2' THEN 0.00254 END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM t)
SELECT conv_id, turn, regexp_extract(v, '([A-Za-z]+\\d+)\\s*-\\s*(\\w+)', 1) AS designator, round_even(CAST(regexp_extract(v, 'X([+-]\\d+)Y', 1) AS DOUBLE) * s, 9) AS x, round_even(CAST(regexp_extract(v, 'Y([+-]\\d+)', 1) AS DOUBLE) * s, 9) AS y FROM u WHERE v LIKE '317%'""")
def ipc356_parse(spark, sf_dir):
    v = F.when(F.col("turn") == 0, F.concat(F.lit("P  UNITS CUST "), (F.col("conv_id") % 3).cast("string"))).otherwise(
        F.concat(F.lit("317NET"), F.lpad(F.col("turn").cast("string"), 11, "0"), F.lit("   R"), (F.col("turn") + 1).cast("string"), F.lit("   -"), (F.col("turn") % 4).cast("string"), F.lit("     A01X+0"), (F.col("turn") * 100).cast("string"), F.lit("Y-0"), (F.col("conv_id") % 1000).cast("string"))
    )
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", v.alias("value"))
    unit = F.regexp_extract("value", r"^P\s+UNITS\s+CUST\s+(\d)", 1)
    s = F.last(F.when(unit == "1", 0.001).when(unit.isin("0", "2"), 0.00254), True).over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0))
    r = t.withColumn("s", s).where("value like '317%'")
    xy = [F.bround(F.regexp_extract("value", p, 1).cast("double") * F.col("s"), 9) for p in (r"X([+-]\d+)Y", r"Y([+-]\d+)")]
    return r.select("conv_id", "turn", F.regexp_extract("value", r"([A-Za-z]+\d+)\s*-\s*(\w+)", 1).alias("designator"), xy[0].alias("x"), xy[1].alias("y"))


@query("S9 W3 P29", """
WITH e AS (SELECT o_orderkey AS line, unnest(['R' || (o_custkey % 400), 'c' || (o_orderkey % 300)]) AS d, unnest([0, 1]) AS place FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY upper(d) ORDER BY line, place) AS n, first_value(line) OVER (PARTITION BY upper(d) ORDER BY line, place) AS first FROM e)
SELECT line, d AS designator, n = 1 AS kept, first AS first_line, CASE WHEN starts_with(d, 'R') THEN 'resistor' ELSE 'capacitor' END AS part_class FROM r""")
def bom_expand_dedup(spark, sf_dir):
    cell = F.concat(F.lit("R"), (F.col("o_custkey") % 400).cast("string"), F.lit("; c"), (F.col("o_orderkey") % 300).cast("string"))
    d = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("line"), F.posexplode(T.designators(cell)).alias("place", "designator"))
    w = W.partitionBy(F.upper("designator")).orderBy("line", "place")
    return d.select("line", "designator", (F.row_number().over(w) == 1).alias("kept"), F.first("line").over(w).alias("first_line"), T.part_class(F.col("designator")).alias("part_class"))


HEAD = """CASE doc_id % 6 WHEN 0 THEN '{"images": [], "annotations": []}' WHEN 1 THEN '{"shapes": []}' WHEN 2 THEN '3 0.5 0.5 0.1 0.2' WHEN 3 THEN 'crop_path,label' ELSE '' END"""
PATH = "CONCAT(source, '/', CASE doc_id % 6 WHEN 0 THEN CASE WHEN doc_id % 36 = 0 THEN 'a.json' ELSE 'x.dat' END WHEN 1 THEN CASE WHEN doc_id % 24 = 1 THEN 'b.json' ELSE 'x.dat' END WHEN 2 THEN 'c.txt' WHEN 3 THEN 'd.csv' WHEN 4 THEN 'good/e.png' ELSE 'f.md' END)"


@query("S11", f"""
SELECT source AS root, CASE max(k) WHEN 5 THEN 'coco' WHEN 4 THEN 'labelme' WHEN 3 THEN 'yolo' WHEN 2 THEN 'csv' WHEN 1 THEN 'folder_per_class' ELSE 'unknown' END AS layout FROM (
  SELECT source, CASE WHEN path LIKE '%.json' AND head LIKE '%"annotations"%' THEN 5 WHEN path LIKE '%.json' AND head LIKE '%"shapes"%' THEN 4 WHEN path LIKE '%.txt' THEN 3 WHEN path LIKE '%.csv' THEN 2 WHEN path LIKE '%.png' THEN 1 ELSE 0 END AS k
  FROM (SELECT source, {PATH} AS path, {HEAD} AS head FROM documents) f) t GROUP BY source""")
def dataset_layout(spark, sf_dir):
    return readers.layout(table(spark, sf_dir, "documents").select(F.expr(PATH).alias("path"), F.expr(HEAD).alias("head")))


@query("K6", """SELECT c_custkey, CASE WHEN regexp_matches(v, '^[=+\\-@\\t\\r]') THEN '''' || v ELSE v END AS cell FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '=1+1' WHEN 1 THEN '-' || c_name WHEN 2 THEN '@x' ELSE c_name END AS v FROM customer) t""")
def csv_formula_guard(spark, sf_dir):
    n = F.col("c_custkey") % 5
    v = F.when(n == 0, "=1+1").when(n == 1, F.concat(F.lit("-"), "c_name")).when(n == 2, "@x").otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.guarded_cell(v).alias("cell"))


@query("K1", """SELECT board_id, '{"board_id":' || board_id || ',"boxes":' || count(*) || ',"labels":[' || string_agg(DISTINCT '"' || label || '"', ',' ORDER BY '"' || label || '"') || ']}' AS manifest FROM det GROUP BY board_id""", ("det",))
def run_manifest(spark, sf_dir):
    d = view(spark, sf_dir, "det").groupBy("board_id").agg(F.count("*").alias("boxes"), F.array_sort(F.collect_set("label")).alias("labels"))
    return d.select("board_id", F.to_json(F.struct("board_id", "boxes", "labels")).alias("manifest"))


@query("K9", "SELECT board_id, no, 'crops/' || board_id || '/' || lpad(CAST(no AS VARCHAR), 4, '0') || '.png' AS crop_path, '' AS label FROM det", ("det",))
def export_sheet(spark, sf_dir):
    return view(spark, sf_dir, "det").select("board_id", "no", F.format_string("crops/%d/%04d.png", "board_id", "no").alias("crop_path"), F.lit("").alias("label"))


@query("S15", "SELECT doc_id, coalesce(nullif(trim(CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE source END), ''), 'img_' || (doc_id % 300)) AS grp, raw_label FROM sample WHERE nullif(trim(raw_label), '') IS NOT NULL", ("sample",))
def label_rows(spark, sf_dir):
    s = view(spark, sf_dir, "sample").where(F.nullif(F.trim("raw_label"), F.lit("")).isNotNull())
    return s.select("doc_id", F.coalesce(F.nullif(F.trim(F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.col("source"))), F.lit("")), "image").alias("grp"), "raw_label")


@query("K2")
def board_bundles(spark, sf_dir):
    d = view(spark, sf_dir, "det").select("board_id", F.format_string("crop_%04d.txt", "no").alias("name"), sinks.yolo_line(F.col("class_id"), B.of(), 250, 250).alias("content"))
    return sinks.bundles(d, "board_id", "name", "content").select("board_id", "files", F.sha2("archive", 256).alias("sha256"))
