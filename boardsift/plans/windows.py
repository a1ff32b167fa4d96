"""Neighbour-aware queries, ranks, limits and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from boardsift.catalog import query
from boardsift.functions import boxes as B
from boardsift.operators import datasets
from boardsift.views import table, view


@query("W3 J21 D1", """
WITH r AS (SELECT doc_id, sha256(text) AS h, row_number() OVER (PARTITION BY sha256(text) ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END, doc_id) AS n FROM sample)
SELECT doc_id, n = 1 AS kept FROM r""", ("sample",))
def dedup_across_splits(spark, sf_dir):
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    return datasets.first_of_duplicates(view(spark, sf_dir, "sample"), F.sha2("text", 256), [rank, F.col("doc_id")]).select("doc_id", "kept")


@query("W4 W5", """SELECT board_id, no, format('slot_{:04d}', row_number() OVER (PARTITION BY board_id ORDER BY (y1 + y2) / 2, (x1 + x2) / 2, y1, x1, y2, x2, label, class_id, -confidence, no)) AS slot_id FROM det""", ("det",))
def recipe_slots(spark, sf_dir):
    w = W.partitionBy("board_id").orderBy(B.center_y(B.of()), B.center_x(B.of()), "y1", "x1", "y2", "x2", "label", "class_id", -F.col("confidence"), "no")
    return view(spark, sf_dir, "det").select("board_id", "no", F.format_string("slot_%04d", F.row_number().over(w)).alias("slot_id"))


@query("W6", """
WITH j AS (SELECT c.board_id, cad_no, d.no, row_number() OVER (PARTITION BY c.board_id, cad_no ORDER BY pow(cx - (x1 + x2) / 2, 2) + pow(cy - (y1 + y2) / 2, 2), d.no) AS r FROM cad c JOIN det d ON c.board_id = d.board_id
  AND pow(cx - (x1 + x2) / 2, 2) + pow(cy - (y1 + y2) / 2, 2) <= 900)
SELECT board_id, cad_no, no, CAST(r AS INT) AS place FROM j WHERE r <= 8""", ("cad",))
def nearest_eight(spark, sf_dir):
    from boardsift.operators.spatial import within

    d = view(spark, sf_dir, "det").select("board_id", "no", B.center_x(B.of()).alias("x"), B.center_y(B.of()).alias("y"))
    c = view(spark, sf_dir, "cad").select("board_id", "cad_no", F.col("cx").alias("x"), F.col("cy").alias("y"))
    j = within(c, d, "board_id", 30.0)
    return j.withColumn("place", F.row_number().over(W.partitionBy("board_id", "cad_no").orderBy("distance2", "no"))).where("place <= 8").select("board_id", "cad_no", "no", "place")


@query("W8", """
WITH f AS (SELECT board_id, no, solder_ratio >= 0.5 AS above FROM feat), c AS (SELECT *, CASE WHEN above <> coalesce(lag(above) OVER (PARTITION BY board_id ORDER BY no), NOT above) THEN 1 ELSE 0 END AS s FROM f),
g AS (SELECT *, sum(s) OVER (PARTITION BY board_id ORDER BY no) AS run FROM c)
SELECT board_id, min(no) AS start, max(no) AS stop, count(*) AS n FROM g WHERE above GROUP BY board_id, run HAVING count(*) >= 3""", ("feat",))
def pin_runs(spark, sf_dir):
    w = W.partitionBy("board_id").orderBy("no")
    f = view(spark, sf_dir, "feat").select("board_id", "no", (F.col("solder_ratio") >= 0.5).alias("above"))
    f = f.withColumn("s", F.when(F.col("above") == F.lag("above").over(w), 0).otherwise(1)).withColumn("run", F.sum("s").over(w))
    return f.where("above").groupBy("board_id", "run").agg(F.min("no").alias("start"), F.max("no").alias("stop"), F.count("*").alias("n")).where("n >= 3").drop("run")


@query("W9", """
WITH e AS (SELECT board_id, no, solder_ratio, first_value(solder_ratio) OVER (PARTITION BY board_id ORDER BY no) AS f, last_value(solder_ratio) OVER (PARTITION BY board_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM feat)
SELECT board_id, no, round_even((coalesce(lag(solder_ratio, 2) OVER w, f) + coalesce(lag(solder_ratio, 1) OVER w, f) + solder_ratio + coalesce(lead(solder_ratio, 1) OVER w, l) + coalesce(lead(solder_ratio, 2) OVER w, l)) / 5, 9) AS baseline FROM e WINDOW w AS (PARTITION BY board_id ORDER BY no)""", ("feat",))
def moving_baseline(spark, sf_dir):
    w, v = W.partitionBy("board_id").orderBy("no"), F.col("solder_ratio")
    whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first(v).over(whole), F.last(v).over(whole)
    total = F.coalesce(F.lag(v, 2).over(w), first) + F.coalesce(F.lag(v, 1).over(w), first) + v + F.coalesce(F.lead(v, 1).over(w), last) + F.coalesce(F.lead(v, 2).over(w), last)
    return view(spark, sf_dir, "feat").select("board_id", "no", F.bround(total / 5, 9).alias("baseline"))


@query("W10", """SELECT board_id, round_even(median(d), 6) AS pitch FROM (SELECT board_id, (x1 + x2) / 2 - lag((x1 + x2) / 2) OVER (PARTITION BY board_id ORDER BY (x1 + x2) / 2, no) AS d FROM det) t GROUP BY board_id""", ("det",))
def median_pitch(spark, sf_dir):
    x = B.center_x(B.of())
    d = view(spark, sf_dir, "det").select("board_id", (x - F.lag(x).over(W.partitionBy("board_id").orderBy(x, "no"))).alias("d"))
    return d.groupBy("board_id").agg(F.bround(F.median("d"), 6).alias("pitch"))


@query("W11", """SELECT conv_id, turn, last_value(CASE WHEN length(text) % 3 = 0 THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scale FROM conversations""")
def running_scale(spark, sf_dir):
    n = F.length("text")
    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.last(F.when(n % 3 == 0, n), ignorenulls=True).over(w).alias("scale"))


@query("T1", "SELECT board_id, no FROM (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY confidence DESC, no) AS r FROM det) t WHERE r <= 50", ("det",))
def topk_per_frame(spark, sf_dir):
    w = W.partitionBy("board_id").orderBy(F.desc("confidence"), "no")
    return view(spark, sf_dir, "det").withColumn("r", F.row_number().over(w)).where("r <= 50").select("board_id", "no")


@query("T4", "SELECT board_id, no AS best FROM (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY pin_index DESC, solder_ratio DESC, contrast, no) AS r FROM feat) t WHERE r = 1", ("feat",))
def best_seed(spark, sf_dir):
    return view(spark, sf_dir, "feat").groupBy("board_id").agg(F.max_by("no", F.struct("pin_index", "solder_ratio", -F.col("contrast"), -F.col("no"))).alias("best"))


@query("T2", """SELECT event_id, severity FROM (SELECT event_id, CASE event_type WHEN 'click' THEN 'error' WHEN 'view' THEN 'warning' ELSE 'info' END AS severity, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END, event_id) AS r FROM events) t WHERE r <= 6""")
def severity_topk(spark, sf_dir):
    severity = F.when(F.col("event_type") == "click", "error").when(F.col("event_type") == "view", "warning").otherwise("info")
    rank = F.when(F.col("event_type") == "click", 0).when(F.col("event_type") == "view", 1).otherwise(2)
    e = table(spark, sf_dir, "events").select("event_id", severity.alias("severity"), F.row_number().over(W.partitionBy("user_id").orderBy(rank, "event_id")).alias("r"))
    return e.where("r <= 6").drop("r")


@query("T8 T9 D12", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY raw_label ORDER BY sha256('7::' || CAST(doc_id AS VARCHAR)), doc_id) AS r FROM sample) t WHERE r <= 6", ("sample",))
def seeded_sample(spark, sf_dir):
    w = W.partitionBy("raw_label").orderBy(F.sha2(F.concat(F.lit("7::"), F.col("doc_id").cast("string")), 256), "doc_id")
    return view(spark, sf_dir, "sample").withColumn("r", F.row_number().over(w)).where("r <= 6").select("doc_id")


@query("U1 U2 U3", "SELECT origin, count(*) AS n FROM (SELECT 'full' AS origin FROM tile WHERE pass = 'full' UNION ALL SELECT 'tile' FROM tile WHERE pass = 'tile' UNION ALL SELECT 'lead' FROM det WHERE label = 'pads') t GROUP BY origin", ("tile",))
def union_passes(spark, sf_dir):
    t, d = view(spark, sf_dir, "tile"), view(spark, sf_dir, "det")
    parts = t.where("pass = 'full'").select(F.lit("full").alias("origin")).unionByName(t.where("pass = 'tile'").select(F.lit("tile").alias("origin"))).unionByName(d.where("label = 'pads'").select(F.lit("lead").alias("origin")))
    return parts.groupBy("origin").agg(F.count("*").alias("n"))


@query("U4 U5 U6", """SELECT k, bool_or(a) AS expected, bool_or(b) AS observed FROM (SELECT part_class AS k, TRUE AS a, FALSE AS b FROM cad UNION ALL SELECT label, FALSE, TRUE FROM det) t GROUP BY k""", ("cad",))
def class_key_sets(spark, sf_dir):
    a = view(spark, sf_dir, "cad").select(F.col("part_class").alias("k")).distinct().withColumn("expected", F.lit(True))
    b = view(spark, sf_dir, "det").select(F.col("label").alias("k")).distinct().withColumn("observed", F.lit(True))
    return a.join(b, "k", "full").na.fill(False)


@query("U7", "SELECT conv_id, string_agg(role, ',' ORDER BY first) AS roles FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY ALL) t GROUP BY conv_id")
def ordered_distinct(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    return c.select("conv_id", F.array_join(F.array_distinct("t.role"), ",").alias("roles"))
