"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardsift.catalog import query
from boardsift.functions import boxes as B
from boardsift.operators import datasets, gates, metrics
from boardsift.plans.rules import MODEL, RULED, features
from boardsift.views import view


@query("A1 K1", "SELECT board_id, string_agg(label || '=' || n, ',' ORDER BY label) AS counts FROM (SELECT board_id, label, count(*) AS n FROM det GROUP BY ALL) t GROUP BY board_id", ("det",))
def label_counts(spark, sf_dir):
    c = metrics.counted(view(spark, sf_dir, "det"), ["board_id"], "label")
    return c.select("board_id", F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))


@query("A3", """SELECT c.board_id, count(*) FILTER (d.no IS NULL OR cx > 4000) AS missing, count(*) FILTER (cad_no % 7 = 0) AS shifted, count(*) FILTER (part_class <> label AND part_class <> 'unknown') AS class_mismatch
FROM cad c LEFT JOIN det d ON c.board_id = d.board_id AND cad_no = no GROUP BY c.board_id""", ("cad",))
def finding_counts(spark, sf_dir):
    j = view(spark, sf_dir, "cad").join(view(spark, sf_dir, "det").select("board_id", F.col("no").alias("cad_no"), "label"), ["board_id", "cad_no"], "left")
    c = F.col
    return j.groupBy("board_id").agg(F.count_if(c("label").isNull() | (c("cx") > 4000)).alias("missing"), F.count_if(c("cad_no") % 7 == 0).alias("shifted"), F.count_if((c("part_class") != c("label")) & (c("part_class") != "unknown")).alias("class_mismatch"))


LABEL = "trim(regexp_replace(lower(raw_label), '[^a-z0-9]+', '_', 'g'), '_')"


@query("A4 A5 U1", f"SELECT source, label, count(*) AS n, count(DISTINCT image) AS groups FROM (SELECT *, {LABEL} AS label FROM sample) t GROUP BY GROUPING SETS ((source), (label), (label, source), ())", ("sample",))
def source_class_cube(spark, sf_dir):
    from boardsift.functions.text import plain_label

    s = view(spark, sf_dir, "sample").withColumn("label", plain_label(F.col("raw_label")))
    return s.groupingSets([["source"], ["label"], ["label", "source"], []], "source", "label").agg(F.count("*").alias("n"), F.countDistinct("image").alias("groups"))


@query("A6 A28", """
WITH t(label) AS (VALUES ('en'), ('de'), ('fr'), ('es'), ('it'), ('en_toxic'), ('xx')),
c AS (SELECT trim(regexp_replace(lower(raw_label), '[^a-z0-9]+', '_', 'g'), '_') AS label, count(*) AS n, count(DISTINCT source) AS sources FROM sample GROUP BY 1)
SELECT t.label, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n < 30 THEN 'thin' ELSE 'covered' END AS status, coalesce(sources, 0) = 1 AS single_source FROM t LEFT JOIN c ON t.label = c.label""", ("sample",))
def coverage_report(spark, sf_dir):
    from boardsift.functions.text import plain_label

    s = view(spark, sf_dir, "sample").groupBy(plain_label(F.col("raw_label")).alias("label")).agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))
    names = spark.createDataFrame([(x,) for x in ("en", "de", "fr", "es", "it", "en_toxic", "xx")], "label string")
    j = names.join(s, "label", "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") < 30, "thin").otherwise("covered")
    return j.select("label", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"), (F.coalesce("sources", F.lit(0)) == 1).alias("single_source"))


MEASURES = ["solder_ratio", "span_ratio", "specular_ratio", "contrast", "centroid_offset_ratio", "edge_contact_start"]
TALL = "WITH t AS (" + " UNION ALL ".join(f"SELECT '{m}' AS feature, {m} AS value FROM feat" for m in MEASURES) + """),
s AS (SELECT feature, count(value) AS n, min(value) AS least, round_even(quantile_cont(value, 0.01), 9) AS low, round_even(quantile_cont(value, 0.5), 9) AS median, round_even(quantile_cont(value, 0.99), 9) AS high,
  max(value) AS most, round_even(avg(value), 9) AS mean, round_even(stddev_pop(value), 9) AS deviation FROM t GROUP BY feature) """


@query("A7", TALL + "SELECT * FROM s", ("feat",))
def feature_percentiles(spark, sf_dir):
    return metrics.distribution(view(spark, sf_dir, "feat"), MEASURES)


@query("A8", TALL + "SELECT feature, round_even(greatest(low * 0.8, 0), 4) AS at_least, round_even(least(high * 1.1, 1), 4) AS at_most FROM s", ("feat",))
def threshold_proposal(spark, sf_dir):
    return metrics.proposal(metrics.distribution(view(spark, sf_dir, "feat"), MEASURES))


@query("A9", """SELECT board_id, count(*) AS n, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, round_even(avg(confidence), 9) AS mean, round_even(stddev_pop(confidence), 9) AS deviation FROM det GROUP BY board_id""", ("det",))
def ab_summary(spark, sf_dir):
    return view(spark, sf_dir, "det").groupBy("board_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.bround(F.avg("confidence"), 9).alias("mean"), F.bround(F.stddev_pop("confidence"), 9).alias("deviation"))


PRED = RULED + f", pr AS (SELECT board_id, no, rule_label AS truth, coalesce(ml, 'good') AS predicted, model_probability AS p FROM fl WHERE kind = 'joint') "


def predictions(spark, sf_dir):
    from boardsift.operators import grading

    g = grading.graded(features(spark, sf_dir).withColumns({}))
    m = view(spark, sf_dir, "feat").select("board_id", "no", F.coalesce(F.expr(MODEL), F.lit("good")).alias("predicted"), F.col("model_probability").alias("p"))
    return g.where("kind = 'joint'").select("board_id", "no", F.col("rule_label").alias("truth")).join(m, ["board_id", "no"])


@query("A10", PRED + "SELECT board_id, round_even(coalesce(avg(CASE WHEN truth <> 'good' THEN CAST(predicted = 'good' AS INT) END), 0), 9) AS escape, round_even(coalesce(avg(CASE WHEN truth = 'good' THEN CAST(predicted <> 'good' AS INT) END), 0), 9) AS false_call FROM pr GROUP BY board_id", ("feat",))
def escape_false_call(spark, sf_dir):
    return metrics.error_rates(predictions(spark, sf_dir), ["board_id"], F.col("truth"), F.col("predicted"))


@query("A11", PRED + "SELECT truth, count(*) FILTER (predicted = 'good') AS good, count(*) FILTER (predicted = 'missing_solder') AS missing_solder, count(*) FILTER (predicted = 'excess_solder') AS excess_solder FROM pr GROUP BY truth", ("feat",))
def confusion_matrix(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("truth").pivot("predicted", ["good", "missing_solder", "excess_solder"]).count().na.fill(0)


@query("A12", PRED + """, l AS (SELECT truth AS label FROM pr UNION SELECT predicted FROM pr),
c AS (SELECT label, (SELECT count(*) FROM pr WHERE truth = label) AS support, (SELECT count(*) FROM pr WHERE predicted = label) AS pn, (SELECT count(*) FROM pr WHERE predicted = label AND truth = label) AS hits FROM l),
q AS (SELECT label, support, CASE WHEN pn > 0 THEN hits / pn ELSE 0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r FROM c)
SELECT label, support, round_even(p, 9) AS precision, round_even(r, 9) AS recall, round_even(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM q""", ("feat",))
def per_class_metrics(spark, sf_dir):
    return metrics.per_class(predictions(spark, sf_dir), "truth", "predicted")


SWEEP = PRED + """, th AS (SELECT unnest([0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95])::DOUBLE AS threshold),
sw AS (SELECT threshold, round_even(count(*) FILTER (p >= threshold) / count(*), 9) AS coverage, round_even(count(*) FILTER (p >= threshold AND truth = predicted) / nullif(count(*) FILTER (p >= threshold), 0), 9) AS precision FROM pr, th GROUP BY threshold) """
THRESHOLDS = [0.5, 0.6, 0.7, 0.8, 0.85, 0.9, 0.95]


def swept(spark, sf_dir):
    return metrics.sweep(predictions(spark, sf_dir).withColumn("right", F.col("truth") == F.col("predicted")), THRESHOLDS, "p", "right")


@query("A13", SWEEP + "SELECT * FROM sw", ("feat",))
def threshold_sweep(spark, sf_dir):
    return swept(spark, sf_dir)


@query("A14", SWEEP + "SELECT (SELECT threshold FROM sw WHERE precision >= 0.1 ORDER BY coverage DESC, threshold LIMIT 1) AS accept, (SELECT max(coverage) FROM sw WHERE precision >= 0.1) AS coverage", ("feat",))
def accept_threshold(spark, sf_dir):
    return metrics.best_threshold(swept(spark, sf_dir), 0.1)


@query("A15", """
WITH g AS (SELECT 0.5 + 0.05 * unnest(range(0, 51)) AS t), l AS (SELECT board_id, no, max(z) AS top, max(z) FILTER (k = no % 5) AS own, list(z) AS zs FROM logit GROUP BY ALL),
n AS (SELECT CAST(t AS DOUBLE) AS t, avg(-ln(greatest(exp((own - top) / t) / list_sum(list_transform(zs, lambda z : exp((z - top) / t))), 1e-12))) AS nll FROM l, g GROUP BY t)
SELECT round_even((SELECT t FROM n ORDER BY nll, t LIMIT 1), 2) AS temperature, round_even(min(nll), 6) AS nll FROM n""", ("logit",))
def temperature_grid(spark, sf_dir):
    from boardsift.plans.scalars import logits

    z = logits(spark, sf_dir)
    t = F.explode(F.transform(F.sequence(F.lit(0), F.lit(50)), lambda i: F.lit(0.5) + F.lit(0.05) * i))
    z = z.withColumn("t", t).withColumn("top", F.array_max("z"))
    p = F.exp((F.element_at("z", (F.col("no") % 5 + 1).cast("int")) - F.col("top")) / F.col("t")) / F.aggregate(F.transform("z", lambda x: F.exp((x - F.col("top")) / F.col("t"))), F.lit(0.0), lambda a, x: a + x)
    n = z.groupBy("t").agg(F.avg(-F.log(F.greatest(p, F.lit(1e-12)))).alias("nll"))
    return n.agg(F.bround(F.min_by("t", F.struct("nll", "t")), 2).alias("temperature"), F.bround(F.min("nll"), 6).alias("nll"))


@query("A16 D6", """
WITH c AS (SELECT label, count(*) AS n FROM det GROUP BY label), w AS (SELECT *, least(sqrt(max(n) OVER () / n), 3) AS r, sum(n) OVER () AS total, count(*) OVER () AS k FROM c)
SELECT label, n, round_even(total / (k * n), 9) AS balanced, round_even(r / avg(r) OVER (), 9) AS soft, round_even(1.0 / n, 12) AS sampler FROM w""", ("det",))
def class_weights(spark, sf_dir):
    c = datasets.class_counts(view(spark, sf_dir, "det"), "label")
    t = c.agg(F.sum("n").alias("total"), F.count("*").alias("k"), F.max("n").alias("most"))
    c = c.join(F.broadcast(t)).withColumn("r", F.least(F.sqrt(F.col("most") / F.col("n")), F.lit(3.0)))
    m = c.agg(F.avg("r").alias("mean"))
    return c.join(F.broadcast(m)).select("label", "n", F.bround(F.col("total") / (F.col("k") * F.col("n")), 9).alias("balanced"), F.bround(F.col("r") / F.col("mean"), 9).alias("soft"), F.bround(1.0 / F.col("n"), 12).alias("sampler"))


@query("A17 D8", "SELECT raw_label, count(*) AS n FROM sample GROUP BY raw_label HAVING count(*) >= 20", ("sample",))
def class_eligibility(spark, sf_dir):
    return view(spark, sf_dir, "sample").groupBy("raw_label").agg(F.count("*").alias("n")).where("n >= 20")


@query("A18", "SELECT raw_label, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test FROM sample GROUP BY raw_label", ("sample",))
def split_pivot(spark, sf_dir):
    return view(spark, sf_dir, "sample").groupBy("raw_label").pivot("split", ["train", "val", "test"]).count().na.fill(0)


@query("A19 A27", """SELECT split, count(*) AS n, round_even(avg(CAST(quality IS NULL AS INT)), 6) AS missing, round_even(quantile_cont(width * height, 0.1), 4) AS p10, round_even(quantile_cont(width * height, 0.5), 4) AS p50, round_even(quantile_cont(width * height, 0.9), 4) AS p90,
  count(*) FILTER (least(width, height) < 8) AS tiny FROM sample GROUP BY split""", ("sample",))
def split_audit(spark, sf_dir):
    area = F.col("width") * F.col("height")
    pct = [F.bround(F.percentile(area, p), 4).alias(f"p{int(100 * p)}") for p in (0.1, 0.5, 0.9)]
    return view(spark, sf_dir, "sample").groupBy("split").agg(F.count("*").alias("n"), F.bround(F.avg(F.col("quality").isNull().cast("double")), 6).alias("missing"), *pct, F.count_if(F.least("width", "height") < 8).alias("tiny"))


@query("A27", "SELECT boxes, count(*) AS boards FROM (SELECT board_id, count(*) FILTER (label = 'pads') AS boxes FROM det GROUP BY board_id) t GROUP BY boxes", ("det",))
def boxes_histogram(spark, sf_dir):
    return view(spark, sf_dir, "det").groupBy("board_id").agg(F.count_if(gates.is_lead(F.col("label"))).alias("boxes")).groupBy("boxes").agg(F.count("*").alias("boards"))


@query("A21", """SELECT c.board_id, round_even(sqrt(avg(pow(cx - (x1 + x2) / 2, 2) + pow(cy - (y1 + y2) / 2, 2))), 6) AS rms FROM cad c JOIN det d ON c.board_id = d.board_id AND cad_no = no WHERE cx < 4000 GROUP BY c.board_id""", ("cad",))
def residual_rms(spark, sf_dir):
    j = view(spark, sf_dir, "cad").where("cx < 4000").join(view(spark, sf_dir, "det").withColumnRenamed("no", "cad_no"), ["board_id", "cad_no"])
    e = F.pow(F.col("cx") - B.center_x(B.of()), 2) + F.pow(F.col("cy") - B.center_y(B.of()), 2)
    return j.groupBy("board_id").agg(F.bround(F.sqrt(F.avg(e)), 6).alias("rms"))


@query("A23", """SELECT board_id, count(*) AS raw, count(*) FILTER (pass = 'full') AS full_image, count(*) FILTER (pass = 'tile') AS tiled, count(DISTINCT tile_id) AS tiles FROM tile GROUP BY board_id""", ("tile",))
def tiling_metrics(spark, sf_dir):
    return view(spark, sf_dir, "tile").groupBy("board_id").agg(F.count("*").alias("raw"), F.count_if(F.col("pass") == "full").alias("full_image"), F.count_if(F.col("pass") == "tile").alias("tiled"), F.countDistinct("tile_id").alias("tiles"))


@query("A26 T2", "SELECT label, n, CAST(row_number() OVER (ORDER BY n DESC, label) AS INT) AS place FROM (SELECT label, count(*) AS n FROM det GROUP BY label) t", ("det",))
def frequency_order(spark, sf_dir):
    from pyspark.sql import Window as W

    return view(spark, sf_dir, "det").groupBy("label").agg(F.count("*").alias("n")).select("*", F.row_number().over(W.orderBy(F.desc("n"), "label")).alias("place"))  # a row a class


@query("J14 G10", """
WITH e AS (SELECT board_id, part_class AS k, count(*) AS want FROM cad WHERE part_class <> 'unknown' GROUP BY ALL), o AS (SELECT board_id, label AS k, count(*) AS got FROM det WHERE label <> 'component_candidate' GROUP BY ALL)
SELECT coalesce(e.board_id, o.board_id) AS board_id, coalesce(e.k, o.k) AS part_class, coalesce(want, 0) AS want, coalesce(got, 0) AS got, CASE WHEN coalesce(got, 0) < coalesce(want, 0) THEN 'missing' ELSE 'unexpected' END AS kind
FROM e FULL JOIN o ON e.board_id = o.board_id AND e.k = o.k WHERE coalesce(want, 0) <> coalesce(got, 0)""", ("cad",))
def bom_count_reconcile(spark, sf_dir):
    from boardsift.operators.reconcile import by_count

    return by_count(view(spark, sf_dir, "cad"), view(spark, sf_dir, "det"))
