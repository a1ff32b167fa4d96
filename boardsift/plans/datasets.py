"""Preparation of training samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardsift.catalog import query
from boardsift.operators import datasets
from boardsift.views import table, view

SHARE = "CAST('0x' || substr(sha256('{seed}::' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295"


@query("D2", f"SELECT doc_id, round_even({SHARE.format(seed=0, key='doc_id')}, 9) AS share, {SHARE.format(seed=0, key='doc_id')} < 0.5 AS calibration FROM documents")
def hash_split(spark, sf_dir):
    share = datasets.hash_share(F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", F.bround(share, 9).alias("share"), (share < 0.5).alias("calibration"))


@query("D3 D4", """
WITH g AS (SELECT DISTINCT source || '/' || image AS g FROM sample), r AS (SELECT g, row_number() OVER (ORDER BY sha256('0::' || g)) AS n, count(*) OVER () AS k FROM g)
SELECT doc_id, source || '/' || image AS g, r.n <= greatest(1, round_even(k * 0.2, 0)) AS held_out FROM sample JOIN r ON source || '/' || image = r.g""", ("sample",))
def group_split(spark, sf_dir):
    s = view(spark, sf_dir, "sample").select("doc_id", F.concat_ws("/", "source", "image").alias("g"))
    return datasets.held_groups(s, "g", 0.2)


@query("D5 U6", """
WITH c AS (SELECT raw_label, count(*) AS n FROM sample GROUP BY raw_label), t AS (SELECT sum(n) AS total FROM c),
k AS (SELECT raw_label, CASE WHEN n < 30 THEN greatest(1, least(4, CAST(floor(0.35 * total / n) AS INT))) ELSE 1 END AS k FROM c, t)
SELECT doc_id, unnest(range(1, k + 1)) AS copy FROM sample s JOIN k ON s.raw_label = k.raw_label""", ("sample",))
def oversample(spark, sf_dir):
    s = view(spark, sf_dir, "sample")
    c = datasets.class_counts(s, "raw_label")
    c = c.join(F.broadcast(c.agg(F.sum("n").alias("total"))))
    k = F.when(F.col("n") < 30, F.greatest(F.lit(1), F.least(F.lit(4), F.floor(F.lit(0.35) * F.col("total") / F.col("n")).cast("int")))).otherwise(1)
    return s.join(F.broadcast(c.select("raw_label", k.alias("k"))), "raw_label").select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k").cast("long"))).alias("copy"))


@query("D7 P14", """
WITH u AS (SELECT DISTINCT board_id, label, x1, y1, x2, y2 FROM det WHERE label <> 'component_candidate'), p AS (SELECT *, 0.15 * greatest(x2 - x1, y2 - y1) AS m FROM u)
SELECT board_id, CASE WHEN label IN ('pads') THEN 'land' ELSE label END AS family, greatest(x1 - m, 0) AS x1, greatest(y1 - m, 0) AS y1, least(x2 + m, 260) AS x2, least(y2 + m, 180) AS y2 FROM p""", ("det",))
def crop_manifest(spark, sf_dir):
    from boardsift.functions import boxes as B

    u = view(spark, sf_dir, "det").where("label <> 'component_candidate'").select("board_id", "label", *B.SIDES).distinct()
    m = F.lit(0.15) * F.greatest(B.width(B.of()), B.height(B.of()))
    b = B.clamped(B.box(F.col("x1") - m, F.col("y1") - m, F.col("x2") + m, F.col("y2") + m), 260, 180)
    return u.select("board_id", F.when(F.col("label") == "pads", "land").otherwise(F.col("label")).alias("family"), b.alias("b")).select("board_id", "family", "b.*")


@query("D9", "SELECT split, sha256(string_agg(d, '' ORDER BY d)) AS fingerprint FROM (SELECT split, sha256(text) || ':' || CAST(n_chars AS VARCHAR) AS d FROM sample) t GROUP BY split", ("sample",))
def dataset_fingerprint(spark, sf_dir):
    return datasets.fingerprint(view(spark, sf_dir, "sample"), "split", F.concat_ws(":", F.sha2("text", 256), F.col("n_chars").cast("string")))


@query("D13", """
WITH b AS (SELECT DISTINCT board_id FROM det), r AS (SELECT board_id, row_number() OVER (ORDER BY sha256('3::' || CAST(board_id AS VARCHAR))) AS n, count(*) OVER () AS k FROM b)
SELECT board_id, CASE WHEN n <= greatest(1, round_even(k * 0.15, 0)) THEN 'val' WHEN n <= 2 * greatest(1, round_even(k * 0.15, 0)) THEN 'test' ELSE 'train' END AS split FROM r""", ("det",))
def board_split(spark, sf_dir):
    b = view(spark, sf_dir, "det").select("board_id").distinct()
    n = b.count()
    part = max(1, round(n * 0.15))
    r = F.col("rank")
    return datasets.ranked(b, datasets.seeded(3, "board_id")).select("board_id", F.when(r <= part, "val").when(r <= 2 * part, "test").otherwise("train").alias("split"))


@query("D12", """
WITH b AS (SELECT board_id, count(*) FILTER (label = 'pads') AS pads FROM det GROUP BY board_id), p AS (SELECT count(*) AS n FROM b WHERE pads >= 20),
r AS (SELECT board_id, row_number() OVER (ORDER BY sha256('5::' || CAST(board_id AS VARCHAR))) AS n FROM b WHERE pads < 20)
SELECT r.board_id FROM r, p WHERE r.n <= floor(0.25 * p.n)""", ("det",))
def negative_cap(spark, sf_dir):
    from boardsift.operators import gates

    b = view(spark, sf_dir, "det").groupBy("board_id").agg(F.count_if(gates.is_lead(F.col("label"))).alias("pads"))
    n = b.where("pads >= 20").count()
    return datasets.ranked(b.where("pads < 20").select("board_id"), datasets.seeded(5, "board_id")).where(F.col("rank") <= int(0.25 * n)).select("board_id")
