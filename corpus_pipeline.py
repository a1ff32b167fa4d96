"""Training-corpus pipeline: quality filter, near-duplicates, repeated passages, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All stages but the last return the
columns of ``documents``; a row is told apart from others with its doc_id by a hash of its text.

Defined results, for all stages: null doc_id, lang, source and n_chars pass through; null text counts as empty; texts of any
length are read whole; columns beside those of ``documents`` are left out, whatever their names; an empty table gives an
empty one. What ties, repeated rows, empty and null texts come to is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.llm import decontaminate, jaccard, quality, suffixes, tokens
from boardsift.llm.common import discard, passing, stored, table, without

#: Near-duplicates share 80 % of their shingles of five words.
SHINGLE, PERCENT = 5, 80
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier rejects: score below its threshold; a score equal to it stays.

    Empty and null texts are scored like others. Repeated rows go or stay together. Without labels all scores are 0.5, so all
    stay.
    """
    docs = docs.select(*COLUMNS)
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"))
    return without(docs, scored.where(F.col("score") < quality.THRESHOLD))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group of near-duplicates: one with the smallest doc_id, or with none if no row has one.

    Rows with one doc_id and other texts are documents of their own, and so are rows without a doc_id. Of repeated rows one
    stays; of rows equal in doc_id and text any one, with its own other columns. Empty and null texts are near nothing, but
    repeated rows of them are one; among equals without a doc_id a hash of the text decides. A similarity of exactly 80 %
    is near.
    """
    docs = docs.select(*COLUMNS)
    key = F.xxhash64("text")
    rows = docs.select("doc_id", key.alias("key")).groupBy("doc_id", "key").agg(F.count("*").alias("copies"))
    several = stored(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("_several")), "several")
    side = F.broadcast(several) if several.count() <= 2_000_000 else several
    unclear = F.col("doc_id").isNull() | F.col("_several").isNotNull()
    named = lambda df, k: df.join(side, df["doc_id"] == F.col("_several"), "left").withColumn("unit", F.when(unclear, F.lit(1 << 62) + F.pmod(F.xxhash64("doc_id", k), F.lit(1 << 61))).otherwise(F.col("doc_id").cast("long")))
    with passing() as keep:
        found = jaccard.near_duplicates(named(docs, key).select(F.col("unit").alias("doc_id"), "text"), SHINGLE, PERCENT)
        groups = found.groupBy(F.col("doc_id").alias("unit")).agg(F.min("component_id").alias("component"))
        rows = keep(stored(named(rows, F.col("key")).join(groups, "unit").select("unit", "doc_id", "key", "copies", "component"), "rows"))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "unit"))
    kept = rows.groupBy("component").agg(one.alias("one")).select("one.unit")
    out = without(docs, rows.join(kept, "unit", "left_anti").unionByName(rows.where("copies > 1")))
    copied = stored(rows.join(kept, "unit", "left_semi").where("copies > 1").select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")), "copied")
    side = F.broadcast(copied) if copied.count() <= 2_000_000 else copied
    again = docs.withColumn("_t", key).join(side, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_k")), "left_semi")
    return out.unionByName(again.dropDuplicates(["doc_id", "_t"]).select(*COLUMNS))


def repeated_text_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that also occur elsewhere; a letter that a cut goes through goes whole. Documents with nothing left go.

    Empty and null texts have nothing to cut and stay, as empty ones. Rows whose texts are equal and have 200 bytes or more are
    cut in full, all of them, and so go; shorter ones stay. n_chars is counted anew.
    """
    left = suffixes.without_repeats(docs.select(*COLUMNS), ("lang", "source"), text=True).where("n_bytes = 0 or kept <> ''")
    return left.withColumnRenamed("kept", "text").withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item.

    Empty and null texts hold none. Repeated rows go or stay together. An empty benchmark drops nothing.
    """
    docs = docs.select(*COLUMNS)
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return without(docs, found.where("n_hit > 0"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and the text they decode to: a row for each row, repeated ones too; empty and null texts have no tokens."""
    return tokens.encode_texts(docs, tokens.tokenizer_file("word_bpe_49k.json"), ("doc_id", "lang", "source"))


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_text", repeated_text_stage),
    ("decontamination", decontamination_stage),
    ("tokens", token_stage),
]

#: Stages that SQL can't express: the pipeline is tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with passing() as keep:  # what a stage writes on its way goes with it, and its input, once its result is there
            docs = keep(stored(stage(spark, docs, sf_dir), name))
        if before:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
