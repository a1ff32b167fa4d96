"""Distributions, error rates and thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counted(rows: DataFrame, by: list[str], key: str) -> DataFrame:
    """Counts of a key for each group as a map in key order."""
    n = rows.groupBy(*by, key).agg(F.count("*").alias("n"))
    return n.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias("counts"))


def distribution(rows: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99, digits: int = 9) -> DataFrame:
    """For each column count, extremes, interpolated percentiles, mean and population deviation."""

    def aggs(c):
        return [
            F.count(c).alias("n"),
            F.min(c).alias("least"),
            F.bround(F.percentile(c, low), digits).alias("low"),
            F.bround(F.percentile(c, 0.5), digits).alias("median"),
            F.bround(F.percentile(c, high), digits).alias("high"),
            F.max(c).alias("most"),
            F.bround(F.avg(c), digits).alias("mean"),
            F.bround(F.stddev_pop(c), digits).alias("deviation"),
        ]

    tall = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in columns))).alias("f")).select("f.*")
    return tall.groupBy("feature").agg(*aggs("value"))


def proposal(d: DataFrame) -> DataFrame:
    """Limits that parts of accepted boards would pass."""
    low, high = F.col("low"), F.col("high")
    return d.select("feature", F.bround(F.greatest(low * 0.8, F.lit(0.0)), 4).alias("at_least"), F.bround(F.least(high * 1.1, F.lit(1.0)), 4).alias("at_most"))


def error_rates(rows: DataFrame, by: list[str], truth: Column, predicted: Column) -> DataFrame:
    """Share of defects that pass as good, and of good ones that don't."""
    escape = F.avg(F.when(truth != "good", (predicted == "good").cast("double")))
    false = F.avg(F.when(truth == "good", (predicted != "good").cast("double")))
    return rows.groupBy(*by).agg(F.bround(F.coalesce(escape, F.lit(0.0)), 9).alias("escape"), F.bround(F.coalesce(false, F.lit(0.0)), 9).alias("false_call"))


def per_class(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall and f1 of each class, from one count by pair."""
    pairs = rows.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    sides = pairs.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.lit("t").alias("side")), F.struct(F.col(predicted).alias("label"), F.lit("p").alias("side")))).alias("s"), "n", (F.col(truth) == F.col(predicted)).alias("hit"))
    sums = sides.groupBy("s.label").agg(*(F.sum(F.when((F.col("s.side") == s) & c, F.col("n")).otherwise(0)).alias(a) for a, s, c in (("support", "t", F.lit(True)), ("predicted", "p", F.lit(True)), ("hits", "t", F.col("hit")))))
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return sums.select("label", "support", F.bround(precision, 9).alias("precision"), F.bround(recall, 9).alias("recall"), F.bround(f1, 9).alias("f1"))


def sweep(rows: DataFrame, thresholds: list[float], score: str, right: str) -> DataFrame:
    """Coverage and precision of what reaches each threshold, from one count by score."""
    held = rows.groupBy(score).agg(F.count("*").alias("n"), F.sum(F.col(right).cast("long")).alias("k"))
    t = F.explode(F.array(*map(F.lit, thresholds)))
    s = held.withColumn("threshold", t).groupBy("threshold").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col(score) >= F.col("threshold"), F.col("n")).otherwise(0)).alias("taken"), F.sum(F.when(F.col(score) >= F.col("threshold"), F.col("k")).otherwise(0)).alias("good")
    )
    return s.select("threshold", F.bround(F.col("taken") / F.col("total"), 9).alias("coverage"), F.bround(F.when(F.col("taken") > 0, F.col("good") / F.col("taken")), 9).alias("precision"))


def best_threshold(swept: DataFrame, target: float) -> DataFrame:
    """The widest coverage at the wanted precision, of equals the lowest threshold."""
    return swept.where(F.col("precision") >= target).agg(F.max_by("threshold", F.struct("coverage", -F.col("threshold"))).alias("accept"), F.max("coverage").alias("coverage"))


def checkpoint_score(defect: Column, wrong: Column) -> Column:
    """Twice the share of defects that don't escape, and the share of good ones that aren't called: an aggregate."""
    escapes = F.coalesce(F.try_divide(F.count_if(defect & wrong), F.count_if(defect)), F.lit(0.0))
    false_calls = F.coalesce(F.try_divide(F.count_if(~defect & wrong), F.count_if(~defect)), F.lit(0.0))
    return 2 * (1 - escapes) + 1 - false_calls
