"""Training samples: labels, duplicates, splits, balance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def audited(rows: DataFrame) -> DataFrame:
    """Rows of each split by the first rule they break."""
    again = F.row_number().over(W.partitionBy("split", "image", "width").orderBy("doc_id")) > 1
    reason = F.when(F.col("width") < 20, "too_narrow").when(F.col("height") > 400, "out_of_range").when(F.col("n_chars").isNull(), "not_numeric").when(again, "duplicate").otherwise("ok")
    return rows.select("split", reason.alias("reason")).groupBy("split", "reason").agg(F.count("*").alias("n"))


def mapped_labels(rows: DataFrame, ignored: DataFrame, names: DataFrame) -> DataFrame:
    """Raw labels to classes: first the ignore list, then the map; anything else stays unmapped, never guessed."""
    j = rows.join(F.broadcast(ignored.withColumn("skip", F.lit(True))), "raw", "left").join(F.broadcast(names), "raw", "left")
    return j.withColumn("status", F.when(F.col("skip"), "ignored").when(F.col("name").isNotNull(), "mapped").otherwise("unmapped"))


def first_of_duplicates(rows: DataFrame, digest: Column, order: list) -> DataFrame:
    """Which row of equal content stays."""
    return rows.withColumn("kept", F.row_number().over(W.partitionBy(digest).orderBy(*order)) == 1)


def hash_share(key: Column, seed: int = 0) -> Column:
    """A number in [0, 1] that depends on the key alone."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}::"), key.cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967295


def ranked(rows: DataFrame, digest: Column) -> DataFrame:
    """The rows with `rank`, their exact place in the order of a hex digest, without sorting them in one task.

    Rows are counted by the digest's first four digits; what comes before such a range is a sum over 65,536 counts at most,
    and within it rows are ranked on their own.
    """
    rows = rows.withColumn("_d", digest).withColumn("_p", F.substring("_d", 1, 4))
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_before"))
    own = F.row_number().over(W.partitionBy("_p").orderBy("_d"))
    return rows.join(F.broadcast(before), "_p").withColumn("rank", F.col("_before") + own).drop("_d", "_p", "_before")


def seeded(seed: int, key: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}::"), F.col(key).cast("string")), 256)


def held_groups(rows: DataFrame, group: str, share: float, seed: int = 0) -> DataFrame:
    """Whole groups held out, at least one: those with the smallest hashes."""
    groups = rows.select(group).distinct()
    n = max(1, round(groups.count() * share))
    held = ranked(groups, seeded(seed, group)).select(group, (F.col("rank") <= n).alias("held_out"))
    return rows.join(held, group)


def fingerprint(rows: DataFrame, group: str, line: Column) -> DataFrame:
    """SHA-256 of each group's lines in order, one after the other. Lines are sorted by Spark and streamed through the digest."""

    def work(batches):
        import hashlib

        import pyarrow as pa

        now, digest = None, None
        for b in batches:
            for g, x in zip(b.column("g").to_pylist(), b.column("d").to_pylist(), strict=True):
                if digest is None or g != now:
                    if digest is not None:
                        yield pa.RecordBatch.from_arrays([pa.array([now], b.schema.field("g").type), pa.array([digest.hexdigest()])], ["g", "fingerprint"])
                    now, digest = g, hashlib.sha256()
                digest.update(x.encode())
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], b.schema.field("g").type), pa.array([digest.hexdigest()])], ["g", "fingerprint"])

    kind = rows.schema[group].dataType.simpleString()
    lines = rows.select(F.col(group).alias("g"), line.alias("d")).repartition("g").sortWithinPartitions("g", "d")
    return lines.mapInArrow(work, f"g {kind}, fingerprint string").withColumnRenamed("g", group)


def class_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n"))
