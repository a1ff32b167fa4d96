"""Files under a root: which path a name stands for, and what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def inside(path: Column) -> Column:
    """The path with `.` and `..` worked out; null where it is absolute or leaves its root."""
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))

    def step(acc, part):
        up = part == ".."
        at = F.when(up, F.slice(acc["at"], 1, F.greatest(F.size(acc["at"]) - 1, F.lit(0)))).when(part.isin("", "."), acc["at"]).otherwise(F.concat(acc["at"], F.array(part)))
        return F.struct(at.alias("at"), (acc["out"] | (up & (F.size(acc["at"]) == 0))).alias("out"))

    done = F.aggregate(F.split(path, "[/\\\\]"), start, step)
    return F.when(~path.startswith("/") & ~done["out"] & (F.size(done["at"]) > 0), F.array_join(done["at"], "/"))


def read_under(wanted: DataFrame, path: str, listing: DataFrame) -> DataFrame:
    """The wanted rows with `content` and `found`, of listed files (path, content) only."""
    files = listing.select(F.col("path").alias("_path"), "content")
    j = wanted.withColumn("_want", inside(F.col(path))).join(files, F.col("_want") == F.col("_path"), "left")
    return j.withColumn("found", F.col("_path").isNotNull()).drop("_want", "_path")


def globbed(spark: SparkSession, patterns: list[str]) -> DataFrame:
    """Path, length and content of the files that any pattern names, each once; folders stand for all in them."""
    parts = [spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select("path", "length", "content") for p in patterns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.dropDuplicates(["path"])


def resolved(wanted: DataFrame, name: str, listing: DataFrame, roots: list[str]) -> DataFrame:
    """The wanted rows with `found`: the file of that name under the first root that has it, else one of the same base name."""
    files = listing.select("path").distinct()
    base = files.groupBy(F.element_at(F.split("path", "/"), -1).alias("_base")).agg(F.min("path").alias("_other"))
    out, tried = wanted, []
    for i, root in enumerate(roots):
        side = files.select(F.col("path").alias(f"_p{i}"))
        out = out.join(side, F.concat(F.lit(f"{root}/"), F.col(name)) == F.col(f"_p{i}"), "left")
        tried.append(f"_p{i}")
    out = out.join(base, F.element_at(F.split(F.col(name), "/"), -1) == F.col("_base"), "left")
    return out.withColumn("found", F.coalesce(*tried, "_other")).drop(*tried, "_base", "_other")


def models(listing: DataFrame) -> DataFrame:
    """Model files of a listing (path, created) with the manifest beside them (the first of three names that is there), origin and kind.

    The kind is the folder under the origin; models come by kind, then active before library before archive, then newest first.
    """
    m = listing.where(F.col("path").endswith(".onnx")).select("path", "created", F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)\.onnx$", 1).alias("stem"))
    names = [F.concat("stem", F.lit(".json")), F.concat("stem", F.lit(".manifest.json")), F.lit("manifest.json")]
    for i, n in enumerate(names):
        side = listing.select(F.col("path").alias(f"_m{i}"))
        m = m.join(side, F.concat("dir", F.lit("/"), n) == F.col(f"_m{i}"), "left")
    origin, kind = F.split("path", "/")[0], F.split("path", "/")[1]
    return m.select("path", "created", origin.alias("origin"), kind.alias("kind"), F.coalesce("_m0", "_m1", "_m2").alias("manifest"))


def origin_rank(origin: Column) -> Column:
    return F.when(origin == "active", 0).when(origin == "library", 1).otherwise(2)
