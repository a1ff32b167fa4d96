"""Benchmark decontamination by a broadcast hash set of word windows, in DataFrame functions only.

Words are maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. An item's windows are its runs of
10 consecutive words, or all its words if it has fewer. Each position of a document is hashed once for each window
length that the benchmark has (at most 10) and probed against the set of window hashes; what hits is verified word by word
against the windows. A text is cut into words once.

The set that is broadcast holds one 64-bit hash a window, at most ``broadcast_windows`` of them; beyond that the same join
runs shuffled. Words and items of windows aren't broadcast by this module.

Defined results: null text has no words; an item without words has no window; items with equal ids count once; a null
item_id counts as the empty string; repeated documents each get a row; documents with equal doc_id are told apart by a
hash of their text; texts of any length are read whole; a window that several items hold names them all; other columns are
ignored, whatever their names; an empty benchmark leaves every document clean; no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.llm.common import table

WINDOW = 10
#: What a word is; texts are cut at its complement.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The gaps between words in a text that isn't lower-cased yet: the same words, without normalising them first.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: str):
    """A-Z in lower case: where a text is ASCII throughout, that is all that lower() changes, and it is faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(F.col(text), UPPER, LOWER))


def words(text: str):
    """Normalised words of a text column; null: none."""
    cut = F.split(lowered(text), GAP)
    first = F.when(F.get(cut, F.lit(0)) == "", 2).otherwise(1)
    rest = F.size(cut) - first + 1 - F.when((F.size(cut) > 1) & (F.get(cut, F.size(cut) - 1) == ""), 1).otherwise(0)
    return F.coalesce(F.slice(cut, first, F.greatest(rest, F.lit(0))), F.array().cast("array<string>"))


def benchmark_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows: h, w (the words), l (how many), items (sorted ids that hold it)."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words("text").alias("ws")).where(F.size("ws") > 0)
    length = F.least(F.lit(window), F.size("ws"))
    rows = rows.select("item", "ws", length.alias("l"), F.explode(F.sequence(F.lit(1), F.size("ws") - length + 1)).alias("p"))
    return rows.groupBy(F.slice("ws", F.col("p"), F.col("l")).alias("w")).agg(F.array_sort(F.collect_set("item")).alias("items")).select(
        F.xxhash64("w").alias("h"), "w", F.size("w").alias("l"), "items"
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, broadcast_windows: int = 4_000_000) -> DataFrame:
    """Per document: doc_id, key (hash of its text), n_words, n_hit, items (sorted ids of items with occurring windows), spans (hit word ranges)."""
    known = benchmark_windows(items, window)
    lengths = {r.l: r.n for r in known.groupBy("l").agg(F.count("*").alias("n")).collect()}  # at most `window` values
    base = docs.select("doc_id", F.xxhash64("text").alias("key"), words("text").alias("ws"))
    # l = 0 stands for the document itself: it carries the number of words and meets no window
    rows = base.select("*", F.explode(F.array(*map(F.lit, [0, *sorted(lengths)]))).alias("l")).where(F.size("ws") >= F.col("l"))
    rows = rows.select("doc_id", "key", "ws", "l", F.explode(F.sequence(F.lit(1), F.when(F.col("l") == 0, 1).otherwise(F.size("ws") - F.col("l") + 1))).alias("p"))
    rows = rows.select("doc_id", "key", "l", "p", F.slice("ws", F.col("p"), F.col("l")).alias("dw"), F.when(F.col("l") == 0, F.size("ws")).alias("n_words"))
    rows = rows.select("*", F.when(F.col("l") == 0, F.xxhash64("doc_id", "key")).otherwise(F.xxhash64("dw")).alias("h"))  # documents spread by themselves
    hashes = known.select(F.col("h").alias("wh"), F.lit(True).alias("met")).distinct()
    hashes = F.broadcast(hashes) if sum(lengths.values()) <= broadcast_windows else hashes
    met = rows.join(hashes, (F.col("l") > 0) & (F.col("h") == F.col("wh")), "left").where("met or l = 0")
    met = met.join(known.select(F.col("h").alias("vh"), "w", F.col("items").alias("found")), (F.col("l") > 0) & (F.col("h") == F.col("vh")) & (F.col("dw") == F.col("w")), "left")
    span = F.struct(F.col("p").alias("a"), (F.col("p") + F.col("l")).alias("b"))
    hits = met.groupBy("doc_id", "key").agg(
        F.count("n_words").alias("rows"),
        F.max("n_words").cast("long").alias("n_words"),
        F.array_sort(F.collect_set(F.when(F.col("found").isNotNull(), span))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("found")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["b"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["end"], s["a"]))).alias("n")),
        lambda acc: acc["n"],
    )
    out = hits.select("doc_id", "key", "n_words", covered.alias("n_hit"), "items", "spans", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("row"))
    return out.drop("row")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
k AS (SELECT item, ws, least(10, len(ws)) AS l, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0),
w AS (SELECT DISTINCT item, l, list_slice(ws, p, p + l - 1) AS w FROM k),
t AS (SELECT r, ws, l, unnest(range(1, len(ws) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM w) WHERE len(ws) >= l),
h AS (SELECT t.r, t.p, t.l, w.item FROM (SELECT r, l, p, list_slice(ws, p, p + l - 1) AS w FROM t) t JOIN w ON t.l = w.l AND t.w = w.w),
q AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + l)) AS x FROM h) GROUP BY r),
g AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN q USING (r) LEFT JOIN g USING (r)
"""
