"""What the operators of this subpackage share: reading tables, shared storage, Arrow batches, components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import itertools
import shutil
import tempfile
import threading
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardsift.shared import shuffles_removed

#: Rows of text that a Python worker holds at once.
BATCH_ROWS = 300
#: Bytes of rows after which a batch is closed, if it has fewer rows than that.
BATCH_BYTES = 16 << 20
#: Rows that a reader of Parquet files holds at once, as texts and sets can be long; bytes that a writer holds.
READ_ROWS, WRITE_BYTES = 256, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it. Where none is named, one process (tests) takes a temporary folder; a cluster is an error."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="boardsift-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
    return context.getCheckpointDir()


def _path(spark: SparkSession, where: str):
    """The folder in the session's file systems: (file system, path)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends there, so a lost executor costs no recomputation.

    What was shuffled on the way goes at once. The driver removes the folder when it ends; `discard` and `passing` do so earlier.
    """
    spark = df.sparkSession
    where = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.option("parquet.block.size", WRITE_BYTES).parquet(where)
    files, path = _path(spark, where)
    files.deleteOnExit(path)
    back = spark.read.schema(df.schema).parquet(where)
    back.stored_at = where
    if _passing():
        _passing()[-1].append(back)
    return back


def discard(df: DataFrame) -> None:
    """Remove what `stored` wrote, once nothing reads it any more."""
    files, path = _path(df.sparkSession, df.stored_at)
    files.delete(path, True)


_OPEN = threading.local()


def _passing() -> list[list[DataFrame]]:
    """What was stored in each `passing` that this thread has open, the innermost last."""
    if not hasattr(_OPEN, "lists"):
        _OPEN.lists = []
    return _OPEN.lists


@contextmanager
def passing():
    """What is stored in here goes in the end, but for what is handed to the function that this yields."""
    own: list[DataFrame] = []
    kept: list[DataFrame] = []
    _passing().append(own)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    try:
        yield keep
    finally:
        _passing().pop()
        for df in own:
            if all(df is not k for k in kept):
                discard(df)
        if _passing():
            _passing()[-1].extend(kept)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Documents can be long: keep the batches that travel to Python workers small, in rows and in bytes.

    Plans read these settings when they run, so they stay set in the session; smaller ones of the caller's are kept.
    """
    conf = spark._jsparkSession.sessionState().conf()
    for key, now, limit in (("maxRecordsPerBatch", conf.arrowMaxRecordsPerBatch(), rows), ("maxBytesPerBatch", conf.arrowMaxBytesPerBatch(), BATCH_BYTES)):
        if not 0 < now <= limit:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(limit))
    if conf.parquetVectorizedReaderBatchSize() > READ_ROWS:
        spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well-spread bits of each key."""
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def held_out(doc_id: str = "doc_id"):
    """Documents that no model learns from: crc32 of the id as text is divisible by 5."""
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def tidy(work):
    """A function over Arrow batches after which its worker gives memory back: workers live on from stage to stage."""

    @functools.wraps(work)
    def tidied(batches):
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from work(batches)
        finally:
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return tidied


def without(docs: DataFrame, dropped: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """Documents whose (doc_id, hash of text) isn't among the dropped ones' (doc_id, key); few of them are broadcast, more are joined by shuffle."""
    dropped = stored(dropped.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")), "dropped")
    side = F.broadcast(dropped) if dropped.count() <= limit else dropped
    return docs.join(side, docs["doc_id"].eqNullSafe(F.col("_d")) & (F.xxhash64(docs["text"]) == F.col("_k")), "left_anti")


def components(nodes: DataFrame, edges: DataFrame, node: str = "id", rounds: int | None = None) -> DataFrame:
    """Smallest id reachable over undirected edges (a, b): (node, component).

    Alternating large-star and small-star steps, in which every node points its larger neighbours, then its smaller
    ones, at the smallest id it knows; the number of rounds grows with the logarithm of the longest path. Each round is
    written to the shared folder. Rounds go on until nothing changes; if `rounds` are given and don't suffice, that is an
    error. Nodes without an edge are their own component.
    """
    spark = nodes.sparkSession
    links = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before, count = None, links.count()
    least = (F.min("b").alias("m"), F.count("*").alias("copies"))

    def met(rows, low, n):
        """A node may have very many neighbours; up to `PLAIN` rows of two numbers a task holds them all with ease."""
        return spread_join(rows, low, ["a"], n, "b") if n > PLAIN else rows.join(low, "a")

    for done in itertools.count(1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(*least).withColumn("m", F.least("a", "m"))
        large = met(both, low, 2 * count).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(*least)
        small = met(large, low, count)
        older = links
        links = stored(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct(),
            "links",
        )
        discard(older)
        state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        if done == rounds:
            raise RuntimeError(f"components have not settled after {rounds} rounds")
        before, count = state, state[0]
    root = links.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", node)
    return nodes.join(root, node, "left").withColumn("component", F.coalesce("component", F.col(node)))


#: Links up to which the steps of `components` don't look for hot nodes.
PLAIN = 1_000_000

#: A key that more than this share of all rows has is hot; there are fewer than its inverse of them, so they are broadcast.
HOT_SHARE = 1e-4


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], rows: int, by: str) -> DataFrame:
    """Left join in which a hot key doesn't land in one task.

    `right` has one row a key and, in `copies`, how many of the `rows` left rows have that key. Rows of a hot key are
    dealt by a hash of the column `by` over as many numbers as would make it an ordinary one, and its right row is repeated
    for each.
    """
    share = max(1, int(rows * HOT_SHARE), 100)
    salts = F.greatest(F.ceil(F.col("copies") / share), F.lit(1)).cast("int")
    hot = right.where(F.col("copies") > share).select(*keys, salts.alias("_salts"))
    left = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.xxhash64(by), F.coalesce("_salts", F.lit(1))).cast("int")).drop("_salts")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return left.join(right, [*keys, "_salt"], "left").drop("_salt")
