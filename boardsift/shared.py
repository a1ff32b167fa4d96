"""Files that all executors see: the folder that the session names, and small text files written there."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _where(spark: SparkSession, path: str):
    """(file system, path) of a path as the session's readers see it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _where(spark, f"{path}/_SUCCESS")
    return files.exists(where)


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``; one process (tests) may do without, a cluster may not."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="boardsift-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    path = f"{base}/{name}-{uuid.uuid4().hex}"
    files, where = _where(spark, path)
    files.deleteOnExit(where)
    return path


#: Whether the shuffle files of a query go when it ends, rather than when the driver's memory is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """What runs in here is written and read back, so nothing needs its shuffle files once it has run."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(rows: DataFrame, name: str) -> DataFrame:
    """Rows written once and read back, where several branches use them."""
    path = folder(rows.sparkSession, name)
    with shuffles_removed(rows.sparkSession):
        rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def bytes_file(spark: SparkSession, path: str, content: bytes) -> None:
    """One small file, from the driver."""
    files, where = _where(spark, path)
    out = files.create(where)
    out.write(content)
    out.close()


def text_files(rows: DataFrame, group: Column, order: Column, line: Column, name: str, head: str = "", tail: str = "", between: str = "\n") -> str:
    """One text file a group: head, the group's lines in order, tail. Groups are bounded by what makes them. Returns the folder."""
    path = folder(rows.sparkSession, name)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("v")))), lambda x: x["v"])
    text = F.concat(F.lit(head), F.array_join(lines, between), F.lit(tail)).alias("value")
    rows.groupBy(group.alias("file")).agg(text).write.partitionBy("file").text(path)
    return path
