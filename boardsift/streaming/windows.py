"""Streams of events: extensions beyond batch inspection. Each runs what is there and ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from boardsift import shared


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """All that the stream yields from what is there now, as a table."""
    spark = stream.sparkSession
    name = shared.folder(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{name}/out/batch={number}")

    q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{name}/state").foreachBatch(keep).start()
    q.awaitTermination()
    out = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{name}/out")
    if mode == "complete":  # each batch replaces the one before
        out = out.join(out.agg(F.max("batch").alias("batch")), "batch")
    return out.drop("batch")


def tumbling(stream: DataFrame, length: str = "1 day") -> DataFrame:
    w = F.window("ts", length)
    return stream.withWatermark("ts", "1 day").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).select(F.date_format("w.start", "yyyy-MM-dd").alias("start"), "event_type", "n", "ids")


def distinct(stream: DataFrame) -> DataFrame:
    return stream.withWatermark("ts", "1 day").dropDuplicates(["event_id"]).select("event_id", "user_id")
