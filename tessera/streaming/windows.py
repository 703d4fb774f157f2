"""Event-time aggregates; each works on a batch frame and on a stream alike."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def events_stream(spark: SparkSession, folder: str, glob: str = "events.parquet") -> DataFrame:
    """The events of a folder as a stream with event time ts."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", step: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", size, step), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """All that a stream's source holds now, run to its end: the aggregate's last state as a stored table.
    Offsets and state live below the session's checkpoint folder; only a session of a single machine may go
    without one."""
    spark = stream.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
    place = f"{root}/tessera-stream-{name}-{uuid.uuid4().hex}"

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/table")

    store(spark.createDataFrame([], stream.schema), -1)  # a source without rows runs no batch
    run = stream.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/table")


def incremental(stream: DataFrame, store: str, checkpoint: str):
    """Process only texts not seen before: each micro-batch is anti-joined with the hashes in the store
    and appended to it. The checkpoint holds the source's offsets, so a restart repeats no batch."""

    def step(batch: DataFrame, number: int) -> None:
        new = batch.withColumn("text_sha256", F.sha2("text", 256)).dropDuplicates(["text_sha256"])
        spark = batch.sparkSession
        try:
            seen = spark.read.parquet(store)
        except Exception as e:  # the first batch finds no store
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            new = new.join(seen.filter(F.col("batch") != number).select("text_sha256"), "text_sha256", "left_anti")
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store)

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
