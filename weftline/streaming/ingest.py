"""Documents that keep arriving: chunked as they come, known chunks left alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.config import Chunking
from weftline.operators.chunking import chunk_documents
from weftline.sources.readers import documents_from_table
from weftline.sources.stores import path_exists


def upsert_chunks(spark: SparkSession, target: str, docs: DataFrame, settings: Chunking | None = None) -> None:
    """Appends the chunks whose ids the target doesn't have; sending documents again adds nothing."""
    new = chunk_documents(docs, settings).dropDuplicates(["chunk_id"])
    if path_exists(spark, target):
        new = new.join(spark.read.parquet(target).select("chunk_id"), "chunk_id", "left_anti")
    new.write.mode("append").parquet(target)


def ingest(spark: SparkSession, landing: str, schema: str, target: str, checkpoint: str, settings: Chunking | None = None, once: bool = False) -> StreamingQuery:
    """Follows a folder of Parquet files of (doc_id, source, text) and keeps the chunks table up to date."""
    stream = spark.readStream.schema(schema).parquet(landing)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: upsert_chunks(df.sparkSession, target, documents_from_table(df), settings))
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()


def windowed_activity(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per window and kind; works on tables and, with the watermark, on streams."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def latest_per_user(events: DataFrame) -> DataFrame:
    """Each user's last event; ties to the larger id."""
    last = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return events.withColumn("r", last).where("r = 1").select("user_id", "event_id", "event_type")
