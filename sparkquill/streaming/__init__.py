"""Streaming forms of the operators (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkquill.operators import codecs
from sparkquill.sources.files import missing


def document_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _marked(events: DataFrame, late: str) -> DataFrame:
    """Streams need a watermark, and that needs instants; batches stay as they are."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def encode_stream(docs: DataFrame, model: codecs.CharModel, out: str, checkpoint: str) -> StreamingQuery:
    """Encode arriving documents with a frozen model; a document that is done stays as it is."""

    def batch(rows: DataFrame, _: int) -> None:
        spark = rows.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
        there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
        todo = missing(rows, spark.read.parquet(out), ["doc_id"]) if there else rows
        codecs.arithmetic(todo.dropDuplicates(["doc_id"]), model).write.mode("append").parquet(out)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def window_bytes(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events, bytes and values by type in tumbling or sliding windows; later ones than ``late`` are dropped."""
    by = F.window("ts", length, slide) if slide else F.window("ts", length)
    return _marked(events, late).groupBy(by.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("props")).alias("n_bytes"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "n_bytes", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's events with no gap longer than ``gap`` between them."""
    out = _marked(events, late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").cast("timestamp_ntz").alias("last"))
    return out.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "last", "n")
