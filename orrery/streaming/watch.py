"""Structured Streaming: files as they change, and counts per window of event time (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def watch(spark: SparkSession, root: str, reindex: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, trigger: str = "1 second") -> StreamingQuery:
    """Calls `reindex` with each batch of new or changed files (file_path, content), one row per path: the latest.

    The trigger is the debounce; the checkpoint remembers what was seen, so a restarted watch neither skips nor repeats.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root)

    def batch(df: DataFrame, n: int) -> None:
        last = df.groupBy("path").agg(F.max(F.struct("modificationTime", "content")).alias("f"))
        reindex(last.select(F.col("path").alias("file_path"), F.try_validate_utf8(F.col("f.content").cast("string")).alias("content")).where("content is not null"), n)

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)).start()


def window_counts(events: DataFrame, at: str, kind: str, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, kind, n) with a watermark, for streams and tables alike."""
    e = events.withColumn(at, F.col(at).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(at, late)
    return e.groupBy(F.window(at, width).alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "kind", "n")


def stream_table(spark: SparkSession, path: str, run: Callable[[DataFrame], DataFrame], checkpoint: str, out: str) -> DataFrame:
    """Drive a streaming query over a table's files to its end, and read its complete result."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    query = run(source).writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out)
