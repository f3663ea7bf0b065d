"""Streams of files: ids, deduplication across batches, exactly-once output, event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.sources.readers import with_hash_id


def read_stream(spark: SparkSession, path: str, schema: str, format: str = "parquet", **options) -> DataFrame:
    return with_hash_id(spark.readStream.format(format).schema(schema).options(**options).load(path))


def dedup_stream(df: DataFrame, keys: list[str], event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each key. With an event time, keys are forgotten after the delay, so state stays bounded."""
    if event_time:
        return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)
    return df.dropDuplicates(keys)


def ingest(df: DataFrame, out: str, checkpoint: str, steps=(), available_now: bool = True) -> StreamingQuery:
    """Run each batch through `steps` (operators or functions) and append it. A batch that is run again after a failure
    replaces what it wrote before: each has its own folder."""

    def batch(b: DataFrame, n: int) -> None:
        for s in steps:
            b = s(b)
        b.write.mode("overwrite").parquet(f"{out}/batch={n}")

    w = df.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def windowed_counts(df: DataFrame, ts: str, key: str, width: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return df.withWatermark(ts, delay).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sessions(df: DataFrame, ts: str, key: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    return df.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), key, "n")
