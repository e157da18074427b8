"""Structured Streaming over files of events: micro-batches of files, running histograms, event-time windows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jaglet.operators.hist import bin_index
from jaglet.session import shared_dir


def read_files(spark: SparkSession, path: str, files_per_batch: int = 1, like: DataFrame | None = None) -> DataFrame:
    """Parquet files of a folder (or glob) as a stream, a few files in each micro-batch."""
    schema = (like if like is not None else spark.read.parquet(path)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over all that is there, then stop; the result is written to the shared folder and read again.

    In complete mode each micro-batch replaces the result, in append mode each adds its own part under its number, so a
    batch that runs again changes nothing.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    out = spark.read.schema(stream.schema).parquet(f"{root}/out")
    return out.select(*stream.columns)


def running_histogram(stream: DataFrame, value: Column, bins: int, low: float, high: float, by: str | None = None) -> DataFrame:
    """bin, n (and by) accumulated over the stream; state is one count for each bin."""
    keys = ["bin", *([by] if by else [])]
    binned = stream.select(bin_index(value.cast("double"), bins, low, high).alias("bin"), *([F.col(by)] if by else []))
    return drain(binned.where("bin is not null").groupBy(*keys).agg(F.count("*").alias("n")), "complete")


def windowed(stream: DataFrame, time: str, size: str, slide: str | None = None, late: str = "1 hour", keys: tuple[str, ...] = (), **aggregates: Column) -> DataFrame:
    """Aggregates of event-time windows with a watermark, final and still open ones."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    grouped = stream.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(*[a.alias(n) for n, a in aggregates.items()])
    return drain(grouped.select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), *keys, *aggregates), "complete")


def sessions(stream: DataFrame, time: str, gap: str, key: str, **aggregates: Column) -> DataFrame:
    """Aggregates of each key's sessions, which a pause of `gap` ends.

    There is no watermark: under one, Spark drops late rows of sessions in complete mode too, though all state is kept.
    """
    grouped = stream.groupBy(F.session_window(time, gap).alias("w"), key).agg(*[a.alias(n) for n, a in aggregates.items()])
    return drain(grouped.select(F.col("w.start").alias("w_start"), F.col("w.end").alias("w_end"), key, *aggregates), "complete")
