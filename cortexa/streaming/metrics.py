"""Metrics of a growing table of frames, kept up to date as files arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.files import upsert


def frame_retention(frames: DataFrame, keys: list[str], at: str, keep: Column, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """keys, start, n_frames, n_kept for each window of event time; frames later than ``late`` are not counted any more."""
    seen = frames.withWatermark(at, late).withColumn("kept", F.coalesce(keep, F.lit(False)))
    counts = seen.groupBy(*keys, F.window(at, window).alias("w")).agg(F.count("*").alias("n_frames"), F.count_if("kept").alias("n_kept"))
    return counts.select(*keys, F.col("w.start").alias("start"), "n_frames", "n_kept")


def keep_updated(metrics: DataFrame, path: str, keys: list[str], checkpoint: str):
    """Upsert each micro-batch's changed rows into a Parquet table; start it with ``.start()``.

    A batch that is run again after a failure upserts the same rows, so the
    table ends up the same.
    """
    return metrics.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: upsert(batch.sparkSession, path, batch, keys))
