"""The common time window of videos with timecodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import timecode_end, timecode_frames


def timecodes(streams: DataFrame) -> DataFrame:
    """streams(video, r_frame_rate_str, n_frames, timecode) with start_frames and end_frames."""
    out = streams.withColumn("start_frames", timecode_frames("timecode", "r_frame_rate_str"))
    return out.withColumn("end_frames", timecode_end("start_frames", "n_frames"))


def window(times: DataFrame) -> DataFrame:
    """Adds start_idx and end_idx: the frames of each video within the window that all of them show.

    A video that starts last begins at 0; one that ends first stops at its last frame. Videos of another
    rate than the first one, or without an overlap, get an error instead, and the others stay.
    """
    good = times.filter("start_frames is not null")
    span = good.agg(F.max("start_frames").alias("last_start"), F.min("end_frames").alias("first_end"), F.min_by("r_frame_rate_str", "video").alias("rate"))
    out = times.join(F.broadcast(span))
    start = F.when(F.col("start_frames") == F.col("last_start"), F.lit(0).cast("long")).otherwise(F.col("last_start") - F.col("start_frames"))
    end = F.when(F.col("end_frames") == F.col("first_end"), F.col("n_frames") - 1).otherwise(F.col("first_end") - F.col("start_frames"))
    error = F.when(F.col("start_frames").isNull(), "no timecode").when(F.col("r_frame_rate_str") != F.col("rate"), "other frame rate").when(F.col("first_end") < F.col("last_start"), "no common window")
    return out.withColumn("error", error).withColumn("start_idx", F.when(error.isNull(), start)).withColumn("end_idx", F.when(error.isNull(), end)).drop("last_start", "first_end", "rate")
