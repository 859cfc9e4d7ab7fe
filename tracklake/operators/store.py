"""The track store: observations of clips as Parquet, partitioned by video and clip.

Long tables: observations(video_id, clip_id, t, individual, x, y, w, h, confidence), clip_time(video_id,
clip_id, t, escape_state), clips and videos. What isn't there has no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names

MODES = {"w-": "errorifexists", "w": "overwrite", "a": "append"}


def first_of_clip(clips: DataFrame, key: str = "loop_clip_name", order: list[str] | None = None) -> DataFrame:
    """Metadata with one row a clip, the first."""
    w = Window.partitionBy(key).orderBy(*(order or [c for c in clips.columns if c != key]))
    return clips.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def with_metadata(observations: DataFrame, clips: DataFrame, key: str = "loop_clip_name", check: bool = True) -> DataFrame:
    """Observations (or clips) with their clip's metadata. A clip without metadata is an error if checked."""
    if check:
        lost = observations.select(key).distinct().join(clips, key, "left_anti").limit(5).collect()
        if lost:
            raise ValueError(f"no metadata for {', '.join(str(r[0]) for r in lost)}")
    return observations.join(first_of_clip(clips, key), key)


def clip_frames(clips: DataFrame) -> DataFrame:
    """0-based frames of clips whose table counts from 1; the escape's frame is 0-based there already. escape_local counts from the clip's start."""
    return clips.select(
        "*",
        (F.col("loop_start_frame_ffmpeg") - 1).alias("clip_first_frame_0idx"),
        (F.col("loop_end_frame_ffmpeg") - 1).alias("clip_last_frame_0idx"),
        (F.col("escape_start_frame_0idx") - (F.col("loop_start_frame_ffmpeg") - 1)).alias("escape_local"),
        F.lower("escape_type").alias("clip_escape_type"),
    )


def escape_states(times: DataFrame, clips: DataFrame, keys: list[str]) -> DataFrame:
    """times(keys..., t) with 1 from the escape's start on, 0 before."""
    start = clip_frames(clips).select(*keys, "escape_local")
    return times.join(start, keys).withColumn("escape_state", (F.col("t") >= F.col("escape_local")).cast("tinyint")).drop("escape_local")


def uniform_fps(clips: DataFrame, video: str = "video") -> DataFrame:
    """The frame rate of each video; is_uniform is false where its clips have several, or none."""
    return clips.groupBy(video).agg(F.min("fps").alias("fps"), F.count_distinct("fps").alias("n_fps")).withColumn("is_uniform", F.col("n_fps") == 1)


def check_uniform_fps(clips: DataFrame, video: str = "video") -> DataFrame:
    bad = uniform_fps(clips, video).filter("not is_uniform").limit(5).collect()
    if bad:
        raise ValueError(f"clips of one video differ in fps: {', '.join(str(r[0]) for r in bad)}")
    return uniform_fps(clips, video).select(video, "fps")


def renumbered(observations: DataFrame, video: str = "video", clip: str = "clip") -> DataFrame:
    """Adds label: individuals of each clip numbered from 0 in their order, as wide as the video's largest number.

    The individuals of a clip are few; the same label in two clips isn't the same animal.
    """
    ids = observations.select(video, clip, "individual").distinct()
    ids = ids.withColumn("n", F.row_number().over(Window.partitionBy(video, clip).orderBy("individual")) - 1)
    wide = ids.groupBy(video).agg(F.length(F.max("n").cast("string")).alias("width"))
    labels = ids.join(wide, video).select(video, clip, "individual", names.individual_label("n", F.col("width")).alias("label"))
    return observations.join(labels, [video, clip, "individual"])


def concat(*tables: DataFrame) -> DataFrame:
    """Clips' tables after one another; columns that one lacks are null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def dense(observations: DataFrame, keys: list[str]) -> DataFrame:
    """A row for each time and individual of a clip, null where there is no observation."""
    t = observations.groupBy(*keys).agg(F.min("t").alias("a"), F.max("t").alias("b")).select(*keys, F.explode(F.sequence("a", "b")).alias("t"))
    grid = t.join(observations.select(*keys, "individual").distinct(), keys)
    return grid.join(observations, [*keys, "individual", "t"], "left")


def write(observations: DataFrame, path: str, mode: str = "w-", group_mode: str | None = None, keys: tuple[str, str] = ("video_id", "clip_id")) -> None:
    """Writes a store. mode: of the store; group_mode "w" replaces the videos' clips that are written, "w-" refuses clips that exist."""
    spark = observations.sparkSession
    table = observations.repartition(*keys).sortWithinPartitions(*keys, "t")
    if mode == "a" and group_mode in ("w", "w-"):
        if group_mode == "w-":
            there = read(spark, path).select(*keys).distinct()
            clash = observations.select(*keys).distinct().join(there, list(keys), "left_semi").limit(1).collect()
            if clash:
                raise ValueError(f"the store has {tuple(clash[0])} already")
            table.write.mode("append").partitionBy(*keys).parquet(path)
        else:
            table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
        return
    table.write.mode(MODES[mode]).partitionBy(*keys).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The store, lazily; filters on video_id and clip_id read only their folders."""
    return spark.read.option("basePath", path).parquet(path)
