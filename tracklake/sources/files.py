"""Listings of files, read by Spark's own readers, and tables of parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names

VIDEO_TYPES = ("mp4", "avi", "mov")


def listing(spark: SparkSession, location: str, glob: str = "*", recursive: bool = False) -> DataFrame:
    """path, file_name, extension (lower case), length of files, hidden ones left out, in order of paths."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).load(location)
    name = names.base_name("path")
    shown = df.select("path", "length", name.alias("file_name"), F.lower(F.substring_index(name, ".", -1)).alias("extension"))
    return shown.filter(~F.col("file_name").startswith(".")).orderBy("path")


def videos(spark: SparkSession, locations: list[str], extensions: tuple[str, ...] = VIDEO_TYPES, recursive: bool = False) -> DataFrame:
    """Video files of folders (one level deep, or all) and files, whatever the case of their extension; none is an error."""
    if isinstance(extensions, str):
        extensions = (extensions,)
    whole = None
    for place in locations:
        one = listing(spark, place, recursive=recursive)
        whole = one if whole is None else whole.unionByName(one)
    found = whole.filter(F.col("extension").isin(*(e.lower().lstrip(".") for e in extensions))).dropDuplicates(["path"]).orderBy("path")
    if found.limit(1).count() == 0:
        raise FileNotFoundError(f"no videos with extension {', '.join(extensions)} in {', '.join(locations)}")
    return found


def grouped(files: DataFrame, key: Column) -> DataFrame:
    """Files by a key of their path (a function of columns), sorted."""
    return files.groupBy(key.alias("key")).agg(F.sort_array(F.collect_list("path")).alias("paths"))


def by_stem(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted(file_name) with the path of the file of that name, whatever the case of its extension."""
    stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    ext = lambda c: F.lower(F.substring_index(c, ".", -1))
    f = files.select(stem(F.col("file_name")).alias("__s"), F.col("extension").alias("__e"), "path")
    return wanted.withColumn("__s", stem(F.col("file_name"))).withColumn("__e", ext(F.col("file_name"))).join(f, ["__s", "__e"], "left").drop("__s", "__e")


def two_levels(params: DataFrame, prefix: str) -> DataFrame:
    """params(run, params map): keys prefix/a/b as rows section a, name b, value."""
    rows = params.select("run", F.explode("params").alias("key", "value"))
    part = F.split("key", "/")
    return rows.filter((part[0] == prefix) & (F.size(part) == 3)).select("run", part[1].alias("section"), part[2].alias("name"), "value")


def nested(params: DataFrame, prefix: str) -> DataFrame:
    """The same as one map of maps for each run."""
    by_section = two_levels(params, prefix).groupBy("run", "section").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("values"))
    return by_section.groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", F.map_entries("values").alias("values"))))).alias("config"))


def argument(given: Column, params: Column, name: str, prefix: str = "cli_args") -> Column:
    """An argument as given, or as a run stored it."""
    return F.coalesce(given, F.try_element_at(params, F.lit(f"{prefix}/{name}")))


def run_of_checkpoint(path: Column) -> Column:
    """The run's id in .../run/checkpoints/file.ckpt."""
    return F.element_at(F.split(path, "/"), -3)


def stored_parameters(checkpoints: DataFrame, params: DataFrame) -> DataFrame:
    """checkpoints(path) with the parameters(run, params map) of the run that wrote each; null where the run isn't known."""
    return checkpoints.withColumn("run", run_of_checkpoint(F.col("path"))).join(params.withColumn("run", F.col("run").cast("string")), "run", "left")


CLIPS = (
    "video_parent_directory string, video_name string, loop_clip_name string, fps double, loop_START_frame_ffmpeg int, loop_END_frame_ffmpeg int, "
    "loop_START_frame_ffmpeg_PTS double, loop_END_frame_ffmpeg_PTS double, escape_START_frame_0_based_idx int, escape_type string"
)


def clip_table(spark: SparkSession, path: str) -> DataFrame:
    """The clips' metadata; columns are matched by name."""
    header = spark.read.option("header", True).csv(path)
    wanted = [f.split() for f in CLIPS.split(", ")]
    return header.select(*((F.col(n).try_cast(t) if n in header.columns else F.lit(None).cast(t)).alias(n) for n, t in wanted))


def stream_info(probes: DataFrame) -> DataFrame:
    """video, r_frame_rate, n_frames, timecode of probe results(video, probe JSON): the last video and the last timecode stream of each.

    A video without either gets nulls and an error, and doesn't touch the others.
    """
    kind = "struct<streams:array<struct<codec_type:string,codec_tag_string:string,r_frame_rate:string,nb_frames:string,tags:map<string,string>>>>"
    s = F.from_json("probe", kind)["streams"]
    video = F.try_element_at(F.filter(s, lambda x: x["codec_type"] == "video"), F.lit(-1))
    code = F.try_element_at(F.filter(s, lambda x: x["codec_tag_string"] == "tmcd"), F.lit(-1))
    out = probes.select("video", video.alias("v"), code.alias("c"))
    error = F.when(F.col("v").isNull(), "no video stream").when(F.col("c").isNull(), "no timecode stream")
    return out.select("video", F.col("v.r_frame_rate").alias("r_frame_rate_str"), F.col("v.nb_frames").try_cast("long").alias("n_frames"), F.try_element_at(F.col("c.tags"), F.lit("timecode")).alias("timecode"), error.alias("error"))
