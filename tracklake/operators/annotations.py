"""Work on annotation rows: duplicates, excluded images, merged selections."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def dedupe(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row, in a total order, of those with the same parsed key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def exclude(rows: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows of images that aren't excluded."""
    return rows.join(excluded.select(key).distinct(), key, "left_anti")


def selections(videos: DataFrame, frames: DataFrame, video: str = "video") -> DataFrame:
    """Each video with its sorted frames, an empty list where none was selected."""
    listed = frames.groupBy(video).agg(F.sort_array(F.collect_set("frame")).alias("frames"))
    return videos.select(video).distinct().join(listed, video, "left").withColumn("frames", F.coalesce("frames", F.array().cast("array<int>")))


def merged(old: DataFrame, new: DataFrame, key: str = "video", value: str = "frames") -> DataFrame:
    """Both maps as rows; the new value where both have a key."""
    n = new.select(key, F.col(value).alias("__new"), F.lit(True).alias("__is"))
    return old.join(n, key, "full_outer").select(key, F.when(F.col("__is"), F.col("__new")).otherwise(F.col(value)).alias(value))


def selection_document(selected: DataFrame, video: str = "video", value: str = "frames") -> DataFrame:
    """The selection as one JSON object, videos in order: a column `value` for a text writer."""
    entry = F.struct(F.col(video).alias("k"), F.col(value).alias("v"))
    return selected.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))


def read_selection(spark: SparkSession, path: str, video: str = "video", value: str = "frames") -> DataFrame:
    """Rows of a selection's JSON object; none if the path doesn't exist."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException:
        return spark.createDataFrame([], f"{video} string, {value} array<int>")
    return text.select(F.explode(F.from_json("value", "map<string,array<int>>")).alias(video, value))


def united(a: DataFrame, b: DataFrame, key: str = "video", value: str = "frames") -> DataFrame:
    """Both frame lists of a key as one set."""
    e = lambda d: d.select(key, F.explode(value).alias("__f"))
    return e(a).union(e(b)).groupBy(key).agg(F.sort_array(F.collect_set("__f")).alias(value))


def zipped(df: DataFrame, *arrays: str) -> DataFrame:
    """Rows of arrays side by side. Arrays of different lengths are an error rather than cut."""
    size = F.size(arrays[0])
    even = F.lit(True)
    for a in arrays[1:]:
        even = even & (F.size(a) == size)
    checked = F.when(even, F.arrays_zip(*arrays)).otherwise(F.raise_error(F.lit(f"arrays of different lengths: {', '.join(arrays)}")))
    return df.select(*(c for c in df.columns if c not in arrays), F.posexplode(checked).alias("pos", "__z")).select("*", *(F.col(f"__z.{a}").alias(a) for a in arrays)).drop("__z")
