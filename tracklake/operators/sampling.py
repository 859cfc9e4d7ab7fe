"""Choice of frames to label, and of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import frame_at
from ..functions.ordering import with_row_number


def initial_samples(frames: DataFrame, keys: list[str], n: int, method: str = "stride", seed: int = 42) -> DataFrame:
    """n frames of each video, evenly spaced or in a seeded order (the count asked for is the operator's purpose)."""
    if method == "random":
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(F.lit(seed), *keys, "frame"), "frame"))
        return frames.withColumn("__r", rank).filter(F.col("__r") <= n).drop("__r")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("frame")) - 1
    stride = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy(*keys)) / n))
    return frames.withColumn("__r", rank).withColumn("__s", stride).filter((F.col("__r") % F.col("__s") == 0) & (F.col("__r") < F.col("__s") * n)).drop("__r", "__s")


def diverse(features: DataFrame, vector: str, n_components: int = 5, n_clusters: int = 5, per_cluster: int = 5, seed: int = 42, key: str = "frame") -> DataFrame:
    """per_cluster rows of each cluster of the vectors' leading components: those nearest to its centre."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = features.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    reduced = PCA(k=n_components, inputCol="__v", outputCol="__c").fit(v).transform(v)
    model = KMeans(k=n_clusters, seed=seed, featuresCol="__c", predictionCol="cluster").fit(reduced)
    centers = F.array(*(F.array(*(F.lit(float(x)) for x in c)) for c in model.clusterCenters()))
    off = F.aggregate(F.zip_with(vector_to_array("__c"), centers[F.col("cluster")], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    ranked = model.transform(reduced).withColumn("distance", off).withColumn("__r", F.row_number().over(Window.partitionBy("cluster").orderBy("distance", key)))
    return ranked.filter(F.col("__r") <= per_cluster).drop("__r", "__v", "__c")


def every_nth(frames: DataFrame, n: int, column: str = "frame") -> DataFrame:
    return frames.filter(F.col(column) % n == 0)


def first_frames(frames: DataFrame, n: int | None, column: str = "frame") -> DataFrame:
    """Frames below n; all for none."""
    return frames if n is None else frames.filter(F.col(column) < n)


def cut_by_clock(frames: DataFrame, clips: DataFrame, keys: list[str]) -> DataFrame:
    """Frames of clips(keys..., clip_name, fps, video_start, clip_start, clip_end as HH:MM:SS), both ends included, numbered from 0 in each clip.

    A frame in several clips is in each of them. A video's clips are few, so they are the equi-join's small side.
    """
    bounds = clips.select(*keys, "clip_name", frame_at(F.col("clip_start"), F.col("video_start"), F.col("fps")).alias("__from"), frame_at(F.col("clip_end"), F.col("video_start"), F.col("fps")).alias("__to"))
    cut = frames.join(bounds, keys).filter(F.col("frame").between(F.col("__from"), F.col("__to")))
    return cut.withColumn("clip_frame", F.col("frame") - F.col("__from")).drop("__from", "__to")


def row_at(df: DataFrame, k: int, order: list[str]) -> DataFrame:
    """The row with a number (from 0), as a task of an array job picks its input."""
    return with_row_number(df, order, "__k", 0).filter(F.col("__k") == k).drop("__k")
