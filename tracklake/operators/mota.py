"""Identity switches and multi-object tracking accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import written
from .matching import box_pairs, greedy_match

#: Frames whose identities are followed in one task.
STRETCH = 4096


def evaluated_truth(truth: DataFrame, predictions: DataFrame, keys: list[str], predicted_frames: DataFrame | None = None) -> DataFrame:
    """True boxes of the frames that have a prediction entry. predicted_frames: those frames, where some have no box."""
    on = [*keys, "frame"]
    frames = (predicted_frames if predicted_frames is not None else predictions).select(*on).distinct()
    return truth.join(frames, on, "left_semi")


def ranked_frames(frames: DataFrame, keys: list[str], stretch: int = STRETCH) -> DataFrame:
    """Adds ord (from 1 by frame), first (the sequence's first frame) and stretch to different frames; only a summary a stretch of frames is ordered by sequence."""
    frames = frames.withColumn("stretch", F.floor(F.col("frame") / stretch))
    whole = Window.partitionBy(*keys)
    sums = frames.groupBy(*keys, "stretch").agg(F.count("*").alias("n"), F.min("frame").alias("low"))
    sums = sums.select(*keys, "stretch", (F.sum("n").over(whole.orderBy("stretch")) - F.col("n")).alias("before"), F.min("low").over(whole).alias("first"))
    here = F.row_number().over(Window.partitionBy(*keys, "stretch").orderBy("frame"))
    return frames.withColumn("here", here).join(sums, [*keys, "stretch"]).withColumn("ord", F.col("here") + F.col("before")).drop("here", "before")


def identity_switches(matched: DataFrame, keys: list[str], stretch: int = STRETCH, frames: DataFrame | None = None) -> DataFrame:
    """Adds reid and swap (0 or 1), and the sequence's first frame, to true boxes with their matched pred_id (null: missed).

    reid: the box has another prediction than it had when last matched. swap: its prediction belonged
    to another true box in the frame evaluated before. A clean exchange of two ids counts four times.

    Rows meet by true box or by prediction and stretch of frames, and what a stretch starts with is carried over from
    those before it, a row each; so neither a long sequence nor an animal that is always in it is one task.
    frames: the matched rows' frames, if they are known more cheaply.
    """
    frames = ranked_frames((matched if frames is None else frames).select(*keys, "frame").distinct(), keys, stretch)
    # each missed box is a prediction of its own
    other = F.coalesce(F.concat(F.lit("p"), F.col("pred_id").cast("string")), F.concat_ws(" ", F.lit("m"), "gt_id", "ord"))
    ranked = written(matched.join(frames, [*keys, "frame"]).withColumn("other", other), "ranked")
    box, prediction = [*keys, "gt_id"], [*keys, "other"]
    earlier = lambda by: Window.partitionBy(*by).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    had = ranked.groupBy(*box, "stretch").agg(F.max_by("pred_id", F.when(F.col("pred_id").isNotNull(), F.col("ord"))).alias("v"))
    had = had.select(*box, "stretch", F.last("v", ignorenulls=True).over(earlier(box)).alias("had"))
    was = ranked.filter("pred_id is not null").groupBy(*prediction, "stretch").agg(F.max(F.struct("ord", "gt_id")).alias("v"))
    was = was.select(*prediction, "stretch", F.last("v").over(earlier(prediction)).alias("was"))
    inside = lambda by: Window.partitionBy(*by, "stretch").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    out = ranked.join(had, [*box, "stretch"])
    out = out.withColumn("known", F.coalesce(F.last("pred_id", ignorenulls=True).over(inside(box)), "had"))
    out = out.join(was, [*prediction, "stretch"], "left")
    out = out.withColumn("before", F.coalesce(F.last(F.struct("ord", "gt_id")).over(inside(prediction)), "was"))
    moved = F.col("pred_id").isNotNull() & (F.col("before.ord") == F.col("ord") - 1) & (F.col("before.gt_id") != F.col("gt_id"))
    reid, swap = F.when(F.col("pred_id") != F.col("known"), 1).otherwise(0), F.when(moved, 1).otherwise(0)
    return out.withColumn("reid", reid).withColumn("swap", swap).drop("known", "ord", "before", "stretch", "other", "had", "was")


def matched_truth(truth: DataFrame, predictions: DataFrame, keys: list[str], threshold: float = 0.1, predicted_frames: DataFrame | None = None, pred_order: str = "pred_id", gt_order: str = "gt_id") -> DataFrame:
    """Every evaluated true box with the prediction that the greedy match gives it, or null."""
    on = [*keys, "frame"]
    shown = evaluated_truth(truth, predictions, keys, predicted_frames)
    matches = greedy_match(box_pairs(shown, predictions, keys, threshold, inclusive=True), keys, pred_order, gt_order)
    return shown.select(*on, "gt_id").join(matches.select(*on, "gt_id", "pred_id"), [*on, "gt_id"], "left")


def mota_per_frame(truth: DataFrame, predictions: DataFrame, keys: list[str], threshold: float = 0.1, predicted_frames: DataFrame | None = None, stretch: int = STRETCH) -> DataFrame:
    """Counts and accuracy of each frame that has true boxes and a prediction entry."""
    on = [*keys, "frame"]
    matched = matched_truth(truth, predictions, keys, threshold, predicted_frames)
    switched = identity_switches(matched, keys, stretch, evaluated_truth(truth, predictions, keys, predicted_frames))
    frames = switched.groupBy(*on).agg(
        F.count("*").alias("total_ground_truth"),
        F.count("pred_id").alias("true_positives"),
        F.sum("reid").alias("reid"),
        F.sum("swap").alias("swap"),
        F.first("first").alias("first"),
    )
    shown = predictions.groupBy(*on).agg(F.count("*").alias("n_pred"))
    out = frames.join(shown, on, "left").withColumn("false_positives", F.coalesce("n_pred", F.lit(0)) - F.col("true_positives"))
    out = out.withColumn("missed_detections", F.col("total_ground_truth") - F.col("true_positives")).withColumn("switches", F.col("reid") + F.col("swap"))
    lost = F.col("missed_detections") + F.col("false_positives") + F.col("switches")
    return out.withColumn("mota", 1 - lost / F.col("total_ground_truth")).withColumn("frame_index", F.col("frame") - F.col("first")).drop("n_pred", "first")


def mota_overall(per_frame: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The mean of the frames' accuracies, and the accuracy of the sums."""
    lost = F.sum(F.col("missed_detections") + F.col("false_positives") + F.col("switches"))
    return per_frame.groupBy(*(keys or [])).agg(F.count("*").alias("n_frames"), F.avg("mota").alias("mean_mota"), (1 - lost / F.sum("total_ground_truth")).alias("aggregated_mota"))


#: Columns of a written metrics table.
METRICS = {
    "frame": "Frame Number",
    "frame_index": "Frame Index",
    "total_ground_truth": "Total Ground Truth",
    "true_positives": "True Positives",
    "missed_detections": "Missed Detections",
    "false_positives": "False Positives",
    "switches": "Number of Switches",
    "mota": "MOTA",
}


def metrics_table(per_frame: DataFrame, keys: list[str]) -> DataFrame:
    """Frames in order, with the columns of a written metrics table after the keys."""
    return per_frame.orderBy(*keys, "frame").select(*keys, *(F.col(c).alias(name) for c, name in METRICS.items()))


def write_metrics(per_frame: DataFrame, keys: list[str], path: str, **options) -> None:
    metrics_table(per_frame, keys).write.option("header", True).csv(path, **options)
