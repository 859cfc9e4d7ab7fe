"""Precision and recall of detections under an optimal assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .matching import above_score, box_pairs, optimal_match, pooled_pairs


def ratio(part: str, *rest: str):
    """part / (part + rest), 0 where there is nothing."""
    return F.coalesce(F.try_divide(F.col(part), sum((F.col(c) for c in rest), F.col(part))), F.lit(0.0))


def confusion(truth: DataFrame, predictions: DataFrame, keys: list[str], threshold: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """True and false positives and false negatives per group (default: per frame), over all frames with a box of either kind."""
    on = [*keys, "frame"]
    by = on if by is None else by
    matches = optimal_match(box_pairs(truth, predictions, keys), keys, threshold)
    parts = truth.select(*on, F.lit(0).alias("tp"), F.lit(1).alias("g"), F.lit(0).alias("p"))
    parts = parts.unionAll(predictions.select(*on, F.lit(0), F.lit(0), F.lit(1))).unionAll(matches.select(*on, F.lit(1), F.lit(0), F.lit(0)))
    out = parts.groupBy(*by).agg(F.sum("tp").alias("tp"), (F.sum("p") - F.sum("tp")).alias("fp"), (F.sum("g") - F.sum("tp")).alias("fn"))
    return out.withColumn("precision", ratio("tp", "fp")).withColumn("recall", ratio("tp", "fn"))


def batch_confusion(truth: DataFrame, predictions: DataFrame, batched: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Counts, precision and recall of each batch of batched(keys..., frame, batch), whose boxes are matched as one pool; batches without a box have zeros. mean_over() gives an epoch's figures."""
    on = [*keys, "frame"]
    frames = batched.select(*on, "batch")
    t, p = (df.join(frames, on).withColumn("frame", F.struct(*on)) for df in (truth, predictions))
    matches = optimal_match(pooled_pairs(t, p, ["batch"]), ["batch"], threshold, pooled=True)
    zero, one = F.lit(0), F.lit(1)
    parts = frames.select("batch", zero.alias("tp"), zero.alias("g"), zero.alias("p")).distinct()
    parts = parts.unionAll(t.select("batch", zero, one, zero)).unionAll(p.select("batch", zero, zero, one)).unionAll(matches.select("batch", one, zero, zero))
    out = parts.groupBy("batch").agg(F.sum("tp").alias("tp"), (F.sum("p") - F.sum("tp")).alias("fp"), (F.sum("g") - F.sum("tp")).alias("fn"))
    return out.withColumn("precision", ratio("tp", "fp")).withColumn("recall", ratio("tp", "fn"))


def by_threshold(truth: DataFrame, predictions: DataFrame, keys: list[str], thresholds: list[float], score: float | None = None) -> DataFrame:
    """Counts, precision and recall over all frames for each overlap threshold, from one assignment."""
    shown = above_score(predictions, score) if score is not None else predictions
    matches = optimal_match(box_pairs(truth, shown, keys), keys)
    levels = F.array(*(F.lit(float(t)) for t in thresholds))
    hits = matches.select(F.explode(levels).alias("threshold"), "iou").groupBy("threshold").agg(F.sum((F.col("iou") > F.col("threshold")).cast("long")).alias("tp"))
    sizes = truth.agg(F.count("*").alias("g")).join(shown.agg(F.count("*").alias("p")), how="cross")  # one row
    level = truth.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    out = level.join(F.broadcast(hits), "threshold", "left").join(F.broadcast(sizes)).withColumn("tp", F.coalesce("tp", F.lit(0).cast("long")))
    out = out.select("threshold", "tp", (F.col("p") - F.col("tp")).alias("fp"), (F.col("g") - F.col("tp")).alias("fn"))
    return out.withColumn("precision", ratio("tp", "fp")).withColumn("recall", ratio("tp", "fn"))


def mean_over(metrics: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The unweighted mean of batches' (or thresholds') precision and recall."""
    return metrics.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg("precision").alias("precision"), F.avg("recall").alias("recall"))


def best_trial(trials: DataFrame) -> DataFrame:
    """The parameters of the trial with the largest mean of precision and recall, the first of equal ones."""
    value = (F.col("precision") + F.col("recall")) / 2
    return trials.agg(F.max_by(F.struct(*trials.columns), F.struct(value, -F.col("trial"))).alias("t")).select("t.*")
