"""Matching of predicted to true boxes, frame by frame.

Tables: truth(keys..., frame, gt_id, x1..y2) and predictions(keys..., frame, pred_id, x1..y2, score).
keys name the sequence (video, clip); a frame is the unit within which boxes meet.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.boxes import CORNERS, iou
from ..functions.ordering import free_column, whole_groups
from .assignment import chosen_links, clusters, sides

#: Side of a grid's cells in pixels; any is right, one of a few boxes is fast.
CELL = 256.0
#: Cells a side of the widest boxes that are entered in cells.
WIDE = 8
#: Cells of a cluster's matrix up to which it is solved where its frame is.
CELLS = 1 << 14


def box_pairs(truth: DataFrame, predictions: DataFrame, keys: list[str], threshold: float = 0.0, inclusive: bool = False) -> DataFrame:
    """Pairs of boxes of one frame whose overlap exceeds the threshold. They meet in the cells of a grid, so a frame's boxes aren't all paired; for a threshold below 0, which pairs without overlap exceed, they are."""
    on = [*keys, "frame"]
    if threshold >= 0:
        return _met(truth, predictions, on, CELL, threshold, inclusive)
    t = truth.select(*on, "gt_id", *(F.col(c).alias(f"t_{c}") for c in CORNERS))
    p = predictions.select(*on, "pred_id", "score", *CORNERS)
    shared = iou(tuple(f"t_{c}" for c in CORNERS), CORNERS, inclusive)
    return t.join(p, on).withColumn("iou", shared).filter(F.col("iou") > threshold).select(*on, "gt_id", "pred_id", "score", "iou")


def pooled_pairs(truth: DataFrame, predictions: DataFrame, by: list[str], threshold: float = 0.0, cell: float = CELL) -> DataFrame:
    """Overlapping pairs of all boxes of a batch, also of different frames, as one pool: ids are numbers within the batch.

    truth, predictions: with the columns `by`, frame, and gt_id or pred_id. For optimal_match(pooled=True).
    Boxes meet in the cells of a grid, so a batch's boxes aren't all paired with each other.
    """

    def numbered(df: DataFrame, name: str) -> DataFrame:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy("frame", name)))

    return _met(numbered(truth, "gt_id"), numbered(predictions, "pred_id"), by, cell, threshold, False)


def grid_pairs(truth: DataFrame, predictions: DataFrame, keys: list[str], cell: float = CELL, threshold: float = 0.0, inclusive: bool = False) -> DataFrame:
    """box_pairs() for crowded frames: only boxes that touch a common cell of a grid meet, each pair in the first one it shares."""
    return _met(truth, predictions, [*keys, "frame"], cell, threshold, inclusive)


def _met(truth: DataFrame, predictions: DataFrame, on: list[str], cell: float, threshold: float, inclusive: bool) -> DataFrame:
    """Boxes of up to WIDE cells a side meet in cells (way 0). A wider true box meets all predictions (1), a wider prediction the other true boxes (2)."""

    def celled(df: DataFrame, wide_ways: tuple[int, ...], ways: tuple[int, ...]) -> DataFrame:
        lo = lambda c: F.floor((F.col(c) - 1) / cell)
        hi = lambda c: F.floor((F.col(c) + 1) / cell)
        wide = (F.col("x2") - F.col("x1") > WIDE * cell) | (F.col("y2") - F.col("y1") > WIDE * cell) | (F.col("x2") - F.col("x1") < -WIDE * cell) | (F.col("y2") - F.col("y1") < -WIDE * cell)
        listed = lambda ns: F.array(*(F.lit(n) for n in ns))
        by_cell = lambda a, b: F.explode(F.when(F.col("way") == 0, F.sequence(lo(a), hi(b))).otherwise(F.array(F.lit(0).cast("long"))))
        df = df.withColumn("way", F.explode(F.when(wide, listed(wide_ways)).otherwise(listed(ways))))
        return df.withColumn("gx", by_cell("x1", "x2")).withColumn("gy", by_cell("y1", "y2"))

    t = celled(truth, (1,), (0, 2)).select(*on, "way", "gx", "gy", "gt_id", *(F.col(c).alias(f"t_{c}") for c in CORNERS))
    p = celled(predictions, (1, 2), (0, 1)).select(*on, "way", "gx", "gy", "pred_id", "score", *CORNERS)
    first = (F.col("gx") == F.floor((F.greatest("t_x1", "x1") - 1) / cell)) & (F.col("gy") == F.floor((F.greatest("t_y1", "y1") - 1) / cell))
    shared = iou(tuple(f"t_{c}" for c in CORNERS), CORNERS, inclusive)
    met = t.join(p, [*on, "way", "gx", "gy"]).filter((F.col("way") > 0) | first)
    return met.withColumn("iou", shared).filter(F.col("iou") > threshold).select(*on, "gt_id", "pred_id", "score", "iou")


def greedy_match(pairs: DataFrame, keys: list[str], pred_order: str = "pred_id", gt_order: str = "gt_id") -> DataFrame:
    """One-to-one matches in the order of predictions: each takes its best overlap among the true boxes that are left, the first of equal ones.

    A frame's pairs come sorted and are streamed; a task holds the ids that the frame has taken.
    """
    on = [*keys, "frame"]
    columns = [*on, "gt_id", "pred_id", "score", "iou"]
    ordered = pairs.withColumn("score", F.col("score").cast("double")).repartition(*on)
    ordered = ordered.sortWithinPartitions(*on, pred_order, F.col("iou").desc(), gt_order, "gt_id", "pred_id", "score").select(*columns)

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, boxes, predictions = None, set(), set()
        for batch in batches:
            kept = []
            of, g, p = (zip(*(batch.column(i).to_pylist() for i in r), strict=True) for r in (range(len(on)), [len(on)], [len(on) + 1]))
            for frame, (box,), (prediction,) in zip(of, g, p, strict=True):
                if frame != now:
                    now, boxes, predictions = frame, set(), set()
                free = box not in boxes and prediction not in predictions
                kept.append(free)
                if free:
                    if box is not None:
                        boxes.add(box)
                    if prediction is not None:
                        predictions.add(prediction)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return ordered.mapInArrow(fold, ordered.schema)


def optimal_match(pairs: DataFrame, keys: list[str], threshold: float = 0.0, pooled: bool = False, cells: int = CELLS) -> DataFrame:
    """One-to-one matches with the largest sum of overlaps, of which those above the threshold stay.

    pairs: with all overlaps above 0. pooled: boxes of all frames of a batch (keys) compete, and pairs
    are those of pooled_pairs(). The links of a frame (or batch) fall into clusters that share no box; small ones are solved
    at once, many together, and each with a matrix of more than so many cells alone, wherever Spark deals it to.
    So what a task holds is a frame's list of links, and a matrix of one cluster.
    """
    on = list(keys) if pooled else [*keys, "frame"]
    cluster = free_column(pairs, "cluster")
    schema = T.StructType([*pairs.schema.fields, T.StructField(cluster, T.LongType())])

    def links(pdf: pd.DataFrame, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's true box and prediction as numbers; those of other groups are others."""
        ids = (pd.factorize(pdf[c])[0] + 1 for c in ("gt_id", "pred_id"))
        return tuple(np.unique(group * (int(i.max()) + 1) + i, return_inverse=True)[1] for i in ids)

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, group in whole_groups(batches, on):
            left, right = links(pdf, group)
            found = clusters(left, right)
            n, m, _ = sides(left, right, found)
            large, kept = n * m > cells, np.zeros(len(pdf), bool)
            small = np.flatnonzero(~large)
            kept[small] = chosen_links(left[small], right[small], pdf.iou.to_numpy()[small], found[small])
            yield pdf.assign(**{cluster: np.where(large, found, -1)})[large | kept]

    def solve(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, group in whole_groups(batches, [*on, cluster]):
            kept = (pdf[cluster] < 0).to_numpy()
            rest = np.flatnonzero(~kept)
            if len(rest):
                left, right = links(pdf.iloc[rest], group[rest])
                kept[rest] = chosen_links(left, right, pdf.iou.to_numpy()[rest], group[rest])
            yield pdf[kept]

    cut_up = pairs.repartition(*on).sortWithinPartitions(*on).mapInPandas(cut, schema)
    solved = cut_up.repartition(*on, cluster).sortWithinPartitions(*on, cluster).mapInPandas(solve, schema).drop(cluster)
    return solved.filter(F.col("iou") > threshold)


def best_overlap(truth: DataFrame, predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Each prediction with its largest overlap, 0 where it meets no true box."""
    on = [*keys, "frame"]
    best = box_pairs(truth, predictions, keys).groupBy(*on, "pred_id").agg(F.max("iou").alias("best"))
    return predictions.select(*on, "pred_id").join(best, [*on, "pred_id"], "left").select(*on, "pred_id", F.coalesce("best", F.lit(0.0)).alias("best_iou"))


def above_score(predictions: DataFrame, threshold: float | None) -> DataFrame:
    """Predictions with a score strictly above the threshold (none: 0)."""
    return predictions.filter(F.col("score") > (threshold or 0.0))
