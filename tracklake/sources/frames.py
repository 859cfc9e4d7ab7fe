"""Interfaces for what needs a codec or a model: frames of videos, detectors, masks; and pixel arithmetic on tables.

A decoder or a model is a plain function that is given here; Spark deals the videos or frames out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import spread

FRAMES = "video string, frame int, width int, height int, pixels binary"
DETECTIONS = "video string, frame int, det_idx int, x1 double, y1 double, x2 double, y2 double, score double, label int"
PROPERTIES = "video string, n_frames long, width int, height int, fps double"


def frames(videos: DataFrame, decode: Callable[[str], Iterable[tuple[int, int, int, bytes]]], batch: int = 16) -> DataFrame:
    """Frames of videos(path): decode(path) yields (frame, width, height, pixels) one after another."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for pdf in parts:
            for path in pdf.path:
                for f in decode(path):
                    held.append((path, *f))
                    if len(held) == batch:
                        yield pd.DataFrame(held, columns=[c.split()[0] for c in FRAMES.split(", ")])
                        held = []
        if held:
            yield pd.DataFrame(held, columns=[c.split()[0] for c in FRAMES.split(", ")])

    return videos.select("path").mapInPandas(run, FRAMES)


def frames_at(wanted: DataFrame, seek: Callable[[str, list[int]], Iterable[tuple[int, int, int, bytes]]], batch: int = 16) -> DataFrame:
    """Only the frames of wanted(path, frame): seek(path, numbers) yields them, numbers being sorted and distinct, so no other is decoded."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []
        for pdf in parts:
            for path, numbers in zip(pdf.path, pdf.numbers, strict=True):
                for f in seek(path, list(map(int, numbers))):
                    held.append((path, *f))
                    if len(held) == batch:
                        yield pd.DataFrame(held, columns=[c.split()[0] for c in FRAMES.split(", ")])
                        held = []
        if held:
            yield pd.DataFrame(held, columns=[c.split()[0] for c in FRAMES.split(", ")])

    return wanted.groupBy("path").agg(F.array_sort(F.collect_set("frame")).alias("numbers")).mapInPandas(run, FRAMES)


def images(listing: DataFrame, shape: Callable[[str], tuple[int, int, int]]) -> DataFrame:
    """Image files of listing(path) with height, width and channels, as shape(path) gives them."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([(p, *shape(p)) for p in pdf.path], columns=["path", "height", "width", "channels"])

    return listing.select("path").mapInPandas(run, "path string, height int, width int, channels int")


def properties(videos: DataFrame, probe: Callable[[str], tuple[int, int, int, float]]) -> DataFrame:
    """n_frames, width, height and fps of videos(path), as probe(path) gives them."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame([(p, *probe(p)) for p in pdf.path], columns=["video", "n_frames", "width", "height", "fps"])

    return videos.select("path").mapInPandas(run, PROPERTIES)


def detect(frames_: DataFrame, model: Callable[[pd.DataFrame], Iterable[pd.DataFrame]]) -> DataFrame:
    """Detections of frames: model gives, for a batch of frames, a table x1..y2, score, label for each. A frame without any gives a row with a null box."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rows = []
            for f, found in zip(pdf.itertuples(), model(pdf), strict=True):
                boxes = [(f.video, f.frame, i, *b) for i, b in enumerate(found[["x1", "y1", "x2", "y2", "score", "label"]].itertuples(index=False))]
                rows.extend(boxes or [(f.video, f.frame, 0, None, None, None, None, None, None)])
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in DETECTIONS.split(", ")])
            yield out.astype({"label": "Int32"})

    return frames_.mapInPandas(run, DETECTIONS)


def clip_commands(clips: DataFrame, fraction: float = 0.5) -> DataFrame:
    """Source, target and the times (from, to) at which each clip is cut; running the cutter is left to the caller."""
    from ..functions.names import clip_length, pts_window

    lo, hi = pts_window("loop_START_frame_ffmpeg_PTS", "loop_END_frame_ffmpeg_PTS", "fps", fraction)
    return clips.select(
        F.concat_ws("/", "video_parent_directory", "video_name").alias("source"), F.col("loop_clip_name").alias("target"), lo.alias("pts_from"), hi.alias("pts_to"),
        clip_length("loop_START_frame_ffmpeg", "loop_END_frame_ffmpeg").alias("expected_frames"),
    )


def frame_counts(expected: DataFrame, found: DataFrame) -> DataFrame:
    """expected(video, n_frames) beside the frames found(video, frame); is_complete tells an early end from a whole video."""
    n = found.groupBy("video").agg(F.count_distinct("frame").alias("n_found"))
    return expected.join(n, "video", "left").withColumn("n_found", F.coalesce("n_found", F.lit(0))).withColumn("is_complete", F.col("n_found") == F.col("n_frames"))


def pixel_statistics(pixels: DataFrame) -> DataFrame:
    """Mean and largest absolute deviation from it of each pixel(video, frame, px, py, value) over its video."""
    by = ["video", "px", "py"]
    mean = pixels.groupBy(*by).agg(F.avg("value").alias("mean"))
    return pixels.join(mean, by).groupBy(*by).agg(F.first("mean").alias("mean"), F.max(F.abs(F.col("value") - F.col("mean"))).alias("max_abs"))


def without_background(pixels: DataFrame) -> DataFrame:
    """Pixels between 0 and 1: their mean is at 1/2, and the largest deviation at an end."""
    s = pixel_statistics(pixels)
    scaled = (F.coalesce(F.try_divide(F.col("value") - F.col("mean"), F.col("max_abs")), F.lit(0.0)) + 1) / 2
    return pixels.join(s, ["video", "px", "py"]).withColumn("value", scaled).drop("mean", "max_abs")


def motion(pixels: DataFrame, delta: int) -> DataFrame:
    """Absolute difference of each pixel and itself delta frames on."""
    later = pixels.select("video", "px", "py", (F.col("frame") - delta).alias("frame"), F.col("value").alias("later"))
    return pixels.join(later, ["video", "px", "py", "frame"]).select("video", "frame", "px", "py", F.abs(F.col("later") - F.col("value")).alias("value"))


def channels(gray: DataFrame, background: DataFrame, moving: DataFrame) -> DataFrame:
    """The three channels side by side, 0 to 255; gray is given in that range."""
    by = ["video", "frame", "px", "py"]
    whole = lambda c: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(c))).cast("short")
    b = background.select(*by, whole(F.col("value") * 255).alias("background"))
    m = moving.select(*by, whole(F.col("value") * 255).alias("motion"))
    return gray.select(*by, whole(F.col("value")).alias("gray")).join(b, by).join(m, by)


def merged_masks(masks: DataFrame) -> DataFrame:
    """masks(image, id, px, py): the larger id where instances overlap. Images are dealt out in parts of bounded size, which later steps by image keep."""
    return spread(masks.select("image", "id", "px", "py"), "image").groupBy("image", "px", "py").agg(F.max("id").cast("short").alias("id"))


def instances(merged: DataFrame, width: int, height: int) -> DataFrame:
    """A mask of its own for each instance of merged(image, px, py, id), as runs over its pixels in row order: start and len of what is set."""
    at = merged.filter(F.col("px").between(0, width - 1) & F.col("py").between(0, height - 1)).withColumn("at", F.col("py").cast("long") * width + F.col("px"))
    w = Window.partitionBy("image", "id").orderBy("at")
    island = at.withColumn("__i", F.col("at") - F.row_number().over(w))
    return island.groupBy("image", "id", "__i").agg(F.min("at").alias("start"), F.count("*").alias("len")).drop("__i")


def mask_runs(merged: DataFrame) -> DataFrame:
    """Runs of pixels of one instance in a row of the image."""
    w = Window.partitionBy("image", "py", "id").orderBy("px")
    island = merged.withColumn("__i", F.col("px") - F.row_number().over(w))
    return island.groupBy("image", "py", "id", "__i").agg(F.min("px").alias("start"), F.count("*").alias("len")).drop("__i")


def mask_moments(merged: DataFrame) -> DataFrame:
    """Centre, axes and angle of the ellipse with the same moments as each instance."""
    m = merged.groupBy("image", "id").agg(F.count("*").alias("n"), F.avg("px").alias("cx"), F.avg("py").alias("cy"), (F.var_pop("px") + 1 / 12).alias("a"), (F.var_pop("py") + 1 / 12).alias("c"), F.covar_pop("px", "py").alias("b"))
    half, root = (F.col("a") + F.col("c")) / 2, F.sqrt(((F.col("a") - F.col("c")) / 2) ** 2 + F.col("b") ** 2)
    return m.select("image", "id", "n", "cx", "cy", (4 * F.sqrt(half + root)).alias("major"), (4 * F.sqrt(F.greatest(F.lit(0.0), half - root))).alias("minor"), (F.atan2(2 * F.col("b"), F.col("a") - F.col("c")) / 2).alias("angle"))


def prompts(boxes: DataFrame) -> DataFrame:
    """Boxes of an image as one array, in order: what a mask model is asked."""
    return boxes.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("det_idx", "x1", "y1", "x2", "y2"))).alias("boxes"))


MASKS = "image string, id int, px int, py int"


def segment(prompted: DataFrame, model: Callable[[str, list[tuple[float, float, float, float]]], Iterable[Iterable[tuple[int, int]]]]) -> DataFrame:
    """Masks of prompts(): model(image, boxes) gives the pixels (px, py) of one mask for each box, in order; instances count from 1."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for image, boxes in zip(pdf.image, pdf.boxes, strict=True):
                asked = [(b["x1"], b["y1"], b["x2"], b["y2"]) for b in boxes]
                rows = [(image, i + 1, x, y) for i, mask in zip(range(len(asked)), model(image, asked), strict=True) for x, y in mask]
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in MASKS.split(", ")]).astype({"id": "int32", "px": "int32", "py": "int32"})

    return prompted.mapInPandas(run, MASKS)
