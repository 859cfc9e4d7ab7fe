"""Commands: python -m tracklake COMMAND --help."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import names
from .functions.storage import written
from .operators import annotations, detection_metrics, mota, sampling, store, tracker
from .sources import files, frames, via

FOUND = "file_name string, det_idx int, x1 double, y1 double, x2 double, y2 double, score double"
DETECTIONS = "video string, frame int, det_idx int, x1 double, y1 double, x2 double, y2 double, score double"


def table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of detections or features, as Parquet or (by its ending) CSV."""
    return spark.read.schema(schema).option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)


def combine_annotations(spark: SparkSession, a: argparse.Namespace) -> None:
    projects = via.read_projects(spark, a.folder, a.exclude_pattern)
    via.write_project(projects, a.out, a.default_dir, a.project_name, a.mode)


def convert_to_coco(spark: SparkSession, a: argparse.Namespace) -> None:
    from .sources import coco

    tables = via.coco_rows(via.combine(via.read_projects(spark, a.folder, a.exclude_pattern)), ["first"], a.category)
    coco.write(*tables, a.out, a.mode)


def track(spark: SparkSession, a: argparse.Namespace) -> None:
    settings = tracker.Settings(a.max_age, a.min_hits, a.iou_threshold)
    found = table(spark, a.detections, DETECTIONS)
    tracks = tracker.track(sampling.first_frames(found, a.max_frames_to_read), ["video"], settings, a.score_threshold)
    tracks.write.mode(a.mode).partitionBy("video").parquet(a.out)
    if a.via_csv:
        via.write_tracks(spark.read.parquet(a.out), a.via_csv, order=("video", "frame", "emit_idx"), mode=a.mode)


def evaluate_tracks(spark: SparkSession, a: argparse.Namespace) -> None:
    """A video's first true frame is its decoded frame a.first_frame; every decoded frame counts, with or without a track."""
    truth = via.read_tracks(spark, a.annotations)
    start = truth.groupBy("video").agg(F.min("frame").alias("start"))  # a row for each video
    found = spark.read.parquet(a.tracks).withColumnRenamed("track_id", "pred_id").join(start, "video")
    found = found.withColumn("frame", F.col("frame") - a.first_frame + F.col("start")).drop("start")
    decoded = truth.join(start, "video").select("video", "frame", (F.col("frame") - F.col("start") + a.first_frame).alias("at"))
    decoded = decoded.filter(F.col("at") < a.n_frames) if a.n_frames is not None else decoded
    per = mota.mota_per_frame(truth, found, ["video"], a.iou_threshold, decoded)
    mota.write_metrics(per, ["video"], a.out, mode=a.mode)
    mota.mota_overall(per, ["video"]).show(truncate=False)


def evaluate_detector(spark: SparkSession, a: argparse.Namespace) -> None:
    """Precision and recall of found boxes on the validation (or test) images of COCO files, as the mean over batches; detections name their image by file_name."""
    from .functions.boxes import xywh_to_xyxy
    from .sources import coco

    images, boxes, _ = coco.read(spark, a.annotations.split(","))
    image = F.concat_ws("/", "dataset_idx", F.col("id").cast("string")).alias("image")
    chosen = coco.split(images.select(image, "file_name"), a.seed, a.train_fraction, a.test_of_rest, "image")
    chosen = coco.batches(chosen.filter(F.col("split") == ("test" if a.use_test_set else "val")), a.batch_size, key="image")
    if a.limit_test_batches is not None:
        chosen = coco.limited(chosen, a.limit_test_batches)
    shown = written(chosen.select("image", "file_name", F.lit(0).alias("frame"), "batch"), "evaluated")
    corners = xywh_to_xyxy(*(F.col("bbox")[i] for i in range(4)))
    named = [c.alias(n) for c, n in zip(corners, ("x1", "y1", "x2", "y2"), strict=True)]
    truth = boxes.select(F.concat_ws("/", "dataset_idx", F.col("image_id").cast("string")).alias("image"), F.lit(0).alias("frame"), F.col("id").alias("gt_id"), *named)
    found = table(spark, a.detections, FOUND).filter("x1 is not null").join(shown.select("image", "file_name", "frame"), "file_name")
    found = found.withColumn("pred_id", F.col("det_idx"))
    per = detection_metrics.batch_confusion(truth, found, shown, ["image"], a.iou_threshold)
    detection_metrics.mean_over(per).select("n", "precision", "recall").write.mode(a.mode).option("header", True).csv(a.out)
    if a.batches_out:
        per.orderBy("batch").write.mode(a.mode).option("header", True).csv(a.batches_out)


def create_store(spark: SparkSession, a: argparse.Namespace) -> None:
    clips = files.clip_table(spark, a.metadata)
    clips = clips.select(
        F.col("loop_clip_name"), "fps", F.col("loop_START_frame_ffmpeg").alias("loop_start_frame_ffmpeg"), F.col("loop_END_frame_ffmpeg").alias("loop_end_frame_ffmpeg"),
        F.col("escape_START_frame_0_based_idx").alias("escape_start_frame_0idx"), "escape_type",
    )
    boxes = via.observations(via.read_tracks(spark, a.tracks)).withColumnRenamed("clip_file", "loop_clip_name")
    joined = store.with_metadata(boxes, store.clip_frames(clips)).withColumn("video_id", F.col("video")).withColumn("clip_id", names.clip_id("loop_clip_name"))
    store.check_uniform_fps(joined.select("video_id", "fps"), "video_id")
    labelled = store.renumbered(joined, "video_id", "clip_id").drop("individual", "video").withColumnRenamed("label", "individual")
    store.write(labelled.withColumn("escape_state", (F.col("t") >= F.col("escape_local")).cast("tinyint")), a.out, a.store_mode, a.group_mode)


def clip_commands(spark: SparkSession, a: argparse.Namespace) -> None:
    commands = frames.clip_commands(files.clip_table(spark, a.metadata), a.fraction)
    commands = sampling.row_at(commands, a.task, ["target"]) if a.task is not None else commands
    commands.write.mode(a.mode).option("header", True).csv(a.out)


def select_frames(spark: SparkSession, a: argparse.Namespace) -> None:
    first = sampling.initial_samples(spark.read.parquet(a.features), ["video"], a.initial_samples, a.method, a.seed)
    chosen = sampling.diverse(first, a.vector, a.n_components, a.n_clusters, a.per_cluster, a.seed)
    new = annotations.selections(first, chosen)
    merged = annotations.merged(annotations.read_selection(spark, a.merge), new) if a.merge else new
    annotations.selection_document(merged).coalesce(1).write.mode(a.mode).text(a.out)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tracklake", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def add(f, *arguments):
        p = sub.add_parser(f.__name__.replace("_", "-"))
        p.set_defaults(run=f)
        for name, options in arguments:
            p.add_argument(name, **options)
        p.add_argument("--out", required=True)
        p.add_argument("--mode", default="errorifexists", choices=["errorifexists", "overwrite", "append", "ignore"])

    folder, pattern = ("folder", {}), ("--exclude-pattern", {})
    add(combine_annotations, folder, pattern, ("--default-dir", {}), ("--project-name", {}))
    add(convert_to_coco, folder, pattern, ("--category", {"default": "animal"}))
    add(
        track, ("detections", {}), ("--via-csv", {}), ("--max-age", {"type": int, "default": 10}), ("--min-hits", {"type": int, "default": 1}),
        ("--iou-threshold", {"type": float, "default": 0.1}), ("--score-threshold", {"type": float, "default": 0.1}), ("--max-frames-to-read", {"type": int}),
    )
    add(
        evaluate_tracks, ("annotations", {}), ("tracks", {}), ("--iou-threshold", {"type": float, "default": 0.1}),
        ("--first-frame", {"type": int, "default": 0, "help": "decoded frame that the first true frame is"}), ("--n-frames", {"type": int, "help": "how many frames were decoded (default: all true ones)"}),
    )
    add(
        evaluate_detector, ("annotations", {"help": "COCO files with commas between them"}), ("detections", {}), ("--use-test-set", {"action": "store_true"}), ("--iou-threshold", {"type": float, "default": 0.1}),
        ("--seed", {"type": int, "default": 42}), ("--train-fraction", {"type": float, "default": 0.8}), ("--test-of-rest", {"type": float, "default": 0.5}), ("--batch-size", {"type": int, "default": 1}),
        ("--limit-test-batches", {"type": lambda v: float(v) if "." in v else int(v), "help": "so many batches, or a share of them"}), ("--batches-out", {"help": "a table of each batch's counts"}),
    )
    add(create_store, ("tracks", {}), ("metadata", {}), ("--store-mode", {"default": "w-", "choices": ["w-", "w", "a"]}), ("--group-mode", {"choices": ["w-", "w"]}))
    add(clip_commands, ("metadata", {}), ("--fraction", {"type": float, "default": 0.5}), ("--task", {"type": int}))
    add(
        select_frames, ("features", {}), ("--vector", {"default": "features"}), ("--merge", {}), ("--method", {"default": "stride", "choices": ["stride", "random"]}), ("--seed", {"type": int, "default": 42}),
        ("--initial-samples", {"type": int, "default": 200}), ("--n-components", {"type": int, "default": 5}), ("--n-clusters", {"type": int, "default": 5}), ("--per-cluster", {"type": int, "default": 5}),
    )
    return top


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(SparkSession.builder.appName(f"tracklake {a.command}").getOrCreate(), a)


if __name__ == "__main__":
    main()
