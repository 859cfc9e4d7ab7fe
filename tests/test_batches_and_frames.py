import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracklake.operators import detection_metrics, matching, sampling, tracker
from tracklake.sources import coco, files, frames, via

BOX = "clip string, frame int, {id} int, x1 double, y1 double, x2 double, y2 double"


def overlap(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return w * h / (area(a) + area(b) - w * h)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pooled_batches_equal_the_best_of_all_assignments(spark, seed):
    """Boxes of different frames of a batch compete."""
    rng = random.Random(seed)
    box = lambda: (lambda x, y: (x, y, x + 20, y + 20))(rng.random() * 30, rng.random() * 30)
    truth = [("c", f, i, *box()) for f in range(4) for i in range(rng.randrange(1, 4))]
    found = [("c", f, i, *box()) for f in range(4) for i in range(rng.randrange(0, 4))]
    batched = spark.createDataFrame([("c", f, f // 2) for f in range(6)], "clip string, frame int, batch int")
    t = spark.createDataFrame(truth, BOX.format(id="gt_id"))
    p = spark.createDataFrame(found, BOX.format(id="pred_id")).selectExpr("*", "1d as score")
    got = {r.batch: (r.tp, r.fp, r.fn) for r in detection_metrics.batch_confusion(t, p, batched, ["clip"], 0.3).collect()}
    for b in range(3):
        g, q = ([r[3:] for r in rows if r[1] // 2 == b] for rows in (truth, found))
        rows, cols = (g, q) if len(g) <= len(q) else (q, g)
        best = max(itertools.permutations(range(len(cols)), len(rows)), key=lambda a: sum(overlap(rows[i], cols[j]) for i, j in enumerate(a)), default=())
        tp = sum(overlap(rows[i], cols[j]) > 0.3 for i, j in enumerate(best))
        assert got[b] == (tp, len(q) - tp, len(g) - tp)
    mean = detection_metrics.mean_over(detection_metrics.batch_confusion(t, p, batched, ["clip"], 0.3)).first()
    assert mean.n == 3


def test_pooled_ids_are_numbers_of_the_batch(spark):
    t = spark.createDataFrame([(1, 0, 7, 0.0, 0.0, 9.0, 9.0), (1, 1, 7, 0.0, 0.0, 9.0, 9.0)], "batch int, frame int, gt_id int, x1 double, y1 double, x2 double, y2 double")
    p = t.withColumnRenamed("gt_id", "pred_id").selectExpr("*", "1d as score")
    assert sorted((r.gt_id, r.pred_id) for r in matching.pooled_pairs(t, p, ["batch"]).collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_batch_limits(spark):
    b = coco.batches(spark.range(95), 10)
    assert {r.batch for r in coco.limited(b, 3).collect()} == {0, 1, 2}
    assert coco.limited(b, 0.25).count() == 20 and coco.limited(b, 1.0).count() == 95 and coco.limited(b, 0).count() == 0


def test_tracks_do_not_depend_on_batches(spark):
    """Sequences and frames that are cut by Arrow's batches give the same tracks as whole ones."""
    rng = random.Random(5)
    rows = []
    for clip in ("a", "b", None, "c"):
        for f in range(40):
            for i in range(4):
                if rng.random() < 0.8:
                    x = 100.0 * i + 2 * f + rng.random()
                    rows.append((clip, f, i, x, x, x + 30, x + 30, rng.random()))
    rows.append(("d", 3, 0, None, None, None, None, None))
    df = spark.createDataFrame(rows, "clip string, frame int, det_idx int, x1 double, y1 double, x2 double, y2 double, score double").repartition(7)
    want = {}
    for clip in ("a", "b", None, "c"):
        part = pd.DataFrame([r for r in rows if r[0] == clip], columns=df.columns)
        out = tracker.run_frames(tracker.Tracker(), part, ["clip"], (clip,))
        want.update({(clip, r.frame, r.emit_idx): (r.track_id, round(r.x1, 6), round(r.score, 6)) for r in out.itertuples()})
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        for size in ("1", "3", "10000"):
            spark.conf.set(key, size)
            got = {(r.clip, r.frame, r.emit_idx): (r.track_id, round(r.x1, 6), round(r.score, 6)) for r in tracker.track(df, ["clip"]).collect()}
            assert got == want
    finally:
        spark.conf.set(key, before)


def test_only_asked_for_frames_are_decoded(spark):
    def seek(path, numbers):
        assert numbers == sorted(set(numbers))
        return ((n, 4, 2, f"{path}{n}".encode()) for n in numbers)

    wanted = spark.createDataFrame([("v", 9), ("v", 2), ("v", 9), ("w", 1)], "path string, frame int")
    assert sorted((r.video, r.frame, bytes(r.pixels)) for r in frames.frames_at(wanted, seek).collect()) == [("v", 2, b"v2"), ("v", 9, b"v9"), ("w", 1, b"w1")]


def test_image_shapes_and_masks(spark):
    listing = spark.createDataFrame([("a.png",), ("bb.png",)], "path string")
    assert sorted(tuple(r) for r in frames.images(listing, lambda p: (len(p), 7, 3)).collect()) == [("a.png", 5, 7, 3), ("bb.png", 6, 7, 3)]
    boxes = spark.createDataFrame([("i", 1, 0.0, 0.0, 2.0, 1.0), ("i", 0, 1.0, 0.0, 3.0, 1.0), ("j", 0, 0.0, 0.0, 0.0, 0.0)], "image string, det_idx int, x1 double, y1 double, x2 double, y2 double")
    inside = lambda image, asked: [[(x, y) for x in range(int(a), int(c)) for y in range(int(b), int(d))] for a, b, c, d in asked]
    masks = frames.segment(frames.prompts(boxes), inside)
    assert sorted(tuple(r) for r in masks.collect()) == [("i", 1, 1, 0), ("i", 1, 2, 0), ("i", 2, 0, 0), ("i", 2, 1, 0)]
    one = frames.instances(frames.merged_masks(masks), 4, 2)
    assert sorted((r.image, r.id, r.start, r.len) for r in one.collect()) == [("i", 1, 2, 1), ("i", 2, 0, 2)]


def test_clips_by_the_clock_and_parameters(spark):
    f = spark.range(200).selectExpr("'v' as video", "cast(id as int) frame")
    clips = spark.createDataFrame([("v", "one", 10.0, "00:00:01", "00:00:02", "00:00:04"), ("v", "two", 10.0, "00:00:01", "00:00:04", "00:00:04")], "video string, clip_name string, fps double, video_start string, clip_start string, clip_end string")
    got = sampling.cut_by_clock(f, clips, ["video"]).collect()
    assert sorted(r.frame for r in got if r.clip_name == "one") == list(range(10, 31)) and [(r.frame, r.clip_frame) for r in got if r.clip_name == "two"] == [(30, 0)]
    runs = spark.createDataFrame([("r1", {"a": "1"})], "run string, params map<string,string>")
    paths = spark.createDataFrame([("x/r1/checkpoints/last.ckpt",), ("x/r2/checkpoints/last.ckpt",)], "path string")
    assert {r.run: r.params for r in files.stored_parameters(paths, runs).collect()} == {"r1": {"a": "1"}, "r2": None}


def test_coco_ids_count_regions_of_the_images_before(spark):
    region = "struct<shape_attributes:struct<name:string,x:double,y:double,width:double,height:double>>"
    rows = [(f"f{i:02d}", [(("rect", float(j), 0.0, 1.0, 1.0),) for j in range(i % 4)]) for i in range(30)]
    pictures = spark.createDataFrame(rows, f"filename string, regions array<{region}>").repartition(5)
    image, annotation, _ = via.coco_rows(pictures, ["filename"])
    assert sorted((r.id, r.file_name) for r in image.collect()) == [(i + 1, f"f{i:02d}") for i in range(30)]
    want, n = [], 0
    for i in range(30):
        for j in range(i % 4):
            n += 1
            want.append((n, i + 1, float(j)))
    assert sorted((r.id, r.image_id, r.bbox[0]) for r in annotation.collect()) == want


def test_masks_of_many_images_are_dealt_in_parts_of_bounded_size(spark, tmp_path, monkeypatch):
    from tracklake.functions import ordering

    path = str(tmp_path / "masks")
    spark.range(40000).selectExpr("id div 4 image", "id % 3 id", "id % 4 px", "0 py").write.parquet(path)
    masks = spark.read.parquet(path)
    real = ordering.spread
    monkeypatch.setattr(frames, "spread", lambda df, *c: real(df, *c, size=2000))
    merged = frames.merged_masks(masks)
    tasks = merged.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 8 and merged.count() == 40000
    plan = frames.mask_runs(merged)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # later steps keep the parts
