import json

import numpy as np
import pytest

from tracklake.__main__ import main, parser

from .test_sources_and_store import CSV, project
from .test_tracker import SCHEMA, moving


@pytest.mark.parametrize("command", ["combine-annotations", "convert-to-coco", "track", "evaluate-tracks", "evaluate-detector", "create-store", "clip-commands", "select-frames"])
def test_help(command, capsys):
    with pytest.raises(SystemExit) as e:
        parser().parse_args([command, "--help"])
    assert e.value.code == 0 and command in capsys.readouterr().out


def text(path, ending):
    return "".join(f.read_text() for f in sorted(path.glob(f"*.{ending}")))


def test_annotations_and_tracks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(project({"x.png": 2}))
    main(["combine-annotations", str(tmp_path / "in"), "--project-name", "all", "--out", str(tmp_path / "combined")])
    assert json.loads(text(tmp_path / "combined", "json"))["_via_settings"]["project"]["name"] == "all"
    main(["convert-to-coco", str(tmp_path / "in"), "--category", "fish", "--out", str(tmp_path / "coco")])
    doc = json.loads(text(tmp_path / "coco", "json"))
    assert len(doc["annotations"]) == 2 and doc["categories"][0]["name"] == "fish"
    spark.createDataFrame(moving(), SCHEMA).write.parquet(str(tmp_path / "det"))
    main(["track", str(tmp_path / "det"), "--out", str(tmp_path / "tracks"), "--via-csv", str(tmp_path / "via"), "--max-frames-to-read", "20"])
    assert spark.read.parquet(str(tmp_path / "tracks")).agg({"frame": "max"}).first()[0] == 19
    (tmp_path / "truth").mkdir()
    rows = [r for r in text(tmp_path / "via", "csv").splitlines() if not r.startswith("filename")]
    (tmp_path / "truth" / "a-Loop01_tracks.csv").write_text("\n".join([CSV.splitlines()[0], *rows[: len(rows) // 2]]))
    main(["evaluate-tracks", str(tmp_path / "truth"), str(tmp_path / "tracks"), "--out", str(tmp_path / "metrics")])
    lines = text(tmp_path / "metrics", "csv").splitlines()
    assert lines[0].startswith("video,Frame Number,Frame Index,Total Ground Truth") and len(lines) > 5


def test_store_clips_and_frames(spark, tmp_path):
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "v-Loop05_tracks.csv").write_text(CSV)
    head = "video_parent_directory,video_name,loop_clip_name,fps,loop_START_frame_ffmpeg,loop_END_frame_ffmpeg,loop_START_frame_ffmpeg_PTS,loop_END_frame_ffmpeg_PTS,escape_START_frame_0_based_idx,escape_type"
    (tmp_path / "clips.csv").write_text(head + "\n/d,v.mov,v-Loop05.mp4,50,101,201,2.0,4.0,120,Spontaneous\n")
    main(["create-store", str(tmp_path / "csv"), str(tmp_path / "clips.csv"), "--out", str(tmp_path / "store")])
    rows = spark.read.parquet(str(tmp_path / "store")).orderBy("t", "individual").collect()
    assert [(r.t, r.individual, r.escape_state, r.clip_id, r.video_id) for r in rows] == [(11, "id_0", 0, "Loop05", "v"), (11, "id_1", 0, "Loop05", "v"), (21, "id_1", 1, "Loop05", "v")]
    main(["clip-commands", str(tmp_path / "clips.csv"), "--task", "0", "--out", str(tmp_path / "cut")])
    assert text(tmp_path / "cut", "csv").splitlines()[1] == "/d/v.mov,v-Loop05.mp4,1.99,4.01,101"
    rng = np.random.RandomState(1)
    spark.createDataFrame([("v", f, rng.rand(6).tolist()) for f in range(40)], "video string, frame int, features array<double>").write.parquet(str(tmp_path / "f"))
    (tmp_path / "old.json").write_text('{"w": [3]}')
    main(["select-frames", str(tmp_path / "f"), "--merge", str(tmp_path / "old.json"), "--n-clusters", "3", "--per-cluster", "2", "--out", str(tmp_path / "sel")])
    chosen = json.loads(text(tmp_path / "sel", "txt"))
    assert chosen["w"] == [3] and len(chosen["v"]) == 6


def evaluated(spark, tmp_path, name, tracked, true=range(10, 20), *more):
    """The metrics of one box that stands still, in the true frames, with a track in the tracked ones."""
    folder = tmp_path / name
    folder.mkdir()
    head = CSV.splitlines()[0]
    shape = '"{""name"":""rect"",""x"":10,""y"":10,""width"":40,""height"":30}"'
    lines = [f'frame_{f:08d}.png,1,"{{}}",1,0,{shape},"{{""track"":""1""}}"' for f in true]
    (folder / "a-Loop01_tracks.csv").write_text("\n".join([head, *lines]))
    rows = [("a", f, 0, 5, 10.0, 10.0, 50.0, 40.0, 0.9) for f in tracked]
    spark.createDataFrame(rows, "video string, frame int, emit_idx int, track_id long, x1 double, y1 double, x2 double, y2 double, score double").write.parquet(str(tmp_path / f"{name}-tracks"))
    main(["evaluate-tracks", str(folder), str(tmp_path / f"{name}-tracks"), "--out", str(tmp_path / f"{name}-out"), *more])
    lines = text(tmp_path / f"{name}-out", "csv").splitlines()
    table = [dict(zip(lines[0].split(","), x.split(","), strict=True)) for x in lines[1:]]
    return [(int(r["Frame Number"]), int(r["Frame Index"]), int(r["True Positives"]), int(r["Missed Detections"]), float(r["MOTA"])) for r in table]


def test_frames_before_the_first_track_are_misses(spark, tmp_path):
    got = evaluated(spark, tmp_path, "late", range(5, 10))
    assert got == [(10 + i, i, int(i >= 5), int(i < 5), float(i >= 5)) for i in range(10)]


def test_a_gap_in_a_track_is_missed(spark, tmp_path):
    got = evaluated(spark, tmp_path, "gap", [0, 1, 2, 6, 7, 8, 9])
    assert [m for *_, m in got] == [1, 1, 1, 0, 0, 0, 1, 1, 1, 1]


def test_frames_that_were_not_decoded_do_not_count(spark, tmp_path):
    assert [i for _, i, *_ in evaluated(spark, tmp_path, "short", range(4), range(10, 20), "--n-frames", "6")] == [0, 1, 2, 3, 4, 5]
    got = evaluated(spark, tmp_path, "later", range(3, 8), range(10, 15), "--first-frame", "3")
    assert [m for *_, m in got] == [1.0] * 5


def test_evaluate_detector(spark, tmp_path):
    """Ten images of two boxes; one is missed in each image, and each even image has a box too many."""
    images = [{"id": i, "width": 100, "height": 100, "file_name": f"f{i}.png"} for i in range(1, 41)]
    boxes = [{"id": 2 * i + k, "image_id": i, "category_id": 1, "bbox": [50.0 * k, 10.0, 20.0, 20.0], "area": 400.0, "iscrowd": 0} for i in range(1, 41) for k in (0, 1)]
    (tmp_path / "coco.json").write_text(json.dumps({"images": images, "annotations": boxes, "categories": [{"id": 1, "name": "c", "supercategory": "animal"}]}))
    rows = [(f"f{i}.png", 0, 1.0, 11.0, 21.0, 31.0, 0.9) for i in range(1, 41)] + [(f"f{i}.png", 1, 0.0, 70.0, 20.0, 90.0, 0.9) for i in range(2, 41, 2)] + [("f3.png", 2, None, None, None, None, None)]
    spark.createDataFrame(rows, "file_name string, det_idx int, x1 double, y1 double, x2 double, y2 double, score double").write.parquet(str(tmp_path / "found"))
    for name, more, n in (("val", [], 4), ("test", ["--use-test-set"], 4), ("all", ["--train-fraction", "0.0", "--test-of-rest", "0.0", "--batch-size", "8"], 5), ("few", ["--limit-test-batches", "0.5"], 2)):
        main(["evaluate-detector", str(tmp_path / "coco.json"), str(tmp_path / "found"), "--out", str(tmp_path / name), "--batches-out", str(tmp_path / f"{name}-batches"), *more])
        got = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / name)).first()
        per = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / f"{name}-batches")).collect()
        assert got.n == len(per) == n and got.recall == 0.5 and abs(got.precision - sum(r.precision for r in per) / n) < 1e-9
        if name == "all":
            assert sum(r.tp for r in per) == 40 and sum(r.fp for r in per) == 20 and sum(r.fn for r in per) == 40
