import json

import pytest
from pyspark.sql import functions as F

from tracklake.operators import analysis, annotations, sampling, store, sync
from tracklake.sources import coco, files, frames, via

CSV = '''filename,file_size,file_attributes,region_count,region_id,region_shape_attributes,region_attributes
frame_00000011.png,26542080,"{""clip"":123}",1,0,"{""name"":""rect"",""x"":2894.5,""y"":975.25,""width"":51,""height"":41}","{""track"":""2.0""}"
frame_00000011.png,26542080,"{""clip"":123}",1,0,"{""name"":""rect"",""x"":940.5,""y"":1192.5,""width"":49,""height"":38}","{""track"":""1.0""}"
frame_00000021.png,26542080,"{""clip"":123}",1,0,"{""name"":""rect"",""x"":940.5,""y"":1192.5,""width"":49,""height"":38}","{""track"":""2.0""}"
'''


def test_read_and_write_tracks(spark, tmp_path):
    (tmp_path / "04.09.2023-01-Right-Loop05_tracks.csv").write_text(CSV)
    rows = via.read_tracks(spark, str(tmp_path)).orderBy("frame", "gt_idx").collect()
    assert [(r.frame, r.gt_id) for r in rows] == [(11, 2), (11, 1), (21, 2)]
    assert rows[0].video == "04.09.2023-01-Right" and rows[0].clip_file == "04.09.2023-01-Right-Loop05.mp4"
    assert (rows[0].x1, rows[0].y1, rows[0].x2, rows[0].y2, rows[0].confidence) == (2894.5, 975.25, 2945.5, 1016.25, None)
    tracks = spark.createDataFrame([(0, 0, 1, 10.5, 20.0, 30.9, 40.0, 0.9), (0, 1, 2, 50.0, 60.0, 70.0, 80.0, 0.8), (1, 0, 1, 15.0, 25.0, 35.0, 45.0, 0.85)], "frame int, emit_idx int, track_id int, x1 double, y1 double, x2 double, y2 double, score double")
    via.write_tracks(tracks, str(tmp_path / "out"))
    lines = [x for f in sorted((tmp_path / "out").glob("*.csv")) for x in f.read_text().splitlines() if not x.startswith("filename")]
    assert lines[0] == 'frame_00000000.png,8888,"{""clip"":123}",1,0,"{""name"":""rect"",""x"":10.5,""y"":20.0,""width"":20,""height"":20}","{""track"":""1"", ""confidence"":""0.9""}"'
    assert len(lines) == 3
    back = via.parse_rows(via.read_rows(spark, str(tmp_path / "out"))).orderBy("frame", "gt_id").collect()
    assert [(r.frame, r.gt_id, r.confidence) for r in back] == [(0, 1, 0.9), (0, 2, 0.8), (1, 1, 0.85)]
    obs = via.observations(via.read_tracks(spark, str(tmp_path))).first()
    assert obs.t == 11 and obs.w == 51


def project(keys, name="p"):
    meta = {k: {"filename": k, "size": -1, "regions": [{"shape_attributes": {"name": "rect", "x": i, "y": 2, "width": 10, "height": 20}, "region_attributes": {}} for i in range(n)]} for k, n in keys.items()}
    return json.dumps({"_via_settings": {"core": {"default_filepath": "/a/"}, "project": {"name": name}}, "_via_attributes": {"region": {}}, "_via_data_format_version": "2.0.10", "_via_image_id_list": list(keys), "_via_img_metadata": meta})


def test_combine_projects_and_convert(spark, tmp_path):
    (tmp_path / "a.json").write_text(project({"x.png": 1, "y.png": 2}, "first"))
    (tmp_path / "b.json").write_text(project({"y.png": 3, "z.png": 0}, "second"))
    (tmp_path / "c_skip.json").write_text(project({"w.png": 1}))
    (tmp_path / "d_coco.json").write_text('{"images": [], "annotations": []}')
    projects = via.read_projects(spark, str(tmp_path), "skip")
    assert projects.count() == 2
    combined = via.combine(projects)
    assert {r.key: len(r.regions) for r in combined.collect()} == {"x.png": 1, "y.png": 3, "z.png": 0}
    one = via.combined_project(projects, "/new/place", "all").first()
    assert one["_via_settings"]["core"]["default_filepath"] == "/new/place/" and one["_via_settings"]["project"]["name"] == "all"
    assert one["_via_image_id_list"] == ["x.png", "y.png", "y.png", "z.png"] and set(one["_via_img_metadata"]) == {"x.png", "y.png", "z.png"}
    assert via.combined_project(projects).first()["_via_settings"]["project"]["name"] == "first"
    with pytest.raises(ValueError):
        via.combined_project(projects, "relative")
    images, boxes, categories = via.coco_rows(combined, ["first"])
    assert [(r.id, r.file_name, r.width) for r in images.orderBy("id").collect()] == [(1, "x.png", 0), (2, "y.png", 0), (3, "z.png", 0)]
    assert [(r.id, r.image_id, r.bbox, r.area, r.iscrowd) for r in boxes.orderBy("id").collect()][:2] == [(1, 1, [0.0, 2.0, 10.0, 20.0], 200.0, 0), (2, 2, [0.0, 2.0, 10.0, 20.0], 200.0, 0)]
    doc = coco.document(images, boxes, categories)
    via.write_json(doc, str(tmp_path / "coco"))
    back = coco.read(spark, [str(tmp_path / "coco"), str(tmp_path / "coco")])
    assert back[0].count() == 6 and back[1].filter("dataset_idx = 1").count() == 4
    names = spark.createDataFrame([("y.png",)], "file_name string")
    kept, anns = coco.exclude(back[0], back[1], names)
    assert kept.count() == 4 and anns.count() == 2
    assert coco.centers(back[0], back[1]).filter("x = 5 and y = 12 and w = 10").count() == 4
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "bad.json").write_text("{nope")
    with pytest.raises(Exception, match="(?i)malformed"):
        via.read_projects(spark, str(tmp_path / "bad")).collect()


@pytest.mark.parametrize("gone", [0, 1, 20, 97])
def test_exclusion_counts(spark, gone):
    images = spark.range(100).selectExpr("0 dataset_idx", "cast(id as int) id", "concat('f', id) file_name")
    anns = spark.range(300).selectExpr("0 dataset_idx", "cast(id % 100 as int) image_id")
    kept, left = coco.exclude(images, anns, images.filter(f"id < {gone}").select("file_name"))
    assert (kept.count(), left.count()) == (100 - gone, 300 - 3 * gone)


@pytest.mark.parametrize("n", [50, 100, 250])
def test_split_fractions(spark, n):
    images = spark.range(n)
    rows = coco.split(images).collect()
    share = {s: sum(r.split == s for r in rows) / n for s in ("train", "test", "val")}
    assert len(rows) == n == len({r.id for r in rows}) and abs(share["train"] - 0.8) < 0.05 and abs(share["test"] - 0.1) < 0.05 and abs(share["val"] - 0.1) < 0.05
    assert sorted(map(tuple, rows)) == sorted(map(tuple, coco.split(images.repartition(5)).collect()))
    assert sorted(map(tuple, rows)) != sorted(map(tuple, coco.split(images, seed=7).collect()))
    sizes = [r["count"] for r in coco.batches(images, 8).groupBy("batch").count().collect()]
    assert sum(sizes) == n and max(sizes) == 8


def test_resolving_files():
    assert coco.annotation_files(["/d/a", "/d/b/"]) == ["/d/a/annotations/VIA_JSON_combined_coco_gen.json", "/d/b/annotations/VIA_JSON_combined_coco_gen.json"]
    assert coco.annotation_files(["/d/a", "/d/b"], ["x.json", "/e/y.json"]) == ["/d/a/annotations/x.json", "/e/y.json"]
    assert coco.image_dirs(["/d/a/"]) == ["/d/a/frames"]
    with pytest.raises(ValueError):
        coco.annotation_files(["/d/a"], ["x.json", "y.json"])


def test_coco_of_boxes(spark):
    boxes = spark.createDataFrame([(0, 0, 1.0, 2.0, 4.0, 6.0), (1, 0, 0.0, 0.0, 2.0, 2.0)], "image_idx int, det_idx int, x1 double, y1 double, x2 double, y2 double")
    images, anns, _ = coco.of_boxes(boxes)
    assert [r.file_name for r in images.orderBy("id").collect()] == ["frame_0000.png", "frame_0001.png"]
    assert [(r.id, r.image_id, r.bbox, r.area) for r in anns.orderBy("id").collect()] == [(1, 1, [1.0, 2.0, 3.0, 4.0], 12.0), (2, 2, [0.0, 0.0, 2.0, 2.0], 4.0)]


def test_listing_videos(spark, tmp_path):
    for f in ("b.MP4", "a.mp4", "._a.mp4", "x.txt", "c.mov"):
        (tmp_path / f).write_bytes(b"1")
    found = files.videos(spark, [str(tmp_path)])
    assert [r.file_name for r in found.collect()] == ["a.mp4", "b.MP4", "c.mov"]
    assert [r.file_name for r in files.videos(spark, [str(tmp_path)], "mp4").collect()] == ["a.mp4", "b.MP4"]
    with pytest.raises(FileNotFoundError):
        files.videos(spark, [str(tmp_path)], ("avi",))
    groups = files.grouped(found, F.col("extension")).collect()
    assert {r.key: len(r.paths) for r in groups} == {"mp4": 2, "mov": 1}
    wanted = spark.createDataFrame([("b.mp4",), ("q.mp4",)], "file_name string")
    assert {r.file_name: r.path is not None for r in files.by_stem(wanted, found).collect()} == {"b.mp4": True, "q.mp4": False}


def test_parameters_and_probes(spark):
    p = spark.createDataFrame([("r", {"config/a/x": "1", "config/a/y": "2", "config/b/x": "3", "cli_args/seed": "9", "other": "0"})], "run string, params map<string,string>")
    assert files.nested(p, "config").first().config is not None and files.two_levels(p, "config").count() == 3
    assert p.select(files.argument(F.lit(None).cast("string"), F.col("params"), "seed").alias("a"), files.argument(F.lit("1"), F.col("params"), "seed").alias("b")).first() == ("9", "1")
    assert p.select(files.run_of_checkpoint(F.lit("/x/run7/checkpoints/last.ckpt"))).first()[0] == "run7"
    probe = json.dumps({"streams": [{"codec_type": "video", "r_frame_rate": "60000/1001", "nb_frames": "100"}, {"codec_type": "data", "codec_tag_string": "tmcd", "tags": {"timecode": "00:00:01:00"}}]})
    rows = files.stream_info(spark.createDataFrame([("a", probe), ("b", '{"streams": []}')], "video string, probe string")).orderBy("video").collect()
    assert (rows[0].r_frame_rate_str, rows[0].n_frames, rows[0].timecode, rows[0].error) == ("60000/1001", 100, "00:00:01:00", None) and rows[1].error == "no video stream"


def clip_table(spark):
    return spark.createDataFrame(
        [("v", "c1", "v-c1.mp4", 100, 200, 150, "Spontaneous", 30.0), ("v", "c2", "v-c2.mp4", 1, 50, 20, "Triggered", 30.0)],
        "video string, clip string, loop_clip_name string, loop_start_frame_ffmpeg int, loop_end_frame_ffmpeg int, escape_start_frame_0idx int, escape_type string, fps double",
    )


def test_store(spark, tmp_path):
    clips = clip_table(spark)
    times = spark.createDataFrame([("v", "c1", t) for t in (0, 10, 20, 50, 51, 60, 80, 100)], "video string, clip string, t int")
    states = store.escape_states(times, clips, ["video", "clip"]).orderBy("t").collect()
    assert [r.escape_state for r in states] == [0, 0, 0, 0, 1, 1, 1, 1]
    early = clips.withColumn("escape_start_frame_0idx", F.lit(90))  # before the clip
    assert {r.escape_state for r in store.escape_states(times, early, ["video", "clip"]).collect()} == {1}
    f = store.clip_frames(clips).orderBy("clip").first()
    assert (f.clip_first_frame_0idx, f.clip_last_frame_0idx, f.escape_local, f.clip_escape_type) == (99, 199, 51, "spontaneous")
    assert store.check_uniform_fps(clips).collect() == [("v", 30.0)]
    with pytest.raises(ValueError, match="fps"):
        store.check_uniform_fps(clips.withColumn("fps", F.when(F.col("clip") == "c2", 25.0).otherwise(30.0)))
    obs = spark.createDataFrame([("v", "c1", 0, i, 1.0, 1.0) for i in (1, 3, 7)] + [("v", "c2", 0, i, 1.0, 1.0) for i in range(11)], "video string, clip string, t int, individual int, x double, y double")
    labels = {(r.clip, r.individual): r.label for r in store.renumbered(obs).collect()}
    assert labels[("c1", 1)] == "id_00" and labels[("c1", 7)] == "id_02" and labels[("c2", 10)] == "id_10"
    with pytest.raises(ValueError, match="metadata"):
        store.with_metadata(spark.createDataFrame([("nope.mp4",)], "loop_clip_name string"), clips)
    path = str(tmp_path / "store")
    table = obs.withColumnsRenamed({"video": "video_id", "clip": "clip_id"})
    store.write(table, path, "w-")
    with pytest.raises(Exception, match="(?i)already exists"):
        store.write(table, path, "w-")
    with pytest.raises(ValueError, match="already"):
        store.write(table, path, "a", "w-")
    store.write(table.filter("clip_id = 'c1' and individual = 1"), path, "a", "w")
    assert {r.clip_id: r["count"] for r in store.read(spark, path).groupBy("clip_id").count().collect()} == {"c1": 1, "c2": 11}
    plan = store.read(spark, path).filter("clip_id = 'c1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(clip_id" in plan
    store.write(table, path, "w")
    assert store.read(spark, path).count() == 14
    assert store.dense(obs, ["video", "clip"]).count() == 14
    assert store.concat(obs, obs.drop("y")).filter("y is null").count() == 14


def test_analysis_edges(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 4.999, 5.0, 10.0, 10.01, -0.1)], "v double")
    assert {r.bin: r.n for r in analysis.histogram(df, "v", 0, 10, 2).collect()} == {0: 2, 1: 2}
    obs = spark.createDataFrame([("c", t, 1, x, y, e) for t, x, y, e in [(0, None, 1.0, 0), (1, 2.0, None, 0), (2, 3.0, 4.0, 1), (5, 3.0, 4.0, 1)]], "clip string, t int, individual int, x double, y double, escape_state int")
    assert analysis.track_lengths(obs, ["clip"]).first().n_samples == 2 and analysis.track_lengths(obs, ["clip"], any_of=True).first().n_samples == 4
    assert tuple(analysis.first_positions(obs, ["clip"]).select("x", "y").first()) == (2.0, 1.0)
    assert [(r.escape_state, r.start, r.length) for r in analysis.run_lengths(obs, ["clip"], "escape_state").orderBy("run").collect()] == [(0, 0, 2), (1, 2, 2)]
    t = {r.t: (len(r.past), len(r.future)) for r in analysis.trajectories(obs, obs, ["clip"]).collect()}
    assert t == {0: (1, 3), 1: (2, 2), 2: (3, 1), 5: (4, 0)}
    assert {r.t: (len(r.past), len(r.future)) for r in analysis.trajectories(obs, obs, ["clip"], now_in_past=False).collect()} == {0: (0, 4), 1: (1, 3), 2: (2, 2), 5: (3, 1)}
    assert analysis.time_slice(spark.range(200).withColumnRenamed("id", "t"), 0, 100).count() == 101
    assert analysis.dense_grid(analysis.occupancy(obs, 10, 10, 4, 3), 4, 3).count() == 12
    assert analysis.long_tracks(obs, ["clip"], 2.5).count() == 0
    assert analysis.clip_at(obs.withColumn("video", F.lit("v")), 0, "video", "clip").count() == 4


def test_annotations(spark):
    v = spark.createDataFrame([("a",), ("b",)], "video string")
    f = spark.createDataFrame([("a", 5), ("a", 1)], "video string, frame int")
    chosen = annotations.selections(v, f)
    assert {r.video: r.frames for r in chosen.collect()} == {"a": [1, 5], "b": []}
    new = spark.createDataFrame([("b", [9]), ("c", [2])], "video string, frames array<int>")
    assert {r.video: r.frames for r in annotations.merged(chosen, new).collect()} == {"a": [1, 5], "b": [9], "c": [2]}
    assert {r.video: r.frames for r in annotations.united(chosen, new).collect()} == {"a": [1, 5], "b": [9], "c": [2]}
    z = spark.createDataFrame([(1, [1, 2], ["x", "y"])], "k int, a array<int>, b array<string>")
    assert [(r.pos, r.a, r.b) for r in annotations.zipped(z, "a", "b").collect()] == [(0, 1, "x"), (1, 2, "y")]
    with pytest.raises(Exception, match="different lengths"):
        annotations.zipped(spark.createDataFrame([(1, [1, 2], ["x"])], "k int, a array<int>, b array<string>"), "a", "b").collect()


def test_synchronised_window(spark):
    s = spark.createDataFrame([("a", "25/1", 100, "00:00:00:00"), ("b", "25/1", 100, "00:00:01:00"), ("c", "30/1", 10, "00:00:00:00"), ("d", "25/1", 5, None)], "video string, r_frame_rate_str string, n_frames long, timecode string")
    rows = {r.video: r for r in sync.window(sync.timecodes(s.filter("video <> 'c'"))).collect()}
    assert (rows["a"].start_idx, rows["a"].end_idx, rows["b"].start_idx, rows["b"].end_idx) == (25, 99, 0, 74) and rows["d"].error == "no timecode"
    assert {r.video: r.error for r in sync.window(sync.timecodes(s)).collect()}["c"] == "other frame rate"


def test_sampling(spark):
    f = spark.range(100).selectExpr("'v' video", "cast(id as int) frame")
    assert [r.frame for r in sampling.initial_samples(f, ["video"], 4).orderBy("frame").collect()] == [0, 25, 50, 75]
    assert sampling.initial_samples(f, ["video"], 7, "random").count() == 7
    assert sampling.first_frames(f, 5).count() == 5 and sampling.first_frames(f, None).count() == 100
    assert sampling.row_at(f, 3, ["frame"]).first().frame == 3


def test_frame_interfaces(spark):
    import pandas as pd

    videos = spark.createDataFrame([("a",), ("b",)], "path string")
    shown = frames.frames(videos, lambda p: ((i, 2, 1, bytes([i, 7])) for i in range(3)))
    assert shown.count() == 6

    def model(pdf):
        for f in pdf.frame:
            n = f % 2
            yield pd.DataFrame({"x1": [0.0] * n, "y1": [0.0] * n, "x2": [1.0] * n, "y2": [1.0] * n, "score": [0.5] * n, "label": [1] * n})

    got = frames.detect(shown, model).collect()
    assert len(got) == 6 and sum(r.x1 is None for r in got) == 4
    assert frames.properties(videos, lambda p: (3, 2, 1, 25.0)).first().fps == 25.0
    expected = spark.createDataFrame([("a", 3), ("b", 4)], "video string, n_frames int")
    assert {r.video: r.is_complete for r in frames.frame_counts(expected, shown).collect()} == {"a": True, "b": False}
    px = spark.createDataFrame([("v", f, 0, 0, float(v)) for f, v in enumerate((0, 10, 20))], "video string, frame int, px int, py int, value double")
    assert [r.value for r in frames.without_background(px).orderBy("frame").collect()] == [0.0, 0.5, 1.0]
    c = frames.channels(px, frames.without_background(px), frames.motion(px, 1)).orderBy("frame").collect()
    assert [(r.gray, r.background, r.motion) for r in c] == [(0, 0, 255), (10, 127, 255)]
    masks = spark.createDataFrame([("i", 1, x, 0) for x in range(5)] + [("i", 2, x, 0) for x in (3, 4, 8)], "image string, id int, px int, py int")
    assert sorted((r.id, r.start, r.len) for r in frames.mask_runs(frames.merged_masks(masks)).collect()) == [(1, 0, 3), (2, 3, 2), (2, 8, 1)]
    assert frames.mask_moments(frames.merged_masks(masks)).filter("id = 1 and cx = 1 and n = 3").count() == 1
