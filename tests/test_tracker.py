import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklake.operators import tracker
from tracklake.operators.tracker import Settings, Tracker
from tracklake.streaming.tracker import DETECTION, TrackProcessor, track_stream

SCHEMA = "video string, frame int, det_idx int, x1 double, y1 double, x2 double, y2 double, score double"


def moving(n_frames=30, n=3, videos=("a", "b")):
    rng = np.random.RandomState(5)
    rows = []
    for v in videos:
        for f in range(n_frames):
            for i in range(n):
                if f in (7, 8) or rng.rand() < 0.1:
                    continue
                x, y = 100 * i + 3 * f + rng.randn(), 50 + 2 * f + rng.randn()
                rows.append((v, f, i, float(x), float(y), float(x + 40), float(y + 30), 0.5 + i / 10))
        rows.append((v, n_frames - 1, 9, None, None, None, None, None))
    return rows


def test_steady_motion_keeps_ids():
    t = Tracker(Settings(max_age=10, min_hits=1, iou_threshold=0.1))
    ids = []
    for f in range(20):
        box, got, score = t.update([[10 + 4 * f, 20, 50 + 4 * f, 50], [300, 20 + 2 * f, 340, 50 + 2 * f]], [0.9, 0.4])
        ids.append(sorted(got.tolist()))
        assert dict(zip(got.tolist(), score.tolist(), strict=True)) == {1: 0.9, 2: 0.4}  # a score stays with its detection
    assert ids == [[1, 2]] * 20
    assert np.allclose(box[list(got).index(1)], [86, 20, 126, 50], atol=1.0)


def test_birth_age_and_death():
    t = Tracker(Settings(max_age=1, min_hits=1, iou_threshold=0.3))
    near = [[0, 0, 10, 10]]
    assert t.update(near, [1.0])[1].tolist() == [1]
    assert t.update(near + [[100, 100, 120, 120]], [1.0, 1.0])[1].tolist() == [1]  # a later track shows at its second hit
    assert t.update(near + [[100, 100, 120, 120]], [1.0, 1.0])[1].tolist() == [2, 1]  # the newest first
    assert t.update([], [])[1].tolist() == [] and len(t.mean) == 2
    t.update([], [])
    assert len(t.mean) == 0
    t.update(near, [1.0])
    assert t.update(near, [1.0])[1].tolist() == [3]


def test_association_takes_plain_pairs_or_solves():
    d = np.array([[0, 0, 10, 10], [20, 0, 30, 10], [90, 90, 99, 99]], float)
    pairs, fresh = tracker.associate(d, d[:2][::-1], 0.3)
    assert sorted(map(tuple, pairs.tolist())) == [(0, 1), (1, 0)] and fresh.tolist() == [2]
    two = np.array([[0, 0, 10, 10], [3, 0, 13, 10]], float)
    pairs, fresh = tracker.associate(two, two + [1, 0, 1, 0], 0.3)
    assert sorted(map(tuple, pairs.tolist())) == [(0, 0), (1, 1)] and not len(fresh)
    assert tracker.associate(d, np.zeros((0, 4)), 0.3)[1].tolist() == [0, 1, 2]


def test_batch_and_stream_agree(spark, tmp_path):
    rows = moving()
    batch = tracker.track(spark.createDataFrame(rows, SCHEMA), ["video"])
    want = sorted(map(tuple, batch.collect()))
    assert want and {r[0] for r in want} == {"a", "b"}
    source = str(tmp_path / "in")
    for lo, hi in ((0, 7), (7, 8), (8, 20), (20, 30)):  # a batch without any box of frames 7 and 8 is in between
        part = [r for r in rows if lo <= r[1] < hi] or [(v, lo, 0, None, None, None, None, None) for v in ("a", "b")]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(source)
    q = track_stream(stream, ["video"]).writeStream.format("memory").queryName("tracks").outputMode("append").start()
    try:
        q.processAllAvailable()
        got = sorted(map(tuple, spark.table("tracks").collect()))
    finally:
        q.stop()
    assert got == want


def paused(seed, n_frames=400, min_hits=1):
    """Two sequences, one without a name, with pauses around the length that ends tracks."""
    rng = np.random.RandomState(seed)
    rows = []
    for v in ("a", None):
        f = 3
        rows.append((v, 0, 0, None, None, None, None, None))  # frames count from here
        while f < n_frames:
            for i in range(rng.randint(1, 4)):
                x, y = 60 * i + 2 * (f % 50) + rng.randn(), 50 + rng.randn()
                rows.append((v, f, i, float(x), float(y), float(x + 40), float(y + 30), 0.5 + i / 10))
            f += int(rng.choice([1, 1, 1, 1, 1, 1, 1, 4, 5, 6, 9]))
        rows.append((v, f + 20, 0, None, None, None, None, None))
    return rows


@pytest.mark.parametrize("settings", [Settings(max_age=3), Settings(max_age=4, min_hits=3), Settings(max_age=4, min_hits=150)])
def test_pieces_equal_the_whole_sequence(spark, settings):
    rows = spark.createDataFrame(paused(settings.min_hits), SCHEMA)
    whole = sorted(map(str, map(tuple, tracker.track(rows, ["video"], settings).collect())))
    pieces = tracker.track_in_pieces(rows, ["video"], settings, stretch=16)
    assert sorted(map(str, map(tuple, pieces.collect()))) == whole and len(whole) > 100
    cut = tracker.cut_frames(rows, ["video"], settings.max_age, 16)
    assert cut.filter("video = 'a'").select("piece").distinct().count() > 8
    many = cut.filter("video = 'a'").repartition("video", "piece", "counted").select(F.spark_partition_id().alias("p")).distinct()
    spread = cut.sparkSession.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert many.count() > 1  # one sequence in many tasks
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", spread)


def run_stream(spark, source, keys, out, checkpoint, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = track_stream(stream, keys, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return sorted(map(tuple, spark.read.parquet(out).collect()))


def add(spark, source, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)


def test_frames_come_in_pieces_and_a_query_starts_again(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "check"))
    rows = [r for r in moving(24) if r[3] is not None]
    # a detection comes up to four frames late, in any order; one that comes after its frame was tracked is dropped
    order = np.random.RandomState(1).randint(0, 5, len(rows)) + [r[1] for r in rows]
    for lo, hi in ((0, 8), (8, 13)):
        add(spark, source, [r for r, at in zip(rows, order, strict=True) if lo <= at < hi][::-1])
    run_stream(spark, source, ["video"], out, checkpoint, lateness=4)
    add(spark, source, [("a", 2, 77, 0.0, 0.0, 9.0, 9.0, 1.0), *[r for r, at in zip(rows, order, strict=True) if at >= 13]])
    add(spark, source, [(v, 40, 0, None, None, None, None, None) for v in ("a", "b")])
    got = run_stream(spark, source, ["video"], out, checkpoint, lateness=4)
    assert got == sorted(map(tuple, tracker.track(spark.createDataFrame(rows, SCHEMA), ["video"]).collect()))


def test_state_has_a_row_for_each_live_track_and_time_closes_them(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / d) for d in ("in", "out", "check"))
    boxes = lambda v, lo, hi: [(v, f, i, 100.0 * i, 0.0, 100.0 * i + 40, 30.0, 0.5) for f in range(lo, hi) for i in range(3)]
    add(spark, source, boxes("a", 0, 10))
    got = run_stream(spark, source, ["video"], out, checkpoint, lateness=2)
    assert {r[1] for r in got} == set(range(8))  # two frames wait
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(checkpoint)
    assert state("tracks").count() == 3 and state("waiting").count() == 2
    # with an idle time, frames that wait come out by themselves (such a query has batches without rows, so it is stopped from outside)
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    q = track_stream(stream, ["video"], lateness=2, idle_ms=500).writeStream.format("memory").queryName("idle").outputMode("append").trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            time.sleep(1)
            got = {r.frame for r in spark.table("idle").collect()}
            if got == set(range(10)):
                break
        assert got == set(range(10)) and q.exception() is None
    finally:
        q.stop()


def test_association_of_a_crowd_needs_no_matrix():
    """30,000 boxes of a frame, whose matrix would have 900 million cells; and a smaller crowd gets the sum that the matrix has."""
    rng = np.random.default_rng(6)
    at = np.c_[np.arange(30000) % 200 * 60.0, np.arange(30000) // 200 * 50.0]
    boxes = np.c_[at, at + [40, 30]]
    pairs, fresh = tracker.associate(boxes, boxes[::-1] + 1.0, 0.1)
    assert not len(fresh) and (pairs.sum(axis=1) == 29999).all()
    for n, wide in ((300, 0), (200, 5)):
        a, b = (np.c_[x := rng.uniform(0, 900, (n, 2)), x + rng.uniform(5, 90, (n, 2))] for _ in range(2))
        a[:wide, 2] += 5000
        of = np.sort(rng.integers(0, 2, n))
        pairs, fresh = tracker.associate(a, b, 0.1, of, of)
        for k in (0, 1):
            here = pairs[of[pairs[:, 0]] == k]
            gain = tracker.overlaps(a[of == k], b[of == k])
            best = tracker.maximum_assignment(gain)
            want = gain[best[:, 0], best[:, 1]]
            assert np.isclose(tracker.overlap(a[here[:, 0]], b[here[:, 1]]).sum(), want[want >= 0.1].sum())
            assert len({*here[:, 0]}) == len({*here[:, 1]}) == len(here) and (of[here[:, 1]] == k).all()


def test_many_sequences_side_by_side_equal_each_alone(monkeypatch):
    rng = np.random.RandomState(3)
    rows = []
    for v in range(60):
        for f in range(rng.randint(0, 5), rng.randint(6, 40)):
            if rng.rand() < 0.8 and f not in range(10, 10 + v % 14):
                rows += [(v, f, i, x := 25.0 * i + 2 * f + rng.randn(), 5.0 * i, x + 40, 5.0 * i + 30, rng.rand()) for i in range(rng.randint(1, 4))]
    table = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    for settings in (Settings(), Settings(max_age=3, min_hits=3)):
        alone = pd.concat([tracker.run_frames(Tracker(settings), part, ["video"], (v,)) for v, part in table.groupby("video")])
        for long in (20000, 5):
            monkeypatch.setattr(tracker, "LONG", long)
            got = pd.concat(list(tracker._run(["video"], settings)(table.iloc[i : i + 37] for i in range(0, len(table), 37))))
            key = ["video", "frame", "emit_idx"]
            pd.testing.assert_frame_equal(got.sort_values(key, ignore_index=True), alone.sort_values(key, ignore_index=True), check_dtype=False)
    monkeypatch.setattr(tracker, "LONG", 20000)
    calls = []
    monkeypatch.setattr(tracker.Trackers, "step", lambda self, *a, step=tracker.Trackers.step: calls.append(1) or step(self, *a))
    list(tracker._run(["video"], Settings())([table]))
    assert len(calls) < 60  # a step for all sequences, not one for each


class Maps:
    """A stateful processor's handle in memory."""

    def __init__(self):
        self.timers = []

    def getMapState(self, name, key, value):  # noqa: N802
        class State(dict):
            getValue, updateValue, removeKey, iterator = dict.get, dict.__setitem__, dict.pop, lambda s: iter(list(s.items()))  # noqa: N815

        setattr(self, name, State())
        return getattr(self, name)

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


class Now:
    def __init__(self, at):
        self.getCurrentProcessingTimeInMs = self.getExpiryTimeInMs = lambda: at


def test_streamed_sequences_of_a_group_step_together(monkeypatch):
    """300 sequences over three batches: as each alone, in as many steps as there are frames, not as many for each sequence."""
    rng = np.random.RandomState(5)
    rows = []
    for v in range(300):
        for f in range(rng.randint(0, 5), rng.randint(6, 40)):
            if rng.rand() < 0.8:
                rows += [(v or None, f, i, x := 25.0 * i + 2 * f + rng.randn(), 5.0 * i, x + 40, 5.0 * i + 30, rng.rand()) for i in range(rng.randint(1, 4))]
    table = pd.DataFrame(rows, columns=["video", *DETECTION])
    settings = Settings(max_age=3, min_hits=3)
    alone = pd.concat([tracker.run_frames(Tracker(settings), part, ["video"], (None if pd.isna(v) else v,)) for v, part in table.groupby("video", dropna=False)])
    calls, step = [], tracker.Trackers.step
    monkeypatch.setattr(tracker.Trackers, "step", lambda self, *a: calls.append(1) or step(self, *a))
    handle = Maps()
    stream = TrackProcessor([T.StructField("video", T.LongType())], settings, 0, None)
    stream.init(handle)
    parts = [table[(table.frame >= lo) & (table.frame < hi)] for lo, hi in ((0, 9), (9, 10), (10, 40))]
    got = pd.concat([out for part in parts for out in stream.handleInputRows((0,), iter([part.sample(frac=1, random_state=1)]), Now(0))])
    key = ["video", "frame", "emit_idx"]
    order = lambda df: df.assign(video=df.video.astype(float)).sort_values(key, ignore_index=True)
    pd.testing.assert_frame_equal(order(got), order(alone), check_dtype=False)
    assert len(calls) <= 80
    assert len(handle.clock) == 300 and len(handle.tracks) == sum(len(c[4]) for c in handle.clock.values())


def test_only_idle_sequences_of_a_group_are_closed():
    handle = Maps()
    stream = TrackProcessor([T.StructField("video", T.StringType())], Settings(), 2, 500)
    stream.init(handle)
    feed = lambda v, lo, hi, at: pd.concat([pd.DataFrame(columns=["frame"]), *stream.handleInputRows((0,), iter([pd.DataFrame([(n, f, 0, 0.0, 0.0, 9.0, 9.0, 1.0) for n in v for f in range(lo, hi)], columns=["video", *DETECTION])]), Now(at))])
    assert set(feed("ab", 0, 10, 1000).frame) == set(range(8))
    assert set(feed("b", 10, 12, 1400).frame) == {8, 9} and handle.timers == [1500, 1900]
    closed = pd.concat(stream.handleExpiredTimer((0,), Now(1500), Now(1500)))
    assert set(closed.video) == {"a"} and closed.frame.tolist() == [8, 9]
    assert {k[0] for k in handle.tracks} == {k[0] for k in handle.waiting} == {"b"}
    assert feed("a", 10, 14, 1600).track_id.tolist() == [2]  # ids go on; a track born late shows from its second box
    closed = pd.concat(stream.handleExpiredTimer((0,), Now(1900), Now(1900)))
    assert closed.frame.tolist() == [10, 11] and set(closed.video) == {"b"}
