import math

import pytest
from pyspark.sql import functions as F

from tracklake.functions import boxes, names


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def box(*v):
    return tuple(F.lit(float(x)) for x in v)


@pytest.mark.parametrize(
    "a, b, want",
    [((0, 0, 10, 10), (0, 0, 10, 10), 1.0), ((0, 0, 10, 10), (20, 20, 30, 30), 0.0), ((0, 0, 10, 10), (5, 5, 12, 12), 0.25), ((0, 0, 10, 10), (10, 10, 20, 20), 1 / 241)],
)
def test_inclusive_overlap(spark, a, b, want):
    assert abs(one(spark, boxes.iou(box(*a), box(*b), inclusive=True)).c0 - want) < 0.01


def test_continuous_overlap_and_empty_boxes(spark):
    r = one(spark, boxes.iou(box(0, 0, 10, 10), box(10, 0, 20, 10)), boxes.iou(box(1, 1, 1, 1), box(1, 1, 1, 1)), boxes.iou(box(0, 0, 2, 2), box(1, 0, 3, 2)))
    assert (r.c0, r.c1) == (0.0, 0.0) and math.isclose(r.c2, 1 / 3)


def test_forms_of_a_box(spark):
    s = boxes.xyxy_to_state(*box(10, 20, 50, 40))
    r = one(spark, *s, *boxes.state_to_xyxy(*s), *boxes.center_to_xyxy(*boxes.xyxy_to_center(*box(1, 2, 4, 8))), *boxes.xywh_to_xyxy(*box(1, 2, 3, 4)), boxes.state_to_xyxy(*box(0, 0, -1, 2))[0])
    assert tuple(r)[:4] == (30, 30, 800, 2)
    assert [round(x, 9) for x in tuple(r)[4:8]] == [10, 20, 50, 40]
    assert tuple(r)[8:12] == (1, 2, 4, 8) and tuple(r)[12:16] == (1, 2, 4, 6) and r[16] is None


def test_clamped_and_small_boxes(spark):
    df = spark.createDataFrame([(-5.0, -5.0, 20.0, 20.0), (99.5, 0.0, 130.0, 50.0), (10.0, 10.0, 10.4, 30.0)], "x1 double, y1 double, x2 double, y2 double")
    assert [tuple(r) for r in boxes.sanitize(df, 100, 100).collect()] == [(0, 0, 20, 20)]


def test_names(spark):
    f = F.lit("/data/04.09.2023-01-Right-Loop05_tracks.csv")
    r = one(spark, names.video_name(f), names.clip_file(f), names.clip_id(names.clip_file(f)), names.frame_number(F.lit("a_b_frame_00000011.png")), names.individual_label(F.lit(3), 2))
    assert tuple(r) == ("04.09.2023-01-Right", "04.09.2023-01-Right-Loop05.mp4", "Loop05", 11, "id_03")


def test_clock_and_windows(spark):
    r = one(spark, names.frame_at(F.lit("00:00:03"), F.lit("00:00:01"), 59.94), *names.pts_window(F.lit(10.0), F.lit(20.0), F.lit(50.0), 0.5), names.clip_length(F.lit(100), F.lit(200)), names.frames_to_minutes(F.lit(3600), 60))
    assert tuple(r) == (119, 9.99, 20.01, 101, 1.0)


@pytest.mark.parametrize(
    "code, rate, frames",
    [("00:00:01:00", "25/1", 25), ("00:01:00:00", "30000/1001", 1798), ("00:01:00:02", "30000/1001", 1800), ("00:10:00:00", "30000/1001", 17982), ("01:00:00;00", "60000/1001", 215784), ("00:00:10:05", "60/1", 605), ("00:01:00:00", "24000/1001", 1440)],
)
def test_timecodes(spark, code, rate, frames):
    assert one(spark, names.timecode_frames(F.lit(code), F.lit(rate))).c0 == frames
