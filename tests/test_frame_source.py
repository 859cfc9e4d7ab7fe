"""Only the frames that are asked for are decoded, by several tasks a video."""

import os

import pytest

from tracklake.sources.frame_source import read_frames


@pytest.fixture
def read(spark, tmp_path):
    log = str(tmp_path / "decoded")

    def count(path):
        return {"a": 1000, "b": 10, "empty": 0}[path]

    def seek(path, numbers):
        with open(f"{log}-{os.getpid()}-{path}-{numbers[0]}", "w") as f:
            for k in numbers:
                f.write(f"{path} {k}\n")
                yield k, 4, 3, bytes([k % 256]) * 12

    def decoded():
        return sorted((v, int(k)) for p in tmp_path.glob("decoded-*") for v, k in map(str.split, p.read_text().splitlines()))

    return read_frames(spark, ["a", "b", "empty"], count, seek, span=100), decoded


def test_whole_videos_are_read_by_many_tasks(read):
    df, decoded = read
    assert df.rdd.getNumPartitions() == 11
    rows = df.collect()
    assert sorted((r.video, r.frame) for r in rows) == decoded() == [("a", k) for k in range(1000)] + [("b", k) for k in range(10)]
    assert all(bytes(r.pixels) == bytes([r.frame % 256]) * 12 and (r.width, r.height) == (4, 3) for r in rows)


@pytest.mark.parametrize(
    "condition, want",
    [
        ("video = 'a' and frame in (3, 5, 777, 5000)", [("a", 3), ("a", 5), ("a", 777)]),
        ("frame between 8 and 11", [("a", 8), ("a", 9), ("a", 10), ("a", 11), ("b", 8), ("b", 9)]),
        ("video in ('b', 'x') and frame > 7", [("b", 8), ("b", 9)]),
        ("frame = 4 and frame < 3", []),
        ("video = 'empty'", []),
    ],
)
def test_filters_choose_what_is_decoded(read, condition, want):
    df, decoded = read
    assert sorted((r.video, r.frame) for r in df.filter(condition).collect()) == decoded() == want


def test_other_conditions_are_left_to_spark(read):
    df, decoded = read
    got = df.filter("video = 'b' and frame % 4 = 1").collect()
    assert sorted(r.frame for r in got) == [1, 5, 9] and len(decoded()) == 10
