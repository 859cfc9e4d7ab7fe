"""Frames of videos as a data source: partitions are stretches of frames of one video, and filters choose what is decoded."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .frames import FRAMES

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
ARROW = pa.schema([("video", pa.string()), ("frame", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("pixels", pa.binary())])
Count = Callable[[str], int]
Seek = Callable[[str, list[int]], Iterable[tuple[int, int, int, bytes]]]


@dataclass
class Stretch(InputPartition):
    video: str
    numbers: list[int] | range


class Reader(DataSourceReader):
    def __init__(self, videos: list[str], count: Count, seek: Seek, span: int, batch: int):
        self.videos, self.count, self.seek, self.span, self.batch = videos, count, seek, span, batch
        self.low, self.high, self.wanted = 0, None, None

    def _meet(self, numbers: Iterable[int]) -> None:
        self.wanted = set(numbers) if self.wanted is None else self.wanted & set(numbers)

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes filters on video and frame; gives back the others."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if isinstance(f, IsNotNull) and column in (("video",), ("frame",)):
                continue
            if column == ("video",) and isinstance(f, (EqualTo, In)):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.videos = [v for v in self.videos if v in named]
            elif column == ("frame",) and isinstance(f, EqualTo):
                self._meet([f.value])
            elif column == ("frame",) and isinstance(f, In):
                self._meet(v for v in f.value if v is not None)
            elif column == ("frame",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif column == ("frame",) and isinstance(f, (LessThan, LessThanOrEqual)):
                top = f.value - isinstance(f, LessThan)
                self.high = top if self.high is None else min(self.high, top)
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        out: list[Stretch] = []
        for video in self.videos:
            n = self.count(video)
            last = n - 1 if self.high is None else min(n - 1, self.high)
            if self.wanted is None:
                out += [Stretch(video, range(a, min(a + self.span, last + 1))) for a in range(self.low, last + 1, self.span)]
                continue
            groups: dict[int, list[int]] = {}
            for k in sorted(k for k in self.wanted if self.low <= k <= last):
                groups.setdefault(k // self.span, []).append(k)
            out += [Stretch(video, g) for g in groups.values()]
        return out or [Stretch("", [])]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for f in self.seek(partition.video, list(partition.numbers)) if len(partition.numbers) else ():
            held.append((partition.video, *f))
            if len(held) == self.batch:
                yield self._rows(held)
                held = []
        if held:
            yield self._rows(held)

    @staticmethod
    def _rows(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)


def frame_format(count: Count, seek: Seek, format_name: str = "frames") -> type[DataSource]:
    """A data source to register: count(path) is a video's number of frames, seek(path, numbers) yields (frame, width, height, pixels) of those asked for.

    Options: videos (paths, as a JSON list), span (frames of a partition), batch (frames handed over at a time).
    """

    class Frames(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def schema(self) -> str:
            return FRAMES

        def reader(self, schema: StructType) -> DataSourceReader:
            return Reader(json.loads(self.options["videos"]), count, seek, int(self.options.get("span", 256)), int(self.options.get("batch", 16)))

    return Frames


def read_frames(spark: SparkSession, videos: list[str], count: Count, seek: Seek, span: int = 256, batch: int = 16) -> DataFrame:
    """Frames of videos. Filters on video and frame are known before anything is decoded; one video is read by as many tasks as it has stretches of span frames."""
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(frame_format(count, seek))
    return spark.read.format("frames").options(videos=json.dumps(videos), span=span, batch=batch).load()
