"""Tracking of a stream of detections; each sequence keeps its live tracks as typed state, a row a track."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.ordering import free_column
from ..operators.tracker import Settings, Trackers, run_together, track_schema

DETECTION = ["frame", "det_idx", "x1", "y1", "x2", "y2", "score"]
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Groups that sequences are dealt to; those of a group are tracked side by side.
GROUPS = 512


class TrackProcessor(StatefulProcessor):
    """The sequences of a group. Frames that may still get rows wait in a map by sequence and frame; those that are complete go through the filter in order.

    Only the state of sequences that have rows in a batch is read and written.
    """

    def __init__(self, keys: list[T.StructField], settings: Settings, lateness: int, idle_ms: int | None):
        self.fields, self.settings, self.lateness, self.idle_ms = keys, settings, lateness, idle_ms
        self.keys = [f.name for f in keys]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        by = lambda *more: T.StructType([*(T.StructField(f"key{i}", f.dataType) for i, f in enumerate(self.fields)), *more])
        self.clock = handle.getMapState("clock", by(), "frames long, next_id long, last_frame int, newest int, live array<long>, waiting array<int>")
        self.tracks = handle.getMapState("tracks", by(T.StructField("track_id", T.LongType())), "since int, hits int, mean array<double>, spread array<double>")
        self.waiting = handle.getMapState("waiting", by(T.StructField("frame", T.IntegerType())), "rows array<double>")
        self.due = handle.getMapState("due", by(), "at long") if self.idle_ms is not None else None

    def _names(self, rows: pd.DataFrame) -> list[tuple]:
        """The keys of rows as the state has them."""

        def plain(v: Any, kind: T.DataType) -> Any:
            if pd.isna(v):
                return None
            return int(v) if isinstance(kind, T.IntegralType) else v.item() if isinstance(v, np.generic) else v

        columns = ([plain(v, f.dataType) for v in rows[f.name]] for f in self.fields)
        return list(zip(*columns, strict=True))

    def _clock(self, name: tuple) -> list:
        """Frames, next id, last frame tracked, newest frame seen, live ids, frames that wait."""
        return list(self.clock.getValue(name) or (0, 1, None, None, [], []))

    def _held(self, names: list[tuple], clocks: list[list]) -> pd.DataFrame:
        """The rows that wait, with the number of their sequence."""
        found = []
        for of, (name, clock) in enumerate(zip(names, clocks, strict=True)):
            for frame in clock[5]:
                rows = np.reshape(self.waiting.getValue((*name, frame))[0], (-1, 6))
                found.append(np.c_[np.full(len(rows), of), np.full(len(rows), frame), rows])
        table = np.concatenate(found) if found else np.zeros((0, 8))
        return pd.DataFrame(table, columns=["of", *DETECTION]).astype({"of": np.int64, "frame": np.int64})

    def _track(self, rows: pd.DataFrame, names: list[tuple], clocks: list[list]) -> pd.DataFrame:
        """Tracks complete frames and stores the live tracks; clocks are brought up to date, not stored."""
        rows = rows.sort_values("of", kind="stable")
        which, group = np.unique(rows["of"].to_numpy(), return_inverse=True)
        trackers = Trackers(self.settings, np.array([clocks[i][0] for i in which], np.int64))
        trackers.next_ids = np.array([clocks[i][1] for i in which], np.int64)
        after = np.array([np.nan if clocks[i][2] is None else clocks[i][2] for i in which], float)
        live = [(nth, track, *self.tracks.getValue((*names[i], track))) for nth, i in enumerate(which) for track in clocks[i][4]]
        if live:
            trackers.owner = np.array([t[0] for t in live], np.int64)
            trackers.marks = np.array([t[1:4] for t in live], np.int64)
            trackers.mean = np.array([t[4] for t in live], float)
            trackers.spread = np.array([t[5] for t in live], float).reshape(-1, 7, 7)
        out, last = run_together(rows, group, trackers, after)
        starts = np.where(np.isnan(after), np.minimum.reduceat(rows.frame.to_numpy(np.int64), np.unique(group, return_index=True)[1]), after + 1)
        ids: list[list[int]] = [[] for _ in which]
        means, spreads = trackers.mean.tolist(), trackers.spread.reshape(-1, 49).tolist()
        for of, (track, since, hits), mean, spread in zip(trackers.owner.tolist(), trackers.marks.tolist(), means, spreads, strict=True):
            ids[of].append(track)
            self.tracks.updateValue((*names[which[of]], track), (since, hits, mean, spread))
        for nth, i in enumerate(which):
            for track in set(clocks[i][4]).difference(ids[nth]):
                self.tracks.removeKey((*names[i], track))
            clocks[i][:3] = clocks[i][0] + int(last[nth] - starts[nth]) + 1, int(trackers.next_ids[nth]), int(last[nth])
            clocks[i][4] = ids[nth]
        of = which[out.pop("group").to_numpy()].tolist()
        for at, k in enumerate(self.keys):
            out.insert(at, k, pd.Series([names[i][at] for i in of], dtype=object))
        return out.astype({"frame": np.int32, "emit_idx": np.int32})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        came = pd.concat(list(rows), ignore_index=True)
        of = came.groupby(self.keys, dropna=False, sort=False).ngroup()
        names = self._names(came[~of.duplicated()])
        clocks = [self._clock(name) for name in names]
        came = came[DETECTION].assign(of=of.to_numpy(np.int64))
        last = np.array([np.nan if c[2] is None else c[2] for c in clocks], float)
        came = came[~(came.frame.to_numpy() <= last[came["of"]])]  # rows of a frame that has been tracked are late
        for i, frame in came.groupby("of").frame.max().items():
            clocks[i][3] = int(frame) if clocks[i][3] is None else max(int(frame), clocks[i][3])
        held = self._held(names, clocks) if self.lateness else came[:0]
        every = pd.concat([held, came], ignore_index=True) if len(held) else came
        newest = np.array([-np.inf if c[3] is None else c[3] for c in clocks], float)
        whole = every.frame.to_numpy() <= newest[every["of"]] - self.lateness
        if whole.any():
            yield self._track(every[whole], names, clocks)
        if self.lateness:
            still: list[list[int]] = [[] for _ in names]
            new = set(zip(came["of"], came.frame, strict=True))
            for (i, frame), part in every[~whole].groupby(["of", "frame"]):
                still[i].append(int(frame))
                if (i, frame) in new:
                    self.waiting.updateValue((*names[i], int(frame)), (part[DETECTION[1:]].to_numpy(float).ravel().tolist(),))
            for name, clock, frames in zip(names, clocks, still, strict=True):
                for frame in set(clock[5]).difference(frames):
                    self.waiting.removeKey((*name, frame))
                clock[5] = frames
        for name, clock in zip(names, clocks, strict=True):
            self.clock.updateValue(name, tuple(clock))
        if self.idle_ms is not None:
            at = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            for name in names:
                self.due.updateValue(name, (at,))
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """Ends sequences without rows for idle_ms: frames that wait are tracked, and all tracks closed. Ids go on from there."""
        now = expiredTimerInfo.getExpiryTimeInMs()
        names = [tuple(name) for name, (at,) in self.due.iterator() if at <= now]  # others had rows since
        clocks = [self._clock(name) for name in names]
        held = self._held(names, clocks)
        if len(held):
            yield self._track(held, names, clocks)
        for name, clock in zip(names, clocks, strict=True):
            for track in clock[4]:
                self.tracks.removeKey((*name, track))
            for frame in clock[5]:
                self.waiting.removeKey((*name, frame))
            clock[4:] = [], []
            self.clock.updateValue(name, tuple(clock))
            self.due.removeKey(name)

    def close(self) -> None:
        pass


def typed_state(spark: SparkSession) -> None:
    """Lets the session keep typed state (in RocksDB) where it has Spark's default store."""
    if "HDFSBacked" in spark.conf.get(PROVIDER, "HDFSBacked"):
        spark.conf.set(PROVIDER, ROCKS)


def track_stream(detections: DataFrame, keys: list[str], settings: Settings = Settings(), lateness: int = 0, idle_ms: int | None = None, groups: int = GROUPS) -> DataFrame:
    """As `track`, over a stream.

    lateness: frames that a sequence waits for further rows, in any order, before it tracks a frame. Rows of a frame
    that has been tracked are late and dropped; with 0, frames come whole, and in order from batch to batch.
    idle_ms: time without rows after which a sequence's waiting frames are tracked and its tracks are closed
    (none: never); without it the last `lateness` frames need a row with a null box so many frames later.
    groups: sequences are dealt to so many by a hash of their keys; a task holds a batch's rows of one group. It stays as it is while a checkpoint is used.
    """
    typed_state(detections.sparkSession)
    mode = "None" if idle_ms is None else "ProcessingTime"
    group = free_column(detections, "group")
    processor = TrackProcessor([detections.schema[k] for k in keys], settings, lateness, idle_ms)
    dealt = detections.select(*keys, *DETECTION, F.pmod(F.hash(*keys), F.lit(groups)).alias(group))
    return dealt.groupBy(group).transformWithStateInPandas(processor, track_schema(detections, keys), "Append", mode)
