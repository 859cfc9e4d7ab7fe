"""Online multi-object tracking: a constant-velocity Kalman filter per animal and optimal association by overlap.

After the description in "Simple Online and Realtime Tracking" (arXiv 1602.00763). A box is observed
as centre, area and aspect ratio; centre and area have velocities. The filter's matrices work on
all tracks of a frame at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ordering import same_rows, starts_group, sum_before
from ..functions.storage import written
from .assignment import chosen_links, clusters, maximum_assignment

#: Fixed values of the filter: measurement, initial and process noise, each a diagonal.
MEASURED = np.array([1.0, 1.0, 10.0, 10.0])
INITIAL = np.array([10.0, 10.0, 10.0, 10.0, 1e4, 1e4, 1e4])
PROCESS = np.array([1.0, 1.0, 1.0, 1.0, 1e-2, 1e-2, 1e-4])

#: Frames that are summed up in one row when long sequences are ordered.
STRETCH = 4096

#: Pairs of boxes of a step up to which all are compared; beyond, only those that share a cell of a grid.
DENSE = 1 << 12
#: Rows of a sequence from which it is tracked as it comes; shorter ones are tracked side by side.
LONG = 20000

MOTION = np.eye(7)
MOTION[[0, 1, 2], [4, 5, 6]] = 1.0


@dataclass(frozen=True)
class Settings:
    max_age: int = 10
    min_hits: int = 1
    iou_threshold: float = 0.1


def observed(boxes: np.ndarray) -> np.ndarray:
    """xyxy boxes as centre, area, ratio."""
    w, h = boxes[:, 2] - boxes[:, 0], boxes[:, 3] - boxes[:, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.c_[boxes[:, 0] + w / 2, boxes[:, 1] + h / 2, w * h, w / h]


def boxed(state: np.ndarray) -> np.ndarray:
    """The boxes of states; nan where area times ratio is negative."""
    with np.errstate(divide="ignore", invalid="ignore"):
        w = np.sqrt(state[:, 2] * state[:, 3])
        h = state[:, 2] / w
    return np.c_[state[:, 0] - w / 2, state[:, 1] - h / 2, state[:, 0] + w / 2, state[:, 1] + h / 2]


def overlaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap of every box of a with every box of b."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:4], b[None, :, 2:4])
    shared = np.clip(high - low, 0, None).prod(axis=2)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    total = area(a)[:, None] + area(b)[None, :] - shared
    return np.divide(shared, total, out=np.zeros_like(shared), where=total > 0)


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Overlap of each box of a with the one of b beside it."""
    low, high = np.maximum(a[:, :2], b[:, :2]), np.minimum(a[:, 2:4], b[:, 2:4])
    shared = np.clip(high - low, 0, None).prod(axis=1)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    total = area(a) + area(b) - shared
    return np.divide(shared, total, out=np.zeros_like(shared), where=total > 0)


def _same(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each value of a the first place and the number of equal ones in sorted b, and their total."""
    low = np.searchsorted(b, a, "left")
    n = np.searchsorted(b, a, "right") - low
    return low, n, int(n.sum())


def _listed(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a, and the places in b that _same() found for them."""
    return np.repeat(np.arange(len(n)), n), np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())


def meeting(a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (of a, of b) of boxes of one owner, all of those that overlap among them."""
    by_owner = np.argsort(of_b, kind="stable")
    low, n, total = _same(of_a, of_b[by_owner])
    if total <= max(DENSE, 8 * (len(a) + len(b))):
        i, at = _listed(low, n)
        return i, by_owner[at]
    both = np.r_[a, b]
    size = np.maximum(both[:, 2] - both[:, 0], both[:, 3] - both[:, 1])
    cell = 2 * max(float(np.median(size[np.isfinite(size) & (size > 0)])) if (size > 0).any() else 0.0, 1e-9)
    proper = (both[:, 2] > both[:, 0]) & (both[:, 3] > both[:, 1])
    with np.errstate(invalid="ignore"):
        wide = proper & ~((size <= 8 * cell) & (np.abs(both) < cell * 2.0**40).all(axis=1))

    def celled(boxes: np.ndarray, owner: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        corner = np.floor(boxes[which] / cell).astype(np.int64)
        nx, ny = corner[:, 2] - corner[:, 0] + 1, corner[:, 3] - corner[:, 1] + 1
        at, nth = _listed(np.zeros(len(which), np.int64), nx * ny)
        x, y = corner[at, 0] + nth % nx[at], corner[at, 1] + nth // nx[at]
        return which[at], (owner[which[at]] * np.int64(1000003) + x) * np.int64(6364136223846793005) + y

    wide_a, wide_b = wide[: len(a)], wide[len(a) :]
    ia, codes_a = celled(a, of_a, np.flatnonzero(proper[: len(a)] & ~wide_a))
    ib, codes_b = celled(b, of_b, np.flatnonzero(proper[len(a) :] & ~wide_b))
    order = np.argsort(codes_b, kind="stable")
    i, at = _listed(*_same(codes_a, codes_b[order])[:2])
    pairs = [ia[i] * len(b) + ib[order[at]]]
    if wide.any():  # with all boxes of the owner
        i, at = _listed(low[wide_a], n[wide_a])
        pairs.append(np.flatnonzero(wide_a)[i] * len(b) + by_owner[at])
        order = np.argsort(of_a, kind="stable")
        i, at = _listed(*_same(of_b[wide_b], of_a[order])[:2])
        pairs.append(order[at] * len(b) + np.flatnonzero(wide_b)[i])
    i, j = np.divmod(np.unique(np.concatenate(pairs)), len(b))
    same = of_a[i] == of_b[j]
    return i[same], j[same]


def associate(detections: np.ndarray, tracks: np.ndarray, threshold: float, of_detections: np.ndarray | None = None, of_tracks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (detection, track), and detections without a track. of_...: the sequence of each, if they are of several.

    Overlaps of a sequence above the threshold are taken as they are if they are one to one already; else the
    assignment with the largest sum, without its pairs below the threshold. It is found for each cluster of boxes that overlap.
    """
    n, m = len(detections), len(tracks)
    every = np.arange(n)
    if not n or not m:
        return np.zeros((0, 2), int), every
    if of_detections is None:
        of_detections, of_tracks = np.zeros(n, np.int64), np.zeros(m, np.int64)
    if threshold <= 0:  # boxes that don't overlap may be paired
        found = []
        for k in np.unique(of_detections):
            d, t = np.flatnonzero(of_detections == k), np.flatnonzero(of_tracks == k)
            gain = overlaps(detections[d], tracks[t])
            above = gain > threshold
            plain = above.any() and above.sum(axis=0).max() == 1 and above.sum(axis=1).max() == 1
            pairs = np.argwhere(above) if plain else maximum_assignment(gain)
            pairs = pairs if plain else pairs[gain[pairs[:, 0], pairs[:, 1]] >= threshold]
            found.append(np.c_[d[pairs[:, 0]], t[pairs[:, 1]]])
        pairs = np.concatenate(found)
        return pairs, np.setdiff1d(every, pairs[:, 0])
    i, j = meeting(detections, tracks, of_detections, of_tracks)
    gain = overlap(detections[i], tracks[j])
    shared = gain > 0
    i, j, gain = i[shared], j[shared], gain[shared]
    above = gain > threshold
    twice = (np.bincount(i[above], minlength=n)[i] > 1) | (np.bincount(j[above], minlength=m)[j] > 1)
    taken = above
    if twice.any() or (gain == threshold).any():
        # an overlap at the threshold itself counts only where no other of the sequence is above
        owner, edge = of_detections[i], gain == threshold
        solved = np.isin(owner, np.r_[owner[twice], np.setdiff1d(owner[edge], owner[above])])
        use = np.flatnonzero(solved)
        left, right = (np.unique(x[use], return_inverse=True)[1] for x in (i, j))
        taken = above & ~solved
        taken[use] = chosen_links(left, right, gain[use], clusters(left, right)) & (gain[use] >= threshold)
    left_over = np.ones(n, bool)
    left_over[i[taken]] = False
    return np.c_[i[taken], j[taken]], every[left_over]


@dataclass
class Tracker:
    """The tracks of one sequence, in order of creation."""

    settings: Settings = Settings()
    frame_count: int = 0
    next_id: int = 1
    mean: np.ndarray = field(default_factory=lambda: np.zeros((0, 7)))
    spread: np.ndarray = field(default_factory=lambda: np.zeros((0, 7, 7)))
    #: id, frames since the last match, matches in a row
    marks: np.ndarray = field(default_factory=lambda: np.zeros((0, 3), np.int64))

    def _keep(self, which: np.ndarray) -> None:
        self.mean, self.spread, self.marks = self.mean[which], self.spread[which], self.marks[which]

    def _predict(self) -> None:
        shrinking = self.mean[:, 2] + self.mean[:, 6] <= 0
        self.mean[shrinking, 6] = 0.0
        self.mean = self.mean @ MOTION.T
        self.spread = MOTION @ self.spread @ MOTION.T + np.diag(PROCESS)
        self.marks[self.marks[:, 1] > 0, 2] = 0
        self.marks[:, 1] += 1

    def _correct(self, which: np.ndarray, seen: np.ndarray) -> None:
        spread = self.spread[which]
        doubt = spread[:, :4, :4] + np.diag(MEASURED)
        weight = spread[:, :, :4] @ np.linalg.inv(doubt)
        off = seen - self.mean[which, :4]
        self.mean[which] += (weight @ off[:, :, None])[:, :, 0]
        rest = np.eye(7) - weight @ np.eye(4, 7)
        self.spread[which] = rest @ spread @ rest.transpose(0, 2, 1) + weight @ np.diag(MEASURED) @ weight.transpose(0, 2, 1)
        self.marks[which, 1] = 0
        self.marks[which, 2] += 1

    def update(self, boxes: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes a frame's detections; gives boxes, ids and scores of the tracks it shows, the newest first. To be called for empty frames too."""
        boxes = np.asarray(boxes, float).reshape(-1, 4)
        scores = np.asarray(scores, float)
        self.frame_count += 1
        self._predict()
        self._keep(~np.isnan(boxed(self.mean)).any(axis=1))
        pairs, fresh = associate(boxes, boxed(self.mean), self.settings.iou_threshold)
        shown = np.full(len(self.mean), np.nan)
        if len(pairs):
            self._correct(pairs[:, 1], observed(boxes[pairs[:, 0]]))
            shown[pairs[:, 1]] = scores[pairs[:, 0]]
        if len(fresh):
            born = np.c_[observed(boxes[fresh]), np.zeros((len(fresh), 3))]
            self.mean = np.r_[self.mean, born]
            self.spread = np.r_[self.spread, np.tile(np.diag(INITIAL), (len(fresh), 1, 1))]
            ids = self.next_id + np.arange(len(fresh))
            self.marks = np.r_[self.marks, np.c_[ids, np.zeros((len(fresh), 2), np.int64)]]
            shown = np.r_[shown, scores[fresh]]
            self.next_id += len(fresh)
        steady = (self.marks[:, 2] >= self.settings.min_hits) | (self.frame_count <= self.settings.min_hits)
        out = np.flatnonzero((self.marks[:, 1] < 1) & steady)[::-1]
        result = boxed(self.mean[out]), self.marks[out, 0].copy(), shown[out]
        self._keep(self.marks[:, 1] <= self.settings.max_age)
        return result


class Trackers(Tracker):
    """The tracks of many sequences side by side; owner: the sequence of each track. counts: frames before each sequence."""

    def __init__(self, settings: Settings, counts: np.ndarray):
        super().__init__(settings)
        self.counts, self.next_ids, self.owner = counts, np.ones(len(counts), np.int64), np.zeros(0, np.int64)

    def _keep(self, which: np.ndarray) -> None:
        super()._keep(which)
        self.owner = self.owner[which]

    def tracks(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Means, spreads, marks and owners of some tracks."""
        return self.mean[which], self.spread[which], self.marks[which], self.owner[which]

    def step(self, boxes: np.ndarray, scores: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As update() of each sequence, with detections in order of sequences; gives the sequences of the shown tracks too, the newest first."""
        self.frame_count += 1
        self._predict()
        self._keep(~np.isnan(boxed(self.mean)).any(axis=1))
        pairs, fresh = associate(boxes, boxed(self.mean), self.settings.iou_threshold, of, self.owner)
        shown = np.full(len(self.mean), np.nan)
        if len(pairs):
            self._correct(pairs[:, 1], observed(boxes[pairs[:, 0]]))
            shown[pairs[:, 1]] = scores[pairs[:, 0]]
        if len(fresh):
            owner, first, births = np.unique(of[fresh], return_index=True, return_counts=True)
            ids = self.next_ids[of[fresh]] + np.arange(len(fresh)) - np.repeat(first, births)
            self.mean = np.r_[self.mean, np.c_[observed(boxes[fresh]), np.zeros((len(fresh), 3))]]
            self.spread = np.r_[self.spread, np.tile(np.diag(INITIAL), (len(fresh), 1, 1))]
            self.marks = np.r_[self.marks, np.c_[ids, np.zeros((len(fresh), 2), np.int64)]]
            self.owner, shown = np.r_[self.owner, of[fresh]], np.r_[shown, scores[fresh]]
            self.next_ids[owner] += births
        least = self.settings.min_hits
        steady = (self.marks[:, 2] >= least) | (self.counts[self.owner] + self.frame_count <= least)
        out = np.flatnonzero((self.marks[:, 1] < 1) & steady)[::-1]
        result = boxed(self.mean[out]), self.marks[out, 0].copy(), shown[out], self.owner[out]
        self._keep(self.marks[:, 1] <= self.settings.max_age)
        return result


def track_schema(df: DataFrame, keys: list[str]) -> T.StructType:
    fields = [df.schema[k] for k in keys]
    return T.StructType(
        [*fields, T.StructField("frame", T.IntegerType()), T.StructField("emit_idx", T.IntegerType()), T.StructField("track_id", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in ("x1", "y1", "x2", "y2", "score")]
    )


def run_frames(tracker: Tracker, rows: pd.DataFrame, keys: Iterable[str], key: tuple, after: int | None = None) -> pd.DataFrame:
    """Feeds rows sorted by frame, with empty updates for frames that have none between the first (or `after`) and the last."""
    rows = rows.sort_values(["frame", "det_idx"], kind="stable")
    frames = rows.frame.to_numpy()
    out: list[np.ndarray] = []
    if len(rows):
        first = int(frames[0]) if after is None else after + 1
        starts = np.searchsorted(frames, np.arange(first, int(frames[-1]) + 2))
        boxes, scores = rows[["x1", "y1", "x2", "y2"]].to_numpy(float), rows.score.to_numpy(float)
        real = ~np.isnan(boxes[:, 0])  # a row without a box stands for an empty frame
        for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            use = np.arange(a, b)[real[a:b]]
            box, ids, score = tracker.update(boxes[use], scores[use])
            if len(ids):
                out.append(np.c_[np.full(len(ids), first + i), np.arange(len(ids)), ids, box, score])
    table = np.concatenate(out) if out else np.zeros((0, 8))
    result = pd.DataFrame({k: pd.Series([v] * len(table), dtype=object) for k, v in zip(keys, key, strict=True)})
    result["frame"], result["emit_idx"], result["track_id"] = table[:, 0].astype(np.int32), table[:, 1].astype(np.int32), table[:, 2].astype(np.int64)
    for i, c in enumerate(("x1", "y1", "x2", "y2", "score")):
        result[c] = table[:, 3 + i]
    return result


def run_together(rows: pd.DataFrame, group: np.ndarray, trackers: Trackers, after: np.ndarray | None = None) -> tuple[pd.DataFrame, np.ndarray]:
    """Tracks sequences, numbered by group, side by side; gives their tracks with the group as column, and their last frames.

    after: the frame before each sequence's first step, or nan. In the end trackers has the tracks that each sequence ends with.
    """
    frame = rows.frame.to_numpy(np.int64)
    starts = np.r_[0, np.flatnonzero(np.diff(group)) + 1]
    first, last = np.minimum.reduceat(frame, starts), np.maximum.reduceat(frame, starts)
    if after is not None:
        first = np.where(np.isnan(after), first, after + 1).astype(np.int64)
    order = np.lexsort((rows.det_idx.to_numpy(float), group, frame - first[group]))
    group, boxes, scores = group[order], rows[["x1", "y1", "x2", "y2"]].to_numpy(float)[order], rows.score.to_numpy(float)[order]
    steps, at = np.unique(frame[order] - first[group], return_index=True)
    ends = np.r_[at[1:], len(order)]
    real = ~np.isnan(boxes[:, 0])  # a row without a box stands for an empty frame
    out, ended, step = [], [], 0
    for nth, (a, b) in zip(steps.tolist(), zip(at.tolist(), ends.tolist(), strict=True), strict=True):
        while step <= nth:
            if step < nth and not len(trackers.marks):
                trackers.frame_count, step = nth, nth
            use = np.arange(a, b)[real[a:b]] if step == nth else np.zeros(0, int)
            goes_on = (last - first)[trackers.owner] >= step
            if not goes_on.all():
                ended.append(trackers.tracks(~goes_on))
                trackers._keep(goes_on)
            box, ids, score, of = trackers.step(boxes[use], scores[use], group[use])
            if len(ids):
                by = np.argsort(of, kind="stable")
                n = np.bincount(of)
                n = n[n > 0]
                out.append(np.c_[of[by], first[of[by]] + step, np.arange(len(by)) - np.repeat(np.cumsum(n) - n, n), ids[by], box[by], score[by]])
            step += 1
    ended.append(trackers.tracks(np.ones(len(trackers.marks), bool)))
    trackers.mean, trackers.spread, trackers.marks, trackers.owner = (np.concatenate(parts) for parts in zip(*ended, strict=True))
    table = np.concatenate(out) if out else np.zeros((0, 9))
    columns = {c: table[:, i].astype(np.int64) for i, c in enumerate(("group", "frame", "emit_idx", "track_id"))}
    return pd.DataFrame(columns | {c: table[:, 4 + i] for i, c in enumerate(("x1", "y1", "x2", "y2", "score"))}), last


def _run(keys: list[str], settings: Settings, pieces: bool = False) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Tracks sequences that come sorted, batch by batch: those that a few batches hold side by side, longer ones as they come.

    pieces: the last key is the number of frames before a piece, which ends with a row (emit_idx -1) that has its births as track_id.
    """
    zeros = dict.fromkeys(("x1", "y1", "x2", "y2", "score"), 0.0)

    def together(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
        new = starts_group(rows, keys)
        named = rows[new].reset_index(drop=True)
        counts = named[keys[-1]].to_numpy(np.int64) if pieces else np.zeros(len(named), np.int64)
        trackers = Trackers(settings, counts)
        out, last = run_together(rows, np.cumsum(new) - 1, trackers)
        if pieces:
            ends = pd.DataFrame({"group": np.arange(len(named)), "frame": last, "emit_idx": -1, "track_id": trackers.next_ids - 1, **zeros})
            out = pd.concat([out, ends], ignore_index=True)
        of = out.pop("group")
        for at, k in enumerate(keys):
            value = named[k].take(of).reset_index(drop=True)
            out.insert(at, k, value.astype(object).where(value.notna(), None) if value.isna().any() else value)
        yield out.astype({"frame": np.int32, "emit_idx": np.int32})

    class Long:
        """One sequence that is tracked as it comes; its last frame may go on in the next batch."""

        def __init__(self, row: pd.DataFrame):
            self.key = tuple(None if pd.isna(v) else v for v in (row[k].iloc[0] for k in keys))
            self.tracker, self.last, self.open = Tracker(settings, int(self.key[-1]) if pieces else 0), None, []

        def feed(self, rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            going_on = rows.frame.to_numpy() == rows.frame.iloc[-1]
            if self.open and (self.open[-1].frame.iloc[-1] != rows.frame.iloc[0] or not going_on.all()) or not going_on.all():
                yield self.track(pd.concat([*self.open, rows[~going_on]]))
                self.open = []
            self.open.append(rows[going_on])

        def track(self, rows: pd.DataFrame) -> pd.DataFrame:
            out = run_frames(self.tracker, rows, keys, self.key, self.last)
            self.last = int(rows.frame.max())
            return out

        def done(self) -> Iterator[pd.DataFrame]:
            yield self.track(pd.concat(self.open))
            if pieces:
                yield pd.DataFrame([dict(zip(keys, self.key, strict=True), frame=self.last, emit_idx=-1, track_id=self.tracker.next_id - 1, **zeros)])

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before: pd.DataFrame | None = None
        held, long = [], None
        for pdf in batches:
            if not len(pdf):
                continue
            joined = pd.concat([before, pdf]) if before is not None else pdf
            at = np.flatnonzero(starts_group(joined, keys)[len(joined) - len(pdf) :]) if before is not None else np.flatnonzero(starts_group(pdf, keys))
            before, begin = pdf.tail(1), 0
            if long is not None:
                begin = int(at[0]) if len(at) else len(pdf)
                if begin:
                    yield from long.feed(pdf.iloc[:begin])
                if not len(at):
                    continue
                yield from long.done()
                long = None
            if len(at):
                if at[-1] > begin:
                    held.append(pdf.iloc[begin : at[-1]])
                if held:
                    yield from together(held)
                held = []
                begin = int(at[-1])
            held.append(pdf.iloc[begin:])
            if sum(map(len, held)) > LONG:
                long = Long(held[0])
                for part in held:
                    yield from long.feed(part)
                held = []
        if long is not None:
            yield from long.done()
        if held:
            yield from together(held)

    return run


def track(detections: DataFrame, keys: list[str], settings: Settings = Settings(), score: float | None = None) -> DataFrame:
    """Tracks of detections(keys..., frame, det_idx, x1..y2, score). Sequences run in parallel, frames of one in order.

    A null box marks a frame without detections; frames between a sequence's first and last row count as such.
    A task reads its sequences sorted, batch by batch. Short ones are tracked side by side; of a long one it holds the live tracks and one frame,
    whose boxes meet in cells, so no matrix of a whole frame is built.
    """
    if score is not None:
        detections = detections.filter((F.col("score") > score) | F.col("x1").isNull())
    columns = [*keys, "frame", "det_idx", "x1", "y1", "x2", "y2", "score"]
    order = [*keys, "frame", "det_idx"]
    return detections.select(*columns).repartition(*keys).sortWithinPartitions(*order).mapInPandas(_run(keys, settings), track_schema(detections, keys))


def cut_frames(detections: DataFrame, keys: list[str], max_age: int, stretch: int = STRETCH) -> DataFrame:
    """keys, frame, piece and counted of each frame with a box: a piece starts after more than max_age frames without one.

    No track outlives such a gap, so pieces can be tracked apart. piece: its first frame; counted: frames of the sequence before it.
    Only a summary a stretch of frames is ordered by sequence, so one long sequence needs no task of its own.
    """
    frames = detections.groupBy(*keys, "frame").agg((F.count("x1") > 0).alias("seen")).withColumn("stretch", F.floor(F.col("frame") / stretch))
    frames = written(frames, "frames")
    within = Window.partitionBy(*keys, "stretch").orderBy("frame")
    before = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    summary = frames.groupBy(*keys, "stretch").agg(F.min("frame").alias("low"), F.max(F.when(F.col("seen"), F.col("frame"))).alias("high"))
    summary = summary.select(*keys, "stretch", F.min("low").over(Window.partitionBy(*keys)).alias("first"), F.last("high", ignorenulls=True).over(before).alias("prior"))
    seen = same_rows(frames.filter("seen").drop("seen"), summary, [*keys, "stretch"])
    gap = F.col("frame") - F.coalesce(F.lag("frame").over(within), "prior")
    cut = written(seen.withColumn("cut", F.when(gap.isNull() | (gap > max_age + 1), F.col("frame"))), "cuts", [frames])
    carried = cut.groupBy(*keys, "stretch").agg(F.max("cut").alias("high"))
    carried = carried.select(*keys, "stretch", F.last("high", ignorenulls=True).over(before).alias("carried"))
    piece = F.coalesce(F.last("cut", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, 0)), "carried")
    return same_rows(cut, carried, [*keys, "stretch"]).select(*keys, "frame", piece.alias("piece"), (piece - F.col("first")).alias("counted"))


def track_in_pieces(detections: DataFrame, keys: list[str], settings: Settings = Settings(), score: float | None = None, stretch: int = STRETCH) -> DataFrame:
    """As track(), with the pieces of a sequence (see cut_frames) in parallel: for long sequences with pauses.

    A piece starts with the sequence's count of frames, and its ids follow those of all births before it.
    """
    if score is not None:
        detections = detections.filter((F.col("score") > score) | F.col("x1").isNull())
    columns = [*keys, "frame", "det_idx", "x1", "y1", "x2", "y2", "score"]
    found = same_rows(detections.filter(F.col("x1").isNotNull()).select(*columns), cut_frames(detections, keys, settings.max_age, stretch), [*keys, "frame"])
    parts = [*keys, "piece", "counted"]
    schema = track_schema(found, parts)
    pieces = found.repartition(*parts).sortWithinPartitions(*parts, "frame", "det_idx").mapInPandas(_run(parts, settings, pieces=True), schema)
    pieces = written(pieces, "pieces")
    born = sum_before(pieces.filter("emit_idx = -1").select(*keys, "piece", F.col("track_id").alias("born")), keys, "piece", "born", "earlier", stretch)
    out = same_rows(pieces.filter("emit_idx >= 0"), born.select(*keys, "piece", "earlier"), [*keys, "piece"])
    return out.withColumn("track_id", F.col("track_id") + F.col("earlier")).select(*keys, "frame", "emit_idx", "track_id", "x1", "y1", "x2", "y2", "score")
