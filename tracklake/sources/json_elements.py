"""Large JSON documents read by many tasks: the elements of the arrays and objects that a top-level object holds.

A file is cut into stretches of bytes anywhere. Whether a stretch begins within a string, and how deep, follows from
those before it: the parity of quotes doesn't depend on that state, so it is counted first; the change of depth is
counted for both cases. Then each stretch finds the elements that begin in it and reads on to the end of its last.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.storage import written
from .documents import store_of

#: Bytes of a stretch.
STRETCH = 4 << 20
QUOTE, BACKSLASH, COMMA, COLON = b'"\\,:'
DELTA = np.zeros(256, np.int8)
DELTA[list(b"{[")], DELTA[list(b"}]")] = 1, -1


def open_quotes(b: np.ndarray, before: int) -> np.ndarray:
    """Places of quotes that end or begin a string; before: backslashes right before the bytes."""
    quotes = np.flatnonzero(b == QUOTE)
    if not (b == BACKSLASH).any():
        return quotes[before % 2 :] if len(quotes) and quotes[0] == 0 else quotes
    plain = np.maximum.accumulate(np.r_[-1 - before, np.where(b != BACKSLASH, np.arange(len(b)), -1 - before)])
    return quotes[(quotes - 1 - plain[quotes]) % 2 == 0]


class Scan:
    """A stretch of bytes with the state it begins in: depth before each byte, and which bytes are outside strings."""

    def __init__(self, b: np.ndarray, before: int, in_string: bool, depth: int):
        quotes = open_quotes(b, before)
        marks = np.zeros(len(b), np.int8)
        marks[quotes] = 1
        inside = (np.cumsum(marks, dtype=np.int32) + in_string) % 2  # after each byte
        self.outside = np.r_[in_string, inside[:-1]] == 0 if len(b) else inside == 0
        self.opening = self.outside & (marks == 1)
        change = np.where(self.outside & (marks == 0), DELTA[b], 0)
        total = np.cumsum(change, dtype=np.int32)
        self.depth = depth + total - change
        self.after = bool(inside[-1]) if len(b) else in_string, depth + int(total[-1]) if len(b) else depth
        self.bytes = b


class Source:
    """Bytes of a file from a place on."""

    def __init__(self, path: str, at: int):
        store, root = store_of(path)
        self.file, self.at = store.open_input_file(root), at
        self.size = self.file.size()

    def __enter__(self) -> Source:
        return self

    def __exit__(self, *_) -> None:
        self.file.close()

    def backslashes(self) -> int:
        """How many are right before the place."""
        n = 0
        while n < self.at:
            take = min(1024, self.at - n)
            self.file.seek(self.at - n - take)
            raw = self.file.read(take)
            run = len(raw) - len(raw.rstrip(b"\\"))
            n += run
            if run < take:
                break
        return n

    def read(self, n: int) -> np.ndarray:
        self.file.seek(self.at)
        raw = self.file.read(min(n, self.size - self.at))
        self.at += len(raw)
        return np.frombuffer(raw, np.uint8)


def stretches(spark: SparkSession, path: str | list[str], stretch: int = STRETCH) -> DataFrame:
    """file, start and stop of all stretches of the files, dealt out evenly."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path).select(F.col("path").alias("file"), "length")
    return files.filter("length > 0").select("file", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(stretch).cast("long"))).alias("start")).select("file", "start", F.least(F.col("start") + stretch, "length").alias("stop"))


def dealt(cut: DataFrame, tasks: int) -> DataFrame:
    """Stretches spread over so many tasks; by number, as tables of a few small rows are otherwise put together again."""
    return cut.repartition(tasks, "file", "start")


def with_state(cut: DataFrame, tasks: int) -> DataFrame:
    """Adds in_string and depth at the start of each stretch, and the least depth in it; raises for a document that doesn't end outside of everything."""
    fields = ("start", "stop", "odd", "change", "change_inside", "low", "low_inside")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                with Source(r["file"], r["start"]) as source:
                    before = source.backslashes()
                    b = source.read(r["stop"] - r["start"])
                marks = np.zeros(len(b), np.uint8)
                marks[open_quotes(b, before)] = 1
                inside = (np.cumsum(marks, dtype=np.uint8) - marks) % 2  # before each byte, if the stretch begins outside
                total = [np.cumsum(DELTA[b[inside == i]], dtype=np.int64) for i in (0, 1)]
                ends = [int(t[-1]) if len(t) else 0 for t in total]
                rows.append((r["file"], r["start"], r["stop"], int(marks.sum(dtype=np.int64) % 2), *ends, *(min(0, int(t.min())) if len(t) else 0 for t in total)))
            columns = zip(*rows, strict=True) if rows else [[] for _ in range(len(fields) + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i else pa.string()) for i, c in enumerate(columns)], names=["file", *fields])

    counted = dealt(cut, tasks).mapInArrow(count, "file string, " + ", ".join(f"{c} long" for c in fields))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch
    state = counted.withColumn("in_string", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    inside = F.col("in_string") == 1
    state = state.withColumn("own", F.when(inside, F.col("change_inside")).otherwise(F.col("change")))
    state = state.withColumn("depth", F.coalesce(F.sum("own").over(before), F.lit(0)))
    state = state.withColumn("low", F.col("depth") + F.when(inside, F.col("low_inside")).otherwise(F.col("low")))
    state = written(state, "stretches")  # so all bytes are counted once
    ends = state.groupBy("file").agg((F.sum("odd") % 2).alias("odd"), F.sum("own").alias("depth")).filter("odd <> 0 or depth <> 0").limit(1).collect()
    if ends:
        raise ValueError(f"malformed JSON: {ends[0].file} ends within a string, an array or an object")
    return state.select("file", "start", "stop", "in_string", "depth", "low")


def _runs(start: int, stop: int, in_string: int, depth: int, source: Source, stretch: int) -> Iterator[tuple[int, Scan]]:
    """The stretch, and then what follows it as long as it is asked for, with the place of each."""
    before, at, take, state = source.backslashes(), start, stop - start, (bool(in_string), depth)
    while at < source.size:
        source.at = at
        scan = Scan(source.read(take), before, *state)
        yield at, scan
        raw = scan.bytes.tobytes()
        run = len(raw) - len(raw.rstrip(b"\\"))
        before = before + run if run == len(raw) else run
        at, take, state = at + take, stretch, scan.after


def _elements(r: dict, stretch: int) -> Iterator[tuple[str, int, str]]:
    """Section, place and text of the elements that begin in a stretch."""
    with Source(r["file"], r["start"]) as source:
        section, names, starts, ends, held = r["section"], [], None, [], []
        for at, scan in _runs(r["start"], r["stop"], r["in_string"], r["depth"], source, stretch):
            b, out = scan.bytes, scan.outside
            held.append(b)
            if starts is None:
                names = [(r["start"] + int(q)) for q in np.flatnonzero(scan.opening & (scan.depth == 1))]
                starts = at + np.flatnonzero(out & (((b == COMMA) & (scan.depth == 2)) | ((DELTA[b] == 1) & (scan.depth == 1))))
            ends.append(at + np.flatnonzero(out & (((b == COMMA) | (DELTA[b] == -1)) & (scan.depth == 2))))
            if not len(starts) or len(ends[-1]) and ends[-1][-1] > starts[-1]:
                break
        if starts is None or not len(starts):
            return
        whole, every = np.concatenate(held).tobytes(), np.concatenate(ends)
        keys = [(q, k) for q in names if (k := _key(whole, q - r["start"]))]
        stops = every[np.searchsorted(every, starts, "right")]
        for a, z in zip(starts.tolist(), stops.tolist(), strict=True):
            while keys and keys[0][0] < a:
                section = keys.pop(0)[1]
            text = whole[a - r["start"] + 1 : z - r["start"]].strip()
            if text:
                yield section, a, text.decode()


def _key(raw: bytes, at: int) -> str | None:
    """The string at a place if it is a key."""
    end = at + 1
    while end < len(raw) and raw[end] != QUOTE:
        end += 1 + (raw[end] == BACKSLASH)
    return raw[at + 1 : end].decode() if raw[end + 1 :].lstrip()[:1] == b":" else None


def with_section(state: DataFrame, tasks: int) -> DataFrame:
    """Adds section, the top-level key before the start of each stretch. Only stretches that come down to that level are read."""

    def last(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[str | None] = []
            for r in batch.to_pylist():
                if r["low"] > 1:
                    found.append(None)
                    continue
                with Source(r["file"], r["start"]) as source:
                    name, places, held = None, [], b""
                    for at, scan in _runs(r["start"], r["stop"], r["in_string"], r["depth"], source, 1024):
                        if at == r["start"]:
                            places = np.flatnonzero(scan.opening & (scan.depth == 1)).tolist()
                        held += scan.bytes.tobytes()
                        # a name that goes on behind the stretch is read to its colon
                        if not places or not scan.after[0] and held.rstrip()[-1:] != b'"':
                            break
                    for q in places:
                        name = _key(held, q) or name
                    found.append(name)
            yield batch.append_column("name", pa.array(found, pa.string()))

    named = dealt(state, tasks).mapInArrow(last, "file string, start long, stop long, in_string long, depth long, low long, name string")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return named.withColumn("section", F.last("name", ignorenulls=True).over(before)).drop("name", "low")


def elements(spark: SparkSession, path: str | list[str], stretch: int = STRETCH) -> DataFrame:
    """file, section, pos (of the element's separator) and text of all elements: `{...}` in an array, `"key": {...}` in an object. The text isn't checked: parse it with FAILFAST."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows, held = [], 0
                for section, pos, text in _elements(r, stretch):
                    rows.append((r["file"], section, pos, text))
                    held += len(text)
                    if held > STRETCH:
                        yield _batch(rows)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["file", "section", "pos", "text"])

    cut = stretches(spark, path, stretch)
    tasks = max(1, min(cut.count(), max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    return dealt(with_section(with_state(cut, tasks), tasks), tasks).mapInArrow(run, "file string, section string, pos long, text string")
