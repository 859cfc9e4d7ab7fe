"""Removal of long repeated strings by a run-length index over aligned contexts.

A string of `length` bytes is repeated if it also starts anywhere else; every byte that a repeated
string covers is marked. Several lengths are answered at once, from one index.

1. Every string of the shortest length selects one of its GRAM-byte strings, the one with the least
   hash, so equal strings select equal grams at equal places (winnowing). Only selected grams, the
   anchors, are looked at. An anchor's context, from shortest - GRAM bytes before it to longest bytes
   from its start, holds every asked-for string whose first `shortest` bytes select it.
2. Anchors meet by hash range as packed blocks; of equal contexts (128-bit hashes) in one task one is
   sent, so whole copies and common passages don't pile up. A context that occurs twice is repeated as
   a whole and needs no text. Of anchors with different contexts, one occurrence of each goes on.
3. Their contexts are read and grouped by anchor. For a block of groups a run-length index is built
   (`RunLengthIndex`): the Burrows-Wheeler transform of the contexts place by place, kept as runs with
   the contexts at both ends of each run as samples. Matching statistics are streamed over the runs:
   inside a run a context keeps its neighbours and its match grows by one byte; only at run ends the
   neighbour is the sample of the next run, and the length is found anew from the two samples. Match
   lengths that reach an asked-for length mark a repeat.
4. The marked spans of a document are united and cut from its bytes.

The distinct contexts of one anchor are held in one task (`width` bytes and some 60 more each).

Null or empty text, or one shorter than the length: nothing is removed. Long texts are looked at in
parts of PIECE bytes that overlap by a context, and are never shortened. Repeated rows are repeats of
each other, also rows that share a doc_id; of equal matches it makes no difference which is found. A
null doc_id is kept as such. Extra columns are ignored by repeated_bytes() and kept by cut_repeats(),
which drops a character whole if one of its bytes goes. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FACTORS, Hashes, free_name, mix, partitions, slices, small_batches, written

#: Bytes that make a string long; of a passage of some 50 words, which has 310 bytes on average and 240 nearly always.
LENGTH, PASSAGE = 400, 240
GRAM = 64
#: Bytes of a long document that are looked at together.
PIECE = 1 << 20
#: Contexts that are indexed together, at least one group.
BLOCK = 12_000
LOWEST = -(2**63)
BYTES = mix(np.arange(1, 257, dtype=np.uint64))
BYTES_2 = mix(np.arange(1001, 1257, dtype=np.uint64))
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long"


def anchors(flat: np.ndarray, bounds: np.ndarray, first: np.ndarray, last: np.ndarray, lengths: tuple[int, ...] = (LENGTH,)) -> tuple[np.ndarray, ...]:
    """Anchors of the pieces between bounds: place, piece, hash, two hashes of the context, its bytes before and from the place.

    first, last: which strings of each piece are looked at, by their starts; the bytes around them are context only.
    """
    n, shortest, longest = len(flat), min(lengths), max(lengths)
    none = np.zeros(0, np.int64)
    if n < shortest:
        return none, none, *(none.astype(np.uint64) for _ in range(3)), none, none
    hashes = Hashes(BYTES[flat], FACTORS[0])
    grams = hashes.grams(GRAM)
    key = (grams >> np.uint64(28) << np.uint64(28)) | np.arange(len(grams), dtype=np.uint64)
    width = shortest - GRAM + 1
    padded = np.full(-(-len(key) // width) * width, ~np.uint64(0))
    padded[: len(key)] = key
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    strings = n - shortest + 1
    least = np.minimum(behind[:strings], ahead[width - 1 : width - 1 + strings])
    piece = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    start = np.arange(strings)
    valid = (piece[:strings] == piece[shortest - 1 :]) & (start >= first[piece[:strings]]) & (start < last[piece[:strings]])
    at = np.unique(least[valid] & np.uint64((1 << 28) - 1)).astype(np.int64)
    own = piece[at]
    left, right = np.minimum(shortest - GRAM, at - bounds[own]), np.minimum(longest, bounds[own + 1] - at)
    shape = mix((left << 20 | right).astype(np.uint64))
    one = mix(hashes.of(at - left, at + right) + shape)
    two = mix(Hashes(BYTES_2[flat], FACTORS[1]).of(at - left, at + right) + shape)
    return at, own, grams[at], one, two, left, right


def pieces(raw: list[bytes], lengths: tuple[int, ...] = (LENGTH,)) -> Iterator[tuple[bytes, list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]]:
    """Documents joined, or parts of a long one: bytes, (document, its offset) of each piece, bounds, first and last string starts."""
    short = [i for i, r in enumerate(raw) if len(r) <= PIECE]
    ends = np.r_[0, np.cumsum([len(raw[i]) for i in short])].astype(np.int64)
    yield b"".join(raw[i] for i in short), [(i, 0) for i in short], ends, ends[:-1], ends[1:]
    for i, r in enumerate(raw):
        for at in range(0, len(r), PIECE) if len(r) > PIECE else ():
            lo = max(0, at - min(lengths))
            part = r[lo : at + PIECE + 2 * max(lengths)]
            yield part, [(i, lo)], np.array([0, len(part)]), np.array([at - lo]), np.array([at - lo + PIECE])


SENT = "bucket int, known boolean, anchors binary, contexts binary, contexts_2 binary, places binary, lefts binary, rights binary, wholes binary, docs binary, texts binary, counts binary"
MET = "kid long, th long, place long, left int, right int, anchor long, whole boolean"
#: Anchors that a task gathers before it sends them.
GATHERED = 200_000


def _anchored(buckets: int, lengths: tuple[int, ...]):
    """Blocks of anchors for each bucket. Of equal contexts of a task one is sent; all of them are known as repeated (blocks `known`)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        n_held = 0

        def blocks() -> pa.RecordBatch:
            cells = [np.concatenate(c) for c in zip(*held, strict=True)]
            o = np.lexsort((cells[7], cells[6], cells[2], cells[1], cells[0]))
            gram, context, second, place, left, right, kid, th = (x[o] for x in cells)
            first = np.r_[True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1]) | (second[1:] != second[:-1])]
            whole = ~(first & np.r_[first[1:], True])
            bucket = (gram % np.uint64(buckets)).astype(np.int32)
            rows = []
            for known, chosen in ((False, np.flatnonzero(first)), (True, np.flatnonzero(whole))):
                chosen = chosen[np.lexsort((th[chosen], kid[chosen], bucket[chosen]))]
                start = np.flatnonzero(np.r_[True, bucket[chosen][1:] != bucket[chosen][:-1]]) if len(chosen) else []
                for i, a in enumerate(start):
                    c = chosen[a : start[i + 1] if i + 1 < len(start) else len(chosen)]
                    head = np.flatnonzero(np.r_[True, (kid[c][1:] != kid[c][:-1]) | (th[c][1:] != th[c][:-1])])
                    cells = (gram[c], context[c], second[c], place[c], left[c].astype(np.uint16), right[c].astype(np.uint16), whole[c].astype(np.uint8), kid[c][head], th[c][head], np.diff(np.r_[head, len(c)]).astype(np.uint32))
                    rows.append((int(bucket[c[0]]), known, *(x.tobytes() for x in cells)))
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1]), *(pa.array(c, pa.binary()) for c in cols[2:])], names=[x.split()[0] for x in SENT.split(", ")])

        for batch in slices(batches, limit=PIECE):
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            ids, th = batch.column("kid").to_numpy(), batch.column("th").to_numpy()
            parts = []
            for data, where, bounds, first, last in pieces(raw, lengths):
                at, own, gram, context, second, left, right = anchors(np.frombuffer(data, np.uint8), bounds, first, last, lengths)
                if len(at):
                    doc, shift = np.array(where, np.int64).T
                    parts.append((doc[own], at - bounds[own] + shift[own], gram, context, second, left, right))
            if not parts:
                continue
            doc, place, gram, context, second, left, right = map(np.concatenate, zip(*parts, strict=True))
            _, once = np.unique(doc << 40 | place, return_index=True)  # an anchor of two parts of a long document
            held.append((gram[once], context[once], second[once], place[once], left[once], right[once], ids[doc[once]], th[doc[once]]))
            n_held += len(once)
            if n_held >= GATHERED:
                yield blocks()
                held, n_held = [], 0
        if n_held:
            yield blocks()

    return run


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated contexts (whole), and of anchors with several contexts one of each, to be compared."""
    names = [x.split()[0] for x in MET.split(", ")]
    bucket, blocks = None, []

    def columns(some: list[list[bytes]]) -> list[np.ndarray]:
        kinds = (np.uint64, np.uint64, np.uint64, np.int64, np.uint16, np.uint16, np.bool_)
        cols = [np.concatenate([np.frombuffer(b[i], k) for b in some]) for i, k in enumerate(kinds)]
        return cols + [np.concatenate([np.repeat(np.frombuffer(b[i], np.int64), np.frombuffer(b[9], np.uint32)) for b in some]) for i in (7, 8)]

    def table(place, left, right, kid, th, anchor, whole) -> Iterator[pa.RecordBatch]:
        full = pa.RecordBatch.from_arrays([pa.array(kid), pa.array(th), pa.array(place), pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32)), anchor, pa.array(whole)], names=names)
        for i in range(0, len(full), 20_000):
            yield full.slice(i, 20_000)

    def groups() -> Iterator[pa.RecordBatch]:
        cols = columns(blocks)
        o = np.lexsort((cols[2], cols[1], cols[0]))
        anchor, context, second, place, left, right, known, kid, th = (c[o] for c in cols)
        fresh = np.r_[True, anchor[1:] != anchor[:-1]]
        inner = fresh | np.r_[True, (context[1:] != context[:-1]) | (second[1:] != second[:-1])]
        head = np.flatnonzero(inner)
        size = np.diff(np.r_[head, len(anchor)])
        group = np.cumsum(fresh) - 1
        several = np.bincount(group[head])[group] > 1  # of the anchor's contexts
        twice = np.repeat((size > 1) | np.logical_or.reduceat(known, head), size)
        compared = several & inner
        out = np.flatnonzero(twice | compared)
        # anchor is null where no comparison is needed
        yield from table(place[out], left[out], right[out], kid[out], th[out], pa.array(anchor[out].view(np.int64), mask=~compared[out]), twice[out])

    for batch in batches:
        for row in batch.to_pylist():
            cells = [row[x.split()[0]] for x in SENT.split(", ")[2:]]
            if row["known"]:
                _, _, _, place, left, right, whole, kid, th = columns([cells])
                yield from table(place, left, right, kid, th, pa.nulls(len(place), pa.int64()), whole)
                continue
            if row["bucket"] != bucket and blocks:
                yield from groups()
                blocks = []
            bucket = row["bucket"]
            blocks.append(cells)
    if blocks:
        yield from groups()


CONTEXTS = "anchor long, kid long, th long, place long, left int, whole boolean, context binary"


def _contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=1 << 20):
        rows = []
        for kid, th, text, marks in zip(*(batch.column(c).to_pylist() for c in ("kid", "th", "text", "marks")), strict=True):
            raw = text.encode("utf-8", "surrogatepass")
            rows.extend((m["anchor"], kid, th, m["place"], m["left"], m["whole"], raw[m["place"] - m["left"] : m["place"] + m["right"]]) for m in marks)
        cols = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
        full = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in CONTEXTS.split(", ")])
        for i in range(0, len(full), 5_000):
            yield full.slice(i, 5_000)


class RunLengthIndex:
    """Run-length transform of aligned contexts, with samples at the ends of runs.

    Contexts of one group have the same anchor. At each place, from the anchor to the left, they are in
    the order of what follows from there, and the transform is the byte before. A place keeps only its
    runs: where each begins, where it goes in the order of the next place, and the contexts at its
    ends. Contexts that no other one agrees with any more leave the order, and a place at which each
    class of agreeing contexts has one byte needs no run at all.

    group: numbers of the contexts' anchors, ascending; lefts: bytes before the anchor; flat, offsets:
    the contexts' bytes. Contexts are renumbered by what follows from the anchor (`number`). `common`
    has the bytes that each has there in common with the one before, and gives the agreement of any two.
    """

    def __init__(self, group: np.ndarray, lefts: np.ndarray, flat: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]):
        self.before, after = min(lengths) - GRAM, max(lengths)
        n = len(group)
        size = np.diff(offsets)
        rows = np.zeros((n, self.before + after), np.uint8)
        owner = np.repeat(np.arange(n), size)
        rows[owner, np.arange(size.sum()) - np.repeat(offsets[:-1] - offsets[0] + lefts - self.before, size)] = flat[offsets[0] : offsets[-1]]
        rights = size - lefts
        following = np.ascontiguousarray(rows[:, self.before :]).view(f"S{after}").ravel()
        self.number = np.lexsort((rights, following, group))
        rows, self.lefts, rights, group = rows[self.number], lefts[self.number], rights[self.number], group[self.number]
        self.common = np.zeros(n + 1, np.int64)
        for i in range(1, n, 4096):
            j = min(n, i + 4096)
            differ = rows[i:j, self.before :] != rows[i - 1 : j - 1, self.before :]
            agree = np.where(differ.any(axis=1), differ.argmax(axis=1), after)
            self.common[i:j] = np.minimum(np.minimum(agree, np.minimum(rights[i:j], rights[i - 1 : j - 1])), np.where(group[i:j] == group[i - 1 : j - 1], after, 0))
        # least of `common` over stretches of 2, 4, 8 and more
        self.least = [self.common]
        while 2 << (len(self.least) - 1) <= n:
            step, last = 1 << (len(self.least) - 1), self.least[-1]
            self.least.append(np.minimum(last[:-step], last[step:]))
        reach = np.maximum(self.common[:-1], self.common[1:])
        self.start = np.flatnonzero(reach + self.lefts >= min(lengths))  # others can't be part of a match
        self.places = self._runs(rows, group)

    def _runs(self, rows: np.ndarray, group: np.ndarray) -> list[tuple[np.ndarray, ...] | None]:
        """For each place before the anchor, from the right: heads, lengths, targets (-1: leaves the order), first and last contexts of the runs, and whether a class begins there."""
        order, out = self.start, []
        fresh = np.r_[True, group[order][1:] != group[order][:-1]][: len(order)]  # where a class of agreeing contexts begins
        for place in range(self.before - 1, -1, -1):
            byte = np.where(self.lefts[order] >= self.before - place, rows[order, place].astype(np.int16), -1)
            head = fresh.copy()
            head[1:] |= byte[1:] != byte[:-1]
            if not len(order) or (np.array_equal(head, fresh) and byte.min() >= 0):
                out.append(None)
                continue
            heads = np.flatnonzero(head)
            length = np.diff(np.r_[heads, len(order)])
            symbol, of = byte[heads], (np.cumsum(fresh) - 1)[heads]
            o = np.lexsort((symbol, of))  # stable: runs of one symbol stay in their order
            begins = np.r_[True, (of[o][1:] != of[o][:-1]) | (symbol[o][1:] != symbol[o][:-1])]
            total = np.add.reduceat(length[o], np.flatnonzero(begins))[np.cumsum(begins) - 1]
            stays = (total > 1) & (symbol[o] >= 0)
            kept = o[stays]
            target, starts = np.full(len(heads), -1), np.zeros(len(heads), bool)
            target[kept] = np.cumsum(length[kept]) - length[kept]
            starts[kept] = begins[stays]
            out.append((heads, length, target, order[heads], order[heads + length - 1], starts))
            at = np.repeat(heads[kept] - target[kept], length[kept]) + np.arange(length[kept].sum())
            order, fresh = order[at], np.zeros(len(at), bool)
            fresh[target[kept][starts[kept]]] = True
        return out

    def agreement(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that contexts a < b have in common from the anchor on."""
        level = np.frexp(b - a)[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level).tolist():
            i = level == k
            out[i] = np.minimum(self.least[k][a[i] + 1], self.least[k][b[i] + 1 - (1 << k)])
        return out

    def statistics(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each place from the anchor to the left: the place, contexts (by `number`) that share it with another one, and the longest match that starts there."""
        ids = self.start
        if not len(ids):
            return
        near = self.agreement(ids[:-1], ids[1:])  # 0 across anchors
        at, before, after = np.arange(len(ids)), np.r_[0, near], np.r_[near, 0]
        yield self.before, ids, np.maximum(before, after)
        for i, runs in enumerate(self.places):
            place = self.before - 1 - i
            if runs is not None:
                heads, length, target, first, last, starts = runs
                o = np.argsort(target)[int((target < 0).sum()) :]  # runs in their new order
                follows = np.flatnonzero(~starts[o])  # those with another run of their class in front
                meet = np.zeros(len(heads), np.int64)
                meet[o[follows]] = self.agreement(last[o[follows - 1]], first[o[follows]])
                next_ = np.zeros(len(heads), np.int64)
                next_[o[follows - 1]] = meet[o[follows]]
                run = np.searchsorted(heads, at, "right") - 1
                before = np.where(at == heads[run], meet[run], before)
                after = np.where(at == heads[run] + length[run] - 1, next_[run], after)
                stays = target[run] >= 0
                at = (target[run] + at - heads[run])[stays]
                ids, before, after = ids[stays], before[stays], after[stays]
                if not len(ids):
                    return
            yield place, ids, np.maximum(before, after) + self.before - place

    def repeats(self, lengths: tuple[int, ...]) -> np.ndarray:
        """(lengths, contexts, starts): whether the string of that length at a place before or at the anchor is found in another context."""
        out = np.zeros((len(lengths), len(self.number), self.before + 1), bool)
        for place, ids, match in self.statistics():
            for i, length in enumerate(lengths):
                out[i, self.number[ids[match >= length]], place] = True
        return out


SPANS = "kid long, th long, length int, start long, stop long"


def _repeated(lengths: tuple[int, ...]):
    """Rows sorted by anchor: the spans of contexts that are found in another one of the same anchor."""

    def spans(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        key = table.column("anchor").to_numpy()
        group = np.cumsum(np.r_[False, key[1:] != key[:-1]])
        left, place = table.column("left").to_numpy().astype(np.int64), table.column("place").to_numpy()
        # offsets of 64 bits: a hot anchor's contexts may have more than 2 GB
        context = table.column("context").cast(pa.large_binary()).chunk(0)
        offsets = np.frombuffer(context.buffers()[1], np.int64)[context.offset : context.offset + len(context) + 1]
        index = RunLengthIndex(group, left, np.frombuffer(context.buffers()[2], np.uint8), offsets, lengths)
        marks = index.repeats(lengths)
        marks[:, table.column("whole").to_numpy(zero_copy_only=False)] = False  # known already
        ids, th = table.column("kid").to_numpy(), table.column("th").to_numpy()
        for length, marked in zip(lengths, marks, strict=True):
            padded = np.zeros((len(marked), index.before + 3), np.int8)
            padded[:, 1:-1] = marked
            turn = np.diff(padded, axis=1)
            row, start = np.nonzero(turn == 1)
            _, stop = np.nonzero(turn == -1)
            shift = place[row] - index.before
            yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(th[row]), pa.array(np.full(len(row), length, np.int32)), pa.array(shift + start), pa.array(shift + stop - 1 + length)], names=[x.split()[0] for x in SPANS.split(", ")])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n_held = 0
        for batch in batches:
            if not len(batch):
                continue
            key = batch.column("anchor").to_numpy()
            change = np.flatnonzero(key[1:] != key[:-1]) + 1
            if held and held[-1].column("anchor")[-1].as_py() != key[0]:
                change = np.r_[0, change]
            if n_held + len(batch) >= BLOCK and len(change):
                cut = int(change[-1])
                held.append(batch.slice(0, cut))
                yield from spans(pa.Table.from_batches(held))
                held, n_held, batch = [], 0, batch.slice(cut)
            held.append(batch)
            n_held += len(batch)
        if n_held:
            yield from spans(pa.Table.from_batches(held))

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return small_batches(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("kid"), text.alias("text"), F.xxhash64(text).alias("th"))


def repeated_spans(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH,)) -> DataFrame:
    """kid, th, spans (length, start, stop; sorted): the bytes of each distinct document that repeated strings of these lengths cover."""
    if min(lengths) < GRAM:
        raise ValueError(f"a length must be {GRAM} or more")
    rows = _keyed(docs)
    n = partitions(docs.sparkSession)
    sent = rows.filter(F.octet_length("text") >= min(lengths)).mapInArrow(_anchored(3 * n, lengths), SENT)
    met = written(sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_met, MET), "anchors")
    # of a context that occurs twice all strings do: one span for each length that fits in
    whole = met.filter("whole").withColumn("length", F.explode(F.array(*(F.lit(m) for m in lengths)))).withColumn("reach", F.least("right", "length"))
    whole = whole.filter(F.col("left") + F.col("reach") >= F.col("length")).select("kid", "th", "length", (F.col("place") - F.col("left")).alias("start"), (F.col("place") + F.col("reach")).alias("stop"))
    marks = met.filter("anchor is not null").groupBy("kid", "th").agg(F.collect_list(F.struct("anchor", "place", "left", "right", "whole")).alias("marks"))
    marks = written(marks, "marks")
    contexts = rows.join(marks, ["kid", "th"]).select("kid", "th", "text", "marks").mapInArrow(_contexts, CONTEXTS)
    part = contexts.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_repeated(lengths), SPANS)
    every = whole.union(part).groupBy("kid", "th").agg(F.array_sort(F.collect_set(F.struct("length", "start", "stop"))).alias("spans"))
    return written(every, "spans", [met, marks])


def united(spans: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """The spans of one length, sorted by their starts, as maximal runs."""
    out: list[list[int]] = []
    for s in spans or ():
        if s["length"] != length:
            continue
        if out and s["start"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["stop"])
        else:
            out.append([s["start"], s["stop"]])
    return [(a, b) for a, b in out]


def kept_bytes(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    out.append(raw[at:])
    return b"".join(out)


def repeated_bytes(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """Per document: bytes, removed bytes, maximal removed runs, and the hash of what stays; besides, the bytes that repeated strings of `passage` bytes cover."""
    lengths = (length, passage)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for kid, text, spans in zip(*(batch.column(c).to_pylist() for c in ("kid", "text", "spans")), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                cut, shorter = united(spans, length), united(spans, passage)
                rows.append((None if kid == LOWEST else kid, len(raw), sum(b - a for a, b in cut), len(cut), hashlib.sha256(kept_bytes(raw, cut)).hexdigest(), sum(b - a for a, b in shorter)))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    return _keyed(docs).join(repeated_spans(docs, lengths), ["kid", "th"], "left").select("kid", "text", "spans").mapInArrow(run, RESULT)


def cut_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The rows and columns of docs, with repeated bytes cut from text, and n_chars, where there is one, counted anew."""
    kid, th, spans = free_name(docs, "kid"), free_name(docs, "th"), free_name(docs, "spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column(spans).to_pylist(), strict=True):
                texts.append(kept_bytes(text.encode("utf-8", "surrogatepass"), united(found, length)).decode("utf-8", "ignore") if text and found else text)
            names = [c for c in batch.schema.names if c != spans]
            yield pa.RecordBatch.from_arrays([pa.array(texts, batch.schema.field("text").type) if c == "text" else batch.column(c) for c in names], names=names)

    found = repeated_spans(docs, (length,)).toDF(kid, th, spans)
    rows = docs.withColumn(kid, F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST))).withColumn(th, F.xxhash64(F.col("text").cast("string")))
    out = rows.join(found, [kid, th], "left").select(*docs.columns, spans).mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
