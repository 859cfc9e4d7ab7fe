"""Quality rules with suffix-array repetition.

The words of a slice of documents are suffix-sorted together by prefix doubling, with the document
as part of the first symbol, so that suffixes of different documents never compare equal. The
longest common prefixes of neighbours in that order bound the intervals of maximal repeated word
strings; a position's longest repeat is the larger of its two neighbours' prefixes, and the union
of these spans is the repeated part of the text.

A document stays if the base rules hold (at least MIN_WORDS words, at most BASE_PERCENT per cent of
them in five-word windows found twice) and repeats of LONG_WORDS words or more cover at most
LONG_PERCENT per cent of the words and none is longer than MAX_REPEAT words.

Null, empty or blank text: no words, so the base fails. A long text is measured whole; some 150 bytes a
word are held for it, however often it repeats itself. A measure that is just at a limit passes. Repeated
rows each get the same verdict. Extra columns, also those named like a result, are no problem: quality()
reads doc_id and text only, and keep_good() returns the columns that it got. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import FACTORS, Hashes, id_and_text, mix, slices, small_batches, word_codes

WINDOW, MIN_WORDS, BASE_PERCENT = 5, 10, 20
LONG_WORDS, LONG_PERCENT, MAX_REPEAT = 20, 15, 200
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_long_repeat_words long, longest_repeat long"
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\v\f\r"


def repeats(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each word, how many words from it on are found elsewhere in its own document (0 to 3: as 0)."""
    n = len(codes)
    longest = np.zeros(n, np.int64)
    if not n:
        return longest
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    end = np.repeat(bounds[1:], sizes)
    key = owner * (int(codes.max()) + 1) + codes
    order = np.argsort(key, kind="stable")
    fresh = np.r_[True, np.diff(key[order]) != 0]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    single = fresh & np.r_[fresh[1:], True]
    open_ = order[~single]  # suffixes whose place isn't settled, in the order of their ranks
    rounds, step = 0, 1
    while len(open_):
        ahead = open_ + step
        second = np.where(ahead < end[open_], rank[np.minimum(ahead, n - 1)], -1)
        first = rank[open_]
        o = np.argsort(first * (n + 1) + second + 1, kind="stable")
        open_, first, second = open_[o], first[o], second[o]
        group = np.r_[True, first[1:] != first[:-1]]
        sub = group | np.r_[True, second[1:] != second[:-1]]
        at = np.arange(len(open_))
        rank[open_] = first + np.maximum.accumulate(np.where(sub, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        open_ = open_[~(sub & np.r_[sub[1:], True])]
        rounds, step = rounds + 1, step * 2
    if rounds < 2:
        return longest
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    # prefixes in common of neighbours, by powers of two: 128-bit hashes take the place of the ranks of all rounds
    symbol = codes.astype(np.uint64)
    hashes = [Hashes(mix(symbol + np.uint64(7 * i + 3)), f) for i, f in enumerate(FACTORS)]

    def same(x: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
        inside = (x + size <= end[x_of]) & (y + size <= end[y_of])
        x, y = np.minimum(x, n - size), np.minimum(y, n - size)
        return inside & (hashes[0].of(x, x + size) == hashes[0].of(y, y + size)) & (hashes[1].of(x, x + size) == hashes[1].of(y, y + size))

    x_of, y_of = suffixes[:-1], suffixes[1:]
    if n < WINDOW - 1:
        return longest
    near = (owner[x_of] == owner[y_of]) & same(x_of, y_of, WINDOW - 1)
    a, b = x_of, y_of = x_of[near], y_of[near]
    common = np.zeros(len(a), np.int64)
    for k in range(rounds, -1, -1):
        if 1 << k <= n:
            common += same(a + common, b + common, 1 << k) * (1 << k)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(longest: np.ndarray, bounds: np.ndarray, least: int) -> np.ndarray:
    """Words of each document in the union of its repeats of at least so many words."""
    at = np.flatnonzero(longest >= least)
    edges = np.zeros(len(longest) + 1, np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + longest[at], -1)
    inside = np.r_[0, np.cumsum(np.cumsum(edges[:-1]) > 0)]
    return inside[bounds[1:]] - inside[bounds[:-1]]


def per_document(flat: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(flat, dtype=np.int64)]
    return np.diff(total[ends])


def measures(texts: pa.Array) -> dict[str, np.ndarray]:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    ends = np.r_[0, np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))]
    flat = np.frombuffer(b"".join(raw), np.uint8)
    table = np.zeros((2, 256), np.int8)
    table[0, [b for b in range(256) if b & 0xC0 != 0x80 and b not in BLANKS]] = 1
    table[1, list(SYMBOLS)] = 1
    codes, bounds, _ = word_codes(texts, lower=False)
    longest = repeats(codes, bounds)
    lines = [[x for x in r.split(b"\n") if x.strip()] for r in raw]
    top = np.zeros(len(raw), np.int64)
    np.maximum.at(top, np.repeat(np.arange(len(raw)), np.diff(bounds)), longest)
    return {
        "n_words": np.diff(bounds),
        "word_chars": per_document(table[0][flat], ends),
        "n_symbols": per_document(table[1][flat], ends),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": covered(longest, bounds, WINDOW),
        "n_long_repeat_words": covered(longest, bounds, LONG_WORDS),
        "longest_repeat": np.where(top >= WINDOW, top, 0),
    }


def _run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=2 << 20):
        m = measures(batch.column("text"))
        failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"])
        kept = ~failed & (100 * m["n_long_repeat_words"] <= LONG_PERCENT * m["n_words"]) & (m["longest_repeat"] <= MAX_REPEAT)
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(m[c]) for c in names), pa.array(failed), pa.array(kept), pa.array(m["n_long_repeat_words"]), pa.array(m["longest_repeat"])],
            names=["doc_id", *names, "base_failed", "kept", "n_long_repeat_words", "longest_repeat"],
        )


def quality(docs: DataFrame) -> DataFrame:
    """Measures and verdict of each document, without a shuffle."""
    return id_and_text(docs).mapInArrow(_run, SCHEMA)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, whose text passes; judged in place, without a join."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            m = measures(batch.column("text"))
            kept = (m["n_words"] >= MIN_WORDS) & (100 * m["n_repeat_words"] <= BASE_PERCENT * m["n_words"])
            kept &= (100 * m["n_long_repeat_words"] <= LONG_PERCENT * m["n_words"]) & (m["longest_repeat"] <= MAX_REPEAT)
            yield batch.filter(pa.array(kept))

    return small_batches(docs).mapInArrow(run, docs.schema)
