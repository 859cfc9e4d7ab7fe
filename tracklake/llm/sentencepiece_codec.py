"""Unigram encoding and decoding over a double-array trie of pieces.

A text is escaped (a marker before it and for each space) and cut before every marker that follows
another character: no piece crosses these places, so the best path of the whole text is the best
paths of the units one after another. Distinct units of a slice are run through Viterbi together,
all in step, over arrays of the double-array trie. Characters without a piece of their own are a
penalised edge that is written as byte pieces. Decoding joins pieces and bytes, turns markers into
spaces and drops the first one.

Scores: the public file is a BPE model, whose scores are the negated ranks of merges. A sum of
ranks isn't a likelihood, so `zipf` (default) takes the log of a Zipf law over ranks, -ln(rank + 2);
`file` takes the file's own scores.

Null or empty text: no pieces, decoded as the empty text. A text's own markers decode as spaces.
A long text is encoded whole; a unit is as long as a text without a space. Of paths of equal scores the one
with the longer last piece is kept. Repeated rows and equal doc_ids each give their own row; extra columns,
whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, slices, small_batches, texts_of

MARK = "▁"
#: How much less than the least piece an unknown character scores (the library's fixed value).
PENALTY = 10.0
#: Most units that a worker remembers.
REMEMBERED = 300_000
SCHEMA = "doc_id long, n_bytes long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean"


class DoubleArray:
    """base/check arrays over bytes; value[s] is the piece that ends in state s, or -1."""

    def __init__(self, keys: list[bytes], values: list[int]):
        order = sorted(range(len(keys)), key=lambda i: keys[i])
        keys, values = [keys[i] for i in order], [values[i] for i in order]
        size = 1 << 21
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used = bytearray(size)
        used[0] = 1
        free, top, todo = 1, 0, [(0, 0, len(keys), 0)]
        while todo:
            state, lo, hi, depth = todo.pop()
            if len(keys[lo]) == depth:
                self.value[state] = values[lo]
                lo += 1
            heads = []
            at = lo
            while at < hi:
                c, to = keys[at][depth], at
                while to < hi and keys[to][depth] == c:
                    to += 1
                heads.append((c, at, to))
                at = to
            if not heads:
                continue
            if len(heads) == 1:  # fills the gaps that wider nodes leave
                free = used.index(0, free)
                base = free - heads[0][0]
                if base < 1:
                    base = used.index(0, heads[0][0] + 1) - heads[0][0]
            else:
                base = max(1, top - 32 - heads[0][0])
                while any(used[base + c] for c, _, _ in heads):
                    base += 1
            self.base[state] = base
            for c, a, b in heads:
                used[base + c] = 1
                self.check[base + c] = state
                todo.append((base + c, a, b, depth + 1))
            top = max(top, base + heads[-1][0])
        for name in ("base", "check", "value"):
            setattr(self, name, getattr(self, name)[: top + 257].copy())

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The next states; -1 where there is none."""
        to = self.base[state] + byte
        return np.where((self.check[to] == state) & (self.base[state] > 0), to, -1)


class Codec:
    def __init__(self, path: str, scores: str = "zipf"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        self.byte_ids = np.full(256, model.unk_id(), np.uint32)
        for i in range(n):
            if model.is_byte(i):
                self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        self.score = np.zeros(n)
        for rank, i in enumerate(plain):
            self.score[i] = -math.log(rank + 2) if scores == "zipf" else model.get_score(i)
        self.unknown = min(self.score[plain]) - PENALTY
        self.trie = DoubleArray([self.pieces[i].encode() for i in plain], plain)
        self.bytes_of = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else (b"" if model.is_control(i) else p.replace(MARK, " ").encode()) for i, p in enumerate(self.pieces)]
        self.is_byte = np.array([model.is_byte(i) for i in range(n)])

    @staticmethod
    def units(text: str) -> list[str]:
        if not text:
            return []
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK))

    def best(self, units: list[str]) -> list[bytes]:
        """The ids (little-endian 32-bit) of the best path of each unit."""
        raw = [u.encode("utf-8", "surrogatepass") for u in units]
        order = sorted(range(len(raw)), key=lambda i: -len(raw[i]))
        out = [b""] * len(raw)
        at = 0
        while at < len(order):  # groups of similar length bound the padded array
            width = len(raw[order[at]])
            to = at
            while to < len(order) and to - at < max(1, (4 << 20) // (width + 1)) and len(raw[order[to]]) * 2 > width:
                to += 1
            group = order[at:to]
            for i, ids in zip(group, self._viterbi([raw[i] for i in group]), strict=True):
                out[i] = ids
            at = to
        return out

    def _viterbi(self, raw: list[bytes]) -> list[bytes]:
        """raw: in descending order of length."""
        n, width = len(raw), len(raw[0])
        size = np.fromiter(map(len, raw), np.int64, n)
        grid = np.zeros((width + 1, n), np.uint8)
        row = np.repeat(np.arange(n), size)
        col = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        grid[col, row] = np.frombuffer(b"".join(raw), np.uint8)
        best = np.full((width + 1, n), -np.inf)
        best[0] = 0
        back = np.zeros((width + 1, n), np.int32)
        piece = np.full((width + 1, n), -1, np.int32)
        for s in range(width):
            live = np.flatnonzero(best[s, : np.searchsorted(-size, -s, "left")] > -np.inf)
            if not len(live):
                continue
            head = grid[s, live]
            char = 1 + (head >= 0xC0) + (head >= 0xE0) + (head >= 0xF0).astype(np.int64)
            own = np.zeros(len(live), bool)  # a piece of just this character was found
            state, at, which = np.zeros(len(live), np.int32), live, np.arange(len(live))
            for e in range(s + 1, width + 1):
                inside = size[at] >= e
                state, at, which = state[inside], at[inside], which[inside]
                state = self.trie.step(state, grid[e - 1, at])
                alive = state >= 0
                state, at, which = state[alive], at[alive], which[alive]
                if not len(at):
                    break
                found = self.trie.value[state]
                ends = found >= 0
                self._relax(best, back, piece, s, e, at[ends], best[s, at[ends]] + self.score[found[ends]], found[ends])
                own[which[ends & (char[which] == e - s)]] = True
            for k in range(1, 5):
                lost = live[~own & (char == k)]
                if len(lost) and s + k <= width:
                    self._relax(best, back, piece, s, s + k, lost, best[s, lost] + self.unknown, np.full(len(lost), -1, np.int32))
        at, end, steps = np.arange(n), size.copy(), []
        while (end > 0).any():
            steps.append(np.where(end > 0, piece[end, at], -2))
            end = np.where(end > 0, back[end, at], 0)
        taken = np.array(steps[::-1], np.int32).T.reshape(n, -1)
        bounds = (4 * np.r_[0, np.cumsum((taken > -2).sum(axis=1))]).tolist()
        flat = taken[taken > -2].astype("<u4").tobytes()
        paths = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for i in np.flatnonzero((taken == -1).any(axis=1)).tolist():  # unknown characters: pieces for their bytes
            e, ids = len(raw[i]), []
            while e:
                s = int(back[e, i])
                ids.append(self.byte_ids[list(raw[i][s:e])] if piece[e, i] < 0 else np.array([piece[e, i]]))
                e = s
            paths[i] = np.concatenate(ids[::-1]).astype("<u4").tobytes()
        return paths

    @staticmethod
    def _relax(best, back, piece, s, e, at, score, ids) -> None:
        better = score > best[e, at]
        at = at[better]
        best[e, at], back[e, at], piece[e, at] = score[better], s, ids[better]

    def decode(self, ids: Iterable[int]) -> str:
        raw = b"".join([self.bytes_of[i] for i in ids])
        return raw.removeprefix(b" ").decode("utf-8", "surrogatepass")


class Encoder:
    """A codec with a bounded memory of units."""

    def __init__(self, codec: Codec):
        self.codec, self.known = codec, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.codec.units(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set(chain.from_iterable(cut)).difference(self.known))
        if new:
            self.known.update(zip(new, self.codec.best(new), strict=True))
        get = self.known.__getitem__
        return [b"".join(map(get, units)) for units in cut]


def encode(docs: DataFrame, path: str, scores: str = "zipf") -> DataFrame:
    """doc_id and ids (little-endian 32-bit) of each whole text, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(Codec(path, scores))  # about 12 MB, whatever the input

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in slices(batches, limit=2 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(encoder.encode(texts_of(batch)), pa.binary())], names=["doc_id", "ids"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of encode()'s rows."""
    shared = encoded.sparkSession.sparkContext.broadcast(Codec(path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.decode(np.frombuffer(r or b"", "<u4").tolist()) for r in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return small_batches(encoded).select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, path: str, scores: str = "zipf") -> DataFrame:
    """Per document: pieces, byte pieces, a checksum of the ids, and whether decoding them gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(Codec(path, scores))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        encoder = Encoder(codec)
        for batch in slices(batches, limit=2 << 20):
            texts = texts_of(batch)
            raw = encoder.encode(texts)
            ids = [np.frombuffer(r, "<u4") for r in raw]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([int(codec.is_byte[x].sum()) for x in ids], pa.int64()),
                    pa.array([zlib.crc32(r) for r in raw], pa.int64()),
                    pa.array([codec.decode(x.tolist()) == t for x, t in zip(ids, texts, strict=True)]),
                ],
                names=["doc_id", "n_bytes", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"],
            )

    return id_and_text(docs).mapInArrow(run, SCHEMA)
