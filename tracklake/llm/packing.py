"""Cost-balanced packing into sequences of a fixed number of tokens.

Each task tokenizes its documents and packs them window by window, so ids are never shuffled and
memory is bounded by the window. A document's cost is linear * n + quadratic * n * n. Documents
longer than a sequence give full sequences first; the rest are assigned in descending order to
the lowest-cost sequence with room. What fits nowhere whole is cut over the sequences with most
room. The tokens of a window that don't fill a sequence end in sequences of power-of-two lengths,
which need no padding.

Null or empty text: the end id alone. A long text is encoded whole. Documents of equal lengths are taken
in their order, sequences of equal costs by their number. Repeated rows and equal doc_ids are packed one by
one; a null doc_id stays null. Extra columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterable, Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import id_and_text, slices, texts_of

#: How the vocabulary cuts texts before its merges (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of ids (4 each) that are packed together.
WINDOW = 24 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, seq_tokens long, seq_cost double"


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers, as the library's default encoding of the file gives them.

    ranks: the same vocabulary as a rank file, whose encoder is four times as fast and gives the same
    ids; texts with special strings or characters beyond Latin (on whose class Unicode versions may
    differ) go to the library itself.
    """

    def __init__(self, path: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.fast = Tokenizer.from_file(path), None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding(os.path.basename(ranks), pat_str=PATTERN, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast and "<|" not in text and (text.isascii() or max(text) < "ɐ"):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.library.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


def assign(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of one window; sequences are numbered from 0."""

    def cost(n: int) -> float:
        return linear * n + quadratic * n * n

    pieces: list[tuple[int, int, int, int, int]] = []
    rest: list[tuple[int, int, int]] = []  # length, document, start
    n_seq = 0
    for d, n in enumerate(lengths):
        whole = n - n % capacity
        for start in range(0, whole, capacity):
            pieces.append((d, start, capacity, n_seq, 0))
            n_seq += 1
        if n > whole:
            rest.append((n - whole, d, whole))
    rest.sort(key=lambda x: (-x[0], x[1]))
    total = sum(x[0] for x in rest)
    room: list[int] = [capacity] * (total // capacity)
    left = total % capacity
    bit = capacity
    while left:  # the tail: one sequence for each binary digit
        bit //= 2
        if left >= bit:
            room.append(bit)
            left -= bit
    limit = list(room)
    spent = [cost(capacity - r) if r < capacity else 0.0 for r in room]
    # a heap of (cost, sequence) for each room, and the cheapest of any stretch of rooms in a binary tree
    leaves, none = 1 << capacity.bit_length(), (float("inf"), -1)
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(leaves)]
    cheapest = [none] * (2 * leaves)

    def renew(r: int) -> None:
        at = leaves + r
        cheapest[at] = heaps[r][0] if heaps[r] else none
        while at > 1:
            at //= 2
            cheapest[at] = min(cheapest[2 * at], cheapest[2 * at + 1])

    for i, r in enumerate(room):
        heappush(heaps[r], (cost(capacity - r), i))
    for r in set(room):
        renew(r)
    late: list[tuple[int, int, int]] = []
    for n, d, start in rest:
        at = leaves + n
        best = cheapest[at]
        while at > 1:  # all rooms of n or more
            if at % 2 == 0:
                best = min(best, cheapest[at + 1])
            at //= 2
        to = best[1]
        if to < 0:
            late.append((n, d, start))
            continue
        pieces.append((d, start, n, n_seq + to, limit[to] - room[to]))
        heappop(heaps[room[to]])
        renew(room[to])
        room[to] -= n
        spent[to] += cost(n)
        if room[to]:
            heappush(heaps[room[to]], (spent[to], to))
            renew(room[to])
    gaps = sorted((i for i, r in enumerate(room) if r), key=lambda i: room[i])
    for n, d, start in late:  # cut over the sequences with most room
        while n:
            i = gaps[-1]
            k = min(n, room[i])
            pieces.append((d, start, k, n_seq + i, limit[i] - room[i]))
            room[i] -= k
            start += k
            n -= k
            if not room[i]:
                gaps.pop()
    return pieces


def pack(docs: DataFrame, path: str, ranks: str | None = None, capacity: int = 2048, end_id: int = 1, linear: float = 1.0, quadratic: float = 1.0 / 2048) -> DataFrame:
    """One row per piece. sequence_id is the task's number and a count; seq_tokens and seq_cost are of the whole sequence."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path, ranks), end_id.to_bytes(4, "little")
        first = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        keys: list[int | None] = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal first
            pieces = assign([len(x) // 4 for x in ids], capacity, linear, quadratic)
            tokens: dict[int, int] = {}
            costs: dict[int, float] = {}
            for _, _, n, s, _ in pieces:
                tokens[s] = tokens.get(s, 0) + n
                costs[s] = costs.get(s, 0.0) + linear * n + quadratic * n * n
            rows = [(keys[d], a, n, zlib.crc32(memoryview(ids[d])[4 * a : 4 * (a + n)]), len(ids[d]) // 4, first + s, o, tokens[s], costs[s]) for d, a, n, s, o in pieces]
            first += len(tokens)
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:8]] + [pa.array(cols[8], pa.float64())], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "seq_tokens", "seq_cost"])

        for batch in slices(batches, limit=2 << 20):
            for key, raw in zip(batch.column("doc_id").to_pylist(), map(encoder.encode, texts_of(batch)), strict=True):
                keys.append(key)
                ids.append(raw + end)
                held += len(raw) + 4
                if held >= WINDOW:
                    yield flush()
                    keys, ids, held = [], [], 0
        if ids:
            yield flush()

    return id_and_text(docs).mapInArrow(run, SCHEMA)
