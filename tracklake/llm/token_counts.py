"""Token counts by rank-synchronous array merging.

Pre-tokens of a slice of documents are held as one ragged numpy array of symbol ids. In each
round every sequence finds its lowest-rank adjacent pair and merges all its occurrences, all
sequences at once; sequences without a pair that has a rank are done, and the symbols that
survive are counted. Distinct pre-tokens are merged once and kept in a bounded table per worker.

Null or empty text: 0 bytes, 0 tokens. A long text is cut into pre-tokens whole, and no pre-token is cut;
of equal ranks the leftmost pair is merged first. Repeated rows and equal doc_ids each give their own row;
a null doc_id stays null. Extra columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_and_text, slices, texts_of

#: Pre-tokens of the vocabulary file (fixed values).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Most pre-tokens that a worker remembers.
REMEMBERED = 400_000
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class RankMerger:
    """Merges of a byte-level BPE file whose last symbol of a word carries a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model["end_of_word_suffix"] or ""
        stands = byte_symbols()
        self.inner = np.array([vocab[c] for c in stands], np.int64)
        self.last = np.array([vocab[c + suffix] for c in stands], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        key = left << 20 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int64), made
        self.none = np.int64(len(merges))

    def rank(self, key: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def count(self, words: list[str]) -> np.ndarray:
        """How many symbols survive in each (non-empty) word."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out = size.copy()
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum(size)
        symbols = self.inner[flat]
        symbols[ends - 1] = self.last[flat[ends - 1]]
        owner = np.repeat(np.arange(len(raw)), size)
        while len(symbols):
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            rank = np.full(len(symbols), self.none)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            rank[inside] = self.rank(symbols[inside] << 20 | symbols[inside + 1])
            lowest = np.minimum.reduceat(rank, first)
            length = np.diff(np.r_[first, len(symbols)])
            live = lowest < self.none
            out[owner[first[~live]]] = length[~live]
            hit = (rank == np.repeat(lowest, length)) & np.repeat(live, length)
            # of overlapping hits (a a a) every second one merges, from the left
            start = hit & ~np.r_[False, hit[:-1]]
            place = np.arange(len(hit)) - np.maximum.accumulate(np.where(start, np.arange(len(hit)), 0))
            at = np.flatnonzero(hit & (place % 2 == 0))
            symbols[at] = self.made[rank[at]]
            keep = np.repeat(live, length)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out


class TokenCounter:
    """Token counts of whole texts, as the library's default encoding of the file gives them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merger = RankMerger(path)
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = [t["content"] for t in json.load(f)["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, added)))
        self.find = regex.compile(PATTERN).findall
        self.stands = {c: b for b, c in enumerate(byte_symbols())}
        self.known: dict[str, int] = {}

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and the number of special strings, which are a token each."""
        parts = self.special.split(text) if "<|" in text else [text]
        return list(chain.from_iterable(map(self._plain, parts))), len(parts) - 1

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.find(text.lower())
        if max(text) < "ɐ":
            return self.find(unicodedata.normalize("NFC", text).lower())
        # characters on whose class or case Unicode versions may differ: the library's own normalizer and cuts
        cut = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(self.stands[c] for c in w).decode("utf-8") for w, _ in cut]

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.pretokens(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set(chain.from_iterable(w for w, _ in cut)).difference(self.known))
        if new:
            self.known.update(zip(new, self.merger.count(new).tolist(), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, words)) + special for words, special in cut]


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document, without a shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(path)
        for batch in slices(batches, limit=2 << 20):
            texts = texts_of(batch)
            found = counter.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(found, pa.int64()), pa.array([n > limit for n in found])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return id_and_text(docs).mapInArrow(run, SCHEMA)
