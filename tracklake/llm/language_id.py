"""Word-level language labels by a linear-chain conditional random field.

Features of a word: its affixes of one to three letters, its letter bigrams and trigrams, and its
membership in each language's lexicon (words that the sample has mostly in that language). The
training sequences are spliced from documents of different languages, so transitions are learned
for code-switched text. The log-likelihood's gradient and the marginals come from forward-backward,
run in step over all sequences of a slice. A document's language is the one with most expected
words; its score is that share.

Training takes from every language SAMPLE documents at most, those with the smallest hashes, and of each
SAMPLE_CHARS characters at most; where languages are many, fewer and shorter ones, so that characters
times languages times languages stay under SAMPLE_CELLS. Of features there are FEATURES, or fewer so that
features times languages stay under WEIGHTS. These are the only bounds. Every document is predicted from
its whole text; a chain ends after SEGMENT words, so a long text is some chains, which are summed.

Null or empty text, or text without a letter (numbers such as ² or ½ are none): `und`, score 0. Documents
without lang don't train. Without any training document every text is `und`. Of languages with equal
sums the first in the order of their names is taken. Repeated rows each give their own row; extra columns,
also those named like a result, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, small_batches, texts_of

SAMPLE, SAMPLE_CHARS, SAMPLE_CELLS = 120, 12_000, 96_000_000
FEATURES, WEIGHTS = 1 << 16, 1 << 23
#: Sampled keys are looked up by a broadcast of up to so many bytes, or by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Words of a chain; words times languages that are looked at together; words times languages that a worker remembers.
SEGMENT, CELLS, REMEMBERED = 4096, 1 << 20, 1_200_000
WORD = re.compile(r"[^\W\d_]+")
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_switches long"


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    words = WORD.findall(text.lower())
    if "".join(words).isalpha() or not words:
        return words
    # word characters that are numbers without being decimal digits, as ² and ½
    return "".join(c if c.isalpha() else " " for c in " ".join(words)).split()


def forward_backward(emit: np.ndarray, bounds: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each word, summed pair marginals, and the log-likelihood's normalizer, over ragged sequences."""
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = bounds[:-1][order], sizes[order]
    top = emit.max(axis=1, keepdims=True)
    local = np.exp(emit - top)
    step = np.exp(trans)
    k = emit.shape[1]
    alpha, beta, scale = np.empty_like(local), np.empty_like(local), np.ones(len(local))
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(longest), "left")  # sequences longer than t
    for t in range(longest):
        at = starts[: live[t]] + t
        a = local[at] if t == 0 else (alpha[at - 1] @ step) * local[at]
        scale[at] = total = a.sum(axis=1)
        alpha[at] = a / total[:, None]
    pairs = np.zeros((k, k))
    for t in range(longest - 1, -1, -1):
        at = starts[: live[t]] + t
        more = live[t + 1] if t + 1 < longest else 0
        beta[at[more:]] = 1.0
        if more:
            ahead = at[:more] + 1
            after = local[ahead] * beta[ahead] / scale[ahead][:, None]
            beta[at[:more]] = after @ step.T
            pairs += step * (alpha[at[:more]].T @ after)
    return alpha * beta, pairs, float((np.log(scale) + top[:, 0]).sum())


#: Multipliers of a gram's letters and of its kind.
FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


class Features:
    """Hashed features of words; lexicon: word to language number."""

    def __init__(self, lexicon: dict[str, int], n: int = FEATURES):
        self.lexicon, self.n = lexicon, n

    def _hashed(self, kind: int, *letters: np.ndarray) -> np.ndarray:
        h = np.full(len(letters[0]), kind * FACTORS[3] & 0xFFFFFFFF, np.uint32)
        for x, k in zip(letters, FACTORS, strict=False):
            h = (h ^ x) * np.uint32(k)
            h ^= h >> np.uint32(15)
        return (h % np.uint32(self.n)).astype(np.int64)

    def ragged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all words, and the bounds of each word's: affixes and lexicon, then bigrams, then trigrams."""
        marked = [f"<{w}>" for w in words]
        size = np.fromiter(map(len, marked), np.int64, len(marked))  # 3 at least
        flat = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32)
        first = np.cumsum(size) - size
        last = first + size - 1
        affix = [self._hashed(1, *(flat[first + i] for i in range(2)))]
        affix.append(self._hashed(2, *(flat[first + i] for i in range(3))))
        affix.append(self._hashed(3, *(flat[np.minimum(first + i, last)] for i in range(4))))
        affix.append(self._hashed(4, *(flat[last - i] for i in range(2))))
        affix.append(self._hashed(5, *(flat[last - i] for i in range(3))))
        affix.append(self._hashed(6, *(flat[np.maximum(last - i, first)] for i in range(4))))
        affix.append(self._hashed(7, np.fromiter((self.lexicon.get(w, -1) + 1 for w in words), np.uint32, len(words))))
        fixed = len(affix)
        two, three = size - 1, size - 2
        bounds = np.r_[0, np.cumsum(fixed + two + three)]
        out = np.empty(int(bounds[-1]), np.int64)
        for i, x in enumerate(affix):
            out[bounds[:-1] + i] = x
        for kind, n, length in ((8, two, 2), (9, three, 3)):
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(first, n) + place
            shift = fixed + (two if length == 3 else 0)
            out[np.repeat(bounds[:-1] + shift, n) + place] = self._hashed(kind, *(flat[at + i] for i in range(length)))
        return out, bounds


class Tagger:
    """A trained field; predict() labels documents."""

    def __init__(self, langs: list[str], features: Features, weights: np.ndarray, trans: np.ndarray):
        self.langs, self.features, self.weights, self.trans = langs, features, weights, trans
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, len(langs)))

    def __getstate__(self):
        return {"langs": self.langs, "features": self.features, "weights": self.weights, "trans": self.trans, "known": {}, "rows": np.zeros((0, len(self.langs)))}

    def emissions(self, words: list[str]) -> np.ndarray:
        flat, bounds = self.features.ragged(words)
        return np.add.reduceat(self.weights[flat], bounds[:-1], axis=0) if len(words) else np.zeros((0, len(self.langs)))

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of all words, bounds of the texts' words, and each word's likeliest label."""
        return self.label_words([words_of(t) for t in texts])

    def label_words(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.known) * len(self.langs) > REMEMBERED:
            self.known, self.rows = {}, self.rows[:0]
        new = list(set(chain.from_iterable(cut)).difference(self.known))
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, self.emissions(new)])
        bounds = np.r_[0, np.cumsum([len(c) for c in cut])].astype(np.int64)
        get = self.known.__getitem__
        codes = np.fromiter(map(get, chain.from_iterable(cut)), np.int64, int(bounds[-1]))
        marginal, _, _ = forward_backward(self.rows[codes], bounds, self.trans)
        return marginal, bounds, marginal.argmax(axis=1) if len(codes) else np.zeros(0, np.int64)

    def predict(self, texts: list[str]) -> list[tuple[str, float, int, int]]:
        cut = [words_of(t) for t in texts]
        chains = [(i, ws[at : at + SEGMENT]) for i, ws in enumerate(cut) for at in range(0, len(ws), SEGMENT)]
        sums, turned, before = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64), np.full(len(texts), -1)
        at = 0
        while at < len(chains):
            to, n = at, 0
            while to < len(chains) and (to == at or (n + len(chains[to][1])) * len(self.langs) <= CELLS):
                n += len(chains[to][1])
                to += 1
            marginal, bounds, best = self.label_words([ws for _, ws in chains[at:to]])
            each = np.add.reduceat(marginal, bounds[:-1], axis=0)
            turns = np.r_[0, np.cumsum(np.r_[False, best[1:] != best[:-1]])]
            for (i, _), row, a, b in zip(chains[at:to], each, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                sums[i] += row
                turned[i] += int(turns[b] - turns[a + 1]) + int(before[i] >= 0 and before[i] != best[a])
                before[i] = best[b - 1]
            at = to
        out = []
        for i, ws in enumerate(cut):
            k = int(sums[i].argmax())
            out.append((self.langs[k], float(min(1.0, max(0.0, sums[i, k] / len(ws)))), len(ws), int(turned[i])) if ws else ("und", 0.0, 0, 0))
        return out


def train(rows: list[tuple[str, str]], rounds: int = 30, seed: int = 5) -> Tagger | None:
    """rows: text, lang. Full-batch gradient steps (Adam) on the penalised log-likelihood."""
    rows = [(words_of(t), g) for t, g in sorted(rows)]
    rows = [(w, g) for w, g in rows if w]
    if not rows:
        return None
    langs = sorted({g for _, g in rows})
    number = {g: i for i, g in enumerate(langs)}
    k = len(langs)
    seen: dict[str, Counter] = {}
    for ws, g in rows:
        for w in ws:
            seen.setdefault(w, Counter())[number[g]] += 1
    lexicon = {}
    for w, c in seen.items():
        (best, n), total = c.most_common(1)[0], sum(c.values())
        if total >= 5 and n >= 0.8 * total:
            lexicon[w] = best
    n_features = min(FEATURES, 1 << int(math.log2(max(1, WEIGHTS // k))))
    features = Features(lexicon, n_features)
    # spliced sequences: spans of 10 to 60 words, each from another document
    rng = random.Random(seed)
    spans = []
    for ws, g in rows:
        at = 0
        while at < len(ws):
            n = rng.randint(10, 60)
            spans.append((ws[at : at + n], number[g]))
            at += n
    rng.shuffle(spans)
    vocab = {w: i for i, w in enumerate(sorted(seen))}
    sequences = [spans[i : i + 6] for i in range(0, len(spans), 6)]
    codes = np.array([vocab[w] for s in sequences for ws, _ in s for w in ws], np.int64)
    gold = np.array([g for s in sequences for ws, g in s for _ in ws], np.int64)
    bounds = np.r_[0, np.cumsum([sum(len(ws) for ws, _ in s) for s in sequences])].astype(np.int64)
    flat, ends = features.ragged(list(vocab))
    owner = np.repeat(np.arange(len(vocab)), np.diff(ends))
    weights, trans = np.zeros((n_features, k)), np.zeros((k, k))
    inner = np.ones(len(codes), bool)
    inner[bounds[:-1]] = False
    at = np.flatnonzero(inner)
    gold_pairs = np.zeros((k, k))
    np.add.at(gold_pairs, (gold[at - 1], gold[at]), 1)
    # sequences that are looked at together
    parts, first = [], 0
    for i in range(1, len(bounds)):
        if i == len(bounds) - 1 or (bounds[i + 1] - bounds[first]) * k > CELLS:
            parts.append((first, i))
            first = i
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(trans), np.zeros_like(trans)]
    for r in range(1, rounds + 1):
        by_vocab = np.add.reduceat(weights[flat], ends[:-1], axis=0)
        by_word, pairs = np.zeros((len(vocab), k)), np.zeros((k, k))
        for a, b in parts:
            own = slice(bounds[a], bounds[b])
            marginal, met, _ = forward_backward(by_vocab[codes[own]], bounds[a : b + 1] - bounds[a], trans)
            marginal[np.arange(len(marginal)), gold[own]] -= 1
            for j in range(k):
                by_word[:, j] -= np.bincount(codes[own], marginal[:, j], len(vocab))
            pairs += met
        g_w = np.stack([np.bincount(flat, by_word[owner, j], n_features) for j in range(k)], axis=1) - 0.1 * weights
        g_t = gold_pairs - pairs - 0.1 * trans
        for x, g, m, v in ((weights, g_w, moments[0], moments[1]), (trans, g_t, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Tagger(langs, features, weights.astype(np.float32), trans)


def fold(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4))


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """Labelled texts outside the held-out fold, of every language."""
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), fold().alias("fold"))
    rows = rows.filter("lang is not null and text is not null and fold <> 2").withColumn("th", F.xxhash64("text"))
    n = rows.select("lang").distinct().count()
    each = min(SAMPLE * SAMPLE_CHARS, SAMPLE_CELLS // max(1, n * n))  # characters a language
    documents = min(SAMPLE, max(1, each // 200))
    chars = min(SAMPLE_CHARS, max(200, each // documents))
    # keys are ranked without their texts, and by task first, so a large language isn't gathered
    key = F.xxhash64(F.lit(3), "id", "th")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(key, "id", "th"))
    chosen = rows.select("id", "th", "lang").withColumn("rank", rank).filter(F.col("rank") <= documents).select(F.coalesce("id", F.lit("")).alias("of"), "th", "lang").distinct()
    # `documents` rows a language, an id and two more columns each
    chosen = F.broadcast(chosen) if n * documents * 200 <= BROADCAST_BYTES else chosen
    of = rows.withColumn("of", F.coalesce("id", F.lit("")))
    found = of.join(chosen, ["of", "th", "lang"], "left_semi").select("lang", F.substring("text", 1, chars).alias("text"), "th", "of").dropDuplicates(["lang", "th", "of"])
    return [(r["text"], r["lang"]) for r in found.select("text", "lang").collect()]


def predict(docs: DataFrame, tagger: Tagger | None) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # FEATURES rows, a lexicon of the sample

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=2 << 20):
            texts = texts_of(batch)
            found = shared.value.predict(texts) if shared.value else [("und", 0.0, 0, 0)] * len(texts)
            cols = list(zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(cols[0]), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())],
                names=["doc_id", "held_out", "lang_pred", "score", "n_words", "n_switches"],
            )

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 2).alias("held_out"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def language_id(docs: DataFrame) -> DataFrame:
    return predict(docs, train(sample(docs)))
