import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tracklake.llm import suffix_dedup
from tracklake.llm.suffix_dedup import GRAM, LENGTH, PASSAGE

from .fixtures import documents, words


def covered(raw, length):
    """Which bytes of each document strings of that length cover that start anywhere else too."""
    seen = Counter(r[p : p + length] for r in raw for p in range(len(r) - length + 1))
    for r in raw:
        edge = np.zeros(len(r) + 1, int)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                edge[p] += 1
                edge[p + length] -= 1
        yield np.cumsum(edge[:-1]) > 0


def brute(rows, length=LENGTH, passage=PASSAGE):
    raw = [(t or "").encode() for _, t in rows]
    out = []
    for (d, _), r, gone, shorter in zip(rows, raw, covered(raw, length), covered(raw, passage), strict=True):
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((d, len(r), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(r, np.uint8)[~gone].tobytes()).hexdigest(), int(shorter.sum())))
    return Counter(out)


def hard_rows():
    rng = random.Random(8)
    passages = [" ".join(words(rng, n)) for n in (60, 75, 120)]
    rows = ["ab" * 500, "ab" * 260 + "c" * 30, "x" * 399, "x" * 401, "é" * 300]
    for i in range(40):
        p = passages[i % 3]
        cut = rng.randrange(0, 30)
        rows.append(" ".join(words(rng, rng.randrange(1, 60))) + p[cut:] + " ".join(words(rng, rng.randrange(1, 60))))
        if i % 9 == 0:
            w = list(rows[-1])
            w[rng.randrange(len(w))] = "#"
            rows.append("".join(w))
    return rows


def same(spark, docs, length=LENGTH, passage=PASSAGE):
    got = Counter(tuple(r) for r in suffix_dedup.repeated_bytes(docs, length, passage).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes").collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], length, passage)


def test_removal_equals_brute_force(spark):
    same(spark, documents(spark))


@pytest.mark.parametrize(("length", "passage"), [(64, 64), (300, 90), (120, 500)])
def test_other_lengths(spark, length, passage):
    same(spark, documents(spark, hard_rows()), length, passage)


def test_passages_periods_and_near_copies(spark):
    same(spark, documents(spark, hard_rows()))


def test_long_documents_in_parts_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 2048)
    raw = [(t or "").encode() for t in hard_rows()]
    whole, parts = set(), set()
    for size, out in ((1 << 20, whole), (2048, parts)):
        monkeypatch.setattr(suffix_dedup, "PIECE", size)
        for data, where, bounds, first, last in suffix_dedup.pieces([b" ".join(raw), *raw]):
            at, own, *rest = suffix_dedup.anchors(np.frombuffer(data, np.uint8), bounds, first, last)
            out |= {(where[o][0], int(a - bounds[o] + where[o][1]), *map(int, x)) for a, o, *x in zip(at, own, *rest, strict=True)}
    assert whole == parts


def test_a_long_document_loses_the_right_bytes(spark, monkeypatch):
    """Longer than PIECE: its repeats lie in other parts, and in another document."""
    rng = random.Random(3)
    passage = " ".join(words(rng, 90))
    long = "".join(f"{rng.random()} " for _ in range(62_000))
    at = 1 << 20
    long = long[: at - 150] + passage + long[at - 150 : at + 50_000] + passage + long[at + 50_000 :]
    docs = documents(spark, [long, "before " + passage + " after"])
    rows = suffix_dedup.repeated_bytes(docs).orderBy("doc_id").collect()
    n = len(passage.encode())
    assert [(r.n_removed, r.n_spans) for r in rows] == [(2 * n, 2), (n, 1)] and len(long) > suffix_dedup.PIECE


def index_of(contexts, group, lefts, lengths):
    offsets = np.r_[0, np.cumsum([len(c) for c in contexts])].astype(np.int64)
    return suffix_dedup.RunLengthIndex(np.array(group), np.array(lefts, np.int64), np.frombuffer(b"".join(contexts), np.uint8), offsets, lengths)


@pytest.mark.parametrize("lengths", [(200,), (200, 90), (90, 100, 260)])
def test_index_matches_direct_comparison(lengths):
    rng = random.Random(2)
    before, after = min(lengths) - GRAM, max(lengths)
    contexts, group, lefts = [], [], []
    for g in range(4):
        base = bytes(rng.choice(b"ab") for _ in range(before + after))
        for _ in range(14):
            c = bytearray(base)
            for _ in range(rng.randrange(4)):
                c[rng.randrange(len(c))] = rng.choice(b"cd\0")
            c[before : before + GRAM] = base[before : before + GRAM]
            left, right = rng.choice([before, before // 2, 0]), rng.choice([after, after, after - 20, GRAM])
            contexts.append(bytes(c[before - left : before + right]))
            group.append(g)
            lefts.append(left)
    got = index_of(contexts, group, lefts, lengths).repeats(lengths)

    def at(i, p, length):
        a = p - (before - lefts[i])
        return contexts[i][a : a + length] if a >= 0 and a + length <= len(contexts[i]) else None

    for k, length in enumerate(lengths):
        for p in range(before + 1):
            for i in range(len(contexts)):
                want = at(i, p, length) is not None and any(j != i and group[j] == group[i] and at(j, p, length) == at(i, p, length) for j in range(len(contexts)))
                assert got[k, i, p] == want, (length, p, i)


def test_index_holds_runs_and_their_samples():
    """Of many contexts that differ in few bytes, a place holds few runs or none; what is stored grows with the edits, not with the text."""
    rng = random.Random(4)
    lengths = (400,)
    before, after = 400 - GRAM, 400
    base = bytes(rng.choice(b"abcdefgh ") for _ in range(before + after))
    contexts = [base[:k] + b"#" + base[k + 1 :] for k in range(0, before, 2)] + [base[:k] + b"$" + base[k + 1 :] for k in range(before + GRAM, before + after, 2)]
    index = index_of(contexts, [0] * len(contexts), [before] * len(contexts), lengths)
    held = [p for p in index.places if p is not None]
    assert len(index.places) == before and len(held) <= before // 2 + 1
    runs = sum(len(p[0]) for p in held)
    assert runs < 4 * len(contexts) < len(contexts) * before / 50
    for heads, length, _, first, last, _ in held:
        assert len(heads) == len(length) == len(first) == len(last)
    kept = index.repeats(lengths)
    assert kept.any()


def test_cut_texts_keep_columns(spark):
    docs = documents(spark, hard_rows())
    out = suffix_dedup.cut_repeats(docs)
    assert out.schema == docs.schema
    assert out.count() == docs.count()
    assert out.filter("n_chars <> length(text)").count() == 0
    assert suffix_dedup.cut_repeats(documents(spark, [])).collect() == []
