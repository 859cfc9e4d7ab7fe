import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tracklake.llm import ngram_join

from .fixtures import documents, texts, words


def sets_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, groups=False):
    sets = [sets_of(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    if groups:
        return len({find(i) for i in range(len(rows)) if sets[i]})
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    docs = documents(spark, texts(seed))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect())
    assert got == brute(rows)


def test_borderline_chains_and_popular_passages(spark):
    rng = random.Random(3)
    rows = []
    passage = words(rng, 60)
    for _ in range(12):  # many edits of one text, most of them too far apart; all with one passage
        base = words(rng, 140)
        for _ in range(8):
            w = list(base)
            for _ in range(3):
                w[rng.randrange(len(w))] = "e" + str(rng.randrange(9999))
            rows.append(" ".join(passage + w))
    docs = documents(spark, rows)
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect())
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_keep_one_keeps_columns_and_one_of_each_group(spark):
    docs = documents(spark)
    kept = ngram_join.keep_one(docs)
    assert kept.schema == docs.schema
    rows = kept.collect()
    groups = brute([(r.doc_id, r.text) for r in docs.collect()], groups=True)
    full = [r for r in rows if sets_of(r.text)]
    assert len(full) == groups
    assert len([r for r in rows if not sets_of(r.text)]) == len([r for r in docs.collect() if not sets_of(r.text)])


def test_empty_table(spark):
    docs = documents(spark, [])
    assert ngram_join.near_duplicates(docs).collect() == []
    assert ngram_join.keep_one(docs).collect() == []


def test_plans_hold_the_pigeonhole_bound():
    ends = ngram_join.band_ends()
    assert [ngram_join.plan(b)[0] for b in range(3)] == ["equal", "neighbourhood", "elements"]
    for low, high in ends[:20]:
        for r in {low, high, max(1, (3 * low + 3) // 4)}:
            for s in range(r, min(high, r * 4 // 3) + 1):
                shared = -(-3 * (r + s) // 7)  # the least intersection of a link
                assert r + s - 2 * shared <= ngram_join.differences(r, high)


def test_sketches_bound_differences():
    rng = np.random.RandomState(4)
    a = rng.randint(0, 2**62, 300).astype(np.uint64)
    b = np.r_[a[:250], rng.randint(0, 2**62, 40).astype(np.uint64)]
    s = ngram_join.sketches(np.r_[a, b], np.array([0, 300, 590])).view(np.uint64)
    bits = sum(int(x).bit_count() for x in (s[0] ^ s[1]))
    assert bits <= 90


def test_shingles_of_short_texts():
    tokens, bounds = ngram_join.shingles(pa.array([None, "", "a", "a b", "A B", "a b c d e", "a b c d e f"]))
    assert np.diff(bounds).tolist() == [0, 0, 1, 1, 1, 1, 2]
    assert tokens[bounds[3]] == tokens[bounds[4]]


def near_copies(rng, n):
    """Copies of one text with so many edits that some are linked with it, some only with each other, most of the rest with nothing; and chains."""
    base = words(rng, 150)
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 5, 6, 7, 9])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        if i % 3 == 0:
            at = rng.randrange(len(w))
            w[at:at] = words(rng, rng.randrange(1, 25))
        rows.append(" ".join(w))
        if i % 10 == 0:  # a neighbour that shares its edits
            w[rng.randrange(len(w))] = "other"
            rows.append(" ".join(w))
    return rows


def test_one_group_of_hundreds_of_near_copies_in_many_components(spark):
    docs = documents(spark, near_copies(random.Random(6), 400))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute(rows)
    assert 20 < len({c for _, _, c in want}) < len(rows) - 20
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(docs).collect())
    assert got == want


def test_candidates_of_a_mixed_group_are_no_pairs(spark):
    """Sets of other components than their leader's are left out by counts of elements before any pair is formed."""
    made = {}
    for n in (100, 400):
        rng = random.Random(7)
        base = words(rng, 150)
        rows = []
        for _ in range(n):
            w = list(base)
            for _ in range(9):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((" ".join(w),))
        texts_ = pa.array([r[0] for r in rows])
        tokens, bounds = ngram_join.shingles(texts_)
        sets = spark.createDataFrame([(i, int(bounds[i + 1] - bounds[i]), tokens[bounds[i] : bounds[i + 1]].view(np.int64).tolist()) for i in range(n)], "hi long, n long, tokens array<long>")
        nodes = sets.selectExpr("hi as node", "hi as label")
        made[n] = ngram_join._partnered(nodes, sets).select("node").distinct().count()
    assert made[400] < 40, made
