"""The prefix trie against one built node by node in plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tracklake.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, n long, top string"


def plain(rows):
    turns = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            said = (role or "", text or "")
            digest = hashlib.sha256(f"{len(said[0].encode())}:{said[0]}{said[1]}".encode()).digest()[:16]
            turns[c].append(((turn is not None, turn or 0, digest), said))
    own = {c: [said for _, said in sorted(t)] for c, t in turns.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        first = c - (c % 5 if c >= 0 else -(-c % 5))
        said = own.get(first, [])[:h] + mine[h:]
        for d in range(len(said) + 1):
            members[tuple(said[:d])].append(c)
        ends[tuple(said)].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[c] for c in children[path]) or 1
        saved[path] = sum(saved[c] for c in children[path]) + (len(members[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
    return sorted(
        (
            (
                *(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p]),
                hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest(),
            )
            for p, m in members.items()
        ),
        key=str,
    )


def table(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-12, n), 10**12, 10**12 + 3]:
        if c % 7 == 5:
            continue
        kind = rng.random()
        said = [("user", rng.choice(["hot", "hot", "hot", f"é{rng.randrange(4)}"]))]
        said += [(rng.choice(["user", "assistant"]), rng.choice(["a", "b", "", "long " * 30])) for _ in range(rng.choice([0, 1, 2, 3, 12]))]
        if kind < 0.3:
            said = [("user", "hot"), ("assistant", "same"), ("user", "same")]
        rows += [(c, rng.choice([i, i]) if rng.random() < 0.95 else None, r if rng.random() < 0.95 else None, t, "clash", 1, "t") for i, (r, t) in enumerate(said)]
    rows += [(3, None, None, None, None, None, None), (None, 1, "user", "nobody's", "k", 1, "t"), rows[5], rows[5]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [None, 1, 40])
def test_trie_equals_the_plain_one(spark, limit):
    rows = table(1)
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), limit)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_ids_of_an_end_come_in_chunks(spark, monkeypatch):
    rows = [(c, 0, "user", "hot", None, None, None) for c in range(700)] + [(c, 0, "user", f"own {c}", None, None, None) for c in range(700, 750)]
    monkeypatch.setattr(prefix_trie, "CHUNK", 50)
    got = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_turnless_conversations_a_single_one_and_none(spark):
    absent = [c for c in range(1, 60) if zlib.crc32(str(c).encode()) % 9 > 1 and c % 5]
    rows = [(absent[0], 1, "user", "gone: its family has no first", None, None, None)]
    got = [tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == plain(rows) and got[0][1] == 0 and len(got) == 1
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 1, "a", "b", None, None, None)], SCHEMA)).collect() == []
