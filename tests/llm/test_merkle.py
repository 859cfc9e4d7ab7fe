"""The manifest against a tree built level by level in plain Python."""

import hashlib
import random
import string
import zlib

import pytest
from pyspark.sql import functions as F

from tracklake.llm import merkle

from .fixtures import documents

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def climb(nodes):
    """The root, and each node's siblings and places by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 8] for i in range(0, len(nodes), 8)]
        for k, i in enumerate(at):
            run, place = runs[i // 8], i % 8
            paths[k].append((run, place))
            at[k] = i // 8
        nodes = [sha(*run) for run in runs]
    return nodes[0], paths


def plain(rows):
    by_lang, out = {}, []
    for r in rows:
        by_lang.setdefault(r.lang, []).append(r)
    langs = sorted(by_lang, key=lambda v: (v is not None, (v or "").encode()))
    trees = {}
    for lang in langs:
        rs = sorted(by_lang[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees[lang] = rs, *climb([leaf(r, r.text) for r in rs])
    root, over = climb([trees[lang][1] for lang in langs])
    for lang, top in zip(langs, over, strict=True):
        rs, subroot, paths = trees[lang]
        for r, path in zip(rs, paths, strict=True):
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and r.text is not None
            node = leaf(r, r.text.translate(LOWER) if hit else r.text)
            siblings = []
            for run, place in path + top:
                node = sha(*run[:place], node, *run[place + 1 :])
                siblings += run[:place] + run[place + 1 :]
            out.append((r.doc_id, leaf(r, r.text), subroot, root, sha(*siblings), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("n", [1, 2, 7, 8, 9, 64, 65, 511, 512, 513, 700])
def test_traversal_gives_every_path(n):
    leaves = [sha(str(i)).encode() for i in range(n)]
    height = merkle.levels(n)
    root, paths = climb([x.decode() for x in leaves])
    tree = merkle.TreeHash(height)
    for x in leaves:
        tree.add(x)
    assert tree.root().decode() == root
    walk = merkle.FractalTraversal(leaves, height)
    got = [[(p, s.decode()) for p, s in path] for path in walk]
    assert got == [[(place, "".join(run[:place] + run[place + 1 :])) for run, place in path] for path in paths]
    held = sum(len(run) for kept in [*walk.existing, *(t.kept for t in walk.desired)] for runs in kept.values() for run in runs)
    assert held <= 2 * len(walk.bands) * (merkle.ARITY + merkle.ARITY**merkle.DEPTH)


@pytest.mark.parametrize("block", [8, 4096])
def test_manifest_equals_the_plain_tree(spark, block):
    rng = random.Random(block)
    docs = documents(spark)
    rows = [(i if rng.random() > 0.02 else None, rng.choice(["A b", "c", "É D", None, ""]), rng.choices(["en", "de", None, "", "z", "é"], [60, 10, 3, 1, 1, 1])[0], rng.choice(["s", None]), rng.choice([None, -3, 12])) for i in range(-150, 450)]
    more = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.unionByName(more.union(more.limit(40)), allowMissingColumns=True)
    got = [tuple(r) for r in merkle.checked(docs, block).collect()]
    want = plain(docs.collect())
    assert sorted(got, key=str) == want and {r[-1] for r in got} == {True, False}


def test_many_languages_and_an_empty_table(spark):
    docs = spark.range(70).selectExpr("id doc_id", "'T' text", "concat('l', id div 2) lang", "'s' source", "id n_chars")
    assert sorted((tuple(r) for r in merkle.checked(docs, 8).collect()), key=str) == plain(docs.collect())
    assert merkle.checked(documents(spark).filter("false")).collect() == []
    one = docs.limit(1)
    assert [tuple(r) for r in merkle.checked(one).collect()] == plain(one.collect())


def test_proofs_show_any_change(spark):
    docs = documents(spark).filter("doc_id is not null")
    rows = merkle.manifest(docs, F.concat("text", F.lit("!")), 64)
    rows = rows.select("doc_id", "altered_leaf", (merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).alias("whole"), (merkle.folded(F.col("altered_leaf"), F.col("proof")) == F.col("root")).alias("same")).collect()
    assert all(r.whole for r in rows) and not any(r.same for r in rows if r.altered_leaf) and sum(r.altered_leaf is None for r in rows) == 1
