"""A Merkle manifest of documents, with a proof for each one.

A leaf is the SHA-256 of a document's fields. The leaves of a language, in ascending order of doc_id, are the bottom
of a tree with ARITY children a node, and the languages' roots, in order of their names, that of one more tree. All
digests are hashed as lowercase hex text.

Leaves are numbered by a sort over ranges, so no task needs a language. A block is BLOCK consecutive leaves of a
language from a multiple of BLOCK on, so its nodes are nodes of the whole tree. Of each block a task first makes the
root alone; the roots are the leaves of the next, BLOCK times smaller, pass, until a language has one node left.
Then, from the top down, each block gets the proof of its own root and a fractal traversal (Jakobsson, Leighton,
Micali and Szydlo, 2003) runs over it: of the stacked subtrees of DEPTH levels on a leaf's way up it keeps the
existing ones, and of each the desired next one, which grows by a leaf a step and is whole when it is needed. So the
leaves' paths come one after another while some hundred nodes are held, and the block's upper proof is appended.

Null fields have a mark of their own. Null doc_ids come first and are never altered by a check; a null lang
is a language of its own, the first. Empty and long texts are hashed whole. Of equal doc_ids the lower leaf comes
first; repeated rows, equal in all fields, are interchangeable, each with its own proof. Extra columns, whatever
their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordering import with_row_number
from .common import free_name, written

#: Children of a node, levels of a subtree, and leaves of a block (a power of ARITY).
ARITY, DEPTH, BLOCK = 8, 2, 8**4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<place: int, siblings: string>>"
PROOF_ARROW = pa.list_(pa.struct([pa.field("place", pa.int32()), pa.field("siblings", pa.string())]))


def digest(children: Sequence[bytes]) -> bytes:
    return hashlib.sha256(b"".join(children)).hexdigest().encode()


def levels(n: int) -> int:
    """Levels above n nodes until one is left."""
    out = 0
    while n > 1:
        n, out = -(-n // ARITY), out + 1
    return out


def levels_in_block(n: int, block: int) -> int:
    """Levels of a block in a row of n nodes: all that it can have, unless it is the only block."""
    return levels(block if n > block else n)


class TreeHash:
    """Takes leaves from the left; holds one unfinished run a level, and keeps runs of the levels it is told to."""

    def __init__(self, height: int, keep: range = range(0)):
        self.height, self.keep = height, keep
        self.runs: list[list[bytes]] = [[] for _ in range(height + 1)]
        self.kept: dict[int, list[list[bytes]]] = {level: [] for level in keep}

    def add(self, node: bytes, level: int = 0) -> None:
        run = self.runs[level]
        if level in self.kept and not run:
            self.kept[level].append(run)
        run.append(node)
        if len(run) == ARITY and level < self.height:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        self.add(digest(run), level + 1)

    def root(self) -> bytes:
        """Closes the runs that are short."""
        for level in range(self.height):
            if self.runs[level]:
                self._close(level)
        return self.runs[self.height][0]


class FractalTraversal:
    """Successive paths of a block's leaves: for each level, the place in its run and the run's other nodes."""

    def __init__(self, leaves: Sequence[bytes], height: int):
        self.leaves, self.height = leaves, height
        self.bands = [range(a, min(a + DEPTH, height)) for a in range(0, height, DEPTH)]
        self.span = [ARITY**band.stop for band in self.bands]  # leaves below a subtree of a band
        self.existing = [self._subtree(i, 0).kept for i in range(len(self.bands))]
        self.desired = [TreeHash(band.stop, band) for band in self.bands]
        self.at = 0

    def _subtree(self, i: int, first: int) -> TreeHash:
        tree = TreeHash(self.bands[i].stop, self.bands[i])
        for leaf in self.leaves[first : first + self.span[i]]:
            tree.add(leaf)
        tree.root()
        return tree

    def __iter__(self) -> Iterator[list[tuple[int, bytes]]]:
        n = len(self.leaves)
        for at in range(n):
            path = []
            for i, band in enumerate(self.bands):
                within = at % self.span[i]
                for level in band:
                    index = within // ARITY**level
                    run, place = self.existing[i][level][index // ARITY], index % ARITY
                    path.append((place, b"".join(run[:place] + run[place + 1 :])))
            yield path
            for i, span in enumerate(self.span):
                if at + span < n:  # a leaf for the next subtree
                    self.desired[i].add(self.leaves[at + span])
                if (at + 1) % span == 0 and at + 1 < n:
                    self.desired[i].root()
                    self.existing[i], self.desired[i] = self.desired[i].kept, TreeHash(self.bands[i].stop, self.bands[i])


def leaf_of(text: Column | str = "text", fields: Sequence[str] = FIELDS) -> Column:
    """The digest (binary) of a row's fields, the last one given as a column."""

    def field(c: Column | str) -> Column:
        value = (F.col(c) if isinstance(c, str) else c).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(field, fields[:-1]), field(text)).cast("binary"), 256))


def _block_roots(nodes: DataFrame, block: int) -> DataFrame:
    """The roots of all blocks, as nodes of the next pass."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        tree = TreeHash(levels_in_block(n, block))
        for node in table.column("digest").to_pylist():
            tree.add(node.hex().encode())
        columns = [[key[0].as_py()], [key[1].as_py()], [-(-n // block)], [bytes.fromhex(tree.root().decode())]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["tree", "pos", "n", "digest"])

    blocked = nodes.select("tree", F.expr(f"pos div {block}").alias("block"), "pos", "n", "digest")
    return blocked.groupBy("tree", "block").applyInArrow(run, "tree string, pos long, n long, digest binary")


def _paths(nodes: DataFrame, upper: DataFrame, block: int) -> DataFrame:
    """nodes with their proofs: the path within the block, then the block's own proof from upper(tree, pos, proof, strings to repeat)."""
    more = [c for c in upper.columns if c not in ("tree", "pos", "proof")]

    def run(key: tuple, table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table.column("n")[0].as_py()
        rest = above.column("proof")[0].as_py()
        places, siblings = [s["place"] for s in rest], [s["siblings"].encode() for s in rest]
        leaves = [node.hex().encode() for node in table.column("digest").to_pylist()]
        all_places: list[int] = []
        all_siblings: list[bytes] = []
        for path in FractalTraversal(leaves, levels_in_block(n, block)):
            all_places += [p for p, _ in path] + places
            all_siblings += [s for _, s in path] + siblings
        ends = np.arange(len(leaves) + 1, dtype=np.int32) * (len(all_places) // len(leaves))
        steps = pa.StructArray.from_arrays([pa.array(all_places, pa.int32()), pa.array(all_siblings, pa.binary()).cast(pa.string())], ["place", "siblings"])
        table = table.drop_columns(["block"]).append_column(pa.field("proof", PROOF_ARROW), pa.ListArray.from_arrays(pa.array(ends), steps).cast(PROOF_ARROW))
        for c in more:
            table = table.append_column(c, pa.array([above.column(c)[0].as_py()] * len(leaves), pa.string()))
        return table

    blocked = nodes.withColumn("block", F.expr(f"pos div {block}"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema), f"proof {PROOF}", *(f"`{c}` string" for c in more)])
    return blocked.groupBy("tree", "block").cogroup(upper.withColumnRenamed("pos", "block").groupBy("tree", "block")).applyInArrow(run, schema)


def climb(nodes: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Roots (tree, digest) of the trees over nodes(tree, pos from 0, n nodes of the tree, digest), and the proofs (tree, pos, proof) of all blocks' roots."""
    roots = written(_block_roots(nodes, block), "block-roots")
    if (roots.agg(F.max("n")).first()[0] or 0) > 1:
        tops, upper = climb(roots, block)
        return tops, _paths(roots, upper, block).select("tree", "pos", "proof")
    return roots.select("tree", "digest"), roots.select("tree", "pos", F.expr(f"cast(array() as {PROOF})").alias("proof"))


def numbered(leaves: DataFrame) -> DataFrame:
    """Adds pos (from 0 in each tree's order of doc_id and digest) and n to leaves(tree, doc_id, digest, ...)."""
    place = free_name(leaves, "place")
    leaves = written(leaves.withColumn(place, F.monotonically_increasing_id()), "leaves")  # texts are read once
    ordered = written(leaves.orderBy("tree", "doc_id", "digest", place).withColumn(place, F.monotonically_increasing_id()), "ordered-leaves", [leaves])
    part = F.shiftright(place, 33)
    runs = ordered.groupBy("tree", part.alias("part")).agg(F.min(place).alias("first"), F.count("*").alias("k"))
    whole = Window.partitionBy("tree")
    runs = runs.select("tree", "part", "first", (F.sum("k").over(whole.orderBy("part")) - F.col("k")).alias("before"), F.sum("k").over(whole).alias("n"))
    joined = ordered.withColumn("part", part).join(runs, ["tree", "part"])
    return joined.withColumn("pos", F.col(place) - F.col("first") + F.col("before")).drop(place, "part", "first", "before")


def manifest(docs: DataFrame, altered: Column | None = None, block: int = BLOCK) -> DataFrame:
    """doc_id, leaf, subroot, root (hex) and proof of each document, and altered_leaf if a changed text is given for some rows.

    proof: for each level from the leaf to the root the node's place in its run and the run's other digests.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit(""))  # null first, then by bytes
    changed = leaf_of(altered) if altered is not None else F.lit(None)
    used = F.lit(False) if altered is None else altered.isNotNull()
    leaves = docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of().alias("digest"), F.when(used, changed).cast("binary").alias("changed"))
    leaves = written(numbered(leaves), "numbered-leaves")
    subroots, upper = climb(leaves, block)
    subroots = written(subroots, "subroots")
    top = with_row_number(subroots, ["tree"], "pos", start=0)
    top = top.select(F.lit("").alias("tree"), F.col("tree").alias("language"), "pos", F.lit(subroots.count()).cast("long").alias("n"), "digest")
    roots, over = climb(top, block)
    root = roots.first()
    over = _paths(top, over, block).select(F.col("language").alias("tree"), F.lower(F.hex("digest")).alias("subroot"), F.col("proof").alias("over"))
    upper = upper.join(written(over, "language-proofs"), "tree")
    upper = upper.select("tree", "pos", F.concat("proof", "over").alias("proof"), "subroot", F.lit(root.digest.hex() if root else None).cast("string").alias("root"))
    hexed = lambda c: F.lower(F.hex(c))
    return _paths(leaves, upper, block).select("doc_id", hexed("digest").alias("leaf"), "subroot", "root", "proof", hexed("changed").alias("altered_leaf"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    digits = 64
    own = lambda node, step: F.concat(F.substring(step["siblings"], F.lit(1), step["place"] * digits), node, F.substring(step["siblings"], step["place"] * digits + 1, F.lit(digits * ARITY)))
    return F.aggregate(proof, leaf, lambda node, step: F.sha2(own(node, step).cast("binary"), 256))


def checked(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The manifest's digests, and what a check finds after every document whose CRC-32 of the id divides by 3 had its capitals lower-cased."""
    utf8 = F.col("text").cast("string")
    lowered = F.translate(utf8, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 3 == 0
    rows = manifest(docs, F.when(hit, lowered), block)
    rows = rows.withColumn("folded_root", folded(F.coalesce("altered_leaf", "leaf"), F.col("proof")))
    joined = F.array_join(F.transform("proof", lambda s: s["siblings"]), "").cast("binary")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(joined, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
