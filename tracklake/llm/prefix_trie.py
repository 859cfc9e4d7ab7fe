"""The prefix trie of a table of conversations: shared beginnings, and what keeping each of them once would save.

A turn is held as 128 bits of the SHA-256 of its role and text. Equal conversations are one sequence with a
count, added up before they travel. Sequences are hash-partitioned by the digest of their first turn, and each task builds
its tries as dictionaries of pointers and sums their nodes in an iterative postorder. A first turn whose
subtrie is oversized (its sequences have more turns than `limit`) is split by the next turn, again and again, and the
nodes above the cuts are added up from the parts below them, deepest first.

The ids of the conversations that end in one node are sorted over all tasks, joined to chunks of text by those
who hold them, and hashed chunk by chunk; so a node with any number of them costs its task only the hashing.

Turns are ordered by their number, null first, and of equal numbers by their digests; repeated rows are turns
of their own. A null role or text is empty; rows of a null conv_id belong to no conversation and are left out.
A long text is hashed where it is read; a long conversation is one row of 24 bytes a turn. Conversations without turns
are members of the root alone. Extra columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions, small_batches, written

#: Turns of a subtrie that a task may hold, and of a chunk of ids the bytes.
LIMIT, CHUNK = 100_000, 1 << 20
#: Turns that a conversation may take over, and conversations that share them.
HEADS, FAMILY = 9, 5
NODE = "top boolean, up string, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOTHING = hashlib.sha256(b"").hexdigest()


def conversations_of(rows: DataFrame) -> DataFrame:
    """conv_id, digests and sizes (bytes of the texts) of each conversation's turns in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    turns = rows.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").cast("long").alias("turn"), F.unhex(F.substring(turn, 1, 32)).alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("t"),
    )
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: t["digest"]).alias("digests"), F.transform("t", lambda t: t["size"]).alias("sizes"))


def rebuilt(conversations: DataFrame, heads: int = HEADS, family: int = FAMILY) -> DataFrame:
    """Each conversation with its first h turns taken from the first of its family; h: the id's CRC-32 modulo heads."""
    conversations = written(conversations, "conversations")
    lists = ("digests", "sizes")
    firsts = conversations.select(F.col("conv_id").alias("family"), *(F.slice(c, 1, heads - 1).alias(f"head_{c}") for c in lists))
    own = conversations.withColumn("family", F.col("conv_id") - F.col("conv_id") % family)
    own = own.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int"))
    joined = own.join(firsts, "family", "left")

    def spliced(c: str, kind: str) -> Column:
        head = F.coalesce(F.slice(f"head_{c}", F.lit(1), F.col("h")), F.expr(f"cast(array() as array<{kind}>)"))
        return F.concat(head, F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))).alias(c)

    return joined.select("conv_id", spliced("digests", "binary"), spliced("sizes", "long"))


def prefix(k: int | Column) -> Column:
    """The first k turns, as text."""
    return F.array_join(F.transform(F.slice("digests", F.lit(1), F.lit(k)), F.hex), "")


def ends_of(members: DataFrame) -> DataFrame:
    """end and ends_sha256: the hash of the conv_ids of each end in members(end, conv_id), ascending and joined by commas."""

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, first, ids, held = None, None, [], 0

        def chunk() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([end]), pa.array([first], pa.int64()), pa.array([",".join(ids)])], names=["end", "first", "ids"])

        for batch in batches:
            for e, c in zip(batch.column("end").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (e != end or held > CHUNK):
                    yield chunk()
                    ids, held = [], 0
                if not ids:
                    end, first = e, c
                ids.append(str(c))
                held += len(ids[-1]) + 1
        if ids:
            yield chunk()

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, state = None, None
        for batch in batches:
            done: list[tuple[str, str]] = []
            for e, text in zip(batch.column("end").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if e == end:
                    state.update(b"," + text.encode())
                    continue
                if state:
                    done.append((end, state.hexdigest()))
                end, state = e, hashlib.sha256(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)] if done else [pa.array([], pa.string())] * 2, names=["end", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([end]), pa.array([state.hexdigest()])], names=["end", "ends_sha256"])

    ordered = members.select("end", "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")
    joined = ordered.mapInArrow(chunks, "end string, first long, ids string")
    return joined.repartition("end").sortWithinPartitions("end", "first").mapInArrow(hashed, "end string, ends_sha256 string")


def sequences_of(conversations: DataFrame) -> DataFrame:
    """The different sequences of turns, each with its number of conversations, the first of them, and the hash of them all."""
    named = written(conversations.withColumn("end", F.sha2(prefix(F.size("digests")).cast("binary"), 256)), "rebuilt")
    equal = named.groupBy("end").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.first("digests").alias("digests"), F.first("sizes").alias("sizes"))
    return written(equal.join(ends_of(named), "end").drop("end"), "sequences", [named])


def tries(table: pd.DataFrame) -> pd.DataFrame:
    """The nodes of the tries of a bucket of sequences; each trie's top is the prefix `key` of `k` turns."""
    tops: dict[str, int] = {}
    child: list[dict[bytes, int]] = []
    parent: list[int] = []
    depth: list[int] = []
    n: list[int] = []
    first: list[int] = []
    size: list[int] = []
    end: list[str | None] = []
    up: list[str | None] = []

    def node(above: int, level: int, own: int, of: int, key: str | None = None) -> int:
        child.append({})
        parent.append(above)
        depth.append(level)
        n.append(0)
        first.append(of)
        size.append(own)
        end.append(None)
        up.append(key)
        return len(child) - 1

    for k, key, count, least, digests, sizes, ends in zip(table.k, table.key, table.n, table["first"], table.digests, table.sizes, table.ends_sha256, strict=True):
        at = tops.get(key)
        if at is None:
            at = tops[key] = node(-1, k, sizes[k - 1], least, key[:-32])
        n[at] += count
        first[at] = min(first[at], least)
        for level in range(k, len(digests)):
            to = child[at].get(digests[level])
            if to is None:
                to = child[at][digests[level]] = node(at, level + 1, sizes[level], least)
            at = to
            n[at] += count
            first[at] = min(first[at], least)
        end[at] = ends
    leaves, saved = [0] * len(child), [0] * len(child)
    for top in tops.values():
        waiting, order = [top], []
        while waiting:  # parents before children; backwards, that is a postorder
            at = waiting.pop()
            order.append(at)
            waiting.extend(child[at].values())
        for at in reversed(order):
            below = child[at].values()
            leaves[at] = sum(leaves[c] for c in below) or 1
            saved[at] = (n[at] - 1) * size[at] + sum(saved[c] for c in below)
    return pd.DataFrame(
        {
            "top": [p < 0 for p in parent],
            "up": up,
            "conv_id": first,
            "depth": depth,
            "parent_conv_id": pd.array([first[p] if p >= 0 else None for p in parent], "Int64"),
            "n_convs": n,
            "n_children": [len(c) for c in child],
            "n_leaves": leaves,
            "saved_tokens": saved,
            "ends_sha256": pd.Series(end, dtype=object),
        }
    )


def trie(conversations: DataFrame, limit: int | None = None) -> DataFrame:
    """The nodes of the trie over conversations(conv_id, digests, sizes), from the root (depth 0) on.

    limit: turns of an oversized subtrie (default: half of a task's share, and LIMIT at most).
    """
    spark = conversations.sparkSession
    sequences = sequences_of(small_batches(conversations))
    turns = sequences.agg(F.sum(F.size("digests"))).first()[0] or 0
    limit = limit or max(1, min(LIMIT, turns // (2 * partitions(spark))))
    buckets = 2 * (turns // limit) + 1
    ended = [sequences.filter(F.size("digests") == 0).withColumn("key", F.lit(""))]
    split: list[DataFrame] = []  # at place j: the oversized prefixes of j + 1 turns
    found: list[DataFrame] = []
    rest, k = sequences.filter(F.size("digests") > 0), 1
    while True:
        rest = rest.withColumn("key", prefix(k))
        sums = rest.groupBy("key").agg(F.sum(F.size("digests")).alias("w"), F.count("*").alias("different"), F.first(F.col("sizes")[k - 1]).alias("size"))
        large = written(sums.filter((F.col("w") > limit) & (F.col("different") > 1)).select("key", "size", F.lit(True).alias("large")), "oversized")
        over = not large.isEmpty()
        if over:  # few: their weights add up to the turns of all
            rest = written(rest.join(large.select("key", "large"), "key", "left"), f"by-{k}-turns")
        fits = rest.filter("large is null").drop("large") if over else rest
        bucket = F.pmod(F.xxhash64("key"), F.lit(buckets))
        found.append(fits.withColumn("k", F.lit(k)).groupBy(bucket).applyInPandas(tries, NODE))
        if not over:
            break
        split.append(large)
        rest = rest.filter("large").drop("large")
        ended.append(rest.filter(F.size("digests") == k))
        rest, k = rest.filter(F.size("digests") > k), k + 1
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    nodes = written(nodes, "trie-nodes")
    inner = nodes.filter("not top")
    tops = nodes.filter("top")
    out = [inner]
    below: DataFrame | None = None
    for j in reversed(range(len(split) + 1)):  # the oversized prefixes of j turns; of none: the root
        children = tops.filter(F.col("depth") == j + 1)
        children = children.unionByName(below) if below is not None else children
        zero = F.lit(0).cast("long")
        parts = children.select(F.col("up").alias("key"), "n_convs", "conv_id", F.lit(1).alias("child"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256"))
        parts = parts.unionByName(ended[j].select("key", F.col("n").alias("n_convs"), F.col("first").alias("conv_id"), F.lit(0).alias("child"), zero.alias("n_leaves"), zero.alias("saved_tokens"), "ends_sha256"))
        made = parts.groupBy("key").agg(
            F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum("child").cast("long").alias("n_children"), F.greatest(F.sum("n_leaves"), F.lit(1)).alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256")
        )
        if j:
            made = made.join(split[j - 1].select("key", "size"), "key").withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size"))
        made = written(made, "upper-nodes")
        if j:
            named = made.select(F.col("key").alias("up"), F.col("conv_id").alias("above"))
            out.append(children.join(named, "up").withColumn("parent_conv_id", F.col("above")).drop("above"))
        else:  # one row
            root = made.first()
            out.append(children.withColumn("parent_conv_id", F.lit(root.conv_id if root else None).cast("long")))
        above = F.expr("left(key, length(key) - 32)") if j else F.lit(None).cast("string")
        below = made.select(F.lit(True).alias("top"), above.alias("up"), "conv_id", F.lit(j).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    out.append(below)
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    return every.drop("top", "up").fillna({"ends_sha256": NOTHING})


def prefix_trie(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """The trie of rows(conv_id, turn, role, text) after rebuilding each conversation upon its family's first."""
    return trie(rebuilt(conversations_of(rows)), limit)
