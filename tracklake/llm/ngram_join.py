"""Exact n-gram Jaccard join: universe partition, pigeonhole, verification.

A document's set is its distinct five-word shingles (64-bit hashes). Two sets of sizes r <= s with a
Jaccard similarity of 3/4 or more differ in at most H = (r + s) div 7 elements. Sizes are split
into bands whose ends are in the ratio 16/9; a pair belongs to the band of its larger set, so a set
is signed in its own band and, if its size allows a larger partner there, in the next one.

In each band the universe of shingles is split by a hash into m segments. At most H segments of two
similar sets differ, so a set with more than H non-empty segments shares one of them with each of
its partners. A plan chosen by cost gives every band one of these forms:
  equal          nothing to sign: similar sets of such sizes are equal
  neighbourhood  one segment with all its subsets that lack one element, where H is at most 1
  segments       m segments, where by chance none has too few non-empty ones (see `plan`)
  elements       every element is a segment; always enough, but popular elements cost candidates

Equal signatures meet by hash range: tasks send packed blocks of signatures, not rows. Signatures
with the same members become one group with a weight. A set stays a candidate in a band only if the
weight of what it shares there reaches (its segments) - H, which follows from the same principle. Then
each member is verified against a leader of its groups first. Of groups that still hold more than one
component, only sets go on that can have a partner in another one: each counts, by size class, those
of its elements that other components hold, which takes a row per element and no pair. What is left
looks for larger sets in its smallest groups, as many as the principle asks for. Pairs whose sketches
(parities of hashed elements) differ in more than H bits differ in more than H elements and are left
out; the rest is compared exactly.

Equal sets (128-bit sums of their elements' hashes) are one class and are signed and verified once.

Null, empty or blank text: the empty set, linked with nothing; its component is its own doc_id. Rows with
a null doc_id take part; their component is the least non-null doc_id reachable, else null. A long text's
set is whole, in a band of its own size. A pair of just 75 per cent is linked. Repeated rows are members of
the same class; of rows of a group that share the least doc_id, keep_one() keeps any one. Extra columns,
whatever their names, are ignored by near_duplicates() and kept by keep_one(). An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, mix, partitions, slices, small_batches, word_codes, written
from .components import components

WIDTH = 5
#: Signatures that a task gathers before it sends them.
GATHERED = 500_000
#: Sets that a task remembers as signed.
REMEMBERED = 500_000
#: Candidate documents (two numbers each, in a hash table) are found in the texts by a broadcast of so many bytes, or by a join.
HOME_BYTES, BROADCAST_BYTES = 96, 32 << 20
#: How much a signature of one element counts: it meets every set with that element.
POPULAR = 2.0
BANDS = 64
#: Width of a size class in which partners are counted.
SIZE_RATIO = 1.05
NOBODY = 2**63 - 1


def band_ends() -> list[tuple[int, int]]:
    """(least, largest) size of each band."""
    out, low = [(1, 3), (4, 6)], 7
    while len(out) < BANDS:
        high = low * 16 // 9
        out.append((low, high))
        low = high + 1
    return out


def differences(r: int | np.ndarray, largest: int | np.ndarray) -> int | np.ndarray:
    """The most elements in which a set of size r and a similar one of at most `largest` differ, the other being no smaller."""
    return (r + np.minimum(largest, r * 4 // 3)) // 7


@lru_cache(maxsize=None)
def plan(band: int) -> tuple[str, int]:
    """The cheapest form of a band, and its number of segments."""
    low, high = band_ends()[band]
    sizes = [max(1, (3 * low + 3) // 4), low, (low + high) // 2, high]
    most = max(int(differences(r, high)) for r in sizes)
    if most == 0:
        return "equal", 0
    forms = [((1 + POPULAR) * high, "elements", 0)]
    if most == 1:
        forms.append((high + 1, "neighbourhood", 1))
    for share in (0.35, 0.4, 0.45, 0.5, 0.6, 0.75, 1.0, 1.5):
        m = math.ceil(share * high)
        for r in sizes:
            empty = math.exp(-r / m)
            mean, spread = m * (1 - empty), math.sqrt(m * empty * max(0.0, 1 - (1 + r / m) * empty))
            if mean - 8 * spread < differences(r, high) + 1:
                break
        else:
            forms.append((m * (1 - math.exp(-high / m)) + POPULAR * high * math.exp(-high / m), "segments", m))
    cost, form, m = min(forms)
    return form, m


def word_hashes(distinct: pa.Array) -> np.ndarray:
    if not len(distinct):
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.array(distinct.to_pylist(), object), categorize=False)


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their bounds."""
    codes, bounds, distinct = word_codes(texts, lower=True)
    h = word_hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)
    n = np.diff(bounds)
    place = [mix(h + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & 0xFFFFFFFFFFFFFFFF)) for i in range(WIDTH)]
    out, owner = [], []
    if len(h) >= WIDTH:
        whole = sum((place[i][i : len(h) - WIDTH + 1 + i] for i in range(1, WIDTH)), place[0][: len(h) - WIDTH + 1])
        doc = np.repeat(np.arange(len(n)), n)
        inside = doc[: len(h) - WIDTH + 1] == doc[WIDTH - 1 :]
        out.append(mix(whole[inside]))
        owner.append(doc[: len(h) - WIDTH + 1][inside])
    for d in np.flatnonzero((n > 0) & (n < WIDTH)).tolist():
        k = int(n[d])
        total = np.uint64(k)
        with np.errstate(over="ignore"):
            for i in range(k):
                total = total + place[i][bounds[d] + i]
        out.append(mix(np.array([total])))
        owner.append(np.array([d]))
    tokens = np.concatenate(out) if out else np.zeros(0, np.uint64)
    doc = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    o = np.lexsort((tokens, doc))
    tokens, doc = tokens[o], doc[o]
    fresh = np.r_[True, (tokens[1:] != tokens[:-1]) | (doc[1:] != doc[:-1])] if len(tokens) else np.zeros(0, bool)
    tokens, doc = tokens[fresh], doc[fresh]
    return tokens, np.searchsorted(doc, np.arange(len(n) + 1))


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of unsigned values between bounds, modulo 2^64."""
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)]
    return total[bounds[1:]] - total[bounds[:-1]]


def set_hashes(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mix(sums(mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)), bounds)), mix(sums(mix(tokens + np.uint64(0x5851F42D4C957F2D)), bounds) + np.uint64(1))


def signatures(tokens: np.ndarray, bounds: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures (the low six bits are the band) and their set's number; per set: own band, what it must share there and in the next one, and whether it has too few segments."""
    n = np.diff(bounds)
    ends = band_ends()
    highs = np.array([h for _, h in ends])
    lows = np.array([low for low, _ in ends] + [1 << 62])
    own = np.searchsorted(highs, n)
    need, short = np.ones((2, len(n)), np.int64), np.zeros(len(n), bool)
    sigs, owners = [], []
    salted = mix(tokens ^ mix(np.array([seed], np.uint64)))
    for role in (0, 1):
        band = own + role
        signed = (n > 0) & (4 * n >= 3 * lows[np.minimum(band, BANDS)]) & (band < BANDS)
        forms = {b: plan(b) for b in np.unique(band[signed]).tolist()}
        for kind in ("neighbourhood", "elements", "segments"):
            chosen = np.flatnonzero(signed & np.isin(band, [b for b, f in forms.items() if f[0] == kind]))
            if not len(chosen):
                continue
            size = n[chosen]
            at = np.repeat(bounds[:-1][chosen] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            doc = np.repeat(chosen, size)
            x, tag = salted[at], mix(band[doc].astype(np.uint64) + np.uint64(101))
            limit = differences(n, highs[np.minimum(band, BANDS - 1)]) + 1
            if kind == "neighbourhood":
                total = np.zeros(len(n), np.uint64)
                np.add.at(total, doc, x)
                sig = np.r_[mix(total[chosen] + mix(band[chosen].astype(np.uint64))), mix(total[doc] - x + mix(band[doc].astype(np.uint64)))]
                owner = np.r_[chosen, doc]
            else:
                if kind == "elements":
                    sig, owner = mix(x + tag), doc
                else:
                    m = np.array([forms.get(b, ("", 1))[1] or 1 for b in range(BANDS + 1)], np.uint64)[band[doc]]
                    segment = (x >> np.uint64(32)) * m >> np.uint64(32)
                    key = doc.astype(np.uint64) << np.uint64(40) | segment
                    o = np.argsort(key, kind="stable")
                    key = key[o]
                    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                    owner = doc[o][first]
                    sig = mix(np.add.reduceat(mix(x[o]), first) + mix(segment[o][first] + tag[o][first]))
                count = np.bincount(owner, minlength=len(n))
                short[chosen] |= count[chosen] < limit[chosen]
                need[role, chosen] = np.maximum(1, count[chosen] - limit[chosen] + 1)
            sigs.append(sig << np.uint64(6) | band[owner].astype(np.uint64))
            owners.append(owner)
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), own, need, short
    return np.concatenate(sigs), np.concatenate(owners), own, need, short


SENT = "bucket int, doc_id long, th long, n long, hi long, lo long, own int, need long, need_next long, short boolean, sigs binary, nodes binary, counts binary"
FOUND = "doc_id long, th long, n long, hi long, lo long, own int, need long, need_next long, short boolean, gid long, band int, node long, weight long"


def _signed(buckets: int, seed: int):
    """Sends a row for each document, and blocks of signatures for each bucket."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        done: set[int] = set()
        n_held, turn = 0, 0  # a document's own row is only passed on, so it may go to any bucket

        def blocks() -> pa.RecordBatch:
            sig, node = np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])
            bucket = (sig >> np.uint64(6)) % np.uint64(buckets)
            o = np.lexsort((node, bucket))
            sig, node, bucket = sig[o], node[o], bucket[o]
            start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            rows = []
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(sig)], strict=True):
                first = np.flatnonzero(np.r_[True, node[a + 1 : b] != node[a : b - 1]])
                rows.append((int(bucket[a]), sig[a:b].tobytes(), node[a:b][first].tobytes(), np.diff(np.r_[first, b - a]).astype(np.uint32).tobytes()))
            cols = list(zip(*rows, strict=True))
            n = len(rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int32()), *(pa.nulls(n, pa.int64()) for _ in range(5)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), *(pa.array(c, pa.binary()) for c in cols[1:])],
                names=[x.split()[0] for x in SENT.split(", ")],
            )

        for batch in slices(batches, limit=2 << 20):
            tokens, bounds = shingles(batch.column("text"))
            hi, lo = set_hashes(tokens, bounds)
            # equal sets are signed once in a task (or once in REMEMBERED different ones)
            _, first = np.unique(hi, return_index=True)
            once = np.zeros(len(hi), bool)
            once[[i for i in first.tolist() if int(hi[i]) not in done]] = True
            done = set() if len(done) > REMEMBERED else done
            done.update(hi[once].tolist())
            sig, owner, own, need, short = signatures(tokens, bounds, seed)
            keep = once[owner]
            held.append((sig[keep], hi[owner[keep]]))
            n_held += int(keep.sum())
            n, k = np.diff(bounds), len(hi)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(((turn + np.arange(k)) % buckets).astype(np.int32)), batch.column("doc_id"), batch.column("th"), pa.array(n), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)),
                    pa.array(own.astype(np.int32)), pa.array(need[0]), pa.array(need[1]), pa.array(short), *(pa.nulls(k, pa.binary()) for _ in range(3)),
                ],
                names=[x.split()[0] for x in SENT.split(", ")],
            )
            turn += k
            if n_held >= GATHERED:
                yield blocks()
                held, n_held = [], 0
        if n_held:
            yield blocks()

    return run


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes documents on; of each bucket's signatures, gives the groups with two members or more."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    bucket, blocks = None, []

    def groups() -> Iterator[pa.RecordBatch]:
        sig = np.concatenate([np.frombuffer(s, np.uint64) for s, _, _ in blocks])
        node = np.concatenate([np.repeat(np.frombuffer(d, np.uint64), np.frombuffer(c, np.uint32)) for _, d, c in blocks])
        o = np.argsort(sig, kind="stable")
        sig, node = sig[o], node[o]
        same = np.zeros(len(sig) + 1, bool)
        same[1:-1] = sig[1:] == sig[:-1]
        many = same[1:] | same[:-1]  # most signatures are met once only
        sig, node = sig[many], node[many]
        o = np.lexsort((node, sig))
        sig, node = sig[o], node[o]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
        sig, node = sig[fresh], node[fresh]
        if not len(sig):
            return
        start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        size = np.diff(np.r_[start, len(sig)])
        band = sig[start] & np.uint64(63)
        gid = mix(np.add.reduceat(mix(node), start) + mix(band + np.uint64(7)))
        _, first, weight = np.unique(gid, return_index=True, return_counts=True)
        keep = size[first] > 1
        first, weight = first[keep], weight[keep]
        size = size[first]
        if not len(first):
            return
        at = np.repeat(start[first] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        n = len(at)
        full = pa.RecordBatch.from_arrays(
            [*(pa.nulls(n, pa.int64()) for _ in range(5)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.array(np.repeat(gid[first], size).view(np.int64)), pa.array(np.repeat(band[first], size).astype(np.int32)), pa.array(node[at].view(np.int64)), pa.array(np.repeat(weight, size))],
            names=names,
        )
        for i in range(0, n, 20_000):
            yield full.slice(i, 20_000)

    for batch in batches:
        kind, buckets = batch.column("sigs").is_null().to_numpy(zero_copy_only=False), batch.column("bucket").to_pylist()
        docs = batch.filter(pa.array(kind))
        if len(docs):
            k = len(docs)
            yield pa.RecordBatch.from_arrays([*(docs.column(c) for c in names[:9]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())], names=names)
        for i in np.flatnonzero(~kind).tolist():
            if buckets[i] != bucket and blocks:
                yield from groups()
                blocks = []
            bucket = buckets[i]
            blocks.append(tuple(batch.column(c)[i].as_py() for c in ("sigs", "nodes", "counts")))
    if blocks:
        yield from groups()


SKETCH = [f"b{i}" for i in range(16)]


def sketches(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parities of the elements' numbers in 1024 buckets: two sets differ in at least as many elements as their sketches do in bits."""
    width = 64 * len(SKETCH)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    counts = np.bincount(owner * width + (tokens >> np.uint64(20)).astype(np.int64) % width, minlength=(len(bounds) - 1) * width)
    return np.packbits((counts & 1).astype(np.uint8).reshape(len(bounds) - 1, width), axis=1).view(np.int64)


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, limit=2 << 20):
        tokens, bounds = shingles(batch.column("text"))
        hi, lo = set_hashes(tokens, bounds)
        bits = sketches(tokens, bounds)
        listed = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(tokens.view(np.int64))).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(np.diff(bounds)), listed, *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(len(SKETCH)))], names=["hi", "lo", "n", "tokens", *SKETCH])


def _size_class(n: str):
    """Sizes in the ratio SIZE_RATIO or nearer."""
    return F.floor(F.log(SIZE_RATIO, F.col(n))).cast("int")


def _may_link(p: str, q: str):
    """Whether sizes and sketches of two sets allow a link."""
    n, m = F.col(f"{p}n"), F.col(f"{q}n")
    bits = sum((F.bit_count(F.col(f"{p}{b}").bitwiseXOR(F.col(f"{q}{b}"))) for b in SKETCH[1:]), F.bit_count(F.col(f"{p}{SKETCH[0]}").bitwiseXOR(F.col(f"{q}{SKETCH[0]}"))))
    return (4 * n >= 3 * m) & (4 * m >= 3 * n) & (7 * bits <= n + m)


def _partnered(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Of nodes with their labels, those that can have a partner of another label, by the partner's size class: node, label, size, partner_size.

    A set of r elements shares 3 (r + s) / 7 with a partner of s elements or more, so it needs so many
    elements that sets of another label and of that size class have. They are counted element by
    element: no pair of sets is formed.
    """
    elements = sets.select(F.col("hi").alias("node"), "n", F.explode("tokens").alias("x")).join(nodes.select("node", "label"), "node").withColumn("size", _size_class("n"))
    holders = elements.groupBy("x", "size").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min("n").alias("least"))
    shared = elements.withColumnRenamed("size", "own_size").join(holders.withColumnRenamed("size", "partner_size"), "x")
    shared = shared.filter("(low <> label or high <> label) and 4 * n >= 3 * least")
    counted = shared.groupBy("node", "label", "n", "own_size", "partner_size").agg(F.count("*").alias("k"), F.min("least").alias("least"))
    return counted.filter("7 * k >= 3 * (n + least)").select("node", "label", F.col("own_size").alias("size"), "partner_size")


def _across(marked: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs a, b of nodes of different labels that can be linked; marked: gid, node, is_own, looks, label of mixed groups."""
    able = marked.select("node", "label").distinct()
    for _ in range(2):  # again without those that have no partner; what is left is exact after any number of turns
        able = written(_partnered(able, sets), "partnered")
    ends = able.select("node", "size", "partner_size")
    bits = sets.select(F.col("hi").alias("node"), "n", *SKETCH)
    one = marked.filter("looks").join(ends, "node").join(bits, "node").alias("p")
    two = marked.filter("is_own").join(ends, "node").join(bits, "node").alias("q")
    larger = (F.col("q.n") > F.col("p.n")) | (F.col("q.n") == F.col("p.n")) & (F.col("q.node") != F.col("p.node"))
    fit = (F.col("p.gid") == F.col("q.gid")) & (F.col("p.partner_size") == F.col("q.size")) & (F.col("q.partner_size") == F.col("p.size"))
    pairs = one.join(two, fit & (F.col("p.label") != F.col("q.label")) & larger & _may_link("p.", "q."))
    return pairs.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of pairs a, b of nodes, those that are linked, as classes."""
    left = pairs.join(sets.select(F.col("hi").alias("a"), F.col("cls").alias("cls_a"), F.col("tokens").alias("tokens_a")), "a")
    both = left.join(sets.select(F.col("hi").alias("b"), F.col("cls").alias("cls_b"), F.col("tokens").alias("tokens_b")), "b")
    shared = F.size(F.array_intersect("tokens_a", "tokens_b"))
    both = both.select("cls_a", "cls_b", "a", "b", shared.alias("shared"), (F.size("tokens_a") + F.size("tokens_b")).alias("total"))
    return both.filter(100 * F.col("shared") >= 75 * (F.col("total") - F.col("shared"))).filter("cls_a <> cls_b").select("a", "b", "cls_a", "cls_b")


def _first_seed(rows: DataFrame, buckets: int, seed: int) -> DataFrame:
    sent = rows.mapInArrow(_signed(buckets, seed), SENT)
    return written(sent.repartition(partitions(rows.sparkSession), "bucket").sortWithinPartitions("bucket").mapInArrow(_met, FOUND), "met")


def classes_of(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every row (doc_id, th, n, cls); the least doc_id of each class; label and component_id of classes linked with another.

    The last two are tables of a row for each class, so a join of all rows with them can split a hot class.
    """
    spark = docs.sparkSession
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    seed = 11
    while True:
        met = _first_seed(rows, 3 * partitions(spark), seed)
        if not met.filter("short").limit(1).count():
            break
        seed += 1  # a set has too few non-empty segments (odds of 1e-14 each): split the universe anew
    cls = F.concat(F.lpad(F.hex("hi"), 16, "0"), F.lpad(F.hex("lo"), 16, "0"))
    every = met.filter("n is not null").select("doc_id", "th", "n", F.when(F.col("n") > 0, cls).alias("cls"), "hi", "own", "need", "need_next")
    # equal sets are one row from here on, added up in each task before they travel
    home = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    classes = every.filter("n > 0").groupBy("hi", "cls").agg(*(F.min(c).alias(c) for c in ("own", "need", "need_next", "n")), F.min("doc_id").alias("least"), F.min(home).alias("home"))
    classes = written(classes, "classes")
    nodes = classes.groupBy("hi").agg(F.max("own").alias("own"), F.min("need").alias("need"), F.min("need_next").alias("need_next"), F.min("n").alias("n"))
    groups = met.filter("gid is not null").groupBy("gid", "band", "node").agg(F.sum("weight").alias("weight"))
    groups = groups.join(nodes.withColumnRenamed("hi", "node"), "node").withColumn("is_own", F.col("band") == F.col("own"))
    groups = groups.withColumn("need", F.when(F.col("is_own"), F.col("need")).otherwise(F.col("need_next"))).drop("need_next", "own")
    groups = written(groups, "groups")
    for _ in range(2):  # sets that share too little, then groups that lack a partner; again without those
        before = groups
        enough = groups.groupBy("node", "band").agg(F.sum("weight").alias("w"), F.first("need").alias("need")).filter("w >= need").select("node", "band")
        groups = groups.join(enough, ["node", "band"])
        led = groups.groupBy("gid").agg(F.count("*").alias("size"), F.count_if("is_own").alias("n_own")).filter("size > 1 and n_own > 0").select("gid", "size")
        groups = written(groups.drop("size").join(led, "gid"), "groups", [before])
    groups_before = groups
    # a group's leader is the set that shares most with all others: the one that the others are copies of, if it is there
    known = groups.groupBy("node").agg(F.sum(F.col("weight") * (F.col("size") - 1)).alias("known"))
    groups = groups.join(known, "node")
    leader = F.max(F.when(F.col("is_own"), F.struct("known", F.col("node").alias("node")))).alias("leader")
    groups = groups.join(groups.groupBy("gid").agg(leader), "gid")
    # of a set's signatures all but H may be left aside: it looks for partners in its smallest groups only
    of_set = Window.partitionBy("node", "band")
    before = F.sum("weight").over(of_set.orderBy("size", "gid")) - F.col("weight")
    looks = before < F.sum("weight").over(of_set) - F.col("need") + 1
    groups = written(groups.select("gid", "node", "n", "is_own", "weight", looks.alias("looks"), F.col("leader.node").alias("leader")), "groups", [groups_before])

    # the candidates' texts are read again for their sets: by a broadcast of few ids, or by a join
    wanted = groups.select(F.col("node").alias("hi")).distinct()
    homes = written(classes.join(wanted, "hi", "left_semi").select("home.doc_id", "home.th"), "homes")
    few = homes.select("doc_id", "th").distinct()
    few = F.broadcast(few) if few.count() * HOME_BYTES <= BROADCAST_BYTES else few
    at_home = rows.alias("r").join(few.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("r.th").eqNullSafe(F.col("f.th")), "left_semi").select("text")
    kinds = "hi long, lo long, n long, tokens array<long>, " + ", ".join(f"{b} long" for b in SKETCH)
    sets = written(at_home.mapInArrow(_sets, kinds).withColumn("cls", cls).dropDuplicates(["cls"]).drop("lo"), "sets")
    bits = sets.select(F.col("hi").alias("node"), "n", *SKETCH)

    # a member with the leader that it shares most with, first
    stars = groups.filter("node <> leader").groupBy(F.col("leader").alias("a"), F.col("node").alias("b")).agg(F.sum("weight").alias("w"))
    stars = stars.join(bits.select(F.col("node").alias("a"), *(F.col(c).alias(f"a_{c}") for c in ["n", *SKETCH])), "a").join(bits.select(F.col("node").alias("b"), *(F.col(c).alias(f"b_{c}") for c in ["n", *SKETCH])), "b")
    stars = written(stars.filter(_may_link("a_", "b_")).select("a", "b", "w").distinct(), "stars")
    best = stars.groupBy("b").agg(F.max_by("a", F.struct("w", "a")).alias("a"))
    links = written(_verified(best.select("a", "b"), sets), "links")
    labels = components(links.select(F.col("a"), F.col("b")))

    def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}")), side, "left").withColumn(f"label_{side}", F.coalesce(f"label_{side}", side))
        return pairs.filter("label_a <> label_b").select("a", "b")

    rest = written(apart(stars.join(best.withColumnRenamed("a", "first"), "b").filter("a <> first").select("a", "b"), labels), "rest")
    more = written(_verified(rest, sets), "links")
    links = links.union(more)
    labels = components(links.select("a", "b"))
    # groups that still hold several components: sets that can have a partner in another one look for it
    marked = groups.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = marked.groupBy("gid").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count_if("looks").alias("n_looks")).filter("x <> y and n_looks > 0").select("gid")
    marked = written(marked.join(mixed, "gid").select("gid", "node", "is_own", "looks", "label"), "mixed")
    across = _across(marked, sets)
    last = written(_verified(across, sets), "links")
    edges = links.union(last).select(F.col("cls_a").alias("a"), F.col("cls_b").alias("b"))
    linked = components(edges).withColumnRenamed("node", "cls")
    linked = linked.join(classes.select("cls", "least"), "cls")
    ids = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    linked = written(linked.join(ids, "label").select("cls", "label", "component_id"), "linked")
    return every.select("doc_id", "th", "n", "cls"), classes.select("cls", "least"), linked


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, and class (a set's hash; null for the empty set) of each row."""
    every, alone, linked = classes_of(docs)
    ids = written(alone.join(linked, "cls", "left").select("cls", F.coalesce("component_id", "least").alias("component_id")), "ids")
    out = every.join(ids, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), F.col("cls").alias("class"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, with one document of each group of linked ones (the least doc_id) and all empty ones."""
    every, _, linked = classes_of(docs)
    group = every.join(linked.select("cls", "label"), "cls", "left").withColumn("group", F.coalesce("label", "cls"))
    first = group.filter("n > 0").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("home")).select("home.doc_id", "home.th", F.lit(True).alias("once"))
    empty = every.filter("n = 0").select("doc_id", "th", F.lit(False).alias("once")).distinct()
    kept = written(first.union(empty), "kept")
    th, once, rank = free_name(docs, "th"), free_name(docs, "once"), free_name(docs, "rank")
    kept = kept.toDF(free_name(docs, "home_id"), free_name(docs, "home_th"), once)
    rows = docs.withColumn(th, F.xxhash64(F.col("text").cast("string")))
    joined = rows.join(kept, rows["doc_id"].cast("long").eqNullSafe(kept[kept.columns[0]]) & rows[th].eqNullSafe(kept[kept.columns[1]]))
    ranked = joined.withColumn(rank, F.row_number().over(Window.partitionBy("doc_id", th).orderBy(th)))
    return ranked.filter(~F.col(once) | (F.col(rank) == 1)).select(*(F.col(c) for c in docs.columns))
