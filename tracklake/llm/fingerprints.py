"""Quartile bucket digests of documents, and of each text edited with the next document's start.

Byte triplets (a byte, with two of the next three) are hashed into 128 buckets and counted. Each
bucket is written as its quartile among the 128 counts (two bits), together with the logarithm of
the length. Two digests are compared by a bounded difference: 0, 1, 2 or 6 for a bucket whose
quartiles are so far apart, and the distance of the length codes.

Neighbours in the order of doc_id meet without a global sort in one task: ids are dealt into
ranges whose bounds are quantiles of doc_id, and the first document of each range is also sent to
the range before, the first of all to the last.

Null text counts as empty: the digest of no bytes. A null doc_id comes before all others; equal
doc_ids are ordered by text, and the next document after any of them is the next row; so rows of one
doc_id (all null ones, say) stay in one range. Of repeated rows each is the next one of another. One
document alone is its own next. Equal counts of buckets are in one quartile. A long text is digested
whole. Extra columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, partitions, slices, texts_of

BUCKETS = 128
#: Differences at or above this are as far as can be.
FAR = 240
LENGTH_CODES = 64
LOWEST = -(2**63)
#: Multipliers of a triplet's three bytes.
FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def digests(raw: list[bytes]) -> np.ndarray:
    """(n, 129) codes: the quartile 0 to 3 of each bucket, then the length's code."""
    n = len(raw)
    size = np.fromiter(map(len, raw), np.int64, n)
    counts = np.zeros((n, BUCKETS), np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    if len(flat) > 3:
        x, y, z = (flat.astype(np.uint32) * np.uint32(k) for k in FACTORS)
        row = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(flat))  # bytes from here to the text's end
        for i, j in ((1, 2), (1, 3), (2, 3)):
            mixed = x[: len(flat) - j] + y[i : len(flat) - j + i] + z[j:]
            bucket = (mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(25)
            inside = left[: len(flat) - j] > j
            counts += np.bincount((row[: len(flat) - j] + bucket)[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
    cut = np.sort(counts, axis=1)[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts[:, :, None] > cut[:, None, :]).sum(axis=2)
    length = np.minimum(np.floor(4 * np.log2(size + 1.0)), LENGTH_CODES * 4 - 1).astype(np.int64)
    return np.c_[code, length].astype(np.uint8)


def written_digests(code: np.ndarray) -> list[str]:
    quart = code[:, :BUCKETS].reshape(len(code), -1, 4)
    packed = quart[:, :, 0] << 6 | quart[:, :, 1] << 4 | quart[:, :, 2] << 2 | quart[:, :, 3]
    return [bytes(r).hex() for r in np.c_[code[:, BUCKETS:], packed].astype(np.uint8)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 for a difference of FAR or more."""
    steps = np.array([0, 1, 2, 6], np.int64)
    apart = steps[np.abs(a[:, :BUCKETS].astype(np.int16) - b[:, :BUCKETS])].sum(axis=1)
    apart += np.abs(a[:, BUCKETS].astype(np.int64) - b[:, BUCKETS])
    return 1 - np.minimum(apart, FAR) / FAR


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each whole text, without a shuffle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            code = digests([t.encode("utf-8", "surrogatepass") for t in texts_of(batch)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(written_digests(code))], names=["doc_id", "fingerprint"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows part, ahead, key, doc_id, text, sorted in each partition so that a row's next one follows; rows with ahead only follow."""
    spark = docs.sparkSession
    n = partitions(spark)
    keyed = id_and_text(docs).withColumn("key", F.coalesce("doc_id", F.lit(LOWEST)))
    cuts = sorted(set(keyed.approxQuantile("key", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []

    @F.pandas_udf("int")
    def part(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, key.to_numpy(), "right").astype(np.int32))

    # one row for each range: its number and its first id
    heads = sorted((r["part"], r["head"]) for r in keyed.select("key").withColumn("part", part("key")).groupBy("part").agg(F.min("key").alias("head")).collect())
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    firsts = sorted(before)

    @F.pandas_udf("array<struct<part:int,ahead:boolean>>")
    def places(key: pd.Series) -> pd.Series:
        own = np.searchsorted(cuts, key.to_numpy(), "right")
        out = []
        for k, p in zip(key.tolist(), own.tolist(), strict=True):
            at = bisect_right(firsts, k)
            out.append([(p, False), (before[k], True)] if at and firsts[at - 1] == k else [(p, False)])
        return pd.Series(out)

    return keyed.withColumn("place", F.explode(places("key"))).select("place.*", "key", "doc_id", "text").repartition(n, "part").sortWithinPartitions("part", "ahead", "key", "text")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, key, text, code = None, None, None, None  # the row that waits for its next one

        for batch in slices(batches):
            texts = texts_of(batch)
            parts, ahead, ids = batch.column("part").to_pylist(), batch.column("ahead").to_pylist(), batch.column("doc_id").to_pylist()
            codes = digests([t.encode("utf-8", "surrogatepass") for t in texts])
            rows, pairs = [], []
            for i, t in enumerate(texts):
                if part is not None and part == parts[i]:
                    half = len(text) // 2
                    rows.append((key, len(text), text[: len(text) - half] + t[:half]))
                    pairs.append((code, codes[i]))
                part, key, text, code = (None, None, None, None) if ahead[i] else (parts[i], ids[i], t, codes[i])
            if rows:
                raw = [r[2].encode("utf-8", "surrogatepass") for r in rows]
                own, after, changed = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), digests(raw)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array([r[1] for r in rows], pa.int64()),
                        pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
                        pa.array(written_digests(own)),
                        pa.array(written_digests(changed)),
                        pa.array(likeness(own, changed)),
                        pa.array(likeness(own, after)),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return with_next(docs).mapInArrow(run, SCHEMA)
