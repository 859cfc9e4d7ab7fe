"""What the operators share: documents as Arrow batches, written tables, free names."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import discard, shared_dir, written

__all__ = ["FACTORS", "Hashes", "discard", "documents", "free_name", "id_and_text", "mix", "partitions", "shared_dir", "slices", "small_batches", "texts_of", "word_codes", "written"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores where a column of df (in any case) has it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about limit bytes of text, or one document."""
    for batch in batches:
        texts = batch.column(column)
        if not len(texts):
            continue
        if pa.types.is_large_string(texts.type):
            ends = np.frombuffer(texts.buffers()[1], np.int64)
        else:
            ends = np.frombuffer(texts.buffers()[1], np.int32)
        ends = ends[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


#: Bytes of an Arrow batch that Spark hands to a Python worker, where the session has no value of its own.
BATCH_KEY, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", {None, "67108864", "67108864b", "64MB", "64m"}, str(4 << 20)


def small_batches(df: DataFrame) -> DataFrame:
    """df; lets its session hand rows over in small batches, which bounds the memory of workers and of the hand-over."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_KEY, None) in BATCH_DEFAULT:
        conf.set(BATCH_KEY, BATCH)
    return df


def id_and_text(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def word_codes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text: codes, bounds of each text's words, and the distinct words."""
    import pyarrow.compute as pc

    raw = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    if lower:
        raw = pa.array([t.lower() for t in raw.to_pylist()], pa.large_binary())
    split = [t.split() for t in raw.to_pylist()]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    flat = pa.array([w for ws in split for w in ws], pa.binary())
    coded = flat.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), bounds, coded.dictionary


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: xor-shifts and two odd multipliers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers of polynomial hashes.
FACTORS = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class Hashes:
    """Polynomial hashes modulo 2^64 of any stretch of a sequence of 64-bit numbers."""

    def __init__(self, values: np.ndarray, factor: int):
        n = len(values)
        powers = np.cumprod(np.full(n, factor, np.uint64))
        self.inverse = np.cumprod(np.full(n + 1, pow(factor, -1, 1 << 64), np.uint64))
        self.total = np.r_[np.zeros(1, np.uint64), np.cumsum(values * powers, dtype=np.uint64)]

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.total[stop] - self.total[start]) * self.inverse[start]

    def grams(self, size: int) -> np.ndarray:
        return mix((self.total[size:] - self.total[:-size]) * self.inverse[: len(self.total) - size])
