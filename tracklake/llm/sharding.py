"""Proportional stratified interleaving with DataFrame functions only.

Rows of each source are ranked in a seeded random order; a row's fractional rank is
(rank - u) / rows of its source, with u in (0, 1) drawn from a seeded hash of the source, so that
many sources of a few rows don't share a fraction. Sorted by it, every stretch of rows holds the sources in their
proportions, so cutting the order into equal parts makes every shard match the mixture.

No task holds a source: a source's rows are split by the leading bits of the seeded hash, ranked
within each part, and shifted by the counts of the parts before. The global order is cut the same
way, by equal parts of the fraction, which are about equally full: a source of n rows has n times a
part's length in each part, give or take one row, and u spreads small sources over all parts. Only a hash, a size
and a checksum of each row travel, never its text.

Law `rows`: shards differ by one row at most. Null or empty text has 0 bytes and the checksum of no bytes;
a long text counts whole. A null source is a source of its own; of equal fractions the source's name and the
rank decide, and repeated rows, equal in all of doc_id, source and text, are interchangeable and share a part.
Extra columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: A row's share besides its text.
OVERHEAD = 8
#: Rows that are ranked together.
PART = 1 << 16


def _ranked(df: DataFrame, group: list[str], part: str, order: list[Column], out: str, total: str) -> DataFrame:
    """Adds the rank (from 1) over each group in the order of part, then order, and the group's size; a part holds few enough rows to sort."""
    within = F.row_number().over(Window.partitionBy(*group, part).orderBy(*order))
    whole = Window.partitionBy(*group)
    sizes = df.groupBy(*group, part).count()
    sizes = sizes.select(*group, part, (F.sum("count").over(whole.orderBy(part)) - F.col("count")).alias("__before"), F.sum("count").over(whole).alias(total))
    return df.withColumn("__within", within).join(sizes, [*group, part]).withColumn(out, F.col("__within") + F.col("__before")).drop("__within", "__before")


def shards(docs: DataFrame, n_shards: int = 24, seed: int = 17, parts: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row. parts: into how many a source, and the whole order, is split to be ranked (default: so many that one has some PART rows)."""
    utf8 = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(utf8) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(utf8.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("stratum"),
    )
    rows = rows.withColumn("__h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    rows = written(rows, "shards")  # the texts are read once; what follows are a few numbers a row
    parts = parts or max(1024, 1 << (rows.count() // PART).bit_length())
    rows = rows.withColumn("__part", F.pmod(F.shiftright("__h", 20), F.lit(parts)).cast("int"))
    rows = _ranked(rows, ["stratum"], "__part", [F.col("__h"), F.col("doc_id"), F.col("text_crc32"), F.col("size")], "__rank", "__n")
    u = (F.pmod(F.xxhash64(F.lit(seed), "stratum"), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    rows = rows.withColumn("__f", (F.col("__rank") - u) / F.col("__n")).drop("__part", "__h", "__n")
    rows = rows.withColumn("__whole", F.lit(0)).withColumn("__cut", F.floor(F.col("__f") * parts).cast("int"))
    placed = _ranked(rows, ["__whole"], "__cut", [F.col("__f"), F.col("stratum"), F.col("__rank")], "__place", "__n")
    placed = placed.withColumn("__place", F.col("__place") - 1).withColumn("shard", F.expr(f"cast((__place * {n_shards}) div __n as int)"))
    start = F.expr(f"(cast(shard as bigint) * __n + {n_shards - 1}) div {n_shards}")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("__place") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
