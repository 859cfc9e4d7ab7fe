from collections import Counter

from pyspark.sql import functions as F

from tracklake.llm import sharding


def test_many_sources_of_one_row_are_spread(spark):
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.when(F.col("id") % 2 == 0, "big").otherwise(F.concat(F.lit("site"), "id")).alias("source"))
    rows = sharding.shards(docs, n_shards=10).select("doc_id", "shard").collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 2_000
    assert set(Counter(r.shard for r in rows).values()) == {200}
    small = Counter(r.shard for r in rows if r.doc_id % 2)
    assert all(60 <= small[i] <= 140 for i in range(10))
