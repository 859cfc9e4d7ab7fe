"""Medians of groups that no task sorts."""

import random

import pytest
from pyspark.sql import functions as F

from tracklake.operators import analysis


def values(seed):
    rng = random.Random(seed)
    rows = []
    for key, n in (("a", 500), ("b", 501), ("ties", 300), ("one", 1), ("two", 2), (None, 99), ("even", 4)):
        rows += [(key, rng.choice([rng.gauss(0, 1), rng.lognormvariate(0, 4), float(rng.randrange(3))]) if key != "ties" else float(rng.randrange(2))) for _ in range(n)]
    rows += [("a", None), ("none", None), ("b", float("nan")), ("b", float("inf")), ("big", -1.7e308), ("big", 1.7e308), ("big", 0.0), ("big", 5e-324), ("big", 1e-323), ("big", 2e-323), ("big", 1e-323)]
    rows += [("odd", v) for v in (float("nan"), float("inf"), float("nan"), 1.0)] + [("minus", float("-inf"))] * 3 + [("minus", 2.0)] * 3
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("bins", [16])
def test_median_equals_the_sorted_one(spark, bins):
    df = spark.createDataFrame(values(bins), "key string, x double").repartition(2)
    want = {r.key: repr(r.m) for r in df.groupBy("key").agg(F.median("x").alias("m")).collect()}
    got = {r.key: repr(r.median) for r in analysis.exact_median(df, ["key"], "x", most=3, bins=bins).collect()}
    assert got == want
    assert {r.key: repr(r.median) for r in analysis.exact_median(df, ["key"], "x").collect()} == want


def test_no_task_holds_a_groups_values(spark):
    df = spark.range(50_000).selectExpr("id % 2 key", "hash(id) / 7.0 x")
    plan = analysis.exact_median(df, ["key"], "x", most=100)._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower() and "median(" not in plan.lower()
