"""Consecutive numbers over a whole table, without sending it through one task."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import written


#: Estimated bytes of a part of spread(): those of a file's columns as stored, of which rows in memory take many times as much. And its most parts, as an estimate may be far too large.
PART = 1 << 20
PARTS = 10000


def spread(df: DataFrame, *columns: str, size: int = PART) -> DataFrame:
    """Repartitions by columns into parts that don't grow with the table: so many that each has about size bytes by Spark's estimate of the table."""
    estimate = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    parts = min(-(-estimate // size), PARTS)
    # Spark puts the parts of smaller tables together
    return df.repartition(parts, *columns) if parts > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*columns)


def free_column(df: DataFrame, name: str) -> str:
    """name, or name with underscores where df has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_row_number(df: DataFrame, order: list[Column | str], name: str, start: int = 1, weight: str | None = None) -> DataFrame:
    """Adds numbers in the given order. The sorted table is written once; each part's numbers then start after the rows before it.

    weight: a column whose sum over all rows before is added as `weight`_before.
    """
    at, own, n, w, before, wb = (free_column(df, c) for c in ("__at", "__part", "__n", "__w", "__before", "__wb"))
    ordered = written(df.orderBy(*order).withColumn(at, F.monotonically_increasing_id()), "ordered")
    part = F.shiftright(at, 33)
    amount = F.col(weight).cast("long") if weight else F.lit(0).cast("long")
    sizes = ordered.groupBy(part.alias(own)).agg(F.count("*").alias(n), F.sum(amount).alias(w))  # a row for each part of the sort
    parts = Window.orderBy(own)
    sums = sizes.select(own, (F.sum(n).over(parts) - F.col(n)).alias(before), (F.sum(w).over(parts) - F.col(w)).alias(wb))
    joined = ordered.withColumn(own, part).join(F.broadcast(sums), own)
    joined = joined.withColumn(name, F.col(before) + F.col(at) - F.shiftleft(own, 33) + start)
    if weight:
        within = F.sum(amount).over(Window.partitionBy(own).orderBy(at)) - amount
        joined = joined.withColumn(f"{weight}_before", F.col(wb) + within)
    return joined.drop(at, own, before, wb)


def same_rows(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """The join of two tables on columns whose nulls count as equal; right's other columns follow left's."""
    apart = {c: f"{c}__right" for c in on}
    named = right.withColumnsRenamed(apart)
    same = F.lit(True)
    for c in on:
        same = same & left[c].eqNullSafe(named[apart[c]])
    return left.join(named, same, how).drop(*apart.values())


def sum_before(df: DataFrame, keys: list[str], order: str, value: str, name: str, width: int) -> DataFrame:
    """Adds the sum of value over the rows of the same keys with a lower number in column order, which is unique among them.

    Rows of a key are summed by stretches of `width` numbers first, so a key with many rows needs no task of its own.
    """
    stretched = df.withColumn("stretch", F.floor(F.col(order) / width))
    sums = stretched.groupBy(*keys, "stretch").agg(F.sum(value).alias("in_stretch"))
    earlier = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "stretch", F.coalesce(F.sum("in_stretch").over(earlier), F.lit(0)).alias("before_stretch"))
    inside = Window.partitionBy(*keys, "stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    here = stretched.withColumn("before_here", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return same_rows(here, sums, [*keys, "stretch"]).withColumn(name, F.col("before_here") + F.col("before_stretch")).drop("stretch", "before_here", "before_stretch")


def starts_group(rows: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Marks rows with other keys than the row before, the first one too; nulls are equal."""
    new = np.zeros(len(rows), bool)
    for k in keys:
        now, before = rows[k], rows[k].shift()
        new |= ((now != before) & ~(now.isna() & before.isna())).to_numpy(bool)
    new[:1] = True
    return new


def whole_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Rows sorted by keys, batch by batch, cut anew so that no group goes on in the next table; with the number of each row's group in its table."""
    held: list[pd.DataFrame] = []

    def table() -> tuple[pd.DataFrame, np.ndarray]:
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
        return rows, np.cumsum(starts_group(rows, keys)) - 1

    for pdf in batches:
        if not len(pdf):
            continue
        joined = pd.concat([held[-1].tail(1), pdf]) if held else pdf
        at = np.flatnonzero(starts_group(joined, keys)[len(joined) - len(pdf) :])
        if len(at):
            held += [pdf.iloc[: at[-1]]] if at[-1] else []
            if held:
                yield table()
            held = [pdf.iloc[at[-1] :]]
        else:
            held.append(pdf)
    if held:
        yield table()
