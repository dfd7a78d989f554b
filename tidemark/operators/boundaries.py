"""Estimators at every recalibration boundary from one aggregation.

An observation belongs to all boundaries after its settlement, so it is counted at the first of them and summed from
there on. A market settles once, so its first boundary is where it is counted as a different market. The work doesn't grow
with the number of boundaries, only the rows that are asked for do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X

UNITS = ("day", "week", "month")


def boundary_of(time_us: Column, unit: str) -> Column:
    """The last boundary at or before a time: the start of its day, week (Monday) or month."""
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is none of {UNITS}")
    return F.date_trunc(unit, F.timestamp_micros(time_us))


def first_boundary(settled_us: Column, unit: str) -> Column:
    """The first boundary strictly after a settlement."""
    return boundary_of(settled_us, unit) + F.expr(f"INTERVAL 1 {unit}")


def at_boundaries(counted: DataFrame, keys: Sequence[str], sums: Sequence[str], unit: str, last: Column) -> DataFrame:
    """keys, boundary and sums: the sums of `counted` (keys, first, sums; a row or more for each key and first boundary) over all rows with first at or before each boundary, from the key's first to `last`."""
    steps = counted.groupBy(*keys, "first").agg(*[F.sum(c).alias(c) for c in sums])
    by_time = Window.partitionBy(*keys).orderBy("first")
    upto = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    one = F.expr(f"INTERVAL 1 {unit}")
    until = F.coalesce(F.lead("first").over(by_time) - one, last)
    held = steps.select(*keys, "first", until.alias("until"), *[F.sum(c).over(upto).alias(c) for c in sums])
    return held.select(*keys, F.explode(F.sequence("first", F.greatest("first", "until"), one)).alias("boundary"), *sums)


def last_boundary(settled: DataFrame, unit: str) -> Column:
    """The first boundary after all settlements, as a literal."""
    return F.lit(settled.agg(F.max(first_boundary(F.col("settled_us"), unit))).first()[0])


def rates_at_boundaries(obs: DataFrame, last: Column, unit: str = "month", keys: Sequence[str] = ("gp", "topic", "price_bucket"), least_markets: int = 1) -> DataFrame:
    """keys, boundary, n, n_markets, avg_price, rate, se: what was known at each boundary of each cell, each market with equal weight.

    obs has keys, ticker, settled_us, price and yes. Rows without settlement never count.
    """
    rows = obs.where("settled_us IS NOT NULL").withColumn("first", first_boundary(F.col("settled_us"), unit))
    market = rows.groupBy(*keys, "first", "ticker").agg(F.count("*").alias("n"), F.lit(1).alias("n_markets"), F.sum("price").alias("prices"), F.avg(F.col("yes").cast("int")).alias("means"))
    out = at_boundaries(market, keys, ["n", "n_markets", "prices", "means"], unit, last).where(F.col("n_markets") >= least_markets)
    rate = F.col("means") / F.col("n_markets")
    return out.select(*keys, "boundary", "n", "n_markets", (F.col("prices") / F.col("n")).alias("avg_price"), rate.alias("rate"), X.binomial_se(rate, F.col("n_markets")).alias("se"))


def counts_at_boundaries(rows: DataFrame, last: Column, counts: Sequence[str], keys: Sequence[str], unit: str = "month") -> DataFrame:
    """keys, boundary and counts of flags or numbers of rows with settled_us: fill rates at each boundary are quotients of them."""
    summed = rows.where("settled_us IS NOT NULL").select(*keys, first_boundary(F.col("settled_us"), unit).alias("first"), *[F.col(c).cast("long").alias(c) for c in counts])
    return at_boundaries(summed, keys, counts, unit, last)


def known_at(points: DataFrame, tables: DataFrame, keys: Sequence[str], time_us: str, unit: str, last: Column) -> DataFrame:
    """points with what the table of the last boundary at or before their time says of their cell, nulls if nothing: an equi-join, as there is a row for each boundary."""
    at = F.least(boundary_of(F.col(time_us), unit), last)
    return points.withColumn("boundary", at).join(tables, [*keys, "boundary"], "left")
