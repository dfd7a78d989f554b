"""Joins that Spark has no operator for: as-of, band, fallback, bracketing, and lookups by levels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_last(left: DataFrame, right: DataFrame, key: str, at: str, time: str, values: Sequence[str], strict: bool = True, tie: Sequence[str] = ()) -> DataFrame:
    """Left with the values of the last right row of the same key before (or, not strict, at) left's `at`.

    Both sides are put in one time order per key, and each left row takes the last right row seen: linear in the rows, however
    many right rows a key has. Rows without an earlier right row have nulls. tie orders right rows of one time.
    """
    payload = F.struct(F.col(time).alias("_t"), *[F.col(v).alias(v) for v in dict.fromkeys((*tie, *values))])
    points = right.select(key, F.col(time).alias("_at"), F.lit(1 if strict else 0).alias("_side"), payload.alias("_right"), *[F.col(t).alias(f"_tie{i}") for i, t in enumerate(tie)])
    rows = left.select(key, F.col(at).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.struct(*left.columns).alias("_left"))
    both = points.unionByName(rows, allowMissingColumns=True)
    order = Window.partitionBy(key).orderBy("_at", "_side", *[f"_tie{i}" for i in range(len(tie))]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("_last", F.last("_right", ignorenulls=True).over(order)).where(F.col("_left").isNotNull())
    return seen.select("_left.*", *[F.col(f"_last.{v}").alias(v) for v in values if v not in left.columns], F.col("_last._t").alias("matched_at"))


def first_of(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in a total order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def band(left: DataFrame, bands: DataFrame, keys: Sequence[str], value: str, low: str, high: str, order: str, values: Sequence[str]) -> DataFrame:
    """Left with the values of the first band of its keys that holds value, both ends included; nulls in a gap.

    The bands of a key are few (a table of rates), so they travel as one sorted array and no left row is doubled.
    """
    packed = bands.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, low, high, *[v for v in values if v not in (order, low, high)]))).alias("_bands"))
    joined = left.join(packed, list(keys), "left")
    hit = F.try_element_at(F.filter("_bands", lambda b: F.col(value).between(b[low], b[high])), F.lit(1))
    return joined.withColumn("_hit", hit).select(*left.columns, *[F.col(f"_hit.{v}").alias(v) for v in values])


def fallback(left: DataFrame, levels: Sequence[tuple[DataFrame, Sequence[str]]], values: Sequence[str]) -> DataFrame:
    """Left with the values of the first level that knows its keys, and the level's number from 1 (null if none does)."""
    out, level, taken = left, F.lit(None).cast("int"), {v: F.lit(None) for v in values}
    for i, (table, keys) in enumerate(levels, 1):
        mine = table.select(*[F.col(k).alias(f"_{i}_{k}") for k in keys], F.struct(*values).alias(f"_v{i}"))
        out = out.join(mine, [F.col(k) == F.col(f"_{i}_{k}") for k in keys], "left") if keys else out.join(mine, how="left")
    first = F.coalesce(*[F.col(f"_v{i}") for i in range(1, len(levels) + 1)])
    for i in range(len(levels), 0, -1):
        level = F.when(F.col(f"_v{i}").isNotNull(), i).otherwise(level)
    taken = {v: first[v] for v in values}
    return out.select(*left.columns, *[c.alias(v) for v, c in taken.items()], level.alias("level"))


def interpolated(left: DataFrame, points: DataFrame, keys: Sequence[str], x: str, at: str, values: Sequence[str]) -> DataFrame:
    """Left with values of the points of its keys, straight between the two that bracket x and level outside; nulls without points."""
    packed = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("_x"), *values))).alias("_points"))
    joined = left.join(packed, list(keys), "left")
    low = F.try_element_at(F.filter("_points", lambda p: p["_x"] <= F.col(x)), F.lit(-1))
    high = F.try_element_at(F.filter("_points", lambda p: p["_x"] >= F.col(x)), F.lit(1))
    both = joined.withColumn("_low", F.coalesce(low, high)).withColumn("_high", F.coalesce(high, low))
    share = F.when(F.col("_high._x") > F.col("_low._x"), (F.col(x) - F.col("_low._x")) / (F.col("_high._x") - F.col("_low._x"))).otherwise(F.lit(0.0))
    return both.select(*left.columns, *[(F.col(f"_low.{v}") + share * (F.col(f"_high.{v}") - F.col(f"_low.{v}"))).alias(v) for v in values])


def class_of(markets: DataFrame, events: DataFrame, classes: DataFrame, values: Sequence[str] = ("gp", "topic")) -> DataFrame:
    """Values by the event's series, else by KX and the ticker's prefix, else by the prefix; each value from the first level that has it."""
    prefix = F.split_part(F.col("ticker"), F.lit("-"), F.lit(1))
    keyed = markets.join(events.select("event_ticker", F.col("series").alias("_k1")), "event_ticker", "left").withColumn("_k3", prefix).withColumn("_k2", F.concat(F.lit("KX"), "_k3"))
    for i in (1, 2, 3):
        mine = classes.select(F.col("series").alias(f"_s{i}"), *[F.col(v).alias(f"_{v}{i}") for v in values])
        keyed = keyed.join(mine, F.col(f"_k{i}") == F.col(f"_s{i}"), "left")
    return keyed.select(*markets.columns, *[F.coalesce(*[F.col(f"_{v}{i}") for i in (1, 2, 3)]).alias(v) for v in values])


def with_event(markets: DataFrame, events: DataFrame, **names: str) -> DataFrame:
    """Markets with columns of their event, given as new name = column of events; nulls where the event is unknown or null. Of events that are stored twice the row with the least values counts, so that no market is doubled."""
    known = events.groupBy("event_ticker").agg(F.min(F.struct(*[F.col(c).alias(n) for n, c in names.items()])).alias("_event"))
    return markets.join(known, "event_ticker", "left").select(*markets.columns, *[F.col(f"_event.{n}").alias(n) for n in names])


def filled_by_passes(rows: DataFrame, column: str, passes: Sequence[tuple[DataFrame, Sequence[Column], str]]) -> DataFrame:
    """Rows whose column is null or empty take it from the first pass that has it: (table, join condition, its column)."""
    out, found = rows, [F.nullif(F.col(column), F.lit(""))]
    for i, (table, keys, value) in enumerate(passes):
        mine = table.select(*[F.col(c).alias(f"_p{i}_{c}") for c in table.columns])
        condition = None
        for left_key, right_key in keys:
            one = left_key == F.col(f"_p{i}_{right_key}")
            condition = one if condition is None else condition & one
        out = out.join(mine, condition, "left")
        found.append(F.nullif(F.col(f"_p{i}_{value}"), F.lit("")))
    return out.select(*[F.coalesce(*found).alias(column) if c == column else F.col(c) for c in rows.columns])


def missing_months(df: DataFrame, time_us: str, *keys: str) -> DataFrame:
    """Of each key, or of all rows, months between the first and the last row that have none."""
    month = F.date_trunc("month", F.timestamp_micros(F.col(time_us))).cast("date")
    have = df.select(*keys, month.alias("month")).distinct()
    ends = have.groupBy(*keys).agg(F.min("month").alias("a"), F.max("month").alias("b"))
    every = ends.select(*keys, F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return every.join(have, [*keys, "month"], "left_anti")
