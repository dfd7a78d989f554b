"""Which windows are still to be fetched, by interval algebra on completed ranges.

Ranges are half open, [start, end), in any number (seconds, days). Work is sorted by key: one row a range, no pair of ranges is
formed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400
# By resolution in minutes, days of one request and days to look back.
CHUNK_DAYS = {1: 1, 60: 7, 1440: 90}
LOOK_BACK_DAYS = {1: 14, 60: 365, 1440: 1460}


def union_of(ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, start, end: ranges of a key that overlap, nest or touch become one. Empty ranges and those without a bound go."""
    by_start = Window.partitionBy(*keys).orderBy("start", "end")
    reached = F.max("end").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    real = ranges.where(F.col("start") < F.col("end")).withColumn("_new", (reached.isNull() | (F.col("start") > reached)).cast("int"))
    island = real.withColumn("_island", F.sum("_new").over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def missing(spans: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, start, end: what ranges leave of each key's one span (keys, low, high)."""
    islands = union_of(ranges, keys).withColumnsRenamed({"start": "_s", "end": "_e"})
    low, high = F.col("low"), F.col("high")
    inside = spans.select(*keys, "low", "high").where(low < high).join(islands, list(keys), "left")
    touched = F.col("_s").isNotNull() & (F.col("_s") < high) & (F.col("_e") > low)
    # an island beside the span counts as an empty one at its end, so that a span keeps a row
    cut = inside.withColumn("_s", F.when(touched, F.greatest("_s", "low")).otherwise(high)).withColumn("_e", F.when(touched, F.least("_e", "high")).otherwise(high))
    by_start = Window.partitionBy(*keys).orderBy("_s", "_e")
    before = F.lag("_e").over(by_start)
    after = F.lead("_s").over(by_start)
    gaps = F.array(F.struct(F.coalesce(before, low).alias("start"), F.col("_s").alias("end")), F.struct(F.col("_e").alias("start"), F.when(after.isNull(), high).alias("end")))
    return cut.select(*keys, gaps.alias("_gaps")).select(*keys, F.explode("_gaps").alias("_g")).select(*keys, "_g.*").where(F.col("start") < F.col("end"))


def chunks(gaps: DataFrame, size: Column) -> DataFrame:
    """Gaps cut into pieces of size from their end backwards, the earliest one shorter; number 0 is the latest."""
    number = F.explode(F.sequence(F.lit(0), (F.ceil((F.col("end") - F.col("start")) / size) - 1).cast("int"))).alias("number")
    others = [c for c in gaps.columns if c not in ("start", "end")]
    cut = gaps.withColumn("_size", size).select("*", number)
    start = F.greatest(F.col("start"), F.col("end") - (F.col("number") + 1) * F.col("_size"))
    return cut.select(*others, "number", start.alias("start"), (F.col("end") - F.col("number") * F.col("_size")).alias("end"))


def by_resolution(table: dict[int, int]) -> Column:
    """Days of a row's resolution, null for an unknown one."""
    return F.element_at(F.create_map(*[F.lit(x) for p in table.items() for x in p]), F.col("resolution"))


def backfill_windows(markets: DataFrame, runs: DataFrame) -> DataFrame:
    """ticker, resolution, number, start, end in seconds: what is to be fetched of markets (ticker, resolution, settled_s), from settlement backwards.

    runs (ticker, resolution, start, end, status): only completed ones count, however they overlap. A resolution that isn't known has no window.
    """
    keys = ["ticker", "resolution"]
    spans = markets.select(*keys, (F.col("settled_s") - by_resolution(LOOK_BACK_DAYS) * DAY).alias("low"), F.col("settled_s").alias("high"))
    gaps = missing(spans, runs.where("status = 'completed'").select(*keys, "start", "end"), keys)
    return chunks(gaps, by_resolution(CHUNK_DAYS) * DAY)


def uncovered(windows: DataFrame, ranges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Windows (keys, start, end) that the completed ranges of their key don't cover as a whole, in one sorted pass: the island that a window could lie in is the last one that begins at or before it."""
    islands = union_of(ranges, keys).select(*keys, F.col("start").alias("t"), F.lit(0).alias("_kind"), F.col("end").alias("_reach"))
    asked = windows.select(*keys, F.col("start").alias("t"), F.lit(1).alias("_kind"), F.struct("start", "end").alias("_w"))
    last = F.last("_reach", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("t", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    both = islands.unionByName(asked, allowMissingColumns=True).withColumn("_covered_to", last)
    return both.where((F.col("_kind") == 1) & (F.col("_covered_to").isNull() | (F.col("_covered_to") < F.col("_w.end")))).select(*keys, "_w.start", "_w.end")


def days_to_fetch(spans: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys, day: the days of each key's one span (keys, first, last; both ends included) that done (keys, day) doesn't have. Spans without a bound or that end before they begin have none; null keys are keys."""
    real = spans.where(F.col("first") <= F.col("last"))
    every = real.select(*keys, F.explode(F.sequence("first", "last")).alias("day"))
    have = done.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("day").alias("_day"))
    return every.join(have, [F.col("day") == F.col("_day"), *[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]], "left_anti")
