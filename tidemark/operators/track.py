"""Track records: summaries, drawdown, decay, and simulated distributions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summary(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Trades, wins, total, mean, sample deviation and their ratio (0 without deviation) of pnl."""
    out = trades.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(F.col("pnl") > 0).alias("wins"), F.sum("pnl").cast("bigint").alias("total"), F.avg("pnl").alias("mean"), F.coalesce(F.stddev_samp("pnl"), F.lit(0.0)).alias("std"))
    sharpe = F.when(F.round("std", 9) == 0, F.lit(0.0)).otherwise(F.try_divide("mean", "std"))
    return out.select(*keys, "n", "wins", "total", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), F.round(sharpe, 6).alias("sharpe"))


def drawdown(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Running pnl, its peak so far (at least 0), and how far it is below."""
    order = Window.partitionBy(*keys).orderBy("settled_us", "id").rowsBetween(Window.unboundedPreceding, 0)
    cum = trades.withColumn("cum", F.sum("pnl").over(order).cast("bigint")).withColumn("peak", F.greatest(F.lit(0), F.max("cum").over(order)).cast("bigint"))
    return cum.withColumn("drawdown", F.col("peak") - F.col("cum"))


def decayed(trades: DataFrame, keys: Sequence[str], window: int = 50, base: float = 0.85, least: float = 0.25) -> DataFrame:
    """Whether the last trades, once there are enough, won too little beyond base for the edge they promised."""
    last = Window.partitionBy(*keys).orderBy("settled_us", "id").rowsBetween(1 - window, 0)
    rows = trades.where("edge > 0").withColumn("_n", F.count("*").over(last)).withColumn("_capture", (F.avg(F.col("won").cast("int")).over(last) - base) / F.avg("edge").over(last))
    return rows.withColumn("paused", (F.col("_n") == window) & (F.col("_capture") < least)).drop("_n", "_capture")


def edge_capture(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of trades with an edge, what was promised, what came, and the ratio."""
    out = trades.where("edge > 0").groupBy(*keys).agg(F.count("*").alias("n"), F.avg("edge").alias("promised"), F.avg(F.col("pnl") / F.col("contracts") / 100).alias("realized"))
    return out.withColumn("capture", F.try_divide("realized", "promised"))


def simulated_totals(trades: DataFrame, sims: int, seed: int = 42) -> DataFrame:
    """Totals of sims replays in which each trade wins with its probability p. Draws are hashes of simulation and trade, so that any task can repeat them; trades are the small side."""
    runs = trades.sparkSession.range(sims).withColumnRenamed("id", "sim")
    joined = runs.join(F.broadcast(trades.select("id", "p", "gain", "loss")), how="cross")
    u = F.pmod(F.xxhash64("sim", "id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return joined.groupBy("sim").agg(F.sum(F.when(u < F.col("p"), F.col("gain")).otherwise(-F.col("loss"))).alias("total"))


def predictions(scored: pd.DataFrame) -> pd.DataFrame:
    """Predicted and observed shares of each group of a scored sample."""
    return scored.groupby("group", as_index=False).agg(n=("predicted", "size"), predicted=("predicted", "mean"), observed=("observed", "mean"))


def running_total(df: DataFrame, order: str, value: str, name: str, width: int = 1 << 16) -> DataFrame:
    """Df with the sum of value up to each row in the order of a whole number, without one sorted task.

    Blocks of width numbers are summed, and blocks of width blocks: a row has the sums of the outer blocks before, of the blocks
    before within its outer block, and of the rows before within its block. The one sort of all outer blocks has a row for
    each width * width numbers. Rows of one number go in any order.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / width)).withColumn("_outer", F.floor(F.col("_block") / width))
    sums = blocked.groupBy("_outer", "_block").agg(F.sum(value).alias("_sum"))
    earlier = lambda *by: (Window.partitionBy(*by) if by else Window).orderBy("_outer", "_block").rowsBetween(Window.unboundedPreceding, -1)
    outer = sums.groupBy("_outer").agg(F.sum("_sum").alias("_sum")).withColumn("_block", F.lit(0))
    starts = outer.select("_outer", F.coalesce(F.sum("_sum").over(earlier()), F.lit(0)).alias("_start"))
    before = sums.withColumn("_near", F.coalesce(F.sum("_sum").over(earlier("_outer")), F.lit(0))).join(starts, "_outer").select("_block", (F.col("_start") + F.col("_near")).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return blocked.withColumn("_inside", inside).join(before, "_block").withColumn(name, F.col("_before") + F.col("_inside")).drop("_block", "_outer", "_inside", "_before")
