"""JSON documents of different formats in one column, as variants, without a schema for each format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.parsers import ladder


def _part(doc: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(doc, path, kind)


def books(df: DataFrame, body: str, *keep: str) -> DataFrame:
    """Format (new, old or none) and the ladders yes and no, arrays of struct(price in cents, quantity).

    A document with any field in `orderbook_fp` is a new one, in dollar strings; else `orderbook` counts, in cents. A side that
    is absent, null or no list of lists is empty; a level that doesn't parse has nulls in it. Documents that aren't JSON
    objects give nulls in all three columns; their rows stay.
    """
    doc = F.try_parse_json(F.col(body))
    parsed = df.withColumn("_doc", doc).withColumn("_top", _part(F.col("_doc"), "$", "map<string,variant>").isNotNull())
    has = lambda name: F.coalesce(F.size(_part(F.col("_doc"), f"$.{name}", "map<string,variant>")) > 0, F.lit(False))
    none = F.array().cast("array<struct<price:int,quantity:int>>")

    def side(name: str) -> Column:
        new = _part(F.col("_doc"), f"$.orderbook_fp.{name}_dollars", "array<array<string>>")
        old = _part(F.col("_doc"), f"$.orderbook.{name}", "array<array<string>>")
        levels = F.when(F.col("_new"), ladder(new, F.lit(None).cast("array<array<string>>"))).otherwise(ladder(F.lit(None).cast("array<array<string>>"), old))
        return F.when(F.col("_top"), F.coalesce(levels, none)).alias(name)

    form = F.when(F.col("_top"), F.when(F.col("_new"), "new").when(has("orderbook"), "old").otherwise("none"))
    return parsed.withColumn("_new", has("orderbook_fp")).select(*keep, form.alias("format"), side("yes"), side("no"))


def _id(item: str) -> Column:
    """An id as a number; null if it is missing, null, empty or 0, whatever its JSON type."""
    number = _part(F.col(item), "$.id", "string").try_cast("long")
    return F.when(number != 0, number)


def contracts(df: DataFrame, body: str, *keep: str) -> DataFrame:
    """A row for each contract of each market of a document.

    Markets and contracts without an id are left out, with all they hold, as are markets without contracts and documents that
    aren't JSON. Other fields that are absent or don't parse are null. spread_bps needs both costs and neither at 0. Each
    document is unfolded where it lies: two lateral explosions, no shuffle.
    """
    spark = df.sparkSession
    docs = df.select(*keep, F.try_variant_get(F.try_parse_json(F.col(body)), "$.markets", "variant").alias("_markets"))
    markets = docs.lateralJoin(spark.tvf.variant_explode(F.col("_markets").outer()).select(F.col("value").alias("_market")))
    named = markets.where(_id("_market").isNotNull()).select(*keep, _id("_market").alias("market_id"), _part(F.col("_market"), "$.shortName", "string").alias("market_name"), _part(F.col("_market"), "$.contracts", "variant").alias("_contracts"))
    each = named.lateralJoin(spark.tvf.variant_explode(F.col("_contracts").outer()).select(F.col("pos").alias("position"), F.col("value").alias("_contract"))).where(_id("_contract").isNotNull())
    price = lambda field: _part(F.col("_contract"), f"$.{field}", "string").try_cast("double")
    rows = each.select(
        *keep, "market_id", "market_name", "position", _id("_contract").alias("contract_id"), _part(F.col("_contract"), "$.name", "string").alias("name"),
        price("lastTradePrice").alias("last_trade"), price("bestBuyYesCost").alias("buy_yes"), price("bestSellYesCost").alias("sell_yes"),
        price("bestBuyNoCost").alias("buy_no"), price("bestSellNoCost").alias("sell_no"), price("lastClosePrice").alias("last_close"),
    )
    buy, sell = F.col("buy_yes"), F.col("sell_yes")
    return rows.withColumn("spread_bps", F.when((buy > 0) & (sell != 0) & (buy + sell > 0), (buy - sell) / ((buy + sell) / 2) * 10000))
