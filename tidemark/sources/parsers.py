"""Rows from API text: typed, with the formats of either API version, and null for what doesn't parse."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("yes_bid", "yes_ask", "price")
FIELDS = ("open", "close", "high", "low")


def cents(dollars: Column) -> Column:
    """Whole cents of a text or number in dollars, half to even."""
    return F.bround(F.round(dollars.try_cast("double") * 100, 6)).cast("int")


def parameters(df: DataFrame, key: str, value: str, wanted: Mapping[str, tuple[str, object]]) -> DataFrame:
    """One row of typed parameters from key and value rows; a missing or bad value takes the default."""
    wide = df.groupBy().pivot(key, list(wanted)).agg(F.max(value))
    return wide.select(*[F.coalesce(F.col(k).try_cast(kind), F.lit(default).cast(kind)).alias(k) for k, (kind, default) in wanted.items()])


def trades(df: DataFrame, body: str) -> DataFrame:
    """Rows without trade_id or ticker drop."""
    wire = "trade_id string, ticker string, created_time string, count_fp string, yes_price_dollars string, no_price_dollars string, taker_side string"
    t = df.select(F.from_json(body, wire).alias("t")).select("t.*")
    t = t.where("trade_id <> '' AND ticker <> ''")
    return t.select("trade_id", "ticker", F.try_to_timestamp("created_time").alias("created_time"), F.col("count_fp").try_cast("double").cast("int").alias("count"), cents(F.col("yes_price_dollars")).alias("yes_cents"), cents(F.col("no_price_dollars")).alias("no_cents"), "taker_side")


def candles(df: DataFrame, body: str, *keep: str) -> DataFrame:
    """Both formats; missing parts are null, rows without an end time drop."""
    part = "struct<" + ",".join(f"{f}: string, {f}_dollars: string" for f in FIELDS) + ">"
    wire = f"end_period_ts bigint, {', '.join(f'{s} {part}' for s in SIDES)}, volume string, volume_fp string, open_interest string, open_interest_fp string"
    c = df.select(*keep, F.from_json(body, wire).alias("c")).where("c.end_period_ts IS NOT NULL")
    price = lambda s, f: F.coalesce(cents(F.col(f"c.{s}.{f}_dollars")), F.col(f"c.{s}.{f}").try_cast("double").cast("int")).alias(f"{s}_{f}")
    count = lambda n: F.coalesce(F.col(f"c.{n}_fp"), F.col(f"c.{n}")).try_cast("double").cast("int").alias(n)
    return c.select(*keep, F.timestamp_seconds("c.end_period_ts").alias("period_end"), *[price(s, f) for s in SIDES for f in FIELDS], count("volume"), count("open_interest"))


def ladder(dollars: Column, plain: Column) -> Column:
    """[[price, quantity], ...] of either format as an array of struct(price in cents, quantity); what a level lacks is null."""
    new = F.transform(dollars, lambda x: F.struct(cents(F.get(x, 0)).alias("price"), F.get(x, 1).try_cast("double").cast("int").alias("quantity")))
    old = F.transform(plain, lambda x: F.struct(F.get(x, 0).try_cast("int").alias("price"), F.get(x, 1).try_cast("int").alias("quantity")))
    return F.coalesce(new, old)


def book_top(yes: Column, no: Column) -> Column:
    """struct(bid, ask, yes_depth, no_depth): the ask is 100 less the best NO bid; null where a side is empty, a crossed book stays."""
    best = lambda side: F.array_max(F.transform(side, lambda x: x["price"]))
    depth = lambda side: F.aggregate(side, F.lit(0).cast("bigint"), lambda s, x: s + x["quantity"])
    return F.struct(best(yes).alias("bid"), (100 - best(no)).alias("ask"), depth(yes).alias("yes_depth"), depth(no).alias("no_depth"))


def better_than(side: Column, price: Column) -> Column:
    """Contracts of a ladder at better prices."""
    return F.aggregate(F.filter(side, lambda x: x["price"] > price), F.lit(0).cast("bigint"), lambda s, x: s + x["quantity"])


# Strike types that make an event's markets monotone.
THRESHOLD_TYPES = ("greater", "greater_or_equal", "less", "less_or_equal")


def market_structure(markets: Column, exclusive: Column, active_only: bool = True) -> Column:
    """Partition, monotone or standalone, from an event's markets (strike_type, status)."""
    used = F.filter(markets, lambda m: m["status"].isin("active", "open")) if active_only else markets
    has = lambda *kinds: F.exists(used, lambda m: m["strike_type"].isin(*kinds))
    return F.when(F.size(used) <= 1, "standalone").when(has("between"), "partition").when(exclusive, "partition").when(has(*THRESHOLD_TYPES), "monotone").otherwise("standalone")


def option_symbol(symbol: Column) -> Column:
    """struct(root, expiry, kind, strike); null for another form."""
    pattern = r"^(SPXW?)(\d{6})([CP])(\d{8})$"
    part = lambda i: F.regexp_extract(symbol, pattern, i)
    found = F.struct(part(1).alias("root"), F.to_date(F.concat(F.lit("20"), part(2)), "yyyyMMdd").alias("expiry"), F.when(part(3) == "C", "call").otherwise("put").alias("kind"), (part(4).try_cast("double") / 1000).alias("strike"))
    return F.when(symbol.rlike(pattern), found)


def winner(prices: Column) -> Column:
    """Index of the outcome that has settled: the first at exactly 1, else the largest above 0.9, else null."""
    most = F.array_max(prices)
    return F.when(F.try_element_at(prices, F.lit(1)) == 1, 0).when(most > 0.9, F.array_position(prices, most) - 1).cast("int")


def known_or_default(value: Column, known: Sequence[str], default: str) -> tuple[Column, Column]:
    """The value if it is known, else the default, and whether someone should look."""
    fine = F.coalesce(value.isin(*known), F.lit(False))
    return F.when(fine, value).otherwise(default), ~fine


def confidence(label: Column) -> Column:
    """A number, or that of high, medium and low."""
    return F.coalesce(label.try_cast("double"), F.element_at(F.create_map(F.lit("high"), F.lit(0.9), F.lit("medium"), F.lit(0.7), F.lit("low"), F.lit(0.4)), F.lower(label)))


def fenced_json(text: Column, schema: str) -> Column:
    """P20: JSON from an answer that may be fenced or have words around it: what is in the first fence, else from the first brace to the last. Null without either; fields of JSON that doesn't parse are null."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    braced = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.from_json(F.coalesce(F.nullif(fenced, F.lit("")), F.nullif(braced, F.lit(""))), schema)


def spread_bps(bid: Column, ask: Column) -> Column:
    """P13, P14."""
    return F.try_divide((ask - bid) * 20000, ask + bid)


def last_level(levels: Column) -> Column:
    """The best level of a ladder that ends with it."""
    return F.try_element_at(levels, F.lit(-1))


def options_chain(df: DataFrame, body: str, *keep: str) -> DataFrame:
    """The contracts of a chain document, with columns of its row that are to stay; numbers that don't parse are null, as are the parts of a symbol of another form.

    A symbol has eight digits for its strike, so a contract may state a strike beside it, which then counts.
    """
    wire = "data struct<options: array<struct<option: string, strike: string, bid: string, ask: string, iv: string, open_interest: string, volume: string>>>"
    o = df.select(*keep, F.explode(F.from_json(body, wire)["data"]["options"]).alias("o")).select(*keep, "o.*")
    number = {c: F.col(c).try_cast(k) for c, k in (("bid", "double"), ("ask", "double"), ("iv", "double"), ("open_interest", "int"), ("volume", "int"))}
    parsed = option_symbol(F.col("option"))
    return o.select(*keep, "option", parsed["root"].alias("root"), parsed["expiry"].alias("expiry"), parsed["kind"].alias("kind"), F.coalesce(F.col("strike").try_cast("double"), parsed["strike"]).alias("strike"), *[v.alias(c) for c, v in number.items()])


def daily_series(df: DataFrame, prices: str, volumes: str, *keep: str) -> DataFrame:
    """Aligned arrays of [ms, value] as one row a day, the first of each."""
    zipped = df.select(*keep, F.posexplode(F.arrays_zip(prices, volumes)).alias("i", "z"))
    rows = zipped.select(*keep, "i", F.timestamp_millis(F.col(f"z.{prices}")[0].cast("bigint")).cast("date").alias("date"), F.col(f"z.{prices}")[1].alias("price"), F.col(f"z.{volumes}")[1].alias("volume"))
    return rows.groupBy(*keep, "date").agg(F.min_by("price", "i").alias("price"), F.min_by("volume", "i").alias("volume"))


def series_observations(df: DataFrame, body: str, *keep: str) -> DataFrame:
    """Date and value of the observations in pages of a series; missing ones ('.', empty, null) and values that are no number drop, as do pages that don't parse."""
    o = df.select(*keep, F.explode(F.from_json(body, "observations array<struct<date: string, value: string>>")["observations"]).alias("o"))
    return o.select(*keep, F.col("o.date").try_cast("date").alias("date"), F.col("o.value").try_cast("double").alias("value")).where("value IS NOT NULL")


def api_windows(spark, first: str, last: str, done: DataFrame | None = None) -> DataFrame:
    """Months from first to last, newest first, without those in done(month)."""
    every = spark.sql(f"SELECT explode(sequence(date_trunc('month', date '{first}'), date_trunc('month', date '{last}'), interval 1 month)) AS month").withColumn("month", F.to_date("month"))
    left = every.join(done, "month", "left_anti") if done is not None else every
    return left.orderBy(F.col("month").desc())


def settlement_log(spark, path: str) -> DataFrame:
    """Settlements of a JSON-lines log; lines that don't parse drop."""
    schema = "action string, ticker string, side string, entry_price int, contracts int, won boolean, fee_cents int, pnl_cents int, edge_estimate double"
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where("action = 'settlement'")
