"""Calibration: rates by price and time, their smoothing and lookup, and edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X

#: Where an observation comes from, the best first.
SOURCES = ("hourly_candle", "snapshot", "daily_candle")
METHODS = ("bid", "mid", "ask", "trade")
#: Markets for a time slice, slices and markets of a cell at most and least.
PER_SLICE, MOST_SLICES, LEAST_MARKETS = 30, 20, 50
#: Weights of markets in the smoothing reach so many slices either way.
REACH = 2


def conditioning_price(method: str, bid: Column, ask: Column, trade: Column | None = None) -> Column:
    """Dollars; a trade price of 0 or less is none."""
    if method not in METHODS:
        raise ValueError(f"price method {method!r} is none of {METHODS}")
    cents = {"bid": bid, "ask": ask, "mid": (bid + ask) / F.lit(2.0), "trade": F.when(trade > 0, trade) if trade is not None else F.lit(None)}
    return cents[method].cast("double") / 100


def bucket_stats(obs: DataFrame, keys: Sequence[str], price: str, won: str) -> DataFrame:
    """Rows, mean price and share won of each key, and the gap between the two."""
    out = obs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(price).alias("avg_price"), F.avg(F.col(won).cast("int")).alias("rate"))
    return out.withColumn("gap", F.col("avg_price") - F.col("rate"))


def _beside(rows: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the totals of their keys, of which a null is one like any other; rows without totals go."""
    other = totals.withColumnsRenamed({k: f"{k}_of_total" for k in keys})
    same = [rows[k].eqNullSafe(other[f"{k}_of_total"]) for k in keys]
    return rows.join(other, same).drop(*[f"{k}_of_total" for k in keys])


def event_rates(obs: DataFrame, price: str, least_markets: int = LEAST_MARKETS, sources: Sequence[str] = SOURCES, by_market: DataFrame | None = None) -> DataFrame:
    """Rates of YES by process, topic, price bucket and adaptive slice of hours before settlement.

    obs has ticker, gp, topic, hours, yes, source, period_us, seq and a price in dollars. A cell with enough different
    markets is cut, in order of hours, into as many slices of equal rows as its markets allow; each market counts
    once in a slice; rates are smoothed over neighbouring slices by their markets; the source of a slice is its most
    frequent one, of equal ones the first in order. Rows are ranked within an hour of a cell and put after the counted
    rows of the hours before, so that no task sorts a whole cell. by_market, if given, are the rows of obs dealt out by
    ticker, from which its markets are counted where they are.
    """
    cell = ["gp", "topic", "price_bucket"]
    price_bucket, hour = X.price_bucket(F.col(price)).alias("price_bucket"), F.floor("hours").alias("hour")
    known = lambda df, *more: df.select(*cell[:2], price_bucket, hour, "ticker", *more).where("price_bucket IS NOT NULL")
    rows = known(obs, "hours", "period_us", "seq", "source", F.col("yes").cast("int").alias("yes"))
    whole = Window.partitionBy(*cell)
    # the place of a row in its cell: the rows of all earlier hours, and its place in its own hour
    counted = (rows if by_market is None else known(by_market)).groupBy(*cell, "hour", "ticker").agg(F.count("*").alias("c"))
    hours = counted.groupBy(*cell, "hour").agg(F.sum("c").alias("c"))
    before = F.sum("c").over(whole.orderBy("hour")) - F.col("c")
    placed_hours = hours.select(*cell, "hour", before.alias("before"), F.sum("c").over(whole).alias("cell_rows"))
    markets = counted.select(*cell, "ticker").distinct().groupBy(*cell).agg(F.count("*").alias("cell_markets")).where(F.col("cell_markets") >= least_markets)
    local = rows.withColumn("local", F.row_number().over(Window.partitionBy(*cell, "hour").orderBy("hours", "ticker", "period_us", "seq")) - 1)
    sized = _beside(local, _beside(placed_hours, markets, cell), [*cell, "hour"]).withColumn("rn", F.col("before") + F.col("local"))
    k = F.greatest(F.lit(1), F.least(F.floor(F.col("cell_markets") / PER_SLICE), F.lit(MOST_SLICES))).cast("int")
    # the slice of a row is the number of bounds at or before it: one more or less than its share of the rows, rounded
    guess = F.floor(F.col("rn") * F.col("k") / F.col("cell_rows"))
    bound = lambda i: F.bround(i * (F.col("cell_rows") / F.col("k"))).cast("long")
    index = F.when(F.col("rn") < bound(F.col("guess")), F.col("guess") - 1).when((F.col("rn") >= bound(F.col("guess") + 1)) & (F.col("guess") + 1 < F.col("k")), F.col("guess") + 1).otherwise(F.col("guess"))
    placed = sized.withColumn("k", k).withColumn("guess", guess).withColumn("bucket_index", index.cast("int"))
    slice_ = [*cell, "bucket_index"]
    # once for each market, then once for each slice
    of = [F.col("source") == s for s in sources]
    votes = [x for i, c in enumerate(of) for x in (F.count_if(c).alias(f"v{i}"), F.min(F.when(c, F.col("rn"))).alias(f"r{i}"))]
    market = placed.groupBy(*slice_, "ticker").agg(F.avg("yes").alias("m"), F.count("*").alias("c"), F.min("hours").alias("h0"), F.max("hours").alias("h1"), *votes)
    totals = [x for i in range(len(of)) for x in (F.sum(f"v{i}").alias(f"v{i}"), F.min(f"r{i}").alias(f"r{i}"))]
    base = market.groupBy(*slice_).agg(F.min("h0").alias("hours_from"), F.max("h1").alias("hours_to"), F.sum("c").alias("n"), F.count("*").alias("n_markets"), F.avg("m").alias("p_raw"), *totals)
    best = F.array_max(F.array(*[F.struct(F.col(f"v{i}").alias("v"), (-F.col(f"r{i}")).alias("r"), F.lit(s).alias("s")) for i, s in enumerate(sources)]))
    near = whole.orderBy("bucket_index").rowsBetween(-REACH, REACH)
    smooth = F.sum(F.col("p_raw") * F.col("n_markets")).over(near) / F.sum("n_markets").over(near)
    return base.withColumn("source", F.when(best["v"] > 0, best["s"])).withColumn("se", X.binomial_se(F.col("p_raw"), F.col("n_markets"))).withColumn("p_yes", smooth).drop(*[f"{x}{i}" for i in range(len(of)) for x in "vr"])


def rates_by_method(obs: DataFrame, least_markets: int = LEAST_MARKETS, sources: Sequence[str] = SOURCES) -> DataFrame:
    """C01 by each of the price methods in one pass: obs has bid, ask and trade in cents instead of a price; the method is one more part of the cell.

    Quotes are dealt out by ticker to count markets before they become a row for each method, so that counts of a market aren't shuffled.
    """
    prices = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), conditioning_price(m, F.col("bid"), F.col("ask"), F.col("trade")).alias("price")) for m in METHODS]))
    priced = lambda df: df.withColumn("_p", prices).where("_p.price IS NOT NULL").withColumn("gp", F.struct("_p.method", "gp")).withColumn("price", F.col("_p.price")).drop("_p")
    return event_rates(priced(obs), "price", least_markets, sources, priced(obs.repartition("ticker"))).withColumn("method", F.col("gp.method")).withColumn("gp", F.col("gp.gp"))


def averaged_rates(questions: DataFrame, rates: DataFrame) -> DataFrame:
    """Questions (gp, topic, hours, bid, ask, trade; prices in cents) with the mean rate and mean error of the price methods that know them, the least n_markets and the number of methods.

    Of each method the first slice of its price bucket that holds hours, both ends included, counts; a trade of 0, less or null is
    none. All methods share one index for each (gp, topic): a map from method and price bucket to its slices, 1600 slices at
    most, which a question meets in one join. Where no method knows it, or gp or topic is null, rate, se and n_markets are null.
    """
    slot = lambda m, bucket: METHODS.index(m) * 20 + bucket
    number = F.element_at(F.create_map(*[F.lit(x) for m in METHODS for x in (m, slot(m, 0))]), F.col("method")) + F.col("price_bucket")
    slices = rates.groupBy("gp", "topic", number.alias("slot")).agg(F.array_sort(F.collect_list(F.struct("bucket_index", "hours_from", "hours_to", "p_yes", "se", "n_markets"))).alias("slices"))
    index = slices.groupBy("gp", "topic").agg(F.map_from_entries(F.collect_list(F.struct("slot", "slices"))).alias("_index"))
    joined = questions.join(index, ["gp", "topic"], "left")

    def known(m: str) -> Column:
        bucket = X.price_bucket(conditioning_price(m, F.col("bid"), F.col("ask"), F.col("trade")))
        return F.try_element_at(F.filter(F.try_element_at("_index", slot(m, bucket)), lambda s: F.col("hours").between(s["hours_from"], s["hours_to"])), F.lit(1))

    hits = joined.withColumn("_hits", F.filter(F.array(*[known(m) for m in METHODS]), lambda h: h.isNotNull()))
    mean = lambda c: F.try_divide(F.aggregate("_hits", F.lit(0.0), lambda s, h: s + h[c]), F.size("_hits"))
    found = {"rate": mean("p_yes"), "se": mean("se"), "n_markets": F.array_min(F.transform("_hits", lambda h: h["n_markets"])), "n_methods": F.greatest(F.size("_hits"), F.lit(0))}
    return hits.select(*questions.columns, *[c.alias(n) for n, c in found.items()])


def best_source(obs: DataFrame, key: str, source: str, order: Sequence[str]) -> DataFrame:
    """All rows of the first source, in order, that a key has."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col(source))
    return obs.withColumn("_p", rank).withColumn("_best", F.min("_p").over(Window.partitionBy(key))).where("_p = _best").drop("_p", "_best")


def smoothed(df: DataFrame, keys: Sequence[str], order: str, value: str, weight: str) -> DataFrame:
    """Weighted mean over two rows either way, cut at the ends."""
    near = Window.partitionBy(*keys).orderBy(order).rowsBetween(-REACH, REACH)
    return df.withColumn("smooth", F.sum(F.col(value) * F.col(weight)).over(near) / F.sum(weight).over(near))


def smoothed_in_place(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Unweighted, and each row sees what its left neighbours have become. For cells of a few slices."""
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).cast("double").alias("v")))).alias("rows"))
    values = F.transform("rows", lambda r: r["v"])
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)

    def step(done, i):
        left = F.slice(done, F.greatest(F.lit(1), F.size(done) - 1), F.least(F.size(done), F.lit(2)))
        ahead = F.slice(values, i, F.lit(3))
        return F.concat(done, F.array(mean(F.concat(left, ahead))))

    done = F.aggregate(F.sequence(F.lit(1), F.size("rows")), F.expr("cast(array() as array<double>)"), step)
    return packed.withColumn("done", done).select(*keys, F.explode(F.arrays_zip("rows", "done")).alias("z")).select(*keys, f"z.rows.{order}", F.col("z.rows.v").alias(value), F.col("z.done").alias("smooth"))


def smoothed_recursively(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """W04 for all cells at once: a recursion whose step is the place of a slice, so that a level is one join and not one cell. keys, order, value and smooth; cells of up to a hundred slices."""
    by_place = Window.partitionBy(*keys).orderBy(order)
    ahead = [F.lead(value, i).over(by_place).alias(f"_v{i}") for i in (1, 2)]
    placed = df.select(*keys, order, F.col(value).cast("double").alias(value), *ahead, F.row_number().over(by_place).alias("_i"))
    names, same = ", ".join(f"r.{k}" for k in keys), " AND ".join(f"r.{k} <=> s.{k}" for k in keys)
    total = f"(coalesce(s._b, 0D) + coalesce(s._a, 0D) + r.{value} + coalesce(r._v1, 0D) + coalesce(r._v2, 0D))"
    count = "(int(s._b IS NOT NULL) + int(s._a IS NOT NULL) + 1 + int(r._v1 IS NOT NULL) + int(r._v2 IS NOT NULL))"
    first = total.replace("coalesce(s._b, 0D) + coalesce(s._a, 0D) + ", "")
    return df.sparkSession.sql(
        f"""WITH RECURSIVE s AS (
          SELECT {names}, r.{order}, r.{value}, r._i, CAST(NULL AS DOUBLE) AS _b, {first} / (1 + int(r._v1 IS NOT NULL) + int(r._v2 IS NOT NULL)) AS _a FROM {{rows}} r WHERE r._i = 1
          UNION ALL SELECT {names}, r.{order}, r.{value}, r._i, s._a, {total} / {count} FROM s JOIN {{rows}} r ON {same} AND r._i = s._i + 1)
        SELECT {', '.join(keys)}, {order}, {value}, _a AS smooth FROM s""",
        rows=placed,
    )


def fill_rates(obs: DataFrame, candles: DataFrame, steps: int = 10, least: int = 30) -> DataFrame:
    """Shares of quotes whose limit a later candle before settlement touches, by outcome.

    obs has ticker, gp, topic, result, settled_us, period_us, seq, bid, ask; candles their lows and highs as ask_low, bid_high.
    A limit is touched by a later candle if it is by the lowest ask (for NO: the highest bid) of all later ones, a suffix
    extreme, so that no pair of candles is formed.
    """
    later = Window.partitionBy("ticker").orderBy("period_us", "seq").rowsBetween(1, Window.unboundedFollowing)
    inside = candles.where("period_us < settled_us").select("ticker", "gp", "topic", "result", "settled_us", "period_us", "seq", "bid", "ask", F.min(F.when(F.col("ask_low") > 0, F.col("ask_low"))).over(later).alias("low"), F.max(F.when(F.col("bid_high") > 0, F.col("bid_high"))).over(later).alias("high"), F.count("*").over(later).alias("left"))
    book = F.explode(F.array(*[F.struct(F.lit(side).alias("side"), b.alias("b"), a.alias("a"), t.alias("reach")) for side, b, a, t in (("yes", F.col("bid"), F.col("ask"), F.col("low")), ("no", 100 - F.col("ask"), 100 - F.col("bid"), 100 - F.col("high")))]))
    sided = inside.where("left > 0").select("gp", "topic", "result", ((F.col("settled_us") - F.col("period_us")) / F.lit(3.6e9)).alias("hours"), book.alias("s")).select("*", "s.*").where("a > b")
    grid = F.explode(F.sequence(F.lit(0), F.lit(steps)))
    placed = sided.withColumn("step", grid).withColumn("limit", F.greatest(F.col("b"), F.least(F.col("a"), F.col("b") + F.bround((F.col("step") / F.lit(float(steps))) * (F.col("a") - F.col("b"))).cast("int"))))
    filled, won = F.coalesce(F.col("reach") <= F.col("limit"), F.lit(False)), F.col("result") == F.col("side")
    counts = placed.select("gp", "topic", X.fill_time_bucket(F.col("hours")).alias("time_bucket"), "side", "step", filled.alias("filled"), won.alias("won")).groupBy("gp", "topic", "time_bucket", "side", "step")
    table = counts.agg(F.count_if("won").alias("n_won"), F.count_if(~F.col("won")).alias("n_lost"), F.count_if(F.col("won") & F.col("filled")).alias("filled_won"), F.count_if(~F.col("won") & F.col("filled")).alias("filled_lost"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    out = table.where(F.col("n_won") + F.col("n_lost") >= least).withColumn("rate_won", rate("filled_won", "n_won")).withColumn("rate_lost", rate("filled_lost", "n_lost"))
    return out.withColumn("adverse", F.col("rate_lost") - F.col("rate_won"))


def series_edges(last: DataFrame, least: int) -> DataFrame:
    """Of each series the favourites' share won and what their price implies, in percent. last: series, side mid, won."""
    out = last.groupBy("series").agg(F.count("*").alias("n"), (F.avg(F.col("won").cast("int")) * 100).alias("win_pct"), F.avg("mid").alias("implied_pct")).where(F.col("n") >= least)
    return out.withColumn("edge", F.col("win_pct") - F.col("implied_pct"))
