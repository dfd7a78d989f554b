"""Documents of several formats, inferred files, append sinks, counts from footers, rates over all price methods."""

import uuid

from pyspark.sql import functions as F

from tidemark.operators import calibration as C
from tidemark.operators import health as H
from tidemark.plans.catalog import query
from tidemark.plans.models import RATES_SQL
from tidemark.plans.upkeep import _in_files
from tidemark.session import shared_folder, written
from tidemark.sources import append as A
from tidemark.sources import delimited as D
from tidemark.sources import documents as N
from tidemark.sources import parsers as P


def _folder(m, name):
    return f"{shared_folder(m.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


BOOKS_SQL = """WITH l AS (SELECT l_orderkey AS k, l_linenumber % 2 AS side, CAST(2 * l_quantity - 1 AS INTEGER) AS p, CAST(floor(l_extendedprice / 1000) AS INTEGER) AS q FROM lineitem),
a AS (SELECT k, coalesce('[' || string_agg('["' || printf('%.2f', p / 100.0) || '","' || q || '.00"]', ',' ORDER BY p, q) FILTER (side = 1) || ']', 'null') AS yd, coalesce('[' || string_agg('["' || printf('%.2f', p / 100.0) || '","' || q || '.00"]', ',' ORDER BY p, q) FILTER (side = 0) || ']', 'null') AS nd,
  coalesce('[' || string_agg('[' || p || ',' || q || ']', ',' ORDER BY p, q) FILTER (side = 1) || ']', 'null') AS yc, coalesce('[' || string_agg('[' || p || ',' || q || ']', ',' ORDER BY p, q) FILTER (side = 0) || ']', 'null') AS nc FROM l GROUP BY k),
d AS (SELECT k, CASE WHEN k % 7 = 0 THEN '{"orderbook_fp":{"yes_dollars":' || yd WHEN k % 3 = 0 THEN '{"orderbook_fp":{"yes_dollars":' || yd || ',"no_dollars":' || nd || '}}' WHEN k % 3 = 1 THEN '{"orderbook":{"yes":' || yc || ',"no":' || nc || '}}' ELSE '{"orderbook_fp":{},"orderbook":{"yes":' || yc || ',"no":' || nc || '}}' END AS body FROM a)"""


def _books(m):
    """A document for each order: dollars, cents, cents beside an empty new book, or cut off."""
    line = m.raw("lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") % 2).alias("side"), F.struct((2 * F.col("l_quantity") - 1).cast("int").alias("p"), F.floor(F.col("l_extendedprice") / 1000).cast("int").alias("q")).alias("x"))
    sides = line.groupBy("k").agg(*[F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("x")))).alias(n) for s, n in ((1, "yes"), (0, "no"))])
    dollars = lambda x: F.format_string('["%.2f","%d.00"]', x["p"] / F.lit(100.0), x["q"])
    plain = lambda x: F.format_string("[%d,%d]", x["p"], x["q"])
    text = lambda side, f: F.when(F.size(side) > 0, F.concat(F.lit("["), F.array_join(F.transform(side, f), ","), F.lit("]"))).otherwise("null")
    new = F.concat(F.lit('{"orderbook_fp":{"yes_dollars":'), text("yes", dollars), F.lit(',"no_dollars":'), text("no", dollars), F.lit("}}"))
    old = F.concat(F.lit('"orderbook":{"yes":'), text("yes", plain), F.lit(',"no":'), text("no", plain), F.lit("}}"))
    cut = F.concat(F.lit('{"orderbook_fp":{"yes_dollars":'), text("yes", dollars))
    body = F.when(F.col("k") % 7 == 0, cut).when(F.col("k") % 3 == 0, new).when(F.col("k") % 3 == 1, F.concat(F.lit("{"), old)).otherwise(F.concat(F.lit('{"orderbook_fp":{},'), old))
    return sides.select("k", body.alias("body"))


@query(
    BOOKS_SQL
    + """, j AS (SELECT k, CASE WHEN json_valid(body) THEN CAST(body AS JSON) END AS j FROM d),
    s AS (SELECT k, j, CASE WHEN j IS NULL THEN NULL WHEN len(json_keys(j, '$.orderbook_fp')) > 0 THEN 'new' ELSE 'old' END AS format FROM j),
    v AS (SELECT k, format, CASE format WHEN 'new' THEN list_transform(from_json(j -> '$.orderbook_fp.yes_dollars', '[["VARCHAR"]]'), lambda x: [CAST(round(CAST(x[1] AS DOUBLE) * 100) AS INTEGER), CAST(CAST(x[2] AS DOUBLE) AS INTEGER)]) WHEN 'old' THEN from_json(j -> '$.orderbook.yes', '[["INTEGER"]]') END AS yes,
      CASE format WHEN 'new' THEN list_transform(from_json(j -> '$.orderbook_fp.no_dollars', '[["VARCHAR"]]'), lambda x: [CAST(round(CAST(x[1] AS DOUBLE) * 100) AS INTEGER), CAST(CAST(x[2] AS DOUBLE) AS INTEGER)]) WHEN 'old' THEN from_json(j -> '$.orderbook.no', '[["INTEGER"]]') END AS no FROM s)
    SELECT k AS o_orderkey, format, list_max(list_transform(yes, lambda x: x[1])) AS bid, 100 - list_max(list_transform(no, lambda x: x[1])) AS ask,
      CASE WHEN format IS NOT NULL THEN CAST(coalesce(list_sum(list_transform(yes, lambda x: x[2])), 0) AS BIGINT) END AS yes_depth, CASE WHEN format IS NOT NULL THEN CAST(coalesce(list_sum(list_transform(no, lambda x: x[2])), 0) AS BIGINT) END AS no_depth FROM v"""
)
def p03_books_of_both_formats(m):
    """Order books of two wire formats in one column; those cut off are rows of nulls."""
    parsed = N.books(_books(m), "body", "k").withColumn("top", P.book_top(F.col("yes"), F.col("no")))
    return parsed.select(F.col("k").alias("o_orderkey"), "format", "top.bid", "top.ask", "top.yes_depth", "top.no_depth")


@query(
    """SELECT o_custkey, o_orderkey AS market_id, CAST(l_partkey AS BIGINT) AS contract_id, bid / 100.0 AS buy_yes, sell / 100.0 AS sell_yes,
    CASE WHEN sell > 0 THEN round((bid / 100.0::DOUBLE - sell / 100.0::DOUBLE) / ((bid / 100.0::DOUBLE + sell / 100.0::DOUBLE) / 2) * 10000, 6) END AS spread_bps
    FROM (SELECT o_custkey, o_orderkey, l_partkey, CAST(2 * l_quantity - 1 AS INTEGER) AS bid, CASE WHEN l_returnflag = 'R' THEN NULL ELSE greatest(0, CAST(2 * l_quantity - 1 AS INTEGER) - l_linenumber) END AS sell FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_partkey <> 0 AND o_orderkey <> 0 AND o_orderkey % 11 <> 0 AND o_custkey % 13 <> 0)"""
)
def s12_nested_contracts(m):
    """A poll for each customer, contracts in its markets: markets without an id and polls cut off drop with all they hold."""
    bid = (2 * F.col("l_quantity") - 1).cast("int")
    sell = F.when(F.col("l_returnflag") != "R", F.greatest(F.lit(0), bid - F.col("l_linenumber")) / F.lit(100.0))
    contract = F.struct(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("name"), (bid / F.lit(100.0)).alias("bestBuyYesCost"), sell.alias("bestSellYesCost"))
    inner = m.raw("lineitem").groupBy("l_orderkey").agg(F.collect_list(contract).alias("contracts"))
    orders = m.raw("orders").join(inner, F.col("o_orderkey") == F.col("l_orderkey"))
    market = F.struct(F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderkey")).alias("id"), F.col("o_orderpriority").alias("shortName"), "contracts")
    text = F.to_json(F.struct(F.col("markets")))
    polls = orders.groupBy("o_custkey").agg(F.collect_list(market).alias("markets")).select("o_custkey", F.when(F.col("o_custkey") % 13 == 0, F.expr("substring(to_json(struct(markets)), 1, length(to_json(struct(markets))) - 1)")).otherwise(text).alias("body"))
    out = N.contracts(polls, "body", "o_custkey")
    return out.select("o_custkey", "market_id", "contract_id", "buy_yes", "sell_yes", F.round("spread_bps", 6).alias("spread_bps"))


@query("SELECT l_suppkey AS series, CAST(l_shipdate AS DATE) AS date, l_extendedprice AS value, l_orderkey FROM lineitem WHERE l_returnflag = 'A' OR (l_returnflag = 'N' AND l_linenumber % 2 = 0)")
def s08_series_observations(m):
    """Observations of series in pages, a page for each order and series: those that are missing drop."""
    value = F.when(F.col("l_returnflag") == "R", ".").when((F.col("l_returnflag") == "N") & (F.col("l_linenumber") % 2 > 0), F.when(F.col("l_partkey") % 2 == 0, "")).otherwise(F.col("l_extendedprice").cast("string"))
    page = m.raw("lineitem").groupBy(F.col("l_suppkey").alias("series"), "l_orderkey").agg(F.collect_list(F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), value.alias("value"))).alias("observations"))
    return P.series_observations(page.select("series", "l_orderkey", F.to_json(F.struct("observations")).alias("body")), "body", "series", "l_orderkey")


@query(
    """SELECT l_returnflag, 'bigint,double,string,timestamp' AS kinds, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (bad) AS BIGINT) AS n_bad, CAST(sum(CASE WHEN NOT bad THEN CAST(l_quantity AS BIGINT) END) AS BIGINT) AS quantity, CAST(sum(l_orderkey) AS BIGINT) AS keys
    FROM (SELECT *, (l_orderkey + l_linenumber) % 997 = 0 AS bad FROM lineitem) GROUP BY l_returnflag"""
)
def s15_inferred_csv(m):
    """Line items as CSV, of which some quantities are no numbers: their lines are kept, and the column stays a number."""
    bad = (F.col("l_orderkey") + F.col("l_linenumber")) % 997 == 0
    rows = m.raw("lineitem").select("l_orderkey", F.when(bad, "n/a").otherwise(F.col("l_quantity").cast("string")).alias("l_quantity"), "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("l_shipdate"))
    path = _folder(m, "lines-csv")
    rows.write.option("header", True).csv(path)
    back = D.read_csv(m.spark, path, share=1.0, tolerance=0.05)
    kinds = ",".join(f.dataType.simpleString() for f in back.schema.fields if f.name != D.CORRUPT)
    ok = F.col(D.CORRUPT).isNull()
    return back.groupBy("l_returnflag").agg(F.lit(kinds).alias("kinds"), F.count("*").alias("n"), F.count_if(~ok).alias("n_bad"), F.sum(F.when(ok, F.col("l_quantity").cast("long"))).alias("quantity"), F.sum("l_orderkey").alias("keys"))


@query("SELECT ticker, period_us, seq, bid, ask FROM candles", "candles")
def k16_appended_csv(m):
    """Quotes appended as CSV in two transactions, the second of which is written twice and adds its rows once."""
    A.register(m.spark)
    path, rows = _folder(m, "training-csv"), written(m.candles.select("ticker", "period_us", "seq", "bid", "ask", (F.col("seq") % 2).alias("half")), "quotes")
    for name, half in (("even", 0), ("odd", 1), ("odd", 1)):
        rows.where(F.col("half") == half).drop("half").write.format("append_csv").mode("append").option("transaction", name).save(path)
    return m.spark.read.schema("ticker string, period_us long, seq long, bid int, ask int").option("header", True).csv(path)


@query("SELECT event_id, user_id, event_type, CAST(floor(value * 100) AS BIGINT) AS cents FROM events")
def k17_appended_lines(m):
    """Events appended as JSON lines by a stream of several micro-batches, each of them a transaction."""
    A.register(m.spark)
    path, schema = _folder(m, "log-lines"), "event_id long, user_id long, event_type string, cents long"
    rows = _in_files(m).select("event_id", "user_id", "event_type", F.floor(F.col("value") * 100).alias("cents"))
    stream = rows.writeStream.format("append_lines").option("path", path).option("transaction", "log").option("checkpointLocation", _folder(m, "log-state")).trigger(availableNow=True).start()
    stream.awaitTermination()
    return m.spark.read.schema(schema).json(path)


COUNTED = {"orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "customer": "c_custkey", "documents": "doc_id", "pages": "page_id"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS dataset, CAST(count(*) AS BIGINT) AS n, CAST(min({k}) AS BIGINT) AS first_key, CAST(max({k}) AS BIGINT) AS last_key, CAST(count(*) AS BIGINT) AS n_exact FROM {t}" for t, k in COUNTED.items()))
def a29_footer_counts(m):
    """Rows and key ranges of tables from their footers, beside the count that a scan gives."""
    out = None
    for name, key in COUNTED.items():
        found = H.footer_counts(m.spark, f"{m.sf_dir}/{name}.parquet", key)
        row = found.select(F.lit(name).alias("dataset"), "n", F.col(f"first_{key}").alias("first_key"), F.col(f"last_{key}").alias("last_key")).join(m.raw(name).agg(F.count(key).alias("n_exact")))
        out = row if out is None else out.unionByName(row)
    return out


TRADE = "CASE WHEN seq % 3 = 0 THEN 0 ELSE bid + seq % (ask - bid + 1) END"
METHODS_SQL = (
    RATES_SQL.replace("WITH o AS (SELECT *, CAST(mid2 // 10 AS INTEGER) AS price_bucket FROM observations)", f"""WITH t AS (SELECT *, CAST({TRADE} AS INTEGER) AS trade FROM observations),
p AS (SELECT *, unnest([{{'method': 'bid', 'price2': 2 * bid}}, {{'method': 'mid', 'price2': bid + ask}}, {{'method': 'ask', 'price2': 2 * ask}}, {{'method': 'trade', 'price2': CASE WHEN trade > 0 THEN 2 * trade END}}], recursive := true) FROM t),
o AS (SELECT * REPLACE (method || '|' || gp AS gp), CAST(price2 // 10 AS INTEGER) AS price_bucket FROM p WHERE price2 BETWEEN 0 AND 199)""")
)


@query(
    f"""WITH t AS (SELECT *, CAST({TRADE} AS INTEGER) AS trade FROM observations),
    rates AS ({METHODS_SQL}),
    asked AS (SELECT ticker, period_us, seq, gp, topic, hours, unnest([{{'i': 1, 'method': 'bid', 'price2': 2 * bid}}, {{'i': 2, 'method': 'mid', 'price2': bid + ask}}, {{'i': 3, 'method': 'ask', 'price2': 2 * ask}}, {{'i': 4, 'method': 'trade', 'price2': CASE WHEN trade > 0 THEN 2 * trade END}}], recursive := true) FROM t),
    hit AS (SELECT a.ticker, a.period_us, a.seq, a.i, arg_min({{'p': r.p_yes, 's': r.se, 'n': r.n_markets}}, r.bucket_index) FILTER (r.gp IS NOT NULL) AS h FROM asked a LEFT JOIN rates r ON r.gp = a.method || '|' || a.gp AND r.topic = a.topic AND a.price2 BETWEEN 0 AND 199 AND r.price_bucket = CAST(a.price2 // 10 AS INTEGER) AND a.hours BETWEEN r.hours_from AND r.hours_to GROUP BY ALL)
    SELECT ticker, period_us, seq, round(avg(h.p), 12) AS rate, round(avg(h.s), 12) AS se, min(h.n) AS n_markets, CAST(count(h.p) AS INTEGER) AS n_methods FROM hit GROUP BY ticker, period_us, seq""",
    "observations",
)
def j16_averaged_rates(m):
    """Each quote's rate over bid, mid, ask and trade prices, whichever of them have a slice for it."""
    trade = F.when(F.col("seq") % 3 == 0, 0).otherwise(F.col("bid") + F.col("seq") % (F.col("ask") - F.col("bid") + 1)).cast("int")
    obs = written(m.observations.select("ticker", "period_us", "seq", "gp", "topic", "hours", "bid", "ask", trade.alias("trade"), F.col("origin").alias("source"), "yes"), "observations")
    rates = C.rates_by_method(obs, sources=("R", "A", "N")).withColumns({c: F.round(c, 9) for c in ("p_yes", "se")})
    out = C.averaged_rates(obs, rates)
    return out.select("ticker", "period_us", "seq", F.round("rate", 12).alias("rate"), F.round("se", 12).alias("se"), "n_markets", "n_methods")
