"""Event-contract views over the driver's tables, in Spark and as SQL for the oracle.

Times are microseconds since 1970 (`*_us`), prices whole cents. `settled` has a market for each order, `candles` a quote for
each line item of it, `tape` a print for each event of a user, whose market settles at the user's last event.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


class Market:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def classes(self) -> DataFrame:
        joined = self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        return joined.select(F.concat(F.lit("S"), "n_nationkey").alias("series"), F.col("r_name").alias("gp"), F.concat(F.lit("T"), F.col("n_nationkey") % 3).alias("topic"))

    @cached_property
    def settled(self) -> DataFrame:
        joined = self.raw("orders").join(self.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
        event = F.concat(F.lit("S"), "c_nationkey", F.lit("-"), "c_custkey")
        return joined.select(
            F.concat(event, F.lit("-"), "o_orderkey").alias("ticker"),
            event.alias("event_ticker"),
            F.concat(F.lit("S"), "c_nationkey").alias("series"),
            F.when(F.col("o_orderstatus") == "F", "yes").when(F.col("o_orderstatus") == "O", "no").alias("result"),
            F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("settled_us"),
            "o_orderkey",
            "o_totalprice",
            "o_orderpriority",
        )

    @cached_property
    def quoted(self) -> DataFrame:
        """Quotes with all of their market: a quote names its market by the order, so J01 and the ticker come from one join."""
        joined = self.raw("lineitem").join(self.settled, F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select(
            "ticker",
            F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("period_us"),
            (2 * F.col("l_quantity") - 1).cast("int").alias("bid"),
            (2 * F.col("l_quantity") + F.round(100 * F.col("l_discount"))).cast("int").alias("ask"),
            F.floor(F.col("l_extendedprice") / 1000).cast("int").alias("volume"),
            (F.col("l_partkey") * 1000 + F.col("l_linenumber")).alias("seq"),
            F.col("l_returnflag").alias("origin"),
            "event_ticker",
            "series",
            "result",
            "settled_us",
        )

    @cached_property
    def candles(self) -> DataFrame:
        return self.quoted.drop("event_ticker", "series", "result", "settled_us")

    @cached_property
    def tape(self) -> DataFrame:
        price = F.when(F.col("event_id") % 2 == 0, 85 + F.col("event_id") % 13).otherwise(3 + F.col("event_id") % 13)
        return self.raw("events").select(
            F.col("event_id").alias("trade_id"),
            F.concat(F.lit("U"), "user_id").alias("ticker"),
            F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
            (F.lit(1) + F.floor("value") % 50).cast("int").alias("count"),
            F.when(F.col("event_type").isin("view", "click"), "yes").otherwise("no").alias("taker_side"),
            price.cast("int").alias("yes_cents"),
            "user_id",
            "event_type",
        )

    @cached_property
    def tape_markets(self) -> DataFrame:
        ends = self.tape.groupBy("ticker", "user_id").agg(F.max("ts_us").alias("settled_us"))
        return ends.select("ticker", F.when(F.col("user_id") % 2 == 0, "yes").otherwise("no").alias("result"), "settled_us", F.concat(F.lit("G"), F.col("user_id") % 2).alias("gp"), F.concat(F.lit("T"), F.floor(F.col("user_id") / 2) % 2).alias("topic"))

    @cached_property
    def observations(self) -> DataFrame:
        """Quotes before settlement with their market's result and class."""
        joined = self.quoted.where(F.col("result").isNotNull()).join(self.classes, "series", "left")
        known = joined.withColumn("gp", F.coalesce("gp", F.lit("unknown"))).withColumn("topic", F.coalesce("topic", F.lit("unknown")))
        good = known.where("period_us < settled_us AND bid > 0 AND ask > 0 AND ask - bid <= 10 AND bid + ask BETWEEN 1 AND 199")
        return good.withColumn("hours", (F.col("settled_us") - F.col("period_us")) / F.lit(3.6e9)).withColumn("mid2", F.col("bid") + F.col("ask")).withColumn("mid", F.col("mid2") / F.lit(200.0)).withColumn("yes", F.col("result") == "yes")


#: The same views for DuckDB; the oracle of a query begins with those that it names.
VIEWS = {
    "classes": "SELECT 'S' || n_nationkey AS series, r_name AS gp, 'T' || (n_nationkey % 3) AS topic FROM nation JOIN region ON n_regionkey = r_regionkey",
    "settled": "SELECT 'S' || c_nationkey || '-' || c_custkey || '-' || o_orderkey AS ticker, 'S' || c_nationkey || '-' || c_custkey AS event_ticker, 'S' || c_nationkey AS series, CASE o_orderstatus WHEN 'F' THEN 'yes' WHEN 'O' THEN 'no' END AS result, epoch_us(o_orderdate) AS settled_us, o_orderkey, o_totalprice, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey",
    "candles": "SELECT ticker, epoch_us(l_shipdate) AS period_us, CAST(2 * l_quantity - 1 AS INTEGER) AS bid, CAST(2 * l_quantity + round(100 * l_discount) AS INTEGER) AS ask, CAST(floor(l_extendedprice / 1000) AS INTEGER) AS volume, l_partkey * 1000 + l_linenumber AS seq, l_returnflag AS origin FROM lineitem JOIN settled ON l_orderkey = o_orderkey",
    "tape": "SELECT event_id AS trade_id, 'U' || user_id AS ticker, epoch_us(ts) AS ts_us, CAST(1 + CAST(floor(value) AS BIGINT) % 50 AS INTEGER) AS count, CASE WHEN event_type IN ('view', 'click') THEN 'yes' ELSE 'no' END AS taker_side, CAST(CASE WHEN event_id % 2 = 0 THEN 85 + event_id % 13 ELSE 3 + event_id % 13 END AS INTEGER) AS yes_cents, user_id, event_type FROM events",
    "tape_markets": "SELECT ticker, CASE WHEN user_id % 2 = 0 THEN 'yes' ELSE 'no' END AS result, max(ts_us) AS settled_us, 'G' || (user_id % 2) AS gp, 'T' || ((user_id // 2) % 2) AS topic FROM tape GROUP BY ticker, user_id",
    "observations": "SELECT c.*, s.series, s.event_ticker, s.result, s.settled_us, coalesce(k.gp, 'unknown') AS gp, coalesce(k.topic, 'unknown') AS topic, (s.settled_us - c.period_us) / 3.6e9 AS hours, bid + ask AS mid2, (bid + ask) / 200.0 AS mid, s.result = 'yes' AS yes FROM candles c JOIN settled s ON c.ticker = s.ticker LEFT JOIN classes k ON s.series = k.series WHERE s.result IS NOT NULL AND period_us < settled_us AND bid > 0 AND ask > 0 AND ask - bid <= 10 AND bid + ask BETWEEN 1 AND 199",
}
_NEEDS = {"candles": ["settled"], "tape_markets": ["tape"], "observations": ["classes", "settled", "candles"]}


def with_views(sql: str, *names: str) -> str:
    """sql after the views it names (and those they need)."""
    order: list[str] = []
    for name in names:
        order += [n for n in (*_NEEDS.get(name, []), name) if n not in order]
    prefix = ",\n".join(f"{n} AS (SELECT * FROM ({VIEWS[n]}))" for n in order)
    body, first = sql.strip(), "WITH"
    if not prefix:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        body, first = "WITH " + body[15:], "WITH RECURSIVE"
    return f"{first} {prefix}{', ' + body[5:] if body[:5].upper() == 'WITH ' else ' ' + body}"
