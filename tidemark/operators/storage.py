"""Which rows are read at all: a Bloom filter before the shuffle, and tables bucketed by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import exprs as X

#: Words of 64 bits in a filter, so that it is 4 MB at most; and the bits that a key sets in its word.
WORDS, BITS = 1 << 18, 4


def _word(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(WORDS)).cast("int")


def _mask(key: Column) -> Column:
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(key, F.lit(i)), F.lit(64)).cast("int")) for i in range(1, BITS + 1)]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def bloom_filter(keys: DataFrame, key: str) -> DataFrame:
    """word, bits: a Bloom filter whose keys each set BITS bits of one word, in one pass that combines before its shuffle; WORDS rows at most."""
    return keys.select(_word(F.col(key)).alias("word"), _mask(F.col(key)).alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits"))


def maybe_in(df: DataFrame, key: str, bloom: DataFrame) -> DataFrame:
    """Rows whose key may be in a filter, where they are read: the filter is broadcast (at most WORDS rows)."""
    tested = df.join(F.broadcast(bloom.withColumnsRenamed({"word": "_word", "bits": "_bits"})), _word(F.col(key)) == F.col("_word"))
    mask = _mask(F.col(key))
    return tested.where(F.col("_bits").bitwiseAND(mask) == mask).drop("_word", "_bits")


def semi_join_filtered(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in keys: a Bloom filter takes most others out before the shuffle, an exact join with the different keys the rest (a semi-join would be pushed below the filter)."""
    wanted = keys.select(key).where(F.col(key).isNotNull()).distinct()
    return maybe_in(df, key, bloom_filter(wanted, key)).join(wanted.hint("merge"), key).select(*df.columns)


def tail_preload(prints: DataFrame, markets: DataFrame, price: str) -> DataFrame:
    """All prints (ticker, price in cents) of the markets that have one at or beyond a tail price, 85 or more or 15 or less."""
    tail = prints.where((F.col(price) >= X.TAIL_LOW) | (F.col(price) <= 100 - X.TAIL_LOW)).select("ticker")
    return semi_join_filtered(prints, tail.join(markets.select("ticker"), "ticker", "left_semi"), "ticker")


def write_bucketed(df: DataFrame, table: str, key: str, order: Sequence[str], buckets: int, path: str) -> None:
    """Df as a table of `buckets` files by the hash of key, each sorted by key and order."""
    df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key, *order).option("path", path).saveAsTable(table)


def rows_of(spark: SparkSession, table: str, key: str, values: Sequence) -> DataFrame:
    """The rows of a few keys; only the files of their buckets are opened."""
    return spark.table(table).where(F.col(key).isin(list(values)))


def last_before(spark: SparkSession, quotes: str, points: str, key: str, time: str, at: str, tie: str, columns: Sequence[str]) -> DataFrame:
    """Of two tables bucketed alike by key, with one point a key, each point's last quote before it: the join and the aggregation both find their rows in place."""
    joined = spark.table(points).hint("merge").join(spark.table(quotes), key).where(F.col(time) < F.col(at))
    last = F.max_by(F.struct(time, *columns), F.struct(time, tie)).alias("last")
    return joined.groupBy(key).agg(last).select(key, "last.*")
