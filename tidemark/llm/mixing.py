"""Mix sources to target weights: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import fresh, save, uniform

#: Up to so many sources the table of rates (a few dozen bytes each) is broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 50_000
#: No source gives more than this times its words.
MOST = 3
SEED = 7
#: Rows alike are numbered in so many parts if they are many.
SALTS = 1000


def size(text: Column) -> Column:
    """Words of a text: runs of characters other than ASCII white space; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def _before(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """df with the sum of some columns over all rows before each in an order: range partitions are summed by themselves, and one row a partition is summed after that. df is written once, so that partitions keep their rows."""
    block, total = fresh(df, "block"), fresh(df, "total")
    cut = save(df.repartitionByRange(*order).withColumn(block, F.spark_partition_id()), "ordered")
    before = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(F.col(block).alias(total)).agg(*(F.sum(c).alias(f"{n}_total") for n, c in sums.items()))
    blocks = totals.select(total, *(F.coalesce(F.sum(f"{n}_total").over(before(Window.orderBy(total))), F.lit(0)).alias(f"{n}_total") for n in sums))
    inside = cut.select("*", *(F.coalesce(F.sum(c).over(before(Window.partitionBy(block).orderBy(*order))), F.lit(0)).alias(n) for n, c in sums.items()))
    joined = inside.join(blocks, F.col(block) == F.col(total))
    return joined.select(*df.columns, *((F.col(n) + F.col(f"{n}_total")).alias(n) for n in sums))


def rates(sizes: DataFrame, most: int = MOST) -> DataFrame:
    """source, source_size, target, rate from (source, size).

    Sources by code point, null last, weigh 1, 2, 3, 1, ... and share all words by weight; no target is over `most`
    times its source's words, and what is over goes to the others by weight. With the sources ordered by limit over
    weight, a source is at its limit as long as the level (words left over weights left) is not below that; the level
    where that ends gives the targets of all others. A source without words has target and rate 0.
    """
    by_source = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size"), F.lit(1).alias("one"))
    ranked = _before(by_source, [F.col("source").asc_nulls_last()], {"rank": "one"})
    weighed = save(ranked.select("source", "source_size", (F.col("rank") % 3 + 1).alias("weight"), (F.col("source_size") * most).alias("most")), "weighed")
    whole = weighed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    order = [F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()]
    levels = _before(weighed, order, {"most_before": "most", "weight_before": "weight"})
    left = (F.lit(whole["words"] or 0) - F.col("most_before")) / (F.lit(whole["weights"] or 0) - F.col("weight_before"))
    level = levels.agg(F.max(left)).first()[0]
    target = F.least(F.col("most").cast("double"), F.col("weight") * F.lit(level))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    return weighed.select("source", "source_size", target.cast("double").alias("target")).withColumn("rate", rate)


def numbered(docs: DataFrame, digest: str, name: str) -> DataFrame:
    """docs with a number from 0 among rows alike in doc_id, source and digest, in no order.

    Rows alike are counted first, by a table without texts; if there are none, no row moves. Rows alike that are more than 1 / SALTS of all
    rows, at most SALTS kinds, are dealt out and numbered in steps of SALTS; there the numbers depend on how docs is partitioned.
    """
    keys = ["doc_id", "source", digest]
    alike = save(docs.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1"), "rows-alike")
    if alike.isEmpty():
        return docs.withColumn(name, F.lit(0).cast("long"))
    many = docs.count() / SALTS
    hot, salt = fresh(docs, "hot"), fresh(docs, "salt")
    kinds = alike.where(F.col("n") > many).select(F.struct(*keys).alias(hot))
    rows = docs.join(F.broadcast(kinds), F.struct(*keys).eqNullSafe(F.col(hot)), "left")
    salted = rows.withColumn(salt, F.when(F.col(hot).isNotNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS))))
    place = F.row_number().over(Window.partitionBy(*keys, salt).orderBy(F.lit(0))) - 1
    return salted.withColumn(name, F.coalesce(place * SALTS + F.col(salt), place).cast("long")).drop(hot, salt)


def with_copies(docs: DataFrame, table: DataFrame, digest: str, seed: int = SEED) -> DataFrame:
    """plan: a struct of source_size, target, rate and copies beside each row of docs, under a name of its own that is the last column. copies is floor(rate), and one more with the fraction as probability, drawn from a hash of doc_id, the text's digest and the row's number among rows alike."""
    plan, of, number = fresh(docs, "plan"), fresh(docs, "of_source"), fresh(docs, "number")
    # the text is counted once: what follows reads one row a source
    table = save(table.select(F.col("source").alias(of), F.struct("source_size", "target", "rate").alias(plan)), "rates")
    if table.count() <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    joined = numbered(docs, digest, number).join(table, F.col("source").eqNullSafe(F.col(of)), "left").drop(of)
    rate = F.col(f"{plan}.rate")
    said = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), digest, F.col(number).cast("string"))
    copies = F.floor(rate) + (uniform(said, seed) < rate - F.floor(rate)).cast("long")
    return joined.withColumn(plan, F.struct(f"{plan}.source_size", f"{plan}.target", f"{plan}.rate", copies.cast("long").alias("copies"))).drop(number)


def text_digest() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def mix(docs: DataFrame, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mixed documents: each row of docs as often as its source's rate says, all its columns unchanged.

    A null source is a source of its own, after all others; a null or empty text has size 0 and is copied at its
    source's rate like any other. Rows that repeat a doc_id, or have none, draw by their text, and rows that repeat both
    draw each by a number of its own, so that their words come near the target too. Texts are never held, however long.
    Columns may have any name. An empty table gives an empty result.
    """
    table = rates(docs.select("source", size(F.col("text")).alias("size")), most)
    digest = fresh(docs, "digest")
    plan = with_copies(docs.withColumn(digest, text_digest()), table, digest, seed)
    copies = F.col(f"{plan.columns[-1]}.copies").cast("int")
    copy = fresh(plan, "copy")
    return plan.where(copies > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)


def mixing_plan(docs: DataFrame, most: int = MOST, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row: what mix() takes of it.

    Nulls, repeated rows, empty and very long texts and ties count as for mix(); taken is 0 for a row that isn't taken.
    An empty table gives an empty result; other columns are ignored.
    """
    sized = save(docs.select("doc_id", "source", size(F.col("text")).alias("size"), text_digest().alias("digest")), "sized")
    plan = with_copies(sized, rates(sized, most), "digest", seed)
    at = plan.columns[-1]
    return plan.select("doc_id", "size", f"{at}.source_size", f"{at}.target", (F.col("size") * F.col(f"{at}.copies")).alias("taken"))


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest,
    row_number() OVER (PARTITION BY doc_id, source, md5(coalesce(text, ''))) - 1 AS number FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, source_size * {MOST} AS most FROM by_source
), leveled AS (
  SELECT *, CAST((SELECT sum(source_size) FROM by_source) - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed WINDOW o AS (ORDER BY most / weight, source ASC NULLS LAST)
), targets AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE), weight * (SELECT max(level) FROM leveled)) AS target FROM leveled
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN least({MOST}.0, target / source_size) ELSE 0.0 END AS rate FROM targets
), drawn AS (
  SELECT doc_id, size, source_size, target, rate,
    CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || digest || '|' || number || '|{SEED}'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sized JOIN rated ON sized.source IS NOT DISTINCT FROM rated.source
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target,
  CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM drawn
"""
