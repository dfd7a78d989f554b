"""Dataset health: freshness, status, and checks in one pass over a table."""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Mapping, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def status(datasets: DataFrame, as_of_us: Column) -> DataFrame:
    """backfill_only, no_data, last_run_failed, stale or healthy, the first that holds."""
    age = as_of_us - F.col("freshest_us")
    out = F.when(F.col("provenance") == "backfill_only", "backfill_only").when(F.col("freshest_us").isNull(), "no_data").when(F.col("last_status") == "failed", "last_run_failed").when(age > F.col("max_stale_us"), "stale").otherwise("healthy")
    return datasets.withColumn("status", out)


def freshness(df: DataFrame, time: str, rows: Column | None = None) -> DataFrame:
    """First and last time and number of rows, of those that belong to the dataset."""
    used = df.where(rows) if rows is not None else df
    return used.agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count("*").alias("n"))


@contextlib.contextmanager
def _footers(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Parquet aggregates are pushed to the files' footers."""
    wanted = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def footer_counts(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """N, and first and last value of each column (whole numbers, floating point, dates), of Parquet files: one row, made when this is called.

    The numbers are exact. They come from the footers, and no data page is read; but where a file's footer has no ends of one
    of the columns, as of one that is null throughout, those columns are scanned.
    """
    ends = [f(c).alias(f"{n}_{c}") for c in columns for f, n in ((F.min, "first"), (F.max, "last"))]
    with _footers(spark):
        found = spark.read.parquet(path).agg(F.count("*").alias("n"), *ends)
        try:
            rows = found.collect()
        except Py4JJavaError as e:
            if "No min/max found" not in str(e):
                raise
            rows = None
    if rows is None:
        rows = spark.read.parquet(path).agg(F.count("*").alias("n"), *ends).collect()
    # a table without row groups has no count to add up
    return spark.createDataFrame([(r.n or 0, *r[1:]) for r in rows], found.schema)


def checks(df: DataFrame, rules: Mapping[str, tuple[Column, Column, float, float]]) -> DataFrame:
    """A row for each rule: name, bad, total, passed. A rule is (what is bad, among which rows, share allowed, number allowed); all are counted in one pass."""
    counts = [c for n, (bad, among, _, _) in rules.items() for c in (F.count_if(among & F.coalesce(bad, F.lit(False))).alias(f"bad_{n}"), F.count_if(among).alias(f"all_{n}"))]
    each = [F.struct(F.lit(n).alias("check_name"), F.col(f"bad_{n}").alias("bad"), F.col(f"all_{n}").alias("total"), (F.col(f"bad_{n}") <= F.greatest(F.lit(float(number)), F.lit(float(share)) * F.col(f"all_{n}"))).alias("passed")) for n, (_, _, share, number) in rules.items()]
    return df.agg(*counts).select(F.explode(F.array(*each)).alias("r")).select("r.*")


def at_least(df: DataFrame, rules: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """A row for each rule, as checks() gives them: an aggregate must reach a number; bad is what it lacks, total what it is."""
    sums = df.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(n) for n, (c, _) in rules.items()])
    each = [F.struct(F.lit(n).alias("check_name"), F.greatest(F.lit(0), least - F.col(n)).cast("long").alias("bad"), F.col(n).alias("total"), (F.col(n) >= least).alias("passed")) for n, (_, least) in rules.items()]
    return sums.select(F.explode(F.array(*each)).alias("r")).select("r.*")


def hourly_gaps(df: DataFrame, key: str, time_us: str) -> DataFrame:
    """Of each key, hours between its first and last row that have none."""
    hour = F.floor(F.col(time_us) / 3_600_000_000)
    have = df.select(key, hour.alias("hour")).distinct()
    spans = have.groupBy(key).agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    return spans.select(key, F.explode(F.sequence("a", "b")).alias("hour")).join(have, [key, "hour"], "left_anti")


def counts_by(df: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Q01-Q14: numbers of rows by each of several keys in one pass: the key's columns (grouped_by), their values and n."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    shown = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("null")).alias(c) for c in names])
    out = shown.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(F.count("*").alias("n"))
    return out.select(F.concat_ws(",", *[F.when(F.col(c).isNotNull(), F.lit(c)) for c in names]).alias("grouped_by"), F.concat_ws(",", *names).alias("value"), "n")
