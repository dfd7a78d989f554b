"""CSV files whose types are inferred, and whose bad lines are kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Types in the order in which they are tried; text takes what none of them does.
KINDS = ("boolean", "bigint", "double", "date", "timestamp")
CORRUPT = "_corrupt_record"


def inferred(spark: SparkSession, path: str, share: float = 1.0, tolerance: float = 0.0, **options: str) -> StructType:
    """The schema of CSV files with a header, from a share of their lines: of each column the first kind that all values but a tolerated share parse as.

    Empty values are null and say nothing; a column of nulls is text. The sample is counted in one pass, a row for all
    columns; with share 1 every line is counted.
    """
    lines = spark.read.options(header=True, **options).csv(path)
    sampled = lines.sample(share, seed=0) if share < 1 else lines
    text = {i: F.trim(F.col(f"`{c}`")) for i, c in enumerate(lines.columns)}
    whole = {"date": r"^\d{4}-\d{2}-\d{2}$", "timestamp": r"^\d{4}-\d{2}-\d{2}[ T]\d", "boolean": "(?i)^(true|false)$", "bigint": r"^[+-]?\d+$"}
    parses = lambda v, kind: (v.rlike(whole[kind]) if kind in whole else F.lit(True)) & v.try_cast(kind).isNotNull()
    counts = [F.count(v).alias(f"n{i}") for i, v in text.items()] + [F.count_if(parses(v, k)).alias(f"{k}{i}") for i, v in text.items() for k in KINDS]
    found = sampled.agg(*counts).first()
    kind = lambda i: next((k for k in KINDS if found[f"n{i}"] and found[f"{k}{i}"] >= (1 - tolerance) * found[f"n{i}"]), "string")
    return StructType.fromDDL(", ".join(f"`{c}` {kind(i)}" for i, c in enumerate(lines.columns)))


def read_csv(spark: SparkSession, path: str, share: float = 1.0, tolerance: float = 0.0, **options: str) -> DataFrame:
    """Typed rows; a line with another number of fields or with a value of another type is kept whole in _corrupt_record, with nulls for what didn't parse. Other rows have null there."""
    found = inferred(spark, path, share, tolerance, **options)
    schema = StructType([*found.fields, StructField(CORRUPT, StringType())])
    rows = spark.read.schema(schema).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, columnPruning=False, enforceSchema=False, **options).csv(path)
    # only what a query reads is parsed: whoever asks for bad lines reads all columns, so that a line is bad in every query or in none
    whole = F.length(F.concat_ws("", *[F.col(f"`{c}`").cast("string") for c in found.names])) >= 0
    return rows.withColumn(CORRUPT, F.when(F.col(CORRUPT).isNotNull() & whole, F.col(CORRUPT)))
