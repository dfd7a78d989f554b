"""Exact duplicates by distributed MSD radix partitioning.

Texts are split by their first bytes, the parts by the next bytes, and so on, with wider steps each round. A row leaves
when its part holds no other row or when its text has ended; what ends together is equal, byte by byte, so no digest
decides. Each round counts the parts with an aggregation that combines before the shuffle, writes the parts of more
than one row, and joins them back: a join of two plain shuffles, whose hot parts Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, save

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """Null as empty; A-Z and nothing else in lower case."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def radix_groups(docs: DataFrame, first_width: int = 64, growth: int = 8) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs.

    A null text counts as empty; empty texts are equal to each other. Of equal texts the row with the largest doc_id is
    kept (a null doc_id is less than any other); if rows repeat that doc_id, one of them is. An empty table gives an
    empty result; columns of docs other than doc_id and text are ignored.
    """
    text = normalised(F.col("text"))
    rows = docs.select("doc_id", text.alias("rest")).select("doc_id", F.monotonically_increasing_id().alias("rid"), F.sha2(F.col("rest").cast("binary"), 256).alias("text_sha256"), F.lit(0).cast("long").alias("part"), F.col("rest").cast("binary").alias("rest"))
    active, width, left = save(rows, "radix"), first_width, []
    while True:
        split = active.withColumn("step", F.substring("rest", 1, width))
        parts = split.groupBy("part", "step").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "rid")).alias("top")).where("n > 1")
        parts = save(parts.select(F.col("part").alias("p"), F.col("step").alias("s"), "n", "top"), "radix-parts")
        # always a merge join: what moves then grows with the input alone, and hot parts can be split
        met = split.join(parts.hint("merge"), (F.col("part") == F.col("p")) & (F.col("step") == F.col("s")), "left")
        over = F.col("n").isNull() | (F.length("step") < width)
        alone = F.col("n").isNull()
        done = save(
            met.select(
                "doc_id",
                "rid",
                "text_sha256",
                over.alias("over"),
                F.when(alone, F.col("doc_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
                F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
                (alone | (F.col("top.rid") == F.col("rid"))).alias("kept"),
                F.col("top.rid").alias("part"),
                F.when(~over, F.expr(f"substring(rest, {width + 1}, length(rest))")).alias("rest"),
            ),
            "radix",
        )
        left.append(done.where("over").select("doc_id", "keep_id", "group_size", "kept", "text_sha256"))
        discard(parts)
        if len(left) == 1:
            discard(active)
        active = done.where("not over").select("doc_id", "rid", "text_sha256", "part", "rest")
        if active.isEmpty():
            break
        width *= growth
    out = left[0]
    for more in left[1:]:
        out = out.unionByName(more)
    return out
