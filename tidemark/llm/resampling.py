"""Quality by importance resampling: a hashed n-gram model of target text over one of raw text weighs each document, and Gumbel noise makes the largest k a sample by weight without replacement."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import runs, save, uniform
from tidemark.llm.textnum import Words, blocks, mix

#: Unigrams and bigrams of words and of runs of punctuation fall into so many buckets.
BUCKETS = 1 << 14
#: The target model is fitted to at most so many rows labelled as good, the first by a hash of doc_id.
FIT_ROWS = 20_000
#: Share of the rows that the sample takes.
SHARE = 0.5
SEED = 11
BINS = 1024
OUT = "doc_id long, draw string, log_weight double"
GATHERED = "slice int, raw binary, target binary"


def _buckets(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each unigram and bigram."""
    text = np.repeat(np.arange(len(w.first) - 1), w.counts())
    pair = text[1:] == text[:-1]
    two = mix(w.hash[:-1] * np.uint64(0xD6E8FEB86659FD93) + w.hash[1:])[pair]
    shift = np.uint64(64 - 14)
    return np.concatenate([w.hash >> shift, two >> shift]).astype(np.int64), np.concatenate([text, text[1:][pair]])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for rows, w in blocks(batches, marks=True):
        bucket, text = _buckets(w)
        good = np.asarray(rows.column(1).to_numpy(zero_copy_only=False), bool)
        raw += np.bincount(bucket, minlength=BUCKETS)
        target += np.bincount(bucket[good[text]], minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([raw.tobytes()], pa.binary()), pa.array([target.tobytes()], pa.binary())], ["slice", "raw", "target"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict = {}
    for (key,), rows, _ in runs(batches, ["slice"]):
        held = sums.setdefault(key, [np.zeros(BUCKETS), np.zeros(BUCKETS)])
        for side in (0, 1):
            for x in rows.column(side + 1):
                held[side] += np.frombuffer(x.as_buffer(), np.float64)
    for key, (raw, target) in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.array([raw.tobytes()], pa.binary()), pa.array([target.tobytes()], pa.binary())], ["slice", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> np.ndarray:
    """Log ratio of the two models by bucket: the raw model from all rows of docs, the target model from the first fit_rows ids labelled as good; a null text or label adds nothing. Zeros without such rows."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    ids = good.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(fit_rows).withColumn("good", F.lit(True))
    marked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    parts = marked.mapInArrow(_gather, GATHERED)
    # each part has a row of a fixed size; they are added up in a few tasks, then in one
    dealt = parts.withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(64)).cast("int")).repartition("slice").sortWithinPartitions("slice").mapInArrow(_add_up, GATHERED)
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in dealt.collect():  # at most 64 rows
        raw += np.frombuffer(r["raw"])
        target += np.frombuffer(r["target"])
    model = lambda c: np.log((c + 1) / (c.sum() + BUCKETS))
    return model(target) - model(raw) if target.sum() else np.zeros(BUCKETS)


def _weigh(ratio_at):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, w in blocks(batches, marks=True):
            bucket, text = _buckets(w)
            weight = np.bincount(text, ratio_at.value[bucket], len(w.first) - 1)
            # without any word bincount gives whole numbers
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(weight.astype(float))], ["doc_id", "draw", "log_weight"])

    return work


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest value of column gumbel_key, by histograms of ever smaller ranges: the driver sees BINS counts a round."""
    low, high, above = *keys.agg(F.min("gumbel_key"), F.max("gumbel_key")).first(), 0
    while low < high:
        width = (high - low) / BINS
        inside = keys.where(F.col("gumbel_key").between(low, high))
        at = F.least(F.floor((F.col("gumbel_key") - low) / width), F.lit(BINS - 1))
        bins = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in inside.groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min("gumbel_key").alias("lo"), F.max("gumbel_key").alias("hi")).collect()}
        for b in sorted(bins, reverse=True):
            n, low, high = bins[b]
            if above + n >= k:
                break
            above += n
    return low


def resample(docs: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight, gumbel_key, selected of each row of docs: the share of rows with the largest key is selected.

    A null or empty text weighs as much in both models: 0. The draw is by doc_id and text, so rows without a doc_id draw
    each for themselves and rows that repeat both have one key; ties at the last place are all selected. Very long texts
    are read whole; other columns are ignored. Without rows labelled as good all weights are 0. An empty table gives an
    empty result.
    """
    ratio = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    drawn = docs.select("doc_id", "text", F.concat_ws("|", F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")).alias("draw"))
    weights = drawn.mapInArrow(_weigh(ratio), OUT)
    noise = -F.log(-F.log(uniform(F.col("draw"), seed) * (1 - 2.0**-40) + 2.0**-41))
    keys = save(weights.select("doc_id", "log_weight", (F.col("log_weight") + noise).alias("gumbel_key")), "resampled")
    k = round(keys.count() * share)
    last = kth_largest(keys, k) if k else float("inf")
    return keys.withColumn("selected", F.col("gumbel_key") >= F.lit(last))
