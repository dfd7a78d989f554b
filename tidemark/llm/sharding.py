"""Put rows into shards by vector bin packing: bytes, tokens and rows are balanced jointly.

Equal texts are a group; a group is placed as a whole in the shard where the dot product of its vector with what the shard
can still take is highest, large groups first. Groups that are large for a shard are cut into pieces. Pieces that are large for a block are
few at any size, and one task places them; all others are dealt out to blocks, which pack their pieces by themselves, each
into its share of what the large ones left. A task keeps three numbers a shard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.mixing import size as words
from tidemark.llm.shared import save

SHARDS = 40
#: Bytes of a row beside its text.
ROW_BYTES = 16
#: A group of more rows than one is cut where it has more than 1 / PARTS of a shard: at most 3 * SHARDS * PARTS groups, so their table is broadcast.
PARTS = 64
#: Blocks hold about so many pieces, but there are at most MOST_BLOCKS.
BLOCK_PIECES, MOST_BLOCKS = 20_000, 1024
#: A piece of more than 1 / COARSE of a block's share of a shard is placed before the blocks: at most 3 * SHARDS * COARSE * blocks of them, half a million.
COARSE = 4
DIMENSIONS = ["bytes", "tokens", "rows"]
PLACED = "digest binary, salt int, block int, shard int, base long, bytes double, tokens double, rows double"
RESULT = "doc_id long, size long, tokens long, text_crc32 long, law string, shard int, slot long, grown_shard int"


def sized(docs: DataFrame, tokens: Callable[[Column], Column] = words) -> DataFrame:
    """doc_id, size, tokens, text_crc32, digest, rid of each row; rid is to be written before it is used."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        tokens(text).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"),
        F.monotonically_increasing_id().alias("rid"),
    )


def _pack(batches: Iterator[pa.RecordBatch], room: Callable[[int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Place pieces, sorted by block and from large to small. room: what each shard may take of a block, a row a shard."""
    at, left, taken = None, np.zeros((0, 3)), np.zeros(0, "<i8")
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.stack([batch.column(d).to_numpy() for d in DIMENSIONS], axis=1)
        blocks, counts = batch.column("block").to_pylist(), batch.column("n").to_pylist()
        shards, bases = [], []
        for i, (block, n) in enumerate(zip(blocks, counts, strict=True)):
            if block != at:
                at, left = block, room(block).copy()
                taken = np.zeros(len(left), "<i8")
            shard = int(np.argmax(left @ sizes[i]))
            left[shard] -= sizes[i]
            shards.append(shard)
            bases.append(int(taken[shard]))
            taken[shard] += n
        yield pa.RecordBatch.from_arrays(
            [batch.column("digest"), batch.column("salt"), batch.column("block"), pa.array(shards, pa.int32()), pa.array(bases, pa.int64()), *(batch.column(d) for d in DIMENSIONS)],
            ["digest", "salt", "block", "shard", "base", *DIMENSIONS],
        )


def _sums(df: DataFrame, key: str) -> dict[int, np.ndarray]:
    """Sums of the dimensions by shard or block, of which there are few."""
    return {r[0]: np.array(r[1:]) for r in df.groupBy(key).agg(*(F.sum(d) for d in DIMENSIONS)).collect()}


def place(pieces: DataFrame, n_pieces: int, shards: int) -> DataFrame:
    """PLACED for each row of a written table (digest, salt, n, bytes, tokens, rows), the last three as shares of all: its shard, and how many rows of its block lie before it there. Block -1 holds the large pieces."""
    blocks = max(1, min(MOST_BLOCKS, round(n_pieces / BLOCK_PIECES)))
    largest = F.greatest(*DIMENSIONS)
    limit = 1 / (shards * COARSE * blocks)
    names = ["digest", "salt", "n", *DIMENSIONS]
    order = ["block", F.col("largest").desc(), "digest", "salt"]
    large = pieces.where(largest > limit).select(*names, F.lit(-1).alias("block"), largest.alias("largest"))
    whole = np.full((shards, 3), 1 / shards)
    first = save(large.repartition(1).sortWithinPartitions(*order).mapInArrow(lambda rows: _pack(rows, lambda _: whole), PLACED), "large-pieces")
    left = whole.copy()
    for shard, used in _sums(first, "shard").items():
        left[shard] -= used
    block = F.pmod(F.xxhash64("digest", "salt"), F.lit(blocks)).cast("int")
    small = pieces.where(largest <= limit).select(*names, block.alias("block"), largest.alias("largest"))
    totals = _sums(small, "block")
    rest = np.maximum(sum(totals.values(), np.zeros(3)), 1e-300)
    rooms = {b: left * (t / rest) for b, t in totals.items()}
    second = small.repartition(blocks, "block").sortWithinPartitions(*order).mapInArrow(lambda rows: _pack(rows, lambda b: rooms[b]), PLACED)
    return first.unionByName(second)


def shard_rows(docs: DataFrame, shards: int = SHARDS, tokens: Callable[[Column], Column] = words) -> DataFrame:
    """RESULT: one row for each row of docs. `law` is bytes: the shards' sizes are near equal, as are their tokens and rows; slots count from 0 in each.

    A null text counts as empty; a doc_id may be null or repeat. Equal texts lie in one shard, one after the other by
    doc_id, but for groups of more than 1 / PARTS of a shard, whose pieces may lie apart. A text larger than a shard's share makes
    its shard that much larger. An empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    rows = save(sized(docs, tokens), "sized")
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    if not total[2]:
        return docs.sparkSession.createDataFrame([], RESULT)
    share = [F.lit(1 / max(1, x)) for x in total]
    vector = [(F.count("*") * F.first(c) * share[i]).alias(d) for i, (d, c) in enumerate(zip(DIMENSIONS[:2], ("size", "tokens"), strict=True))] + [(F.count("*") * share[2]).alias("rows")]
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), *vector)
    parts = F.least(F.ceil(F.greatest(*DIMENSIONS) * shards * PARTS), F.col("n")).cast("int")
    hot = save(groups.select(F.col("digest").alias("hot"), parts.alias("parts")).where("parts > 1"), "hot-groups")
    salt = F.coalesce(F.pmod(F.xxhash64("rid"), F.col("parts")), F.lit(0)).cast("int")
    keyed = rows.join(F.broadcast(hot), F.col("digest") == F.col("hot"), "left").select(*rows.columns, salt.alias("salt"))
    pieces = save(keyed.groupBy("digest", "salt").agg(F.count("*").alias("n"), *vector), "pieces")
    placed = save(place(pieces, pieces.count(), shards), "placed")
    filled = placed.join(pieces.select("digest", "salt", "n"), ["digest", "salt"]).groupBy("block", "shard").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each block and shard: at most (MOST_BLOCKS + 1) * shards
    offsets = save(filled.select("block", "shard", F.coalesce(before, F.lit(0)).alias("offset")), "offsets")
    starts = placed.join(F.broadcast(offsets), ["block", "shard"]).select("digest", "salt", "shard", (F.col("offset") + F.col("base")).alias("start"))
    within = F.row_number().over(Window.partitionBy("digest", "salt").orderBy("doc_id", "rid")) - 1
    out = keyed.join(starts, ["digest", "salt"]).withColumn("slot", F.col("start") + within)
    return out.select("doc_id", "size", "tokens", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
