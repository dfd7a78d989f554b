"""Language identification: a bidirectional gated recurrent network over bytes labels every position; a document's probabilities are the mean over its positions.

The network starts anew every SPAN bytes, which bounds what a position sees of its text, and a cut may fall within a
character. All positions of all pieces count.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import gru
from tidemark.llm.shared import by_bytes
from tidemark.llm.textnum import flat

#: Bytes that the network reads in a row; a text is cut into so long pieces, all of which are labelled.
SPAN = 64
HIDDEN = 8
#: The model is fitted to at most so many labelled rows, the first by a hash of doc_id, and to so many pieces of each.
FIT_ROWS, FIT_PIECES = 4000, 8
STEPS, BATCH, RATE = 400, 256, 0.02
#: Pieces that are labelled at once.
AT_ONCE = 4096
UNKNOWN = "und"
OUT = "doc_id long, held_out boolean, lang_pred string, score double"


def cuts(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each piece of all texts begins, how many bytes of it are the text's, and its text."""
    sizes = np.diff(at)
    many = -(-sizes // SPAN)
    text = np.repeat(np.arange(len(sizes)), many)
    order = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    begin = at[:-1][text] + order * SPAN
    return begin, np.minimum(SPAN, at[1:][text] - begin), text


def pieces(raw: np.ndarray, begin: np.ndarray, used: np.ndarray) -> np.ndarray:
    """(SPAN, pieces) bytes, 0 after a piece's end."""
    steps = np.arange(SPAN)[:, None]
    return np.where(steps < used, raw[np.minimum(begin + steps, len(raw) - 1)], 0)


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(1, keepdims=True)
    return x


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Up to FIT_PIECES pieces of each text, drawn by a hash of the text: (lang, piece, used), of a fixed size each."""
    for batch in batches:
        for i, j in by_bytes(batch.column(0), 1 << 20):
            rows = batch.slice(i, j - i)
            raw, at = flat(rows.column(0))
            if not len(raw):
                continue
            begin, used, owner = cuts(at)
            first = np.searchsorted(owner, np.arange(len(at)))
            keep = np.concatenate([a + np.random.default_rng(zlib.crc32(raw[x:y].tobytes())).permutation(b - a)[:FIT_PIECES] for a, b, x, y in zip(first, first[1:], at, at[1:], strict=False)]).astype(int)
            lang = rows.column(1).take(pa.array(owner[keep]))
            cut = pieces(raw, begin[keep], used[keep]).T
            yield pa.RecordBatch.from_arrays([lang, pa.array([np.ascontiguousarray(c).tobytes() for c in cut], pa.binary()), pa.array(used[keep].astype(np.int32))], ["lang", "piece", "used"])


def fit(sample: list[tuple[str, bytes, int]], seed: int = 1) -> dict:
    """Parameters of the network from pieces (lang, SPAN bytes, how many of them count): for each direction a table of inputs by byte and recurrent weights; weights of the labels."""
    names = sorted({lang for lang, _, _ in sample})
    rng = np.random.default_rng(seed)
    number = {n: k for k, n in enumerate(names)}
    used, label = np.array([u for _, _, u in sample], int), np.array([number[x] for x, _, _ in sample], int)
    rows = np.frombuffer(b"".join(x for _, x, _ in sample), np.uint8).reshape(-1, SPAN).T
    p = {"out": (rng.standard_normal((len(names), 2 * HIDDEN)) * 0.3).astype(np.float32), "bias": np.zeros((len(names), 1), np.float32)}
    for side in ("f", "b"):
        p[f"in_{side}"] = (rng.standard_normal((3 * HIDDEN, 256)) * 0.3).astype(np.float32)
        p[f"u_{side}"] = gru.initial(rng, HIDDEN)
    adam = gru.Adam(p, RATE)
    for step in range(STEPS if len(used) else 0):
        adam.rate = RATE * (1 - step / STEPS) + 0.001
        pick = rng.integers(0, len(used), BATCH)
        x, y = rows[:, pick], label[pick]
        valid = (np.arange(SPAN)[:, None] < used[pick]).astype(np.float32)
        kept: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([gru.forward(p[f"in_{s}"][:, x].transpose(1, 0, 2), p[f"u_{s}"], valid, s == "b", kept[s]) for s in "fb"], axis=1)
        d = _softmax(np.matmul(p["out"], h) + p["bias"])
        d[:, y, np.arange(BATCH)] -= 1
        d *= (valid / valid.sum())[:, None, :]
        d_h = np.matmul(p["out"].T, d)
        grads = {"out": np.einsum("tcb,thb->ch", d, h), "bias": d.sum((0, 2))[:, None]}
        for s, part in (("f", d_h[:, :HIDDEN]), ("b", d_h[:, HIDDEN:])):
            d_in, grads[f"u_{s}"] = gru.backward(part, p[f"u_{s}"], kept[s], valid)
            grads[f"in_{s}"] = np.stack([np.bincount(x.ravel(), d_in[:, k].ravel(), 256) for k in range(3 * HIDDEN)]).astype(np.float32)
        adam.update(grads)
    return p | {"names": names}


def label_positions(model: dict, rows: np.ndarray, valid: np.ndarray) -> np.ndarray:
    """Probabilities (SPAN, languages, pieces) of each position."""
    h = [gru.forward(np.take(model[f"in_{s}"], rows, axis=1).transpose(1, 0, 2), model[f"u_{s}"], valid if s == "b" else None, s == "b") for s in "fb"]
    scores = np.matmul(model["out"][:, :HIDDEN], h[0])
    scores += np.matmul(model["out"][:, HIDDEN:], h[1])
    scores += model["bias"]
    return _softmax(scores)


def document_probabilities(model: dict, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, languages): means over all positions of each text; zeros for an empty text."""
    sums = np.zeros((len(at) - 1, len(model["names"])))
    if at[-1] > at[0]:
        begin, used, text = cuts(at)
        for i in range(0, len(used), AT_ONCE):
            some = slice(i, i + AT_ONCE)
            valid = (np.arange(SPAN)[:, None] < used[some]).astype(np.float32)
            found = np.einsum("tcb,tb->bc", label_positions(model, pieces(raw, begin[some], used[some]), valid), valid)
            np.add.at(sums, text[some], found)
    return sums / np.maximum(np.diff(at), 1)[:, None]


def _predict(model_at):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at.value
        for batch in batches:
            column = batch.column(2)
            for i, j in by_bytes(column, SPAN * AT_ONCE):
                p = document_probabilities(model, *flat(column.slice(i, j - i)))
                known = np.asarray(batch.column(3).slice(i, j - i).to_numpy(zero_copy_only=False)) & bool(model["names"])
                best = p.argmax(1) if model["names"] else np.zeros(len(p), int)
                names = [model["names"][b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
                score = np.where(known, p.max(1, initial=0.0), 0.0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return work


def fold(docs: DataFrame, parts: int, out: int) -> DataFrame:
    """docs with held_out: whether CRC-32 of doc_id as text, modulo parts, is out. A null doc_id is the text `null`."""
    return docs.withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")) % parts == out)


def predict_languages(docs: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row of docs.

    Learned from text and lang of rows that aren't held out and whose lang isn't null. A null text, an empty one, one
    without a letter, and any text if there is nothing to learn from are `und` with score 0. Very long texts are read whole,
    piece by piece. Rows stay as they are, repeated ones too; a null doc_id is the text `null` for the fold; other columns
    are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = fold(docs.select("doc_id", "text", "lang"), 4, 2)
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    known = rows.where("not held_out and lang is not null and text is not null")
    # the sample is drawn from ids alone; of its rows only pieces of a fixed size leave the tasks that read them
    ids = known.select("doc_id").orderBy(order, "doc_id").limit(fit_rows).distinct().withColumnRenamed("doc_id", "of")
    met = known.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi").withColumn("number", F.xxhash64("lang", "text"))
    # ids that repeat could bring more rows than that: the first by hash stay
    last = met.select(order.alias("by"), "number").orderBy("by", "number").limit(fit_rows).agg(F.max(F.struct("by", "number")).alias("last"))
    learn = met.join(F.broadcast(last), F.struct(order, F.col("number")) <= F.col("last")).select("text", "lang")
    sample = sorted(tuple(r) for r in learn.mapInArrow(_choose, "lang string, piece binary, used int").collect())
    model = spark.sparkContext.broadcast(fit(sample))
    ready = rows.select("doc_id", "held_out", "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return ready.mapInArrow(_predict(model), OUT)
