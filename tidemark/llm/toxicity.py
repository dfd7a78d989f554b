"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

A text is read in overlapping windows of words, all of which are scored; its score is that of its worst window. The
inputs of a word are a few learned numbers of its hash bucket, the mean of a few learned numbers of its character n-grams,
the log odds of the word's bucket, and the largest and the mean log odds of its n-grams.

The fit reads a bounded sample of labelled rows and holds no text outside the tasks that read it: tasks count buckets and
add up slices of the counts, other tasks choose windows, which have a fixed size, and one task trains the network on those.
The driver sees the tables of odds and the network, both of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import gru
from tidemark.llm.language import fold
from tidemark.llm.shared import by_bytes, discard, runs, save
from tidemark.llm.textnum import Words, flat

WINDOW, STRIDE = 32, 16
HIDDEN, EMBED, CHARS = 8, 4, 4
WORD_BITS, GRAM_BITS, CHAR_BITS = 18, 20, 14
#: Lengths in bytes of character n-grams; the blank before and after a word counts. Those of the first length have learned numbers.
GRAMS = (5, 7, 9)
INPUTS = 3 + EMBED + CHARS
#: The model is fitted to at most so many labelled rows, the first by a hash of doc_id, and to so many windows of each.
FIT_ROWS, FIT_WINDOWS = 8000, 8
EPOCHS, BATCH, RATE = 4, 48, 0.01
#: Log odds need so many texts behind them.
SEEN = 4
AT_ONCE = 2048
#: Tasks that read the sample, and slices of the counts.
READERS, SLICES = 8, 32
OUT = "doc_id long, held_out boolean, score double, predicted int"


def read(texts: pa.Array) -> tuple[Words, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words, the bucket of each, and for each n-gram length the buckets with the word of each n-gram."""
    raw, at = flat(texts)
    # a blank on either side of each text, so that n-grams and words end there
    n = len(at) - 1
    padded = np.full(len(raw) + 2 * n, 32, np.uint8)
    shift = np.repeat(2 * np.arange(n) + 1, np.diff(at))
    padded[np.arange(len(raw)) + shift] = raw
    w = Words(padded, at + 2 * np.arange(n + 1))
    grams = []
    span = w.end - w.begin + 2
    for size in GRAMS:
        many = np.maximum(span - size + 1, 0)
        word = np.repeat(np.arange(len(w)), many)
        begin = w.begin[word] - 1 + np.arange(len(word)) - np.repeat(np.cumsum(many) - many, many)
        hashed = w.spans(begin, begin + size) + np.uint64(size)
        grams.append(((hashed >> np.uint64(64 - GRAM_BITS)).astype(np.int64), word))
    return w, (w.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64), grams


def _present(bucket: np.ndarray, text: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of each pair once."""
    both = np.unique((text.astype(np.int64) << bits) | bucket)
    return both & ((1 << bits) - 1), both >> bits


def _odds(pos: np.ndarray, neg: np.ndarray, positives: int, negatives: int) -> np.ndarray:
    """Smoothed log odds by bucket; 0 for buckets of fewer than SEEN texts."""
    odds = np.log((pos + 1) / (positives + 2)) - np.log((neg + 1) / (negatives + 2))
    return np.where(pos + neg >= SEEN, np.clip(odds, -4, 6), 0).astype(np.float32)


def features(tables: dict, w: Words, bucket: np.ndarray, grams: list) -> np.ndarray:
    """(3, words + 1): log odds of each word, the largest and the mean of its n-grams; the last word is none."""
    out = np.zeros((3, len(w) + 1), np.float32)
    out[0, :-1] = tables["word"][bucket]
    count = np.zeros(len(w), np.float32)
    for index, word in grams:
        if not len(word):
            continue
        value = tables["gram"][index]
        start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        which = word[start]
        out[1, which] = np.maximum(out[1, which], np.maximum.reduceat(value, start))
        out[2, which] += np.add.reduceat(value, start)
        count[which] += np.diff(np.r_[start, len(word)])
    out[2, :-1] /= np.maximum(count, 1)
    return out


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, length and text of each window: at every STRIDE words, until one reaches the end; one without words for an empty text."""
    counts = np.diff(first)
    many = 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE))
    text = np.repeat(np.arange(len(counts)), many)
    begin = (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    return first[:-1][text] + begin, np.minimum(WINDOW, counts[text] - begin), text


def char_means(table: np.ndarray, size: int, index: np.ndarray, word: np.ndarray) -> np.ndarray:
    """(CHARS, size): the mean of table's (CHARS, buckets) columns over the n-grams of each of so many words, given bucket and word of each n-gram."""
    many = np.bincount(word, minlength=size)
    return np.stack([np.bincount(word, row[index], size) for row in table]).astype(np.float32) / np.maximum(many, 1).astype(np.float32)


def char_buckets(index: np.ndarray) -> np.ndarray:
    return index >> (GRAM_BITS - CHAR_BITS)


def _inputs(feats: np.ndarray, begin: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inputs (WINDOW, features, windows) and where they are words; the last column of feats is none."""
    steps = np.arange(WINDOW)[:, None]
    valid = steps < used
    index = np.where(valid, begin + steps, feats.shape[1] - 1)
    return np.ascontiguousarray(feats[:, index].transpose(1, 0, 2)), valid.astype(np.float32)


def _network(p: dict, x: np.ndarray, valid: np.ndarray, kept: dict | None = None) -> tuple[np.ndarray, tuple]:
    h = np.concatenate([gru.forward(np.matmul(p[f"w_{s}"], x) + p[f"c_{s}"], p[f"u_{s}"], valid, s == "b", kept[s] if kept else None) for s in "fb"], axis=1)
    a = np.tanh(np.matmul(p["att"], h))
    score = np.einsum("k,tkb->tb", p["pick"], a) + (valid - 1) * 1e4
    score = np.exp(score - score.max(0))
    share = score / score.sum(0)
    pooled = np.einsum("tb,thb->hb", share, h)
    return p["out"] @ pooled + p["bias"][0], (h, a, share, pooled)


def _gradients(p: dict, x: np.ndarray, valid: np.ndarray, kept: dict, mid: tuple, d: np.ndarray) -> tuple[dict, np.ndarray]:
    h, a, share, pooled = mid
    g = {"out": pooled @ d, "bias": np.array([d.sum()], np.float32)}
    d_pool = np.outer(p["out"], d)
    d_share = np.einsum("thb,hb->tb", h, d_pool)
    d_score = share * (d_share - (share * d_share).sum(0))
    g["pick"] = np.einsum("tb,tkb->k", d_score, a)
    d_a = d_score[:, None, :] * p["pick"][None, :, None] * (1 - a * a)
    g["att"] = np.einsum("tkb,thb->kh", d_a, h)
    d_h = share[:, None, :] * d_pool + np.matmul(p["att"].T, d_a)
    d_x = np.zeros_like(x)
    for s, part in (("f", d_h[:, :HIDDEN]), ("b", d_h[:, HIDDEN:])):
        d_in, g[f"u_{s}"] = gru.backward(part, p[f"u_{s}"], kept[s], valid)
        d_in *= valid[:, None, :]
        g[f"w_{s}"] = np.einsum("tkb,tdb->kd", d_in, x)
        g[f"c_{s}"] = d_in.sum((0, 2))[:, None]
        d_x += np.matmul(p[f"w_{s}"].T, d_in)
    return g, d_x


def initial(seed: int = 1) -> dict:
    rng = np.random.default_rng(seed)
    p = {"bias": np.zeros(1, np.float32), "out": (rng.standard_normal(2 * HIDDEN) * 0.3).astype(np.float32), "att": (rng.standard_normal((4, 2 * HIDDEN)) * 0.3).astype(np.float32), "pick": (rng.standard_normal(4) * 0.3).astype(np.float32)}
    p |= {"embed": (rng.standard_normal((EMBED, 1 << WORD_BITS)) * 0.02).astype(np.float32), "chars": (rng.standard_normal((CHARS, 1 << CHAR_BITS)) * 0.1).astype(np.float32)}
    for s in "fb":
        p[f"w_{s}"] = (rng.standard_normal((3 * HIDDEN, INPUTS)) * 0.3).astype(np.float32)
        p[f"c_{s}"] = np.zeros((3 * HIDDEN, 1), np.float32)
        p[f"u_{s}"] = gru.initial(rng, HIDDEN)
    return p


def _counts(texts: pa.Array, label: np.ndarray, half: np.ndarray, found: dict[str, np.ndarray]) -> None:
    """Add to (half, label, buckets): in how many texts a word or n-gram bucket is."""
    w, bucket, grams = read(texts)
    text_of = np.repeat(np.arange(len(texts)), w.counts())
    index, owner = np.concatenate([i for i, _ in grams]), np.concatenate([text_of[word] for _, word in grams])
    for name, bits, values, owners in (("word", WORD_BITS, bucket, text_of), ("gram", GRAM_BITS, index, owner)):
        b, t = _present(values, owners, bits)
        np.add.at(found[name], (half[t], label[t], b), 1)


COUNTED = "slice int, texts binary, word binary, gram binary"


def _sides(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return (rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(int) for c in ("toxic", "half"))


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = {"word": np.zeros((2, 2, 1 << WORD_BITS), np.int32), "gram": np.zeros((2, 2, 1 << GRAM_BITS), np.int32)}
    texts = np.zeros((2, 2), np.int64)
    for batch in batches:
        for i, j in by_bytes(batch.column(0), 1 << 17):
            rows = batch.slice(i, j - i)
            label, half = _sides(rows)
            np.add.at(texts, (half, label), 1)
            _counts(rows.column(0), label, half, found)
    if texts.any():
        part = lambda name, k: np.ascontiguousarray(np.split(found[name], SLICES, axis=2)[k]).tobytes()
        for k in range(SLICES):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([texts.tobytes()], pa.binary()), pa.array([part("word", k)], pa.binary()), pa.array([part("gram", k)], pa.binary())], ["slice", "texts", "word", "gram"])


ODDS = "slice int, word binary, gram binary"


def _odds_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Log odds of a slice of the buckets, as (3, buckets): from the first half of the sample, the second, and both."""
    held: list = []

    def out() -> pa.RecordBatch:
        tables = []
        for counts in held[2:]:
            by = [_odds(*reversed(counts[h].sum(0)), *held[1][h].sum(0)[::-1].tolist()) for h in ([0], [1], [0, 1])]
            tables.append(pa.array([np.stack(by).tobytes()], pa.binary()))
        return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int32()), *tables], ["slice", "word", "gram"])

    for (key,), rows, first in runs(batches, ["slice"]):
        if first:
            if held:
                yield out()
            held = [key, np.zeros((2, 2), np.int64), np.zeros((2, 2, (1 << WORD_BITS) // SLICES)), np.zeros((2, 2, (1 << GRAM_BITS) // SLICES))]
        for k, kind in ((1, np.int64), (2, np.int32), (3, np.int32)):
            for x in rows.column(k):
                held[k] += np.frombuffer(x.as_buffer(), kind).reshape(held[k].shape)
    if held:
        yield out()


def tables_from(sample: DataFrame) -> list[dict[str, np.ndarray]]:
    """Log odds by bucket from the first half of the sample (text, toxic, half), the second, and both."""
    sliced = sample.select("text", "toxic", "half").mapInArrow(_count_task, COUNTED).repartition(SLICES, "slice").sortWithinPartitions("slice")
    rows = sorted(sliced.mapInArrow(_odds_task, ODDS).collect(), key=lambda r: r["slice"])  # SLICES rows of a fixed size
    whole = {n: np.concatenate([np.frombuffer(r[n], np.float32).reshape(3, -1) for r in rows], axis=1) for n in ("word", "gram")}
    return [{n: np.ascontiguousarray(t[k]) for n, t in whole.items()} for k in range(3)]


WINDOWS = "row long, place int, label int, used int, feats binary, slots binary, gram_at binary, grams binary"


def _choose(halves_at):
    """Up to FIT_WINDOWS windows of each text: those of the largest odds, which a wrong score would come from, and some others. Odds come from the other half of the texts, so that the network sees them as new texts have them; equal texts are in one half."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = halves_at.value
        for batch in batches:
            for i, j in by_bytes(batch.column(0), 1 << 17):
                rows = batch.slice(i, j - i)
                label, half = _sides(rows)
                ids = rows.column(rows.schema.get_field_index("row")).to_pylist()
                w, bucket, grams = read(rows.column(0))
                two = [features(t, w, bucket, grams) for t in (halves[1], halves[0])]
                feats = np.where(np.r_[half[np.repeat(np.arange(len(rows)), w.counts())], 0] == 0, *two)
                begin, used, text = windows(w.first)
                loud = np.concatenate([[0], np.cumsum(feats[0, :-1] + feats[1, :-1])])
                worth = loud[begin + used] - loud[begin]
                for t, n in enumerate(np.bincount(text, minlength=len(ids)).tolist()):
                    rng, mine = np.random.default_rng(abs(ids[t])), text == t
                    worth[mine] += rng.random(n) + 1e3 * (rng.random(n) < 0.3)
                order = np.lexsort((-worth, text))
                rank = np.arange(len(order)) - np.searchsorted(text, np.arange(len(ids)))[text[order]]
                chosen = order[rank < FIT_WINDOWS]
                index, word = grams[0]
                first_gram = np.searchsorted(word, np.arange(len(w) + 1))
                out = []
                for c in chosen.tolist():
                    a, b = int(begin[c]), int(begin[c] + used[c])
                    g = slice(first_gram[a], first_gram[b])
                    out.append((ids[text[c]], a, int(label[text[c]]), b - a, feats[:, a:b].tobytes(), bucket[a:b].astype(np.int32).tobytes(), (word[g] - a).astype(np.uint8).tobytes(), char_buckets(index[g]).astype(np.uint16).tobytes()))
                if out:
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in WINDOWS.split(", ")])

    return work


TRAINED = "name string, shape array<int>, data binary"


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The network, fitted to the windows of the sample, of which there are at most FIT_ROWS * FIT_WINDOWS."""
    table = pa.Table.from_batches(list(batches))
    if not table.num_rows:
        return
    used, label, row = (table.column(c).to_numpy() for c in ("used", "label", "row"))
    feats = np.zeros((3, WINDOW, len(used)), np.float32)
    slots = np.zeros((WINDOW, len(used)), np.int32)
    for k, (n, x, y) in enumerate(zip(used.tolist(), table.column("feats"), table.column("slots"), strict=True)):
        feats[:, :n, k] = np.frombuffer(x.as_buffer(), np.float32).reshape(3, n)
        slots[:n, k] = np.frombuffer(y.as_buffer(), np.int32)
    grams = [np.frombuffer(x.as_buffer(), np.uint16) for x in table.column("grams")]
    steps = [np.frombuffer(x.as_buffer(), np.uint8).astype(np.int32) for x in table.column("gram_at")]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    p = train(feats, slots, used, grams, steps, label[first], np.r_[first, len(row)])
    for name, value in p.items():
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([list(value.shape)], pa.list_(pa.int32())), pa.array([value.astype(np.float32).tobytes()], pa.binary())], ["name", "shape", "data"])


def train(feats: np.ndarray, slots: np.ndarray, used: np.ndarray, grams: list[np.ndarray], steps: list[np.ndarray], label: np.ndarray, cut: np.ndarray, seed: int = 1) -> dict:
    """Parameters by gradient descent on the worst window of each text; cut says where each text's windows begin, with the end last."""
    rng, p = np.random.default_rng(seed), initial(seed)
    dense = {k: v for k, v in p.items() if k not in ("embed", "chars")}
    adam = gru.Adam(dense, RATE)
    texts = len(label)
    total, step = EPOCHS * -(-texts // BATCH), 0
    for _ in range(EPOCHS):
        for docs in np.array_split(rng.permutation(texts), max(1, -(-texts // BATCH))):
            step += 1
            adam.rate = RATE * (1.05 - step / total)
            many = cut[docs + 1] - cut[docs]
            rows = np.concatenate([np.arange(cut[d], cut[d + 1]) for d in docs])
            valid, slot = (np.arange(WINDOW)[:, None] < used[rows]).astype(np.float32), slots[:, rows]
            gram = np.concatenate([grams[r] for r in rows]).astype(int)
            cell = np.concatenate([steps[r] * len(rows) + k for k, r in enumerate(rows.tolist())])
            chars = char_means(p["chars"], WINDOW * len(rows), gram, cell).reshape(CHARS, WINDOW, len(rows))
            x = np.concatenate([feats[:, :, rows], p["embed"][:, slot] * valid, chars]).transpose(1, 0, 2)
            kept: dict[str, list] = {"f": [], "b": []}
            logit, mid = _network(p, np.ascontiguousarray(x), valid, kept)
            start = np.cumsum(many) - many
            worst = np.array([s + int(logit[s : s + m].argmax()) for s, m in zip(start, many, strict=True)])
            d = np.zeros(len(rows), np.float32)
            d[worst] = (1 / (1 + np.exp(-logit[worst])) - label[docs]) / len(docs)
            g, d_x = _gradients(p, x, valid, kept, mid, d)
            adam.update(g)
            d_x = d_x.transpose(1, 0, 2) * valid
            per = np.maximum(np.bincount(cell, minlength=WINDOW * len(rows)), 1)
            for k in range(EMBED):
                p["embed"][k] -= 0.5 * np.bincount(slot.ravel(), d_x[3 + k].ravel(), 1 << WORD_BITS).astype(np.float32)
            for k in range(CHARS):
                p["chars"][k] -= 0.5 * np.bincount(gram, (d_x[3 + EMBED + k].ravel() / per)[cell], 1 << CHAR_BITS).astype(np.float32)
    return p


def all_features(model: dict, w: Words, bucket: np.ndarray, grams: list) -> np.ndarray:
    """(INPUTS, words + 1): what the network reads of each word; the last word is none."""
    out = np.zeros((INPUTS, len(w) + 1), np.float32)
    out[:3] = features(model, w, bucket, grams)
    out[3 : 3 + EMBED, :-1] = model["embed"][:, bucket]
    index, word = grams[0]
    out[3 + EMBED :, :-1] = char_means(model["chars"], len(w), char_buckets(index), word)
    return out


def scores(model: dict, texts: pa.Array) -> np.ndarray:
    """The score of the worst of all windows of each text."""
    w, bucket, grams = read(texts)
    feats = all_features(model, w, bucket, grams)
    begin, used, text = windows(w.first)
    out = np.full(len(texts), -np.inf)
    for i in range(0, len(begin), AT_ONCE):
        x, valid = _inputs(feats, begin[i : i + AT_ONCE], used[i : i + AT_ONCE])
        np.maximum.at(out, text[i : i + AT_ONCE], _network(model, x, valid)[0])
    return 1 / (1 + np.exp(-out))


def _score(model_at):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at.value
        for batch in batches:
            column = batch.column(2)
            for i, j in by_bytes(column, 1 << 19):
                s = scores(model, column.slice(i, j - i)) if model else np.zeros(j - i)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return work


def sampled(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """text, toxic, half, row of at most 2 * fit_rows rows to learn from: those of the first fit_rows labelled ids by hash that aren't held out."""
    rows = fold(docs.select("doc_id", "text"), 5, 0).where("not held_out and doc_id is not null")
    marks = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # the sample is drawn from ids alone; only its rows' texts move
    order = F.md5(F.col("doc_id").cast("string").cast("binary"))
    ids = marks.where(~(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)).orderBy(order, "doc_id").limit(fit_rows)
    met = rows.join(F.broadcast(ids), "doc_id").withColumn("number", F.xxhash64("doc_id", "text"))
    # ids that repeat could bring more rows than that: the first by hash stay
    last = met.select(order.alias("by"), "number").orderBy("by", "number").limit(2 * fit_rows).agg(F.max(F.struct("by", "number")).alias("last"))
    kept = met.join(F.broadcast(last), F.struct(order, F.col("number")) <= F.col("last"))
    text = F.coalesce("text", F.lit(""))
    return kept.select(text.alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic"), F.pmod(F.xxhash64(text), F.lit(2)).cast("int").alias("half"), F.col("number").alias("row"))


def fit(sample: DataFrame) -> dict | None:
    """Log odds and network from a sample (text, toxic, half, row); None without a row."""
    spark = sample.sparkSession
    held = save(sample.repartition(READERS, "row").sortWithinPartitions("row"), "toxicity-sample")
    if held.isEmpty():
        return None
    *halves, whole = tables_from(held)
    halves_at = spark.sparkContext.broadcast(halves)
    chosen = save(held.select("text", "toxic", "half", "row").mapInArrow(_choose(halves_at), WINDOWS), "toxicity-windows")
    # a fixed number of windows at most, whatever the input
    trained_ = chosen.repartition(1).sortWithinPartitions("row", "place").mapInArrow(_train_task, TRAINED).collect()
    halves_at.destroy()
    discard(held)
    discard(chosen)
    return {r["name"]: np.frombuffer(r["data"], np.float32).reshape(r["shape"]) for r in trained_} | whole


def trained(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS):
    """The model, broadcast: a fixed number of buckets whatever the input. None without a labelled row."""
    return docs.sparkSession.sparkContext.broadcast(fit(sampled(docs, labels, fit_rows)))


def score_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs.

    Learned from labelled rows that aren't held out (a doc_id with several labels is toxic if any says so). A null text
    counts as empty and is scored as one window without words. Without labelled rows all scores are 0. Rows stay as they
    are, repeated ones too; an empty table gives an empty result.
    """
    model = trained(docs, labels, fit_rows)
    ready = fold(docs.select("doc_id", "text"), 5, 0).select("doc_id", "held_out", "text")
    return ready.mapInArrow(_score(model), OUT)


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs that the model doesn't predict to be toxic, all columns unchanged.

    Each row is decided by its text alone, which is read whole: a null text counts as empty, rows that repeat go or stay
    together, a null doc_id changes nothing, and columns may have any name. Without labelled rows, or on an empty table,
    all rows stay.
    """
    model = trained(docs, labels)
    schema = docs.schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            for i, j in by_bytes(column, 1 << 19):
                keep = scores(model.value, column.slice(i, j - i)) < 0.5 if model.value else np.ones(j - i, bool)
                yield batch.slice(i, j - i).filter(pa.array(keep))

    return docs.mapInArrow(work, schema)
