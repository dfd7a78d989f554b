"""Benchmark decontamination by latent semantic retrieval.

1. Fit: all texts are cut into passages of PASSAGE words with TF-IDF weights over hashed terms. A randomised
   factorisation of the passages' Gram matrix needs one pass: each task adds up document frequencies and the product of
   its part with a random test matrix, both of fixed size, and the driver finishes a Nystroem decomposition of the sum.
2. Search: overlapping windows of all texts and of all benchmark items are projected to the leading factors; pairs of high
   cosine are candidates. Where a window dilutes or cuts an item its cosine is low, so there is an exact way as well: a text
   that lacks no more than m of an item's n words has KEYS at least of its m + KEYS rarest different ones, and each place
   where so many of them are close together is a candidate too.
3. Check: a candidate is a leak if, within a stretch of at most SPREAD times the item's words, the longest common subsequence
   of words covers most of the item, or a good part of it and the answer is there as well. The answer is the last ANSWER
   words of the item, as the table has no column for it. No stretch that this accepts is lost by the search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import runs
from tidemark.llm.textnum import Words, flat, long_texts_cut

PASSAGE = 24
STEP = PASSAGE // 2
#: Windows of an item begin at every so many words.
ITEM_STEP = 6
TERM_BITS = 13
FACTORS, TESTS = 48, 64
COSINE = 0.4
#: Bits of a set of terms.
SET_BITS = 2048
#: An item may be spread over so many times its own words.
SPREAD = 3
#: Leak at so large a part of the item in order, or at a smaller one if the answer is there.
COVERED, PARAPHRASED = 0.65, 0.55
ANSWER = 5
#: Different rare words of an item that must be close together in a text, by the exact way.
KEYS = 3
#: Bytes of items searched for at once, and so the most that is broadcast; more take another pass over the texts.
ITEM_BYTES = 8 << 20
#: Cosines computed at once.
AT_ONCE = 1 << 22
SLICES = 64
#: Bytes of text and passages of a term that are summed at once.
CHUNK, EIGHT = 1 << 19, 8
TERMS = 1 << TERM_BITS
FOUND = "doc_id long, item_id long, cosine double, covered double, answer boolean"


def _terms(w: Words) -> np.ndarray:
    return (w.hash >> np.uint64(64 - TERM_BITS)).astype(np.uint16)


def _test_matrix() -> np.ndarray:
    return np.random.default_rng(6).standard_normal((TERMS, TESTS)).astype(np.float32)


def _passages(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text cut into runs of size words: the first word of each, its text, and the run of each word."""
    counts = w.counts()
    many = -(-counts // size)
    text = np.repeat(np.arange(len(counts)), many)
    start = w.first[:-1][text] + (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)) * size
    of_word = np.cumsum(np.bincount(start, minlength=len(w)))[: len(w)] - 1
    return start, text, of_word


def _run_sums(table: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Sums of table's rows over the second axis of index, one column at a time: the sums stay in cache."""
    out = np.take(table, index[:, 0], axis=0)
    one = np.empty_like(out)
    for k in range(1, index.shape[1]):
        out += np.take(table, index[:, k], axis=0, out=one, mode="clip")
    return out


def _with_none(table: np.ndarray) -> np.ndarray:
    """A row of zeros last, for the places of a run that hold no word."""
    return np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])


def _term_runs(term: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """(runs, size): the terms from start to end, filled up with the number after the last term."""
    index = start[:, None] + np.arange(size)
    return np.where(index < end[:, None], term[np.minimum(index, len(term) - 1)].astype(np.int64), TERMS)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tests = _with_none(_test_matrix())
    product, frequency, total = np.zeros((TERMS, TESTS), np.float64), np.zeros(TERMS, np.int64), 0
    for w in (w for _, parts in long_texts_cut(batches, CHUNK, 0) for w in parts):
        if not len(w):
            continue
        term = _terms(w)
        start, text, of_word = _passages(w, PASSAGE)
        sums = _with_none(_run_sums(tests, _term_runs(term, start, np.minimum(start + PASSAGE, w.first[1:][text]), PASSAGE)))
        order = np.argsort(term, kind="stable")
        sorted_term, passage = term[order], of_word[order]
        # the passages of each term, in rows of EIGHT
        begin = np.flatnonzero(np.r_[True, sorted_term[1:] != sorted_term[:-1]])
        many = np.diff(np.r_[begin, len(term)])
        rows = -(-many // EIGHT)
        row = np.repeat(np.cumsum(rows) - rows, many) * EIGHT + np.arange(len(term)) - np.repeat(begin, many)
        index = np.full(rows.sum() * EIGHT, len(sums) - 1)
        index[row] = passage
        product[sorted_term[begin]] += np.add.reduceat(_run_sums(sums, index.reshape(-1, EIGHT)), np.cumsum(rows) - rows, axis=0)
        new = np.r_[True, (sorted_term[1:] != sorted_term[:-1]) | (passage[1:] != passage[:-1])]
        frequency += np.bincount(sorted_term[new], minlength=TERMS)
        total += len(start)
    if total:
        rows = TERMS // SLICES
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(range(SLICES), pa.int32()),
                pa.array([total] * SLICES, pa.int64()),
                pa.array([frequency[i * rows : (i + 1) * rows].tobytes() for i in range(SLICES)], pa.binary()),
                pa.array([product[i * rows : (i + 1) * rows].tobytes() for i in range(SLICES)], pa.binary()),
            ],
            ["slice", "total", "frequency", "product"],
        )


GATHERED = "slice int, total long, frequency binary, product binary"


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list = []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([held[0]], pa.int32()), pa.array([held[1]], pa.int64()), pa.array([held[2].tobytes()], pa.binary()), pa.array([held[3].tobytes()], pa.binary())], ["slice", "total", "frequency", "product"])

    for (key,), rows, first in runs(batches, ["slice"]):
        if first:
            if held:
                yield out()
            held = [key, 0, np.zeros(TERMS // SLICES, np.int64), np.zeros(TERMS // SLICES * TESTS)]
        held[1] += sum(rows.column(1).to_pylist())
        for f, p in zip(rows.column(2), rows.column(3), strict=True):
            held[2] += np.frombuffer(f.as_buffer(), np.int64)
            held[3] += np.frombuffer(p.as_buffer(), np.float64)
    if held:
        yield out()


def fit(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(TERMS, FACTORS): TF-IDF weight times factor of each term, from all passages of all texts; and the passages with each term. Null and empty texts have none, repeated rows count each, an empty table gives zeros."""
    parts = docs.select("text").mapInArrow(_gather, GATHERED).repartition(SLICES, "slice").sortWithinPartitions("slice").mapInArrow(_add_up, GATHERED)
    rows = sorted(parts.collect(), key=lambda r: r["slice"])  # SLICES rows of a fixed size
    if not rows:
        return np.zeros((TERMS, FACTORS), np.float32), np.zeros(TERMS, np.int64)
    frequency = np.concatenate([np.frombuffer(r["frequency"], np.int64) for r in rows])
    product = np.concatenate([np.frombuffer(r["product"], np.float64) for r in rows]).reshape(TERMS, TESTS)
    return factors(frequency, product, rows[0]["total"]), frequency


def factors(frequency: np.ndarray, product: np.ndarray, total: int) -> np.ndarray:
    """product is G Omega, G the Gram matrix of raw counts. With W the diagonal of inverse document frequencies, C = W G W times the test matrix W^-1 Omega is W product, which Nystroem's method needs and nothing else."""
    idf = np.log((total + 1) / (frequency + 0.5)).clip(0.05)
    tests = _test_matrix() / idf[:, None]
    sketch = idf[:, None] * product
    shift = 1e-9 * np.linalg.norm(sketch) + 1e-12
    sketch = sketch + shift * tests
    core = tests.T @ sketch
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    good = values > values.max() * 1e-9
    root = vectors[:, good] / np.sqrt(values[good])
    left, strength, _ = np.linalg.svd(sketch @ root, full_matrices=False)
    left, strength = left[:, :FACTORS], strength[:FACTORS]
    scaled = idf[:, None] * left / (strength + 1e-12)
    out = np.zeros((TERMS, FACTORS), np.float32)
    out[:, : scaled.shape[1]] = scaled
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _bits(runs_: np.ndarray) -> np.ndarray:
    """(runs, SET_BITS / 64): the bits that the terms of each run set."""
    out = np.zeros((len(runs_), SET_BITS), bool)
    row, place = np.nonzero(runs_ < TERMS)
    out[row, runs_[row, place] % SET_BITS] = True
    return np.packbits(out, axis=1).view(np.uint64)


class RunBits:
    """Bits of ranges of runs, each from two ranges of a power of two: a range costs the same however long it is."""

    def __init__(self, bits: np.ndarray, longest: int):
        self.tables = [bits]
        while 2 ** len(self.tables) <= longest:
            last, step = self.tables[-1], 2 ** (len(self.tables) - 1)
            wider = last.copy()
            if len(last) > step:
                wider[:-step] |= last[step:]
            self.tables.append(wider)

    def enough(self, begin: np.ndarray, end: np.ndarray, of: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Which ranges have so many of the bits of `of`."""
        out = np.zeros(len(begin), bool)
        level = np.log2(end - begin).astype(int)
        for k in np.unique(level).tolist():
            rows = np.flatnonzero(level == k)
            for i in range(0, len(rows), 4096):
                r = rows[i : i + 4096]
                inside = (self.tables[k][begin[r]] | self.tables[k][end[r] - 2**k]) & of[r]
                out[r] = np.bitwise_count(inside).sum(1) >= need[r]
        return out


class Items:
    """Benchmark items as arrays: windows with their factors, words, and rare words. How rare decides what a search costs, not what it finds."""

    def __init__(self, ids: list, texts: list[str], table: np.ndarray, frequency: np.ndarray):
        w = Words(*flat(pa.array(texts, pa.string())))
        term = _terms(w)
        self.ids = ids
        self.words = [w.hash[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
        self.answers = [self._answer(t) for t in texts]
        begin, end, item = [], [], []
        for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
            if b > a:
                last = max(a, b - PASSAGE)
                for s in [*range(a, last, ITEM_STEP), last]:
                    begin.append(s)
                    end.append(min(b, s + PASSAGE))
                    item.append(i)
        self.item = np.array(item, int)
        sums = np.concatenate([np.zeros((1, FACTORS)), np.cumsum(table[term].astype(np.float64), axis=0)])
        self.vectors = _unit((sums[end] - sums[begin]).astype(np.float32)) if item else np.zeros((0, FACTORS), np.float32)
        self.least = [next((k for k in range(1, len(x)) if k / len(x) >= PARAPHRASED), len(x)) for x in self.words]
        self.span = np.array([SPREAD * len(x) for x in self.words], int)
        # a region with enough words of an item has so many of the bits that all its words set
        ends = [(a, b) for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
        sets = [_bits(term[None, a:b].astype(np.int64))[0] if b > a else np.zeros(SET_BITS // 64, np.uint64) for a, b in ends]
        self.bits = np.array(sets, np.uint64).reshape(len(ends), SET_BITS // 64)
        self.need = np.array([k - len(x) for k, x in zip(self.least, self.words, strict=True)], int) + np.bitwise_count(self.bits).sum(1).astype(int)
        #: Runs before and after a window that the region around it reaches.
        self.reach = np.array([-(-len(x) // STEP) for x in self.words], int)
        self.bags = [np.unique(x, return_counts=True) for x in self.words]
        # repeated words may be all that a text has: then one word of any is enough
        self.keys = np.array([max(1, min(KEYS, len(bag) - len(x) + m)) for x, (bag, _), m in zip(self.words, self.bags, self.least, strict=True)], int)
        pairs = []
        for i, (x, a) in enumerate(zip(self.words, w.first.tolist(), strict=False)):
            rarest = dict.fromkeys(x[np.argsort(frequency[term[a : a + len(x)]], kind="stable")].tolist())
            most = len(x) - self.least[i] + int(self.keys[i])
            pairs += [(y, i) for y in list(rarest)[:most]]
        pairs.sort()
        self.key, self.key_at = np.unique(np.array([x for x, _ in pairs], np.uint64), return_index=True)
        self.key_at = np.r_[self.key_at, len(pairs)]
        self.owner = np.array([i for _, i in pairs], int)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.key >> np.uint64(48)] = True

    @staticmethod
    def _answer(text: str) -> np.ndarray:
        return Words(*flat(pa.array([text], pa.string()))).hash[-ANSWER:]


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with the bits of one number as a row of the table."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        if hit := places.get(x):
            both = row & hit
            row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def _within(part: np.ndarray, whole: np.ndarray) -> bool:
    """Whether the words of part follow each other in whole."""
    return len(part) > 0 and len(whole) >= len(part) and bool((np.lib.stride_tricks.sliding_window_view(whole, len(part)) == part).all(1).any())


def close_keys(items: Items, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """text, item, low and high of candidates: neighbouring blocks of span words that have enough rare words of an item together; each stretch of span words lies within two such blocks."""
    at = np.flatnonzero(items.maybe[w.hash >> np.uint64(48)])
    place = np.searchsorted(items.key, w.hash[at])
    right = items.key[np.minimum(place, len(items.key) - 1)] == w.hash[at]
    at, place = at[right], place[right]
    many = items.key_at[place + 1] - items.key_at[place]
    item = items.owner[np.repeat(items.key_at[place] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
    at, place = np.repeat(at, many), np.repeat(place, many)
    first = w.first[np.searchsorted(w.first, at, "right") - 1]
    span = items.span[item]
    begin = at - (at - first) % span
    before = begin > first
    group = np.r_[item * len(w) + begin, (item * len(w) + begin - span)[before]]
    different = np.unique(group * len(items.key) + np.r_[place, place[before]]) // len(items.key)
    group, count = np.unique(different, return_counts=True)
    item, begin = np.divmod(group, len(w))
    good = count >= items.keys[item]
    item, begin = item[good], begin[good]
    text = np.searchsorted(w.first, begin, "right") - 1
    high = np.minimum(w.first[text + 1], begin + 2 * items.span[item])
    return text, item, begin, high


def search(items: Items, table: np.ndarray, w: Words) -> Iterator[tuple[int, int, float, float, bool]]:
    """(text, item, cosine, covered, answer) of each leak in a few texts. table has a row of zeros last."""
    if not len(w) or not len(items.item):
        return
    start, text, _ = _passages(w, STEP)
    terms = _term_runs(_terms(w), start, np.minimum(start + STEP, w.first[1:][text]), STEP)
    part, run_bits = _run_sums(table, terms), _bits(terms)
    follows = np.r_[text[1:] == text[:-1], False]
    # a window is a run and the next one; a text's last run is a window of its own only if it is its first as well
    first = np.r_[True, text[1:] != text[:-1]]
    window = np.flatnonzero(follows | first)
    vectors = part[window]
    vectors[follows[window]] += part[window[follows[window]] + 1]
    vectors = _unit(vectors)
    best: dict[tuple[int, int], list[tuple[int, int]]] = {}
    first_run = np.searchsorted(text, np.arange(len(w.first)))
    ranges = RunBits(run_bits, 2 * int(items.span.max()) // STEP + 2)
    rows = max(1, AT_ONCE // len(items.item))
    for i in range(0, len(window), rows):
        hit = np.flatnonzero((vectors[i : i + rows] @ items.vectors.T).ravel() >= COSINE)
        at, query = np.divmod(hit, len(items.item))
        at, item = window[at + i], items.item[query]
        # a window and as many words before and after it as the item has
        begin = np.maximum(first_run[text[at]], at - items.reach[item])
        end = np.minimum(first_run[text[at] + 1], at + 2 + items.reach[item])
        for k in np.flatnonzero(ranges.enough(begin, end, items.bits[item], items.need[item])).tolist():
            doc, which, p = int(text[at[k]]), int(item[k]), int(start[at[k]])
            n = len(items.words[which])
            best.setdefault((doc, which), []).append((max(int(w.first[doc]), p - n), min(int(w.first[doc + 1]), p + PASSAGE + n)))
    of_text, of_item, low, high = close_keys(items, w)
    begin = first_run[of_text] + (low - w.first[of_text]) // STEP
    end = first_run[of_text] + (high - 1 - w.first[of_text]) // STEP + 1
    for k in np.flatnonzero(ranges.enough(begin, end, items.bits[of_item], items.need[of_item])).tolist():
        best.setdefault((int(of_text[k]), int(of_item[k])), []).append((int(low[k]), int(high[k])))
    for (doc, which), places in best.items():
        covered, answer, done = 0.0, False, -1
        for low, high in sorted(set(places)):
            if high > done:
                done = high
                # of the stretches that are leaks, each by itself, the one with the most of the item
                covered, answer = max((covered, answer), region_leaks(items, which, w.hash[low:high]))
        if covered:
            near = (text[window] == doc) & (start[window] < max(high for _, high in places)) & (start[window] + PASSAGE > min(low for low, _ in places))
            yield doc, which, float((vectors[near] @ items.vectors[items.item == which].T).max()), covered, answer


def region_leaks(items: Items, which: int, region: np.ndarray) -> tuple[float, bool]:
    """(covered, answer) of the stretch of a region that is most of a leak; (0, False) if none is one."""
    words, (bag, times), span = items.words[which], items.bags[which], int(items.span[which])
    place = np.minimum(np.searchsorted(bag, region), len(bag) - 1)
    at = np.flatnonzero(bag[place] == region)
    # no more words can be in order than there are
    if np.minimum(np.bincount(place[at], minlength=len(bag)), times).sum() < items.least[which]:
        return 0.0, False
    if common_subsequence(words, region[at]) / len(words) < PARAPHRASED:
        return 0.0, False
    best = (0.0, False)
    last = -1
    for k, begin in enumerate(at.tolist()):
        end = int(np.searchsorted(at, begin + span))
        if end == last:  # the stretch before has all that this one has
            continue
        last = end
        share = common_subsequence(words, region[at[k:end]]) / len(words)
        if share >= PARAPHRASED:
            whole = _within(items.answers[which], region[begin : begin + span])
            if share >= COVERED or whole:
                best = max(best, (share, whole))
    return best


def search_rows(items: Items, table: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, float, float, bool]]]]:
    """Rows, and what search() finds in them. A text of more than CHUNK bytes is searched stretch by stretch; any place that may hold an item lies in one."""
    span = int(items.span.max()) if len(items.span) else 0
    for rows, parts in long_texts_cut(batches, CHUNK, span):
        best: dict[tuple[int, int], tuple[float, bool, float]] = {}
        for w in parts:
            for doc, which, cosine, covered, answer in search(items, table, w):
                old = best.get((doc, which), (0.0, False, -1.0))
                best[doc, which] = (*max(old[:2], (covered, answer)), max(old[2], cosine))
        yield rows, [(doc, which, cosine, covered, answer) for (doc, which), (covered, answer, cosine) in best.items()]


def _search(table_at, items_at):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, items = _with_none(table_at.value), items_at.value
        for rows, found in search_rows(items, table, batches):
            if found:
                ids = rows.column(0).to_pylist()
                doc, item, cosine, covered, answer = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d in doc], pa.int64()), pa.array([items.ids[i] for i in item], pa.int64()), pa.array(cosine, pa.float64()), pa.array(covered, pa.float64()), pa.array(answer, pa.bool_())], ["doc_id", "item_id", "cosine", "covered", "answer"])

    return work


def _item_groups(docs: DataFrame, benchmark: DataFrame) -> list:
    """Broadcasts of the factors and of the items, ITEM_BYTES of their texts in each."""
    spark = docs.sparkSession
    table, frequency = fit(docs)
    table_at = spark.sparkContext.broadcast(table)
    named = benchmark.where("text is not null").select("item_id", "text")
    size = named.agg(F.coalesce(F.sum(F.octet_length("text") + 8), F.lit(0))).first()[0]
    groups, out = max(1, -(-size // ITEM_BYTES)), []
    for k in range(groups):
        some = named.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == k).orderBy("item_id", "text").collect()
        out.append((table_at, spark.sparkContext.broadcast(Items([r.item_id for r in some], [r.text for r in some], table, frequency))))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, cosine, covered, answer: a row for each row of docs and row of benchmark that it leaks.

    Null and empty texts and items, and those without words, leak nothing; an item of less than PASSAGE words has one
    window. Rows that repeat a doc_id, and benchmark rows that repeat an item, are reported each; a null doc_id or item_id
    is reported as null; other columns are ignored. A very long text is searched in overlapping stretches of CHUNK bytes, and its
    passages begin anew in each. Of a text's stretches that leak an item, the one with the most of it is
    reported. Empty tables give an empty result.
    """
    rows, out = docs.select("doc_id", "text"), None
    for table_at, items_at in _item_groups(docs, benchmark):
        found = rows.mapInArrow(_search(table_at, items_at), FOUND)
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of docs that leak no item, all columns unchanged.

    Each row is decided by its text alone, so rows that repeat a doc_id, or have none, go or stay each by itself. Null and
    empty texts stay, and all rows if there are no items; very long texts are searched in stretches; columns may have any
    name. An empty table gives an empty result.
    """

    def clean(table_at, items_at):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table, items = _with_none(table_at.value), items_at.value
            for rows, found in search_rows(items, table, batches):
                keep = np.ones(rows.num_rows, bool)
                keep[[d for d, *_ in found]] = False
                yield rows.filter(pa.array(keep))

        return work

    for table_at, items_at in _item_groups(docs, benchmark):
        docs = docs.mapInArrow(clean(table_at, items_at), docs.schema)
    return docs
