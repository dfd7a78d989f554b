"""All pairs of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, by a MinHash LSH forest.

Texts of the same words are first collapsed to one representative. The forest has TREES trees; a tree labels a text with
DEPTH of its minimum hashes, 16 bits of each. Range partitioning and sorting by tree and label lay each tree's prefix trie
out in order, over many tasks; a text's longest matched prefix is the one that it shares with a neighbour in that order. A
matched prefix may be shortened to `shortest(target)` hashes, the longest at which a pair at the threshold itself meets in
some tree with the target probability; texts that match none so long have no node in that tree.

A node is worked from its leaves up: texts of one full label are compared by signature and linked; then prefixes are
shortened by a hash at a time, and only texts that aren't yet linked to each other are compared, until the node's texts are
all linked or its shortest prefix is reached. Links are a spanning forest of the node, never all its pairs. The components
of all links are clusters, and each text goes to its cluster's tasks (pairs of blocks, if the cluster is large), where
the exact similarity of all pairs is taken from their words. Links are counted there and leave as one row a text and task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import components, discard, fresh, save, whole_runs
from tidemark.llm.textnum import TABLE, Words, blocks, shingles

SHINGLE, SIMILARITY = 5, 0.8
TREES, DEPTH, SHORTEST = 32, 8, 4
HASHES = TREES * DEPTH
#: Probability with which a pair at the threshold meets in some tree. At DEPTH it is 0.9972, at one hash less 0.9995, at two less 0.99994.
TARGET = 0.9999
#: Pairs whose signatures agree in a smaller share than this aren't verified: five standard errors below the threshold.
NEAR = 0.8 - 5 * (0.8 * 0.2 / HASHES) ** 0.5
#: Texts in a block of a node or a cluster: the least and the most. Groups of more than the least are cut into up to SPREAD blocks, larger ones into more.
LEAST, BLOCK, SPREAD = 128, 2048, 16
#: Words in a block of a cluster, about.
BLOCK_WORDS = 1 << 20

SIGNED = "doc_id long, rid long, same string, words binary, sig binary"


def recall_at(similarity: float, depth: int) -> float:
    """The share of pairs of a similarity that meet in a node of a depth."""
    return 1 - (1 - similarity**depth) ** TREES


def shortest(target: float) -> int:
    """The longest prefix, of SHORTEST hashes at least, at which pairs at the threshold meet with the target probability."""
    return next((d for d in range(DEPTH, SHORTEST, -1) if recall_at(SIMILARITY, d) >= target), SHORTEST)


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 1 << 32, HASHES, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, HASHES, np.uint32)


def signatures(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """(texts, HASHES): 16 bits of the minimum hashes of each text's shingles; texts without shingles have zeros."""
    out = np.zeros((len(first) - 1, HASHES), np.uint32)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        start = first[:-1][some]
        low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
        mul, add = _seeds()
        for k in range(HASHES):
            hashed = low * mul[k]
            hashed += add[k]
            hashed ^= high
            hashed *= np.uint32(0x9E3779B1)
            out[some, k] = np.minimum.reduceat(hashed, start)
    return ((out * np.uint32(0x85EBCA6B)) >> np.uint32(16)).astype(np.uint16)


def digest(words: bytes | None) -> str | None:
    return hashlib.sha256(words).hexdigest()[:32] if words else None


def same_words(text: Column) -> Column:
    """The digest of a text's words, as signing makes it: null without words."""
    ascii_ = [chr(b) for b in range(128)]
    letters = F.translate(text, "".join(ascii_), "".join(chr(TABLE[b]) for b in range(128)))
    joined = F.trim(F.regexp_replace(letters, " +", " "))
    return F.when(joined != "", F.substring(F.sha2(joined.cast("binary"), 256), 1, 32))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, w in blocks(batches):
        values, first = shingles(w, SHINGLE)
        joined = w.joined()
        sig = [s.tobytes() for s in signatures(values, first)]
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(map(digest, joined), pa.string()), pa.array(joined, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "rid", "same", "words", "sig"])


def sign(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, same, words, sig): a number of each row, its words and a digest of them (null without words), and the signature."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), "text")
    return rows.mapInArrow(_sign, SIGNED)


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree of each text: the tree and its hashes, in an order that sorts like a trie."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            sig = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint16).reshape(-1, TREES, DEPTH)
            label = np.empty((len(sig), TREES, 1 + 2 * DEPTH), np.uint8)
            label[:, :, 0] = np.arange(TREES)
            label[:, :, 1:] = sig.astype(">u2").view(np.uint8).reshape(len(sig), TREES, 2 * DEPTH)
            width = label.shape[2]
            offsets = np.arange(len(sig) * TREES + 1, dtype=np.int32) * width
            packed = pa.Array.from_buffers(pa.binary(), len(sig) * TREES, [None, pa.py_buffer(offsets), pa.py_buffer(label.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(some.column(0)), TREES)), packed], ["rep", "label"])


def _matched(depth: int):
    """From texts in the order of a trie those that share a prefix of so many hashes with a neighbour; rest holds the hashes after it, as a number. The first and the last prefix of a task may go on in the next one, so they always count."""
    width = 1 + 2 * depth

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last row, if nothing has let it through yet
        first_prefix: bytes | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rep = np.asarray(batch.column(0)).astype(np.int64)
            label = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(rep), 1 + 2 * DEPTH)
            if held is not None:
                rep, label = np.r_[held[0], rep], np.concatenate([held[1][None], label])
            prefix = np.ascontiguousarray(label[:, :width])
            if first_prefix is None:
                first_prefix = prefix[0].tobytes()
            like = (prefix[1:] == prefix[:-1]).all(1)
            good = np.r_[held is not None and held[2], like] | np.r_[like, False]
            good |= (prefix == np.frombuffer(first_prefix, np.uint8)).all(1)
            # the last row waits for its neighbour, but may go if it matches the one before
            held = (rep[-1], label[-1].copy(), bool(good[-1]))
            yield _members(rep[:-1][good[:-1]], label[:-1][good[:-1]], depth)
        if held is not None:
            yield _members(held[:1], held[1][None], depth)

    return work


def _members(rep: np.ndarray, label: np.ndarray, depth: int) -> pa.RecordBatch:
    width = 1 + 2 * depth
    node = [int.from_bytes(hashlib.blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in label[:, :width]]
    rest = np.zeros(len(label), np.int64)
    for k in range(width, label.shape[1]):
        rest = rest << 8 | label[:, k]
    return pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(node, pa.int64()), pa.array(rest, pa.int64())], ["rep", "node", "rest"])


def blocks_of(n: Column, weight: Column | None = None) -> Column:
    """Into how many blocks a group of n rows is cut."""
    many = F.greatest(F.ceil(n / F.lit(BLOCK)), F.least(F.lit(SPREAD), F.ceil(n / F.lit(LEAST))))
    return F.greatest(many, weight) if weight is not None else many


def blocked(rows: DataFrame, many: str) -> DataFrame:
    """rows with block numbers a <= b: a group of one block has one task, a larger one a task for each pair of its blocks, and a row goes to all pairs of its own."""
    mine = F.pmod(F.xxhash64("rep"), F.col(many))
    pairs = F.transform(F.sequence(F.lit(0), F.col(many) - 1), lambda x: F.struct(F.least(mine, x).alias("a"), F.greatest(mine, x).alias("b")))
    one = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))
    return rows.withColumn("mine", mine).withColumn("pair", F.explode(F.when(F.col(many) > 1, pairs).otherwise(one))).select("*", F.col("pair.a").alias("a"), F.col("pair.b").alias("b")).drop("pair")


def _spanning(edges: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The least index that each of n rows is linked to."""
    label = np.arange(n)
    if edges:
        i, j = np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges])
        while True:
            low = np.minimum(label[i], label[j])
            new = label.copy()
            np.minimum.at(new, i, low)
            np.minimum.at(new, j, low)
            new = new[new]
            if (new == label).all():
                break
            label = new
    return label


def link_node(sketch: np.ndarray, rest: np.ndarray, levels: int) -> np.ndarray:
    """The least index that each text of a node is linked to. sketch: (texts, HASHES), a byte of each hash; rest: the last `levels` hashes of the full label, in order.

    Prefixes are shortened level by level. Texts that are linked already, and those that met at a longer prefix, aren't compared.
    """
    need = int(np.ceil(NEAR * HASHES))
    label = np.arange(len(rest))
    for cut in range(levels + 1):
        code, deeper = rest >> (16 * cut), rest >> (16 * (cut - 1)) if cut else None
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        for a, b in zip(starts.tolist(), np.r_[starts[1:], len(rest)].tolist(), strict=True):
            if b - a < 2 or (label[a:b] == label[a]).all():
                continue
            for i in range(a, b - 1):
                open_ = label[i + 1 : b] != label[i]
                if deeper is not None:
                    open_ &= deeper[i + 1 : b] != deeper[i]
                others = np.flatnonzero(open_) + i + 1
                if not len(others):
                    continue
                near = others[(sketch[others] == sketch[i]).sum(1) >= need]
                if len(near):
                    old = np.unique(np.r_[label[i], label[near]])
                    label[np.isin(label, old)] = old[0]
    return label


def _near(levels: int):
    """Links of a node's block between texts whose signatures are near, as a spanning forest."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u: list[np.ndarray] = []
        v: list[np.ndarray] = []
        for _, rows in whole_runs(batches, ["node", "a", "b"]):
            if rows.num_rows < 2:
                continue
            rep = rows.column("rep").to_numpy()
            sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(len(rep), HASHES)
            label = link_node(sig.astype(np.uint8), rows.column("rest").to_numpy(), levels)
            linked = np.flatnonzero(label != np.arange(len(rep)))
            if len(linked):
                u.append(rep[linked])
                v.append(rep[label[linked]])
            if sum(map(len, u)) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])
                u, v = [], []
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

    return work


def _dealt(rows: DataFrame, by: list[str], *then: str) -> DataFrame:
    return rows.repartition(*by).sortWithinPartitions(*by, *then)


def near_links(reps: DataFrame, target: float = TARGET) -> DataFrame:
    """Links (u, v) between representatives (rep, sig) whose signatures are near and that share a node of the forest."""
    depth = shortest(target)
    parts = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    tries = reps.select("rep", "sig").mapInArrow(_labels, "rep long, label binary").repartitionByRange(parts, "label", "rep").sortWithinPartitions("label", "rep")
    members = save(tries.mapInArrow(_matched(depth), "rep long, node long, rest long"), "forest")
    shared = save(members.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node", blocks_of(F.col("n")).alias("many")), "nodes")
    dealt = blocked(members.join(shared, "node"), "many").select("node", "a", "b", "rest", "rep").join(reps.select("rep", "sig"), "rep")
    found = save(_dealt(dealt.select("node", "a", "b", "rest", "rep", "sig"), ["node", "a", "b"], "rest").mapInArrow(_near(DEPTH - depth), "u long, v long").distinct(), "near")
    discard(members)
    discard(shared)
    return found


def numbered(words: list[bytes]) -> list[np.ndarray]:
    """The different shingles of each text as numbers that are equal for the same words and for no others."""
    raw = np.frombuffer(b" ".join(words), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(x) + 1 for x in words])])
    at[-1] = len(raw)
    w = Words(raw, at)
    values, first = shingles(w, SHINGLE)
    name = w.names().dictionary_encode().indices.to_numpy()
    _, place, number = np.unique(values, return_index=True, return_inverse=True)
    counts = w.counts()
    text = np.repeat(np.arange(len(counts)), np.diff(first))
    start = w.first[:-1][text] + np.arange(len(values)) - first[:-1][text]
    size = np.minimum(counts[text], SHINGLE)
    cells = np.full((len(values), SHINGLE), -1, name.dtype)
    for k in range(SHINGLE):
        cells[:, k] = np.where(k < size, name[np.minimum(start + k, len(name) - 1)], -1)
    if not (cells == cells[place[number]]).all():  # two different shingles have one hash
        number = np.unique(cells, axis=0, return_inverse=True)[1].ravel()
    return [np.unique(number[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def similar(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of numbers, the later ones of similarity SIMILARITY or more."""
    sizes = np.array([len(s) for s in sets])
    mark = np.zeros(max(int(s[-1]) for s in sets) + 1, np.int32)
    # sets by size: only those of at least SIMILARITY times the size can be similar
    order = np.argsort(sizes, kind="stable")
    numbers = np.concatenate([sets[i] for i in order])
    begin = np.concatenate([[0], np.cumsum(sizes[order])])
    for k, i in enumerate(order):
        end = np.searchsorted(sizes[order], sizes[i] / SIMILARITY, "right")
        if end <= k + 1:
            continue
        mark[sets[i]] = 1
        common = np.add.reduceat(mark[numbers[begin[k + 1] : begin[end]]], begin[k + 1 : end] - begin[k + 1])
        mark[sets[i]] = 0
        hit = np.flatnonzero(common >= SIMILARITY * (sizes[i] + sizes[order[k + 1 : end]] - common))
        if len(hit):
            yield int(i), order[hit + k + 1]


VERIFIED = "rep long, links long, label long"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact links of each text in its block pair, and the least text that it is linked to."""
    for (_, a, b), rows in whole_runs(batches, ["cluster", "a", "b"]):
        if rows.num_rows < 2:
            continue
        rep, copies, mine = (rows.column(c).to_numpy() for c in ("rep", "copies", "mine"))
        links, edges = np.zeros(len(rep), np.int64), []
        for i, js in similar(numbered(rows.column("words").to_pylist())):
            if a != b:  # pairs within a block belong to its own task
                js = js[mine[js] != mine[i]]
            if len(js):
                links[i] += copies[js].sum()
                links[js] += copies[i]
                edges.append((np.full(len(js), i), js))
        label = _spanning(edges, len(rep))
        some = np.flatnonzero(links)
        for k in range(0, len(some), 10_000):
            s = some[k : k + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(rep[s]), pa.array(links[s]), pa.array(rep[label[s]])], ["rep", "links", "label"])


def _classes(docs: DataFrame, target: float) -> DataFrame:
    """doc_id, same, class_no, class_id, n_links of each row of docs. Classes have a number of their own, as rows may repeat a doc_id."""
    signed = save(sign(docs), "signed")
    named = signed.where("same is not null and doc_id is not null")
    # a representative goes by the number of a row with its words, which no other row has
    reps = save(named.groupBy("same").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("sig").alias("sig")), "reps")
    links = near_links(reps, target)
    clusters = components(links, "near-star")
    first = save(clusters.select(F.col("node").alias("rep"), F.col("label").alias("cluster")).join(reps.select("rep", "copies"), "rep"), "clusters")
    texts = save(named.select(F.col("rid").alias("rep"), "words").join(first, "rep"), "clustered")
    sizes = texts.groupBy("cluster").agg(F.count("*").alias("n"), F.sum(F.octet_length("words")).alias("bytes"))
    many = save(sizes.select("cluster", blocks_of(F.col("n"), F.ceil(F.col("bytes") / (6 * BLOCK_WORDS))).alias("many")), "cluster-sizes")
    ready = blocked(texts.join(many, "cluster"), "many").select("cluster", "a", "b", "mine", "rep", "copies", "words")
    found = save(_dealt(ready, ["cluster", "a", "b"]).mapInArrow(_verify, VERIFIED), "verified")
    for old in (links, first, texts, many):
        discard(old)
    joined = components(found.select(F.col("rep").alias("u"), F.col("label").alias("v")), "class-star")
    least = save(joined.select(F.col("node").alias("rep"), "label").join(reps.select("rep", "id"), "rep"), "classes")
    class_of = least.groupBy("label").agg(F.min("id").alias("class_id"))
    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    by_words = reps.select("rep", "id", "same", "copies").join(least.select("rep", "label"), "rep", "left").join(class_of, "label", "left").join(linked, "rep", "left")
    by_words = save(by_words.select(F.col("same").alias("of"), F.coalesce("label", "rep").alias("class_no"), F.coalesce("class_id", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "by-words")
    for old in (reps, found, least):
        discard(old)
    rows = signed.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("same")).alias("same"))
    return rows.join(by_words, F.col("same") == F.col("of"), "left").select("doc_id", "same", "class_no", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def similarity_join(docs: DataFrame, target: float = TARGET) -> DataFrame:
    """doc_id, class_id, n_links of each row of docs.

    class_id is the least doc_id of the texts that links connect, and n_links the number of other rows whose similarity
    to the row is 0.8 or more. Texts of the same words are similar; a text of one to four words has one shingle, all its
    words; a text without words (null and empty ones too) has no links and is a class of its own, and so is a row
    with a null doc_id, whose class_id is null. Rows that repeat a doc_id count each. Very long texts are read whole; other
    columns are ignored. An empty table gives an empty result.
    """
    return _classes(docs, target).select("doc_id", "class_id", "n_links")


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """docs without near duplicates: one row of each class stays, all columns unchanged.

    It is the one with the least doc_id, and of rows with that doc_id the one whose words have the least digest; of rows
    that repeat both, any one. Rows without words and rows with a null doc_id are no duplicates and stay.
    """
    rows = save(_classes(docs, TARGET).select("doc_id", "same", "class_no"), "near-classes")
    # one row a class, combined before the shuffle
    best = rows.where("class_no is not null").groupBy("class_no").agg(F.min(F.struct("doc_id", "same")).alias("best"))
    id_, key, words_ = fresh(docs, "of_doc"), fresh(docs, "of_words"), fresh(docs, "its_words")
    best = save(best.select(F.col("best.doc_id").alias(id_), F.col("best.same").alias(key)), "near-best")
    repeated = save(rows.where("doc_id is not null").groupBy(F.col("doc_id").alias(id_)).agg(F.count("*").alias("n")).where("n > 1").select(id_), "repeated-ids")
    stay = best.select(id_).unionByName(rows.where("same is null and doc_id is not null").select(F.col("doc_id").alias(id_)))
    by_id = docs["doc_id"] == F.col(id_)
    if repeated.isEmpty():  # an id says which row
        return docs.join(stay, by_id, "left_semi").unionByName(docs.where("doc_id is null"))
    single = docs.join(repeated, by_id, "left_anti")
    many = docs.join(repeated, by_id, "left_semi").withColumn(words_, same_words(F.col("text")))
    kept = many.join(best, (many["doc_id"] == F.col(id_)) & (F.col(words_) == F.col(key)), "left_semi").dropDuplicates(["doc_id", words_])
    parts = [single.join(stay, single["doc_id"] == F.col(id_), "left_semi"), single.where("doc_id is null"), kept, many.where(F.col(words_).isNull())]
    out = parts[0].select(*docs.columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*docs.columns))
    return out
