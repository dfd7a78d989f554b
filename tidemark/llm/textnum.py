"""Words of many texts as numpy arrays: one pass over the bytes, no loop over words.

A word is a run of bytes other than ASCII white space and punctuation, with A-Z in lower case; bytes of 128 and more
count as letters. Its hash takes eight bytes at a time, each mixed into what came before, so that no two words of up to
eight bytes share one and longer ones do only by chance; words of more than LONG bytes are digested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_LETTER = bytes(b for b in range(256) if chr(b).isalnum() and b < 128 or b >= 128)
#: Lower case for A-Z, a blank for what isn't part of a word.
TABLE = bytes(ord(chr(b).lower()) if b < 128 and b in _LETTER else b if b >= 128 else 32 for b in range(256))
#: The same, but for ASCII punctuation, which stays.
MARKS = bytes(TABLE[b] if 32 >= b or b == 127 or TABLE[b] != 32 else b for b in range(256))
_P = 0x9E3779B97F4A7C15 | 1
#: 0 for a blank, 1 for a letter, 2 for punctuation, after MARKS.
_KINDS = np.array([0 if b == 32 else 1 if TABLE[b] != 32 else 2 for b in range(256)], np.uint8)
_POWERS: dict[str, np.ndarray] = {}
LONG = 64
#: The lowest so many bytes of a number.
_LOWEST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, 1 << 16)
        for name, base in (("p", _P), ("i", pow(_P, -1, 1 << 64))):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["p"][:n], _POWERS["i"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (null: empty) and where each text starts, with the end last."""
    column = pc.fill_null(column, "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each byte range; ranges hold no zero byte."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = end - begin
    out = mix((eight[begin] & _LOWEST[np.minimum(size, 8)]) + np.uint64(_P))
    more, at = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(more):
        part = eight[begin[more] + at] & _LOWEST[np.minimum(size[more] - at, 8)]
        out[more] = mix(out[more] * np.uint64(0xD6E8FEB86659FD93) + part)
        at += 8
        more = more[size[more] > at]
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[begin[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


class Words:
    """Words of a few texts: begin and end (bytes), hash, and first (index of each text's first word, with the end last)."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, marks: bool = False):
        """marks: runs of punctuation are words, too."""
        n = len(raw)
        self.data = np.frombuffer(raw.tobytes().translate(MARKS if marks else TABLE), np.uint8)
        kind = np.zeros(n + 2, np.uint8)
        kind[1:-1] = _KINDS[self.data] if marks else self.data != 32
        here = kind[1:-1]
        begin = (here > 0) & (here != kind[:-2])
        edges = at[1:-1][at[1:-1] < n]
        begin[edges] = here[edges] > 0
        self.begin = np.flatnonzero(begin)
        stop = (here > 0) & (here != kind[2:])
        last = edges[edges > 0] - 1
        stop[last] = here[last] > 0
        self.end = np.flatnonzero(stop) + 1
        self.first = np.searchsorted(self.begin, at)
        self.at = at
        self.sums: np.ndarray | None = None
        self.hash = word_hashes(self.data, self.begin, self.end)

    def spans(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of short byte ranges, of one length each: a polynomial of the bytes, modulo 2**64, mixed."""
        p, inverse = _powers(len(self.data) + 1)
        if self.sums is None:
            self.sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * p[:-1], out=self.sums[1:])
        return mix((self.sums[end] - self.sums[begin]) * inverse[begin])

    def joined(self) -> list[bytes | None]:
        """The words of each text with a blank between, None without words: texts have the same words if these are equal."""
        letter = self.data != 32
        ends = np.zeros(len(self.data), bool)
        ends[self.end[self.end < len(self.data)]] = True
        # a letter stays, and so does the place after a word; where a text's last word ends at its edge there is no such place
        keep = letter | ends
        kept = self.data[keep]
        at = np.concatenate([[0], np.cumsum(keep)])[self.at]
        return [t or None for t in (kept[a:b].tobytes().strip(b" ") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True))]

    def names(self) -> pa.Array:
        """The words themselves."""
        size = self.end - self.begin
        offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[self.data != 32])])

    def __len__(self) -> int:
        return len(self.begin)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 21, marks: bool = False) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Rows with the words of their whole texts, about limit bytes at a time (a longer text alone)."""
    from tidemark.llm.shared import by_bytes

    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        for i, j in by_bytes(column, limit):
            yield batch.slice(i, j - i), Words(*flat(column.slice(i, j - i)), marks)


def stretches(text: bytes, limit: int, span: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of a text, of about limit bytes and whole words, each beginning span words before the last one ends: any span words in a row lie in one. A range grows beyond limit only where so few bytes hold no more than twice span words."""
    low, begin = text.translate(TABLE), 0
    while True:
        size = limit
        while (end := low.find(b" ", begin + size)) >= 0:
            letter = np.frombuffer(low, np.uint8, end - begin, begin) != 32
            starts = np.flatnonzero(letter & ~np.r_[False, letter[:-1]])
            if not span or len(starts) > 2 * span:
                break
            size *= 2
        if end < 0:
            yield begin, len(low)
            return
        yield begin, end
        begin = begin + int(starts[len(starts) - span]) if span else end


def long_texts_cut(batches: Iterator[pa.RecordBatch], limit: int, span: int, text: str = "text") -> Iterator[tuple[pa.RecordBatch, Iterator[Words]]]:
    """Rows and their words as blocks() gives them, but a text of more than limit bytes comes alone and as stretches, one at a time."""
    from tidemark.llm.shared import by_bytes

    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        for i, j in by_bytes(column, limit):
            part = column.slice(i, j - i)
            raw = part[0].as_buffer().to_pybytes() if j == i + 1 and part[0].is_valid and part[0].as_buffer().size > limit else None
            if raw is None:
                yield batch.slice(i, j - i), iter([Words(*flat(part))])
            else:
                yield batch.slice(i, 1), (Words(np.frombuffer(raw, np.uint8, b - a, a), np.array([0, b - a])) for a, b in stretches(raw, limit, span))


def shingles(w: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each n words in a row, and where each text's start, with the end last. A text of 1 to n-1 words has one shingle, all its words."""
    counts = w.counts()
    many = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    first = np.concatenate([[0], np.cumsum(many)])
    if not first[-1]:
        return np.zeros(0, np.uint64), first
    text = np.repeat(np.arange(len(counts)), many)
    start = w.first[:-1][text] + np.arange(first[-1]) - first[:-1][text]
    length = np.minimum(counts[text], n)
    out = np.zeros(first[-1], np.uint64)
    for k in range(n):
        use = k < length
        out[use] = out[use] * np.uint64(0xD6E8FEB86659FD93) + w.hash[start[use] + k] + np.uint64(k + 1)
    return mix(out), first
