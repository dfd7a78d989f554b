"""Token ids in Arrow stream files of fixed-size lists.

Documents in ascending doc_id order are encoded, each with an end id, and packed into sequences of one length. A file
is one Arrow stream; all its batches but the last have the same number of sequences, and each sequence has its ids and
a mask (1: a token, 0: filling after the last), both fixed-size lists without nulls. Any sequence is therefore found by
arithmetic and read without a copy. The stream's schema holds the documents: their ids and lengths, and the number of
tokens before the file within its part, a range of doc_id. Spark's text writer puts the files on any file system, one
row a file, and its line end after the end mark of the stream, which readers don't look at.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import by_bytes, save, scratch

LENGTH = 2048
ROWS = 64
#: A file is closed at the document that brings it to so many tokens.
FILE_TOKENS = 1 << 22
END_ID = 2
READ = "doc_id long, part int, start_in_part long, n_tokens long, ids_crc32 long"
#: Words whose ids the library keeps in a worker, some 700 bytes each.
CACHED_WORDS = 1 << 18
# What word_bpe_49k.json does to a text before its model: compose, white space to one space, lower case; cut; bytes as letters.
_STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
# Its model: nothing is left to chance, and words end by a symbol of their own.
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
# Characters other than ASCII, and letters that are composed already and become lower case each by itself.
_ODD = re.compile("[^\t\n\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]")
# ByteLevel's letter of each byte of such a text, and that of a word's last byte: the model has symbols of its own for those ("e</w>"), here each is one character.
_LAST = 0x200
_LETTERS = np.arange(256, dtype="<u2")
_LETTERS[[*range(0x80, 0xA1), 0xAD]] = range(0x122, 0x144)
_LETTERS = np.concatenate([_LETTERS, _LETTERS + np.uint16(_LAST)]).astype("<u2")
# A byte is white space, of a letter, a digit or of another character.
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[[*b"\t\n\r "]] = _SPACE
_KINDS[[*b"abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]] = _LETTER
_KINDS[[*b"0123456789"]] = _DIGIT
# The library's merges of n letters take n log n steps, and memory at random; so they are of a piece of about so many bytes.
_PIECE = 1 << 16

_TOKENIZERS: dict[str, tuple] = {}


def _with_last_letters(model: dict) -> tuple[dict[str, int], list[tuple[str, str]]] | None:
    """Vocabulary and merges of a BPE model with each last letter of a word as one character; None if the model isn't one in which such letters alone keep words apart."""
    if {k: v for k, v in model.items() if k not in ("vocab", "merges")} != _MODEL:
        return None
    vocab = model["vocab"]
    letters = {w for w in vocab if len(w) == 1}
    if not {chr(c) for c in _LETTERS[[*range(0x21, 0x7F), *range(0x80, 0x100)]]} <= letters or max(letters) >= chr(_LAST) or not {f"{c}</w>" for c in letters} <= vocab.keys():
        return None
    names = {c: c for c in letters} | {f"{c}</w>": chr(ord(c) + _LAST) for c in letters}
    merges = []
    for left, right in model["merges"]:
        if not {left, right} <= names.keys() or names[left][-1] >= chr(_LAST):
            return None
        merges.append((names[left], names[right]))
        both = names[left] + names[right]
        if names.setdefault(left + right, both) != both:
            return None
    return {names[w]: i for w, i in vocab.items() if w in names}, merges


def _tokenizers(tokenizer_file: str) -> tuple:
    """The tokenizer of a file; its model alone, for texts from _marked, where the file takes the steps known here; its added tokens in lower case. A worker loads them once."""
    if tokenizer_file not in _TOKENIZERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        whole, plain = Tokenizer.from_file(tokenizer_file), None
        whole.model._resize_cache(CACHED_WORDS)
        with open(tokenizer_file, encoding="utf-8") as f:
            spec = json.load(f)
        if (spec["normalizer"], spec["pre_tokenizer"]) == _STEPS and (model := _with_last_letters(spec["model"])):
            plain = Tokenizer(models.BPE(*model))
            plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        _TOKENIZERS[tokenizer_file] = whole, plain, [t["content"].lower() for t in spec["added_tokens"]]
    return _TOKENIZERS[tokenizer_file]


def _prepared(text: str, added: list[str]) -> bytes | None:
    """The text in lower case; None if it has an added token or a character for which only the library's own steps are sure."""
    if _ODD.search(text):
        return None
    low = text.lower()
    return None if any(t in low for t in added) else low.encode()


def _marked(texts: list[bytes]) -> list[str]:
    """Texts from _prepared, each byte as its letter, or as another one where it ends a word: the file's cut. White space goes, but for a character in each piece of a batch, where the library cuts long texts."""
    data = np.frombuffer(b" ".join([b"", *texts, b" "]), np.uint8)
    kinds = _KINDS[data]
    last = np.append(kinds[:-1] != kinds[1:], True) | (kinds == _DIGIT)
    # 's, 't, 'm, 'd, 're, 've and 'll are words, but for a ' within other characters
    at = np.flatnonzero(data == ord("'"))
    at = at[kinds[at - 1] != _OTHER]
    first, second = data[at + 1], data[at + 2]
    short = np.isin(first, [*b"stmd"])
    long = np.isin(first, [*b"rv"]) & (second == ord("e")) | (first == ord("l")) & (second == ord("l"))
    last[at[short | long]] = False
    last[at[short] + 1] = True
    last[at[long] + 2] = True
    kept = kinds != _SPACE
    spaces = np.flatnonzero(~kept)
    spaces = spaces[1:][np.diff(spaces // _PIECE) > 0]
    kept[spaces], last[spaces] = True, False
    letters = _LETTERS[data[kept] + last[kept] * np.uint16(256)].tobytes().decode("utf-16-le")
    ends = np.cumsum(kept)[np.cumsum([len(t) + 1 for t in texts])].tolist()
    return [letters[i:j] for i, j in zip([0, *ends], ends, strict=False)]


def encode(tokenizer_file: str, texts: list[str], dtype: str) -> list[bytes]:
    """Ids of whole texts by the tokenizers library, without special tokens.

    For each word the library makes a string of its own, with the place of each byte, and looks it up; that takes longer than
    the model's merges. Nothing is merged past a word's last letter, which is another symbol than the same letter within.
    So whole texts of ASCII and Latin letters come to the library in lower case with those letters marked, and it merges each
    text as one; the steps that are left out don't change such a text further. All others take the steps of the file.
    """
    whole, plain, added = _tokenizers(tokenizer_file)
    ready = [plain and _prepared(t, added) for t in texts]
    found: list[bytes] = [b""] * len(texts)
    for tokenizer, at in ((whole, [i for i, r in enumerate(ready) if r is None]), (plain, [i for i, r in enumerate(ready) if r is not None])):
        if at:
            given = [texts[i] for i in at] if tokenizer is whole else _marked([ready[i] for i in at])
            for i, e in zip(at, tokenizer.encode_batch_fast(given, add_special_tokens=False), strict=True):
                found[i] = np.array(e.ids, dtype).tobytes()
    return found


def stream_file(ids: bytes, dtype: str, meta: dict, length: int = LENGTH, rows: int = ROWS) -> bytes:
    """An Arrow stream of sequences of one length, with their masks."""
    flat = np.frombuffer(ids, dtype)
    n = -(-len(flat) // length)
    packed = np.zeros(n * length, flat.dtype)
    packed[: len(flat)] = flat
    mask = np.packbits(np.arange(n * length) < len(flat), bitorder="little")
    kind = pa.from_numpy_dtype(flat.dtype)
    schema = pa.schema([pa.field("ids", pa.list_(kind, length), False), pa.field("mask", pa.list_(pa.bool_(), length), False)], {k: v if isinstance(v, bytes) else json.dumps(v).encode() for k, v in meta.items()})
    tokens = pa.FixedSizeListArray.from_arrays(pa.array(packed, kind), length)
    masks = pa.FixedSizeListArray.from_arrays(pa.Array.from_buffers(pa.bool_(), n * length, [None, pa.py_buffer(mask)]), length)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_table(pa.Table.from_arrays([tokens, masks], schema=schema), max_chunksize=rows)
    return sink.getvalue().to_pybytes()


def _write(tokenizer_file: str, dtype: str, end_id: int, length: int, file_tokens: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], dtype).tobytes()
        part, before = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        docs: list[int | None] = []
        lengths: list[int] = []

        def file() -> pa.RecordBatch:
            nonlocal before, held, docs, lengths
            meta = {"part": part, "start_in_part": before, "dtype": dtype, "length": length, "null_ids": [i for i, d in enumerate(docs) if d is None]}
            meta["doc_ids"] = base64.b64encode(np.array([d or 0 for d in docs], "<i8").tobytes())
            meta["n_tokens"] = base64.b64encode(np.array(lengths, "<i8").tobytes())
            content = stream_file(b"".join(held), dtype, meta, length)
            before += sum(lengths)
            held, docs, lengths = [], [], []
            return pa.RecordBatch.from_arrays([pa.array([content], pa.binary())], ["content"])

        total = 0
        for batch in batches:
            column = batch.column(1)
            for i, j in by_bytes(column, 1 << 20):
                texts = [t or "" for t in column.slice(i, j - i).to_pylist()]
                for doc, ids in zip(batch.column(0).slice(i, j - i).to_pylist(), encode(tokenizer_file, texts, dtype), strict=True):
                    held += [ids, end]
                    docs.append(doc)
                    lengths.append((len(ids) + len(end)) // len(end))
                    total += lengths[-1]
                    if total >= file_tokens:
                        yield file()
                        total = 0
        if docs:
            yield file()

    return work


def write_token_files(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, length: int = LENGTH, file_tokens: int = FILE_TOKENS, parts: int | None = None) -> None:
    """Write (doc_id, text) under path; other columns are ignored.

    Null and empty texts are the end id alone; a null doc_id comes first; rows that repeat a doc_id go by a hash of the text. A very long
    text is one document of one file. An empty table writes no sequences.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    dtype = "<u2" if Tokenizer.from_file(tokenizer_file).get_vocab_size() <= 1 << 16 else "<u4"
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    # a doc_id that many rows repeat, or lack, is dealt out over tasks as well
    dealt = docs.select("doc_id", "text", F.xxhash64("text").alias("tie")).repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    files = dealt.mapInArrow(_write(tokenizer_file, dtype, end_id, length, file_tokens), "content binary")
    files.select(F.col("content").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)


def sequences(content: bytes | pa.Buffer) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, mask bits) of each sequence of a file; the ids are views of the file's bytes."""
    for batch in pa.ipc.open_stream(content):
        ids, mask = batch.column("ids"), batch.column("mask")
        length = ids.type.list_size
        flat = ids.flatten().to_numpy(zero_copy_only=True).reshape(-1, length)
        bits = np.asarray(mask.flatten().to_numpy(zero_copy_only=False)).reshape(-1, length)
        yield from zip(flat, bits, strict=True)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            buffer = content.as_buffer()
            if buffer.size < 9:  # the line end of a task without files
                continue
            reader = pa.ipc.open_stream(buffer)
            meta = reader.schema.metadata
            docs, lengths = (np.frombuffer(base64.b64decode(meta[k]), "<i8") for k in (b"doc_ids", b"n_tokens"))
            length = json.loads(meta[b"length"])
            views = [(b.column(0).flatten().to_numpy(zero_copy_only=True), b.column(1).flatten()) for b in reader]
            ids = np.concatenate([v for v, _ in views]) if views else np.zeros(0, np.uint16)
            used = sum(m.true_count for _, m in views)
            if used != lengths.sum() or len(ids) % length:
                raise ValueError("the masks of a file don't add up to its documents")
            wide = ids.astype("<u4")
            ends = np.cumsum(lengths)
            crc = [zlib.crc32(wide[e - n : e].tobytes()) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            null = np.zeros(len(docs), bool)
            null[json.loads(meta[b"null_ids"])] = True
            starts = json.loads(meta[b"start_in_part"]) + ends - lengths
            part = np.full(len(docs), json.loads(meta[b"part"]), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=null), pa.array(part), pa.array(starts), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "part", "start_in_part", "n_tokens", "ids_crc32"])


def read_documents(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the files. Parts, of which there are as many as tasks wrote, give each other's starts. A null doc_id is read as null; a folder without sequences gives an empty result."""
    files = spark.read.format("binaryFile").load(path).select("content")
    found = save(files.mapInArrow(_read, READ), "tokens")
    sizes = found.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return found.join(F.broadcast(starts), "part").select("doc_id", (F.col("before") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Write docs and read the files back; nulls, repeats, other columns and empty tables as in write_token_files."""
    path = scratch(docs.sparkSession, "token-files")
    write_token_files(docs, path, tokenizer_file)
    return read_documents(docs.sparkSession, path)
