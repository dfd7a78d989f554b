"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example whose context is all turns before it and whose reply alone is trainable.
Examples of one conversation share their context, so the written form keeps each text once: a row holds the piece that
its example adds, the number of characters before it, and the span under the loss mask, counted from the start of the
conversation. The text of an example is all pieces of its conversation up to its own; `examples` spells it out. The
written form grows with the conversations and not with their squares, and a conversation streams through a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import runs, scratch

# Fixed values of the template, and control strings of other templates that texts may hold.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
_CONTROL = re.compile(r"([<\[])(?=\\|\||/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\")
_TURNS = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(TEXT) + r"(.*?)" + re.escape(END), re.S)

#: Context of so many characters without a reply is written as a row of its own.
FLUSH_CHARS = 1 << 20
FORMATTED = "conv_id long, seq long, kind string, piece string, context_chars long, loss_start long, loss_end long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    """Put a backslash into each control string, and one after each < or [ that a backslash follows."""
    return _CONTROL.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in FORMATTED.split(", ")]
    kinds = [pa.string() if f.split()[1] == "string" else pa.int64() for f in FORMATTED.split(", ")]
    out: list[tuple] = []
    held: list[str] = []
    conv, size, at, seq = None, 0, 0, 0

    def put(kind: str, loss: tuple[int | None, int | None]) -> None:
        nonlocal held, size, at, seq
        out.append((conv, seq, kind, "".join(held), at, *loss))
        held, at, size, seq = [], at + size, 0, seq + 1

    for (key,), rows, first in runs(batches, ["conv_id"]):
        if first:
            if held:
                put("context", (None, None))
            conv, size, at, seq = key, 0, 0, 0
        for role, text in zip(rows.column("role").to_pylist(), rows.column("text").to_pylist(), strict=True):
            before, body = f"{TURN}{escape(role or '')}{TEXT}", escape(text or "")
            held += [before, body, END]
            start = at + size + len(before)
            size += len(before) + len(body) + len(END)
            if role == "assistant":
                put("target", (start, start + len(body)))
            elif size >= FLUSH_CHARS:
                put("context", (None, None))
        if len(out) >= 1000 or sum(len(r[3]) for r in out) > 1 << 23:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out = []
    if held:
        put("context", (None, None))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


def format_turns(conversations: DataFrame) -> DataFrame:
    """Rows conv_id, seq, kind, piece, context_chars, loss_start, loss_end: a `target` row for each assistant turn, `context` rows for turns that none follows.

    Turns go by (turn, role, text), nulls first, so repeated turns have one order. A null text or role counts as empty, a
    null conv_id is a conversation of its own. An empty table gives an empty result; other columns are ignored.
    """
    rows = conversations.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_format, FORMATTED)


def examples(formatted: DataFrame) -> DataFrame:
    """The examples with their context spelled out: conv_id, seq, text, loss_start, loss_end. Their size is quadratic in a conversation's turns."""
    until = Window.partitionBy("conv_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    text = F.array_join(F.collect_list("piece").over(until), "")
    return formatted.withColumn("text", text).where("kind = 'target'").select("conv_id", "seq", "text", "loss_start", "loss_end")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    state: dict = {}

    def close() -> None:
        if state:
            out.append((state["conv"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["at"]))

    for (conv,), rows, first in runs(batches, ["conv_id"]):
        if first:
            close()
            state = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "at": 0}
        for piece, at, start, end in zip(*(rows.column(c).to_pylist() for c in ("piece", "context_chars", "loss_start", "loss_end")), strict=True):
            if at != state["at"]:
                raise ValueError(f"conversation {conv}: a piece at {at} follows {state['at']} characters")
            state["at"] += len(piece)
            for role, text in _TURNS.findall(piece):
                state["turns"].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                state["n"] += 1
            if start is not None:
                reply = unescape(piece[start - at : end - at])
                state["loss"].update(reply.encode())
                state["chars"] += len(reply)
        if len(out) >= 10_000:
            yield _digests(out)
            out.clear()
    close()
    if out:
        yield _digests(out)


def _digests(out: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in DIGESTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == "string" else pa.int64()) for c, (_, k) in zip(zip(*out, strict=True), fields, strict=True)], [n for n, _ in fields])


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader of the written form finds in each conversation: its turns and the text under its loss masks, unescaped."""
    rows = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return rows.mapInArrow(_digest, DIGESTS)


def round_trip(conversations: DataFrame) -> DataFrame:
    """Format, write, read back, digest."""
    spark = conversations.sparkSession
    path = scratch(spark, "chat")
    format_turns(conversations).write.option("compression", "zstd").parquet(path)
    return digests(spark.read.schema(FORMATTED).parquet(path))
