"""Chat formatting by columnar byte assembly.

A turn is `<|turn|>role`, a line `<|text|>text`, and a line `<|end|>`. Rows are dealt out by ranges of (conversation, turn) and sorted there. For a
slab of rows the lengths of all segments (marks, roles, texts) are laid out in numpy; their cumulative sums say where each one begins, and marks
and contents are scattered into one Arrow buffer allocated once. The loss mask, spans of code points, is read off the same sums.

A mark inside a role or text gets a backslash before it, whatever stands there already, and loses one when it is read back; marks of the template
follow a line's end or begin a turn, so they never have one. Nothing else is escaped.

Null roles and texts are empty. Turns follow their number, null first, then role and text, so that ties have one order; repeated rows are turns of
their own. A null conversation id is one conversation. A conversation is one row of the output; one that a partition's border cuts, or that is
longer than LONGEST, is several, which `part` and `seq` order: no task ever holds a whole long conversation. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import streams
from .common import buffers, slabs, tidy

MARKS = TURN, TEXT, END = b"<|turn|>", b"<|text|>", b"<|end|>"
#: The role whose texts a model learns to write.
LEARNED = "assistant"
#: Bytes of text that are assembled together, and bytes up to which a conversation stays in one piece.
SLAB, LONGEST = 1 << 20, 1 << 22
BACKSLASH = ord("\\")
FORMATTED = f"conv_id long, {streams.PLACE}, formatted string, loss array<struct<start:long,end:long>>"
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("seq", pa.int64()), ("whole", pa.bool_()), ("formatted", pa.large_string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
SUMS, STREAMS = ["n_turns", "loss_chars", "formatted_chars"], ["turns", "loss"]


def marks(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, which of MARKS) of every mark in the bytes, in order."""
    two = np.flatnonzero(raw[:-1] == MARKS[0][0])
    two = two[raw[two + 1] == MARKS[0][1]]
    at, kind = [], []
    for k, mark in enumerate(MARKS):
        here = two[two + len(mark) <= len(raw)]
        for i in range(2, len(mark)):
            here = here[raw[here + i] == mark[i]]
        at.append(here)
        kind.append(np.full(len(here), k))
    at, kind = np.concatenate(at), np.concatenate(kind)
    order = np.argsort(at)
    return at[order], kind[order]


def inside(at: np.ndarray, sizes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which marks lie within one text of those that the offsets cut."""
    return at + sizes <= offsets[np.searchsorted(offsets, at, "right")]


def assemble(parts: list, rows: int) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """(bytes, begin of each segment as rows x parts, begin of each row and the end). A part is bytes that every row has, or a column as
    (bytes, offsets, places that get a backslash before them)."""
    sizes = np.empty((rows, len(parts)), np.int64)
    for c, part in enumerate(parts):
        sizes[:, c] = len(part) if isinstance(part, bytes) else np.diff(part[1]) + np.diff(np.searchsorted(part[2], part[1]))
    ends = np.concatenate([[0], np.cumsum(sizes.ravel())])
    begin = ends[:-1].reshape(rows, len(parts))
    buffer = pa.allocate_buffer(int(ends[-1]))
    out = np.frombuffer(buffer, np.uint8)
    for c, part in enumerate(parts):
        if isinstance(part, bytes):
            out[begin[:, c][:, None] + np.arange(len(part))] = np.frombuffer(part, np.uint8)
            continue
        raw, offsets, escaped = part
        to = np.arange(len(raw)) + np.repeat(begin[:, c] - offsets[:-1], np.diff(offsets))
        if len(escaped):
            more = np.zeros(len(raw), np.int64)
            more[escaped] = 1
            to += np.cumsum(more) - np.repeat(np.searchsorted(escaped, offsets[:-1]), np.diff(offsets))
            out[to[escaped] - 1] = BACKSLASH
        out[to] = raw
    return buffer, begin, ends[:: len(parts)] if parts else ends


def spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The kept bytes of raw[start:end], one span behind the other, and the offsets of the spans."""
    size = end - start
    ends = np.cumsum(size)
    index = np.arange(int(size.sum())) + np.repeat(start - (ends - size), size)
    held = keep[index]
    count = np.concatenate([[0], np.cumsum(held)])
    return raw[index[held]], count[np.concatenate([[0], ends])]


def _begins(raw: np.ndarray) -> np.ndarray:
    """Which bytes begin a code point."""
    return raw & 0xC0 != 0x80


def _firsts(key: pa.Array) -> np.ndarray:
    """The first row of each run of equal keys; null is a key."""
    ids, null = key.fill_null(0).to_numpy(), np.array(key.is_null())
    return np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (null[1:] != null[:-1])]))


def _assembled(rows: pa.RecordBatch, part: int, seq: int, first_whole: bool, last_whole: bool) -> pa.RecordBatch:
    """The conversations of sorted (text, role, conv_id) rows."""
    n, parts = len(rows), []
    for column in (rows.column("role"), rows.column("text")):
        raw, offsets = buffers(column)
        at, kind = marks(raw)
        parts.append((raw, offsets, at[inside(at, np.array([*map(len, MARKS)])[kind], offsets)] if len(at) else at))
    buffer, begin, row = assemble([TURN, parts[0], b"\n" + TEXT, parts[1], b"\n" + END + b"\n"], n)
    key = rows.column("conv_id")
    first = _firsts(key)
    byte = np.append(row[first], row[-1])
    out = np.frombuffer(buffer, np.uint8)
    chars = np.concatenate([[0], np.cumsum(_begins(out))])
    learned = np.flatnonzero(pc.equal(rows.column("role"), LEARNED).to_numpy(zero_copy_only=False))
    own = np.searchsorted(first, learned, "right") - 1
    base = chars[byte[own]]
    loss = pa.StructArray.from_arrays([pa.array(chars[begin[learned, 3]] - base), pa.array(chars[begin[learned, 4]] - base)], ["start", "end"])
    whole = np.ones(len(first), bool)
    whole[0] &= first_whole
    whole[-1] &= last_whole
    return pa.RecordBatch.from_arrays(
        [
            key.take(pa.array(first)), pa.array([part] * len(first), pa.int32()), pa.array(seq + np.arange(len(first))), pa.array(whole),
            pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(byte), buffer), pa.ListArray.from_arrays(pa.array(np.searchsorted(own, np.arange(len(first) + 1)).astype(np.int32)), loss),
        ], schema=_FORMATTED,
    )


def formatted(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, seq, whole, formatted, loss): the conversations as text, and the spans of code points that are learned."""
    rows = conversations.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"), F.col("conv_id").cast("long"), "turn")
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").drop("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, known, held, size = TaskContext.get().partitionId(), 0, False, [], 0
        for slab in slabs(batches, SLAB):
            held.append(slab)
            size += sum(c.nbytes for c in slab.columns[:2])
            if size < SLAB:
                continue
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cut = int(_firsts(rows.column("conv_id"))[-1])  # the last conversation may go on
            if not cut and size < LONGEST:
                held = [rows]
                continue
            out = _assembled(rows.slice(0, cut or len(rows)), part, seq, known, bool(cut))
            yield out
            known, seq = bool(cut), seq + len(out)
            held = [rows.slice(cut)] if cut else []
            size = sum(c.nbytes for b in held for c in b.columns[:2])
        if held:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            yield _assembled(rows, part, seq, known, False)

    return rows.mapInArrow(tidy(run), FORMATTED)


def parsed(pieces: pa.RecordBatch) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray, tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Of formatted pieces: roles and texts, unescaped, as (bytes, offsets); the number of turns before each piece and in all; the texts under the
    loss mask; the number of masked spans before each piece and in all; code points of each piece."""
    raw, offsets = buffers(pieces.column("formatted"))
    at, kind = marks(raw)
    escaped = (at > 0) & (raw[at - 1] == BACKSLASH) if len(at) else np.zeros(0, bool)
    keep = np.ones(len(raw), bool)
    keep[at[escaped] - 1] = False
    at, kind = at[~escaped], kind[~escaped]
    if len(at) % 3 or (kind != np.tile(np.arange(3), len(at) // 3)).any():
        raise ValueError("marks of the template are out of order")
    turn, text, end = at[0::3], at[1::3], at[2::3]
    roles = spans(raw, turn + len(TURN), text - 1, keep)
    texts = spans(raw, text + len(TEXT), end - 1, keep)
    begins = np.flatnonzero(_begins(raw))
    chars = np.searchsorted(begins, offsets)
    loss = pieces.column("loss")
    count = np.concatenate([[0], np.cumsum(loss.value_lengths().fill_null(0).to_numpy())])
    flat, base = loss.flatten(), np.repeat(chars[:-1], np.diff(count))
    begins = np.append(begins, len(raw))
    bound = [begins[base + flat.field(c).to_numpy()] for c in ("start", "end")]
    return roles, texts, np.searchsorted(turn, offsets), spans(raw, *bound, keep), count, np.diff(chars)


def read_back(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, loss_chars, formatted_chars, turns_sha256, loss_sha256), taken from formatted texts and masks alone. A cut conversation's
    pieces meet as a stream."""
    schema = f"conv_id long, {streams.PLACE}, {', '.join(f'{s} long' for s in SUMS)}, {streams.fields(STREAMS)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, SLAB):
            roles, texts, turns, learned, masked, chars = parsed(slab)
            none = np.empty(0, np.int64)
            plain, _, row = assemble([(*roles, none), b"\n", (*texts, none), b"\n"], int(turns[-1]))
            columns, byte = {c: slab.column(c) for c in ("conv_id", "part", "seq", "whole")}, (row[turns], learned[1][masked])
            points = np.concatenate([[0], np.cumsum(_begins(learned[0]))])
            columns |= {"n_turns": pa.array(np.diff(turns)), "loss_chars": pa.array(np.diff(points[byte[1]])), "formatted_chars": pa.array(chars)}
            whole = slab.column("whole").to_pylist()
            for name, data, cut in zip(STREAMS, (memoryview(plain), memoryview(learned[0])), byte):
                held = [data[i:j] for i, j in zip(cut[:-1], cut[1:])]
                columns[f"{name}_sha256"] = pa.array([hashlib.sha256(h).hexdigest() if w else None for h, w in zip(held, whole)], pa.string())
                columns[f"{name}_bytes"] = pa.array([None if w else bytes(h) for h, w in zip(held, whole)], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    # the formatted text is the first string column, by which slabs are cut
    return streams.finished(pieces.mapInArrow(tidy(run), schema), ["conv_id"], SUMS, STREAMS)
