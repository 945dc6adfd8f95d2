"""Chat formatting: turns become one marked text by columnar byte assembly.

A turn reads ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Inside texts every ``<``, backslashes, ``|``
gets one more backslash, so no control string can occur there and unescaping restores the text.
Roles are percent-escaped. Conversations are dealt by range of (conv_id, turn), so one that holds
a large share of the rows spreads over tasks; it then comes as several consecutive parts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlab.llm.common import conf_batches, flat, small_batches

START, END = b"<|im_start|>", b"<|im_end|>"
_CONTROL = re.compile(rb"<\\*\|")
_ESCAPED = re.compile(rb"<(\\*)\\\|")
_TURN = re.compile(rb"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)

PARTS = "conv_id long, part long, n_turns long, formatted string, loss array<struct<start:int,stop:int>>"


def escape_role(role: str) -> bytes:
    out = role.replace("%", "%25").replace("\n", "%0A").replace("<", "%3C")
    return out.encode()


def unescape_role(role: bytes) -> str:
    return role.decode().replace("%3C", "<").replace("%0A", "\n").replace("%25", "%")


def unescape(text: bytes) -> bytes:
    return _ESCAPED.sub(rb"<\1|", text)


def _insertions(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions before which a backslash goes; matches that straddle two texts don't count."""
    found = np.array([(m.start(), m.end() - 1) for m in _CONTROL.finditer(data.tobytes())], np.int64).reshape(-1, 2)
    row = np.searchsorted(offsets, found, "right")
    return found[row[:, 0] == row[:, 1], 1]


def _copy(to: np.ndarray, starts: np.ndarray, data: np.ndarray, offsets: np.ndarray, shift: np.ndarray | None = None) -> None:
    """Scatters row i's bytes of data to `to` from starts[i] on; shift moves single bytes further."""
    where = np.arange(len(data), dtype=np.int64) + np.repeat(starts - offsets[:-1], np.diff(offsets))
    to[where if shift is None else where + shift] = data


def assemble(roles: pa.Array, texts: pa.Array, learn: np.ndarray, parts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The formatted parts and their loss spans in bytes. parts: first row of each part, then the row count."""
    heads = pa.array([START + escape_role(r or "") + b"\n" for r in roles.to_pylist()], pa.large_binary())
    head, head_off = flat(heads)
    data, off = flat(texts)
    at = _insertions(data, off)
    extra = np.diff(np.searchsorted(at, off))
    tail = np.frombuffer(END + b"\n", np.uint8)
    text_len, head_len = np.diff(off) + extra, np.diff(head_off)
    ends = np.cumsum(head_len + text_len + len(tail))
    begins = ends - (head_len + text_len + len(tail))
    out = np.full(int(ends[-1]) if len(ends) else 0, ord("\\"), np.uint8)
    _copy(out, begins, head, head_off)
    text_at = begins + head_len
    before = np.searchsorted(at, np.arange(len(data)), "right") if len(at) else None
    if before is not None:
        before = before - np.repeat(np.searchsorted(at, off[:-1]), np.diff(off))
    _copy(out, text_at, data, off, before)
    out[(ends - len(tail))[:, None] + np.arange(len(tail))] = tail
    part_off = np.append(begins[parts[:-1]], ends[-1:]).astype(np.int64)
    formatted = pa.Array.from_buffers(pa.large_string(), len(parts) - 1, [None, pa.py_buffer(part_off), pa.py_buffer(out)])
    own = np.repeat(part_off[:-1], np.diff(parts))
    spans = pa.StructArray.from_arrays(
        [pa.array((text_at - own)[learn], pa.int32()), pa.array((text_at + text_len - own)[learn], pa.int32())], ["start", "stop"]
    )
    span_off = np.append(0, np.cumsum(learn))[parts]
    return formatted, pa.ListArray.from_arrays(pa.array(span_off, pa.int32()), spans)


def _format_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    for b in small_batches(batches, "text", 2 << 20):
        conv = b.column("conv_id")
        ids, null = conv.fill_null(0).to_numpy(zero_copy_only=False), conv.is_null().to_numpy(zero_copy_only=False)
        new = np.append(True, (ids[1:] != ids[:-1]) | (null[1:] != null[:-1]))
        parts = np.append(np.flatnonzero(new), b.num_rows)
        learn = np.array([r == "assistant" for r in b.column("role").to_pylist()], bool)
        formatted, loss = assemble(b.column("role"), b.column("text"), learn, parts)
        n = len(parts) - 1
        yield pa.RecordBatch.from_arrays(
            [conv.take(pa.array(parts[:-1])), pa.array(part + np.arange(n)), pa.array(np.diff(parts)), formatted.cast(pa.string()), loss],
            ["conv_id", "part", "n_turns", "formatted", "loss"],
        )
        part += n


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, part, n_turns, formatted, loss (byte spans of the assistant texts in formatted).

    Rows go by turn, ties by role, then text; repeated rows stay. Null role or text: empty; a null
    conv_id is one conversation of its own; null turns come first. Few conversations have more than
    one part (about 2 MB of text each); their parts, by `part`, are the whole. No rows: no parts."""
    conf_batches(conversations.sparkSession)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(_format_part, PARTS)


def parse(formatted: bytes, loss: list[tuple[int, int]]) -> tuple[list[tuple[str, bytes]], list[bytes]]:
    """Read back: the turns as (role, text) and the unescaped texts under the loss mask."""
    turns = [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]
    return turns, [unescape(formatted[a:b]) for a, b in loss]


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now = object()
    rows: list[dict] = []

    def flush(done: list[dict]) -> pa.RecordBatch:
        cols = [n.split()[0] for n in DIGEST.split(", ")]
        data = [[(v.hexdigest() if hasattr(v := r[c], "hexdigest") else v) for r in done] for c in cols]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(data, kinds)], cols)

    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]  # one part as Python objects at a time
            if r["conv_id"] != now or not rows:
                now = r["conv_id"]
                rows.append({"conv_id": now, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0})
            x = rows[-1]
            turns, learnt = parse(r["formatted"].encode(), [(s["start"], s["stop"]) for s in r["loss"]])
            x["n_turns"] += len(turns)
            for role, text in turns:
                x["turns_sha256"].update(role.encode() + b"\n" + text + b"\n")
            for text in learnt:
                x["loss_chars"] += len(text.decode())
                x["loss_sha256"].update(text)
            x["formatted_chars"] += len(r["formatted"])
        if len(rows) > 1:
            yield flush(rows[:-1])
            rows = rows[-1:]
    if rows:
        yield flush(rows)


def digest(parts: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted parts in order; of a batch of parts, which its bytes bound, one at a time becomes Python objects."""
    dealt = parts.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(_digest_part, DIGEST)
