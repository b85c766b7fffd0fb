"""Chat formatting by columnar byte assembly.

Turns are sorted within their conversation by Spark and pass through a task in Arrow batches. Each batch is assembled as
one buffer: every turn has three segments (header, escaped content, footer), the segment lengths give the offsets by a
running sum, and the bytes are scattered to their places with three index vectors. No turn is formatted on its own.

Template: ``[INST] text [/INST]`` for users, ``[SYS] text [/SYS]`` for the system, `` text </s>`` for assistants, and
``[TURN role] text [/TURN]`` for any other role. In texts and roles a backslash is put before every backslash, before the
bracket of a control string, and (in roles) before ``]``; reading back drops it, so that formatting is reversible.
The loss mask covers the assistants' contents (escaped), not headers or footers.

A conversation leaves as pieces, at most one per conversation and batch, with its loss spans in code points of the piece:
the pieces of a long conversation in order are its formatted text, and no task holds more than one batch.

Defined cases: null text and null role are empty text; an unknown or empty role takes the ``TURN`` header; turns of equal
number are ordered by role, then text; a null turn number comes first; rows without a conv_id form one conversation of
their own. Repeated rows are repeated turns. Extra columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hanok.llm.columnar import ranges, text_bytes

#: Header and footer by role.
FRAMES = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": (" ", " </s>")}
OTHER = ("[TURN ", "] ", " [/TURN]")
#: What a text may not show unescaped. A backslash goes before each match's first character.
CONTROL = r"(\\|\[/?(?:INST|SYS|TURN)|</?s>)"
ROLE_CONTROL = r"(\\|\]|\[/?(?:INST|SYS|TURN)|</?s>)"

PIECES = "conv_id bigint, piece int, turns int, formatted string, loss_starts array<bigint>, loss_ends array<bigint>"
DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _frames(roles: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """Header and footer of every row, and whether its content is under the loss mask."""
    kinds = roles.dictionary_encode()
    names = [x.as_py() for x in kinds.dictionary]
    escaped = pc.replace_substring_regex(kinds.dictionary, ROLE_CONTROL, r"\\\1").to_pylist() if names else []
    heads = [FRAMES[n][0] if n in FRAMES else OTHER[0] + e + OTHER[1] for n, e in zip(names, escaped, strict=True)]
    feet = [FRAMES[n][1] if n in FRAMES else OTHER[2] for n in names]
    at = kinds.indices
    taught = np.array([n == "assistant" for n in names], bool)[at.to_numpy(zero_copy_only=False)] if names else np.zeros(0, bool)
    return pa.array(heads, pa.string()).take(at), pa.array(feet, pa.string()).take(at), taught


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, turn ends, content starts, content ends, taught) of all rows in one preallocated buffer."""
    heads, feet, taught = _frames(roles)
    parts = [text_bytes(x) for x in (heads, pc.replace_substring_regex(texts, CONTROL, r"\\\1"), feet)]
    lengths = np.stack([np.diff(offsets) for _, offsets in parts], axis=1)
    ends = np.cumsum(lengths.reshape(-1)).reshape(lengths.shape)
    out = np.empty(int(ends[-1, -1]) if len(ends) else 0, np.uint8)
    for k, (data, offsets) in enumerate(parts):
        out[ranges(ends[:, k] - lengths[:, k], lengths[:, k])] = data[ranges(offsets[:-1], lengths[:, k])]
    return out, ends[:, 2], ends[:, 0], ends[:, 1], taught


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, piece = object(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        roles, texts = (pc.fill_null(batch.column(c), "") for c in ("role", "text"))
        out, ends, inner, outer, taught = assemble(roles, texts)
        chars = np.zeros(len(out) + 1, np.int64)  # code points before each byte
        np.cumsum((out & 0xC0) != 0x80, out=chars[1:])
        conv = batch.column("conv_id").to_pylist()
        rows = np.flatnonzero([i == 0 or conv[i] != conv[i - 1] for i in range(len(conv))])
        stops = np.append(rows[1:], len(conv))
        numbers = []
        for r in rows:
            piece = piece + 1 if conv[r] == last else 0
            last = conv[r]
            numbers.append(piece)
        starts = np.where(rows > 0, ends[rows - 1], 0)
        bounds = np.append(starts, ends[-1])
        origin = chars[np.repeat(starts, stops - rows)]
        before = np.concatenate([[0], np.cumsum(taught)])
        spans = [pa.ListArray.from_arrays(pa.array(np.append(before[rows], before[-1]), pa.int32()), pa.array((chars[x] - origin)[taught])) for x in (inner, outer)]
        formatted = pa.LargeStringArray.from_buffers(len(rows), pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array([conv[r] for r in rows], pa.int64()), pa.array(numbers, pa.int32()), pa.array(stops - rows, pa.int32()), formatted, *spans],
            names=["conv_id", "piece", "turns", "formatted", "loss_starts", "loss_ends"],
        )


def format_chats(turns: DataFrame) -> DataFrame:
    """Formatted pieces of all conversations of ``turns(conv_id, turn, role, text)``, in order within each task."""
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    return rows.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text").mapInArrow(_pieces, PIECES)


_TURN = re.compile(
    r"\[INST\] (?P<user>(?:[^\\\[]|\\.|\[(?!/INST\]))*?) \[/INST\]"
    r"|\[SYS\] (?P<system>(?:[^\\\[]|\\.|\[(?!/SYS\]))*?) \[/SYS\]"
    r"|\[TURN (?P<role>(?:[^\\\]]|\\.)*)\] (?P<other>(?:[^\\\[]|\\.|\[(?!/TURN\]))*?) \[/TURN\]"
    r"| (?P<assistant>(?:[^\\<]|\\.|<(?!/s>))*?) </s>",
    re.DOTALL,
)
_ESCAPE = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    return _ESCAPE.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted piece; fails on text that the template cannot have made."""
    out, at = [], 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError(f"no turn at {at}: {formatted[at:at + 40]!r}")
        kind = found.lastgroup
        out.append((unescape(found["role"]) if kind == "other" else kind, unescape(found[kind])))
        at = found.end()
    return out


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of whole conversations from their pieces, which arrive in order; a running hash bounds the memory."""
    now, state, started = None, None, False

    def row():
        return [now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

    def table(rows):
        schema = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], names=names)

    for batch in batches:
        done = []
        for x in batch.to_pylist():
            if not started or x["piece"] == 0:
                if started:
                    done.append(row())
                now, state, started = x["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
            text = x["formatted"]
            turns = parse(text)
            state[0] += len(turns)
            state[1].update("".join(f"{r}\n{t}\n" for r, t in turns).encode())
            for a, b in zip(x["loss_starts"], x["loss_ends"], strict=True):
                taught = unescape(text[a:b])
                state[2] += len(taught)
                state[3].update(taught.encode())
            state[4] += len(text)
        if done:
            yield table(done)
    if started:
        yield table([row()])


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests by conversation, parsed from ``format_chats``' output in the partitions and order it left them in."""
    return pieces.mapInArrow(_read_back, DIGESTS)
