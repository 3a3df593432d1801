"""Chat formatting: turns become one byte string per conversation, assembled in columns.

Template, once per turn: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. Control strings inside texts and roles get a
backslash after their first character; those that already look so get one more, so that reading back removes exactly one. A role's
backslashes and newlines are written as ``\\\\`` and ``\\n``.

Turns are partitioned by conversation and sorted, then streamed: a piece of output is written when ``PIECE`` bytes have been
gathered or the conversation ends, so that a conversation of any length needs bounded memory. Inside a piece, segment lengths,
cumulative offsets and scatter indices are numpy arrays, and headers and texts are copied into one preallocated Arrow buffer.
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

# Strings that no text may contain as they are.
CONTROLS = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
OPEN, CLOSE = b"<|im_start|>", b"<|im_end|>\n"
#: Bytes of texts and roles in one piece of output.
PIECE = 4 << 20
_TAILS = "|".join(re.escape(c[1:]) for c in CONTROLS)
_ESCAPE = f"([<\\[]\\\\*)({_TAILS})"
_UNESCAPE = re.compile(f"([<\\[]\\\\*)\\\\({_TAILS})")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(texts: pa.Array) -> pa.Array:
    """Control strings inside texts made harmless; ``unescape`` gives the texts back."""
    return pc.replace_substring_regex(texts, pattern=_ESCAPE, replacement=r"\1\\\2")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def _roles(roles: pa.Array) -> pa.Array:
    return escape(pc.replace_substring(pc.replace_substring(roles, "\\", "\\\\"), "\n", "\\n"))


def _role(written: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(written))


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Buffer, np.ndarray, np.ndarray]:
    """(formatted bytes, turn offsets, [start, end] of the texts inside), for turns without nulls."""
    n = len(texts)
    role_bytes, role_at = _bytes(_roles(roles))
    text_bytes, text_at = _bytes(escape(texts))
    fixed = np.frombuffer(OPEN + b"\n" + CLOSE, np.uint8)
    # source: fixed parts, then roles, then texts; five segments a turn
    source = np.concatenate([fixed, role_bytes, text_bytes])
    lengths = np.empty((n, 5), np.int64)
    begins = np.empty((n, 5), np.int64)
    lengths[:] = [len(OPEN), 0, 1, 0, len(CLOSE)]
    begins[:] = [0, 0, len(OPEN), 0, len(OPEN) + 1]
    lengths[:, 1], begins[:, 1] = np.diff(role_at), role_at[:-1] + len(fixed)
    lengths[:, 3], begins[:, 3] = np.diff(text_at), text_at[:-1] + len(fixed) + len(role_bytes)
    flat = lengths.ravel()
    offsets = np.concatenate([[0], np.cumsum(flat)])
    buffer = pa.allocate_buffer(int(offsets[-1]))
    out = np.frombuffer(buffer, np.uint8)
    shift = begins.ravel() - offsets[:-1]
    step = max(1, n // max(1, int(offsets[-1]) // (1 << 20)))  # turns whose scatter indices are held at once
    for a in range(0, n, step):
        b = min(n, a + step)
        lo, hi = int(offsets[5 * a]), int(offsets[5 * b])
        out[lo:hi] = source[np.arange(lo, hi) + np.repeat(shift[5 * a:5 * b], flat[5 * a:5 * b])]
    spans = np.stack([offsets[3:-1:5], offsets[4::5]], 1)
    return buffer, offsets[::5], spans


def format_chats(
    turns: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text",
    loss_role: str = "assistant", piece: int = PIECE,
) -> DataFrame:
    """Rows (id, piece number from 0, ``formatted``, ``loss`` spans in code points of the piece, ``n_turns``, ``last`` piece or not).

    Turns come by turn number (null first), then role, then text, so ties and repeated rows have one order; each row is a turn.
    Null roles and texts count as empty. Rows with a null id form a conversation of their own. Texts with ``loss_role`` are
    under the loss mask. Only the four named columns are read. Pieces of one conversation are neighbours in one partition.
    """
    rows = turns.select(
        F.col(id_column).alias("_id"), F.col(turn_column).alias("_turn"),
        F.coalesce(F.col(role_column), F.lit("")).alias("_role"), F.coalesce(F.col(text_column), F.lit("")).alias("_text"),
    ).repartition("_id").sortWithinPartitions("_id", "_turn", "_role", "_text")
    id_type = turns.schema[id_column].dataType.simpleString()
    schema = f"_id {id_type}, _piece bigint, formatted string, loss array<struct<start:bigint,end:bigint>>, n_turns bigint, last boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, number, current = 0, 0, object()

        def emit(last: bool) -> pa.RecordBatch:
            nonlocal held, size, number
            table = pa.Table.from_batches(held)
            roles, texts = table.column("_role").combine_chunks(), table.column("_text").combine_chunks()
            buffer, _, spans = assemble(roles, texts)
            data = np.frombuffer(buffer, np.uint8)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            mine = np.asarray(pc.equal(roles, loss_role))
            loss = [{"start": int(a), "end": int(b)} for a, b in points[spans[mine]]]
            formatted = pa.Array.from_buffers(pa.large_string(), 1, [None, pa.py_buffer(np.array([0, len(data)], np.int64)), buffer])
            out = pa.RecordBatch.from_arrays(
                [table.column("_id").slice(0, 1).combine_chunks(), pa.array([number], pa.int64()), formatted.cast(pa.string()),
                 pa.array([loss], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([table.num_rows], pa.int64()),
                 pa.array([last])],
                names=["_id", "_piece", "formatted", "loss", "n_turns", "last"])
            held, size, number = [], 0, number + 1
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0)
            same = np.zeros(batch.num_rows, bool)
            same[1:] = np.asarray(pc.fill_null(pc.equal(ids[1:], ids[:-1]), False)) | (np.asarray(ids[1:].is_null()) & np.asarray(ids[:-1].is_null()))
            sizes = np.asarray(pc.add(pc.binary_length(batch.column(2)), pc.binary_length(batch.column(3)))).astype(np.int64)
            starts = np.flatnonzero(~same).tolist() + [batch.num_rows]
            for a, b in zip(starts, starts[1:], strict=False):
                key = ids[a].as_py()
                if held and key != current:
                    yield emit(True)
                if key != current:
                    current, number = key, 0
                while a < b:
                    if held and size >= piece:
                        yield emit(False)
                    stop = min(b, a + max(1, int(np.searchsorted(np.cumsum(sizes[a:b]), piece - size)) + 1))
                    held.append(batch.slice(a, stop - a))
                    size += int(sizes[a:stop].sum())
                    a = stop
        if held:
            yield emit(True)

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_column).withColumnRenamed("_piece", "piece")


def read_chats(formatted: str, loss: list[tuple[int, int]]) -> Iterator[tuple[str, str, str]]:
    """(role, text, text under the mask) of every turn of a piece."""
    masks = {start: end for start, end in loss}
    for m in _TURN.finditer(formatted):
        text = unescape(m[2])
        yield _role(m[1]), text, unescape(formatted[m.start(2):masks[m.start(2)]]) if m.start(2) in masks else ""


def digests(formatted: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """One row per conversation, read back from ``format_chats``' pieces as they stream by."""
    schema = (f"_id {formatted.schema[id_column].dataType.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, "
              "loss_sha256 string, formatted_chars bigint, n_pieces bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n = loss_chars = chars = pieces = 0
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                for role, text, masked in read_chats(row["formatted"], [(s["start"], s["end"]) for s in row["loss"]]):
                    turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    loss.update(masked.encode("utf-8", "surrogatepass"))
                    loss_chars += len(masked)
                    n += 1
                chars += len(row["formatted"])
                pieces += 1
                if row["last"]:
                    rows.append((row["_id"], n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, pieces))
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    n = loss_chars = chars = pieces = 0
            names = ["_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_pieces"]
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    rows = formatted.select(F.col(id_column).alias("_id"), "formatted", "loss", "last")
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_column)
