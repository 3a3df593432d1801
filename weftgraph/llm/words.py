"""Columnar word scanning inside Arrow tasks: byte tables, numpy offsets and 64-bit word hashes.

Words are maximal runs of the wanted bytes of a text's UTF-8 form. Both word classes below only name ASCII separators, so
scanning bytes gives the same words as scanning code points. ``A-Z`` counts as ``a-z`` in hashes. Hashes come from a fixed
seed, so they agree between tasks, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at once; temporaries take about 30 times as much.
CHUNK = 1 << 20
#: Bytes of text handed to an operator at once (at least one whole text).
SLICE = 2 << 20

_codes = np.arange(256)
#: Words of letters, digits and everything beyond ASCII.
ALNUM = ((_codes >= 0x30) & (_codes <= 0x39)) | ((_codes >= 0x41) & (_codes <= 0x5A)) | ((_codes >= 0x61) & (_codes <= 0x7A)) | (_codes >= 0x80)
#: Words between white space.
NONSPACE = ~((_codes == 0x20) | ((_codes >= 0x09) & (_codes <= 0x0D)))

_BYTES = np.random.Generator(np.random.PCG64(20_177)).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTES[0x41:0x5B] = _BYTES[0x61:0x7B]
_BASE = 0x9E37_79B9_7F4A_7C15  # odd, so it has an inverse modulo 2**64
_powers: dict[str, np.ndarray] = {}


class Words(NamedTuple):
    """Words of consecutive texts. ``first[i]:first[i + 1]`` are the words of text i; bounds are bytes of the buffer."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def mix(values: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    v = values ^ (values >> np.uint64(30))
    v = v * np.uint64(0xBF58_476D_1CE4_E5B9)
    v = v ^ (v >> np.uint64(27))
    v = v * np.uint64(0x94D0_49BB_1331_11EB)
    return v ^ (v >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, CHUNK + 4096), base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"][:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column, null as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: int = 1, limit: int = SLICE) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        data, offsets = text_buffer(batch.column(text))
        row = 0
        while row < batch.num_rows:
            stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
            yield batch.slice(row, stop - row), data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row]
            row = stop


def scan(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray) -> Words:
    """Words of all texts. Works through the bytes in chunks that end at a separator or between texts."""
    starts, ends, hashes = [], [], []
    at, n = 0, len(data)
    while at < n:
        stop = min(n, at + CHUNK)
        while stop < n:  # a cut inside a word moves on to the word's end
            ahead = wanted[data[stop - 1:stop + CHUNK]]
            gap = np.flatnonzero(~(ahead[1:] & ahead[:-1]))
            limit = np.searchsorted(offsets, stop)
            border = int(offsets[limit]) - stop if limit < len(offsets) else n - stop
            ahead_by = int(gap[0]) if len(gap) else len(ahead) - 1
            stop += min(ahead_by, border)
            if len(gap) or border <= ahead_by or stop >= n:
                break
        piece = data[at:stop]
        inside = wanted[piece]
        begin, finish = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        finish[:-1] &= ~inside[1:]
        edges = offsets[np.searchsorted(offsets, at):np.searchsorted(offsets, stop, side="right")] - at
        lead = edges[edges < len(piece)]
        tail = edges[edges > 0] - 1
        begin[lead] = inside[lead]
        finish[tail] = inside[tail]
        s, e = np.flatnonzero(begin), np.flatnonzero(finish) + 1
        up, down = _power(len(piece))
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTES[piece] * up, out=total[1:])
        hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    code = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    return Words(start, end, code, np.searchsorted(start, offsets))


def words_of(text: str, wanted: np.ndarray) -> np.ndarray:
    """Word hashes of one text."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return scan(raw, np.array([0, len(raw)], np.int64), wanted).hash


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive values."""
    n = len(hashes) - k + 1
    if n <= 0:
        return hashes[:0]
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = total * np.uint64(_BASE) + hashes[i:i + n]
    return mix(total)


def code_points(data: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """Code points of one text before the byte positions."""
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return before[positions]
