"""Byte-level BPE as a tree reduction over exact joins.

``Encoder.encode`` encodes the halves of a long piece and joins them. A token list is the BPE encoding of its bytes when each
neighbouring pair re-encodes to itself, so a join re-encodes a window of tokens around the seam and lets it grow until both
pairs at its rims are stable; everything outside is then final. Decoding concatenates token bytes up the same tree.

The vocabulary is read once on the driver (its path is a parameter) and shipped to the executors: one entry per rank, a size
fixed by the file and checked against ``MAX_VOCABULARY_BYTES``. Pieces of text are encoded once per task and kept in a table
of ``MEMO`` entries, which starts anew when it is full.
"""

from __future__ import annotations

import base64
import heapq
import re
import unicodedata
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 6
#: Windows of more bytes use a heap.
HEAP_FROM = 64
NONE = 1 << 60
MEMO = 120_000
MAX_VOCABULARY_BYTES = 64 << 20
#: Characters of text whose pieces are held as Python strings at once.
PIECES = 1 << 18
#: Fixed value: the public splitting pattern, for which there is a quicker form below.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The quicker form holds for texts below this character; its classes are read off the Unicode tables.
LATIN_END = 0x250
_ready: dict[str, Encoder] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (one base64 token and its rank per line)."""
    raw = Path(path).read_bytes()
    if len(raw) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has {len(raw)} bytes, more than {MAX_VOCABULARY_BYTES}")
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


class Encoder:
    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self._stable: dict[tuple[int, int], bool] = {}
        self._leaves: dict[bytes, list[int]] = {}
        self.memo: _Memo | None = None  # of this process

    def leaf(self, piece: bytes) -> list[int]:
        """Merges of the lowest rank first, leftmost among equals."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > HEAP_FROM:
            return self._heap_merges(piece)
        get = ranks.get
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pairs = [get(piece[i:i + 2], NONE) for i in range(len(piece) - 1)]
        while pairs:
            best = min(pairs)
            if best == NONE:
                break
            i = pairs.index(best)
            merged = parts[i] = parts[i] + parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(merged + parts[i + 1], NONE)
            if i:
                pairs[i - 1] = get(parts[i - 1] + merged, NONE)
        return [ranks[p] for p in parts]

    def _heap_merges(self, piece: bytes) -> list[int]:
        """The same merges for a long window, with a heap of pairs and linked parts."""
        n, get = len(piece), self.ranks.get
        end = list(range(1, n + 1))  # part i is piece[i:end[i]]; end[i] is also the next part
        before = list(range(-1, n - 1))
        alive = [True] * n
        heap = [(rank, i, i + 2) for i in range(n - 1) if (rank := get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or end[end[i]] != stop:
                continue
            alive[end[i]] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                if (rank := get(piece[i:end[stop]])) is not None:
                    heapq.heappush(heap, (rank, i, end[stop]))
            if (p := before[i]) >= 0 and (rank := get(piece[p:stop])) is not None:
                heapq.heappush(heap, (rank, p, stop))
        return [self.ranks[piece[i:end[i]]] for i in range(n) if alive[i]]

    def stable(self, a: int, b: int) -> bool:
        """Whether the two tokens stay as they are when their bytes are encoded together."""
        key = (a, b)
        known = self._stable.get(key)
        if known is None:
            if len(self._stable) > MEMO:
                self._stable.clear()
            known = self._stable[key] = self.leaf(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def small(self, piece: bytes) -> list[int]:
        """``leaf`` with a table, for the short byte strings that come again and again."""
        known = self._leaves.get(piece)
        if known is None:
            if len(self._leaves) > MEMO:
                self._leaves.clear()
            known = self._leaves[piece] = self.leaf(piece)
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the concatenation of two encoded pieces."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = b"".join([self.bytes[t] for t in left[a:] + right[:b]])
            middle = self.small(window) if len(window) <= 4 * LEAF else self.leaf(window)
            if (a == 0 or self.stable(left[a - 1], middle[0])) and (b == len(right) or self.stable(middle[-1], right[b])):
                return left[:a] + middle + right[b:]
            width *= 2

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece (one match of the splitting pattern): halves are encoded, then joined."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) <= LEAF:
            return self.small(piece)
        half = len(piece) // 2
        return self.join(self.encode(piece[:half]), self.encode(piece[half:]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class _Memo(dict):
    """Packed ids of a piece of text, worked out when first asked for."""

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.encoder.encode(piece.encode("utf-8", "surrogatepass")), "<u4").tobytes()
        if len(self) >= MEMO:
            self.clear()
        if len(piece) <= 64:
            self[piece] = packed
        return packed


def _ranges(wanted: Callable[[str], bool]) -> str:
    points = [i for i in range(LATIN_END) if wanted(chr(i))]
    firsts = [i for i in points if i - 1 not in points]
    lasts = [i for i in points if i + 1 not in points]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(firsts, lasts, strict=True))


def splitter(pattern: str) -> Callable[[str], re.Pattern]:
    """Gives the compiled pattern for a text. Letters come first in the quicker form: no other part can begin as they do."""
    import regex

    every = regex.compile(pattern)
    if pattern != SPLIT:
        return lambda _: every
    letter = _ranges(lambda c: unicodedata.category(c)[0] == "L")
    number = _ranges(lambda c: unicodedata.category(c)[0] == "N")
    space = _ranges(lambda c: regex.match(r"\s", c) is not None)
    latin = re.compile(
        f" ?[{letter}]+|'(?:s|t|re|ve|m|ll|d)| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+"
    )
    beyond = re.compile(f"[^\\u0000-\\u{LATIN_END - 1:04x}]")
    return lambda text: every if beyond.search(text) else latin


def _packed(text: str, finder, memo: _Memo) -> Iterator[bytes]:
    """Packed ids in runs of pieces, so that a long text is never held as a list of all its pieces."""
    pieces, held = [], 0
    for match in finder(text):
        pieces.append(match.group())
        held += len(pieces[-1])
        if held >= PIECES:
            yield b"".join(map(memo.__getitem__, pieces))
            pieces, held = [], 0
    yield b"".join(map(memo.__getitem__, pieces))


def _encoder(vocabulary, key: str) -> Encoder:
    """The process's encoder of a broadcast vocabulary, kept between tasks."""
    if key not in _ready:
        _ready.clear()
        _ready[key] = Encoder(vocabulary.value)
        _ready[key].memo = _Memo(_ready[key])
    return _ready[key]


def encode_texts(
    docs: DataFrame, vocabulary_path: str, pattern: str, text_column: str = "text", keep: list[str] | None = None, round_trip: bool = False,
) -> DataFrame:
    """One row per row: the ``keep`` columns (default ``doc_id``) and ``ids``, the packed little-endian unsigned 32-bit ids.

    With ``round_trip`` a column of that name says whether decoding gives the text back, found in the same task.

    Null texts count as empty and give no ids; repeated rows are encoded one by one; other columns are not read.
    """
    keep = ["doc_id"] if keep is None else keep
    vocabulary, key = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path)), str(vocabulary_path)
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_column).alias("_text"))
    schema = ", ".join([f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)] + ["ids binary"] + ["round_trip boolean"] * round_trip)
    n_keep = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, key)
        pattern_for, memo = splitter(pattern), encoder.memo
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = []
                for text in part.column(n_keep).to_pylist():
                    text = text or ""
                    compiled = pattern_for(text)
                    if len(text) <= PIECES:
                        ids.append(b"".join(map(memo.__getitem__, compiled.findall(text))))
                    else:
                        ids.append(b"".join(_packed(text, compiled.finditer, memo)))
                columns = [part.column(i) for i in range(n_keep)] + [pa.array(ids, pa.binary())]
                if round_trip:
                    same = [encoder.decode(np.frombuffer(x, "<u4").tolist()) == (t or "").encode() for x, t in zip(ids, part.column(n_keep).to_pylist(), strict=True)]
                    columns.append(pa.array(same))
                yield pa.RecordBatch.from_arrays(columns, names=[f"_k{i}" for i in range(n_keep)] + ["ids"] + ["round_trip"] * round_trip)

    return rows.mapInArrow(run, schema).select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "ids", *["round_trip"] * round_trip)


def decode_ids(encoded: DataFrame, vocabulary_path: str, ids_column: str = "ids") -> DataFrame:
    """The rows with ``decoded`` (bytes) added; null ids give empty bytes."""
    names = encoded.columns
    if "decoded" in names:
        raise ValueError("the rows already have a column named decoded")
    vocabulary, key = encoded.sparkSession.sparkContext.broadcast(read_ranks(vocabulary_path)), str(vocabulary_path)
    ids_at = names.index(ids_column)
    schema = ", ".join([f"_k{i} {f.dataType.simpleString()}" for i, f in enumerate(encoded.schema.fields)] + ["decoded binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary, key)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = [encoder.decode(np.frombuffer(x or b"", "<u4").tolist()) for x in part.column(ids_at).to_pylist()]
                columns = [part.column(i) for i in range(len(names))] + [pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[f"_k{i}" for i in range(len(names))] + ["decoded"])

    plain = encoded.toDF(*[f"_k{i}" for i in range(len(names))])
    return plain.mapInArrow(run, schema).toDF(*names, "decoded")


def report(decoded: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Digests of a decoded result."""
    return decoded.select(
        F.col(id_column), F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
