"""Secret scan: three fixed kinds, and a likelihood ratio between two character Markov models for everything else.

The models are first-order chains over the characters of ``[A-Za-z0-9+/_=-]``. They are trained on the documents themselves,
labelled by the fixed kinds: what these find are samples of random strings, all other runs of such characters are samples of
ordinary identifiers and words. Counts cover all rows; each task sends one table of counts, whatever its input. Fixed spans cut
a run into pieces. A piece of ``min_length`` or more characters is a ``random`` span when its mean log-likelihood ratio reaches
``min_ratio``; else its best part of that length and mean is one, widened to whole letters and digits between other
symbols, and what lies before and after it is searched alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.words import code_points, slices

# The kinds in the order that breaks ties, and their patterns over UTF-8 bytes.
KINDS = ["assign", "access", "hex", "random"]
_LETTER = "abcdefghijklmnopqrstuvwxyz"
_NAMES = ["password", "passwd", "secret", "token", "api_?key"]
ASSIGN = re.compile((
    "(" + "|".join("".join(f"[{c.upper()}{c}]" if c in _LETTER else c for c in name) for name in _NAMES)
    + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
).encode())
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
_HINT = re.compile(rb"[:=]")

ALPHABET = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SYMBOLS = len(ALPHABET)
#: Letters and digits come before the other symbols.
PLAIN = 62
_CODE = np.full(256, -1, np.int16)
_CODE[np.frombuffer(ALPHABET, np.uint8)] = np.arange(SYMBOLS)

MIN_LENGTH = 20
MIN_RATIO = 0.5
#: Added to every transition count of the models, in samples of the training counts.
PRIOR = 1.0


def base_spans(text: bytes) -> list[tuple[int, int, int]]:
    """(start byte, end byte, kind number) of the fixed kinds: leftmost, non-overlapping per kind."""
    found = []
    if _HINT.search(text):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found


def _hex_spans(data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of 24 or more hex digits inside the texts of a slice."""
    raw = data.tobytes()
    spans = []
    for m in HEX.finditer(raw):
        start, end = m.span()
        borders = offsets[np.searchsorted(offsets, start, side="right"):np.searchsorted(offsets, end)]
        edges = [start, *borders.tolist(), end]
        spans += [(a, b) for a, b in zip(edges, edges[1:], strict=False) if b - a >= 24]
    return spans


def slice_spans(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Fixed spans of every text of a slice, in bytes of that text."""
    out = []
    for i in range(len(offsets) - 1):
        out.append(base_spans(data[offsets[i]:offsets[i + 1]].tobytes()))
    for start, end in _hex_spans(data, offsets):
        i = int(np.searchsorted(offsets, start, side="right")) - 1
        out[i].append((start - int(offsets[i]), end - int(offsets[i]), 2))
    return out


def _symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol of every byte, and whether byte i and i + 1 follow each other inside one run of symbols."""
    codes = _CODE[data]
    follows = np.zeros(len(codes), bool)
    if len(codes) > 1:
        follows[:-1] = (codes[:-1] >= 0) & (codes[1:] >= 0)
        borders = offsets[1:-1]
        borders = borders[(borders > 0) & (borders < len(codes))]
        follows[borders - 1] = False
    return codes, follows


def transition_counts(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """Counts [random or ordinary, from, to] over all rows; the driver gets one table, the sum over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SYMBOLS * SYMBOLS), np.int64)
        for _, data, offsets in slices(batches, 0):
            codes, follows = _symbols(data, offsets)
            secret = np.zeros(len(data), bool)
            for i, spans in enumerate(slice_spans(data, offsets)):
                for start, end, kind in spans:
                    a, b = int(offsets[i]) + start, int(offsets[i]) + end
                    if kind == 0:  # the value only, not the name before it
                        a += ASSIGN.match(data[a:b].tobytes()).start(2)
                    secret[a:b] = True
            at = np.flatnonzero(follows)
            pair = codes[at].astype(np.int64) * SYMBOLS + codes[at + 1]
            hidden = secret[at] & secret[at + 1]
            mixed = secret[at] ^ secret[at + 1]
            total[0] += np.bincount(pair[hidden], minlength=SYMBOLS * SYMBOLS)
            total[1] += np.bincount(pair[~hidden & ~mixed], minlength=SYMBOLS * SYMBOLS)
        label, code = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label, pa.int64()), pa.array(code, pa.int64()), pa.array(total[label, code], pa.int64())],
                                         names=["label", "code", "n"])

    counts = docs.select(F.col(text_column).alias("t")).mapInArrow(run, "label bigint, code bigint, n bigint")
    table = np.zeros((2, SYMBOLS * SYMBOLS))
    for row in counts.groupBy("label", "code").agg(F.sum("n").alias("n")).collect():  # at most 2 * 67 * 67 rows
        table[row["label"], row["code"]] = row["n"]
    return table.reshape(2, SYMBOLS, SYMBOLS)


def likelihood_ratio(counts: np.ndarray, prior: float = PRIOR) -> np.ndarray:
    """log P(to | from, random) - log P(to | from, ordinary).

    ``prior`` pulls each row of the ordinary model to a uniform one, and each row of the random model to its own symbols' shares
    smoothed alike, so that tables without samples give two uniform models and ratios of 0.
    """
    share = (counts.sum(1) + prior) / (counts.sum((1, 2)) + prior * SYMBOLS)[:, None]
    smooth = counts + (prior * SYMBOLS) * share[:, None, :]
    chain = smooth / smooth.sum(2, keepdims=True)
    return np.log(chain[0]) - np.log(chain[1])


def random_parts(codes: np.ndarray, ratio: np.ndarray, min_length: int, min_ratio: float) -> list[tuple[int, int]]:
    """(start, end) of the random parts of one piece of symbols, by start. ``ratio`` is the flat table."""
    gain = np.zeros(len(codes))  # sums up to each symbol, less what a mean of min_ratio has
    np.cumsum(ratio[codes[:-1] * SYMBOLS + codes[1:]].astype(np.float64) - min_ratio, out=gain[1:])
    apart = np.flatnonzero(codes >= PLAIN)
    steps = max(1, min_length - 1)
    found, open_ = [], [(0, len(codes))]
    while open_:
        a, b = open_.pop()
        if b - a < max(2, min_length):
            continue
        if gain[b - 1] >= gain[a]:
            found.append((a, b))
            continue
        sums = gain[a:b]
        lowest = np.minimum.accumulate(sums[:-steps])
        last = int(np.argmax(sums[steps:] - lowest)) + steps
        if sums[last] < lowest[last - steps]:
            continue
        start, end = a + int(np.argmin(sums[:last - steps + 1])), a + last + 1
        k = int(np.searchsorted(apart, start, side="right"))  # the other symbols around both ends
        start = max(a, min(start, int(apart[k - 1]) + 1 if k else a))
        k = int(np.searchsorted(apart, end - 1))
        end = min(b, max(end, int(apart[k]) if k < len(apart) else b))
        found.append((start, end))
        open_ += [(a, start), (end, b)]
    return sorted(found)


def scan_secrets(
    docs: DataFrame, text_column: str = "text", keep: list[str] | None = None, ratio: np.ndarray | None = None,
    min_length: int = MIN_LENGTH, min_ratio: float = MIN_RATIO,
) -> DataFrame:
    """One row per row: the ``keep`` columns (default ``doc_id``), ``_text`` and ``_spans``: kind, start and end in code points,
    by start, then kind as listed in ``KINDS``, then end.

    ``ratio`` is a trained likelihood ratio; without one it is trained on ``docs``. Null and empty texts have no spans;
    repeated rows are scanned one by one; other columns are not read.
    """
    keep = ["doc_id"] if keep is None else keep
    table = likelihood_ratio(transition_counts(docs, text_column)) if ratio is None else ratio
    rows = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_column).alias("_text"))
    n_keep = len(keep)
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    flat = table.ravel().astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches, n_keep):
            found = slice_spans(data, offsets)
            codes, follows = _symbols(data, offsets)
            for i, spans in enumerate(found):
                for a, b, _ in spans:
                    codes[int(offsets[i]) + a:int(offsets[i]) + b] = -1
            follows[:-1] &= (codes[:-1] >= 0) & (codes[1:] >= 0)
            opens = codes >= 0
            opens[1:] &= ~follows[:-1]
            starts = np.flatnonzero(opens)
            stops = np.flatnonzero((codes >= 0) & ~follows) + 1
            long = stops - starts >= min_length
            for start, stop in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
                i = int(np.searchsorted(offsets, start, side="right")) - 1
                at = start - int(offsets[i])
                found[i] += [(at + a, at + b, 3) for a, b in random_parts(codes[start:stop].astype(np.int64), flat, min_length, min_ratio)]
            out = []
            for i, spans in enumerate(found):
                if not spans:
                    out.append([])
                    continue
                bounds = code_points(data[offsets[i]:offsets[i + 1]], np.array([s[:2] for s in spans]))
                by = sorted((int(a), s[2], int(b)) for (a, b), s in zip(bounds, spans, strict=True))
                out.append([{"kind": KINDS[kind], "start": a, "end": b} for a, kind, b in by])
            columns = [part.column(i) for i in range(n_keep + 1)] + [pa.array(out, span_type)]
            yield pa.RecordBatch.from_arrays(columns, names=[f"_k{i}" for i in range(n_keep)] + ["_text", "_spans"])

    schema = ", ".join([f"_k{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep)]
                       + ["_text string, _spans array<struct<kind:string,start:bigint,end:bigint>>"])
    return rows.mapInArrow(run, schema).select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "_text", "_spans")


def report(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts and span lists per document."""
    count = lambda kind: F.size(F.filter("_spans", lambda s: s["kind"] == kind)).cast("bigint")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("_spans", lambda s: s["kind"] != "random")
    return found.select(
        F.col(id_column), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"),
    )


def redacted(docs: DataFrame, placeholder: str = "[secret]", **options) -> DataFrame:
    """Documents with every span (overlaps as one) replaced by the placeholder; no document goes.

    Texts without spans stay as they are, null ones too. ``n_chars`` follows a changed text where there is such a column.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no name of the caller's can clash with the scan's own
    text, chars = f"c{names.index('text')}", f"c{names.index('n_chars')}" if "n_chars" in names else None
    found = scan_secrets(plain, text, keep=[c for c in plain.columns if c != text], **options)
    body, start = F.col("_text"), F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    between = lambda acc, s: F.substr(body, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
    fresh = lambda acc, s: s["start"] >= acc["at"]
    cut = F.aggregate(
        "_spans", start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(fresh(acc, s), F.concat(acc["out"], between(acc, s), F.lit(placeholder))).otherwise(acc["out"]).alias("out")),
        lambda acc: F.concat(acc["out"], F.substr(body, (acc["at"] + 1).cast("int"))),
    )
    touched = F.size("_spans") > 0
    out = found.withColumn(text, F.when(touched, cut).otherwise(body))
    if chars:
        out = out.withColumn(chars, F.when(touched, F.char_length(text).cast(plain.schema[chars].dataType)).otherwise(F.col(chars)))
    return out.select(*plain.columns).toDF(*names)
