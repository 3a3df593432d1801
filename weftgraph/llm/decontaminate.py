"""Benchmark decontamination: a suffix automaton of test items, streamed over the words of whole documents.

An item of ``window`` or more words matches with any ``window`` consecutive words, a shorter one (but not an empty one) with
all its words. Every document word inside an occurrence is hit.

Items are sorted into blocks of at most ``block_words`` words; each block becomes one automaton on the driver and is shipped to
the executors, and documents pass the blocks one after the other without a shuffle. Words are compared by 64-bit hashes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.automaton import Lexicon, SuffixAutomaton
from weftgraph.llm.words import ALNUM, code_points, scan, slices, words_of

WINDOW = 10
#: Words of test items in one automaton (some 200 MB in a task).
BLOCK_WORDS = 200_000
_built: dict[str, ItemIndex] = {}


class ItemIndex:
    """Automaton of one block of items with what is needed to name the items at a state."""

    def __init__(self, items: list[tuple[object, np.ndarray]], window: int) -> None:
        items = [(key, hashes) for key, hashes in items if len(hashes)]
        self.keys = [key for key, _ in items]
        self.window = window
        self.lexicon = Lexicon([hashes for _, hashes in items])
        self.automaton = SuffixAutomaton()
        self.shortest = window
        self.short: dict[int, list[tuple[int, int]]] = {}
        for number, sequence in enumerate(self.lexicon.sequences):
            self.automaton.add(sequence.tolist())
            self.shortest = min(self.shortest, len(sequence))
        for number, sequence in enumerate(self.lexicon.sequences):
            if len(sequence) < window:
                state = self.automaton.stream(sequence.tolist())[1][-1]
                self.short.setdefault(state, []).append((len(sequence), number))
        self.below = self.automaton.children()
        self._long: dict[int, frozenset[int]] = {}
        self._short: dict[int, list[tuple[int, int]]] = {}

    def long_items(self, state: int) -> frozenset[int]:
        """Items that have the last ``window`` words of the state's substrings."""
        if state not in self._long:
            s = state
            while self.automaton.lengths[self.automaton.links[s]] >= self.window:
                s = self.automaton.links[s]
            if s not in self._long:
                self._long[s] = frozenset(n for n, end in self.automaton.occurrences(s, self.below) if end >= self.window)
            self._long[state] = self._long[s]
        return self._long[state]

    def short_items(self, state: int) -> list[tuple[int, int]]:
        """(words, item) of the short items that are suffixes of the state's substrings."""
        if state not in self._short:
            found, s = [], state
            while s > 0:
                found.extend(self.short.get(s, ()))
                s = self.automaton.links[s]
            self._short[state] = found
        return self._short[state]

    def hits(self, tokens: list[int], offset: int, spans: list[tuple[int, int]], items: set[int]) -> None:
        """Add the word spans and items that occur in a run which starts at word ``offset``."""
        for i, (length, state) in enumerate(zip(*self.automaton.stream(tokens), strict=True), offset + 1):
            if length >= self.window:
                spans.append((i - self.window, i))
                items |= self.long_items(state)
            if self.short:
                for size, item in self.short_items(state):
                    if size <= length:
                        spans.append((i - size, i))
                        items.add(item)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


_SPANS = "array<struct<start:bigint,end:bigint>>"


def contamination(
    docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: list[str] | None = None,
) -> DataFrame:
    """One row per document row: the ``keep`` columns (default: the id) with ``_words`` (count), ``_spans`` (hit word spans,
    merged), ``_cuts`` (the same in code points, up to each span's last word) and ``_items`` (item ids as text, sorted).

    Null and empty texts have no words and no hits; null item ids are left out of ``_items`` but their words count as hits;
    repeated documents and items count one by one. Extra columns are only read when ``keep`` names them.
    """
    spark = docs.sparkSession
    keep = [id_column] if keep is None else keep
    items = benchmark.select(F.col(item_column).cast("string").alias("k"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    blocks: list[list[tuple[object, np.ndarray]]] = [[]]
    words = 0
    for row in items.toLocalIterator():  # one partition at a time; what stays on the driver is the blocks' hashes
        hashes = words_of(row["t"], ALNUM)
        if words + len(hashes) > block_words and blocks[-1]:
            blocks.append([])
            words = 0
        blocks[-1].append((row["k"], hashes))
        words += len(hashes)
    state = docs.select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_column).alias("_text"), F.lit(0).cast("bigint").alias("_words"),
        F.array().cast(_SPANS).alias("_spans"), F.array().cast(_SPANS).alias("_cuts"), F.array().cast("array<string>").alias("_items"),
    )
    for block in blocks:
        state = state.mapInArrow(_scanner(spark.sparkContext.broadcast(block), window, len(keep)), state.schema)
    return state.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("_text"), "_words", "_spans", "_cuts", "_items")


def _scanner(block, window: int, n_keep: int):
    key = uuid.uuid4().hex  # a process builds the automaton once for all its tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _built:
            _built.clear()
            _built[key] = ItemIndex(block.value, window)
        index = _built[key]
        for rows, data, offsets in slices(batches, n_keep):
            found = scan(data, offsets, ALNUM)
            ids = index.lexicon.ids(found.hash)
            spans: dict[int, list[tuple[int, int]]] = {}
            items: dict[int, set[int]] = {}
            for start, stop in index.lexicon.runs(ids, found.first, index.shortest):
                doc = int(np.searchsorted(found.first, start, side="right")) - 1
                index.hits(ids[start:stop].tolist(), start - int(found.first[doc]), spans.setdefault(doc, []), items.setdefault(doc, set()))
            counts = np.diff(found.first)
            old = [rows.column(n_keep + k).to_pylist() for k in (2, 3, 4)]
            for doc, fresh in spans.items():
                if not fresh:
                    continue
                union = merged(fresh + [(s["start"], s["end"]) for s in old[0][doc]])
                text = data[offsets[doc]:offsets[doc + 1]]
                at = int(found.first[doc])
                bounds = np.array([(found.start[at + a], found.end[at + b - 1]) for a, b in union]) - offsets[doc]
                points = code_points(text, bounds)
                old[0][doc] = [{"start": a, "end": b} for a, b in union]
                old[1][doc] = [{"start": int(a), "end": int(b)} for a, b in points]
                old[2][doc] = sorted({*old[2][doc], *(index.keys[i] for i in items[doc] if index.keys[i] is not None)})
            columns = [rows.column(i) for i in range(n_keep + 1)] + [pa.array(counts, pa.int64())]
            columns += [pa.array(v, rows.schema.field(n_keep + 2 + k).type) for k, v in enumerate(old)]
            yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return run


def report(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Digest per document of a ``contamination`` result."""
    hit = F.coalesce(F.aggregate("_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"]), F.lit(0))
    return found.select(
        F.col(id_column), F.col("_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("_items", ","), 256).alias("items_sha256"), (F.size("_spans") > 0).alias("contaminated"),
    )


def without(text: Column, cuts: Column) -> Column:
    """Text without the code-point spans (sorted, disjoint)."""
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    kept = lambda acc, s: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")))
    return F.aggregate(
        cuts, start, lambda acc, s: F.struct(s["end"].alias("at"), kept(acc, s).alias("out")),
        lambda acc: F.concat(acc["out"], F.substr(text, (acc["at"] + 1).cast("int"))),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, max_coverage: float = 0.5, **options) -> DataFrame:
    """Documents without their hit spans; a document of which ``max_coverage`` or more of the words are hit goes as a whole.

    Untouched documents stay as they are, those with null texts too. ``n_chars`` follows the new text where there is such a column.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])  # no name of the caller's can clash with the scan's own
    text, chars = f"c{names.index('text')}", f"c{names.index('n_chars')}" if "n_chars" in names else None
    found = contamination(plain, benchmark, text, text, keep=[c for c in plain.columns if c != text], **options)
    hit = F.aggregate("_spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    touched = F.size("_spans") > 0
    left = found.filter(~touched | (hit < max_coverage * F.col("_words"))).withColumn(
        text, F.when(touched, without(F.col("_text"), F.col("_cuts"))).otherwise(F.col("_text")))
    if chars:
        left = left.withColumn(chars, F.when(touched, F.char_length(text).cast(plain.schema[chars].dataType)).otherwise(F.col(chars)))
    return left.select(*plain.columns).toDF(*names)
