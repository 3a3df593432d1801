"""Phrase collocations: n-gram counts from an FM-index per shard, summed across shards.

A phrase can only be frequent if its words and its word pairs are, so texts are read three times: words are counted, then pairs of frequent
words, then longer phrases of frequent pairs. What is frequent travels to the tasks as a bit table of bounded size; it may let rare phrases
through, which the exact sums drop, but never loses one. Counts are sums over all shards, so no shard's own count decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.fmindex import WordIndex
from weftgraph.llm.words import mix, slices
from weftgraph.plans.scale import durable

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: Text bytes of one shard; its index takes about 60 times as much.
SHARD = 2 << 20
#: Bits of the table of frequent words or pairs: 16 an entry, no more than this (16 MB).
MAX_BITS = 1 << 27

_codes = np.arange(256)
_LOWER = np.where((_codes >= 0x41) & (_codes <= 0x5A), _codes + 32, _codes).astype(np.uint8)
_BREAK = np.isin(_codes, [ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D])
_WORD = ~(_BREAK | np.isin(_codes, [0x20, 0x09]))
_COUNTS = "lang string, phrase string, a bigint"


def _hashes(strings: pa.Array) -> np.ndarray:
    return pd.util.hash_array(np.asarray(strings.to_numpy(zero_copy_only=False), dtype=object), categorize=False)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(0x9E37_79B9_7F4A_7C15) + right)


class BitTable:
    """Membership of 64-bit keys at two places of a bit table; says yes to every key put in, and to few others."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.mask = np.uint64(len(words) * 64 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for places in bit_places(keys, self.mask):
            found &= (self.words[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1) == 1
        return found


def bit_places(keys: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    return keys & mask, mix(keys + np.uint64(1)) & mask


class Shard:
    """Words of some texts: ``ids`` number (lang, word), 0 between pieces; ``vocabulary[id - 1]`` and ``langs[id - 1]`` name them."""

    def __init__(self, langs: np.ndarray, texts: list[bytes]) -> None:
        data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        inside = _WORD[data]
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        stops = np.flatnonzero(~inside & np.concatenate([[False], inside[:-1]]))
        offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
        raw = pa.py_buffer(np.ascontiguousarray(data[inside]))
        coded = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), raw).dictionary_encode()
        number = coded.indices.to_numpy().astype(np.int64)
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
        lang_names, lang_of = np.unique(langs, return_inverse=True)
        joint = lang_of[text] * max(1, len(coded.dictionary)) + number
        keys, self.words = np.unique(joint, return_inverse=True)
        self.langs = lang_names[keys // max(1, len(coded.dictionary))]
        self.vocabulary = coded.dictionary.take(pa.array(keys % max(1, len(coded.dictionary))))
        self.counts = np.bincount(self.words, minlength=len(keys))
        breaks = np.cumsum(_BREAK[data])
        self.piece = breaks[starts] if len(starts) else starts  # line breaks between texts end pieces too

    def hashes(self) -> np.ndarray:
        """Key of every (lang, word)."""
        return _pair(_hashes(pa.array(self.langs, pa.string())), _hashes(self.vocabulary))

    def ids(self, joined: np.ndarray, least: int) -> np.ndarray:
        """Numbers from 1 with separators: neighbours stay together where ``joined`` says so; runs of fewer than ``least`` words go."""
        n = len(self.words)
        if not n:
            return np.zeros(0, np.int64)
        run = np.concatenate([[0], np.cumsum(~joined)])
        keep = np.bincount(run)[run] >= least
        ends = np.concatenate([~joined, [True]]) & keep
        closed = ends[keep]
        places = np.arange(len(closed)) + np.cumsum(closed) - closed
        out = np.zeros(int(keep.sum() + ends.sum()), np.int64)
        out[places] = self.words[keep] + 1
        return out

    def neighbours(self) -> np.ndarray:
        """Whether word i and i + 1 lie in one piece."""
        return self.piece[1:] == self.piece[:-1] if len(self.piece) else np.zeros(0, bool)

    def rows(self, index: WordIndex, intervals: np.ndarray, length: int) -> pa.RecordBatch:
        places, counts = index.patterns(intervals)
        parts = [self.vocabulary.take(pa.array(index.ids[places + i] - 1)) for i in range(length)]
        phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if length > 1 else parts[0]
        langs = self.langs[index.ids[places] - 1]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), phrase.cast(pa.string()), pa.array(counts, pa.int64())], names=["lang", "phrase", "a"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for part, data, offsets in slices(batches, 1, SHARD):
        filled = np.flatnonzero(np.diff(offsets))
        if len(filled):
            langs = np.array(part.column(0).to_pylist(), dtype=object)[filled]
            yield Shard(langs, [data[offsets[i]:offsets[i + 1]].tobytes() for i in filled])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for shard in _shards(batches):
        columns = [pa.array(shard.langs, pa.string()), shard.vocabulary.cast(pa.string()), pa.array(shard.counts, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "a"])


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def _bits(frequent: DataFrame, n: int, pairs: bool) -> np.ndarray:
    """The bit table of words or pairs: places are OR-ed together by Spark, at most MAX_BITS / 64 numbers reach the driver."""
    size = 1 << 10
    while size < 16 * n and size < MAX_BITS:
        size *= 2

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            langs = _hashes(batch.column(0))
            if pairs:
                halves = pc.split_pattern(batch.column(1), " ", max_splits=1)
                keys = _pair(_pair(langs, _hashes(pc.list_element(halves, 0))), _pair(langs, _hashes(pc.list_element(halves, 1))))
            else:
                keys = _pair(langs, _hashes(batch.column(1)))
            for found in bit_places(keys, np.uint64(size - 1)):
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64), pa.int64())], names=["place"])

    found = frequent.select("lang", "phrase").mapInArrow(places, "place bigint")
    merged = found.groupBy(F.shiftright("place", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("word")).toArrow()
    table = np.zeros(size // 64, np.uint64)
    table[merged.column("at").to_numpy()] = merged.column("word").to_numpy().view(np.uint64)
    return table


def phrase_counts(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """(totals, counts): words per lang as ``n``; every word and phrase of up to ``max_words`` words found ``min_count`` times as lang, phrase, size, a.

    A-Z count as a-z; pieces end at ``.,;:!?`` and line breaks, words at spaces and tabs. A null lang is ``und``; null and empty texts have no
    words; repeated rows count each time; very long texts become a shard of their own; an empty table gives empty results. Other columns are
    not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"), F.col(text_column).alias("text"))
    words = durable(_summed(rows.mapInArrow(_words, _COUNTS)), "words")
    totals = words.groupBy("lang").agg(F.sum("a").alias("n"))
    frequent = words.filter(F.col("a") >= min_count)
    word_bits = spark.sparkContext.broadcast(_bits(frequent, frequent.count(), pairs=False))

    def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = BitTable(word_bits.value)
        for shard in _shards(batches):
            known = table.has(shard.hashes())[shard.words]
            index = WordIndex(shard.ids(shard.neighbours() & known[1:] & known[:-1], 2), 2)
            yield shard.rows(index, index.extend_left(index.words()), 2)

    counts = [frequent]
    if max_words >= 2:
        pairs = durable(_summed(rows.mapInArrow(pair_rows, _COUNTS)).filter(F.col("a") >= min_count), "pairs")
        counts.append(pairs)
    if max_words >= 3:
        pair_bits = spark.sparkContext.broadcast(_bits(pairs, pairs.count(), pairs=True))

        def long_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = BitTable(pair_bits.value)
            for shard in _shards(batches):
                keys = shard.hashes()[shard.words]
                joined = shard.neighbours()
                joined[joined] = table.has(_pair(keys[:-1][joined], keys[1:][joined]))
                index = WordIndex(shard.ids(joined, 3), max_words)
                intervals = index.extend_left(index.words())
                for length in range(3, max_words + 1):
                    intervals = index.extend_left(intervals)
                    yield shard.rows(index, intervals, length)

        counts.append(durable(_summed(rows.mapInArrow(long_rows, _COUNTS)).filter(F.col("a") >= min_count), "phrases"))
    found = counts[0]
    for more in counts[1:]:
        found = found.unionByName(more)
    return totals, found.withColumn("size", F.size(F.split("phrase", " ")))


def collocations(
    docs: DataFrame, text_column: str = "text", lang_column: str = "lang", min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
) -> DataFrame:
    """The ``top`` phrases of 2 to ``max_words`` words per lang: lang, rank, phrase, a, l, r, n, score, left_most, right_most.

    A phrase's score is the smallest of floor(1000 * a * n / (l * r)) over its cuts; on a tie the smallest cut gives l and r. ``left_most`` and
    ``right_most`` count its commonest extension by a word before or after it (0: none found ``min_count`` times). A phrase goes if an
    extension is as frequent as itself; one that a longer phrase holds without loss has such an extension of one word. Ranks go by score, then a,
    both descending, then phrase. Nulls, empty and repeated rows as in ``phrase_counts``.
    """
    totals, counts = phrase_counts(docs, text_column, lang_column, min_count, max_words)
    parts = counts.select("lang", "phrase", "a", "size", F.split("phrase", " ").alias("_words"))
    longer = parts.filter("size >= 3")
    shorter = [longer.select("lang", F.array_join(F.expr(cut), " ").alias("phrase"), F.col("a").alias(side))
               for side, cut in (("left_most", "slice(_words, 2, size - 1)"), ("right_most", "slice(_words, 1, size - 1)"))]
    wider = shorter[0].unionByName(shorter[1], allowMissingColumns=True).groupBy("lang", "phrase").agg(F.max("left_most").alias("left_most"), F.max("right_most").alias("right_most"))
    kept = (
        parts.filter("size >= 2").join(wider, ["lang", "phrase"], "left").fillna(0, ["left_most", "right_most"])
        .filter(F.greatest("left_most", "right_most") < F.col("a"))
    )
    cuts = kept.withColumn("_cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).withColumns({
        "_left": F.array_join(F.expr("slice(_words, 1, _cut)"), " "), "_right": F.array_join(F.expr("slice(_words, _cut + 1, size - _cut)"), " ")})
    sides = counts.select("lang", "phrase", "a")
    cuts = (
        cuts.join(sides.select("lang", F.col("phrase").alias("_left"), F.col("a").alias("l")), ["lang", "_left"])
        .join(sides.select("lang", F.col("phrase").alias("_right"), F.col("a").alias("r")), ["lang", "_right"]).join(totals, "lang")
        .withColumn("score", F.expr("(cast(1000 * a as decimal(19, 0)) * cast(n as decimal(18, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(19, 0)))"))
    )
    scored = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "_cut", "l", "r")).alias("_best"), *[F.first(c).alias(c) for c in ("a", "n", "left_most", "right_most")])
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.select("lang", "phrase", "a", "_best.l", "_best.r", "n", "_best.score", "left_most", "right_most")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score", "left_most", "right_most")
