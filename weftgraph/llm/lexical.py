"""Ranked lexical search: range-maximum tables over posting lists, best-first over document intervals.

Tasks cut their documents into blocks, each sorted by id. In a block every query term has a posting list of impacts and a sparse table that answers the
largest impact between two places. A query starts with the interval of all documents; an interval's bound is the sum of its terms' range
maxima. The interval with the largest bound is split at the document of its largest single impact, which is scored; parts whose bound cannot
reach the k-th score are dropped. Several intervals are split per step, which only adds work that was bounded anyway. Each task keeps k
documents a query, and one window takes the best of all tasks.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.words import ALNUM, scan, slices
from weftgraph.plans.scale import durable

TOP = 50
#: Documents and text bytes of one block.
BLOCK_DOCS = 4096
BLOCK_BYTES = 8 << 20
#: Query terms sent to the tasks at once (8 bytes each); more queries take further passes over the documents.
MAX_TERMS = 1 << 20
#: Intervals split per step.
STEP = 128

_LOW = (1 << 32) - 1


class Block:
    """Posting lists of some documents in id order: ``keys`` holds term * documents + document, ascending, ``impact`` belongs to it."""

    def __init__(self, ids: list, keys: np.ndarray, impact: np.ndarray) -> None:
        self.ids, self.n, self.keys, self.impact = ids, len(ids), keys, impact
        longest = int(np.bincount(keys // self.n).max()) if len(keys) else 1
        packed = (impact << 32) | (_LOW - np.arange(len(keys)))  # the first of equal impacts is the largest
        self.table = np.zeros((longest.bit_length(), len(keys)), np.int64)
        self.table[0] = packed
        for level in range(1, len(self.table)):  # entries that reach into the next list are never asked for
            half, whole = 1 << (level - 1), 1 << level
            below = self.table[level - 1]
            self.table[level, : len(keys) - whole + 1] = np.maximum(below[: len(keys) - whole + 1], below[half: len(keys) - half + 1])
        self.log = np.frexp(np.arange(longest + 1, dtype=np.float64))[1] - 1

    def bounds(self, base: np.ndarray, weights: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bound, document to split at) of intervals whose postings of each term are places a to b."""
        some = b > a
        level = self.log[np.maximum(b - a, 1)]
        left = np.where(some, a, 0)
        right = np.where(some, b - (1 << level), 0)
        best = np.maximum(self.table[level, left], self.table[level, right])
        share = np.where(some, (best >> 32) * weights, -1)
        lead = share.argmax(axis=1)
        row = np.arange(len(a))
        place = _LOW - (best[row, lead] & _LOW)
        return np.where(some, share, 0).sum(axis=1), self.keys[np.minimum(place, len(self.keys) - 1)] - base[lead]

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int, tie: int) -> list[tuple[int, int]]:
        """(score, document) of every document that can be among the best k: above ``least``, or equal to it and before document ``tie``."""
        if not len(self.keys):
            return []
        base = terms * self.n
        a, b = np.searchsorted(self.keys, base)[None, :], np.searchsorted(self.keys, base + self.n)[None, :]
        held = (b > a)[0]
        base, weights, a, b = base[held], weights[held], a[:, held], b[:, held]
        if not len(base):
            return []
        start = np.zeros(1, np.int64)
        bound, split = self.bounds(base, weights, a, b)
        found: list[tuple[int, int]] = []
        while True:
            alive = (bound > least) | ((bound == least) & (start < tie))
            if not alive.all():
                a, b, start, bound, split = a[alive], b[alive], start[alive], bound[alive], split[alive]
            if not len(bound):
                return found
            if len(bound) > STEP:
                chosen = np.argpartition(-bound, STEP)[:STEP]
                rest = np.ones(len(bound), bool)
                rest[chosen] = False
            else:
                chosen, rest = np.arange(len(bound)), np.zeros(len(bound), bool)
            want = base[None, :] + split[chosen, None]
            at = np.searchsorted(self.keys, want)
            there = self.keys[np.minimum(at, len(self.keys) - 1)] == want
            score = np.where(there, self.impact[np.minimum(at, len(self.keys) - 1)] * weights, 0).sum(axis=1)
            found.extend(zip(score.tolist(), split[chosen].tolist(), strict=True))
            if len(found) >= k:
                found = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
                if found[-1][0] > least or (found[-1][0] == least and found[-1][1] < tie):
                    least, tie = found[-1]
            below_a, below_b = np.concatenate([a[chosen], at + there]), np.concatenate([at, b[chosen]])
            below_start = np.concatenate([start[chosen], split[chosen] + 1])
            filled = (below_b > below_a).any(axis=1)
            below_a, below_b, below_start = below_a[filled], below_b[filled], below_start[filled]
            below_bound, below_split = self.bounds(base, weights, below_a, below_b)
            a, b = np.concatenate([a[rest], below_a]), np.concatenate([b[rest], below_b])
            start, bound, split = (np.concatenate([x[rest], y]) for x, y in ((start, below_start), (bound, below_bound), (split, below_split)))


def _lengths(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    if 50 * int(n.max(initial=0)) * n_docs < 1 << 63:
        return 50 + (50 * n * n_docs) // n_terms
    return np.array([50 + 50 * int(x) * n_docs // n_terms for x in n], np.int64)


def _postings(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms per document, document, term, occurrences) of some texts; the last three for terms of the lexicon only."""
    found = scan(data, offsets, ALNUM)
    at = np.minimum(np.searchsorted(lexicon, found.hash), len(lexicon) - 1)
    known = np.flatnonzero(lexicon[at] == found.hash)
    doc = np.searchsorted(found.first, known, side="right") - 1
    pairs, tf = np.unique(doc * len(lexicon) + at[known], return_counts=True)
    return np.diff(found.first), pairs // len(lexicon), pairs % len(lexicon), tf


def _terms(items: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """item, and the hashes of its distinct terms; rows that are equal in both columns count once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in slices(batches):
            found = scan(data, offsets, ALNUM)
            terms = [np.unique(found.hash[found.first[i]:found.first[i + 1]]).view(np.int64) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(terms, pa.list_(pa.int64()))], names=["item", "terms"])

    rows = items.select(F.col(id_column).alias("item"), F.col(text_column).alias("text")).dropDuplicates()
    schema = T.StructType([T.StructField("item", items.schema[id_column].dataType), T.StructField("terms", T.ArrayType(T.LongType()))])
    return rows.mapInArrow(run, schema).filter(F.size("terms") > 0)


def _one_pass(rows: DataFrame, items: pa.Table, k: int) -> DataFrame:
    """(row of ``items``, id, score) of the best k documents of every task."""
    spark = rows.sparkSession
    flat = items.column("terms").combine_chunks()
    lexicon, number = np.unique(flat.flatten().to_numpy().view(np.uint64), return_inverse=True)
    borders = np.concatenate([[0], np.cumsum(pc.list_value_length(flat).to_numpy())])
    queries = [number[borders[i]:borders[i + 1]] for i in range(len(flat))]
    shared = spark.sparkContext.broadcast(lexicon)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_docs = n_terms = 0
        holders = np.zeros(len(shared.value), np.int64)
        for _, data, offsets in slices(batches):
            n, _, term, _ = _postings(data, offsets, shared.value)
            n_docs, n_terms = n_docs + int((n > 0).sum()), n_terms + int(n.sum())
            holders += np.bincount(term, minlength=len(holders))
        used = np.flatnonzero(holders)
        yield pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([[-2, -1], used]), pa.int64()), pa.array(np.concatenate([[n_docs, n_terms], holders[used]]), pa.int64())], names=["term", "n"])

    sums = rows.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    totals = dict(zip(sums.column("term").to_pylist(), sums.column("n").to_pylist(), strict=True))
    n_docs, n_terms = totals.pop(-2, 0), totals.pop(-1, 0)
    weights = np.zeros(len(lexicon), np.int64)
    for term, holders in totals.items():
        weights[term] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holders + 1)))
    weighed = spark.sparkContext.broadcast((lexicon, weights, queries))
    id_type = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, weights, queries = weighed.value
        best: list[list[tuple[int, object]]] = [[] for _ in queries]
        order = lambda x: (-x[0], x[1] is None, 0 if x[1] is None else x[1])
        id_arrow = None
        for ids, n, doc, term, tf in _blocks(batches, lexicon):
            id_arrow = ids.type
            rank = pc.sort_indices(ids, null_placement="at_end").to_numpy()
            place = np.empty(len(rank), np.int64)
            place[rank] = np.arange(len(rank))
            names = ids.take(pa.array(rank)).to_pylist()
            filled = len(names) - ids.null_count
            keys = term * len(names) + place[doc]
            by_key = np.argsort(keys, kind="stable")
            impact = (1_000_000_000 * tf) // (1000 * tf + 20 * _lengths(n, n_docs, n_terms)[doc])
            block = Block(names, keys[by_key], impact[by_key])
            for query, terms in enumerate(queries):
                kept = best[query]
                least, tie = 0, 0
                if len(kept) == k:
                    least, last = kept[-1]
                    tie = len(names) if last is None else bisect_left(names, last, 0, filled)
                fresh = [(score, names[at]) for score, at in block.search(terms, weights[terms], k, least, tie) if score > 0]
                if fresh:
                    best[query] = sorted(kept + fresh, key=order)[:k]
        rows = [(query, name, score) for query, kept in enumerate(best) for score, name in kept]
        if rows:
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], id_arrow), pa.array(columns[2], pa.int64())], names=["query", "id", "score"])

    schema = T.StructType([T.StructField("query", T.LongType()), T.StructField("id", id_type), T.StructField("score", T.LongType())])
    names = spark.createDataFrame(pa.table({"query": np.arange(len(queries)), "item": items.column("item")}))
    return rows.mapInArrow(run, schema).join(names, "query")


def _blocks(batches: Iterator[pa.RecordBatch], lexicon: np.ndarray) -> Iterator[tuple]:
    """(ids, terms per document, and per posting: document, term, occurrences) of blocks of documents that hold any term."""
    parts: list[tuple] = []
    docs = size = 0

    def joined() -> tuple:
        shift = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])
        ids = pa.concat_arrays([p[0] for p in parts])
        doc = np.concatenate([p[2] + shift[i] for i, p in enumerate(parts)])
        return ids, np.concatenate([p[1] for p in parts]), doc, np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])

    for part, data, offsets in slices(batches):
        n, doc, term, tf = _postings(data, offsets, lexicon)
        for at in range(0, part.num_rows, BLOCK_DOCS):  # a slice may hold more texts than a block
            mine = slice(*np.searchsorted(doc, [at, at + BLOCK_DOCS]))
            if parts and (docs + min(BLOCK_DOCS, part.num_rows - at) > BLOCK_DOCS or size >= BLOCK_BYTES):
                yield joined()
                parts, docs, size = [], 0, 0
            parts.append((part.column(0).slice(at, BLOCK_DOCS), n[at:at + BLOCK_DOCS], doc[mine] - at, term[mine], tf[mine]))
            docs += len(parts[-1][0])
        size += len(data)
    if parts:
        yield joined()


def search(
    docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", item_text: str = "text",
    k: int = TOP, max_terms: int = MAX_TERMS,
) -> DataFrame:
    """The best k documents of every item: the item's column, ``rank`` (from 1), the document's id column, ``score`` (over 0, else no row).

    Terms are runs of letters and digits and everything beyond ASCII, with A-Z as a-z; an item's terms count once. Equal scores go by id, nulls last;
    repeated documents are ranked each, repeated items answered once, and items that share an id but not a text apart. Null and empty texts have
    no terms. Very long texts are scored whole, alone in their block. Empty tables give no rows. Other columns are not read.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    terms = durable(_terms(items, item_column, item_text), "items")
    total = terms.agg(F.sum(F.size("terms"))).first()[0] or 0
    passes = max(1, -(-2 * total // max_terms)) if total > max_terms else 1
    found = []
    for number in range(passes):
        part = terms.filter(F.pmod(F.xxhash64("item", "terms"), F.lit(passes)) == number).toArrow()
        if part.num_rows:
            found.append(_one_pass(rows, part, k).withColumn("_pass", F.lit(number)))
    names = [item_column, "rank", id_column, "score"]
    if not found:
        return terms.select(F.col("item").alias(names[0]), F.lit(1).alias("rank"), F.lit(None).cast(rows.schema["id"].dataType).alias(names[2]), F.lit(0).cast("bigint").alias("score")).limit(0)
    merged = reduce(DataFrame.unionByName, found)
    best = Window.partitionBy("_pass", "query").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = merged.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(names[0]), "rank", F.col("id").alias(names[2]), "score")


OP12_SQL = r"""
WITH words AS (
  SELECT doc_id, row, unnest(w) AS term, len(w) AS n FROM (
    SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents)
), totals AS (
  SELECT count(DISTINCT row) AS n_docs, count(*) AS n_terms FROM words
), tfs AS (
  SELECT doc_id, row, n, term, count(*) AS tf FROM words GROUP BY ALL
), queries AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tfs, totals GROUP BY term
), scores AS (
  SELECT item_id, doc_id, row, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM queries JOIN tfs USING (term) JOIN weights USING (term), totals GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
