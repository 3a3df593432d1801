"""Passages that repeat across documents, by sparse suffixes.

1. Only suffixes at minimiser positions are kept: a position is kept when the hash of its next ``ANCHOR`` words is the smallest among
   ``min_words - ANCHOR + 1`` neighbours. Which ones are kept follows from the words alone, so two copies of a passage of
   ``min_words`` or more words keep the same positions, at least one.
2. Suffixes are shuffled and sorted by their first words, and neighbours are compared: those that no other text has go.
3. The others are extended: every window of ``min_words`` words that contains such a suffix's first words is sorted and compared in the
   same way; windows that another text has too are joined to maximal spans to the left and right.

Texts of equal words are one class and enter once; their documents repeat as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.words import NONSPACE, grams, scan, slices
from weftgraph.plans.scale import durable

MIN_WORDS = 50
ANCHOR = 25
#: Kept positions that may be broadcast with their text ids (some 100 MB); beyond, texts are shuffled.
BROADCAST_POSITIONS = 4_000_000
SEEN = 200_000


def minimisers(hashes: np.ndarray, anchor: int, span: int) -> np.ndarray:
    """Positions whose ``anchor``-word hash is the smallest (leftmost among equals) in some run of ``span`` positions."""
    keys = grams(hashes, anchor)
    if len(keys) < span:
        return np.zeros(0, np.int64)
    best, width = np.arange(len(keys)), 1
    while width < span:  # doubling, the last step overlapping
        step = min(width, span - width)
        a, b = best[:len(best) - step], best[step:]
        best = np.where(keys[b] < keys[a], b, a)
        width += step
    return np.unique(best)


def text_class(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def _suffixes(anchor: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows, data, offsets in slices(batches):
            words = scan(data, offsets, NONSPACE)
            classes, keys, places = [], [], []
            first = words.first.tolist()
            for a, b in zip(first, first[1:], strict=False):
                mine = words.hash[a:b]
                cls = text_class(mine)
                classes.append(cls)
                if b - a < anchor + span - 1 or cls in seen:
                    keys.append(None)
                    places.append(None)
                    continue
                if len(seen) < SEEN:
                    seen.add(cls)
                at = minimisers(mine, anchor, span)
                keys.append(grams(mine, anchor)[at].view(np.int64))
                places.append(at.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.diff(words.first), pa.int64()), pa.array(classes, pa.int64()),
                 pa.array(keys, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32()))],
                names=["_id", "n_words", "cls", "keys", "places"])

    return run


_ROW = np.dtype([("key", np.int64), ("cls", np.int64), ("pos", np.int32)])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys that two or more classes have, each with the smallest class, or for that one the next. Input is sorted by (key, cls).

    The rows of the open key's smallest class are held until another class comes (one text's places), all others stream through.
    """
    held = np.empty(0, _ROW)
    open_key = low = None  # a key whose first class has been written
    for batch in batches:
        fresh = np.empty(batch.num_rows, _ROW)
        for i, name in enumerate(_ROW.names):
            fresh[name] = batch.column(i).to_numpy()
        rows = np.concatenate([held, fresh])
        if len(rows) == 0:
            continue
        starts = np.flatnonzero(np.append(True, rows["key"][1:] != rows["key"][:-1]))
        group = np.cumsum(np.append(True, rows["key"][1:] != rows["key"][:-1])) - 1
        least = rows["cls"][starts]
        shown = np.zeros(len(starts), bool)
        if open_key is not None and rows["key"][0] == open_key:
            least[0], shown[0] = low, True
        other = rows["cls"] != least[group]
        at = np.flatnonzero(other)
        second = np.zeros(len(starts), np.int64)
        second[group[at[::-1]]] = rows["cls"][at[::-1]]  # the first other class of each key
        shown[group[at]] = True
        keep = shown[group]
        last = len(starts) - 1
        if shown[last]:
            open_key, low, held = rows["key"][-1], least[last], np.empty(0, _ROW)
        else:
            open_key, held = None, rows[starts[last]:].copy()
        if keep.any():
            out, g = rows[keep], group[keep]
            partner = np.where(out["cls"] == least[g], second[g], least[g])
            yield pa.RecordBatch.from_arrays([pa.array(out["cls"]), pa.array(out["pos"]), pa.array(partner)], names=["cls", "pos", "other"])


def _windows(anchor: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in slices(batches, 2):
            words = scan(data, offsets, NONSPACE)
            keys, classes, places = [], [], []
            cls, kept = rows.column(0).to_numpy(), rows.column(1)
            for i, (a, b) in enumerate(zip(words.first.tolist(), words.first.tolist()[1:], strict=False)):
                mine = words.hash[a:b]
                n = len(mine) - min_words + 1
                if n <= 0 or text_class(mine) != cls[i]:  # a repeated id may bring another text along
                    continue
                at = kept[i].values.to_numpy()
                wanted = np.zeros(n + 1, np.int32)
                np.add.at(wanted, np.clip(at + anchor - min_words, 0, n), 1)
                np.add.at(wanted, np.clip(at + 1, 0, n), -1)
                starts = np.flatnonzero(np.cumsum(wanted[:-1]) > 0)
                keys.append(grams(mine, min_words)[starts].view(np.int64))
                classes.append(np.full(len(starts), cls[i]))
                places.append(starts.astype(np.int32))
            if keys:
                columns = [np.concatenate(keys), np.concatenate(classes), np.concatenate(places)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "cls", "pos"])

    return run


def repeated_passages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> DataFrame:
    """Rows (id, ``start``, ``end``, ``n_words``, ``other_id``): maximal spans of words, ``min_words`` or longer, of which every window of ``min_words``
    words is in another document too; ``other_id`` is a document that has one of them. Words are runs of characters other than white space,
    ``A-Z`` as ``a-z``.

    Texts with the same words repeat as a whole; a passage that repeats only inside one document is no repeat. Null and short texts have
    none. Rows that share an id and its words are one document; null ids take part but are never named as the other. Other columns are not read.
    """
    span = min_words - anchor + 1
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    schema = f"_id {id_type}, n_words bigint, cls bigint, keys array<bigint>, places array<int>"
    found = durable(rows.mapInArrow(_suffixes(anchor, span), schema), "suffixes")
    suffixes = found.filter("keys IS NOT NULL").select("cls", F.explode(F.arrays_zip("keys", "places")).alias("s"))
    suffixes = suffixes.select(F.col("s.keys").alias("key"), "cls", F.col("s.places").alias("pos"))
    suffixes = suffixes.repartition("key").sortWithinPartitions("key", "cls", "pos")
    kept = durable(suffixes.mapInArrow(_shared, "cls bigint, pos int, other bigint"), "kept")

    classes = durable(found.filter(F.col("n_words") >= min_words).groupBy("cls").agg(
        F.min("_id").alias("rep"), F.max("_id").alias("_top"), F.first("n_words").alias("n_words")), "classes")
    places = kept.groupBy("cls").agg(F.sort_array(F.collect_set("pos")).alias("at"))  # one text's positions
    places = durable(places.join(classes.select("cls", "rep"), "cls"), "places")
    side = places.withColumnRenamed("cls", "_cls")
    side = F.broadcast(side) if kept.count() <= BROADCAST_POSITIONS else side
    texts = rows.join(side, F.col("_id").eqNullSafe(F.col("rep"))).select(F.col("_cls").alias("cls"), "at", "_text")
    windows = texts.mapInArrow(_windows(anchor, min_words), "key bigint, cls bigint, pos int")
    windows = windows.repartition("key").sortWithinPartitions("key", "cls", "pos")
    hits = windows.mapInArrow(_shared, "cls bigint, pos int, other bigint").groupBy("cls", "pos").agg(F.min("other").alias("other"))
    by = Window.partitionBy("cls").orderBy("pos")
    marked = hits.withColumn("_new", (F.col("pos") > F.lag("pos").over(by) + min_words).cast("int"))
    marked = marked.withColumn("_span", F.sum(F.coalesce("_new", F.lit(0))).over(by))
    spans = marked.groupBy("cls", "_span").agg(
        F.min("pos").cast("bigint").alias("start"), (F.max("pos") + min_words).cast("bigint").alias("end"), F.min("other").alias("other"))
    spans = spans.join(classes.select(F.col("cls").alias("other"), F.col("rep").alias("other_id")), "other", "left").select("cls", "start", "end", "other_id")
    alone = classes.filter(F.col("rep").eqNullSafe(F.col("_top"))).select("cls")
    whole = classes.filter(~F.col("rep").eqNullSafe(F.col("_top"))).select(
        "cls", F.lit(0).cast("bigint").alias("start"), F.col("n_words").alias("end"), F.lit(None).cast(id_type).alias("other_id"), "rep", "_top")
    spans = spans.join(alone, "cls", "left_semi").select("*", F.lit(None).cast(id_type).alias("rep"), F.lit(None).cast(id_type).alias("_top")).unionByName(whole)
    spans = durable(spans, "spans")
    ids = found.select("_id", "cls").distinct()
    out = ids.join(spans, "cls").withColumn(
        "other_id", F.coalesce("other_id", F.when(F.col("_id").eqNullSafe(F.col("rep")), F.col("_top")).otherwise(F.col("rep"))))
    return out.select(F.col("_id").alias(id_column), "start", "end", (F.col("end") - F.col("start")).alias("n_words"), "other_id")
