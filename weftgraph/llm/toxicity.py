"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(bias + sum of term weights + sum over term pairs of the dot product of their factors), over the distinct chosen terms of a whole
text. Pair weights catch combinations that a sum of single weights misses.

The model is fitted on a bounded sample: labelled rows outside the held-out fifth, ``MAX_ROWS`` at most, in the order of a hash of
their ids. Terms are counted by label in Spark over all sampled texts and the ``TERMS`` with the largest chi-square are
chosen (a parameter of the model); only their numbers per sampled row reach the driver, where the fit runs. Scoring covers every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.words import ALNUM, scan, slices
from weftgraph.plans.scale import durable

MAX_ROWS = 20_000
TERMS = 1024
FACTORS = 8
BUCKETS = 1 << 22
#: A term in fewer sampled rows is not chosen.
MIN_ROWS = 3
EPOCHS = 30


class Model(NamedTuple):
    terms: np.ndarray  # sorted buckets
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, docs: np.ndarray, terms: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts from (text, term number) pairs without repeats."""
        linear = self.bias + np.bincount(docs, self.weights[terms], n)
        pairs = np.zeros(n)
        for f in range(self.factors.shape[1]):
            v = self.factors[terms, f]
            pairs += np.bincount(docs, v, n) ** 2 - np.bincount(docs, v * v, n)
        return 1 / (1 + np.exp(-np.clip(linear + pairs / 2, -30, 30)))


def remainder(id_column: Column) -> Column:
    return F.crc32(id_column.cast("string").cast("binary")) % 5


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) pairs without repeats, by text."""
    words = scan(data, offsets, ALNUM)
    docs = np.repeat(np.arange(len(offsets) - 1), np.diff(words.first))
    pairs = np.unique(docs.astype(np.uint64) * np.uint64(BUCKETS) + words.hash % np.uint64(BUCKETS))
    return (pairs // np.uint64(BUCKETS)).astype(np.int64), (pairs % np.uint64(BUCKETS)).astype(np.int64)


def _term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in slices(batches):
        docs, terms = _buckets(data, offsets)
        bounds = np.searchsorted(docs, np.arange(rows.num_rows + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(terms, pa.int64()))
        yield pa.RecordBatch.from_arrays([rows.column(0), lists], names=["label", "terms"])


def sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, max_rows: int) -> DataFrame:
    """(label, terms) of the sampled labelled rows; ids of at most ``max_rows`` rows are broadcast, texts stay where they are."""
    chosen = labels.select(F.col(id_column).alias("_id"), F.col(label_column).cast("int").alias("_label")).dropna().filter(remainder(F.col("_id")) != 0)
    chosen = chosen.groupBy("_id").agg(F.max("_label").alias("_label"))  # a row labelled twice counts once, as 1 if any label is
    chosen = durable(chosen.orderBy(F.xxhash64("_id"), "_id").limit(max_rows), "sample")
    rows = docs.select(F.col(id_column).alias("_doc"), F.col(text_column).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
    return durable(rows.select("_label", "_text").mapInArrow(_term_lists, "label int, terms array<bigint>"), "terms")


def choose_terms(rows: DataFrame, terms: int = TERMS, min_rows: int = MIN_ROWS) -> np.ndarray:
    """Buckets with the largest chi-square against the label."""
    totals = rows.agg(F.sum(F.col("label")).alias("p"), F.count("*").alias("n")).first()
    p, n = totals["p"] or 0, totals["n"]
    if not p or p == n:
        return np.zeros(0, np.int64)
    counts = rows.select("label", F.explode("terms").alias("t")).groupBy("t").agg(F.sum("label").alias("a"), F.count("*").alias("m"))
    a, m = F.col("a").cast("double"), F.col("m").cast("double")
    chi = n * (a * (n - p) - (m - a) * p) ** 2 / (m * (n - m) * p * (n - p))
    best = counts.filter((F.col("m") >= min_rows) & (F.col("m") < n)).orderBy(chi.desc(), "t").limit(terms)
    return np.sort(np.array([r["t"] for r in best.select("t").collect()], np.int64))


def fit(rows: list[tuple[int, list[int]]], terms: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Adam on the log loss over mini-batches of the sampled rows, given as (label, term numbers)."""
    rng = np.random.default_rng(7)
    labels = np.array([y for y, _ in rows], np.float32)
    positive = float(labels.sum())
    bias = float(np.log((positive + 0.5) / (len(rows) - positive + 1.5)))
    w, v = np.zeros(len(terms), np.float32), rng.normal(0, 0.02, (len(terms), factors)).astype(np.float32)
    if not len(terms) or not rows:
        return Model(terms, bias, w, v)
    state = [np.zeros_like(x) for x in (w, v, w, v)]
    step, size = 0, 256
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), size):
            part = order[at:at + size]
            x = np.zeros((len(part), len(terms)), np.float32)
            for i, k in enumerate(part):
                x[i, rows[k][1]] = 1
            used = np.flatnonzero(x.any(0))
            x = x[:, used]
            s = x @ v[used]
            z = bias + x @ w[used] + ((s ** 2) - x @ (v[used] ** 2)).sum(1) / 2
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[part]) / len(part)
            bias -= rate * float(error.sum())
            gw, gv = np.zeros_like(w), np.zeros_like(v)
            gw[used] = x.T @ error
            gv[used] = x.T @ (error[:, None] * s) - v[used] * (x.T @ error)[:, None]
            step += 1
            for k, (value, gradient) in enumerate(((w, gw), (v, gv))):
                gradient += decay * value
                state[k] = 0.9 * state[k] + 0.1 * gradient
                state[k + 2] = 0.99 * state[k + 2] + 0.01 * gradient ** 2
                value -= rate * (state[k] / (1 - 0.9 ** step)) / (np.sqrt(state[k + 2] / (1 - 0.99 ** step)) + 1e-6)
    return Model(terms, bias, w.astype(np.float64), v.astype(np.float64))


def train(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic",
    max_rows: int = MAX_ROWS, terms: int = TERMS,
) -> Model:
    """Model of the labels outside the held-out fifth. Null ids and labels are left out; without labels of both kinds every score is the prior."""
    rows = sample(docs, labels, id_column, text_column, label_column, max_rows)
    chosen = choose_terms(rows, terms)
    wanted = F.array(*[F.lit(int(t)) for t in chosen]).cast("array<bigint>") if len(chosen) else F.array().cast("array<bigint>")
    kept = rows.select("label", F.array_sort(F.array_intersect("terms", wanted)).alias("terms"))
    table = kept.toArrow()  # at most max_rows rows of at most ``terms`` numbers
    lists = [np.searchsorted(chosen, np.array(x, np.int64)).tolist() for x in table.column("terms").to_pylist()]
    order = sorted(zip(table.column("label").to_pylist(), lists, strict=True))  # the same fit whatever order rows come in
    return fit(order, chosen)


def score(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ``held_out``, ``score``, ``predicted``, ``n_terms``) per row. Null and empty texts get the prior's score; a null id is not held out;
    repeated rows get a score each; only the id and text columns are read, and the id never enters the score."""
    shipped = docs.sparkSession.sparkContext.broadcast(tuple(model))
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_ = Model(*shipped.value)
        for part, data, offsets in slices(batches):
            docs_, terms = _buckets(data, offsets)
            if len(model_.terms):
                at = np.minimum(np.searchsorted(model_.terms, terms), len(model_.terms) - 1)
                known = model_.terms[at] == terms
                docs_, at = docs_[known], at[known]
            else:
                docs_, at = docs_[:0], terms[:0]
            result = model_.scores(docs_, at, part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(result), pa.array(np.bincount(docs_, minlength=part.num_rows))], names=["_id", "score", "n_terms"])

    scored = rows.mapInArrow(run, f"_id {docs.schema[id_column].dataType.simpleString()}, score double, n_terms bigint")
    return scored.select(
        F.col("_id").alias(id_column), F.coalesce(remainder(F.col("_id")) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_terms")
