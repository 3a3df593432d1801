"""Cached batch embedding with a user callback, and an offline hashed embedding."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.scalar import content_hash, embedding_input, tokens
from weftgraph.plans.scale import durable

EmbedFn = Callable[[Sequence[str]], Sequence[Sequence[float]]]


def _text_key(c):
    """Content hash as a join key: declared non-NULL, so that no null filter hashes the text a second time."""
    return F.coalesce(content_hash(c), F.lit(""))


def cache_split(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct content hashes with ``cached``: whether (hash, model) is already stored."""
    hashed = texts.select(_text_key(embedding_input(F.col("text"))).alias("content_hash")).distinct()
    known = cache.filter(F.col("model") == model).select("content_hash", F.lit(True).alias("cached")).distinct()
    return hashed.join(known, "content_hash", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def embed(texts: DataFrame, cache: DataFrame, embed_fn: EmbedFn, model: str, batch: int = 100, attempts: int = 3) -> tuple[DataFrame, DataFrame]:
    """(id, vector) for ``texts(id, text)`` and the new cache rows. Each distinct unknown text is embedded once."""
    keyed = texts.select("id", embedding_input(F.col("text")).alias("text")).withColumn("content_hash", _text_key(F.col("text")))
    known = cache.filter(F.col("model") == model).groupBy("content_hash").agg(F.any_value("vector").alias("vector"))
    missing = keyed.join(known, "content_hash", "left_anti").groupBy("content_hash").agg(F.any_value("text").alias("text"))
    schema = T.StructType([T.StructField("content_hash", T.StringType()), T.StructField("vector", T.ArrayType(T.DoubleType()))])

    def call(items: list[str]) -> list:
        for attempt in range(attempts):
            try:
                return [list(map(float, v)) for v in embed_fn(items)]
            except Exception:  # back off, then give up on the last attempt
                if attempt == attempts - 1:
                    raise
                time.sleep(2 ** attempt)
        return []

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i:i + batch]
                yield pd.DataFrame({"content_hash": part["content_hash"].values, "vector": call(part["text"].tolist())})

    # the model must not run twice for the join and the cache write
    fresh = durable(missing.mapInPandas(run, schema), "embedded")
    vectors = known.unionByName(fresh)
    rows = fresh.select("content_hash", "vector", F.lit(model).alias("model"), F.current_timestamp().alias("created_at"))
    return keyed.select("id", "content_hash").join(vectors, "content_hash").select("id", "vector"), rows


def hashed_terms(texts: DataFrame, dims: int = 64) -> DataFrame:
    """Sparse L2-normalised hashed term frequencies: (id, bucket, weight)."""
    words = texts.select("id", F.explode(tokens(F.col("text"))).alias("w"))
    bucket = F.conv(F.substring(F.md5("w"), 1, 6), 16, 10).cast("int") % dims
    counts = words.groupBy("id", bucket.alias("bucket")).agg(F.count("*").alias("tf"))
    norms = counts.groupBy("id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    return counts.join(norms, "id").select("id", "bucket", (F.col("tf") / F.col("norm")).alias("weight"))


def hashed_embedding(texts: DataFrame, dims: int = 64) -> DataFrame:
    """Dense vectors of ``hashed_terms``; a text without words gets zeros."""
    sparse = hashed_terms(texts, dims).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "weight"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda b: F.coalesce(F.col("m")[b], F.lit(0.0)))
    zeros = F.array_repeat(F.lit(0.0), dims)
    return texts.select("id").join(sparse, "id", "left").select("id", F.when(F.col("m").isNull(), zeros).otherwise(filled).alias("vector"))
