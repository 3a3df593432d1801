"""The corpus pipeline: documents through five stages, each written as Parquet and read again by the next.

Each stage works on all rows that the stage before kept, and takes effect: failed documents go, one document of each group of near-duplicates
stays, benchmark passages are cut out, secrets are replaced, and the last stage returns token ids. Documents with null ids or texts, repeated rows
and empty tables pass through as each operator's docstring says.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, decontaminate, jaccard, quality, secrets
from weftgraph.plans.scale import new_path

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the text rules and whose host passes."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group at 0.8 or more over five-word shingles: the one with the smallest id."""
    return jaccard.without_copies(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages; those made up of them for the most part go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with secrets replaced by a placeholder."""
    return secrets.redacted(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the number of tokens, the packed ids, and whether decoding gives the text back."""
    path = public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode_texts(docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], round_trip=True)
    n_tokens = F.floor(F.octet_length("ids") / 4).cast("bigint").alias("n_tokens")
    return encoded.select("doc_id", "lang", "source", n_tokens, "ids", "round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("byte-level BPE", tokens),
]

#: SQL can express neither the trained secret model nor the encoder; tests compare the first three stages with plain versions, and the last with its round trip.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the tables between them go to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = new_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{number}")
            docs = spark.read.parquet(f"{base}/{number}")
    return docs
