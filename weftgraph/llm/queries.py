"""Registered queries of this subpackage: thin digests over the operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import bpe, chat, decontaminate, extraction, jaccard, lexical, licenses, phrases, quality, repeats, secrets, shards, toxicity
from weftgraph.llm.phrase_sql import OP11_SQL

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(probe).alias("text"))
    return chat.digests(chat.format_chats(turns.unionByName(extra)))


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan_licenses(_table(spark, sf_dir, "documents")))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan_secrets(_table(spark, sf_dir, "documents")))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op8_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    encoded = bpe.encode_texts(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return bpe.report(bpe.decode_ids(encoded, path))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeated_passages(_table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(_table(spark, sf_dir, "documents"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.main_texts(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting, op2_license_scans, op3_quality_rules, op4_secret_scans, op5_benchmark_decontamination, op6_ngram_jaccard_join,
        op7_toxicity, op8_byte_level_bpe, op9_suffix_array_dedup, op10_sharding, op11_phrase_collocations,
        op12_ranked_lexical_search, op13_html_extraction, pipeline,
    )
}

_ESCAPED = "length(regexp_replace({}, '([<\\[]\\\\*)(\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|s>|/s>|INST\\]|/INST\\]|<SYS>>|</SYS>>)', '\\1\\\\\\2', 'g'))"

# the template adds 12 + 1 + 11 characters a turn
OP1_SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), ordered AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS body,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS masked,
    sum(24 + length(role) + {_ESCAPED.format('text')}) AS formatted
  FROM turns GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(body) AS turns_sha256, length(masked) AS loss_chars, sha256(masked) AS loss_sha256,
  CAST(formatted AS BIGINT) AS formatted_chars, CAST(1 AS BIGINT) AS n_pieces
FROM ordered
"""

ORACLES: dict[str, str] = {"op1_chat_formatting": OP1_SQL, "op11_phrase_collocations": OP11_SQL, "op12_ranked_lexical_search": lexical.OP12_SQL}
