"""Quality rules with host verdicts, in DataFrame functions alone.

Per text: word and symbol counts, repeated lines, and words inside repeated 3-word windows. Per host: documents and rule failures,
added up before any shuffle; each host's failure rate is shrunk by a beta prior that is fitted to all hosts' counts. A host whose shrunken
rate, less two posterior deviations, is above ``host_limit`` fails with all its documents. Verdicts are joined back to the documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.plans.scale import durable

SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEATED = 50
#: More symbols than this share of the words: mark-up or noise.
MAX_SYMBOL_SHARE = 0.2
#: A host fails when it is clear that most of its documents do.
HOST_LIMIT = 0.5
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeated_words(windows: Column) -> Column:
    """Words that lie in a 3-word window found twice or more, from the sorted windows: equal neighbours are repeats."""
    same = lambda v, w: (v["2"] == w["2"]) & (v["1"] == w["1"]) & (v["0"] == w["0"])  # noqa: E731  the last word differs most often
    n = F.size(windows) - 1
    later = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    repeats = F.filter(later, lambda k: same(F.get(windows, k - 1), F.get(windows, k)))
    pairs = F.transform(repeats, lambda k: F.array(F.get(windows, k - 1)["i"], F.get(windows, k)["i"]))
    places = F.sort_array(F.array_distinct(F.flatten(pairs)))
    start = F.struct(F.lit(-3).alias("at"), F.lit(0).alias("n"))
    return F.aggregate(
        places, start, lambda acc, p: F.struct(p.alias("at"), (acc["n"] + F.least(F.lit(3), p - acc["at"])).alias("n")),
        lambda acc: acc["n"])


def with_features(rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """The ``keep`` columns with the per-text counts. Null texts have no words.

    Each array is a column of its own step, so that it is worked out once per row however often it is used.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    words = rows.select(
        *keep, F.array_remove(F.split(body, SPACE + "+"), "").alias("_w"),
        F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("_l"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
    )
    n = F.greatest(F.size("_w") - 2, F.lit(0))
    windows = words.select(
        *keep, F.size("_w").cast("bigint").alias("n_words"), F.char_length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        "n_symbols", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.sort_array(F.arrays_zip(
            F.slice("_w", 1, n).alias("0"), F.slice("_w", 2, n).alias("1"), F.slice("_w", 3, n).alias("2"),
            F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")).alias("i"),
        )).alias("_z"),
    )
    return windows.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(_repeated_words(F.col("_z")), F.lit(0)).cast("bigint").alias("n_repeat_words"))


def base_failed(min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))


def doc_failed(max_symbol_share: float = MAX_SYMBOL_SHARE) -> Column:
    """The base rules or too many symbols."""
    return base_failed() | (F.col("n_symbols") > max_symbol_share * F.col("n_words"))


def host_verdicts(rows: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n_docs, n_failed, rate, shrunken_rate, host_failed) from rows of (``_host``, ``_failed``).

    The prior's mean is the pooled failure rate; its weight comes from the spread of the hosts' rates beyond what sampling
    alone gives (method of moments, between 1 and 10 000 documents). Rows with a null host form one host.
    """
    hosts = rows.groupBy("_host").agg(F.count("*").alias("n_docs"), F.sum(F.col("_failed").cast("bigint")).alias("n_failed"))
    hosts = hosts.withColumn("rate", F.col("n_failed") / F.col("n_docs"))
    prior = hosts.agg(
        (F.sum("n_failed") / F.sum("n_docs")).alias("_m"), F.var_samp("rate").alias("_v"), F.avg(1 / F.col("n_docs")).alias("_inv"))
    sampling = F.col("_m") * (1 - F.col("_m")) * F.col("_inv")
    between = F.greatest(F.coalesce(F.col("_v"), F.lit(0.0)) - sampling, F.lit(1e-9))
    weight = F.least(F.greatest(F.col("_m") * (1 - F.col("_m")) / between - 1, F.lit(1.0)), F.lit(10_000.0))
    prior = prior.select("_m", weight.alias("_w"))
    joined = hosts.join(F.broadcast(prior))  # one row
    a, b = F.col("n_failed") + F.col("_m") * F.col("_w"), F.col("n_docs") - F.col("n_failed") + (1 - F.col("_m")) * F.col("_w")
    mean = a / (a + b)
    deviation = F.sqrt(mean * (1 - mean) / (a + b + 1))
    return joined.select(
        "_host", "n_docs", "n_failed", "rate", mean.alias("shrunken_rate"), (mean - 2 * deviation > host_limit).alias("host_failed"))


def failed_hosts(docs: DataFrame, host_column: str = "source", text_column: str = "text", host_limit: float = HOST_LIMIT) -> DataFrame:
    rows = with_features(docs.select(F.col(host_column).alias("_host"), F.col(text_column).alias("_text")), "_text", ["_host"])
    return host_verdicts(rows.select("_host", doc_failed().alias("_failed")), host_limit)


def quality(docs: DataFrame, id_column: str = "doc_id", host_column: str = "source", text_column: str = "text", host_limit: float = HOST_LIMIT) -> DataFrame:
    """One row per document row: id, the counts, ``base_failed``, ``doc_failed``, ``host_failed``, ``shrunken_rate`` and ``kept``.

    Null and empty texts have no words and fail; repeated rows count as documents of their own; only the three named columns
    are read. The counts are written once, without texts, and both the host table and the result come from them.
    """
    rows = docs.select(F.col(id_column).alias("_id"), F.col(host_column).alias("_host"), F.col(text_column).alias("_text"))
    rows = durable(with_features(rows, "_text", ["_id", "_host"]), "quality")
    marked = rows.withColumns({"base_failed": base_failed(), "_failed": doc_failed()})
    hosts = durable(host_verdicts(marked, host_limit).select(F.col("_host").alias("_h"), "shrunken_rate", "host_failed"), "hosts")
    joined = marked.join(hosts, F.col("_host").eqNullSafe(F.col("_h")), "left")
    return joined.select(
        F.col("_id").alias(id_column), *FEATURES, "base_failed", F.col("_failed").alias("doc_failed"), "host_failed", "shrunken_rate",
        (~F.col("_failed") & ~F.col("host_failed")).alias("kept"))


def kept_documents(docs: DataFrame, host_column: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The documents that pass, with their own columns. Texts are read twice and never shuffled: only failed hosts are joined."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    host, text = f"c{names.index(host_column)}", f"c{names.index('text')}"
    bad = durable(failed_hosts(plain, host, text, host_limit).filter("host_failed").select(F.col("_host").alias("_h")), "hosts")
    marked = with_features(plain, text, plain.columns).select(*plain.columns, doc_failed().alias("_failed"))
    # the one-row explode keeps the filter above the counts: pushed down, it would repeat them inside their own lambdas
    marked = marked.select(*plain.columns, F.explode(F.array("_failed")).alias("_out"))
    passed = marked.filter(~F.col("_out")).select(*plain.columns)
    return passed.join(bad, F.col(host).eqNullSafe(F.col("_h")), "left_anti").toDF(*names)
