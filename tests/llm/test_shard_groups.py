"""Shards per group of equal texts, with a hot group, groups below a quota and pairs that leave no row free."""

from collections import defaultdict

from pyspark.sql import functions as F

from weftgraph.llm import shards


def test_few_shards_per_group(spark):
    n, n_shards = 12_000, 40  # a third of one text, five texts of 200 rows, pairs; quota 300
    text = F.when(F.col("id") < 4000, F.lit("hot")).when(F.col("id") < 5000, F.concat(F.lit("mid "), F.col("id") % 5))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.otherwise(F.concat(F.lit("pair "), F.floor(F.col("id") / 2))).alias("text"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = shards.shard_documents(docs, n_shards).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(n))
    where, sizes, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    for r in found:
        where[texts[r["doc_id"]]].add(r["shard"])
        sizes[texts[r["doc_id"]]] += 1
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(n // n_shards)) for s in slots.values()) and len(slots) == n_shards
    assert all(r["group_size"] == sizes[texts[r["doc_id"]]] for r in found)
    assert len(where["hot"]) == 14
    assert all(len(where[f"mid {i}"]) == 1 for i in range(5))
    assert sum(len(s) > 1 for t, s in where.items() if t.startswith("pair")) < n_shards
