"""Host verdicts: one bad host beside clean ones."""

from weftgraph.llm import quality

GOOD = " ".join(f"word{i}" for i in range(60))


def test_a_host_of_mostly_failing_documents_fails(spark):
    rows = [(i, GOOD if i % 100 >= 85 else "too short", "bad") for i in range(100)]
    rows += [(1000 * h + i, GOOD if i % 20 else "too short", f"host{h}") for h in range(1, 11) for i in range(100)]
    rows += [(50_000 + i, GOOD if i < 60 else "too short", "mixed") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r for r in quality.quality(docs).collect()}
    assert not any(found[i]["kept"] for i in range(100)) and found[99]["host_failed"] and not found[99]["base_failed"]
    assert all(r["kept"] == (not r["base_failed"]) and not r["host_failed"] for i, r in found.items() if i >= 100)
    assert {r["source"] for r in quality.kept_documents(docs).collect()} == {*(f"host{h}" for h in range(1, 11)), "mixed"}
