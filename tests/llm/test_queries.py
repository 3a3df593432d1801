"""The registered queries on the smallest tables against plain versions."""


import duckdb
import pytest
import tiktoken

import __spark_entry__ as entry_point
from tests.llm import brute
from weftgraph.llm import bpe, queries

SF = "/root/testdata/sf0.001"


def rows(spark, name):
    return entry_point.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_chat_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    cursor = con.execute(queries.OP1_SQL)
    names = [d[0] for d in cursor.description]
    theirs = sorted(cursor.fetchall())
    mine = sorted(tuple(r[n] for n in names) for r in rows(spark, "op1_chat_formatting"))
    assert mine == theirs


def test_licenses(spark, docs):
    for r in rows(spark, "op2_license_scans"):
        n, base = brute.base_places(docs[r["doc_id"]])
        starts = [at for _, at in base]
        assert (r["n_words"], r["n_base"]) == (n, len(base))
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({label for label, _ in base}))
        assert {x for x in r["base_labels"].split(",")} - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_quality(spark, docs):
    for r in rows(spark, "op3_quality_rules"):
        f = brute.features(docs[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == f
        assert r["base_failed"] == (f[0] < 50 or 100 * f[4] > 50 * f[0])
        assert not (r["kept"] and r["base_failed"])


def test_secrets(spark, docs):
    for r in rows(spark, "op4_secret_scans"):
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == brute.base_secrets(docs[r["doc_id"]])


def test_decontamination(spark, docs):
    items = [(r["item_id"], brute.ALNUM.findall(brute.lower(r["text"]))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = rows(spark, "op5_benchmark_decontamination")
    assert any(r["contaminated"] for r in found)
    for r in found:
        assert tuple(r)[1:] == brute.contamination(docs[r["doc_id"]], items)


def test_jaccard(spark, docs):
    theirs = sorted(brute.components(sorted(docs.items()), 4, 85))
    assert sorted(map(tuple, rows(spark, "op6_ngram_jaccard_join"))) == theirs
    assert any(a != c for a, _, c in theirs)


def test_toxicity(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    found = [r for r in queries.op7_toxicity(spark, "/root/testdata/sf0.01").collect()]
    held = [r for r in found if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)


def test_bpe(spark, docs):
    import public_tokenizers

    ranks = bpe.read_ranks(public_tokenizers.path(queries.VOCABULARY))
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r in rows(spark, "op8_byte_level_bpe"):
        text = docs[r["doc_id"]] or ""
        ids = own.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == brute.sha(b"".join(i.to_bytes(4, "little") for i in ids))
        assert r["decoded_sha256"] == brute.sha(text)


def test_repeats(spark, docs):
    mine = {}
    for r in rows(spark, "op9_suffix_array_dedup"):
        mine.setdefault(r["doc_id"], set()).add((r["start"], r["end"]))
        assert r["other_id"] not in (None, r["doc_id"])
    assert mine == brute.repeated(docs.items(), 50)


def test_shards(spark, docs):
    found = rows(spark, "op10_sharding")
    assert sorted(r["doc_id"] for r in found) == sorted(docs)
    slots = {}
    for r in found:
        assert (r["size"], r["text_crc32"]) == (len((docs[r["doc_id"]] or "").encode()) + 16, brute.crc(docs[r["doc_id"]]))
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert set(slots) == set(range(40)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1


def test_pipeline(spark):
    found = rows(spark, "pipeline")
    assert found and all(r["round_trip"] for r in found)
    assert len({r["doc_id"] for r in found}) == len(found)
