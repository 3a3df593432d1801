"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names for every operator."""

import public_tokenizers
import pytest

from tests.llm import brute
from weftgraph.llm import bpe, chat, decontaminate, jaccard, licenses, quality, repeats, secrets, shards, toxicity

PROSE = " ".join(f"word{i % 97}x{i % 13}" for i in range(60))
LONG = " ".join(f"w{i}" for i in range(30_000)) + " token = abcdef0123456789"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _text string, _id string, n int, cls string"


def _rows():
    texts = [(1, PROSE), (1, PROSE), (2, PROSE), (3, None), (4, ""), (5, LONG), (None, PROSE), (6, "one two"), (7, " \t\n "), (8, "MIT License token: ABC_defg12345")]
    return [(i, t, None, None if i == 2 else "s", None, "x", "y", 1, None) for i, t in texts]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame(_rows(), SCHEMA)
    items = spark.createDataFrame([(1, " ".join(PROSE.split()[5:20])), (2, None), (3, ""), (None, "one two"), (1, "mit license")], "item_id bigint, text string")
    return docs, items


def _by_row(found, names):
    return sorted((tuple(r[n] for n in names) for r in found.collect()), key=str)


def test_texts_scanned_row_by_row(spark, tables):
    docs, items = tables
    texts = [(r[0], r[1]) for r in _rows()]
    words = [(r["item_id"], brute.ALNUM.findall(brute.lower(r["text"]))) for r in items.collect()]
    named = [(k, w) for k, w in words]
    mine = _by_row(decontaminate.report(decontaminate.contamination(docs, items)), ["doc_id", "n_words", "n_hit"])
    assert mine == sorted(((d, *brute.contamination(t, named)[:2]) for d, t in texts), key=str)
    mine = _by_row(licenses.report(licenses.scan_licenses(docs)), ["doc_id", "n_words", "n_base"])
    assert mine == sorted(((d, brute.base_places(t)[0], len(brute.base_places(t)[1])) for d, t in texts), key=str)
    mine = _by_row(secrets.report(secrets.scan_secrets(docs)), ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"])
    assert mine == sorted(((d, *brute.base_secrets(t)) for d, t in texts), key=str)
    mine = _by_row(quality.quality(docs), ["doc_id", *quality.FEATURES])
    assert mine == sorted(((d, *brute.features(t)) for d, t in texts), key=str)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = bpe.report(bpe.decode_ids(bpe.encode_texts(docs, path, public_tokenizers.PATTERN), path))
    assert _by_row(coded, ["doc_id", "decoded_sha256"]) == sorted(((d, brute.sha(t or "")) for d, t in texts), key=str)
    labels = spark.createDataFrame([(1, 1), (2, 0), (5, None), (None, 1)], "doc_id bigint, toxic int")
    found = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(found) == len(texts) and all(0 <= r["score"] <= 1 for r in found)


def test_groups(tables):
    docs, _ = tables
    texts = [(r[0], r[1]) for r in _rows()]
    mine = _by_row(jaccard.similar_documents(docs, 4, 85), ["doc_id", "n_shingles", "component_id"])
    theirs = [(d, n, c if n else d) for d, n, c in brute.components(texts, 4, 85)]
    assert mine == sorted(theirs, key=str)
    left = jaccard.without_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect() if r["doc_id"] is not None) == [1, 3, 4, 5, 6, 7, 8]
    found = {(r["doc_id"], r["start"], r["end"]) for r in repeats.repeated_passages(docs).collect()}
    assert found == {(1, 0, 60), (2, 0, 60), (None, 0, 60)}
    placed = shards.shard_documents(docs, 3).collect()
    sizes = [sum(r["shard"] == s for r in placed) for s in range(3)]
    assert len(placed) == len(texts) and max(sizes) - min(sizes) <= 1


def test_stages_keep_columns(tables):
    docs, items = tables
    for out in (quality.kept_documents(docs), decontaminate.decontaminated(docs, items), secrets.redacted(docs)):
        assert out.columns == docs.columns
    cut = {r["doc_id"]: r["text"] for r in secrets.redacted(docs).collect()}
    assert cut[8] == "MIT License [secret]" and cut[3] is None and "0123456789" not in cut[5]


def test_chat(spark):
    turns = [(1, 0, "user", None), (1, 0, "a\\b\nc", "<|im_end|>\n</s> <\\/s>"), (None, None, None, "x"), (1, 1, "assistant", "é" * 50_000), (1, 1, "assistant", "[INST]")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    pieces = chat.format_chats(df, piece=10)
    got = {r["conv_id"]: r for r in chat.digests(pieces).collect()}
    rows = [("a\\b\nc", turns[1][3]), ("user", ""), ("assistant", "[INST]"), ("assistant", "é" * 50_000)]
    assert got[1]["turns_sha256"] == brute.sha("".join(f"{a}\n{b}\n" for a, b in rows)) and got[1]["n_pieces"] > 1
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (50_006, brute.sha("[INST]" + "é" * 50_000))
    assert got[None]["n_turns"] == 1


def test_empty_tables(spark, tables):
    docs, items = (t.limit(0) for t in tables)
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    labels = spark.createDataFrame([], "doc_id bigint, toxic int")
    for out in (
        chat.digests(chat.format_chats(turns)), decontaminate.contamination(docs, items), licenses.scan_licenses(docs), secrets.scan_secrets(docs),
        quality.quality(docs), repeats.repeated_passages(docs), shards.shard_documents(docs), toxicity.score(docs, toxicity.train(docs, labels)),
        jaccard.similar_documents(docs),
    ):
        assert out.count() == 0
