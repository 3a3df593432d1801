"""The pieces of documents hold every text whole, and the entities of which no text or only a docstring was captured."""

from weftgraph.catalog import chunks


def test_pieces_hold_whole_texts_and_entities_without_text(spark, tmp_path):
    docs = [(1, "alpha beta", "en", "s", 10), (2, "gamma\n" * 200, "de", "s", 1200), (3, "delta", "en", "t", 14), (4, "x" * 21, "fr", "t", 21)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    pieces = chunks.C.chunk_nodes(chunks._with_bare(chunks.entities(spark, str(tmp_path))), chunks.MAX_TOKENS).collect()
    content = {r["chunk_id"]: r["content"] for r in pieces}
    note = "// Function: d{0}\n// File: f/{1}\n// Lines: 1-{2}\n// (no signature, docstring, or body captured)"
    assert content["doc1:0"] == "// Signature: en\nalpha beta" and content["doc3:0"] == "// Signature: en\ndelta"
    assert content["doc1/bare:0"] == note.format(1, "s", 10) and content["doc3/bare:0"] == note.format(3, "t", 14)
    assert content["doc4:0"].count("x" * 21) == 2 and content["doc4/bare:0"] == "/** " + "x" * 21
    whole = [r for r in pieces if r["chunk_id"].startswith(("doc2:", "doc2/bare:")) and not r["chunk_id"].endswith(":parent")]
    assert sum(r["content"].count("gamma") for r in whole) == 600  # as docstring and body, and as docstring alone
    asked = {r["chunk_id"]: r for r in chunks.chunk_pieces(spark, str(tmp_path)).collect()}
    assert asked.keys() == {k for k in content if not k.endswith(":parent")} and asked["doc2/bare:1"]["parent_chunk_id"] == "doc2/bare:parent"
