"""Chunking and embedding of the documents, each seen as one entity."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import scalar as X
from weftgraph.operators import chunk as C
from weftgraph.operators import embed as E
from weftgraph.plans.scale import spread
from weftgraph.plans.views import table

MAX_TOKENS = 120


def entities(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents"))
    return d.select(
        F.concat(F.lit("doc"), "doc_id").alias("node_id"), F.lit("Function").alias("node_type"), F.concat(F.lit("d"), "doc_id").alias("name"),
        F.concat(F.lit("f/"), "source").alias("file_path"), F.col("source").alias("repo"), F.col("lang").alias("language"),
        F.lit(1).alias("start_line"), F.col("n_chars").cast("int").alias("end_line"), F.col("lang").alias("signature"),
        F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("/** "), "text")).otherwise("").alias("docstring"),
        F.col("text").alias("body"),
        F.when(F.col("n_chars") % 2 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>")).alias("annotations"),
        (F.col("n_chars") % 2 == 0).alias("exported"), F.create_map(F.lit("kind"), F.col("lang")).alias("props"))


def _chunks(spark, sf_dir):
    return C.chunk_nodes(entities(spark, sf_dir), MAX_TOKENS)


def _with_bare(nodes):
    """Each entity as it is and once more without signature and body, so that some have a docstring only and others no text at all."""
    bare = F.col("bare")
    return nodes.withColumn("bare", F.explode(F.array(F.lit(False), F.lit(True)))).withColumns({
        "node_id": F.when(bare, F.concat("node_id", F.lit("/bare"))).otherwise(F.col("node_id")),
        "signature": F.when(bare, "").otherwise(F.col("signature")), "body": F.when(bare, "").otherwise(F.col("body"))}).drop("bare")


def chunk_pieces(spark, sf_dir):
    return C.chunk_nodes(_with_bare(entities(spark, sf_dir)), MAX_TOKENS).filter("not startswith(content, '// Function: ') or not endswith(chunk_id, ':parent')").select(
        "chunk_id", F.sha2("content", 256).alias("content_hash"), "token_count", "parent_chunk_id", F.col("metadata")["exported"].alias("exported"))


def chunk_parents(spark, sf_dir):
    return _chunks(spark, sf_dir).filter("endswith(chunk_id, ':parent')").select(
        "chunk_id", F.sha2("content", 256).alias("content_hash"), "token_count", F.col("metadata")["total_chunks"].alias("total_chunks"), F.col("metadata")["kind"].alias("kind"))


def _texts(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


def _cache(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("lang = 'en'")
    return d.select(X.content_hash(X.embedding_input(F.col("text"))).alias("content_hash"), F.array(F.lit(1.0), F.lit(0.0)).alias("vector"),
                    F.when(F.col("n_chars") % 2 == 0, "m1").otherwise("m2").alias("model"))


def embed_cache_split(spark, sf_dir):
    return E.cache_split(_texts(spark, sf_dir), _cache(spark, sf_dir), "m1")


def _length_vectors(items):
    return [[0.0, float(len(t))] for t in items]


def embed_cached(spark, sf_dir):
    vectors, _ = E.embed(_texts(spark, sf_dir), _cache(spark, sf_dir), _length_vectors, "m1")
    return vectors.select("id", F.get("vector", F.lit(0)).alias("a"), F.get("vector", F.lit(1)).alias("b"))


def hashed_terms(spark, sf_dir):
    return E.hashed_terms(_texts(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


def hashed_embedding(spark, sf_dir):
    v = E.hashed_embedding(_texts(spark, sf_dir))
    return v.select("id", F.size("vector").alias("dims"), F.round(X.dot(F.col("vector"), F.col("vector")), 6).alias("norm"), F.round(F.get("vector", F.lit(5)), 6).alias("v5"))


QUERIES = {f.__name__: f for f in (chunk_pieces, chunk_parents, embed_cache_split, embed_cached, hashed_terms, hashed_embedding)}

def node_sql(max_tokens: int, more: str = "") -> str:
    return f"""WITH RECURSIVE n AS (SELECT 'doc' || doc_id AS id, 'd' || doc_id AS name, 'f/' || source AS file_path, n_chars, lang, source,
   lang AS sig, CASE WHEN n_chars % 3 = 0 THEN '/** ' || text ELSE '' END AS doc, text AS body FROM documents{more}),
 h AS (SELECT *, '// Function: ' || name || chr(10) || '// File: ' || file_path || chr(10) || '// Lines: 1-' || n_chars AS head,
   concat_ws(chr(10), CASE WHEN sig <> '' THEN '// Signature: ' || sig END, nullif(doc, ''), nullif(body, '')) AS raw FROM n),
 c AS (SELECT *, CASE WHEN regexp_replace(raw, '\\s', '', 'g') = '' THEN head || chr(10) || '// (no signature, docstring, or body captured)' ELSE raw END AS content FROM h),
 t AS (SELECT *, CAST(ceil(length(content) / 4.0) AS INT) AS tokens FROM c),
 ln AS (SELECT id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (SELECT id, string_split(content, chr(10)) AS l FROM t WHERE tokens > {max_tokens})),
 lt AS (SELECT *, CAST(ceil((length(line) + 1) / 4.0) AS INT) AS lt FROM ln),
 pk AS (SELECT id, i, lt AS cur, 0 AS idx FROM lt WHERE i = 1
   UNION ALL SELECT l.id, l.i, CASE WHEN p.cur + l.lt > {max_tokens} THEN l.lt ELSE p.cur + l.lt END, CASE WHEN p.cur + l.lt > {max_tokens} THEN p.idx + 1 ELSE p.idx END
   FROM pk p JOIN lt l ON l.id = p.id AND l.i = p.i + 1),
 pc AS (SELECT id, idx, string_agg(line, chr(10) ORDER BY i) AS content, sum(lt) AS tokens FROM pk JOIN lt USING (id, i) GROUP BY id, idx),
 pieces AS (SELECT id, 0 AS idx, content, tokens, CAST(NULL AS VARCHAR) AS parent FROM t WHERE tokens <= {max_tokens}
   UNION ALL SELECT pc.id, idx, CASE WHEN regexp_replace(pc.content, '\\s', '', 'g') = '' THEN head || chr(10) || '// (no signature, docstring, or body captured)' ELSE pc.content END, pc.tokens, pc.id || ':parent' FROM pc JOIN t USING (id))"""


_NODE = node_sql(MAX_TOKENS)
_BARE = """
   UNION ALL SELECT 'doc' || doc_id || '/bare', 'd' || doc_id, 'f/' || source, n_chars, lang, source, '', CASE WHEN n_chars % 3 = 0 THEN '/** ' || text ELSE '' END, '' FROM documents"""


def parent_sql(max_tokens: int) -> str:
    return f"""s AS (SELECT id, lang, source, concat_ws(chr(10), head, CASE WHEN sig <> '' THEN '// Signature: ' || sig END, CASE WHEN length(doc) > 500 THEN substr(doc, 1, 500) || '...' ELSE nullif(doc, '') END,
          CASE WHEN n_chars % 2 = 0 THEN '// Annotations: ' || lang || ', ' || source END) AS content FROM t WHERE tokens > {max_tokens})"""


ORACLES = {
    "chunk_pieces": node_sql(MAX_TOKENS, _BARE) + " SELECT id || ':' || idx AS chunk_id, sha256(p.content) AS content_hash, p.tokens AS token_count, parent AS parent_chunk_id, CASE WHEN n_chars % 2 = 0 THEN 'true' ELSE 'false' END AS exported FROM pieces p JOIN t USING (id)",
    "chunk_parents": _NODE + ", " + parent_sql(MAX_TOKENS) + """
        SELECT id || ':parent' AS chunk_id, sha256(content) AS content_hash, CAST(ceil(length(content) / 4.0) AS INT) AS token_count, (SELECT CAST(max(idx) + 1 AS VARCHAR) FROM pk WHERE pk.id = s.id) AS total_chunks, lang AS kind FROM s""",
    "embed_cache_split": "SELECT sha256(text) AS content_hash, bool_or(lang = 'en' AND n_chars % 2 = 0) AS cached FROM documents GROUP BY 1",
    "embed_cached": """WITH k AS (SELECT DISTINCT text FROM documents WHERE lang = 'en' AND n_chars % 2 = 0)
        SELECT doc_id AS id, CASE WHEN k.text IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS a, CASE WHEN k.text IS NULL THEN length(d.text)::DOUBLE ELSE 0.0::DOUBLE END AS b FROM documents d LEFT JOIN k ON k.text = d.text""",
    "hashed_terms": """WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents),
        c AS (SELECT id, CAST(('0x' || substr(md5(w), 1, 6)) AS INT) % 64 AS bucket, count(*) AS tf FROM w GROUP BY 1, 2)
        SELECT id, bucket, round(tf / sqrt(sum(tf * tf) OVER (PARTITION BY id)), 6) AS weight FROM c""",
    "hashed_embedding": """WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM documents),
        c AS (SELECT id, CAST(('0x' || substr(md5(w), 1, 6)) AS INT) % 64 AS bucket, count(*) AS tf FROM w GROUP BY 1, 2),
        s AS (SELECT id, sqrt(sum(tf * tf)) AS nm, sum(tf) FILTER (bucket = 5) AS t5 FROM c GROUP BY id)
        SELECT doc_id AS id, 64 AS dims, CASE WHEN nm IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS norm, coalesce(round(t5 / nm, 6), 0.0::DOUBLE) AS v5 FROM documents LEFT JOIN s ON s.id = doc_id""",
}
