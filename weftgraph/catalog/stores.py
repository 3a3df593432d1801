"""Sources, sinks, checks and streams over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import scalar as X
from weftgraph.operators import audit as A
from weftgraph.operators import chunk as C
from weftgraph.operators import extract as E
from weftgraph.operators import limits as L
from weftgraph.operators import link as K
from weftgraph.operators import summary as Y
from weftgraph.catalog.chunks import entities, node_sql, parent_sql
from weftgraph.catalog.code import java_files, ts_files
from weftgraph.catalog.policies import LIMITS, log
from weftgraph.plans.scale import durable, new_path, spread
from weftgraph.plans.views import graph_sql, sql_over, star_graph, star_nodes, table
from weftgraph.sources import audit_log, files as S, tables as T
from weftgraph.streaming import audit as SA, limits as SL

PATH_SQL = """SELECT concat('src/', lower(p_type), CASE p_size % 9 WHEN 0 THEN '/node_modules/a/b' WHEN 1 THEN '/__tests__' WHEN 2 THEN '/build' WHEN 3 THEN '/my_build' ELSE '' END,
   '/', replace(p_name, ' ', '-'), p_partkey, CASE p_size % 5 WHEN 0 THEN '.test' ELSE '' END, CASE p_size % 4 WHEN 0 THEN '.tsx' WHEN 1 THEN '.java' WHEN 2 THEN '.md' ELSE '.ts' END) AS path FROM part"""


def path_selection(spark, sf_dir):
    return S.with_language(S.select_paths(sql_over(spark, sf_dir, PATH_SQL, ["part"]), "path", ["**/*.ts", "**/*.tsx", "**/*.java"]))


def _raw(spark, sf_dir):
    """Documents as raw files; some with broken bytes, some in no supported language."""
    d = table(spark, sf_dir, "documents")
    ext = F.when(F.col("n_chars") % 5 == 0, ".txt").when(F.col("n_chars") % 2 == 0, ".ts").otherwise(".java")
    body = F.encode("text", "UTF-8")
    data = F.when(F.col("n_chars") % 4 == 1, F.concat(body, F.unhex(F.lit("FFFE")))).otherwise(body)
    return d.select(F.col("source").alias("repo"), F.concat(F.lit("src/d"), "doc_id", ext).alias("path"), F.octet_length(data).cast("bigint").alias("length"), data.alias("content"))


def read_sources(spark, sf_dir):
    good, _ = S.read_sources(_raw(spark, sf_dir))
    return good.select("repo", "path", "language", F.sha2("content", 256).alias("hash"), "n_bytes", "n_lines")


def read_errors(spark, sf_dir):
    return S.read_sources(_raw(spark, sf_dir))[1]


def _requests(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("repo"), F.concat(F.when(F.col("doc_id") % 3 == 0, "/src/d").when(F.col("doc_id") % 3 == 1, "d").otherwise("missing/"), "doc_id").alias("file_path"))


def _tree(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("repo"), F.concat(F.lit("src/d"), "doc_id").alias("path"), F.col("text").alias("content"))


def file_content(spark, sf_dir):
    found = S.file_content(_tree(spark, sf_dir), _requests(spark, sf_dir), ["", "src"], 1000)
    return found.select("repo", "file_path", "found", "resolved", F.sha2("content", 256).alias("hash"))


def verify_files(spark, sf_dir):
    found = S.verify_files(_tree(spark, sf_dir), _requests(spark, sf_dir), 1500)
    return found.select("repo", "file_path", "exists", "lines", "chars", "bytes", F.sha2("content", 256).alias("hash"))


def upsert_repos(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    old = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.lit("old").alias("path"), F.lit("java").alias("language"), F.col("r_regionkey").alias("v"))
    new = n.select(F.concat(F.lit("REGION_"), F.col("n_regionkey") * 2).alias("name"), F.col("n_name").alias("path"), F.lit("ts").alias("language"), F.col("n_nationkey").alias("v"))
    return T.upsert_repos(old, new, "v")


def upsert_nodes(spark, sf_dir):
    """Order components updated by the orders of odd keys, plus one new node per part."""
    cols = ["repo", "node_type", "file_path", "name", "start_line", "docstring", "v"]
    old = star_nodes(spark, sf_dir).filter("node_type = 'Component'").select(*cols[:5], F.lit("old").alias("docstring"), F.lit(0).alias("v"))
    new = old.filter("start_line % 2 = 1").select(*cols[:5], F.repeat(F.col("name"), 300).alias("docstring"), F.lit(1).alias("v"))
    extra = table(spark, sf_dir, "part").select(F.lit("front").alias("repo"), F.lit("Component").alias("node_type"), F.col("p_brand").alias("file_path"),
                                                F.col("p_name").alias("name"), F.col("p_size").alias("start_line"), F.lit(None).cast("string").alias("docstring"), F.col("p_partkey").cast("int").alias("v"))
    return T.upsert_nodes(old, new.unionByName(extra), "v").withColumn("docstring", F.length("docstring")).drop("v")


def containment_edges(spark, sf_dir):
    """Repo to file to node containment of the derived TypeScript files and their modules."""
    files = ts_files(spark, sf_dir)
    repos = table(spark, sf_dir, "region").select(F.when(F.col("r_regionkey") == 0, "front").otherwise(F.col("r_name")).alias("name"))
    nodes = E.route_nodes(files)
    parts = [T.file_edges(files, repos), T.node_edges(nodes, files), T.module_edges(files)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def module_nodes(spark, sf_dir):
    return T.module_nodes(java_files(spark, sf_dir).unionByName(ts_files(spark, sf_dir)))


def upsert_edges(spark, sf_dir):
    g = star_graph(spark, sf_dir)
    old = g.edges.filter("rel_type = 'CONTAINS'").select("src", "rel_type", "dst", F.create_map(F.lit("s"), F.lit("old")).alias("props"))
    null = F.lit(None).cast("string")
    specs = table(spark, sf_dir, "supplier").select(
        F.struct(F.lit("File").alias("node_type"), null.alias("file_path"), F.concat(F.lit("NATION_"), "s_nationkey").alias("name"), F.lit(None).cast("int").alias("line")).alias("src"),
        F.lit("CONTAINS").alias("rel_type"),
        F.struct(F.lit("Function").alias("node_type"), null.alias("file_path"), F.col("s_name").alias("name"), F.lit(None).cast("int").alias("line")).alias("dst"),
        F.create_map(F.lit("s"), F.lit("new")).alias("props"))
    return T.upsert_edges(old, specs, g.nodes).select("src", "rel_type", "dst", F.col("props")["s"].alias("state"))


def unique_violations(spark, sf_dir):
    return T.check_unique(table(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), F.col("p_name").alias("path")), ["repo", "path"])


def unique_nodes(spark, sf_dir):
    return T.check_unique(star_graph(spark, sf_dir).nodes, ["node_id"])


def safe_props(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.array("o_orderstatus", "o_orderpriority").alias("tags"),
                                              F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("cust"))
    return o.select("o_orderkey", F.to_json(T.safe_props(o, ["o_orderstatus", "tags", "cust"])).alias("props"))


def layout_round_trip(spark, sf_dir):
    """Nodes written by repo and type, read back through a partition filter."""
    path = new_path(spark, "layout")
    T.write_layout(star_graph(spark, sf_dir).nodes.drop("props", "annotations"), path, ["repo", "node_type"], ["name"])
    kept = T.delete_by_repo(spark.read.parquet(path), "back")
    return kept.groupBy("repo", "node_type").agg(F.count("*").alias("n"), F.min("name").alias("first"))


def vector_points(spark, sf_dir):
    chunks = durable(C.chunk_nodes(entities(spark, sf_dir), 400), "chunks")
    vectors = chunks.select("chunk_id", F.array(F.length("content").cast("double")).alias("vector"))
    fresh = T.vector_points(chunks, vectors).select("chunk_id", "repo", "content", "vector", F.size("metadata").alias("keys"))
    stored = T.upsert_vectors(fresh.filter("repo = 'src1'").withColumn("content", F.lit("stale")), fresh)
    return stored.select("chunk_id", "repo", F.length("content").alias("n"), F.get("vector", F.lit(0)).alias("v"), "keys")


def _audit_rows(spark, sf_dir):
    decided = L.limit_counts(log(spark, sf_dir), LIMITS)
    return A.denial_events(decided)


def audit_round_trip(spark, sf_dir):
    """Denials appended as JSON lines, read back as typed rows."""
    path = new_path(spark, "audit")
    audit_log.append_audit(_audit_rows(spark, sf_dir), path)
    back = audit_log.read_audit(spark, path)
    return back.groupBy("event_type", "error").agg(F.count("*").alias("n"), F.count("repo").alias("with_repo"))


def stream_audit(spark, sf_dir):
    """The denial log twice over as JSON lines through the audit stream: every event comes out once."""
    path, out, mark = new_path(spark, "audit-in"), new_path(spark, "audit-out"), new_path(spark, "audit-mark")
    rows = _audit_rows(spark, sf_dir)
    audit_log.append_audit(rows.unionByName(rows), path)
    SA.write_stream(SA.audit_stream(spark, path, "60 days"), out, mark).awaitTermination()
    return spark.read.parquet(out).select("timestamp", "session_id", "event_type", "error")


def audit_accounts(spark, sf_dir):
    """The denial log twice, with broken, timeless and late lines, through the accounted stream: lines per outcome."""
    path, out, refused, mark = (new_path(spark, f"accounts-{x}") for x in ("in", "out", "refused", "mark"))
    rows = _audit_rows(spark, sf_dir)
    lines = rows.select(F.to_json(F.struct(*[c for c in rows.columns if c in A.AUDIT_SCHEMA.fieldNames()])).alias("value"), F.xxhash64("session_id", "timestamp", "error").alias("h"))
    lines = durable(lines, "lines")
    odd = table(spark, sf_dir, "nation").select(F.explode(F.array(
        F.concat(F.lit("{broken "), "n_name"), F.concat(F.lit('{"session_id":"'), "n_nationkey", F.lit('","timestamp":"never"}')), F.col("n_name"))).alias("value"))
    lines.select("value").unionByName(odd).coalesce(1).write.text(f"{path}/0")
    late = table(spark, sf_dir, "nation").select(F.concat(F.lit('{"timestamp":"1901-01-01T00:00:00.000000+00:00","session_id":"'), "n_nationkey", F.lit('"}')).alias("value"))
    lines.select("value").unionByName(late).coalesce(1).write.text(f"{path}/1")
    SA.write_accounted(spark, f"{path}/*", out, refused, mark, "20000 days", files_per_batch=1).awaitTermination()
    SA.write_accounted(spark, f"{path}/*", out, refused, mark, "20000 days").awaitTermination()  # nothing is left to do
    events = spark.read.parquet(out).agg(F.lit("event").alias("outcome"), F.count("*").alias("n"))
    return events.unionByName(spark.read.parquet(refused).groupBy(F.col("reason").alias("outcome")).agg(F.sum("n").alias("n")))


def stream_limits(spark, sf_dir):
    """The event log through the stateful stream: counted resources, builds (errors) and token requests (purchases)."""
    schema = table(spark, sf_dir, "events").schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir.rstrip('/')}/events.parquet*")
    events = raw.select(
        F.col("user_id").alias("session_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") == "error", "build").when(F.col("event_type") == "purchase", "tokens").otherwise(F.col("event_type")).alias("resource"),
        F.floor("value").alias("tokens"))
    decided = SL.limit_stream(events, {"click": 10, "view": 8}, builds_per_hour=1, token_limit=200)
    out, mark = new_path(spark, "limits-out"), new_path(spark, "limits-mark")
    SA.write_stream(decided, out, mark).awaitTermination()
    return spark.read.parquet(out)


def _ingested(spark, sf_dir):
    ts, java = ts_files(spark, sf_dir), java_files(spark, sf_dir)
    methods = E.java_methods(spread(java))
    nodes = durable(E.ts_nodes(spread(ts)).unionByName(methods.drop("class_line", "endpoint")).unionByName(E.java_classes(spread(java))).unionByName(E.endpoints(methods)), "nodes")
    edges = E.structural_edges(methods).withColumn("repo", F.lit("back"))
    chunks = C.chunk_nodes(nodes.withColumn("language", F.lit("code")), 40)
    return ts.unionByName(java), nodes, edges, chunks


def ingest_summary(spark, sf_dir):
    files, nodes, edges, chunks = _ingested(spark, sf_dir)
    errors = S.read_sources(_raw(spark, sf_dir))[1].withColumn("repo", F.when(F.col("repo") < "src2", "front").otherwise("back"))
    return Y.ingest_summary(files, nodes, edges, chunks.filter("parent_chunk_id is null"), errors)


def link_totals(spark, sf_dir):
    """Calls of the derived files against the endpoints of the derived controllers."""
    calls = E.api_calls(ts_files(spark, sf_dir))
    methods = E.endpoints(E.java_methods(spread(java_files(spark, sf_dir))))
    ends = durable(methods.select("file_path", F.col("props")["http_method"].alias("http_method"), F.col("props")["path"].alias("path"), F.col("props")["controller"].alias("controller"),
                                  F.col("props")["handler_method"].alias("handler_method"), F.xxhash64("node_id").alias("ordinal")), "endpoints")
    links = durable(K.link(calls, ends), "links")
    return Y.link_totals(links, K.unmatched_calls(calls, links), K.unmatched_endpoints(ends, links))


def validate(spark, sf_dir):
    return Y.validate(star_graph(spark, sf_dir))


def text_helpers(spark, sf_dir):
    """The scalar text functions over whole documents and their URLs."""
    d = table(spark, sf_dir, "documents")
    t = F.col("text")
    fenced = F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit("```ts\n"), t, F.lit("\n```"))).when(F.col("n_chars") % 3 == 1, F.concat(F.lit("```\n"), t)).otherwise(t)
    return d.select(
        "doc_id", X.slugify(t).alias("slug"), X.branch_slug(t).alias("branch"), F.sha2(X.strip_fences(fenced), 256).alias("unfenced"),
        F.length(X.truncate_with_notice(t, 500, "\n(cut)")).alias("cut"), X.score_band(F.col("n_chars") / 2500).alias("band"),
        X.query_hash(t).alias("qh"), X.relative_path(F.concat(F.lit("/repo/"), "source"), "/repo").alias("rel"), X.token_estimate(t).alias("tokens"))


def path_parts(spark, sf_dir):
    p = F.col("path")
    return sql_over(spark, sf_dir, PATH_SQL, ["part"]).select("path", X.dir_name(p).alias("dir"), X.file_name(p).alias("name"), X.file_stem(p).alias("stem"), X.file_ext(p).alias("ext"))


QUERIES = {f.__name__: f for f in (
    path_selection, read_sources, read_errors, file_content, verify_files, upsert_repos, upsert_nodes, containment_edges, module_nodes,
    upsert_edges, unique_violations, unique_nodes, safe_props, layout_round_trip, vector_points, audit_round_trip, stream_audit, audit_accounts,
    stream_limits, ingest_summary, link_totals, validate, text_helpers, path_parts)}

_RAWQ = """WITH r AS (SELECT source AS repo, 'src/d' || doc_id || CASE WHEN n_chars % 5 = 0 THEN '.txt' WHEN n_chars % 2 = 0 THEN '.ts' ELSE '.java' END AS path, text, n_chars % 4 = 1 AS bad, n_chars % 5 = 0 AS odd FROM documents)"""
_REQ = """WITH q AS (SELECT source AS repo, CASE doc_id % 3 WHEN 0 THEN '/src/d' WHEN 1 THEN 'd' ELSE 'missing/' END || doc_id AS file_path, doc_id, text FROM documents)"""
_DEN = """WITH lim(resource, lim) AS (VALUES ('click', 10), ('view', 8), ('purchase', 5)), c AS (SELECT user_id, event_id, ts, event_type AS resource, lim,
   row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events JOIN lim ON lim.resource = event_type), d AS (SELECT * FROM c WHERE r > lim)"""
_JP = "'src/main/java/com/shop/api'"
_TSP = "'src/app/' || lower(p_type) || '/[id]/(grp)/p' || p_partkey"
ORACLES = {
    "path_selection": f"""WITH t AS ({PATH_SQL}) SELECT path, CASE WHEN path LIKE '%.tsx' THEN 'tsx' WHEN path LIKE '%.ts' THEN 'typescript' ELSE 'java' END AS language FROM t
        WHERE path NOT LIKE '%.md' AND path NOT LIKE '%/node_modules/%' AND path NOT LIKE '%/__tests__/%' AND path NOT LIKE '%/build/%' AND path NOT LIKE '%.test.%'""",
    "read_sources": _RAWQ + """ SELECT repo, path, CASE WHEN path LIKE '%.ts' THEN 'typescript' ELSE 'java' END AS language, sha256(text) AS hash, octet_length(encode(text)) AS n_bytes, len(string_split(text, chr(10))) AS n_lines FROM r WHERE NOT bad AND NOT odd""",
    "read_errors": _RAWQ + " SELECT repo, path, CASE WHEN odd THEN 'unsupported language' ELSE 'not valid UTF-8' END AS error FROM r WHERE bad OR odd",
    "file_content": _REQ + """ SELECT repo, file_path, doc_id % 3 < 2 AS found, CASE WHEN doc_id % 3 < 2 THEN 'src/d' || doc_id END AS resolved,
        CASE WHEN doc_id % 3 < 2 THEN sha256(CASE WHEN length(text) > 1000 THEN substr(text, 1, 1000) || chr(10) || chr(10) || '... (truncated)' ELSE text END) END AS hash FROM q""",
    "verify_files": _REQ + """ SELECT repo, file_path, doc_id % 3 = 0 AS exists, CASE WHEN doc_id % 3 = 0 THEN len(string_split(text, chr(10))) - CASE WHEN text LIKE '%' || chr(10) THEN 1 ELSE 0 END END AS lines,
        CASE WHEN doc_id % 3 = 0 THEN length(text) END AS chars, CASE WHEN doc_id % 3 = 0 THEN octet_length(encode(text)) END AS bytes,
        CASE WHEN doc_id % 3 = 0 THEN sha256(CASE WHEN length(text) > 1500 THEN substr(text, 1, 1500) || chr(10) || chr(10) || '... (truncated, ' || length(text) || ' bytes total)' ELSE text END) END AS hash FROM q""",
    "upsert_repos": """WITH n AS (SELECT 'REGION_' || (n_regionkey * 2) AS name, n_name AS path, 'ts' AS language, n_nationkey AS v FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC) = 1)
        SELECT * FROM n UNION ALL SELECT r_name, 'old', 'java', r_regionkey FROM region WHERE r_name NOT IN (SELECT name FROM n)""",
    "upsert_nodes": graph_sql(""", o AS (SELECT repo, node_type, file_path, name, start_line FROM nodes WHERE node_type = 'Component'),
        p AS (SELECT DISTINCT 'front' AS repo, 'Component' AS node_type, p_brand AS file_path, p_name AS name, p_size AS start_line FROM part)
        SELECT *, CASE WHEN start_line % 2 = 1 THEN 300 * length(name) ELSE 3 END AS docstring FROM o UNION ALL SELECT *, 0 FROM p"""),
    "containment_edges": f"""WITH f AS (SELECT {_TSP} || '/page.tsx' AS path, {_TSP} AS dir, '/' || lower(p_type) || '/:id/p' || p_partkey AS route FROM part)
        SELECT 'front' AS src, 'CONTAINS' AS rel_type, 'front:' || path AS dst FROM f UNION ALL SELECT 'front:' || path, 'CONTAINS', path || ':Route:' || route || ':1' FROM f
        UNION ALL SELECT 'front:Module:' || dir, 'CONTAINS', 'front:' || path FROM f""",
    "module_nodes": f"SELECT DISTINCT 'back' AS repo, {_JP} AS path FROM supplier UNION ALL SELECT DISTINCT 'front', {_TSP} FROM part",
    "upsert_edges": graph_sql("SELECT src, rel_type, dst, CASE WHEN dst LIKE 'supplier:%' THEN 'new' ELSE 'old' END AS state FROM edges WHERE rel_type = 'CONTAINS'"),
    "unique_violations": "SELECT p_brand AS repo, p_name AS path, count(*) AS n FROM part GROUP BY 1, 2 HAVING count(*) > 1",
    "unique_nodes": graph_sql("SELECT node_id, count(*) AS n FROM nodes GROUP BY node_id HAVING count(*) > 1"),
    "safe_props": """SELECT o_orderkey, '{"o_orderstatus":"' || o_orderstatus || '","tags":"[\\"' || o_orderstatus || '\\",\\"' || o_orderpriority || '\\"]"' || CASE WHEN o_orderstatus = 'F' THEN ',"cust":"' || o_custkey || '"' ELSE '' END || '}' AS props FROM orders""",
    "layout_round_trip": graph_sql("SELECT repo, node_type, count(*) AS n, min(name) AS first FROM nodes WHERE repo <> 'back' GROUP BY repo, node_type"),
    "vector_points": node_sql(400) + ", " + parent_sql(400) + """, a AS (SELECT p.id || ':' || idx AS chunk_id, source AS repo, p.content FROM pieces p JOIN t USING (id) UNION ALL SELECT id || ':parent', source, content FROM s)
        SELECT chunk_id, repo, length(content) AS n, length(content)::DOUBLE AS v, CASE WHEN chunk_id LIKE '%:parent' THEN 3 ELSE 2 END AS keys FROM a""",
    "audit_round_trip": _DEN + " SELECT 'RATE_LIMIT_EXCEEDED' AS event_type, 'Rate limit exceeded for ' || resource AS error, count(*) AS n, 0 AS with_repo FROM d GROUP BY resource",
    "stream_audit": _DEN + """ SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS timestamp, CAST(user_id AS VARCHAR) AS session_id, 'RATE_LIMIT_EXCEEDED' AS event_type, 'Rate limit exceeded for ' || resource AS error FROM d""",
    "audit_accounts": _DEN + """, e AS (SELECT DISTINCT ts, user_id, resource FROM d) SELECT 'event' AS outcome, count(*) AS n FROM e
        UNION ALL SELECT 'duplicate', 2 * (SELECT count(*) FROM d) - (SELECT count(*) FROM e) UNION ALL SELECT 'malformed', 2 * count(*) FROM nation
        UNION ALL SELECT 'no time', count(*) FROM nation UNION ALL SELECT 'late', count(*) FROM nation""",
    "stream_limits": """WITH RECURSIVE lim(resource, lim) AS (VALUES ('click', 10), ('view', 8)),
        e AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id, ts, event_type, CAST(floor(value) AS BIGINT) AS tokens FROM events),
        c AS (SELECT session_id, event_id, event_type AS resource, row_number() OVER (PARTITION BY session_id, event_type ORDER BY ts, event_id) AS r, lim FROM e JOIN lim ON resource = event_type),
        b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS rn FROM e WHERE event_type = 'error'),
        bf AS (SELECT session_id, event_id, rn, true AS allowed, 0 AS current, [ts] AS st FROM b WHERE rn = 1
          UNION ALL SELECT session_id, event_id, rn, len(l) < 1, len(l), CASE WHEN len(l) < 1 THEN list_append(l, ts) ELSE l END
          FROM (SELECT b.session_id, b.event_id, b.rn, b.ts, list_filter(bf.st, lambda x: x > b.ts - INTERVAL 1 HOUR) AS l FROM bf JOIN b ON b.session_id = bf.session_id AND b.rn = bf.rn + 1) z),
        p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) AS rn FROM e WHERE event_type = 'purchase'),
        pf AS (SELECT session_id, event_id, rn, tokens <= 200 AS allowed, tokens AS projected, CASE WHEN tokens <= 200 THEN tokens ELSE 0 END AS total FROM p WHERE rn = 1
          UNION ALL SELECT p.session_id, p.event_id, p.rn, pf.total + p.tokens <= 200, pf.total + p.tokens, CASE WHEN pf.total + p.tokens <= 200 THEN pf.total + p.tokens ELSE pf.total END
          FROM pf JOIN p ON p.session_id = pf.session_id AND p.rn = pf.rn + 1)
        SELECT session_id, event_id, resource, r <= lim AS allowed, least(r - 1, lim) AS current, lim AS "limit" FROM c
        UNION ALL SELECT session_id, event_id, 'build', allowed, current, 1 FROM bf UNION ALL SELECT session_id, event_id, 'tokens', allowed, projected, 200 FROM pf""",
    "ingest_summary": _RAWQ + """, er AS (SELECT CASE WHEN repo < 'src2' THEN 'front' ELSE 'back' END AS repo, count(*) AS n FROM r WHERE bad OR odd GROUP BY 1)
        SELECT 'front' AS repo, (SELECT count(*) FROM part) AS files, (SELECT 7 * count(*) FROM part) AS nodes, 0 AS relationships, (SELECT 7 * count(*) FROM part) AS chunks, (SELECT n FROM er WHERE repo = 'front') AS errors
        UNION ALL SELECT 'back', (SELECT count(*) FROM supplier), (SELECT 6 * count(*) FROM supplier), (SELECT 5 * count(*) FROM supplier), (SELECT 6 * count(*) FROM supplier), (SELECT n FROM er WHERE repo = 'back')""",
    "link_totals": """SELECT 0 AS matches, (SELECT 3 * count(*) FROM part) AS unmatched_calls, (SELECT 2 * count(*) FROM supplier) AS unmatched_endpoints""",
    "validate": graph_sql("""SELECT 'nodes by label' AS "check", count(*) AS n, count(*) > 0 AS passed FROM nodes
        UNION ALL SELECT 'relationship types', count(DISTINCT rel_type), true FROM edges
        UNION ALL SELECT 'api endpoints', count(*), true FROM nodes WHERE node_type = 'APIEndpoint'
        UNION ALL SELECT 'functions with callers', count(DISTINCT dst), true FROM edges WHERE rel_type = 'CALLS' AND dst LIKE 'supplier:%'
        UNION ALL SELECT 'cross-repo links', count(*), true FROM edges WHERE rel_type = 'CONSUMES'
        UNION ALL SELECT 'search: class name', 0, true UNION ALL SELECT 'search: exported components', count(*), true FROM nodes WHERE node_type = 'Component' AND exported
        UNION ALL SELECT 'search: hooks', 0, true UNION ALL SELECT 'search: services', 0, true"""),
    "text_helpers": r"""WITH d AS (SELECT doc_id, text, n_chars, source, regexp_replace(text, '^\s+|\s+$', '', 'g') AS st FROM documents)
        SELECT doc_id, substr(trim(regexp_replace(lower(st), '[^a-z0-9]+', '-', 'g'), '-'), 1, 50) AS slug,
          substr(trim(regexp_replace(regexp_replace(lower(st), '[^a-z0-9-]', '-', 'g'), '-{2,}', '-', 'g'), '-'), 1, 50) AS branch,
          sha256(CASE n_chars % 3 WHEN 1 THEN regexp_replace(rtrim(st, '`'), '^\s+|\s+$', '', 'g') ELSE text END) AS unfenced,
          least(length(text), 500) AS cut, CASE WHEN n_chars / 2500 > 0.8 THEN 'green' WHEN n_chars / 2500 > 0.6 THEN 'orange' ELSE 'red' END AS band,
          substr(sha256(text), 1, 16) AS qh, source AS rel, CAST(ceil(length(text) / 4.0) AS INT) AS tokens FROM d""",
    "path_parts": f"""WITH t AS ({PATH_SQL}), p AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, regexp_extract(path, '[^/]*$') AS name FROM t)
        SELECT path, dir, name, regexp_replace(name, '\\.[^.]*$', '') AS stem, regexp_extract(name, '\\.[^.]*$') AS ext FROM p""",
}
ORACLES = {k: v.replace("CAST(NULL AS STRING)", "CAST(NULL AS VARCHAR)") for k, v in ORACLES.items()}
