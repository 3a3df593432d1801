"""Graph queries over the star schema seen as a code graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import graph as G
from weftgraph.plans.views import graph_sql, star_graph, table


def label_counts(spark, sf_dir):
    return G.label_counts(star_graph(spark, sf_dir))


def graph_totals(spark, sf_dir):
    return G.graph_totals(star_graph(spark, sf_dir))


def rel_type_counts(spark, sf_dir):
    return G.rel_type_counts(star_graph(spark, sf_dir))


def top_called(spark, sf_dir):
    return G.top_called(star_graph(spark, sf_dir))


def _suppliers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"))


def neighbors_d1(spark, sf_dir):
    return G.neighbors(star_graph(spark, sf_dir), table(spark, sf_dir, "orders").select(
        F.concat(F.lit("Order"), "o_orderkey").alias("name")), 1)


def neighbors_d2(spark, sf_dir):
    return G.neighbors(star_graph(spark, sf_dir), _suppliers(spark, sf_dir).withColumn("repo", F.lit("back")), 2)


def neighbors_d3(spark, sf_dir):
    return G.neighbors(star_graph(spark, sf_dir), table(spark, sf_dir, "region").select(F.col("r_name").alias("name")), 3)


def graph_view_edges(spark, sf_dir):
    return G.graph_view(star_graph(spark, sf_dir), _suppliers(spark, sf_dir), 1, 100)[1]


def graph_view_nodes(spark, sf_dir):
    return G.graph_view(star_graph(spark, sf_dir), _suppliers(spark, sf_dir), 1, 100)[0]


def callers(spark, sf_dir):
    return G.find_callers(star_graph(spark, sf_dir), _suppliers(spark, sf_dir), 50)


def callers_in_repo(spark, sf_dir):
    asked = _suppliers(spark, sf_dir).withColumn("repo", F.lit("back"))
    return G.find_callers(star_graph(spark, sf_dir), asked, 50)


def api_contracts(spark, sf_dir):
    return G.api_contracts(star_graph(spark, sf_dir), "back")


def api_map(spark, sf_dir):
    return G.api_map(star_graph(spark, sf_dir))


def api_map_filtered(spark, sf_dir):
    return G.api_map(star_graph(spark, sf_dir), "/API/N", unmatched_only=True)


def api_map_totals(spark, sf_dir):
    return G.api_map_totals(G.api_map(star_graph(spark, sf_dir)))


def endpoints_without_consumers(spark, sf_dir):
    return G.unmatched_endpoints(star_graph(spark, sf_dir), 20)


def cross_repo_impact(spark, sf_dir):
    return G.cross_repo_impact(star_graph(spark, sf_dir), ["/api/brand-1/", "/api/brand-22/"], 2)


def module_graph(spark, sf_dir):
    asked = table(spark, sf_dir, "region").select(F.lit("back").alias("repo"), F.col("r_name").alias("path"))
    return G.module_graph(star_graph(spark, sf_dir), asked)


def module_report(spark, sf_dir):
    asked = table(spark, sf_dir, "region").select(F.lit("back").alias("repo"), F.col("r_name").alias("path"))
    return G.section_report(G.module_graph(star_graph(spark, sf_dir), asked), ["module_id"], "kind", "node", 20)


def trace_report(spark, sf_dir):
    rows = G.cross_repo_impact(star_graph(spark, sf_dir), ["/api/brand-1/", "/api/brand-22/"], 2)
    return G.section_report(rows, ["endpoint_id"], "role", "node", 5)


def neighbor_report(spark, sf_dir):
    rows = G.neighbors(star_graph(spark, sf_dir), _suppliers(spark, sf_dir), 1, 50)
    return G.section_report(rows, ["seed"], "direction", "name", 10)


def contract_report(spark, sf_dir):
    rows = G.api_contracts(star_graph(spark, sf_dir)).filter("consumer is not null")
    return G.section_report(rows, ["endpoint_id"], "http_method", "consumer", 20)


def shortest_path(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    asked = nation.join(region, region.r_regionkey == (nation.n_regionkey + 1) % 5).select(
        F.col("n_name").alias("start"), F.col("r_name").alias("end"))
    paths = G.shortest_path(star_graph(spark, sf_dir), asked, 5)
    return paths.select("start", "end", "length", F.array_join("nodes", ">").alias("nodes"), F.array_join("rels", ">").alias("rels"))


def path_steps(spark, sf_dir):
    region = table(spark, sf_dir, "region").select(F.col("r_name").alias("start"), "r_regionkey")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("end"), (F.col("s_nationkey") % 5).alias("r_regionkey"))
    asked = supplier.join(region, "r_regionkey").select("start", "end")
    return G.path_rows(G.shortest_path(star_graph(spark, sf_dir), asked, 3))


def impact(spark, sf_dir):
    return G.impact(star_graph(spark, sf_dir), _impact_names(spark, sf_dir))


def _impact_names(spark, sf_dir):
    graph = star_graph(spark, sf_dir)
    return graph.nodes.filter("node_type in ('APIEndpoint', 'Function')").select("name")


def impact_counts(spark, sf_dir):
    return G.impact_counts(impact(spark, sf_dir))


def impact_depth2(spark, sf_dir):
    return G.impact(star_graph(spark, sf_dir), _suppliers(spark, sf_dir), 2)


def consumers_by_path(spark, sf_dir):
    return G.consumers_by_path(star_graph(spark, sf_dir), ["/api/brand-3/", "GET /api/brand-4/3"])


def text_contains(spark, sf_dir):
    return G.contains_text(star_graph(spark, sf_dir), "(status: F)", "front", 20)


def exported_components(spark, sf_dir):
    return G.sample_nodes(star_graph(spark, sf_dir), "Component", exported=True, limit=10)


def annotated_functions(spark, sf_dir):
    return G.sample_nodes(star_graph(spark, sf_dir), "Function", annotation="KindFunction", limit=10)


QUERIES = {f.__name__: f for f in (
    label_counts, graph_totals, rel_type_counts, top_called, neighbors_d1, neighbors_d2, neighbors_d3, graph_view_edges, graph_view_nodes,
    callers, callers_in_repo, api_contracts, api_map, api_map_filtered, api_map_totals, endpoints_without_consumers,
    cross_repo_impact, module_graph, module_report, trace_report, neighbor_report, contract_report, shortest_path,
    path_steps, impact, impact_counts, impact_depth2, consumers_by_path, text_contains, exported_components,
    annotated_functions)}

_BOTH = ", b AS (SELECT src AS a, dst AS b, rel_type FROM edges UNION ALL SELECT dst, src, rel_type FROM edges), bd AS (SELECT DISTINCT a, b FROM b)"


def _neighbors_sql(seeds: str, depth: int, limit: int, tail: str) -> str:
    levels = f", s AS ({seeds}), h0 AS (SELECT node_id AS seed, node_id AS node FROM s)"
    for d in range(1, depth + 1):
        levels += f", h{d} AS (SELECT DISTINCT seed, b AS node FROM h{d - 1} JOIN bd ON a = node)"
    hops = " UNION ALL ".join(f"SELECT seed, node, {d} AS hop FROM h{d}" for d in range(1, depth + 1))
    return graph_sql(f"""{_BOTH}{levels},
      reached AS (SELECT seed, node, min(hop) AS hop FROM ({hops}) WHERE seed <> node GROUP BY seed, node),
      kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY hop, node) AS rn FROM reached) WHERE rn <= {limit}),
      direct AS (SELECT src AS seed, dst AS node, rel_type, 'outgoing' AS direction FROM edges
                 UNION ALL SELECT dst, src, rel_type, 'incoming' FROM edges),
      found AS (SELECT k.seed, k.node, n.name, n.node_type, n.repo, n.file_path, k.hop, d.rel_type, d.direction
                FROM kept k LEFT JOIN direct d ON k.hop = 1 AND d.seed = k.seed AND d.node = k.node JOIN nodes n ON n.node_id = k.node)
      {tail}""")


_SUPPLIER_SEEDS = "SELECT node_id, name FROM nodes WHERE node_id LIKE 'supplier:%'"
_ALL = "SELECT * FROM found"
_HANDLER = """handler AS (SELECT e.src AS endpoint_id, n.node_id AS handler_id, n.name AS handler FROM edges e JOIN nodes n ON n.node_id = e.dst
   WHERE e.rel_type = 'EXPOSED_BY' AND n.node_type = 'Function'),
 consumer AS (SELECT e.dst AS endpoint_id, n.node_id AS consumer_id, n.name AS consumer, n.repo AS consumer_repo
   FROM edges e JOIN nodes n ON n.node_id = e.src WHERE e.rel_type = 'CONSUMES')"""
_MAP = f""", {_HANDLER}, m AS (SELECT n.node_id AS endpoint_id, n.http_method, n.path, h.handler, count(c.consumer_id) AS consumers,
   count(c.consumer_id) > 0 AS has_consumers FROM nodes n LEFT JOIN handler h ON h.endpoint_id = n.node_id
   LEFT JOIN consumer c ON c.endpoint_id = n.node_id WHERE n.node_type = 'APIEndpoint' GROUP BY 1, 2, 3, 4)"""


def _report_sql(rows: str, keys: str, section: str, label: str, limit: int, select_keys: str) -> str:
    return f""", rows_ AS ({rows}), rk AS (SELECT *, row_number() OVER (PARTITION BY {keys}, {section} ORDER BY {label}) AS rn FROM rows_)
      SELECT {select_keys}, {section}, count(*) AS total, string_agg({label}, ', ' ORDER BY {label}) FILTER (rn <= {limit}) AS items
      FROM rk GROUP BY {keys}, {section}"""


_MODULE_ROWS = """SELECT m.node_id AS module_id, 'file' AS kind, f.node_id AS node FROM nodes m JOIN edges c ON c.src = m.node_id AND c.rel_type = 'CONTAINS'
     JOIN nodes f ON f.node_id = c.dst AND f.node_type = 'File' WHERE m.node_type = 'Module'
   UNION SELECT m.node_id, 'import', i.dst FROM nodes m JOIN edges c ON c.src = m.node_id AND c.rel_type = 'CONTAINS'
     JOIN nodes f ON f.node_id = c.dst AND f.node_type = 'File' JOIN edges i ON i.src = f.node_id AND i.rel_type = 'IMPORTS' WHERE m.node_type = 'Module'
   UNION SELECT m.node_id, 'node', i.dst FROM nodes m JOIN edges c ON c.src = m.node_id AND c.rel_type = 'CONTAINS'
     JOIN nodes f ON f.node_id = c.dst AND f.node_type = 'File' JOIN edges i ON i.src = f.node_id AND i.rel_type = 'CONTAINS' WHERE m.node_type = 'Module'"""
_IMPACT_ROWS = f""", {_HANDLER}, calls AS (SELECT DISTINCT dst AS a, src AS b FROM edges WHERE rel_type = 'CALLS'),
  req AS (SELECT node_id AS endpoint_id, r AS request FROM nodes, (VALUES ('/api/brand-1/'), ('/api/brand-22/')) v(r)
          WHERE node_type = 'APIEndpoint' AND contains(path, r)),
  st AS (SELECT DISTINCT r.endpoint_id, handler_id AS node, 'handler' AS role FROM req r JOIN handler USING (endpoint_id)
         UNION SELECT DISTINCT r.endpoint_id, consumer_id, 'frontend_consumer' FROM req r JOIN consumer USING (endpoint_id)),
  u1 AS (SELECT DISTINCT endpoint_id, b AS node, CASE role WHEN 'handler' THEN 'backend_impact' ELSE 'frontend_impact' END AS role FROM st JOIN calls ON a = node),
  u2 AS (SELECT DISTINCT endpoint_id, b AS node, role FROM u1 JOIN calls ON a = node),
  trace AS (SELECT endpoint_id, node, role, 0 AS hop FROM st
    UNION ALL SELECT endpoint_id, node, role, min(hop) FROM (SELECT *, 1 AS hop FROM u1 UNION ALL SELECT *, 2 FROM u2) GROUP BY 1, 2, 3)"""


def _path_sql(requests: str, depth: int, tail: str) -> str:
    text = f""", be AS (SELECT a, b, min(rel_type) AS rel FROM (SELECT src AS a, dst AS b, rel_type FROM edges UNION ALL SELECT dst, src, rel_type FROM edges) GROUP BY a, b),
      req AS ({requests}), p0 AS (SELECT start_, end_, s AS node, [s] AS ids, CAST([] AS VARCHAR[]) AS rels, t FROM req)"""
    for d in range(1, depth + 1):
        seen = " ".join(f"AND NOT EXISTS (SELECT 1 FROM p{k} q WHERE q.start_ = p.start_ AND q.end_ = p.end_ AND q.node = be.b)" for k in range(d))
        text += f""", p{d} AS MATERIALIZED (SELECT start_, end_, node, min(w).ids AS ids, min(w).rels AS rels, t FROM (
            SELECT p.start_, p.end_, be.b AS node, p.t, {{'ids': list_append(p.ids, be.b), 'rels': list_append(p.rels, be.rel)}} AS w
            FROM p{d - 1} p JOIN be ON be.a = p.node WHERE p.node <> p.t {seen}) GROUP BY start_, end_, node, t)"""
    union = " UNION ALL ".join(f"SELECT *, {d} AS length FROM p{d} WHERE node = t" for d in range(1, depth + 1))
    return graph_sql(f"{text}, found AS ({union}) {tail}")


_REGION_REQ = """SELECT n_name AS start_, r_name AS end_, concat('nation:', n_nationkey) AS s, concat('region:', r_regionkey) AS t
   FROM nation JOIN region ON r_regionkey = (n_regionkey + 1) % 5"""
_SUPPLIER_REQ = """SELECT r_name AS start_, s_name AS end_, concat('region:', r_regionkey) AS s, concat('supplier:', s_suppkey) AS t
   FROM supplier JOIN region ON r_regionkey = s_nationkey % 5"""
_IMPACT = f""", {_HANDLER}, seeds AS ({{seeds}}), im AS (
   SELECT DISTINCT s.name, 'dependent' AS role, e.src AS node, e.rel_type, 1 AS hop FROM seeds s JOIN edges e ON e.dst = s.node_id
   UNION ALL SELECT DISTINCT s.name, 'dependency', e.dst, e.rel_type, 1 FROM seeds s JOIN edges e ON e.src = s.node_id
   UNION ALL SELECT DISTINCT s.name, 'cross_repo', c.consumer_id, 'CONSUMES', 1 FROM seeds s JOIN consumer c ON c.endpoint_id = s.node_id
   {{more}}), ix AS (SELECT im.*, n.node_type FROM im JOIN nodes n ON n.node_id = im.node)"""
_FAR = """UNION ALL SELECT DISTINCT s.name, 'dependent', e2.src, NULL, 2 FROM seeds s JOIN edges e ON e.dst = s.node_id JOIN edges e2 ON e2.dst = e.src
     WHERE e2.src <> s.node_id AND NOT EXISTS (SELECT 1 FROM edges x WHERE x.dst = s.node_id AND x.src = e2.src)
   UNION ALL SELECT DISTINCT s.name, 'dependency', e2.dst, NULL, 2 FROM seeds s JOIN edges e ON e.src = s.node_id JOIN edges e2 ON e2.src = e.dst
     WHERE e2.dst <> s.node_id AND NOT EXISTS (SELECT 1 FROM edges x WHERE x.src = s.node_id AND x.dst = e2.dst)"""
_IMPACT_SEEDS = "SELECT node_id, name FROM nodes WHERE node_type IN ('APIEndpoint', 'Function')"
_CALLERS = """, c AS (SELECT DISTINCT f.name AS callee_name, f.node_id AS callee_id, f.repo AS callee_repo, k.node_id AS caller_id,
    k.name AS caller_name, k.repo AS caller_repo, k.file_path AS caller_file FROM edges e JOIN nodes f ON f.node_id = e.dst AND f.node_type = 'Function'
    JOIN nodes k ON k.node_id = e.src WHERE e.rel_type = 'CALLS' AND f.node_id LIKE 'supplier:%' {more})
  SELECT callee_name, callee_id, caller_id, caller_name, caller_repo, caller_file FROM (SELECT *, row_number() OVER (PARTITION BY callee_name ORDER BY caller_id, callee_id) AS rn FROM c) WHERE rn <= 50"""

ORACLES = {
    "label_counts": graph_sql("SELECT node_type, count(*) AS n FROM nodes GROUP BY node_type"),
    "graph_totals": graph_sql("SELECT (SELECT count(*) FROM nodes) AS total_nodes, (SELECT count(*) FROM edges) AS relationships, (SELECT count(DISTINCT repo) FROM nodes) AS repos"),
    "rel_type_counts": graph_sql("SELECT rel_type, count(*) AS n FROM edges GROUP BY rel_type"),
    "top_called": graph_sql("""SELECT n.name, count(*) AS callers FROM edges e JOIN nodes n ON n.node_id = e.dst AND n.node_type = 'Function'
        WHERE rel_type = 'CALLS' GROUP BY n.name ORDER BY callers DESC, n.name LIMIT 5"""),
    "neighbors_d1": _neighbors_sql("SELECT node_id FROM nodes WHERE node_id LIKE 'order:%'", 1, 50, _ALL),
    "neighbors_d2": _neighbors_sql(_SUPPLIER_SEEDS, 2, 50, _ALL),
    "neighbors_d3": _neighbors_sql("SELECT node_id FROM nodes WHERE node_id LIKE 'region:%'", 3, 50, _ALL),
    "graph_view_edges": _neighbors_sql(_SUPPLIER_SEEDS, 1, 100, """SELECT seed, CASE WHEN direction = 'outgoing' THEN seed ELSE node END AS source,
        CASE WHEN direction = 'outgoing' THEN node ELSE seed END AS target, coalesce(rel_type, 'RELATED') AS label FROM found"""),
    "graph_view_nodes": _neighbors_sql(_SUPPLIER_SEEDS, 1, 100, """SELECT DISTINCT seed, node AS id, substr(name, 1, 20) AS label, node_type FROM found
        UNION ALL SELECT node_id, node_id, name, 'center' FROM s"""),
    "callers": graph_sql(_CALLERS.replace("{more}", "")),
    "callers_in_repo": graph_sql(_CALLERS.replace("{more}", "AND k.repo = 'back' AND f.repo = 'back'")),
    "api_contracts": graph_sql(f""", {_HANDLER} SELECT DISTINCT n.node_id AS endpoint_id, n.http_method, n.path, n.repo, h.handler_id, h.handler, c.consumer_id, c.consumer
        FROM nodes n LEFT JOIN handler h ON h.endpoint_id = n.node_id LEFT JOIN consumer c ON c.endpoint_id = n.node_id WHERE n.node_type = 'APIEndpoint' AND n.repo = 'back'"""),
    "api_map": graph_sql(_MAP + " SELECT * FROM m"),
    "api_map_filtered": graph_sql(_MAP + " SELECT * FROM m WHERE contains(lower(path), '/api/n') AND NOT has_consumers"),
    "api_map_totals": graph_sql(_MAP + " SELECT count(*) AS total, count(*) FILTER (has_consumers) AS matched, count(*) FILTER (NOT has_consumers) AS unmatched FROM m"),
    "endpoints_without_consumers": graph_sql("""SELECT node_id AS endpoint_id, http_method, path, name AS endpoint_name, repo FROM nodes n WHERE node_type = 'APIEndpoint'
        AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.dst = n.node_id AND e.rel_type = 'CONSUMES') ORDER BY path, node_id LIMIT 20"""),
    "cross_repo_impact": graph_sql(_IMPACT_ROWS + " SELECT request, t.endpoint_id, role, node, hop FROM req JOIN trace t USING (endpoint_id)"),
    "trace_report": graph_sql(_IMPACT_ROWS + _report_sql("SELECT * FROM req JOIN trace USING (endpoint_id)", "endpoint_id", "role", "node", 5, "endpoint_id")),
    "module_graph": graph_sql(_MODULE_ROWS),
    "module_report": graph_sql(_report_sql(_MODULE_ROWS, "module_id", "kind", "node", 20, "module_id")),
    "neighbor_report": _neighbors_sql(_SUPPLIER_SEEDS, 1, 50, _report_sql("SELECT * FROM found", "seed", "direction", "name", 10, "seed")),
    "contract_report": graph_sql(f", {_HANDLER}" + _report_sql("""SELECT DISTINCT n.node_id AS endpoint_id, n.http_method, c.consumer_id, c.consumer FROM nodes n
        JOIN consumer c ON c.endpoint_id = n.node_id WHERE n.node_type = 'APIEndpoint'""", "endpoint_id", "http_method", "consumer", 20, "endpoint_id")),
    "shortest_path": _path_sql(_REGION_REQ, 5, "SELECT start_ AS start, end_ AS \"end\", length, array_to_string(ids, '>') AS nodes, array_to_string(rels, '>') AS rels FROM found"),
    "path_steps": _path_sql(_SUPPLIER_REQ, 3, """, st AS (SELECT start_, end_, ids, rels, unnest(range(0, 2 * len(ids) - 1)) AS step FROM found)
        SELECT start_ AS start, end_ AS "end", step, CASE WHEN step % 2 = 0 THEN 'node' ELSE 'relationship' END AS kind,
               CASE WHEN step % 2 = 0 THEN ids[step // 2 + 1] ELSE rels[step // 2 + 1] END AS value FROM st"""),
    "impact": graph_sql(_IMPACT.format(seeds=_IMPACT_SEEDS, more="") + " SELECT * FROM ix"),
    "impact_counts": graph_sql(_IMPACT.format(seeds=_IMPACT_SEEDS, more="") + """ SELECT name, count(*) FILTER (role = 'dependent') AS callers,
        count(*) FILTER (role = 'dependency') AS dependencies, count(*) FILTER (role = 'cross_repo') AS cross_repo FROM ix GROUP BY name"""),
    "impact_depth2": graph_sql(_IMPACT.format(seeds=_SUPPLIER_SEEDS, more=_FAR) + " SELECT * FROM ix"),
    "consumers_by_path": graph_sql(f""", {_HANDLER} SELECT DISTINCT r AS request, consumer_id, consumer, consumer_repo
        FROM nodes n, (VALUES ('/api/brand-3/'), ('GET /api/brand-4/3')) v(r), consumer c
        WHERE n.node_type = 'APIEndpoint' AND (n.name = r OR contains(n.path, r)) AND c.endpoint_id = n.node_id"""),
    "text_contains": graph_sql("""SELECT node_id, name, node_type, repo, 1.0::DOUBLE AS score FROM nodes
        WHERE (contains(name, '(status: F)') OR contains(signature, '(status: F)')) AND repo = 'front' ORDER BY node_id LIMIT 20"""),
    "exported_components": graph_sql("SELECT node_id, name, repo, file_path FROM nodes WHERE node_type = 'Component' AND exported ORDER BY name, node_id LIMIT 10"),
    "annotated_functions": graph_sql("SELECT node_id, name, repo, file_path FROM nodes WHERE node_type = 'Function' ORDER BY name, node_id LIMIT 10"),
}


def _tidy(sql: str) -> str:
    return sql.replace("CAST(NULL AS STRING)", "CAST(NULL AS VARCHAR)").replace("edges AS (", "edges AS MATERIALIZED (", 1).replace(") , ", "), ").replace(")  , ", "), ")


ORACLES = {k: _tidy(v) for k, v in ORACLES.items()}
