"""Extraction over source files that Spark derives from parts (TypeScript) and suppliers (Java), one file per row.

The SQL counterparts state what each file must yield from the row's own columns.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import extract as X
from weftgraph.operators import link as L
from weftgraph.plans.scale import durable, spread
from weftgraph.plans.views import sql_over

_TS_LINES = [
    "'import React, { useState as useS, useMemo } from \"react\";'",
    "'import * as api from \"../lib/api\";'",
    "concat('import { usePart', if(k = 0, 1, k - 1), ' } from \"../p', if(k = 0, 1, k - 1), '/page\";')",
    "''",
    "concat('/** Shows ', p_name, '. */')",
    "concat('export const Part', k, 'View = async (props: Props', k, ') => {')",
    "'  const [s, setS] = useS({ a: 0 });'",
    "concat('  const x = usePart', k, '(props.id);')",
    "concat('  const r = await fetch(`/api/parts/$', '{props.id}/', p_size, '`);')",
    "'  if (x) { setS(1); }'",
    "concat('  return <div>{helper', k, '(x)}</div>;')",
    "'};'",
    "''",
    "concat('export function usePart', k, '(id: number): number {')",
    "concat('  return apiClient.post(\"/api/use/', k, '\", id);')",
    "'}'",
    "''",
    "concat('function helper', k, '(v) {')",
    "concat('  return shared(v * ', p_size, ');')",
    "'}'",
    "concat('export { helper', k, ', other };')",
    "concat('interface Props', k, ' {')",
    "'  id: number;'",
    "'}'",
    "concat('export type Id', k, ' = number | string;')",
    "'export const shared = (n: number): number => n + 1;'",
    "'async function load() { return authenticatedFetch(\"/api/load\"); }'",
]
TS_SQL = f"""SELECT 'front' AS repo, concat('src/app/', lower(p_type), '/[id]/(grp)/p', k, '/page.tsx') AS path,
   concat(repeat('// note\\n', p_size % 3), concat_ws('\\n', {', '.join(_TS_LINES)})) AS content FROM (SELECT *, p_partkey AS k FROM part)"""

_JAVA_LINES = [
    "'package com.shop.api;'", "''", "'import java.util.List;'", "'import static com.shop.core.Base.run;'",
    "concat('import com.shop.api.S', next, 'Controller;')", "''",
    "'/**'", "concat(' * Serves ', s_name)", "' */'",
    "if(s_acctbal > 0, '@RestController', '@Service')", "concat('@RequestMapping(\"/api/s', k, '/\")')",
    "concat('public class S', k, 'Controller extends Base {')",
    "'    private final Repo repo;'", "''",
    "concat('    public S', k, 'Controller(final Repo repo, S', next, 'Controller other) {')", "'        this.repo = repo;'", "'    }'", "''",
    "'    @GetMapping(\"/{id}\")'", "'    public Map<String, Item> find(@PathVariable(\"id\") Long id, String view) {'",
    "'        if (id == null) { return null; }'", "'        return convert(repo.load(id));'", "'    }'", "''",
    "'    @RequestMapping(value = \"items\", method = RequestMethod.PUT)'", "'    @Audited'", "'    protected void store(Item item)'", "'    {'",
    "'        repo.save(item);'", "'    }'", "''",
    "'    private static Item convert(Row row) { return new Item(row); }'", "'}'",
]
JAVA_SQL = f"""SELECT 'back' AS repo, concat('src/main/java/com/shop/api/S', k, 'Controller.java') AS path, concat_ws('\\n', {', '.join(_JAVA_LINES)}) AS content
   FROM (SELECT *, s_suppkey AS k, if(s_suppkey = 0, 1, s_suppkey - 1) AS next FROM supplier)"""


def ts_files(spark, sf_dir):
    return sql_over(spark, sf_dir, TS_SQL, ["part"])


def java_files(spark, sf_dir):
    return sql_over(spark, sf_dir, JAVA_SQL, ["supplier"])


def ts_entities(spark, sf_dir):
    n = X.ts_nodes(spread(ts_files(spark, sf_dir)))
    return n.select("node_id", "node_type", "name", "file_path", "start_line", "end_line", "signature", "exported", "docstring",
                    F.length("body").alias("body_length"), F.col("props")["is_async"].alias("is_async"), F.col("props")["has_jsx"].alias("has_jsx"))


def ts_imports(spark, sf_dir):
    return X.ts_imports(ts_files(spark, sf_dir))


def api_calls(spark, sf_dir):
    return X.api_calls(ts_files(spark, sf_dir))


def route_nodes(spark, sf_dir):
    return X.route_nodes(ts_files(spark, sf_dir)).select("node_type", "name", "file_path", F.col("props")["route_type"].alias("route_type"))


def uses_hook_edges(spark, sf_dir):
    nodes = durable(X.ts_nodes(spread(ts_files(spark, sf_dir))), "nodes")
    return L.resolve_wildcards(X.uses_hook_specs(nodes), nodes).select("src", "rel_type", "dst")


def java_classes(spark, sf_dir):
    return X.java_classes(spread(java_files(spark, sf_dir))).select(
        "node_id", "name", "start_line", "end_line", "signature", "docstring", F.array_join("annotations", ",").alias("annotations"),
        F.col("props")["class_type"].alias("class_type"), F.col("props")["base_path"].alias("base_path"))


def java_methods(spark, sf_dir):
    return X.java_methods(spread(java_files(spark, sf_dir))).select(
        "node_id", "name", "start_line", "end_line", "signature", F.array_join("annotations", ",").alias("annotations"),
        F.col("props")["class_name"].alias("class_name"), "class_line")


def java_endpoints(spark, sf_dir):
    e = X.endpoints(X.java_methods(spread(java_files(spark, sf_dir))))
    return e.select("name", "file_path", "start_line", F.col("props")["http_method"].alias("http_method"), F.col("props")["path"].alias("path"),
                    F.col("props")["controller"].alias("controller"), F.col("props")["handler_method"].alias("handler"))


def java_imports(spark, sf_dir):
    return X.java_imports(java_files(spark, sf_dir)).select("source_file", "imported_name", "imported_from")


def structural_edges(spark, sf_dir):
    return X.structural_edges(X.java_methods(spread(java_files(spark, sf_dir)))).select("src", "rel_type", "dst")


def depends_on_edges(spark, sf_dir):
    files = spread(java_files(spark, sf_dir))
    return L.resolve_wildcards(X.depends_on_specs(files), durable(X.java_classes(files), "nodes")).select("src", "rel_type", "dst")


def call_edges(spark, sf_dir):
    nodes = durable(X.ts_nodes(spread(ts_files(spark, sf_dir))).unionByName(
        X.java_methods(spread(java_files(spark, sf_dir))).drop("class_line", "endpoint")), "nodes")
    return X.call_edges(nodes).select("src", "rel_type", "dst")


def import_edges(spark, sf_dir):
    files = ts_files(spark, sf_dir).unionByName(java_files(spark, sf_dir))
    imports = X.ts_imports(ts_files(spark, sf_dir)).unionByName(X.java_imports(java_files(spark, sf_dir)))
    return X.import_edges(imports, files).select("src", "rel_type", "dst")


QUERIES = {f.__name__: f for f in (
    ts_entities, ts_imports, api_calls, route_nodes, uses_hook_edges, java_classes, java_methods, java_endpoints, java_imports,
    structural_edges, depends_on_edges, call_edges, import_edges)}

_TS = """WITH f AS (SELECT *, CAST(p_partkey AS VARCHAR) AS k, p_size % 3 AS o, 'src/app/' || lower(p_type) || '/[id]/(grp)/p' || p_partkey || '/page.tsx' AS path,
    CAST(CASE WHEN p_partkey = 0 THEN 1 ELSE p_partkey - 1 END AS VARCHAR) AS prev FROM part)"""
_TS_ENT = _TS + """, e AS (
    SELECT path, 'Component' AS t, 'Part' || k || 'View' AS name, 6 + o AS s, 12 + o AS e, 'Part' || k || 'View(props: Props' || k || ')' AS sig, true AS exported, '/** Shows ' || p_name || '. */' AS doc,
      length('async (props: Props' || k || ') => {') + length('  const [s, setS] = useS({ a: 0 });') + length('  const x = usePart' || k || '(props.id);')
      + length('  const r = await fetch(`/api/parts/${props.id}/' || p_size || '`);') + length('  if (x) { setS(1); }') + length('  return <div>{helper' || k || '(x)}</div>;') + 1 + 6 AS bl, 'true' AS a, 'true' AS j FROM f
    UNION ALL SELECT path, 'Hook', 'usePart' || k, 14 + o, 16 + o, 'usePart' || k || '(id: number): number', true, '',
      length('function usePart' || k || '(id: number): number {') + length('  return apiClient.post("/api/use/' || k || '", id);') + 1 + 2, 'false', 'false' FROM f
    UNION ALL SELECT path, 'Function', 'helper' || k, 18 + o, 20 + o, 'helper' || k || '(v)', true, '', length('function helper' || k || '(v) {') + length('  return shared(v * ' || p_size || ');') + 1 + 2, 'false', 'false' FROM f
    UNION ALL SELECT path, 'Interface', 'Props' || k, 22 + o, 24 + o, 'interface Props' || k || ' {' || chr(10) || '  id: number;' || chr(10) || '}', false, '', 0, NULL, NULL FROM f
    UNION ALL SELECT path, 'Type', 'Id' || k, 25 + o, 25 + o, 'type Id' || k || ' = number | string', true, '', 0, NULL, NULL FROM f
    UNION ALL SELECT path, 'Function', 'shared', 26 + o, 26 + o, 'shared(n: number): number', true, '', length('(n: number): number => n + 1'), 'false', 'false' FROM f
    UNION ALL SELECT path, 'Function', 'load', 27 + o, 27 + o, 'load()', false, '', length('async function load() { return authenticatedFetch("/api/load"); }'), 'true', 'false' FROM f)"""
_ID = "path || ':' || t || ':' || name || ':' || s"
_J = """WITH f AS (SELECT *, CAST(s_suppkey AS VARCHAR) AS k, CAST(CASE WHEN s_suppkey = 0 THEN 1 ELSE s_suppkey - 1 END AS VARCHAR) AS next,
    'src/main/java/com/shop/api/S' || s_suppkey || 'Controller.java' AS path FROM supplier),
  m AS (SELECT f.*, v.* FROM f, (VALUES ('find', 19, 23, 'Map<String, Item> find(@PathVariable("id") Long id, String view)', 'GetMapping', 'GET', '{id}'),
    ('store', 25, 30, 'void store(Item item)', 'RequestMapping,Audited', 'PUT', 'items'), ('convert', 32, 32, 'Item convert(Row row)', '', NULL, NULL)) v(name, s, e, sig, ann, verb, p)),
  ep AS (SELECT *, CASE WHEN s_acctbal > 0 THEN '/api/s' || k ELSE '' END || '/' || p AS full_path FROM m WHERE verb IS NOT NULL)"""
ORACLES = {
    "ts_entities": _TS_ENT + f" SELECT {_ID} AS node_id, t AS node_type, name, path AS file_path, s AS start_line, e AS end_line, sig AS signature, exported, doc AS docstring, bl AS body_length, a AS is_async, j AS has_jsx FROM e",
    "ts_imports": _TS + """ SELECT 'front' AS repo, path AS source_file, n AS imported_name, src AS imported_from, d AS is_default, ns AS is_namespace, al AS alias FROM f,
        (VALUES ('React', 'react', true, false, NULL), ('useState', 'react', false, false, 'useS'), ('useMemo', 'react', false, false, NULL), ('api', '../lib/api', false, true, NULL)) v(n, src, d, ns, al)
        UNION ALL SELECT 'front', path, 'usePart' || prev, '../p' || prev || '/page', false, false, NULL FROM f""",
    "api_calls": _TS + """ SELECT 'front' AS repo, path AS file_path, 9 + o AS line_number, 'GET' AS method, '/api/parts/${props.id}/' || p_size AS url_pattern FROM f
        UNION ALL SELECT 'front', path, 15 + o, 'POST', '/api/use/' || k FROM f UNION ALL SELECT 'front', path, 27 + o, 'GET', '/api/load' FROM f""",
    "route_nodes": _TS + " SELECT 'Route' AS node_type, '/' || lower(p_type) || '/:id/p' || k AS name, path AS file_path, 'page' AS route_type FROM f",
    "uses_hook_edges": _TS_ENT + """ SELECT path || ':Component:' || name || ':' || s AS src, 'USES_HOOK' AS rel_type, path || ':Hook:use' || replace(name, 'View', '') || ':' || (s + 8) AS dst FROM e WHERE t = 'Component'""",
    "java_classes": _J + """ SELECT path || ':Class:S' || k || 'Controller:10' AS node_id, 'S' || k || 'Controller' AS name, 10 AS start_line, 33 AS end_line,
        CASE WHEN s_acctbal > 0 THEN '@RestController' ELSE '@Service' END || ' @RequestMapping("/api/s' || k || '/") public class S' || k || 'Controller extends Base {' AS signature,
        '/**' || chr(10) || ' * Serves ' || s_name || chr(10) || ' */' AS docstring, CASE WHEN s_acctbal > 0 THEN 'RestController' ELSE 'Service' END || ',RequestMapping' AS annotations,
        CASE WHEN s_acctbal > 0 THEN 'controller' ELSE 'service' END AS class_type, CASE WHEN s_acctbal > 0 THEN '/api/s' || k || '/' ELSE '' END AS base_path FROM f""",
    "java_methods": _J + " SELECT path || ':Function:' || name || ':' || s AS node_id, name, s AS start_line, e AS end_line, sig AS signature, ann AS annotations, 'S' || k || 'Controller' AS class_name, 10 AS class_line FROM m",
    "java_endpoints": _J + " SELECT verb || ' ' || full_path AS name, path AS file_path, s AS start_line, verb AS http_method, full_path AS path, 'S' || k || 'Controller' AS controller, name AS handler FROM ep",
    "java_imports": _J + """ SELECT path AS source_file, n AS imported_name, p AS imported_from FROM f, (VALUES ('List', 'java.util'), ('run', 'com.shop.core.Base')) v(n, p)
        UNION ALL SELECT path, 'S' || next || 'Controller', 'com.shop.api' FROM f""",
    "structural_edges": _J + """ SELECT path || ':Class:S' || k || 'Controller:10' AS src, 'HAS_METHOD' AS rel_type, path || ':Function:' || name || ':' || s AS dst FROM m
        UNION ALL SELECT path || ':APIEndpoint:' || verb || ' ' || full_path || ':' || s, 'EXPOSED_BY', path || ':Function:' || name || ':' || s FROM ep""",
    "depends_on_edges": _J + """ SELECT path || ':Class:S' || k || 'Controller:10' AS src, 'DEPENDS_ON' AS rel_type, 'src/main/java/com/shop/api/S' || next || 'Controller.java:Class:S' || next || 'Controller:10' AS dst FROM f""",
    "call_edges": _TS_ENT + ", j AS (" + _J.replace("WITH f AS", "WITH jf AS").replace("FROM f,", "FROM jf f,") + """ SELECT path || ':Function:find:19' AS src, path || ':Function:convert:32' AS dst FROM jf),
        c AS (SELECT path || ':Component:' || name || ':' || s AS src, path || ':Hook:use' || replace(name, 'View', '') || ':' || (s + 8) AS dst FROM e WHERE t = 'Component'
          UNION ALL SELECT path || ':Component:' || name || ':' || s, path || ':Function:helper' || replace(replace(name, 'View', ''), 'Part', '') || ':' || (s + 12) FROM e WHERE t = 'Component'
          UNION ALL SELECT path || ':Function:' || name || ':' || s, path || ':Function:shared:' || (s + 8) FROM e WHERE name LIKE 'helper%'
          UNION ALL SELECT src, dst FROM j)
        SELECT src, 'CALLS' AS rel_type, dst FROM c""",
    "import_edges": _TS + """, t AS (SELECT a.path AS src, b.path AS dst FROM f a JOIN f b ON b.k = a.prev AND b.p_type = a.p_type)
        SELECT 'front:' || a.path AS src, 'IMPORTS' AS rel_type, 'front:' || b.path AS dst FROM f a JOIN f b ON b.k = a.prev AND lower(b.p_type) = lower(a.p_type)
        UNION ALL SELECT 'back:src/main/java/com/shop/api/S' || s_suppkey || 'Controller.java', 'IMPORTS', 'back:src/main/java/com/shop/api/S' || CASE WHEN s_suppkey = 0 THEN 1 ELSE s_suppkey - 1 END || 'Controller.java' FROM supplier""",
}
ORACLES["import_edges"] = ORACLES["import_edges"].replace(", t AS (SELECT a.path AS src, b.path AS dst FROM f a JOIN f b ON b.k = a.prev AND b.p_type = a.p_type)", "")
