"""Extraction over varied source files: six shapes per language around the whole text of every document.

A shape is a list of lines; marks in them stand for the document's number and for its text, made safe for the place it stands in. The same lines
give the files and, in the SQL counterparts, the spans and the lengths that must come out.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from weftgraph.operators import extract as X
from weftgraph.operators import link as L
from weftgraph.plans.scale import durable, spread
from weftgraph.plans.views import sql_over

# both engines run these; chr(92) is a backslash, as string escapes differ between them
_MARKS = {
    "K": "CAST(doc_id AS STRING)", "X": "chr(92)",
    "C": "translate(t, '*', '#')", "T": "translate(t, concat('`$', chr(92)), '...')", "B": "translate(t, concat('\"', chr(92)), '..')",
    "L": "replace(t, chr(10), concat(chr(10), '// '))", "S": "replace(translate(t, concat('\"', chr(92)), '..'), chr(10), ' ')",
}
_LONG = re.compile("@[CTBL]@")

# (lines, entities: kind, name, first line, last line, what is cut off in front, exported)
TS_SHAPES = [
    (["/* {{{ @C@", " export function ghost@K@() { */", "export function doc@K@(a: { b: string }): { c: number } {", "  const s = \"}{\" + '{'; // }}",
      "  return helper@K@(s) / 2;", "}", "function helper@K@(v) { return v /* { */ }"],
     [("Function", "doc@K@", 2, 5, "export ", True), ("Function", "helper@K@", 6, 6, "", False)]),
    (["export const note@K@ = (n: number) => {", "  const t = `{{ @T@ ${n > 1 ? `{${n}` : \"}\"} }`;", "  return send@K@(t);", "};", "const hidden = `",
      "export function ghost@K@() {", "`;", "export function send@K@(t: string): void", "{ log(t); }"],
     [("Function", "note@K@", 0, 3, "export const note@K@ = ", True), ("Function", "send@K@", 7, 8, "export ", True)]),
    (["export default function Quote@K@(props: Props) {", "  const s = \"{ @S@ (\";", "  const q = useQuote@K@(1);", "  return <p>Don't {props.a} {\"{\"}</p>;", "}",
      "export const useQuote@K@ = (n: number) => useMemo(() => {", "  const r = /[{\"'/]+@X@{/g.test(String(n));", "  return r ? { a: 1 } : null;", "}, [n]);"],
     [("Component", "Quote@K@", 0, 4, "export default ", True), ("Hook", "useQuote@K@", 5, 8, "export const useQuote@K@ = ", True)]),
    (["interface Shape@K@ extends Base<{ x: number }> {", "  a: { b: string; c: \"}\" };", "  m(): void; // }", "}", "export type Union@K@ =", "  | { a: \"{\" }",
      "  // @L@", "  | { b: number };", "export const sum@K@ = (a: number): number =>", "  a", "  + 1;"],
     [("Interface", "Shape@K@", 0, 3, "", False), ("Type", "Union@K@", 4, 7, "", True), ("Function", "sum@K@", 8, 10, "export const sum@K@ = ", True)]),
    (["export function over@K@(a: string): void;", "export function over@K@(a: { n: number }): void;", "export function over@K@(a: any) {", "  /* @C@ { */",
      "  return { a };", "}", "export async function Load@K@() { return over@K@(`<p>${1}</p>`); }"],
     [("Function", "over@K@", 0, 0, "export ", True), ("Component", "Load@K@", 6, 6, "export ", True)]),
    (["// @L@", "// export function ghost@K@() {", "async function real@K@() { // {{", "  if (a) { b(); } else { c(\"}\"); }", "  /** not a doc { */", "}",
      "export const View@K@ = () => <Doc@K@ text={`{@T@`} />;", "export { real@K@ };"],
     [("Function", "real@K@", 2, 5, "", True), ("Component", "View@K@", 6, 6, "export const View@K@ = ", True)]),
]
# entities: kind, name, first line, last line, class around it
JAVA_SHAPES = [
    (["public class D@K@ {", "  String t = \"\"\"", "    { void ghost() { @B@", "    \"\"\";", "  public int size() {", "    return t.length();", "  }", "}"],
     [("Class", "D@K@", 0, 7, ""), ("Function", "size", 4, 6, "D@K@")]),
    (["/* { @C@", " class Ghost { void no() { */", "@Service", "class D@K@ extends Base {", "  /* void old() { */ void now(int a) {", "    // }",
      "    go(a, '{', '\"', \"{@X@\"{\");", "  }", "}"],
     [("Class", "D@K@", 2, 8, ""), ("Function", "now", 4, 7, "D@K@")]),
    (["public abstract class D@K@ {", "  abstract void open(int a);", "  // @L@", "  static class Inner@K@ {", "    String s = \"}}\";", "    int size() { return 1; }", "  }",
      "  void close() { run(\"{\"); }", "}"],
     [("Class", "D@K@", 0, 8, ""), ("Class", "Inner@K@", 3, 6, ""), ("Function", "open", 1, 1, "D@K@"), ("Function", "size", 5, 5, "Inner@K@"), ("Function", "close", 7, 7, "D@K@")]),
    (["class D@K@ {", "  @GetMapping(value = {\"/a{b}\", \"/c\"})", "  public Map<String, int[]> find(", "      @PathVariable(\"{\") Long id, // {", "      String view)",
      "      throws IOException", "  {", "    items.forEach(x -> { use(x); });", "    int[] a = {1, 2}; /* @C@ */", "  }", "}"],
     [("Class", "D@K@", 0, 10, ""), ("Function", "find", 1, 9, "D@K@")]),
    (["final class D@K@ {", "  static { String s = \"{\"; }", "  public <T> T max(T a, T b) { return a.compareTo(b) > 0 ? a : b; }", "  protected String text() {",
      "    return \"@S@ {\" + '}';", "  }", "}"],
     [("Class", "D@K@", 0, 6, ""), ("Function", "max", 2, 2, "D@K@"), ("Function", "text", 3, 5, "D@K@")]),
    (["class D@K@ implements Runnable {", "  public void run() {", "    new Thread() {", "      public void start() { String x = \"}\"; }", "    };",
      "    if (x) return; // @L@", "  }", "  private int last() { return 0; }", "}"],
     [("Class", "D@K@", 0, 8, ""), ("Function", "run", 1, 6, "D@K@"), ("Function", "start", 3, 3, "D@K@"), ("Function", "last", 7, 7, "D@K@")]),
]
_DOCS = "SELECT doc_id, coalesce(text, '') AS t FROM documents"


def _sql(text: str) -> str:
    """A concat of the line; a dollar is kept from its brace, which Spark would take for a variable."""
    parts = re.split("(@[A-Z]@)", text)
    made = [_MARKS[p[1]] if i % 2 else "'" + p.replace("'", "''").replace("${", "$', '{") + "'" for i, p in enumerate(parts) if p]
    return f"concat({', '.join(made)}, '')" if made else "''"


def _files_sql(shapes: list, path: str) -> str:
    cases = " ".join(f"WHEN {n} THEN concat_ws(chr(10), {', '.join(map(_sql, lines))})" for n, (lines, _) in enumerate(shapes))
    return f"SELECT {path} AS path, CASE doc_id % {len(shapes)} {cases} END AS content FROM ({_DOCS})"


def _line(lines: list[str], at: int, last: bool) -> str:
    """SQL of the line number: long marks bring the document's own lines with them."""
    extra = sum(len(_LONG.findall(x)) for x in lines[:at + last])
    return f"CAST({at + 1} + {extra} * (length(t) - length(replace(t, chr(10), ''))) AS INT)"


def _expected(shapes: list, path: str, more: list[str]) -> str:
    rows = []
    for n, (lines, entities) in enumerate(shapes):
        for kind, name, first, last, *rest in entities:
            body = f"concat_ws(chr(10), {', '.join(map(_sql, lines[first:last + 1]))})"
            size = f"length({body})"
            if "lead" in more:
                size = "0" if kind in ("Type", "Interface") else f"{size} - length({_sql(rest[0])}) - {int(lines[last].endswith(';'))}"
                extra = f"{str(rest[1]).lower()} AS exported"
            else:
                size = "0" if kind == "Class" else size
                extra = f"{_sql(rest[0])} AS class_name"
            rows.append(f"SELECT {path} AS file_path, '{kind}' AS node_type, {_sql(name)} AS name, {_line(lines, first, False)} AS start_line, "
                        f"{_line(lines, last, True)} AS end_line, {extra}, CAST({size} AS INT) AS body_length FROM d WHERE doc_id % {len(shapes)} = {n}")
    return " UNION ALL ".join(rows)


_TS_PATH, _JAVA_PATH = "concat('web/d', CAST(doc_id AS STRING), '.tsx')", "concat('src/D', CAST(doc_id AS STRING), '.java')"


def ts_files(spark, sf_dir):
    return spread(sql_over(spark, sf_dir, f"SELECT 'front' AS repo, * FROM ({_files_sql(TS_SHAPES, _TS_PATH)})", ["documents"]))


def java_files(spark, sf_dir):
    return spread(sql_over(spark, sf_dir, f"SELECT 'back' AS repo, * FROM ({_files_sql(JAVA_SHAPES, _JAVA_PATH)})", ["documents"]))


def ts_shapes(spark, sf_dir):
    return X.ts_nodes(ts_files(spark, sf_dir)).select("file_path", "node_type", "name", "start_line", "end_line", "exported", F.length("body").alias("body_length"))


def java_shapes(spark, sf_dir):
    files = java_files(spark, sf_dir)
    methods = X.java_methods(files).withColumn("class_name", F.col("props")["class_name"])
    classes = X.java_classes(files).withColumn("class_name", F.lit(""))
    columns = ["file_path", "node_type", "name", "start_line", "end_line", "class_name", F.length("body").alias("body_length")]
    return classes.select(*columns).unionByName(methods.select(*columns))


def shape_calls(spark, sf_dir):
    nodes = durable(X.ts_nodes(ts_files(spark, sf_dir)), "nodes")
    return X.call_edges(nodes).unionByName(L.resolve_wildcards(X.uses_hook_specs(nodes), nodes).select("src", "rel_type", "dst", "props")).select("src", "rel_type", "dst")


QUERIES = {f.__name__: f for f in (ts_shapes, java_shapes, shape_calls)}

_WITH = f"WITH d AS ({_DOCS})"
_EDGES = [("CALLS", "doc", "helper"), ("CALLS", "note", "send"), ("CALLS", "Quote", "useQuote"), ("CALLS", "Load", "over"), ("USES_HOOK", "Quote", "useQuote")]
ORACLES = {
    "ts_shapes": f"{_WITH} {_expected(TS_SHAPES, _TS_PATH, ['lead'])}",
    "java_shapes": f"{_WITH} {_expected(JAVA_SHAPES, _JAVA_PATH, [])}",
    "shape_calls": f"{_WITH}, e AS (SELECT *, concat(file_path, ':', node_type, ':', name, ':', start_line) AS id, regexp_replace(name, '[0-9]+$', '') AS base FROM ({_expected(TS_SHAPES, _TS_PATH, ['lead'])})) "
    + " UNION ALL ".join(f"SELECT a.id AS src, '{kind}' AS rel_type, b.id AS dst FROM e a JOIN e b USING (file_path) WHERE a.base = '{x}' AND b.base = '{y}'" for kind, x, y in _EDGES),
}
