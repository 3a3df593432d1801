"""File trees, extraction shapes and streams."""

import json

from pyspark.sql import functions as F

from weftgraph import CodeGraph, Graph
from weftgraph.operators import embed as B
from weftgraph.operators import extract as E
from weftgraph.sources import audit_log, files as S
from weftgraph.streaming import audit as SA, limits as SL


def test_discovery_and_decoding(spark, tmp_path):
    for name, data in {"src/a.ts": b"let a;\n", "src/deep/b.tsx": b"x", "src/a.test.ts": b"t", "node_modules/p/q/c.ts": b"n", "src/bad.ts": b"\xff\xfe", "src/d.java": b"class D {}"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    raw = S.discover_files(spark, str(tmp_path), "web", "typescript")
    good, errors = S.read_sources(raw)
    assert sorted(r.path for r in good.collect()) == ["src/a.ts", "src/deep/b.tsx"]
    assert [(r.path, r.error) for r in errors.collect()] == [("src/bad.ts", "not valid UTF-8")]
    java = S.discover_files(spark, str(tmp_path), "core", "java", include=["**/*.java"])
    assert [r.path for r in java.collect()] == ["src/d.java"]


TS = """/** Adds. */
function add(a: number,
             b: number): number {
  return a + b;
}
export const Card = ({ title }: Props): JSX.Element => (
  <div>{title}</div>
);
export const twice = n => add(n, n);
type Shape =
  | 'a'
  | 'b';
export { add };
"""
ROUTES = {"src/app/[[...slug]]/page.tsx": "/:slug*", "src/app/(shop)/items/[id]/page.tsx": "/items/:id", "src/app/[...all]/route.ts": "/:all+", "src/lib/page.tsx": None}


def test_typescript_shapes(spark):
    files = spark.createDataFrame([("web", "m.tsx", TS)], "repo string, path string, content string")
    got = {r.name: r for r in E.ts_nodes(files).collect()}
    assert (got["add"].start_line, got["add"].end_line, got["add"].docstring, got["add"].exported) == (2, 5, "/** Adds. */", True)
    assert got["add"].signature.startswith("add(a: number,") and got["add"].signature.endswith("): number")
    assert (got["Card"].node_type, got["Card"].start_line, got["Card"].end_line, got["Card"].props["has_jsx"]) == ("Component", 6, 8, "true")
    assert got["twice"].end_line == 9 and got["Shape"].end_line == 12
    calls = {(r.src.split(":")[2], r.dst.split(":")[2]) for r in E.call_edges(E.ts_nodes(files)).collect()}
    assert calls == {("twice", "add")}


def test_routes(spark):
    df = spark.createDataFrame([(p,) for p in ROUTES], "path string")
    assert {r.path: r.route for r in df.select("path", E.route_of(F.col("path")).alias("route")).collect()} == ROUTES


def test_annotations(spark):
    cases = {"@Service": ("Service", None, None), '@RequestMapping("/a")': ("RequestMapping", "/a", None),
             '@RequestMapping(value = "/b", method = RequestMethod.POST)': ("RequestMapping", "/b", "POST"), '@Api(tags = "x")': ("Api", "x", None), "@Size(max = 3)": ("Size", None, None)}
    df = spark.createDataFrame([(c,) for c in cases], "t string").select("t", E.parse_annotation(F.col("t")).alias("a"))
    assert {r.t: (r.a.name, r.a.value, r.a.method) for r in df.collect()} == cases


def test_embedding_runs_once_per_distinct_text(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def fn(items):
        import uuid

        for t in items:
            (calls / uuid.uuid4().hex).write_text(t)
        return [[float(len(t))] for t in items]

    texts = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "bbb"), (4, "   "), (5, None)], "id int, text string")
    cache = spark.createDataFrame([], "content_hash string, vector array<double>, model string")
    vectors, fresh = B.embed(texts, cache, fn, "m")
    assert {r.id: r.vector for r in vectors.collect()} == {1: [2.0], 2: [2.0], 3: [3.0], 4: [1.0], 5: [1.0]}
    assert len(list(calls.iterdir())) == 3 and fresh.count() == 3


def test_stream_restarts_and_clears(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    source.mkdir()

    def push(name, rows):
        (source / name).write_text("\n".join(json.dumps(dict(zip(("session_id", "event_id", "ts", "resource", "tokens"), r))) for r in rows))

    def run():
        events = spark.readStream.schema("session_id string, event_id long, ts timestamp, resource string, tokens long").json(str(source))
        SA.write_stream(SL.limit_stream(events, {"llm_calls": 2}, 1, 100), out, mark).awaitTermination()
        return {r.event_id: (r.resource, r.allowed, r.current) for r in spark.read.parquet(out).collect()}

    push("1.json", [("s", i, f"2024-01-01T00:00:0{i}", "llm_calls", 0) for i in range(2)] + [("s", 2, "2024-01-01T00:00:03", "tokens", 90), ("s", 3, "2024-01-01T00:00:04", "build", 0)])
    run()
    push("2.json", [("s", 4, "2024-01-01T00:01:00", "llm_calls", 0), ("s", 5, "2024-01-01T00:01:01", "tokens", 20), ("s", 6, "2024-01-01T00:01:02", "build", 0),
                    ("s", 7, "2024-01-01T00:01:03", "session_start", 0), ("s", 8, "2024-01-01T00:01:04", "llm_calls", 0), ("s", 9, "2024-01-01T00:01:05", "tokens", 20)])
    got = run()
    assert got == {0: ("llm_calls", True, 0), 1: ("llm_calls", True, 1), 2: ("tokens", True, 90), 3: ("build", True, 0), 4: ("llm_calls", False, 2),
                   5: ("tokens", False, 110), 6: ("build", False, 1), 8: ("llm_calls", True, 0), 9: ("tokens", True, 20)}


def test_malformed_audit_lines_are_skipped(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"timestamp":"2024-01-01T00:00:00+00:00","session_id":"s","event_type":"FILE_WRITE","details":{"is_new":"true"}}\nnot json\n')
    rows = audit_log.read_audit(spark, str(tmp_path)).collect()
    assert len(rows) == 1 and rows[0].details == {"is_new": "true"}


def test_facade(spark):
    nodes = spark.createDataFrame([("a", "Function", "fa", "r", "x.ts"), ("b", "Function", "fb", "r", "x.ts")], "node_id string, node_type string, name string, repo string, file_path string")
    edges = spark.createDataFrame([("a", "CALLS", "b")], "src string, rel_type string, dst string")
    code = CodeGraph(Graph(nodes, edges), files=spark.createDataFrame([("r", "x.ts", "body")], "repo string, path string, content string"))
    asked = spark.createDataFrame([("fb",)], "name string")
    assert [(r.caller_name, r.callee_name) for r in code.find_callers(asked).collect()] == [("fa", "fb")]
    assert code.get_node_graph(asked).first()["items"] == "fa"
    assert code.get_file_content(spark.createDataFrame([("r", "/x.ts")], "repo string, file_path string")).first()["content"] == "body"
    assert code.register_views(spark) == ["code_nodes", "code_edges", "code_files"] and spark.sql("select count(*) from code_nodes").first()[0] == 2
