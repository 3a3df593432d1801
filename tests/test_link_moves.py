"""Loading links and upserts move long rows without sorting them where they come from, and load no edges where only nodes are read."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from weftgraph.operators import link as L
from weftgraph.plans import views as V
from weftgraph.sources import tables as T

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _nodes(spark):
    rows = [(f"f{i}", "Function", "a.ts" if i % 2 else None, i, i + 9, None) for i in range(1, 40)]
    rows += [(f"e{i}", "APIEndpoint", "b.java", 1, 1, {"path": f"/p{i % 5}", "http_method": "GET"}) for i in range(8)]
    return spark.createDataFrame(rows, "node_id string, node_type string, file_path string, start_line int, end_line int, props map<string,string>")


def _links(spark):
    rows = [("a.ts" if i % 7 else None, i % 60, "GET", f"/p{i % 6}" if i % 11 else None, 1.0, f"/u/{i}") for i in range(300)]
    return spark.createDataFrame(rows, "fe_file string, fe_line int, be_method string, be_path string, confidence double, fe_url string")


def test_load_links_hashes_what_it_looks_up_and_sorts_links_once(spark):
    links, nodes = _links(spark), _nodes(spark)
    found = L.load_links(links, nodes)
    text = plan(found)
    assert not re.search(r"SortMergeJoin \[(fe_file#\d+, fe_line|be_path)", text) and text.count("ShuffledHashJoin") >= 2
    want = {}
    for k in links.collect():
        around = [(n["end_line"] - n["start_line"], n["node_id"]) for n in nodes.collect()
                  if n["node_type"] == "Function" and n["file_path"] == k["fe_file"] and k["fe_file"] and n["start_line"] <= k["fe_line"] <= n["end_line"]]
        ends = [n["node_id"] for n in nodes.collect() if n["props"] and k["be_path"] and n["props"]["path"] == k["be_path"]] if around else []
        for e in ends:
            key = min(around)[1], e
            want[key] = max(want.get(key, (-1, "")), (k["fe_line"], k["fe_url"]))
    got = {(r["src"], r["dst"]): (r["rel_type"], r["props"]) for r in found.collect()}
    assert {k: v[1]["fe_url"] for k, v in got.items()} == {k: v[1] for k, v in want.items()} and len(got) > 50
    assert {v[0] for v in got.values()} == {"CONSUMES"} and {v[1]["confidence"] for v in got.values()} == {"1.0"}


def test_upsert_deals_rows_out_by_key_before_it_sorts_them(spark):
    old = spark.createDataFrame([("a", 1, "old"), ("a", 1, "old"), (None, 2, "old"), ("b", None, "kept")], "k string, n int, docstring string")
    new = spark.createDataFrame([("a", 1, "x" * 5000, 1), ("a", 1, "late", 2), (None, 2, None, None), ("c", 3, "added", 0)], "k string, n int, docstring string, v int")
    found = T.upsert(old, new, ["k", "n"], "v")
    text = plan(found)
    assert text.count("Exchange hashpartitioning") == 1 and "REPARTITION_BY_NUM" in text
    rows = {tuple(r) for r in found.collect()}
    assert rows == {("a", 1, "late"), (None, 2, None), ("b", None, "kept"), ("c", 3, "added")} and found.count() == 4


def test_queries_over_nodes_write_no_edges(spark, monkeypatch):
    monkeypatch.setattr(V, "_LOADED", {})
    for name in ("load_links", "load_counts", "upsert_nodes", "enclosing_entity", "wildcard_resolve"):
        entry_point.queries()[name](spark, SF)
    assert {key[2] for key in V._LOADED} == {"nodes"}
    nodes = V.star_nodes(spark, SF)
    graph = V.star_graph(spark, SF)  # the edges are added, the nodes stay
    assert {key[2] for key in V._LOADED} == {"nodes", "edges"} and sorted(graph.nodes.inputFiles()) == sorted(nodes.inputFiles())
    assert graph.edges.select(F.count("*")).first()[0] > 0
