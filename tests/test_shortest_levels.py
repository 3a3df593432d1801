"""Shortest paths write no level for requests that are answered, and rank parallel edges by type."""

from weftgraph.operators import graph as G


def _graph(spark, edges):
    names = sorted({x for e in edges for x in (e[0], e[2]) if x})
    nodes = spark.createDataFrame([(n, n.upper().rstrip("0123456789")) for n in names], "node_id string, name string")
    return G.Graph(nodes, spark.createDataFrame(edges, "src string, rel_type string, dst string"))


def _found(spark, edges, asked, depth=5):
    rows = G.shortest_path(_graph(spark, edges), spark.createDataFrame(asked, "start string, end string"), depth).collect()
    return {(r["start"], r["end"]): (r["length"], r["nodes"], r["rels"]) for r in rows}


def test_levels_of_answered_requests_are_not_written(spark, monkeypatch):
    written = {}
    plain = G.durable

    def counted(df, label="stage"):
        out = plain(df, label)
        written[label] = max(written.get(label, 0), out.count())
        return out

    monkeypatch.setattr(G, "durable", counted)
    edges = [("s", "CALLS", f"leaf{i}") for i in range(50)] + [("s", "CALLS", "t")]
    assert _found(spark, edges, [("S", "T")]) == {("S", "T"): (1, ["s", "t"], ["CALLS"])}
    assert written["front"] == 1


def test_parallel_edges_and_depth(spark):
    edges = [("a", "USES", "b"), ("a", "CALLS", "b"), ("b", None, "c"), ("c", "Z", "b"), ("c", None, "d"), ("a", "Q", "x"), ("x", "Q", "d"), ("d", "R", "e"),
             ("a", "SELF", "a"), ("e", None, None)]
    got = _found(spark, edges, [("A", "C"), ("A", "D"), ("A", "E"), ("C", "D"), ("A", "NONE"), ("E", "E")])
    assert got == {("A", "C"): (2, ["a", "b", "c"], ["CALLS", "Z"]), ("A", "D"): (2, ["a", "x", "d"], ["Q", "Q"]),
                   ("A", "E"): (3, ["a", "x", "d", "e"], ["Q", "Q", "R"]), ("C", "D"): (1, ["c", "d"], [None]), ("E", "E"): (2, ["e", "d", "e"], ["R", "R"])}
    assert _found(spark, edges, [("A", "E")], 2) == {}


def test_start_and_end_of_one_name(spark):
    edges = [("x1", "CALLS", "x2"), ("x2", "CALLS", "y"), ("y", "CALLS", "x3")]
    assert _found(spark, edges, [("X", "X")]) == {("X", "X"): (2, ["x2", "y", "x2"], ["CALLS", "CALLS"])}
