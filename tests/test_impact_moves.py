"""Impact: roles as before, and every edge moves once a side and its row once more."""

from weftgraph.operators import graph as G


def _graph(spark):
    nodes = [("f1", "Function", "f"), ("f2", "Function", "f"), ("e1", "APIEndpoint", "e"), ("e1b", "APIEndpoint", "f"), ("c1", "Component", "c"), ("c2", "Component", "c"), ("c2", "Hook", "c")]
    edges = [("c1", "CALLS", "f1"), ("c1", "CALLS", "f2"), ("c1", "CONSUMES", "e1"), ("c1", "CONSUMES", "e1"), ("c2", "CONSUMES", "e1b"), ("c1", "CONSUMES", "f1"),
             ("e1", "EXPOSED_BY", "f1"), ("f1", "CALLS", "gone")]
    return G.Graph(spark.createDataFrame(nodes, "node_id string, node_type string, name string").selectExpr("*", "'r' as repo"),
                   spark.createDataFrame(edges, "src string, rel_type string, dst string"))


def test_impact_rows(spark):
    rows = G.impact(_graph(spark), spark.createDataFrame([("f",), ("e",)], "name string")).collect()
    assert sorted(map(tuple, rows)) == sorted([
        ("f", "dependent", "c1", "CALLS", "Component", 1), ("f", "dependent", "c1", "CONSUMES", "Component", 1), ("f", "dependent", "e1", "EXPOSED_BY", "APIEndpoint", 1),
        ("f", "dependent", "c2", "CONSUMES", "Component", 1), ("f", "dependent", "c2", "CONSUMES", "Hook", 1),
        ("f", "cross_repo", "c2", "CONSUMES", "Component", 1), ("f", "cross_repo", "c2", "CONSUMES", "Hook", 1),
        ("e", "dependent", "c1", "CONSUMES", "Component", 1), ("e", "cross_repo", "c1", "CONSUMES", "Component", 1),
        ("e", "dependency", "f1", "EXPOSED_BY", "Function", 1)])


def test_impact_moves_edges_twice_and_rows_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = G.impact(_graph(spark), spark.createDataFrame([("f",), ("e",)], "name string"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # two sides: seeds, edges, rows, types
    assert plan.count("Exchange hashpartitioning") <= 8
