"""The stored graph holds the rows of its SQL, and consumers are looked up for the asked endpoints only."""

from collections import Counter

from pyspark.sql import functions as F

from weftgraph.operators import graph as G
from weftgraph.plans import views as V


def _folder(spark, path):
    spark.sql("select cast(0 as int) r_regionkey, 'R0' r_name").write.parquet(f"{path}/region.parquet")
    spark.sql("select cast(id as int) n_nationkey, concat('N', id) n_name, cast(0 as int) n_regionkey from range(3)").write.parquet(f"{path}/nation.parquet")
    spark.sql("select id s_suppkey, concat('S', id) s_name, cast(id % 3 as int) s_nationkey, 1.0D s_acctbal from range(4)").write.parquet(f"{path}/supplier.parquet")
    spark.sql("select id c_custkey, concat('C', id) c_name, cast(id % 3 as int) c_nationkey, -1.0D c_acctbal, 'M' c_mktsegment from range(5)").write.parquet(f"{path}/customer.parquet")
    spark.sql("select id p_partkey, 'p' p_name, concat('Brand#', id) p_brand, 't' p_type, cast(id * 9 as int) p_size from range(6)").write.parquet(f"{path}/part.parquet")
    spark.sql("select id o_orderkey, id % 5 o_custkey, 'O' o_orderstatus, '1' o_orderpriority from range(8)").write.parquet(f"{path}/orders.parquet")
    lines = [(1, 2, 3), (1, 2, 3), (1, 2, 0), (None, 2, 1), (None, 2, 1), (3, None, None), (3, None, 2), (4, 5, 3), (None, None, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{path}/lineitem.parquet")


def test_stored_graph_is_that_of_the_sql(spark, tmp_path):
    path = str(tmp_path)
    _folder(spark, path)
    g = V.star_graph(spark, path)
    edges = V.sql_over(spark, path, V.EDGE_SQL, V.STAR)
    assert Counter(map(tuple, g.edges.select("src", "rel_type", "dst").collect())) == Counter(map(tuple, edges.collect()))
    columns = ["node_id", "node_type", "name", "repo", "file_path", "start_line", "end_line", "signature", "exported"]
    nodes = V.sql_over(spark, path, V.NODE_SQL, V.STAR).select(*columns)
    assert Counter(map(tuple, g.nodes.select(*columns).collect())) == Counter(map(tuple, nodes.collect()))
    # spelled after they are distinct: the keys are moved as numbers
    plan = V.sql_over(spark, path, V._SPARK_EDGES, V.STAR)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [l_orderkey" in plan and "Aggregate [concat(order:" not in plan


def test_consumers_of_asked_endpoints(spark, tmp_path):
    path = str(tmp_path)
    _folder(spark, path)
    g = V.star_graph(spark, path)
    got = {(r["request"], r["consumer"]) for r in G.consumers_by_path(g, ["/api/brand-2/", "GET /api/brand-5/5", "nothing"]).collect()}
    assert got == {("/api/brand-2/", "Order1")}
    ends = g.nodes.filter("name = 'POST /api/brand-5/5'").select(F.col("node_id").alias("endpoint_id"))
    assert [r["consumer"] for r in G._consumers(g, ends).collect()] == ["Order4"]
