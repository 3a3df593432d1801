"""The written vector index: recall, pruned cells, passes, ties and empty inputs."""

import numpy as np

from weftgraph.operators import search as S
from weftgraph.operators import vector_index as V


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "vec_id long, vector array<double>")


def test_index_finds_nearest_and_reads_few_cells(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(25, 16))[rng.integers(0, 25, 3000)] + 0.15 * rng.normal(size=(3000, 16))).tolist()
    rows += [rows[0]] * 40  # copies: ties by id
    pool = vectors(spark, rows)
    V.write_index(pool.unionByName(spark.createDataFrame([(-1, []), (-2, None)], pool.schema)), str(tmp_path / "x"), k=10, cell_rows=500)
    asked = pool.filter("vec_id % 50 = 0").selectExpr("vec_id as query_id", "vector")
    exact = {(r["query_id"], r["vec_id"]) for r in S.knn(asked, pool, 10).collect()}
    for size in (1 << 20, 2000):  # one pass over the cells, or several
        got = V.search_index(spark, str(tmp_path / "x"), asked, 10, broadcast_bytes=size)
        pairs = {(r["query_id"], r["vec_id"]) for r in got.collect()}
        assert len(pairs & exact) >= 0.9 * len(exact)
    one = V.search_index(spark, str(tmp_path / "x"), asked.filter("query_id = 0"), 10)
    assert [r["vec_id"] for r in one.orderBy("rank").collect()] == [0, *range(3000, 3009)]
    meta = spark.read.parquet(str(tmp_path / "x/centres")).first()
    text = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [" in text and "cell" in text.split("PartitionFilters: [")[1].split("]")[0]
    assert meta["probes"] < 25
    assert V.search_index(spark, str(tmp_path / "x"), asked.limit(0)).collect() == []


def test_empty_index(spark, tmp_path):
    V.write_index(vectors(spark, []), str(tmp_path / "e"))
    assert V.search_index(spark, str(tmp_path / "e"), spark.createDataFrame([(1, [1.0])], "query_id long, vector array<double>")).collect() == []
