"""Broad wildcard specs make as many edges as specs times nodes; these edges are neither moved nor sorted, and none is lost or doubled."""

from pyspark.sql import functions as F

from weftgraph.operators import link as L
from weftgraph.sources.store import BucketTable

NODE = "node_id string, node_type string, file_path string, name string, start_line int"
END = "struct<node_type string, file_path string, name string, line int>"
SPEC = f"src {END}, rel_type string, dst {END}, seq bigint, props map<string,string>"


def _brute(nodes, specs):
    def hits(end):
        if end[1] is None and end[2] is None and end[3] is None:
            return []
        return [n[0] for n in nodes if all(want is None or want == have for want, have in zip(end, n[1:], strict=True))]

    best = {}
    for src, rel, dst, seq, props in specs:
        for a in hits(src):
            for b in hits(dst):
                best[a, rel, b] = max(best.get((a, rel, b), (-1, "")), (-1 if seq is None else seq, "" if seq is None else props["k"]))
    return best


def test_edges_equal_those_of_a_plain_search(spark):
    nodes = [(f"f{i}", "Function", f"a{i % 3}", f"n{i % 7}", i % 5) for i in range(40)]
    nodes += nodes[:10]  # rows that come twice
    nodes += [("f1", "Function", "a2", "n1", 1), ("f2", "Hook", "a0", "n2", 2), (None, "Function", "a0", "n0", 0), (None, "Function", "a1", None, None), ("f50", "File", None, "x", None)]
    broad = [("Function", f"a{k}", None, None) for k in range(3)] + [(None, None, "n3", None), ("Function", "a1", "n4", None), (None, "a0", None, 2), ("Function", None, None, None), (None, "zz", None, None)]
    specs = [(src, "R" if (i + j) % 4 else None, dst, None if (i * j) % 5 == 4 else 100 * i + j, {"k": f"{i}.{j}"}) for i, src in enumerate(broad) for j, dst in enumerate(broad)]
    specs += [((None, None, f"n{k % 7}", None), "S", ("Function", f"a{k % 3}", None, None), k, {"k": f"s{k}"}) for k in range(60)]
    found = L.resolve_wildcards(spark.createDataFrame(specs, SPEC), spark.createDataFrame(nodes, NODE)).collect()
    got = {(r["src"], r["rel_type"], r["dst"]): r["props"] for r in found}
    want = _brute(nodes, specs)
    assert len(found) == len(got) and got.keys() == want.keys()
    assert {k: (v or {}).get("k", "") for k, v in got.items()} == {k: v[1] for k, v in want.items()}
    assert L.resolve_wildcards(spark.createDataFrame([], SPEC), spark.createDataFrame(nodes, NODE)).count() == 0


def test_edges_of_broad_specs_do_not_move(spark):
    nodes = spark.range(2000).select(F.concat(F.lit("f"), "id").alias("node_id"), F.lit("Function").alias("node_type"), F.lit("a").alias("file_path"),
                                     F.concat(F.lit("n"), "id").alias("name"), F.col("id").cast("int").alias("start_line"))
    null = F.lit(None).cast("string")
    specs = spark.range(300).select(
        F.struct(null.alias("node_type"), null.alias("file_path"), F.concat(F.lit("n"), "id").alias("name"), F.lit(None).cast("int").alias("line")).alias("src"), F.lit("R").alias("rel_type"),
        F.struct(F.lit("Function").alias("node_type"), F.lit("a").alias("file_path"), null.alias("name"), F.lit(None).cast("int").alias("line")).alias("dst"),
        F.col("id").alias("seq"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("props"))
    found = L.resolve_wildcards(specs, nodes)
    assert found.count() == 600_000
    # the first side of the union holds them: no aggregate and no exchange stands over the join that makes them
    over = found._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[0]
    assert over.startswith("Union") and "Aggregate" not in over and "Repartition" not in over


def test_edges_go_into_a_table_whose_props_were_never_null(spark, tmp_path):
    old = spark.range(1).select(F.lit("a").alias("src"), F.lit("R").alias("rel_type"), F.lit("b").alias("dst"), F.create_map(F.lit("k"), F.lit("v")).alias("props"))
    table = BucketTable.create(spark, str(tmp_path / "t"), old.schema, ["src", "rel_type", "dst"], buckets=2).upsert(old)
    specs = spark.createDataFrame([((None, None, "n", None), "R", (None, None, "n", None), 1, {"k": "w"})], SPEC)
    found = table.upsert(L.resolve_wildcards(specs, spark.createDataFrame([("x", "File", "f", "n", 1)], NODE)))
    assert sorted((r["src"], r["props"]["k"]) for r in found.read().collect()) == [("a", "v"), ("x", "w")]


def test_few_broad_specs_make_their_edges_in_many_tasks(spark):
    nodes = spark.createDataFrame([(f"f{i}", "Function", "a", f"n{i}", i) for i in range(400)], NODE)
    broad = [((None, None, f"n{i}", None), "R", ("Function", "a", None, None), i, {"k": f"v{i}"}) for i in range(200)]
    found = L.resolve_wildcards(spark.createDataFrame(broad, SPEC), nodes, {"twice": F.concat(F.col("props")["k"], F.col("props")["k"])})
    counts = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 80_000 and len(counts) >= 4 and max(counts) <= 40_000
    assert {(r["src"], r["twice"]) for r in found.filter("dst = 'f7'").collect()} == {(f"f{i}", f"v{i}v{i}") for i in range(200)}
