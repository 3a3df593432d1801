"""The driver tables seen as a property graph, as source files and as logs.

region = module, nation = file, supplier and customer = functions, part = endpoint, orders = component.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.graph import Graph
from weftgraph.plans.scale import new_path

_LOADED: dict[tuple[str, str, str], str] = {}


_TABLES: dict[tuple[str, str, str], DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; the footer is read once per application."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), name)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return _TABLES[key]


def sql_over(spark: SparkSession, sf_dir: str, text: str, names: list[str]) -> DataFrame:
    """Run SQL text over driver tables by name, without touching the session's own views."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(f"weft_{name}")
        for verb in ("FROM", "JOIN"):
            text = text.replace(f"{verb} {name}", f"{verb} weft_{name}")
    return spark.sql(text)


# Both engines run these texts; {map} and {map_end} spell a two-entry map.
NODE_SQL = """
  SELECT concat('region:', r_regionkey) AS node_id, 'Module' AS node_type, r_name AS name, 'back' AS repo,
         r_name AS file_path, 1 AS start_line, 1 AS end_line, '' AS signature, true AS exported,
         CAST(NULL AS STRING) AS http_method, CAST(NULL AS STRING) AS path FROM region
  UNION ALL
  SELECT concat('nation:', n_nationkey), 'File', n_name, 'back', n_name, 1, 1, '', true, NULL, NULL FROM nation
  UNION ALL
  SELECT concat('supplier:', s_suppkey), 'Function', s_name, 'back', concat('NATION_', s_nationkey),
         CAST(s_suppkey + 1 AS INT), CAST(s_suppkey + 10 AS INT), concat(s_name, '(balance: number)'), s_acctbal > 0, NULL, NULL
  FROM supplier
  UNION ALL
  SELECT concat('customer:', c_custkey), 'Function', c_name, 'front', concat('NATION_', c_nationkey),
         CAST(c_custkey + 1 AS INT), CAST(c_custkey + 10 AS INT), concat(c_name, '(segment: ', c_mktsegment, ')'), c_acctbal > 0, NULL, NULL
  FROM customer
  UNION ALL
  SELECT concat('part:', p_partkey), 'APIEndpoint',
         concat(CASE WHEN p_size > 25 THEN 'POST' ELSE 'GET' END, ' /api/', replace(lower(p_brand), '#', '-'), '/', p_partkey),
         'back', p_brand, CAST(p_partkey AS INT), CAST(p_partkey + p_size AS INT), '', false,
         CASE WHEN p_size > 25 THEN 'POST' ELSE 'GET' END, concat('/api/', replace(lower(p_brand), '#', '-'), '/', p_partkey)
  FROM part
  UNION ALL
  SELECT concat('order:', o_orderkey), 'Component', concat('Order', o_orderkey), 'front', o_orderpriority,
         CAST(o_orderkey AS INT), CAST(o_orderkey + 20 AS INT), concat('Order', o_orderkey, '(status: ', o_orderstatus, ')'),
         o_orderstatus = 'O', NULL, NULL
  FROM orders
  UNION ALL
  SELECT concat('endpoint:', n_nationkey), 'APIEndpoint', concat('GET /api/nations/', n_nationkey), 'back', n_name, 1, 9, '', false,
         'GET', concat('/api/nations/', n_nationkey)
  FROM nation
"""
EDGE_SQL = """
  SELECT concat('region:', n_regionkey) AS src, 'CONTAINS' AS rel_type, concat('nation:', n_nationkey) AS dst FROM nation
  UNION ALL SELECT concat('nation:', c_nationkey), 'CONTAINS', concat('customer:', c_custkey) FROM customer
  UNION ALL SELECT concat('nation:', s_nationkey), 'CONTAINS', concat('supplier:', s_suppkey) FROM supplier
  UNION ALL SELECT concat('nation:', a.n_nationkey), 'IMPORTS', concat('nation:', b.n_nationkey)
            FROM nation a JOIN nation b ON b.n_regionkey = (a.n_regionkey + 1) % 5
  UNION ALL SELECT concat('part:', l_partkey), 'EXPOSED_BY', concat('supplier:', min(l_suppkey)) FROM lineitem GROUP BY l_partkey
  UNION ALL SELECT DISTINCT concat('order:', l_orderkey), 'CONSUMES', concat('part:', l_partkey) FROM lineitem
  UNION ALL SELECT concat('customer:', o_custkey), 'CALLS', concat('order:', o_orderkey) FROM orders
  UNION ALL SELECT DISTINCT concat('order:', l_orderkey), 'CALLS', concat('supplier:', l_suppkey) FROM lineitem
  UNION ALL SELECT concat('supplier:', a.s_suppkey), 'CALLS', concat('supplier:', b.s_suppkey)
            FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1
"""


# What Spark runs: pairs of keys are made distinct as numbers, then spelled; the same rows, as equal spellings are equal numbers.
_SPARK_EDGES = EDGE_SQL
for _verb, _other, _key in (("CONSUMES", "part", "l_partkey"), ("CALLS", "supplier", "l_suppkey")):
    _SPARK_EDGES = _SPARK_EDGES.replace(
        f"SELECT DISTINCT concat('order:', l_orderkey), '{_verb}', concat('{_other}:', {_key}) FROM lineitem",
        f"SELECT concat('order:', l_orderkey), '{_verb}', concat('{_other}:', {_key}) FROM (SELECT DISTINCT l_orderkey, {_key} FROM lineitem)")

NODE_TYPES = ["Module", "File", "Function", "APIEndpoint", "Component"]
REL_TYPES = ["CONTAINS", "IMPORTS", "EXPOSED_BY", "CONSUMES", "CALLS"]
STAR = ["region", "nation", "supplier", "customer", "part", "orders", "lineitem"]


def _loaded(spark: SparkSession, sf_dir: str, kinds: list[str]) -> dict[str, str]:
    """Folders of the graph's ``nodes`` and ``edges``, each written when it is first asked for."""
    at = {kind: (spark.sparkContext.applicationId, sf_dir, kind) for kind in kinds}
    # a folder per type: each job reads only the tables of its type, and no task sorts its rows by type before it writes them
    parts, paths = [], {}
    if "edges" in kinds and at["edges"] not in _LOADED:
        paths[at["edges"]] = new_path(spark, "edges")
        edges = sql_over(spark, sf_dir, _SPARK_EDGES, STAR).withColumn("props", F.lit(None).cast("map<string,string>"))
        parts += [(edges, "rel_type", t, paths[at["edges"]]) for t in REL_TYPES]
    if "nodes" in kinds and at["nodes"] not in _LOADED:
        paths[at["nodes"]] = new_path(spark, "nodes")
        flat = sql_over(spark, sf_dir, NODE_SQL, STAR)
        props = F.when(F.col("path").isNotNull(), F.create_map(
            F.lit("http_method"), F.col("http_method"), F.lit("path"), F.col("path")))
        nodes = flat.select(
            "node_id", "node_type", "name", "repo", "file_path", "start_line", "end_line", "signature", "exported",
            F.array(F.concat(F.lit("Kind"), "node_type")).alias("annotations"), props.alias("props"))
        parts += [(nodes, "node_type", t, paths[at["nodes"]]) for t in NODE_TYPES]

    def load(part: tuple[DataFrame, str, str, str]) -> None:
        df, column, kind, folder = part
        df.filter(F.col(column) == kind).drop(column).write.parquet(f"{folder}/{column}={kind}")

    with ThreadPoolExecutor(4) as side_by_side:  # small tables fill the cores that a large one leaves
        list(side_by_side.map(load, parts))
    _LOADED.update(paths)
    return {kind: _LOADED[key] for kind, key in at.items()}


def star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes alone, for operators that take no edges: the same rows as those of ``star_graph``, and one load for both."""
    path = _loaded(spark, sf_dir, ["nodes"])["nodes"]
    return spark.read.parquet(path).select(
        "node_id", "node_type", "name", "repo", "file_path", "start_line", "end_line", "signature", "exported",
        "annotations", "props")


def star_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Load the graph tables once per application and folder, as an ingest run would, and read them back."""
    path = _loaded(spark, sf_dir, ["edges", "nodes"])["edges"]
    return Graph(star_nodes(spark, sf_dir), spark.read.parquet(path).select("src", "rel_type", "dst", "props"))


def graph_sql(query: str) -> str:
    """The same graph for an ANSI SQL engine."""
    return f"WITH RECURSIVE nodes AS ({NODE_SQL}), edges AS ({EDGE_SQL}) {query}"
