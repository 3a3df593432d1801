"""weftgraph: code and document analytics on Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import graph as _graph
from weftgraph.operators import search as _search
from weftgraph.operators.graph import Graph
from weftgraph.sources import files as _files

__all__ = ["CodeGraph", "Graph"]


class CodeGraph:
    """The read operators by name over one set of tables. Every method takes and returns DataFrames.

    ``points`` holds vec_id, vector, repo, node_type, name, content; ``files`` holds repo, path, content.
    """

    def __init__(self, graph: Graph, points: DataFrame | None = None, files: DataFrame | None = None):
        self.graph, self.points, self.files = graph, points, files

    def search_code(self, queries: DataFrame, repos: list[str] | None = None, node_types: list[str] | None = None, limit: int = 10) -> DataFrame:
        """``queries``: query_id, vector -> report rows with related names."""
        return _search.search_report(_search.hybrid_search(queries, self.points, self.graph, limit, repos, node_types))

    def get_node_graph(self, names: DataFrame, depth: int = 1) -> DataFrame:
        return _graph.section_report(_graph.neighbors(self.graph, names, depth), ["seed"], "direction", "name", 10)

    def find_callers(self, names: DataFrame, limit: int = 50) -> DataFrame:
        return _graph.find_callers(self.graph, names, limit)

    def find_api_contracts(self, repo: str | None = None) -> DataFrame:
        return _graph.api_contracts(self.graph, repo)

    def cross_repo_trace(self, paths: list[str], depth: int = 2) -> DataFrame:
        return _graph.section_report(_graph.cross_repo_impact(self.graph, paths, depth), ["request", "endpoint_id"], "role", "node", 5)

    def get_file_content(self, requests: DataFrame, bases: list[str] | None = None, max_chars: int = 10_000) -> DataFrame:
        return _files.file_content(self.files, requests, bases, max_chars)

    def get_module_structure(self, modules: DataFrame) -> DataFrame:
        """Files and entities cut at 20 labels, imports at 10."""
        rows = _graph.module_graph(self.graph, modules)
        wide = _graph.section_report(rows.filter("kind <> 'import'"), ["module_id"], "kind", "node", 20)
        return wide.unionByName(_graph.section_report(rows.filter("kind = 'import'"), ["module_id"], "kind", "node", 10))

    def stats(self) -> DataFrame:
        return _graph.label_counts(self.graph).orderBy(F.desc("n"), "node_type")

    def register_views(self, spark: SparkSession, prefix: str = "code_") -> list[str]:
        """Temporary views for SQL users."""
        tables = {"nodes": self.graph.nodes, "edges": self.graph.edges, "points": self.points, "files": self.files}
        made = []
        for name, df in tables.items():
            if df is not None:
                df.createOrReplaceTempView(f"{prefix}{name}")
                made.append(f"{prefix}{name}")
        return made
