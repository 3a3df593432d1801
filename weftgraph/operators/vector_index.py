"""Vector index on storage: vectors written by cell, queries read the nearest cells only.

Cells are k-means centres of the directions of a sample (``SAMPLE`` rows at most, in the order of a hash of their ids); every vector is indexed. How
many cells a query must read is measured on the sample too, against exact search. Cells are partitions of the written table, so a search prunes
to the folders that any query asks for; a large cell is written, and read, by several tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.operators.search import _id_array, _keep, _matrix, _parts
from weftgraph.plans.scale import BROADCAST_BYTES, top_rows

SAMPLE = 20_000
CELL_ROWS = 50_000


def fit_cells(directions: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means of unit vectors; an empty cell takes the vector that is farthest from its centre."""
    rng = np.random.default_rng(seed)
    centres = directions[rng.choice(len(directions), cells, replace=False)]
    for _ in range(rounds):
        near = directions @ centres.T
        cell = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, directions)
        far = np.argsort(near.max(axis=1))
        for empty, row in zip(np.flatnonzero(np.bincount(cell, minlength=cells) == 0), far, strict=False):
            sums[empty] = directions[row]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def probes_for(directions: np.ndarray, centres: np.ndarray, k: int, recall: float) -> int:
    """Fewest nearest cells that hold ``recall`` of the exact top k of the sample's own vectors."""
    asked = directions[:: max(1, len(directions) // 500)]
    top = np.argsort(-(asked @ directions.T), axis=1, kind="stable")[:, : k + 1]
    cell = (directions @ centres.T).argmax(axis=1)
    rank = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)  # rank of every cell for every query
    needed = np.sort(np.take_along_axis(rank, cell[top], axis=1).ravel())
    return min(len(centres), int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1)


def write_index(vectors: DataFrame, path: str, k: int = 20, recall: float = 0.95, cell_rows: int = CELL_ROWS, sample: int = SAMPLE) -> None:
    """Index of ``vectors(vec_id, vector)`` below ``path``; null and empty vectors have no direction and are left out."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "vector").filter("size(vector) > 0")
    n = rows.count()
    local = _matrix(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()["vector"]) if n else np.zeros((0, 1))
    cells = max(1, min(len(local), 4 * int(np.sqrt(n)) if n < cell_rows else -(-4 * n // cell_rows)))
    cells = min(cells, max(1, len(local) // 20))
    centres = fit_cells(local, cells) if len(local) else local
    probes = probes_for(local, centres, k, recall) if len(local) else 0
    shipped = spark.sparkContext.broadcast(centres)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=(_matrix(pdf["vector"]) @ shipped.value.T).argmax(axis=1).astype(np.int32))

    placed = rows.mapInPandas(place, T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())]))
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n // (cells * cell_rows)) * 4)))
    placed.repartition("cell", salt).write.partitionBy("cell").parquet(f"{path}/cells")
    meta = {"centres": json.dumps(centres.tolist()), "probes": probes}
    spark.createDataFrame([meta], "centres string, probes int").coalesce(1).write.parquet(f"{path}/centres")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 20, probes: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Cosine top-k of ``queries(query_id, vector)``: query_id, vec_id, score, rank. Ties go by vec_id.

    Queries travel to the tasks in blocks of bounded size; every block is a pass over the cells that it asks for.
    """
    meta = spark.read.parquet(f"{path}/centres").first()
    centres, wanted = np.array(json.loads(meta["centres"])), probes or meta["probes"]
    asked = queries.select("query_id", "vector").filter("size(vector) > 0")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    schema = T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("vec_id", T.LongType()), T.StructField("score", T.DoubleType())])
    if not size["n"] or not len(centres):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())]))
    stored = spark.read.parquet(f"{path}/cells")
    schema = T.StructType([schema.fields[0], stored.schema["vec_id"], schema.fields[2]])
    passes = -(-size["n"] * size["d"] * 8 // broadcast_bytes)
    found = []
    for number in range(passes):
        local = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == number).toPandas()
        if not len(local):
            continue
        q = _matrix(local["vector"])
        near = np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :wanted]
        of_cell = {int(c): np.flatnonzero((near == c).any(axis=1)) for c in np.unique(near)}
        shipped = spark.sparkContext.broadcast((_id_array(local["query_id"]), q, of_cell))

        def scan(batches: Iterator[pd.DataFrame], shipped=shipped) -> Iterator[pd.DataFrame]:
            ids, q, of_cell = shipped.value
            best: dict[int, tuple] = {}
            for pdf in batches:
                for cell, part in pdf.groupby("cell", sort=False):
                    best[cell] = _keep(best.get(cell), q[of_cell[int(cell)]], _matrix(part["vector"]), _id_array(part["vec_id"]), k)
            for cell, (scores, names) in best.items():
                yield from _parts(ids[of_cell[int(cell)]], names, scores)

        pruned = stored.filter(F.col("cell").isin(*of_cell)).select("vec_id", "vector", "cell")
        found.append(pruned.mapInPandas(scan, schema))
    return top_rows(reduce(DataFrame.unionByName, found), ["query_id"], [F.desc("score"), F.col("vec_id")], k)
