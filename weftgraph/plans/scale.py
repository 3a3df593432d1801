"""Plan shaping for skewed data: durable tables, size checks, running totals and ordered folds.

The helpers aim at no more than ``max_rows`` rows of one key in a task. Range bounds are sampled, so a block can exceed that target somewhat.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_GROUP_ROWS = 2_000_000
BROADCAST_BYTES = 32 << 20
_FALLBACK_DIR: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder named by the cluster. A temporary folder stands in only where none is set and all tasks share this machine."""
    global _FALLBACK_DIR
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _FALLBACK_DIR is None:
        _FALLBACK_DIR = tempfile.mkdtemp(prefix="weftgraph-")
    return _FALLBACK_DIR


def new_path(spark: SparkSession, label: str) -> str:
    """A new folder below the application's own one, which may be removed once the application has ended."""
    return f"{scratch_dir(spark)}/weftgraph/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out to all cores when the input has fewer partitions than the cluster has cores.

    Only inputs too small to fill the cluster are moved; a large scan already has more splits than cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def gather(df: DataFrame, parts: int = 16) -> DataFrame:
    """Several read partitions a task, for many small files: a task of its own costs more than such a partition. No rows move, and every core gets its tasks."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    read = df.rdd.getNumPartitions()
    return df.coalesce(max(4 * cores, -(-read // parts))) if read > 4 * cores else df


def group_shape(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows, rows of the largest key); map-side combined, two numbers reach the driver."""
    row = df.groupBy(*keys).count().agg(F.sum("count").alias("n"), F.max("count").alias("m")).first()
    return int(row["n"] or 0), int(row["m"] or 0)


def range_blocks(df: DataFrame, keys: list[str], order: list[str], rows: int, max_rows: int, blocks: int | None = None) -> DataFrame:
    """Split by (keys, order) ranges so that a hot key spans several blocks; ``_block`` follows the order. ``blocks`` overrides their number."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = blocks or max(parts, -(-2 * rows // max_rows))
    ranged = df.repartitionByRange(n, *keys, *order).withColumn("_block", F.spark_partition_id())
    return durable(ranged, "blocks")


def running_totals(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    totals: dict[str, Column],
    max_rows: int = MAX_GROUP_ROWS,
    blocks: int | None = None,
) -> DataFrame:
    """Inclusive running sums per key in ``order`` (a unique order).

    Small keys use a plain window. When a key is larger than ``max_rows`` the rows are range-split into blocks:
    block sums first, an offset per block, then a window inside each block.
    """
    marked = df.select("*", *[value.alias(f"_v_{name}") for name, value in totals.items()])
    rows, largest = group_shape(df, keys)
    if largest <= max_rows:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        sums = {name: F.sum(f"_v_{name}").over(w) for name in totals}
        return marked.withColumns(sums).drop(*[f"_v_{name}" for name in totals])
    ranged = range_blocks(marked, keys, order, rows, max_rows, blocks)
    part = ranged.groupBy(*keys, "_block").agg(*[F.sum(f"_v_{name}").alias(f"_s_{name}") for name in totals])
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = part.select(
        *keys, "_block", *[F.coalesce(F.sum(f"_s_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in totals]
    )
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(offsets, [*keys, "_block"])
    sums = {name: F.sum(f"_v_{name}").over(inside) + F.col(f"_o_{name}") for name in totals}
    scratch = [f"{p}{name}" for name in totals for p in ("_v_", "_o_")]
    return joined.withColumns(sums).drop("_block", *scratch)


# A fold takes (rows of one key in order, state) and returns (new columns, state); the state is a list of longs.
Fold = Callable[[pd.DataFrame, list[int]], tuple[dict[str, object], list[int]]]


def ordered_fold(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fold: Fold,
    init: list[int],
    added: list[T.StructField],
    max_rows: int = MAX_GROUP_ROWS,
    blocks: int | None = None,
) -> DataFrame:
    """Order-dependent fold with feedback per key.

    Blocks hold whole keys while every key fits; otherwise keys are range-split and block states are passed on
    until no incoming state changes any more, which is exact and never puts a hot key into one task.
    """
    spark = df.sparkSession
    rows, largest = group_shape(df, keys)
    out_schema = T.StructType([f for f in df.schema.fields] + added)
    names = [f.name for f in out_schema.fields]
    added_names = [f.name for f in added]

    def run(pdf: pd.DataFrame, first_state: list[int] | None) -> tuple[pd.DataFrame, list[int]]:
        pdf = pdf.sort_values([*keys, *order], kind="mergesort").reset_index(drop=True)
        change = (pdf[keys] != pdf[keys].shift()).any(axis=1)
        starts = list(change[change].index) + [len(pdf)]
        parts: dict[str, list] = {name: [] for name in added_names}
        state = list(init)
        for k in range(len(starts) - 1):
            piece = pdf.iloc[starts[k]:starts[k + 1]]
            state = list(first_state) if k == 0 and first_state is not None else list(init)
            columns, state = fold(piece, state)
            for name in added_names:
                parts[name].extend(columns[name])
        for name in added_names:
            pdf[name] = pd.Series(parts[name], index=pdf.index, dtype=object)
        return pdf, state

    if largest <= max_rows:
        # far fewer blocks than keys: the per-group Python cost is paid per block, not per key
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * rows // max_rows))
        hashed = df.withColumn("_block", F.pmod(F.xxhash64(*keys), F.lit(n)))
        return hashed.groupBy("_block").applyInPandas(lambda pdf: run(pdf, None)[0][names], out_schema)

    ranged = range_blocks(df, keys, order, rows, max_rows, blocks)
    # a block boundary cuts at most one key, so fewer keys than blocks ever need a state passed on
    spans = ranged.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    per_key = Window.partitionBy(*keys)
    cut = durable(
        spans.withColumn("_spread", F.count("*").over(per_key)).filter("_spread > 1")
        .select(*keys, "_block", F.array(*[F.lit(v) for v in init]).cast("array<bigint>").alias("_state")),
        "states",
    )
    key_fields = [df.schema[k] for k in keys]
    state_schema = T.StructType(
        key_fields + [T.StructField("_block", T.IntegerType()), T.StructField("_out", T.ArrayType(T.LongType()))]
    )

    def state_only(pdf: pd.DataFrame) -> pd.DataFrame:
        _, state = run(pdf.drop(columns=["_state"]), list(pdf["_state"].iloc[0]))
        head = pdf.iloc[0]
        return pd.DataFrame({**{k: [head[k]] for k in keys}, "_block": [head["_block"]], "_out": [state]})

    chain = Window.partitionBy(*keys).orderBy("_block")
    outs = None
    pending = cut
    while not pending.isEmpty():
        fresh = durable(
            ranged.join(pending, [*keys, "_block"]).groupBy(*keys, "_block").applyInPandas(state_only, state_schema),
            "fold",
        )
        outs = fresh if outs is None else durable(
            fresh.unionByName(outs.join(fresh, [*keys, "_block"], "left_anti")), "fold")
        passed = outs.select(*keys, "_block", F.lag("_out").over(chain).alias("_next"))
        merged = durable(
            cut.join(passed, [*keys, "_block"])
            .select(*keys, "_block", "_state", F.coalesce("_next", "_state").alias("_next")),
            "states",
        )
        pending = merged.filter(F.col("_next") != F.col("_state")).select(*keys, "_block", F.col("_next").alias("_state"))
        cut = merged.select(*keys, "_block", F.col("_next").alias("_state"))

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values([*keys, *order], kind="mergesort")
        head = ordered["_state"].iloc[0]
        return run(ordered.drop(columns=["_state"]), None if head is None else list(head))[0][names]

    return ranged.join(cut, [*keys, "_block"], "left").groupBy("_block").applyInPandas(emit, out_schema)


def top_rows(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n per key; Spark prunes to n per key and task before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
