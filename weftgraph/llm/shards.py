"""Sharding by balanced label propagation over documents with equal texts; shard sizes follow the law ``rows``.

Documents of one text form a group of links. Every document starts at a hashed shard, so that even a group of a third of all rows is many
small cells. Groups then move to the shard that holds most of their documents among those that still have room for them; a full shard is
left out, and a group that a shard refused asks another one in the next round.

Groups over a sixteenth of a quota (an equal share of all rows) go first, the largest before the others; a group over a whole quota takes
empty shards. Smaller groups move as a whole, as many as the quota of their shard leaves open, by a hash of the group. What no shard has
granted, and then the documents without links, fill up what is left in one row, group by group, so that shard counts differ by one at
most and only the groups at the border of two shards are cut.

The driver sees counts per shard, and shard counts of the large groups, which are ``LARGE * n_shards`` at most. All tables between rounds
are groups and cells, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.scale import durable

N_SHARDS = 40
ROUNDS = 8
#: Parts that ranks are counted in, so that no task sorts a whole shard.
BLOCKS = 64
#: A group over this part of a quota is large.
LARGE = 16


def _ranked(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Adds a gapless number from 0 per key. Rows are counted per block of a hash first, so no task holds all rows of a key."""
    blocks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("_id", "_h"), F.lit(max(BLOCKS, blocks))))
    counts = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(counts.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o")), "offsets")
    inside = Window.partitionBy(*keys, "_b").orderBy("_id", "_h", "size")
    numbered = rows.withColumn("_r", F.row_number().over(inside) - 1)
    return numbered.join(offsets, [*keys, "_b"]).withColumn(name, F.col("_r") + F.col("_o")).drop("_b", "_r", "_o")


def _before(groups: DataFrame, key: str, name: str) -> DataFrame:
    """Adds the rows (``_n``) of the groups before each one of its key, in the order of a hash. As in ``_ranked``, no task holds all of a key."""
    blocks = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = groups.withColumn("_b", F.pmod(F.xxhash64("_g"), F.lit(max(BLOCKS, blocks))))
    counts = groups.groupBy(key, "_b").agg(F.sum("_n").alias("_m"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(counts.select(key, "_b", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_o")), "offsets")
    inside = Window.partitionBy(key, "_b").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    summed = groups.withColumn("_r", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    return summed.join(offsets, [key, "_b"]).withColumn(name, F.col("_r") + F.col("_o")).drop("_b", "_r", "_o")


def _pick(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index + 1)


def _place_large(held: dict[bytes, dict[int, int]], room: list[int]) -> list[tuple[bytes, int, int, int]]:
    """(group, first row, end row, shard) of the large groups, largest first; takes what they need from ``room``.

    A group goes whole to the shard with most of it among those that have room for all of it; if there is none, it fills the emptiest shard and
    the rest goes on.
    """
    pieces = []
    for g, cells in sorted(held.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        at, end = 0, sum(cells.values())
        while at < end:
            fit = [s for s, r in enumerate(room) if r >= end - at]
            to = max(fit, key=lambda s: (cells.get(s, 0), -s)) if fit else max(range(len(room)), key=lambda s: (room[s], cells.get(s, 0), -s))
            n = min(room[to], end - at)
            pieces.append((g, at, at + n, to))
            room[to] -= n
            at += n
    return pieces


def _place_small(groups: DataFrame, cells: DataFrame, room: list[int], rounds: int) -> DataFrame:
    """(_g, _n, _now) of the other groups, ``_now`` null where no shard granted the move; takes what is granted from ``room``."""
    out, pending = [], groups
    for _ in range(rounds):
        open_ = [s for s, r in enumerate(room) if r]
        if not open_:
            break
        fits = (_pick(room, F.col("_s")) >= F.col("_n")).cast("int")
        # a shard with room first, then most documents, then a hash of group and shard
        rank = F.struct(fits.alias("o"), "_m", F.xxhash64("_g", "_s").alias("h"))
        best = cells.join(pending, "_g").groupBy("_g", "_n").agg(F.max_by("_s", rank).alias("_to"), F.max(fits).alias("_o"))
        # none of its shards has room: any open one, the same share of groups for the same room
        ends = [sum(room[t] for t in open_[:k + 1]) for k in range(len(open_))]
        draw = F.pmod(F.xxhash64("_g", F.lit(len(out))), F.lit(ends[-1]))
        other = _pick(open_, F.size(F.filter(F.array(*[F.lit(e).cast("bigint") for e in ends]), lambda e: e <= draw)))
        asked = best.select("_g", "_n", F.when(F.col("_o") == 1, F.col("_to")).otherwise(other).alias("_to"))
        ordered = _before(durable(asked, "asked"), "_to", "_k")
        granted = F.col("_k") + F.col("_n") <= _pick(room, F.col("_to"))
        decided = durable(ordered.select("_g", "_n", F.when(granted, F.col("_to")).alias("_now")), "decided")
        got = {r["_now"]: (r["n"], r["k"]) for r in decided.groupBy("_now").agg(F.sum("_n").alias("n"), F.count("*").alias("k")).collect()}
        refused = got.pop(None, (0, 0))[1]
        for s, (n, _) in got.items():
            room[s] -= n
        out.append(decided.filter("_now IS NOT NULL"))
        pending = decided.filter("_now IS NULL").select("_g", "_n")
        if not refused or not got:
            break
    left = pending.withColumn("_now", F.lit(None).cast("int"))
    for part in out:
        left = left.unionByName(part)
    return left


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS, rounds: int = ROUNDS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row: id, ``size`` (UTF-8 bytes of the text, null as none, plus 16), ``text_crc32``, ``law`` ('rows'), ``shard``, ``slot``
    (gapless from 0 in its shard), ``grown_shard`` (null under this law) and ``group_size`` (rows with the same text).

    Null texts count as empty and share a group with empty ones; null ids are numbered first; equal rows are told apart only by their slots.
    Only the two named columns are read, once.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    rows = docs.select(
        F.col(id_column).alias("_id"), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(text.cast("binary"))).alias("_g"))
    rows = rows.withColumn("_h", F.xxhash64("_id", "_g")).withColumn("_s", F.pmod("_h", F.lit(n_shards)).cast("int"))
    rows = durable(rows, "rows")
    sizes = rows.groupBy("_g").agg(F.count("*").alias("group_size")).filter("group_size > 1")
    sizes = durable(sizes, "groups")
    total = rows.count()
    low, extra = divmod(total, n_shards)
    quota = [low + (1 if s < extra else 0) for s in range(n_shards)]

    room = list(quota)
    bar = max(1, total // (LARGE * n_shards))
    # the large groups: few, and the only ones that may be hot
    cells = rows.join(F.broadcast(sizes.filter(F.col("group_size") > bar)), "_g").groupBy("_g", "_s").agg(F.count("*").alias("_m"))
    held: dict[bytes, dict[int, int]] = {}
    for r in cells.collect():
        held.setdefault(bytes(r["_g"]), {})[r["_s"]] = r["_m"]
    pieces = [(bytearray(g), a, b, s, sum(held[g].values())) for g, a, b, s in _place_large(held, room)]
    pieces = docs.sparkSession.createDataFrame(pieces, "_g binary, _from bigint, _end bigint, _now int, group_size bigint")
    large = F.broadcast(pieces.select("_g").distinct())
    numbered = _ranked(rows.join(large, "_g"), ["_g"], "_k")
    inside = (F.col("_k") >= F.col("_from")) & (F.col("_k") < F.col("_end"))
    numbered = numbered.join(F.broadcast(pieces.withColumnRenamed("_g", "_p")), (F.col("_g") == F.col("_p")) & inside)
    columns = ["_id", "size", "text_crc32", "_g", "_h", "group_size"]
    stay = durable(numbered.select(*columns, "_now"), "large")

    rest = rows.join(large, "_g", "left_anti")
    small = durable(sizes.filter(F.col("group_size") <= bar).select("_g", F.col("group_size").alias("_n")), "small")
    cells = durable(rest.join(small, "_g", "left_semi").groupBy("_g", "_s").agg(F.count("*").alias("_m")), "cells")
    groups = durable(_place_small(small, cells, room, rounds), "groups")
    placed = durable(rest.join(groups, "_g", "left").withColumn("group_size", F.coalesce("_n", F.lit(1))), "placed")
    stay = stay.unionByName(placed.filter("_now IS NOT NULL").select(*columns, "_now"))
    # what is left lies in one line over the open places: refused groups one by one, then unlinked documents
    ends, end = [], 0
    for s in range(n_shards):
        end += room[s]
        ends.append(end)
    offsets = _before(groups.filter("_now IS NULL").select("_g", "_n", F.lit(0).alias("_all")), "_all", "_at").select("_g", "_at")
    offsets = durable(offsets, "line")
    refused = placed.filter("_now IS NULL AND _n IS NOT NULL").join(offsets, "_g")
    own = Window.partitionBy("_g").orderBy("_id", "_h", "size")
    refused = refused.withColumn("_k", F.col("_at") + F.row_number().over(own) - 1).select(*columns, "_k")
    before = groups.filter("_now IS NULL").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n")).first()["n"]
    alone = _ranked(placed.filter("_n IS NULL").select(*columns).withColumn("_all", F.lit(0)), ["_all"], "_k")
    filled = refused.unionByName(alone.select(*columns, (F.col("_k") + before).alias("_k")))
    bounds = F.array(*[F.lit(e).cast("bigint") for e in ends])
    filled = filled.withColumn("_now", F.size(F.filter(bounds, lambda e: e <= F.col("_k"))).cast("int")).drop("_k")
    settled = durable(stay.unionByName(filled), "settled")
    slotted = _ranked(settled.withColumnRenamed("_now", "shard"), ["shard"], "slot")
    return slotted.select(
        F.col("_id").alias(id_column), "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "group_size")
