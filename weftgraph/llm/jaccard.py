"""Exact n-gram Jaccard join as a blocked sparse product of the document by n-gram incidence.

1. Each text becomes its set of hashed word n-grams; equal sets form one class, which is all the join sees.
2. N-grams are put in one global order: by hash, with those of many classes last. Two sets of Jaccard similarity t or more have, in that
   order, at least SHARED n-grams in common among the first ``n - ceil(t * n) + SHARED`` of each. Only this part of the
   incidence matrix is multiplied: rows are shuffled and sorted by n-gram, so each n-gram's column is one block of the product.
3. Products are added up per pair. Pairs whose sizes, whose places in the order, or whose signatures bound the overlap below what t
   needs are discarded, as are pairs with fewer than SHARED products; what is left is compared with whole sets. A signature holds the
   parities of the set's n-grams in 512 buckets: two sets differ in at least as many n-grams as their signatures in bits. Where sets are
   small enough for that to decide (``SIGNED`` n-grams), a pair is not taken again in a column whose predecessor both sets share.
4. First each column is multiplied with its smallest set alone, then every set with the one nearest to it by signature. What that links is one
   component, so that afterwards only products between different components are needed: a group of copies costs its length, not its
   square, and no link that joins two components is lost.

Only a bounded table reaches the driver: the n-grams of many classes, ``MAX_HEAVY`` at most (the bar is raised until they fit). It decides the
order and so the cost, never the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.components import components
from weftgraph.llm.words import NONSPACE, Words, grams, mix, scan, slices
from weftgraph.plans.scale import durable

SHARED = 3
#: Buckets of a signature, and the largest set for which it tells most pairs apart.
BITS = 512
SIGNED = 1500
#: An n-gram of this many classes goes to the end of the order.
HEAVY_FROM = 4
MAX_HEAVY = 1 << 20
#: Rows of ids that may be broadcast (some 60 MB as a hash table); larger sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Class digests that a task remembers so as not to send copies twice (a saving only).
SEEN = 200_000


def needed(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Smallest overlap of a set of n with any partner."""
    return -(-percent * n // 100)


def can_link(n: int, percent: int) -> bool:
    """Whether a set of n can be similar enough to a set that is not equal to it."""
    return 100 * n >= percent * (n + 1)


def shared(percent: int) -> int:
    """Products that any linked pair of unequal sets has inside both prefixes."""
    n = next(n for n in range(1, 101) if can_link(n, percent))
    return min(SHARED, needed(n, percent))


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - needed(n, percent) + shared(percent)) if can_link(n, percent) else 0


def shingle_sets(words: Words, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct n-gram hashes of each text; a text of fewer words gives one n-gram, without words none."""
    every = grams(words.hash, k)
    first = words.first.tolist()
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= k:
            yield np.unique(every[a:b - k + 1])
        elif b > a:
            yield mix(grams(words.hash[a:b], b - a) + np.uint64(b - a))
        else:
            yield every[:0]


def class_of(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def signature(shingles: np.ndarray) -> bytes:
    """Parities of the n-grams per bucket."""
    odd = np.bincount((shingles >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _members(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(_id, n, cls, pre, sig): pre holds the first n-grams by hash, sig the signature; both once per class and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for rows, data, offsets in slices(batches):
            sizes, classes, pre, signatures = [], [], [], []
            for shingles in shingle_sets(scan(data, offsets, NONSPACE), k):
                cls = class_of(shingles)
                sizes.append(len(shingles))
                classes.append(cls)
                fresh = cls is not None and cls not in seen and can_link(len(shingles), percent)
                if fresh and len(seen) < SEEN:
                    seen.add(cls)
                pre.append(shingles[:prefix_length(len(shingles), percent)].view(np.int64) if fresh else None)
                signatures.append(signature(shingles) if fresh else None)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(pre, pa.list_(pa.int64())),
                 pa.array(signatures, pa.binary())],
                names=["_id", "n", "cls", "pre", "sig"])

    return docs.mapInArrow(run, f"_id {docs.schema['_id'].dataType.simpleString()}, n bigint, cls binary, pre array<bigint>, sig binary")


def _heavy(members: DataFrame, heavy_from: int, max_heavy: int) -> np.ndarray:
    """Sorted n-grams of at least ``heavy_from`` classes; the bar doubles until no more than ``max_heavy`` are over it."""
    counts = members.filter("pre IS NOT NULL").select(F.explode("pre").alias("g")).groupBy("g").count().filter(F.col("count") >= heavy_from)
    counts = durable(counts, "heavy")
    steps = {r["b"]: r["n"] for r in counts.groupBy(F.floor(F.log2(F.col("count") / heavy_from)).cast("int").alias("b")).agg(F.count("*").alias("n")).collect()}
    bar = 0
    while sum(n for b, n in steps.items() if b >= bar) > max_heavy:
        bar += 1
    chosen = counts.filter(F.col("count") >= heavy_from * 2 ** bar).select("g").toArrow()
    return np.sort(chosen.column("g").to_numpy().astype(np.int64).view(np.uint64))


def _postings(docs: DataFrame, k: int, percent: int, heavy) -> DataFrame:
    """(g, cls, n, pos) for the first n-grams of every class in the global order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = heavy.value, set()
        for _, data, offsets in slices(batches):
            parts, sizes, classes = [], [], []
            for shingles in shingle_sets(scan(data, offsets, NONSPACE), k):
                cls = class_of(shingles)
                if not can_link(len(shingles), percent) or cls in seen:
                    continue
                if len(seen) < SEEN:
                    seen.add(cls)
                length = prefix_length(len(shingles), percent)
                if len(common):
                    at = np.minimum(np.searchsorted(common, shingles), len(common) - 1)
                    late = common[at] == shingles
                    shingles_ = np.concatenate([shingles[~late], shingles[late]])
                else:
                    shingles_ = shingles
                parts.append(shingles_[:length])
                sizes.append(len(shingles))
                classes.append(cls)
            lengths = [len(p) for p in parts]
            which = np.repeat(np.arange(len(parts)), lengths)
            total = int(sum(lengths))
            starts = np.repeat(np.cumsum([0, *lengths[:-1]]), lengths) if parts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(parts).view(np.int64) if parts else [], pa.int64()),
                 pa.array(classes, pa.binary()).take(pa.array(which, pa.int64())), pa.array(np.array(sizes, np.int32)[which], pa.int32()),
                 pa.array((np.arange(total) - starts).astype(np.int32), pa.int32())],
                names=["g", "cls", "n", "pos"])

    return docs.mapInArrow(run, "g bigint, cls binary, n int, pos int")


def _halves(column: pa.Array, width: int = 2) -> np.ndarray:
    """Digests or signatures as rows of ``width`` 8-byte numbers."""
    raw = np.frombuffer(column.buffers()[2], np.uint8) if len(column) else np.zeros(0, np.uint8)
    size = 8 * width
    return raw[size * column.offset:size * (column.offset + len(column))].view(np.uint64).reshape(-1, width)


def _digests(halves: np.ndarray) -> pa.Array:
    n = len(halves)
    offsets = pa.py_buffer((16 * np.arange(n + 1)).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(halves))])


_ROW = np.dtype([("g", np.int64), ("cls", np.uint64, 2), ("n", np.int32), ("pos", np.int32)])


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    out = np.empty(batch.num_rows, _ROW)
    out["g"], out["cls"], out["n"], out["pos"] = batch.column(0).to_numpy(), _halves(batch.column(1)), batch.column(2).to_numpy(), batch.column(3).to_numpy()
    return out


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns of two or more classes, each row with the column's smallest set. Input is sorted by (g, n, cls); one row is held back."""
    lead = None  # first row of the open column
    shown = False
    held = np.empty(0, _ROW)
    for batch in batches:
        rows = np.concatenate([held, _rows(batch)])
        if len(rows) == 0:
            continue
        again = np.zeros(len(rows), bool)
        again[1:] = (rows["g"][1:] == rows["g"][:-1]) & (rows["cls"][1:] == rows["cls"][:-1]).all(1)
        if lead is not None and shown:
            again[0] = rows["g"][0] == lead["g"] and (rows["cls"][0] == last).all()
        last = rows["cls"][-1].copy()
        rows = rows[~again]
        if len(rows) == 0:
            held = np.empty(0, _ROW)
            continue
        opens = np.ones(len(rows), bool)
        opens[1:] = rows["g"][1:] != rows["g"][:-1]
        goes_on = lead is not None and shown and rows["g"][0] == lead["g"]
        first = np.maximum.accumulate(np.where(opens, np.arange(len(rows)), 0))
        leads = rows[first]
        size = np.diff(np.append(np.flatnonzero(opens), len(rows)))[np.cumsum(opens) - 1]
        show = size > 1
        if goes_on:
            mine = first == 0
            leads[mine] = lead
            show[mine] = True
        lead, shown = leads[-1].copy(), bool(show[-1])
        held = np.empty(0, _ROW) if shown else rows[-1:].copy()
        if show.any():
            r, top = rows[show], leads[show]
            yield pa.RecordBatch.from_arrays(
                [pa.array(r["g"]), _digests(r["cls"]), pa.array(r["n"]), pa.array(r["pos"]), _digests(top["cls"]), pa.array(top["n"])],
                names=["g", "cls", "n", "pos", "lead", "lead_n"])


def _may_link(n, cap, pos, other_n, other_cap, other_pos, percent: int):
    """Whether sizes, and the places of one shared n-gram among those that any other class has, still allow the overlap that is needed.

    ``cap`` is a set's size without the prefix n-grams that no other class has in its own prefix. A partner whose prefix ends earlier may hold
    such an n-gram after it, but what the two share after the earlier end is no more than the rest of the set whose prefix ends there. So
    either set's count holds with the longer of both rests.
    """
    least, most = np.minimum(n, other_n), np.maximum(n, other_n)
    rest = needed(most, percent)
    live = np.minimum(cap - needed(n, percent) - pos, other_cap - needed(other_n, percent) - other_pos)
    overlap = np.minimum(pos, other_pos) + np.minimum(live + rest, np.minimum(n - pos, other_n - other_pos))
    return (100 * least >= percent * most) & (overlap * (100 + percent) >= percent * (n + other_n))


_PLACED = np.dtype(_ROW.descr + [("cap", np.int32), ("prev", np.int64), ("comp", np.uint64, 2), ("sig", np.uint64, BITS // 64)])


def _placed(batch: pa.RecordBatch) -> np.ndarray:
    out, plain = np.empty(batch.num_rows, _PLACED), _rows(batch)
    for name in _ROW.names:
        out[name] = plain[name]
    out["cap"], out["prev"] = batch.column(4).to_numpy(), batch.column(5).to_numpy()
    out["comp"], out["sig"] = _halves(batch.column(6)), _halves(batch.column(7), BITS // 64)
    return out


#: Rows of a column up to which all columns of a batch are multiplied at once, place by place.
SMALL = 256
#: Cells of one step in a larger column.
CELLS = 1 << 18


def _between(percent: int, nearest: bool):
    """Products between different components of a column as (a, b, w); input is sorted by (g, comp).

    Pairs of signed sets weigh as many products as are asked for, and come once for each run of n-grams that are neighbours in both sets'
    orders: were the predecessor shared too, the pair would be in its column. Other pairs come once per product. With ``nearest`` every signed set
    offers only its nearest one by signature, so that a column gives no more pairs than it has rows.
    """
    enough = shared(percent)

    class Product:
        def __init__(self, rows: np.ndarray) -> None:
            self.rows, self.comp = rows, rows["comp"]
            self.n, self.pos, self.cap = (rows[c].astype(np.int64) for c in ("n", "pos", "cap"))
            self.prev, self.first, self.signed = rows["prev"], rows["pos"] == 0, rows["n"] <= SIGNED
            self.sig = np.ascontiguousarray(rows["sig"])
            self.best, self.partner = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), -1)

        def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The pairs that may link, and the bits in which their signatures differ."""
            n, pos, cap = self.n, self.pos, self.cap
            short = self.signed[i] & self.signed[j]
            keep = (self.comp[i] != self.comp[j]).any(1) & ~(short & (self.prev[i] == self.prev[j]) & ~self.first[i] & ~self.first[j])
            if nearest:
                keep &= short
            i, j = i[keep], j[keep]
            keep = _may_link(n[i], cap[i], pos[i], n[j], cap[j], pos[j], percent)
            i, j = i[keep], j[keep]
            apart = np.bitwise_count(self.sig[i] ^ self.sig[j]).sum(1, dtype=np.int64)
            keep = (100 + percent) * (n[i] + n[j] - apart) >= 2 * percent * (n[i] + n[j])
            return i[keep], j[keep], apart[keep]

        def offer(self, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> None:
            order = np.argsort(apart, kind="stable")
            for mine, theirs in ((i, j), (j, i)):
                row, at = np.unique(mine[order], return_index=True)
                better = apart[order][at] < self.best[row]
                row, at = row[better], order[at[better]]
                self.best[row], self.partner[row] = apart[at], theirs[at]

        def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            edges = np.flatnonzero(np.append(True, self.rows["g"][1:] != self.rows["g"][:-1]))
            sizes = np.diff(np.append(edges, len(self.rows)))
            after = np.repeat(edges + sizes, sizes) - np.arange(len(self.rows)) - 1  # rows of the column that follow
            after[np.repeat(sizes > SMALL, sizes)] = 0
            left, step = np.flatnonzero(after > 0), 1
            while len(left):
                for at in range(0, len(left), CELLS):
                    yield left[at:at + CELLS], left[at:at + CELLS] + step
                step += 1
                left = left[after[left] >= step]
            for start, size in zip(edges[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
                stop, block = start + size, max(1, CELLS // size)
                for at in range(start, stop, block):
                    i, j = np.meshgrid(np.arange(at, min(stop, at + block)), np.arange(at + 1, stop), indexing="ij")
                    later = i < j
                    yield i[later], j[later]

        def emit(self) -> Iterator[pa.RecordBatch]:
            for i, j in self.pairs():
                i, j, apart = self.near(i, j)
                if nearest:
                    self.offer(i, j, apart)
                elif len(i):
                    yield self.pack(i, j)
            if nearest:
                i = np.flatnonzero(self.partner >= 0)
                if len(i):
                    yield self.pack(i, self.partner[i])

        def pack(self, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
            a, b = self.rows["cls"][i], self.rows["cls"][j]
            x, y = a.byteswap(), b.byteswap()  # compared as bytes, as Spark does
            swap = (x[:, 0] > y[:, 0]) | ((x[:, 0] == y[:, 0]) & (x[:, 1] > y[:, 1]))
            a[swap], b[swap] = b[swap], a[swap].copy()
            weight = np.where(self.signed[i] & self.signed[j], enough, 1)
            return pa.RecordBatch.from_arrays([_digests(a), _digests(b), pa.array(weight, pa.int64())], names=["a", "b", "w"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty(0, _PLACED)
        for batch in batches:
            rows = np.concatenate([held, _placed(batch)])
            if len(rows) == 0:
                continue
            whole = len(rows) - int(np.argmax((rows["g"] != rows["g"][-1])[::-1])) if rows["g"][0] != rows["g"][-1] else 0
            if whole:
                yield from Product(rows[:whole]).emit()
            held = rows[whole:].copy()
        if len(held):
            yield from Product(held).emit()

    return run


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cls, grams) of the wanted (cls, rep); texts move only when too many are wanted for a broadcast."""
    n = wanted.count()
    reps = wanted.select(F.col("rep").alias("_rep"))
    side = F.broadcast(reps) if n <= BROADCAST_ROWS else reps
    chosen = docs.join(side, F.col("_id").eqNullSafe(F.col("_rep")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, offsets in slices(batches):
            sets = [s for s in shingle_sets(scan(data, offsets, NONSPACE), k) if len(s)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([class_of(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["cls", "grams"])

    sets = chosen.mapInArrow(run, "cls binary, grams array<bigint>")
    # a repeated id may bring other texts along
    return durable(sets.join(F.broadcast(wanted.select("cls")) if n <= BROADCAST_ROWS else wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"]), "sets")


def _links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    ids = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    wanted = durable(ids.join(classes, "cls").select("cls", "rep"), "wanted")
    sets = _sets(docs, wanted, k)
    left = sets.select(F.col("cls").alias("a"), F.col("grams").alias("_x"))
    right = sets.select(F.col("cls").alias("b"), F.col("grams").alias("_y"))
    both = pairs.join(right, "b").join(left, "a")
    overlap = both.select("a", "b", F.size("_x").alias("_m"), F.size("_y").alias("_n"), F.size(F.array_intersect("_x", "_y")).alias("_o"))
    return durable(overlap.filter(100 * F.col("_o") >= percent * (F.col("_m") + F.col("_n") - F.col("_o"))).select("a", "b"), "links")


def _products(ranked: DataFrame, roots: DataFrame, classes: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """(a, b) of different components with enough products; only columns of several components are multiplied."""
    named = roots.withColumnRenamed("node", "cls")
    named = F.broadcast(named) if named.count() <= BROADCAST_ROWS else named
    signed = classes.filter("sig IS NOT NULL").select("cls", "sig")
    placed = ranked.join(named, "cls", "left").join(signed, "cls").select("g", "cls", "n", "pos", "cap", "prev", F.coalesce("root", "cls").alias("comp"), "sig")
    column = Window.partitionBy("g")  # one shuffle serves the filter and the product
    mixed = placed.withColumns({"_a": F.min("comp").over(column), "_b": F.max("comp").over(column)}).filter("_a <> _b")
    rest = mixed.select("g", "cls", "n", "pos", "cap", "prev", "comp", "sig").sortWithinPartitions("g", "comp", "n", "cls")
    pairs = rest.mapInArrow(_between(percent, nearest), "a binary, b binary, w bigint").groupBy("a", "b").agg(F.sum("w").alias("w"))
    return pairs.filter(F.col("w") >= shared(percent)).select("a", "b")


def similar_documents(
    docs: DataFrame, k: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text",
    heavy_from: int = HEAVY_FROM, max_heavy: int = MAX_HEAVY,
) -> DataFrame:
    """(id, ``n_shingles``, ``component_id``): documents link at a Jaccard similarity of ``percent`` or more over ``k``-word n-grams.

    ``component_id`` is the smallest id reachable by links. Texts without words, null ones too, link with nothing and are their own
    component. A text of fewer than ``k`` words is one n-gram. Repeated rows and ids give a row each; null ids take part but are never the
    smallest. Other columns are not read. Ties need no rule: the smallest id is unique. Very long texts are read whole.
    """
    members, classes, roots = _joined(docs, k, percent, id_column, text_column, heavy_from, max_heavy)
    of_root = roots.withColumnRenamed("node", "cls").join(classes, "cls")
    of_root = of_root.join(of_root.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("cls", "component_id")
    placed = durable(
        classes.join(of_root, "cls", "left").select("cls", F.coalesce("component_id", "rep").alias("component_id")), "placed")
    out = members.select("_id", "n", "cls").join(placed, "cls", "left")
    return out.select(F.col("_id").alias(id_column), F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("_id")).otherwise(F.col("component_id")).alias("component_id"))


def similar_classes(docs: DataFrame, k: int, percent: int, id_column: str, text_column: str) -> DataFrame:
    """(_id, ``n_shingles``, ``component``) per row: a component is named by one of its classes of equal n-gram sets, null without words."""
    members, _, roots = _joined(docs, k, percent, id_column, text_column, HEAVY_FROM, MAX_HEAVY)
    out = members.select("_id", F.col("n").alias("n_shingles"), "cls").join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left")
    return out.select("_id", "n_shingles", F.coalesce("root", "cls").alias("component"))


def _joined(docs: DataFrame, k: int, percent: int, id_column: str, text_column: str, heavy_from: int, max_heavy: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their class (_id, n, cls), classes with their smallest id (cls, rep), and the component (node, root) of every class that links."""
    rows = docs.select(F.col(id_column).alias("_id"), F.col(text_column).alias("_text"))
    members = durable(_members(rows, k, percent), "members")
    classes = durable(members.filter("cls IS NOT NULL").groupBy("cls").agg(F.min("_id").alias("rep"), F.max("sig").alias("sig")), "classes")
    heavy = docs.sparkSession.sparkContext.broadcast(_heavy(members, heavy_from, max_heavy))
    sorted_ = _postings(rows, k, percent, heavy).repartition("g").sortWithinPartitions("g", "n", "cls")
    schema = "g bigint, cls binary, n int, pos int, lead binary, lead_n int"
    columns = durable(sorted_.mapInArrow(_columns, schema), "columns")

    # a class's places are renumbered among the n-grams that others have too; a class with fewer than SHARED of them has no partner
    own = Window.partitionBy("cls")
    order = own.orderBy("pos", "g")
    ranked = columns.select(
        "g", "cls", "n", "lead", "lead_n", (F.row_number().over(order) - 1).alias("pos"), F.lag("g", 1, 0).over(order).alias("prev"),
        F.count("*").over(own).alias("_live"))
    cap = F.expr(f"({percent} * n + 99) div 100") - shared(percent) + F.col("_live")
    ranked = durable(ranked.filter(F.col("_live") >= shared(percent)).withColumn("cap", cap.cast("int")).drop("_live"), "ranked")
    fits = (100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n")) & (
        F.col("cap") * (100 + percent) >= percent * (F.col("n") + F.col("lead_n")))
    stars = ranked.filter((F.col("cls") != F.col("lead")) & fits).groupBy("lead", "cls").count().filter(F.col("count") >= shared(percent))
    stars = durable(stars.select(F.least("lead", "cls").alias("a"), F.greatest("lead", "cls").alias("b")).distinct(), "stars")
    links = _links(stars, rows, classes, k, percent)
    roots = durable(components(links), "roots")
    tried = stars
    for nearest in (True, False):  # first each set's nearest ones, then all that are left between what these have joined
        pairs = _products(ranked, roots, classes, percent, nearest)
        pairs = durable(pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        links = durable(links.unionByName(_links(pairs, rows, classes, k, percent)), "links")
        tried = durable(tried.unionByName(pairs), "tried") if nearest else tried
        roots = durable(components(links), "roots")

    return members, classes, roots


def without_copies(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with its own columns: the smallest id's.

    Decided by rows, not by ids: rows of one id whose texts do not link stay apart. Rows without words are kept, but for repeated ones of equal id and text.
    A component whose ids are all null keeps one row. Of several rows with the smallest id the first by digest stays. Texts do not move: only digests of
    rows are shuffled, and the rows that are there more than once. Empty tables stay empty; other columns may be null and have any name.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    key, text = f"c{names.index('doc_id')}", f"c{names.index('text')}"
    marked = plain.withColumn("_row", _row_digest(plain))
    found = similar_classes(marked, k, percent, "_row", text).select(F.col("_id").alias("_row"), "component")
    brief = durable(marked.groupBy("_row").agg(F.first(key).alias(key), F.first(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("_text"), F.count("*").alias("_n")), "rows")
    joined = brief.join(found.distinct(), "_row")
    alone = F.concat_ws(":", F.lit("empty"), F.coalesce(F.col(key).cast("string"), F.lit("null")), "_text")
    group = F.coalesce(F.hex("component"), alone)
    first = F.struct(F.col(key).isNull(), key, "_row")
    best = durable(joined.groupBy(group.alias("_group")).agg(F.min_by(F.struct("_row", "_n"), first).alias("_best")).select("_best.*"), "best")
    side = lambda rows: F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows
    equal = best.filter("_n > 1").select("_row")
    out = durable(brief.select("_row").join(best.select("_row"), "_row", "left_anti").unionByName(equal), "out")
    left = marked.join(side(out), "_row", "left_anti")
    if not equal.isEmpty():  # only rows that are there more than once are dealt out to be told apart
        left = left.unionByName(marked.join(side(equal), "_row", "left_semi").dropDuplicates(["_row"]))
    return left.select(*plain.columns).toDF(*names)


def _row_digest(rows: DataFrame) -> Column:
    """128 bits of all columns; where nulls are counts too."""
    columns = [F.to_json(c) if rows.schema[c].dataType.typeName() in ("map", "struct", "array", "variant") else F.col(c) for c in rows.columns]
    nulls = F.concat(*[F.col(c).isNull().cast("int").cast("string") for c in rows.columns])
    return F.concat_ws("-", F.hex(F.xxhash64(nulls, *columns)), F.hex(F.xxhash64(F.lit(1), nulls, *columns)))
