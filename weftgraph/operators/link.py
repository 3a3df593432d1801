"""Matching calls to endpoint templates, wildcard edge resolution and line-range lookups.

Every join is an equi join. Call paths walk a trie of the endpoint templates, so a hot (method, segment count) group never meets itself
pairwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.scalar import normalize_path, normalize_url, path_confidence, segments
from weftgraph.plans.scale import durable

MATCH_COLUMNS = [
    "fe_file", "fe_line", "fe_method", "fe_url", "be_file", "be_method", "be_path", "be_controller", "be_handler",
    "confidence",
]


def _endpoint_templates(endpoints: DataFrame) -> DataFrame:
    """One row per (method, normalised path): the first endpoint by ordinal."""
    keyed = endpoints.select(
        F.coalesce("http_method", F.lit("GET")).alias("m"),
        normalize_path(F.coalesce("path", F.lit(""))).alias("p"),
        "ordinal", "file_path", "http_method", "path", "controller", "handler_method",
    )
    first = F.min_by(F.struct("file_path", "http_method", "path", "controller", "handler_method"), "ordinal")
    return keyed.groupBy("m", "p").agg(F.min("ordinal").alias("ordinal"), first.alias("be"))


#: Copies of each trie edge, so that the calls below a common prefix or a catch-all meet it in so many tasks.
SALTS = 8
#: Levels walked before the open paths are written out.
LEVELS = 4


def _is_param(segment: Column) -> Column:
    return segment.startswith(":")


def _trie(templates: DataFrame, shapes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, leaves) of the template trie, once for every shape of calls (which of their segments are parameters) of the same method and length.

    Where a call has a segment, a template's parameter is the label ``:``, whatever its name; where a call has a parameter, a template's segment is
    ``*``, and only a parameter keeps its name. So a node has two edges that fit a segment at most, and few that fit a parameter.
    """
    open_ = F.col("open")
    label = F.transform("segs", lambda s, i: F.when(F.get(open_, i), F.when(_is_param(s), s).otherwise("*")).otherwise(F.when(_is_param(s), ":").otherwise(s)))
    leaves = templates.join(shapes, ["m", "n"]).groupBy("m", "n", "open", label.alias("labels")).agg(F.min("ordinal").alias("ordinal"))
    leaves = durable(leaves.withColumn("node", F.array_join("labels", "/")), "leaves")

    def edge(x: Column, i: Column) -> Column:
        parent = F.array_join(F.slice("labels", F.lit(1), i), "/")
        return F.struct(i.alias("level"), parent.alias("parent"), F.when(F.get(open_, i), "").otherwise(x).alias("key"), x.alias("label"),
                        F.array_join(F.slice("labels", F.lit(1), i + 1), "/").alias("child"))

    edges = leaves.select("m", "n", "open", F.explode(F.transform("labels", edge)).alias("e")).select("m", "n", "open", "e.*").distinct()
    return durable(edges.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "trie"), leaves


def _pattern_matches(calls: DataFrame, templates: DataFrame, pick: str) -> DataFrame:
    """(m, p, ordinal) of the best template of each call path: all paths walk the trie together, one join per level."""
    def shaped(df: DataFrame) -> DataFrame:
        return df.withColumn("segs", segments(F.col("p"))).withColumn("n", F.size("segs"))

    left = durable(shaped(calls).withColumn("open", F.transform("segs", _is_param)), "paths")
    edges, leaves = _trie(shaped(templates.select("m", "p", "ordinal")), left.select("m", "n", "open").distinct())
    salt = F.pmod(F.xxhash64("p"), F.lit(SALTS)).cast("int")
    front = left.select("m", "n", "open", "p", "segs", salt.alias("salt"), F.lit("").alias("parent"), F.lit(0).alias("points"))
    depth = left.agg(F.max("n")).first()[0] or 0
    ends = []
    for level in range(depth):
        segment = F.get("segs", F.lit(level))
        keys = F.when(F.get("open", F.lit(level)), F.array(F.lit(""))).otherwise(F.array(segment, F.lit(":")))
        found = front.withColumn("key", F.explode(keys)).join(edges.filter(F.col("level") == level).drop("level"), ["m", "n", "open", "parent", "key", "salt"])
        points = F.col("points") + F.when(F.col("label") == segment, 10).otherwise(8)
        front = found.select("m", "n", "open", "p", "segs", "salt", F.col("child").alias("parent"), points.alias("points"))
        if level % LEVELS == LEVELS - 1:
            front = durable(front, "front")
        ends.append(front.filter(F.col("n") == level + 1).select("m", "n", "open", "p", F.col("parent").alias("node"), "points"))
        front = front.filter(F.col("n") > level + 1)
    if not ends:
        return left.select("m", "p", F.lit(None).cast(templates.schema["ordinal"].dataType).alias("ordinal")).limit(0)
    hits = reduce(DataFrame.unionByName, ends).join(leaves.select("m", "n", "open", "node", "ordinal"), ["m", "n", "open", "node"])
    order = (-F.col("points"), F.col("ordinal")) if pick == "best" else (F.col("ordinal"),)
    return hits.groupBy("m", "p").agg(F.min_by("ordinal", F.struct(*order)).alias("ordinal"))


def _call_key() -> list[Column]:
    """Join key of a call. Never NULL, so the planner adds no second evaluation as a null filter below the join."""
    return [F.coalesce(F.upper("method"), F.lit("")).alias("m"), F.coalesce(normalize_url(F.col("url_pattern")), F.lit("")).alias("p")]


def link(calls: DataFrame, endpoints: DataFrame, pick: str = "best") -> DataFrame:
    """Match rows; exact first, then templates. ``pick='first'`` takes the earliest template that matches at all."""
    # both key tables feed several joins: normalise and deduplicate once
    templates = durable(_endpoint_templates(endpoints), "templates")
    wanted = durable(
        calls.select(*_call_key()).distinct(), "calls")
    exact = wanted.join(templates.select("m", "p", "ordinal"), ["m", "p"]).select("m", "p", "ordinal")
    rest = wanted.join(templates.select("m", "p"), ["m", "p"], "left_anti")
    chosen = exact.unionByName(_pattern_matches(rest, templates, pick))
    confidence = F.when(F.col("p") == F.col("be_p"), F.lit(1.0)).otherwise(path_confidence(F.col("p"), F.col("be_p")))
    # written out, its size is known: Spark broadcasts it when small, so the calls themselves need no shuffle
    matched = durable(
        chosen.join(templates.select("ordinal", F.col("p").alias("be_p"), "be"), "ordinal")
        .select("m", "p", "be", confidence.alias("confidence")), "matched")
    keyed = calls.select("*", *_call_key())
    return keyed.join(matched, ["m", "p"]).select(
        F.col("file_path").alias("fe_file"), F.col("line_number").alias("fe_line"), F.col("method").alias("fe_method"),
        F.col("url_pattern").alias("fe_url"), F.col("be.file_path").alias("be_file"),
        F.coalesce("be.http_method", F.lit("GET")).alias("be_method"), F.coalesce("be.path", F.lit("")).alias("be_path"),
        F.coalesce("be.controller", F.lit("")).alias("be_controller"),
        F.coalesce("be.handler_method", F.lit("")).alias("be_handler"), "confidence",
    )


def unmatched_calls(calls: DataFrame, links: DataFrame) -> DataFrame:
    keys = links.select(F.upper("fe_method").alias("m"), F.col("fe_url").alias("u")).distinct()
    return calls.join(keys, (F.upper(calls.method) == keys.m) & (calls.url_pattern == keys.u), "left_anti")


def unmatched_endpoints(endpoints: DataFrame, links: DataFrame) -> DataFrame:
    """Endpoints whose raw METHOD:path was never matched."""
    keys = links.select(F.col("be_method").alias("m"), F.col("be_path").alias("u")).distinct()
    method, path = F.coalesce(endpoints.http_method, F.lit("GET")), F.coalesce(endpoints.path, F.lit(""))
    return endpoints.join(keys, (method == keys.m) & (path == keys.u), "left_anti")


def consumes_specs(links: DataFrame) -> DataFrame:
    """CONSUMES edge specs from calls to endpoints, wildcard line on the endpoint side."""
    def side(path: Column, kind: str, name: Column, line: Column) -> Column:
        return F.struct(path.alias("file_path"), F.lit(kind).alias("node_type"), name.alias("name"), line.alias("line"))

    return links.select(
        side(F.col("fe_file"), "APICall", F.col("fe_url"), F.col("fe_line").cast("int")).alias("src"),
        F.lit("CONSUMES").alias("rel_type"),
        side(F.col("be_file"), "APIEndpoint", F.concat_ws(" ", "be_method", "be_path"), F.lit(None).cast("int")).alias("dst"),
        F.create_map(F.lit("fe_method"), F.col("fe_method"), F.lit("fe_url"), F.col("fe_url"),
                     F.lit("confidence"), F.col("confidence").cast("string")).alias("props"),
    )


LINES_PER_BUCKET = 200


def enclosing_entity(points: DataFrame, entities: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Narrowest entity of the same file whose span holds the line.

    Spans and lines meet in buckets of a few hundred lines, so a huge file does not pair all of both sides.
    ``points`` keeps its columns; ``entity_id`` is added. Points outside every entity are dropped.
    """
    first, last = (F.floor(F.col(c) / LINES_PER_BUCKET) for c in ("start_line", "end_line"))
    spans = entities.filter("end_line >= start_line").select(
        *keys, "node_id", "start_line", "end_line", F.explode(F.sequence(first, last)).alias("_b"))
    wanted = points.select(*keys, line).distinct().withColumn("_b", F.floor(F.col(line) / LINES_PER_BUCKET))
    hits = wanted.join(spans, [*keys, "_b"]).filter(F.col(line).between(F.col("start_line"), F.col("end_line")))
    span = F.struct(F.col("end_line") - F.col("start_line"), F.col("node_id"))
    narrowest = hits.groupBy(*keys, line).agg(F.min_by("node_id", span).alias("entity_id"))
    # the looked-up rows are hashed, a row per line at most: the points are moved but not sorted
    return points.join(narrowest.hint("shuffle_hash"), [*keys, line])


def load_links(links: DataFrame, nodes: DataFrame, node_types: tuple[str, ...] = ("Function", "Component", "Hook")) -> DataFrame:
    """CONSUMES edges from the entity around each call to every endpoint node with that path and method."""
    entities = nodes.filter(F.col("node_type").isin(*node_types)).withColumn("fe_file", F.col("file_path"))
    placed = enclosing_entity(links, entities, ["fe_file"], "fe_line")
    endpoints = nodes.filter("node_type = 'APIEndpoint'").select(
        F.col("node_id").alias("dst"), F.col("props")["path"].alias("be_path"), F.col("props")["http_method"].alias("be_method"))
    joined = placed.join(endpoints.hint("shuffle_hash"), ["be_path", "be_method"])
    pairs = joined.select(F.col("entity_id").alias("src"), "dst", "fe_line", "fe_url", "confidence")
    # few links share both ends: rows are dealt out as they are and sorted once, not in the tasks that send them as well
    tasks = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last = pairs.repartition(tasks, "src", "dst").groupBy("src", "dst").agg(F.max(F.struct("fe_line", "fe_url", "confidence")).alias("x"))
    props = F.create_map(F.lit("confidence"), F.col("x.confidence").cast("string"), F.lit("fe_url"), F.col("x.fe_url"))
    return last.select("src", F.lit("CONSUMES").alias("rel_type"), "dst", props.alias("props"))


def load_counts(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """(loaded, total): how many links found both ends."""
    entities = nodes.filter(F.col("node_type").isin("Function", "Component", "Hook")).withColumn("fe_file", F.col("file_path"))
    known = nodes.filter("node_type = 'APIEndpoint'").select(
        F.col("props")["path"].alias("be_path"), F.col("props")["http_method"].alias("be_method")).distinct()
    loaded = enclosing_entity(links, entities, ["fe_file"], "fe_line").join(known.hint("shuffle_hash"), ["be_path", "be_method"], "left_semi")
    return loaded.select(F.lit(1).alias("l"), F.lit(0).alias("t")).unionAll(
        links.select(F.lit(0).alias("l"), F.lit(1).alias("t"))).agg(F.sum("l").alias("loaded"), F.sum("t").alias("total"))


_FIELDS = ("node_type", "file_path", "name", "line")


def _mask_of(field: Column) -> Column:
    known = [F.when(field[f].isNotNull(), F.lit(1 << i)).otherwise(0) for i, f in enumerate(_FIELDS)]
    return known[0] + known[1] + known[2] + known[3]


#: Tasks that share the specs of one pattern; a node goes to those that hold specs for it.
SHARES = 16
#: The hash comes first: rows are sorted by it, and few of them need their texts compared. More bits would only be moved.
_PATTERN = ["_hash", "_mask", "_k0", "_k1", "_k2", "_k3"]


def _pattern(mask: Column, get: Callable[[str], Column]) -> list[Column]:
    """The known fields as text, the others empty, and 16 bits of a hash of them."""
    known = [F.when(mask.bitwiseAND(F.lit(1 << i)) > 0, get(f).cast("string")).otherwise(F.lit("")) for i, f in enumerate(_FIELDS)]
    return [F.xxhash64(mask, *known).bitwiseAND(F.lit(0xFFFF)).alias("_hash"), *[k.alias(f"_k{i}") for i, k in enumerate(known)]]


def _asked(specs: DataFrame, side: str) -> DataFrame:
    """Specs with the pattern of a side; without those that know nothing but a type."""
    marked = specs.withColumn("_mask", _mask_of(F.col(side))).filter(F.col("_mask") > 1)
    return marked.select("*", *_pattern(F.col("_mask"), lambda f: F.col(side)[f]))


def _offered(nodes: DataFrame, asked: DataFrame, id_name: str) -> DataFrame:
    """Each node keyed once per mask in use (at most 14)."""
    masks = [r["_mask"] for r in asked.select("_mask").distinct().collect()]  # at most 14 values
    typed = nodes.select("node_id", "node_type", "file_path", "name", F.col("start_line").alias("line"))
    spread = typed.select("*", F.explode(F.array(*[F.lit(m) for m in masks or [0]])).alias("_mask"))
    return spread.select(F.col("node_id").alias(id_name), "_mask", *_pattern(F.col("_mask"), F.col))


def _same(a: DataFrame, b: DataFrame, columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in columns])


def resolve_wildcards(specs: DataFrame, nodes: DataFrame, take: dict[str, Column] | None = None) -> DataFrame:
    """Edges for specs whose ends may leave out fields; an end with neither file, name nor line is dropped.

    ``take`` names columns to return in place of ``props``, computed of it once a pattern and not once an edge.

    A node has one pattern per mask, so a source's patterns of one mask never meet in a node: equal edges are sought before the last ends are looked
    up, and the edges themselves, of which a broad pattern makes as many as specs times nodes, are neither moved nor grouped. Only sources with
    several masks and ids that come with several patterns are grouped as edges.
    """
    begun = _asked(specs if "seq" in specs.columns else specs.withColumn("seq", F.lit(0)), "src")
    placed = _asked(begun.join(_offered(nodes, begun, "src_id"), _PATTERN).drop(*_PATTERN), "dst")
    source = ["src_id", "rel_type"]
    share = F.pmod(F.xxhash64(*source), F.lit(SHARES)).alias("_share")
    last = placed.groupBy(*source, *_PATTERN).agg(F.max_by(F.struct("props"), "seq").alias("x"), F.max("seq").alias("seq")).withColumn("props", F.col("x.props"))
    kept = F.when(F.col("x").isNotNull(), F.struct(*[c.alias(name) for name, c in (take or {"props": F.col("props")}).items()]))
    best = durable(last.withColumn("x", kept).drop("props").select("*", share), "patterns")
    ends = durable(_offered(nodes, best, "dst_id").join(best.select(*_PATTERN).distinct(), _PATTERN).distinct(), "ends")
    several = best.groupBy(*source).agg((F.min("_mask") < F.max("_mask")).alias("_several")).filter("_several")
    again = ends.groupBy("dst_id", "_mask").agg(F.count("*").alias("_n")).filter("_n > 1")
    mixed, repeated = _same(best, several, source), _same(ends, again, ["dst_id", "_mask"])
    shares = best.select(*_PATTERN, "_share").distinct()

    def met(left: DataFrame, right: DataFrame, tasks: int | None = None) -> DataFrame:
        ends_of = right.join(shares, _PATTERN)
        if tasks:  # a number, or Spark would make few tasks of few rows however many edges they make
            left, ends_of = (df.repartition(tasks, *_PATTERN, "_share") for df in (left, ends_of))
        return left.join(ends_of, [*_PATTERN, "_share"]).select(F.col("src_id").alias("src"), "rel_type", F.col("dst_id").alias("dst"), "x", "seq")

    plain, known = best.join(several, mixed, "left_anti"), ends.join(again, repeated, "left_anti")
    twice = met(best.join(several, mixed, "left_semi"), ends).unionByName(met(plain, ends.join(again, repeated, "left_semi")))
    merged = twice.groupBy("src", "rel_type", "dst").agg(F.max_by("x", "seq").alias("x"))
    columns = ["src", "rel_type", "dst", *[F.col(f"x.{name}") for name in (take or ["props"])]]
    tasks = int(specs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return met(plain, known, tasks).select(*columns).unionByName(merged.select(*columns))


def parse_node_id(c: Column) -> Column:
    """file:type:name:line with ``*`` as wildcard; fewer than three parts gives NULL."""
    parts = F.split(c, ":")

    def part(i: int) -> Column:
        return F.nullif(F.get(parts, F.lit(i)), F.lit("*"))

    return F.when(F.size(parts) >= 3, F.struct(
        part(0).alias("file_path"), part(1).alias("node_type"), part(2).alias("name"),
        part(3).try_cast("int").alias("line")))
