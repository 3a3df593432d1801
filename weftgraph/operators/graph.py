"""Property-graph queries as bounded joins over ``nodes`` and ``edges`` tables.

Requests come as DataFrames (or short Python lists for substring tests); one plan answers all of them.
Results are rows, one per related node, so a hub never becomes one huge array.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.plans.scale import durable, top_rows


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame  # node_id, node_type, name, repo, file_path, start_line, end_line, signature, exported, annotations, props
    edges: DataFrame  # src, rel_type, dst, props


def both_ways(edges: DataFrame) -> DataFrame:
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel_type")
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel_type")
    return out.unionAll(back)


def named(graph: Graph, requests: DataFrame) -> DataFrame:
    """Nodes asked for by name; a request may carry a repo. Adds ``seed``."""
    ids = graph.nodes.select(F.col("node_id").alias("seed"), "name", "repo")
    if "repo" not in requests.columns:
        return ids.join(requests.distinct(), "name")
    wanted = requests.distinct()
    anywhere = ids.join(wanted.filter("repo is null").select("name"), "name")
    inside = ids.join(wanted.filter("repo is not null"), ["name", "repo"]).select("seed", "name", "repo")
    return anywhere.select("seed", "name", "repo").unionAll(inside).distinct()


def walk(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Breadth-first levels from (seed, node) over (a, b) edges -> (seed, node, hop), hop 1..depth, nearest hop.

    The frontier holds only nodes not seen before; beyond one hop each level is written once and reused.
    """
    frontier, seen = start.select("seed", "node"), None
    for hop in range(1, depth + 1):
        step = (
            frontier.join(edges, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node")).distinct()
            .withColumn("hop", F.lit(hop))
        )
        if seen is not None:
            step = step.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        if depth > 1:
            step = durable(step, "hop")
        seen = step if seen is None else seen.unionByName(step)
        frontier = step.select("seed", "node")
    return seen


def _short_lists(edges: DataFrame, around: DataFrame, length: int) -> DataFrame:
    """First ``length`` distinct neighbours by id of the nodes in ``around(a)``, with type and direction (a, b, …).

    Only edges at those nodes are kept before anything is ranked; few nodes mean no shuffle of the edge table.
    """
    sides = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel_type", F.lit("outgoing").alias("direction")).unionAll(
        edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel_type", F.lit("incoming").alias("direction")))
    w = Window.partitionBy("a").orderBy("b")
    sides = sides.join(around.distinct(), "a", "left_semi")
    return sides.withColumn("_r", F.dense_rank().over(w)).filter(F.col("_r") <= length).drop("_r")


def neighbors(graph: Graph, requests: DataFrame, depth: int = 1, limit: int = 50) -> DataFrame:
    """Nearest nodes around each named node (by hop, then id), with type and direction of direct edges.

    Hubs stay cheap: a seed stops once it has ``limit`` nodes, so an open seed has seen fewer than that, and the first
    2 * limit + 2 neighbours of any node then hold every node that can still be among its nearest. Lists are cut to
    that length before they are joined.
    """
    depth = min(max(depth, 1), 3)
    seeds = named(graph, requests).select("seed").distinct()
    seeds = durable(seeds, "seeds")
    width = 2 * limit + 2
    lists = _short_lists(graph.edges, seeds.select(F.col("seed").alias("a")), width)
    by_id = Window.partitionBy("seed").orderBy("node")
    near = (
        seeds.join(lists, F.col("seed") == F.col("a")).filter("b <> seed")
        .select("seed", F.col("b").alias("node"), "rel_type", "direction", F.lit(1).alias("hop"))
        .withColumn("_r", F.dense_rank().over(by_id)).filter(F.col("_r") <= limit).drop("_r")
    )
    if depth > 1:
        near = durable(near, "hop")
    found, step, seen = near, near.select("seed", "node").distinct(), near.select("seed", "node").distinct()
    for hop in range(2, depth + 1):
        room = seen.groupBy("seed").agg((F.lit(limit) - F.count("*")).alias("room")).filter("room > 0")
        live = durable(step.join(room, "seed"), "live")
        lists = _short_lists(graph.edges, live.select(F.col("node").alias("a")), width).select("a", "b").distinct()
        ahead = live.join(lists, F.col("node") == F.col("a")).filter("b <> seed")
        fresh = ahead.select("seed", F.col("b").alias("node"), "room").distinct().join(seen, ["seed", "node"], "left_anti")
        kept = top_rows(fresh, ["seed"], [F.col("node")], limit, "_r").filter("_r <= room").select("seed", "node")
        step = durable(kept, "hop") if hop < depth else kept
        seen = seen.unionByName(step)
        null = F.lit(None).cast("string")
        found = found.unionByName(step.select("seed", "node", null.alias("rel_type"), null.alias("direction"), F.lit(hop).alias("hop")))
    info = graph.nodes.select(F.col("node_id").alias("node"), "name", "node_type", "repo", "file_path")
    return found.join(info, "node").select("seed", "node", "name", "node_type", "repo", "file_path", "hop", "rel_type", "direction")


def graph_view(graph: Graph, requests: DataFrame, depth: int = 1, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """Drawable (nodes, oriented edges) around each named node; labels cut at 20 characters."""
    found = neighbors(graph, requests, depth, limit)
    around = found.select("seed", F.col("node").alias("id"), F.substring("name", 1, 20).alias("label"), "node_type").distinct()
    centre = named(graph, requests).select("seed", F.col("seed").alias("id"), F.col("name").alias("label"),
                                           F.lit("center").alias("node_type"))
    out = F.coalesce(F.col("direction") == "outgoing", F.lit(False))
    arrows = found.select(
        "seed", F.when(out, F.col("seed")).otherwise(F.col("node")).alias("source"),
        F.when(out, F.col("node")).otherwise(F.col("seed")).alias("target"),
        F.coalesce("rel_type", F.lit("RELATED")).alias("label"))
    return centre.unionByName(around), arrows


def find_callers(graph: Graph, requests: DataFrame, limit: int = 50) -> DataFrame:
    """Callers of each named function; a request with a repo also restricts the caller's repo."""
    cols = [F.col("node_id"), F.col("name"), F.col("repo"), F.col("file_path")]
    callee = named(Graph(graph.nodes.filter("node_type = 'Function'"), graph.edges), requests)
    calls = graph.edges.filter("rel_type = 'CALLS'").select(F.col("src").alias("caller"), F.col("dst").alias("seed")).distinct()
    hits = callee.select("seed", F.col("name").alias("callee_name"), F.col("repo").alias("callee_repo")).join(calls, "seed")
    info = graph.nodes.select(*[c.alias(f"caller_{n}") for c, n in zip(cols, ("id", "name", "repo", "file"))])
    if "repo" in requests.columns:
        asked = requests.select(F.col("name").alias("callee_name"), F.col("repo").alias("asked")).distinct()
        joined = hits.join(asked, "callee_name").join(info, F.col("caller") == F.col("caller_id"))
        joined = joined.filter("asked is null or (asked = callee_repo and asked = caller_repo)")
        return top_rows(joined, ["callee_name", "asked"], [F.col("caller_id"), F.col("seed")], limit).select(
            "callee_name", F.col("seed").alias("callee_id"), "caller_id", "caller_name", "caller_repo", "caller_file")
    kept = top_rows(hits, ["callee_name"], [F.col("caller"), F.col("seed")], limit)
    return kept.join(info, F.col("caller") == F.col("caller_id")).select(
        "callee_name", F.col("seed").alias("callee_id"), "caller_id", "caller_name", "caller_repo", "caller_file")


def _endpoints(graph: Graph, repo: str | None = None) -> DataFrame:
    found = graph.nodes.filter("node_type = 'APIEndpoint'")
    if repo is not None:
        found = found.filter(F.col("repo") == repo)
    return found.select(F.col("node_id").alias("endpoint_id"), F.col("props")["http_method"].alias("http_method"),
                        F.col("props")["path"].alias("path"), F.col("name").alias("endpoint_name"), "repo")


def _handlers(graph: Graph, functions_only: bool) -> DataFrame:
    handler = graph.nodes.filter("node_type = 'Function'") if functions_only else graph.nodes
    exposed = graph.edges.filter("rel_type = 'EXPOSED_BY'").select(F.col("src").alias("endpoint_id"), F.col("dst").alias("handler_id"))
    return exposed.join(handler.select(F.col("node_id").alias("handler_id"), F.col("name").alias("handler")), "handler_id")


def _consumers(graph: Graph, ends: DataFrame | None = None) -> DataFrame:
    """Consumers of all endpoints, or of ``ends(endpoint_id, ...)`` only: then just their edges meet the nodes."""
    used = graph.edges.filter("rel_type = 'CONSUMES'").select(F.col("dst").alias("endpoint_id"), F.col("src").alias("consumer_id"))
    if ends is not None:
        # written, so that Spark knows how few they are and need not move the edges
        used = used.join(durable(ends, "ends"), "endpoint_id")
    return used.join(graph.nodes.select(F.col("node_id").alias("consumer_id"), F.col("name").alias("consumer"),
                                        F.col("repo").alias("consumer_repo")), "consumer_id")


def api_contracts(graph: Graph, repo: str | None = None) -> DataFrame:
    """Endpoint, handler and distinct consumer, one row per consumer (NULL where there is none)."""
    base = _endpoints(graph, repo).join(_handlers(graph, True), "endpoint_id", "left")
    return base.join(_consumers(graph).distinct(), "endpoint_id", "left").select(
        "endpoint_id", "http_method", "path", "repo", "handler_id", "handler", "consumer_id", "consumer")


def api_map(graph: Graph, path_contains: str | None = None, unmatched_only: bool = False) -> DataFrame:
    """Endpoint and handler with the number of consumer links (a multiset count) and ``has_consumers``."""
    base = _endpoints(graph).join(_handlers(graph, False), "endpoint_id", "left")
    if path_contains:
        base = base.filter(F.lower("path").contains(path_contains.lower()))
    used = graph.edges.filter("rel_type = 'CONSUMES'").groupBy(F.col("dst").alias("endpoint_id")).agg(F.count("*").alias("c"))
    counted = base.join(used, "endpoint_id", "left").select(
        "endpoint_id", "http_method", "path", "handler", F.coalesce("c", F.lit(0)).alias("consumers"),
        (F.coalesce("c", F.lit(0)) > 0).alias("has_consumers"))
    return counted.filter(~F.col("has_consumers")) if unmatched_only else counted


def api_map_totals(mapping: DataFrame) -> DataFrame:
    return mapping.agg(F.count("*").alias("total"), F.count_if(F.col("has_consumers")).alias("matched"),
                       F.count_if(~F.col("has_consumers")).alias("unmatched"))


def unmatched_endpoints(graph: Graph, limit: int = 20) -> DataFrame:
    used = graph.edges.filter("rel_type = 'CONSUMES'").select(F.col("dst").alias("endpoint_id"))
    return _endpoints(graph).join(used, "endpoint_id", "left_anti").orderBy("path", "endpoint_id").limit(limit)


def cross_repo_impact(graph: Graph, paths: list[str], depth: int = 2) -> DataFrame:
    """Everything touched by endpoints whose path contains one of ``paths``: rows (request, endpoint, role, node, hop)."""
    wanted = F.array(*[F.lit(p) for p in paths])
    found = _endpoints(graph).select(
        F.explode(F.filter(wanted, lambda p: F.col("path").contains(p))).alias("request"), "endpoint_id")
    ends = found.select("endpoint_id").distinct()
    handlers = ends.join(_handlers(graph, True), "endpoint_id").select("endpoint_id", F.col("handler_id").alias("node"))
    consumers = _consumers(graph, ends).select("endpoint_id", F.col("consumer_id").alias("node")).distinct()
    callers = graph.edges.filter("rel_type = 'CALLS'").select(F.col("dst").alias("a"), F.col("src").alias("b"))

    def upstream(start: DataFrame, role: str) -> DataFrame:
        # callers do not depend on the endpoint: walk once per start node, not once per endpoint
        reached = walk(callers, start.select(F.col("node").alias("seed"), "node").distinct(), depth)
        return start.withColumnRenamed("node", "seed").join(reached, "seed").groupBy("endpoint_id", "node").agg(
            F.min("hop").alias("hop")).withColumn("role", F.lit(role))

    rows = (
        handlers.select("endpoint_id", "node", F.lit(0).alias("hop"), F.lit("handler").alias("role"))
        .unionByName(upstream(handlers, "backend_impact"))
        .unionByName(consumers.select("endpoint_id", "node", F.lit(0).alias("hop"), F.lit("frontend_consumer").alias("role")))
        .unionByName(upstream(consumers, "frontend_impact"))
    )
    return found.join(rows, "endpoint_id").select("request", "endpoint_id", "role", "node", "hop")


def module_graph(graph: Graph, modules: DataFrame) -> DataFrame:
    """Files, imported files and contained entities of each (repo, path) module: rows (module_id, kind, node)."""
    mods = graph.nodes.filter("node_type = 'Module'").select(
        F.col("node_id").alias("module_id"), "repo", F.col("name").alias("path")).join(modules.distinct(), ["repo", "path"]).select("module_id")
    contains = graph.edges.filter("rel_type = 'CONTAINS'").select("src", "dst")
    imports = graph.edges.filter("rel_type = 'IMPORTS'").select("src", "dst")
    file_ids = graph.nodes.filter("node_type = 'File'").select(F.col("node_id").alias("file_id"))
    files = mods.join(contains, F.col("module_id") == F.col("src")).select("module_id", F.col("dst").alias("file_id")).join(file_ids, "file_id", "left_semi")

    def part(edges: DataFrame, kind: str) -> DataFrame:
        return files.join(edges, F.col("file_id") == F.col("src")).select("module_id", F.lit(kind).alias("kind"), F.col("dst").alias("node")).distinct()

    imported = part(imports, "import").join(file_ids.withColumnRenamed("file_id", "node"), "node", "left_semi")
    return (
        files.select("module_id", F.lit("file").alias("kind"), F.col("file_id").alias("node")).distinct()
        .unionByName(imported).unionByName(part(contains, "node"))
    )


def shortest_path(graph: Graph, requests: DataFrame, max_depth: int = 5) -> DataFrame:
    """Shortest undirected path per (start, end) name pair, smallest node sequence on ties.

    Both ends expand in turn and meet in the middle, so a level never exceeds half the depth; each level keeps one
    best path per node, and answered requests leave the frontiers before a level is written.
    """
    ids = graph.nodes.select(F.col("node_id").alias("id"), F.col("name").alias("nm"))
    asked = requests.select("start", "end").distinct()
    # every node of the start name begins one side, every node of the end name the other: no pairs are formed
    starts = durable(asked.join(ids.select(F.col("id").alias("node"), F.col("nm").alias("start")), "start").select("start", "end", "node"), "starts")
    ends = durable(asked.join(ids.select(F.col("id").alias("node"), F.col("nm").alias("end")), "end").select("start", "end", "node"), "ends")
    links = both_ways(graph.edges).filter("a <> b")
    none = F.array().cast("array<string>")
    key = ["start", "end"]

    def begin(side: DataFrame) -> DataFrame:
        return side.select(*key, "node", F.struct(F.array("node").alias("ids"), none.alias("rels")).alias("way")).distinct()

    def step(level: DataFrame, forward: bool, open_requests: DataFrame) -> DataFrame:
        """Ways one edge longer. Parallel edges stay; ``odd`` ranks an untyped one behind the typed ones where the smallest way is taken."""
        live = level.join(open_requests, key, "left_semi")
        return live.join(links, F.col("node") == F.col("a")).select(
            *key, F.col("b").alias("node"),
            F.struct(
                (F.concat("way.ids", F.array("b")) if forward else F.concat(F.array("b"), "way.ids")).alias("ids"),
                F.col("rel_type").isNull().alias("odd"),
                (F.concat("way.rels", F.array("rel_type")) if forward else F.concat(F.array("rel_type"), "way.rels")).alias("rels"),
            ).alias("way"))

    def joined(stepped: DataFrame, other: DataFrame, before: DataFrame, forward: bool) -> DataFrame:
        """Whole ways of each request where the step reaches the other side's level at a node new to its own side."""
        meet = stepped.withColumnRenamed("way", "s").join(other.select(*key, "node", F.col("way").alias("o")), [*key, "node"])
        meet = meet.join(before, [*key, "node"], "left_anti")
        f, g = ("s", "o") if forward else ("o", "s")
        return meet.select(*key, F.struct(
            F.concat(f"{f}.ids", F.slice(f"{g}.ids", F.lit(2), F.size(f"{g}.ids"))).alias("ids"), F.col("s.odd").alias("odd"),
            F.concat(f"{f}.rels", f"{g}.rels").alias("rels")).alias("way"))

    def plain(way: str) -> Column:
        return F.struct(F.col(f"{way}.ids").alias("ids"), F.col(f"{way}.rels").alias("rels")).alias("way")

    # durable levels: small ones are sent to the edges, which then need not move
    levels = {True: durable(begin(starts), "front"), False: durable(begin(ends), "front")}
    seen = {side: level.select(*key, "node") for side, level in levels.items()}
    open_requests, found = starts.select(*key).distinct().join(ends.select(*key).distinct(), key, "left_semi"), None
    open_requests = durable(open_requests, "open")
    for length in range(1, max_depth + 1):
        forward = length % 2 == 1
        # first only the ways that meet: a level is written for the requests that these do not answer
        whole = joined(step(levels[forward], forward, open_requests), levels[not forward], seen[forward], forward)
        hit = durable(whole.groupBy(*key).agg(F.min("way").alias("way")).select(*key, plain("way"), F.lit(length).alias("length")), "met")
        found = hit if found is None else found.unionByName(hit)
        if length < max_depth:
            open_requests = durable(open_requests.join(hit.select(*key), key, "left_anti"), "open")
            if open_requests.isEmpty():
                break
            best = step(levels[forward], forward, open_requests).groupBy(*key, "node").agg(F.min("way").alias("way"))
            levels[forward] = durable(best.join(seen[forward], [*key, "node"], "left_anti").select(*key, "node", plain("way")), "front")
            seen[forward] = seen[forward].unionByName(levels[forward].select(*key, "node"))
    return found.select(*key, "length", F.col("way.ids").alias("nodes"), F.col("way.rels").alias("rels"))


def path_rows(paths: DataFrame) -> DataFrame:
    """Alternating node / relationship rows of each path."""
    steps = F.flatten(F.transform("nodes", lambda n, i: F.array(
        F.struct(F.lit("node").alias("kind"), n.alias("value")),
        F.struct(F.lit("relationship").alias("kind"), F.get("rels", i).alias("value")))))
    rows = paths.select("start", "end", F.posexplode(steps).alias("step", "x"))
    return rows.select("start", "end", "step", F.col("x.kind").alias("kind"), F.col("x.value").alias("value")).filter("value is not null")


def impact(graph: Graph, requests: DataFrame, depth: int = 1) -> DataFrame:
    """Dependents, dependencies and, for endpoints, consumers of each named node: (name, role, node, rel_type, node_type, hop)."""
    # written, so that Spark knows how few they are; an endpoint is told by its id
    ends = graph.nodes.filter("node_type = 'APIEndpoint'").select(F.col("node_id").alias("seed"), F.lit(True).alias("endpoint")).distinct()
    seeds = durable(named(graph, requests).select("seed", "name").join(ends, "seed", "left"), "seeds")
    fwd = graph.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), "rel_type")
    rev = graph.edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), "rel_type")
    info = graph.nodes.select(F.col("node_id").alias("node"), "node_type")

    def direct(edges: DataFrame) -> DataFrame:
        # dealt out by node, which both the grouping and the look-up of its type can use as it is: the rows move once
        hits = seeds.join(edges, F.col("seed") == F.col("a")).select("name", F.col("b").alias("node"), "rel_type", "endpoint").repartition("node")
        return hits.groupBy("name", "node", "rel_type").agg(F.max("endpoint").alias("endpoint")).join(info, "node")

    def far(edges: DataFrame, role: str) -> DataFrame:
        start = seeds.select("seed", F.col("seed").alias("node"))
        reached = walk(edges.select("a", "b"), start, depth).filter("hop > 1 and node <> seed").join(seeds, "seed")
        return reached.join(info, "node").select("name", F.lit(role).alias("role"), "node", F.lit(None).cast("string").alias("rel_type"), "node_type", "hop")

    consumes = F.coalesce(F.col("endpoint") & (F.col("rel_type") == "CONSUMES"), F.lit(False))
    dependent = F.array(F.lit("dependent"))
    roles = F.when(consumes, F.concat(dependent, F.array(F.lit("cross_repo")))).otherwise(dependent)
    parts = [direct(rev).withColumn("role", F.explode(roles)), direct(fwd).withColumn("role", F.lit("dependency"))]
    rows = [df.select("name", "role", "node", "rel_type", "node_type", F.lit(1).alias("hop")) for df in parts]
    if depth > 1:
        rows += [far(rev, "dependent"), far(fwd, "dependency")]
    return reduce(DataFrame.unionByName, rows)


def consumers_by_path(graph: Graph, texts: list[str]) -> DataFrame:
    """Consumers of endpoints named so or whose path contains the text (the page's cross-repo list)."""
    wanted = F.array(*[F.lit(t) for t in texts])
    hit = _endpoints(graph).select("endpoint_id", F.explode(F.filter(
        wanted, lambda t: (F.col("endpoint_name") == t) | F.col("path").contains(t))).alias("request"))
    return _consumers(graph, hit).select("request", "consumer_id", "consumer", "consumer_repo").distinct()


def impact_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(*[
        F.count_if(F.col("role") == role).alias(alias)
        for role, alias in (("dependent", "callers"), ("dependency", "dependencies"), ("cross_repo", "cross_repo"))])


def section_report(rows: DataFrame, keys: list[str], section: str, label: str, limit: int) -> DataFrame:
    """First ``limit`` labels per section as one short list, with the full count. The list is cut before it is built."""
    total = rows.groupBy(*keys, section).agg(F.count("*").alias("total"))
    head = top_rows(rows, [*keys, section], [F.col(label)], limit)
    lists = head.groupBy(*keys, section).agg(F.array_join(F.array_sort(F.collect_list(label)), ", ").alias("items"))
    return total.join(lists, [*keys, section])


def label_counts(graph: Graph) -> DataFrame:
    return graph.nodes.groupBy("node_type").agg(F.count("*").alias("n"))


def graph_totals(graph: Graph) -> DataFrame:
    """Node total, relationship total and repo count in one row."""
    parts = (
        graph.nodes.groupBy("repo").agg(F.count("*").alias("nodes")).select("nodes", F.lit(0).alias("rels"), F.lit(1).alias("repos"))
        .unionByName(graph.edges.agg(F.count("*").alias("rels")).select(F.lit(0).alias("nodes"), "rels", F.lit(0).alias("repos")))
    )
    return parts.agg(F.sum("nodes").alias("total_nodes"), F.sum("rels").alias("relationships"), F.sum("repos").alias("repos"))


def rel_type_counts(graph: Graph) -> DataFrame:
    return graph.edges.groupBy("rel_type").agg(F.count("*").alias("n"))


def top_called(graph: Graph, limit: int = 5) -> DataFrame:
    """Functions by caller count; the edges are counted per node before names are looked up."""
    per_node = graph.edges.filter("rel_type = 'CALLS'").groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("c"))
    functions = graph.nodes.filter("node_type = 'Function'").select("node_id", "name")
    return per_node.join(functions, "node_id").groupBy("name").agg(F.sum("c").alias("callers")).orderBy(F.desc("callers"), "name").limit(limit)


def contains_text(graph: Graph, text: str, repo: str | None = None, limit: int = 20) -> DataFrame:
    """Substring fallback over name and signature, score 1."""
    hit = graph.nodes.filter(F.col("name").contains(text) | F.col("signature").contains(text))
    if repo is not None:
        hit = hit.filter(F.col("repo") == repo)
    return hit.select("node_id", "name", "node_type", "repo", F.lit(1.0).alias("score")).orderBy("node_id").limit(limit)


def sample_nodes(graph: Graph, node_type: str, exported: bool | None = None, annotation: str | None = None, limit: int = 10) -> DataFrame:
    hit = graph.nodes.filter(F.col("node_type") == node_type)
    if exported is not None:
        hit = hit.filter(F.col("exported") == exported)
    if annotation is not None:
        hit = hit.filter(F.array_contains("annotations", annotation))
    return hit.select("node_id", "name", "repo", "file_path").orderBy("name", "node_id").limit(limit)
