"""Entities, imports, calls and relationship specs from source texts.

Everything happens inside each file's row: one scan, no shuffle, texts never move. A lexer blanks out strings and comments and gives the end
of what starts on each line (``functions/lexer.py``); declarations are found by patterns over the lines that are left, which is the known loss against a parser.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import rules as R
from weftgraph.functions.lexer import FILLER, lexed
from weftgraph.functions.scalar import dir_name

ID = r"[A-Za-z_$][A-Za-z0-9_$]*"
ANNOTATION = r"@[A-Za-z_][A-Za-z0-9_.]*(?:\s*\((?:[^()\"']++|\"[^\"]*+\"|'[^']*+'|\([^()]*+\))*+\))?"
MODIFIERS = r"(?:(?:public|protected|private|static|final|abstract|synchronized|default)\s+)*"
CALL_KEYWORDS = ["if", "for", "while", "switch", "catch", "return", "function", "typeof", "new", "super", "await", "import", "synchronized"]

# (kind, line pattern, group of the name)
TS_DECLARATIONS = [
    ("arrow", rf"^export\s+(?:const|let|var)\s+({ID})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:<[^>]*>\s*)?(?:\([^)]*\)[^=]*=>|\([^)]*$|{ID}\s*=>)", 1),
    ("function", rf"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*({ID})", 1),
    ("type", rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+({ID})\s*(?:<[^=]*>)?\s*=", 1),
    ("interface", rf"^\s*(?:export\s+)?(?:default\s+)?(?:declare\s+)?interface\s+({ID})", 1),
]
_LEAD = rf"^\s*(?:{ANNOTATION}\s+)*{MODIFIERS}"
JAVA_DECLARATIONS = [
    ("class", rf"{_LEAD}class\s+({ID})", 1),
    ("method", rf"{_LEAD}(?:<[^>]+>\s+)?(?!(?:return|new|else|throw|class|case|public|protected|private|static|final|abstract|synchronized|default)\b)[A-Za-z_][\w.<>\[\], ?]*\s+({ID})\s*\(", 1),
    ("constructor", rf"{_LEAD}([A-Z][A-Za-z0-9_$]*)\s*\(", 1),
]


def _declared(line: Column, declarations) -> Column:
    """struct(kind, name) of the first declaration pattern that matches, else NULL."""
    return F.coalesce(*[
        F.when(line.rlike(p), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(line, p, g).alias("name")))
        for kind, p, g in declarations])


def _entities(declarations, candidate: str) -> tuple[Column, Column]:
    """(labelled lines, fold to declarations). ``candidate`` is a cheap test that most lines fail."""
    def label(code: Column, i: Column) -> Column:
        line, trimmed = F.get("lines", i), F.ltrim(code)
        return F.struct(
            i.alias("i"), F.when(code.rlike(candidate), _declared(code, declarations)).alias("d"),
            (trimmed.startswith("@") & trimmed.rlike(rf"^(?:{ANNOTATION}\s*)+$")).alias("note"),
            (F.ltrim(line).startswith("/**") & ~trimmed.startswith(FILLER)).alias("doc"), F.rtrim(line).endswith("*/").alias("doc_end"))

    labelled = F.transform("code", label)
    none = F.array().cast("array<struct<kind:string,name:string,at:int,first:int,doc_from:int,doc_to:int>>")
    start = F.struct(F.lit(-1).alias("run"), F.lit(-1).alias("doc_from"), F.lit(-1).alias("doc_to"), F.lit(False).alias("open"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begins = x["doc"] & ~acc["open"]
        inside = acc["open"] | begins
        closes = inside & x["doc_end"]
        declares = x["d"].isNotNull() & ~inside
        first = F.when(acc["run"] >= 0, acc["run"]).otherwise(x["i"])
        item = F.struct(
            x["d"]["kind"].alias("kind"), x["d"]["name"].alias("name"), x["i"].alias("at"), first.alias("first"),
            acc["doc_from"].alias("doc_from"), F.when(acc["doc_to"] == first - 1, acc["doc_to"]).otherwise(F.lit(-1)).alias("doc_to"))
        return F.struct(
            F.when(x["note"] & ~inside, first).otherwise(F.lit(-1)).alias("run"),
            F.when(begins, x["i"]).otherwise(acc["doc_from"]).alias("doc_from"),
            F.when(closes, x["i"]).otherwise(acc["doc_to"]).alias("doc_to"),
            (inside & ~x["doc_end"]).alias("open"),
            F.when(declares, F.concat(acc["out"], F.array(item))).otherwise(acc["out"]).alias("out"))

    found = F.aggregate("labelled", start, step, lambda acc: acc["out"])
    return labelled, found


def staged(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns computed once per row: a generator in between keeps the optimizer from copying them into lambdas."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _spans(files: DataFrame, declarations, brace_kinds: list[str], candidate: str, language: str) -> DataFrame:
    """Files with ``lines``, ``code`` (lines without comments and strings) and ``decls``: array of declarations with their last line ``end``."""
    parsed = lexed(files.select("repo", "path", "content"), language).withColumnRenamed("code", "blanked")
    lined = staged(parsed, lines=F.split("content", "\n"), code=F.split("blanked", "\n")).drop("blanked")
    labelled, found = _entities(declarations, candidate)
    marked = staged(staged(lined, labelled=labelled), found=found)
    ended = F.transform("found", lambda d: d.withField(
        "end", F.when(d["kind"].isin(*brace_kinds), F.get("braced", d["at"])).otherwise(F.get("plain", d["at"]))))
    return staged(marked, decls=ended).drop("labelled", "found", "braced", "plain")


def _text(first: Column, last: Column) -> Column:
    return F.array_join(F.slice("lines", first + 1, last - first + 1), "\n")


def _doc(d: Column) -> Column:
    return F.when(d["doc_to"] >= 0, F.regexp_replace(_text(d["doc_from"], d["doc_to"]), r"\A\s+", "")).otherwise("")


def _node(kind: Column, name: Column, start: Column, end: Column, signature: Column, body: Column, doc: Column, exported: Column,
          annotations: Column, props: Column) -> list[Column]:
    node_id = F.concat_ws(":", "path", kind, name, start.cast("string"))
    return [node_id.alias("node_id"), kind.alias("node_type"), name.alias("name"), F.col("repo"), F.col("path").alias("file_path"),
            start.cast("int").alias("start_line"), end.cast("int").alias("end_line"), signature.alias("signature"), body.alias("body"),
            doc.alias("docstring"), exported.alias("exported"), annotations.alias("annotations"), props.alias("props")]


def classify_function(name: Column, body: Column) -> Column:
    markup = F.lower(body).contains("jsx") | body.contains("<")
    return F.when(name.rlike(r"^use\p{Lu}"), "Hook").when(name.rlike(r"^\p{Lu}") & markup, "Component").otherwise("Function")


def has_jsx(body: Column) -> Column:
    return body.rlike(r"(^|[\s(=?:&>{])<([A-Za-z][\w.]*[\s/>]|>)")


def separately_exported(content: Column) -> Column:
    """First name of each ``export { … }`` list."""
    return F.regexp_extract_all(content, F.lit(rf"export \{{ ?({ID})"), F.lit(1))


def _signature(name: Column, text: Column) -> Column:
    head = F.regexp_replace(text, rf"(?s)\A.*?(?=\(|{ID}\s*=>)", "")
    nested = r"(?s)\A(\((?:[^()]++|\([^()]*+\))*+\))\s*(:(?:[^{=]++|=(?!>)|\{[^}]*+\}(?=\s*(?:\{|=>)))*+)?"
    params, returns = F.regexp_extract(head, nested, 1), F.rtrim(F.regexp_extract(head, nested, 2))
    return F.concat(name, F.when(params == "", F.lit("()")).otherwise(params), returns)


def ts_nodes(files: DataFrame) -> DataFrame:
    """Functions, components, hooks, type aliases and interfaces of TypeScript files (repo, path, content)."""
    spans = _spans(files, TS_DECLARATIONS, ["function", "interface"], r"\b(?:export|function|type|interface)\b", "typescript")
    # one function per name and file: exported ones first, then file order
    rows = spans.withColumn("decls", F.transform("decls", lambda d: d.withField("exported", F.get("lines", d["at"]).rlike(r"^\s*export\b"))))
    rows = rows.withColumn("names", F.transform(F.filter("decls", lambda d: d["kind"].isin("arrow", "function")), lambda d: F.struct(
        d["name"].alias("name"), F.when(d["exported"], 0).otherwise(1).alias("late"), d["at"].alias("at"))))
    kept = rows.select("repo", "path", "content", "lines", "names", F.explode("decls").alias("d"))
    mine = F.filter("names", lambda x: x["name"] == F.col("d.name"))
    winner = F.array_min(F.transform(mine, lambda x: F.struct(x["late"].alias("late"), x["at"].alias("at"))))["at"]
    kept = kept.filter(~F.col("d.kind").isin("arrow", "function") | (winner == F.col("d.at")))
    name, d = F.col("d.name"), F.col("d")
    lead = rf"(?s)\A\s*(?:export\s+)?(?:default\s+)?(?:(?:const|let|var)\s+{ID}\s*(?::[^=]+)?=\s*)?"
    text = F.regexp_replace(F.regexp_replace(_text(d["at"], d["end"]), lead, ""), r"(?s);\s*\z", "")
    kept = staged(kept, text=text)
    is_function = F.col("d.kind").isin("arrow", "function")
    kind = F.when(is_function, classify_function(name, F.col("text"))).when(F.col("d.kind") == "type", "Type").otherwise("Interface")
    signature = F.when(is_function, _signature(name, F.col("text"))).otherwise(F.col("text"))
    exported = F.col("d.exported") | F.array_contains(separately_exported(F.col("content")), name)
    props = F.when(is_function, F.create_map(
        F.lit("has_jsx"), has_jsx(F.col("text")).cast("string"),
        F.lit("is_async"), F.substring("text", 1, 20).contains("async").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))
    body = F.when(is_function, F.col("text")).otherwise("")
    return kept.select(*_node(kind, name, d["at"] + 1, d["end"] + 1, signature, body, F.when(is_function, _doc(d)).otherwise(""), exported,
                              F.array().cast("array<string>"), props))


def ts_imports(files: DataFrame) -> DataFrame:
    """Default, named (with alias) and namespace imports."""
    p = rf"(?m)^\s*import\s+(?:type\s+)?([^'\";]+?)\s+from\s+['\"]([^'\"]+)['\"]"
    pairs = F.arrays_zip(F.regexp_extract_all("content", F.lit(p), F.lit(1)).alias("clause"), F.regexp_extract_all("content", F.lit(p), F.lit(2)).alias("source"))
    rows = files.select("repo", "path", F.explode(pairs).alias("i")).select("repo", "path", "i.clause", "i.source")
    default = F.regexp_extract("clause", rf"^({ID})\s*(?:,|\z)", 1)
    namespace = F.regexp_extract("clause", rf"\*\s+as\s+({ID})", 1)
    inner = F.regexp_extract("clause", r"(?s)\{(.*)\}", 1)
    specs = F.filter(F.transform(F.split(inner, ","), lambda s: F.regexp_replace(s, r"(?s)^\s*(?:type\s+)?|\s+$", "")), lambda s: s != "")

    def item(name: Column, is_default: bool, is_namespace: bool, alias: Column) -> Column:
        return F.struct(name.alias("imported_name"), F.lit(is_default).alias("is_default"), F.lit(is_namespace).alias("is_namespace"), alias.alias("alias"))

    null = F.lit(None).cast("string")
    named = F.transform(specs, lambda s: item(F.regexp_extract(s, rf"^({ID})", 1), False, False, F.nullif(F.regexp_extract(s, rf"\bas\s+({ID})", 1), F.lit(""))))
    single = F.filter(F.array(F.when(default != "", item(default, True, False, null)), F.when(namespace != "", item(namespace, False, True, null))), lambda x: x.isNotNull())
    return rows.select("repo", F.col("path").alias("source_file"), F.col("source").alias("imported_from"), F.explode(F.concat(single, named)).alias("x")).select(
        "repo", "source_file", "x.imported_name", "imported_from", "x.is_default", "x.is_namespace", "x.alias")


def java_imports(files: DataFrame) -> DataFrame:
    names = F.regexp_extract_all("content", F.lit(r"(?m)^\s*import\s+(?:static\s+)?([a-zA-Z0-9_.]+);"), F.lit(1))
    rows = files.select("repo", F.col("path").alias("source_file"), F.explode(names).alias("full"))
    null = F.lit(None).cast("string")
    return rows.select(
        "repo", "source_file", F.substring_index("full", ".", -1).alias("imported_name"),
        F.when(F.col("full").contains("."), F.regexp_replace("full", r"\.[^.]*\z", "")).otherwise("").alias("imported_from"),
        F.lit(False).alias("is_default"), F.lit(False).alias("is_namespace"), null.alias("alias"))


def api_calls(files: DataFrame) -> DataFrame:
    """Calls per line: first fetch, first client call with a verb, first authenticated fetch."""
    quote, text = "[`\"']", "([^`\"']+)"
    plain = rf"fetch\s*\(\s*{quote}{text}{quote}"
    client = r"(?i)apiClient\.(get|post|put|patch|delete)\s*[<(]\s*[`\"']?([^`\"'<>()]+)[`\"']?"
    signed = rf"authenticatedFetch\s*\(\s*{quote}{text}{quote}"
    lines = files.filter(F.col("content").rlike("(?i)fetch|apiclient")).select(
        "repo", "path", F.posexplode(F.split("content", "\n")).alias("i", "line")).filter(F.col("line").rlike("(?i)fetch|apiclient"))
    line = F.col("line")

    def call(test: str, method: Column, url: Column) -> Column:
        return F.when(line.rlike(test), F.struct(method.alias("method"), url.alias("url_pattern")))

    found = F.array_compact(F.array(
        call(plain, F.lit("GET"), F.regexp_extract(line, plain, 1)),
        call(client, F.upper(F.regexp_extract(line, client, 1)), F.trim(F.regexp_extract(line, client, 2))),
        call(signed, F.lit("GET"), F.regexp_extract(line, signed, 1))))
    return lines.select("repo", F.col("path").alias("file_path"), (F.col("i") + 1).alias("line_number"), F.explode(found).alias("c")).select(
        "repo", "file_path", "line_number", "c.method", "c.url_pattern")


ROUTE = r"/app/(.+?)/(page|route)\.(tsx?|jsx?)$"


def route_of(path: Column) -> Column:
    """Route pattern of an app-router file, NULL for other files."""
    rooted = F.concat(F.lit("/"), path)
    route = F.concat(F.lit("/"), F.regexp_extract(rooted, ROUTE, 1))
    for pattern, replacement in [(r"\[\[\.\.\.(\w+)\]\]", ":$1*"), (r"\[\.\.\.(\w+)\]", ":$1+"), (r"\[(\w+)\]", ":$1"), (r"\([^)]+\)/", "")]:
        route = F.regexp_replace(route, pattern, replacement)
    return F.when(rooted.rlike(ROUTE), route)


def route_nodes(files: DataFrame) -> DataFrame:
    rows = files.withColumn("route", route_of(F.col("path"))).filter("route is not null")
    props = F.create_map(F.lit("route_type"), F.regexp_extract(F.concat(F.lit("/"), "path"), ROUTE, 2), F.lit("framework"), F.lit("nextjs"))
    return rows.select(*_node(F.lit("Route"), F.col("route"), F.lit(1), F.lit(1), F.lit(""), F.lit(""), F.lit(""), F.lit(False),
                              F.array().cast("array<string>"), props))


def spec_side(path: Column, kind: Column, name: Column, line: Column) -> Column:
    return F.struct(kind.alias("node_type"), path.alias("file_path"), name.alias("name"), line.cast("int").alias("line"))


def hook_names(body: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(body, F.lit(r"\b(use[A-Z]\w*)\s*\("), F.lit(1)))


def uses_hook_specs(nodes: DataFrame) -> DataFrame:
    """USES_HOOK from components to hooks by name, anywhere."""
    null = F.lit(None).cast("string")
    return nodes.filter("node_type = 'Component'").select("*", F.explode(hook_names(F.col("body"))).alias("hook")).select(
        spec_side(F.col("file_path"), F.col("node_type"), F.col("name"), F.col("start_line")).alias("src"), F.lit("USES_HOOK").alias("rel_type"),
        spec_side(null, F.lit("Hook"), F.col("hook"), null).alias("dst"), F.create_map().cast("map<string,string>").alias("props"))


def parse_annotation(text: Column) -> Column:
    """struct(name, value, method): marker, single string, value= and method=, bare string, name only."""
    name = F.regexp_extract(text, r"^@(\w+)", 1)
    single = F.regexp_extract(text, r"^@\w+\s*\(\s*[\"']([^\"']+)[\"']\s*\)", 1)
    inside = F.regexp_extract(text, r"(?s)^@\w+\s*\((.+)\)", 1)
    value = F.regexp_extract(inside, r"value\s*=\s*[\"']([^\"']+)[\"']", 1)
    method = F.regexp_extract(inside, r"method\s*=\s*RequestMethod\.(\w+)", 1)
    bare = F.when((value == "") & (method == ""), F.regexp_extract(inside, r"[\"']([^\"']+)[\"']", 1)).otherwise("")
    chosen = F.coalesce(F.nullif(single, F.lit("")), F.nullif(value, F.lit("")), F.nullif(bare, F.lit("")))
    return F.when(name != "", F.struct(name.alias("name"), chosen.alias("value"), F.when(single == "", F.nullif(method, F.lit(""))).alias("method")))


def class_type(annotations: Column) -> Column:
    return reduce(
        lambda acc, row: F.when(reduce(lambda a, b: a | b, [F.array_contains(annotations, n) for n in row[0]]), row[1]).otherwise(acc),
        reversed(R.CLASS_TYPES), F.lit("class"))


def _annotations_of(d: Column) -> Column:
    """Annotations above the declaration and in front of it on its own line."""
    above = F.when(d["at"] > d["first"], _text(d["first"], d["at"] - 1)).otherwise("")
    inline = F.regexp_extract(F.get("lines", d["at"]), rf"^\s*((?:{ANNOTATION}\s+)*)", 1)
    return F.regexp_extract_all(F.concat_ws("\n", above, inline), F.lit(ANNOTATION), F.lit(0))


def _java_spans(files: DataFrame) -> DataFrame:
    spans = _spans(files, JAVA_DECLARATIONS, ["class", "constructor", "method"], r"\bclass\b|\(", "java")
    classes = F.filter("decls", lambda d: d["kind"] == "class")
    rows = spans.withColumn("classes", F.transform(classes, lambda d: d.withField("notes", F.transform(_annotations_of(d), parse_annotation))))
    return rows.select("repo", "path", "lines", "classes", F.explode("decls").alias("d"))


def _with_class(rows: DataFrame) -> DataFrame:
    around = F.filter("classes", lambda c: (c["at"] < F.col("d.at")) & (c["end"] >= F.col("d.end")))
    owner = F.get(around, F.size(around) - 1)  # declarations are in line order: the last one around is the innermost
    return rows.withColumn("owner", owner).filter("owner is not null")


def _names(notes: Column) -> Column:
    return F.transform(notes, lambda a: a["name"])


def _base_path(notes: Column) -> Column:
    mapped = F.filter(notes, lambda a: a["name"] == "RequestMapping")
    controller = F.array_contains(_names(notes), "RestController") | F.array_contains(_names(notes), "Controller")
    return F.when(controller, F.coalesce(F.get(mapped, F.lit(0))["value"], F.lit(""))).otherwise("")


def java_classes(files: DataFrame) -> DataFrame:
    rows = _java_spans(files).filter("d.kind = 'class'").withColumn("notes", F.transform(_annotations_of(F.col("d")), parse_annotation))
    d, notes = F.col("d"), F.col("notes")
    text = F.regexp_replace(_text(d["first"], d["end"]), r"\A\s+", "")
    signature = F.regexp_replace(F.regexp_extract(text, r"(?s)\A([^{]*\{[^\n]*)", 1), "\n", " ")
    props = F.create_map(F.lit("class_type"), class_type(_names(notes)), F.lit("base_path"), _base_path(notes), F.lit("annotations_detail"), F.to_json("notes"))
    return rows.select(*_node(F.lit("Class"), d["name"], d["first"] + 1, d["end"] + 1, F.rtrim(signature), F.lit(""), _doc(d), F.lit(True), _names(notes), props))


def _header(d: Column) -> Column:
    plain = F.regexp_replace(F.get("lines", d["at"]), rf"^\s*(?:{ANNOTATION}\s+)*", "")
    rest = F.when(d["end"] > d["at"], F.concat(F.lit("\n"), _text(d["at"] + 1, d["end"]))).otherwise("")
    return F.regexp_extract(F.concat(plain, rest), r"(?s)\A((?:[^{;\"]++|\"[^\"]*+\")*+)", 1)


def _parameters(header: Column) -> Column:
    inner = F.regexp_extract(header, r"(?s)\A[^(]*\((.*)\)", 1)
    parts = F.split(inner, r",(?![^<]*>)(?![^(]*\))")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"(?s)^\s+|\s+$", "")), lambda p: p != "")


def java_methods(files: DataFrame) -> DataFrame:
    """Methods with their class context; ``class_line`` and ``endpoint`` (http_method, path) come along for edges."""
    rows = _with_class(_java_spans(files).filter("d.kind = 'method'"))
    rows = rows.withColumn("notes", F.transform(_annotations_of(F.col("d")), parse_annotation)).withColumn("header", _header(F.col("d")))
    rows = rows.withColumn("params", _parameters(F.col("header"))).withColumn("base", _base_path(F.col("owner.notes")))
    d, notes = F.col("d"), F.col("notes")
    before = F.regexp_extract("header", rf"(?s)\A\s*{MODIFIERS}(?:<[^>]+>\s+)?(.*?)\s+{ID}\s*\(", 1)
    returns = F.when(before == "", F.lit("void")).otherwise(before)
    signature = F.concat(returns, F.lit(" "), d["name"], F.lit("("), F.array_join("params", ", "), F.lit(")"))
    props = F.create_map(F.lit("class_name"), F.col("owner.name"), F.lit("class_type"), class_type(_names(F.col("owner.notes"))),
                         F.lit("return_type"), returns, F.lit("parameters"), F.to_json("params"))
    body = _text(d["first"], d["end"])
    mapped = F.get(F.filter(notes, lambda a: a["name"].isin(*R.MAPPING_VERBS)), F.lit(0))
    verb = reduce(lambda acc, kv: F.when(mapped["name"] == kv[0], F.lit(kv[1])).otherwise(acc),
                  [kv for kv in R.MAPPING_VERBS.items() if kv[1]], F.coalesce(mapped["method"], F.lit("GET")))
    base = F.regexp_replace("base", "/+$", "")
    joined = F.when(F.coalesce(mapped["value"], F.lit("")) != "", F.concat(base, F.lit("/"), F.regexp_replace(mapped["value"], "^/+", ""))).otherwise(base)
    endpoint = F.when(mapped.isNotNull(), F.struct(verb.alias("http_method"), F.when(joined == "", F.lit("/")).otherwise(joined).alias("path")))
    return rows.select(*_node(F.lit("Function"), d["name"], d["first"] + 1, d["end"] + 1, signature, body, _doc(d), F.lit(False), _names(notes), props),
                       (F.col("owner.first") + 1).alias("class_line"), endpoint.alias("endpoint"))


def endpoints(methods: DataFrame) -> DataFrame:
    """APIEndpoint nodes of mapped methods."""
    e = methods.filter("endpoint is not null").withColumn("path", F.col("file_path"))
    name = F.concat_ws(" ", "endpoint.http_method", "endpoint.path")
    props = F.create_map(F.lit("http_method"), F.col("endpoint.http_method"), F.lit("path"), F.col("endpoint.path"),
                         F.lit("controller"), F.col("props")["class_name"], F.lit("handler_method"), F.col("name"))
    return e.select(*_node(F.lit("APIEndpoint"), name, F.col("start_line"), F.col("end_line"), name, F.lit(""), F.lit(""), F.lit(False),
                           F.array().cast("array<string>"), props))


def structural_edges(methods: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """HAS_METHOD from the class (by the class's own line) and EXPOSED_BY from the endpoint, as resolved edges with the ``keep`` columns of the method."""
    owner = F.concat_ws(":", "file_path", F.lit("Class"), F.col("props")["class_name"], F.col("class_line").cast("string"))
    endpoint = F.concat_ws(":", "file_path", F.lit("APIEndpoint"), F.concat_ws(" ", "endpoint.http_method", "endpoint.path"), F.col("start_line").cast("string"))
    none, kept = F.create_map().cast("map<string,string>").alias("props"), keep or []
    has = methods.select(*kept, owner.alias("src"), F.lit("HAS_METHOD").alias("rel_type"), F.col("node_id").alias("dst"), none)
    return has.unionByName(methods.filter("endpoint is not null").select(*kept, endpoint.alias("src"), F.lit("EXPOSED_BY").alias("rel_type"), F.col("node_id").alias("dst"), none))


def depends_on_specs(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """DEPENDS_ON from a class to the types of its constructor parameters, with the ``keep`` columns of the file."""
    rows = _with_class(_java_spans(files).filter("d.kind = 'constructor'")).filter("owner.name = d.name")
    params = F.explode(_parameters(_header(F.col("d")))).alias("param")
    null = F.lit(None).cast("string")
    kept = keep or []
    rows = rows.select(*kept, F.col("path").alias("_path"), F.col("owner.name").alias("class_name"), params).withColumn(
        "dep", F.regexp_extract("param", rf"(?s)^(?:{ANNOTATION}\s+|final\s+)*(.+?)\s+{ID}$", 1)).filter("dep <> ''")
    return rows.select(
        *kept, spec_side(F.col("_path"), F.lit("Class"), F.col("class_name"), null).alias("src"), F.lit("DEPENDS_ON").alias("rel_type"),
        spec_side(null, F.lit("Class"), F.col("dep"), null).alias("dst"), F.create_map(F.lit("injection_type"), F.lit("constructor")).alias("props"))


def call_names(nodes: DataFrame) -> DataFrame:
    """A row per node and name that its body calls, without keywords and the node's own name."""
    names = F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)))
    found = nodes.filter("body <> ''").select("repo", "file_path", "node_id", "name", F.explode(names).alias("callee"))
    return found.filter(~F.col("callee").isin(*CALL_KEYWORDS) & (F.col("callee") != F.col("name")))


def call_edges(nodes: DataFrame) -> DataFrame:
    """CALLS from a body to functions of that name in the same repo: the one in the same file, else the first by path and line.

    One definition per name is looked up, so a common name never multiplies its callers by its definitions.
    """
    callers = call_names(nodes).select("repo", "file_path", F.col("node_id").alias("src"), "callee")
    targets = nodes.filter(F.col("node_type").isin("Function", "Hook", "Component")).select("repo", "file_path", F.col("name").alias("callee"), "node_id", "start_line")
    here = targets.groupBy("repo", "file_path", "callee").agg(F.min_by("node_id", "start_line").alias("near"))
    anywhere = targets.groupBy("repo", "callee").agg(F.min_by("node_id", F.struct("file_path", "start_line")).alias("far"))
    found = callers.join(anywhere, ["repo", "callee"]).join(here, ["repo", "file_path", "callee"], "left")
    pairs = found.select("src", F.coalesce("near", "far").alias("dst")).distinct()
    return pairs.select("src", F.lit("CALLS").alias("rel_type"), "dst", F.create_map().cast("map<string,string>").alias("props"))


def import_edges(imports: DataFrame, files: DataFrame) -> DataFrame:
    """IMPORTS between files: relative TypeScript paths and Java package + class. Unresolved imports give no edge."""
    known = files.select("repo", F.col("path").alias("target")).withColumn("module", F.regexp_replace("target", r"(/index)?\.(tsx?|jsx?|java)$", ""))
    once = known.groupBy("repo", "module").agg(F.min("target").alias("target"))
    parts = F.split(F.concat_ws("/", dir_name(F.col("source_file")), "imported_from"), "/")
    none = F.array().cast("array<string>")
    walked = F.aggregate(parts, none, lambda acc, p: F.when((p == ".") | (p == ""), acc).when(
        p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    local = imports.filter(F.col("imported_from").startswith(".")).select(
        "repo", "source_file", F.regexp_replace(F.array_join(walked, "/"), r"\.(tsx?|jsx?)$", "").alias("module"))
    ts = local.join(once, ["repo", "module"])
    # a Java class file ends in package/Class: key files by their last package parts through the declared package folder
    java = imports.filter(F.col("source_file").endswith(".java")).select(
        "repo", "source_file", F.concat_ws("/", F.regexp_replace("imported_from", r"\.", "/"), "imported_name").alias("module"))
    roots = files.filter(F.col("path").endswith(".java")).select(
        "repo", F.col("path").alias("target"), F.regexp_replace(F.regexp_extract("content", r"(?m)^\s*package\s+([\w.]+)\s*;", 1), r"\.", "/").alias("pkg"),
        F.regexp_extract("path", r"([^/]+)\.java$", 1).alias("cls"))
    classes = roots.select("repo", F.concat_ws("/", F.nullif("pkg", F.lit("")), "cls").alias("module"), "target").groupBy("repo", "module").agg(F.min("target").alias("target"))
    both = ts.select("repo", "source_file", "target").unionByName(java.join(classes, ["repo", "module"]).select("repo", "source_file", "target"))
    return both.distinct().select(F.concat_ws(":", "repo", "source_file").alias("src"), F.lit("IMPORTS").alias("rel_type"),
                                  F.concat_ws(":", "repo", "target").alias("dst"), F.create_map().cast("map<string,string>").alias("props"))
