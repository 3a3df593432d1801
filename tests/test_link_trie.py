"""Template matching against a plain version: long paths, shared parameters, catch-alls, ties."""

import random

import pytest

from weftgraph.operators import link as L


def plain(call, templates, pick):
    best = None
    for ordinal, path in templates:
        a, b = call.split("/")[1:], path.split("/")[1:]
        if len(a) != len(b) or not all(x == y or x[:1] == ":" or y[:1] == ":" for x, y in zip(a, b, strict=True)):
            continue
        points = sum(10 if x == y else 8 for x, y in zip(a, b, strict=True))
        rank = (-points, ordinal) if pick == "best" else (ordinal,)
        if best is None or rank < best[0]:
            best = (rank, ordinal, round(points / 10 / len(a), 6))
    return best and best[1:]


def link(spark, calls, templates, pick="best"):
    left = spark.createDataFrame([("f", i, "get", p) for i, p in enumerate(calls)], "file_path string, line_number int, method string, url_pattern string")
    right = spark.createDataFrame([(f"e{o}", "GET", p, "c", "h", o) for o, p in templates], "file_path string, http_method string, path string, controller string, handler_method string, ordinal long")
    return {r["fe_line"]: (int(r["be_file"][1:]), round(r["confidence"], 6)) for r in L.link(left, right, pick).collect()}


@pytest.mark.parametrize("pick", ["best", "first"])
def test_random_paths(spark, pick):
    r = random.Random(pick)
    parts = ["a", "b", "c", ":x", ":y", ":param", "*"]
    calls = list({"/" + "/".join(r.choice(parts) for _ in range(r.randrange(1, 5))) for _ in range(150)})
    templates = list(enumerate({"/" + "/".join(r.choice(parts) for _ in range(r.randrange(1, 5))) for _ in range(60)}))
    exact = {p: o for o, p in templates}
    want = {i: (exact[c], 1.0) if c in exact else plain(c, templates, pick) for i, c in enumerate(calls)}
    assert link(spark, calls, templates, pick) == {i: x for i, x in want.items() if x}


def test_long_paths_shared_parameters_and_catch_all(spark):
    shared = [f":p{i}" for i in range(12)]
    long = [f"s{i}" for i in range(28)] + shared  # 40 segments
    other = list(long)
    other[35] = "fixed"
    templates = [(0, "/" + "/".join([":any"] * 40)), (1, "/" + "/".join(long[:39] + ["last"])), (2, "/" + "/".join([*long[:33], "no", *long[34:39], "end"])), (3, "/:one/:two")]
    calls = ["/" + "/".join(other), "/" + "/".join(["z", *long[1:]]), *[f"/u{i}/v" for i in range(300)], "/alone"]
    found = link(spark, calls, templates)
    assert found[0] == plain(calls[0], templates, "best") and found[0][0] == 1 and found[1] == (0, 0.8)
    assert all(found[2 + i] == (3, 0.8) for i in range(300)) and 302 not in found
    assert link(spark, [], templates) == {} == link(spark, calls[:3], [])


def test_plan_has_no_nested_loop(spark):
    left = spark.createDataFrame([("GET", "/a/b")], "m string, p string")
    right = spark.createDataFrame([("GET", "/a/:x", 1)], "m string, p string, ordinal long")
    text = L._pattern_matches(left, right, "best")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "NestedLoop" not in text and "Cartesian" not in text
