"""Properties that hold for any input."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.functions import scalar as X
from weftgraph.operators import chunk as C
from weftgraph.sources.files import glob_regex

LIMIT = 9


def greedy(lines):
    starts, sums, cur = [0], [], 0
    for i, line in enumerate(lines):
        t = -(-(len(line) + 1) // 4)
        if i and cur + t > LIMIT:
            sums.append(cur)
            starts.append(i)
            cur = 0
        cur += t
    return starts, sums + [cur]


def test_packing_is_greedy_and_loses_nothing(spark):
    @settings(max_examples=3, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.lists(st.text("abc é", max_size=60), min_size=1, max_size=25), min_size=1, max_size=40))
    def check(docs):
        df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, lines array<string>")
        for r in df.select("id", "lines", C.pack_lines(F.col("lines"), LIMIT, X.token_estimate).alias("p")).collect():
            assert (r.p.starts, r.p.sums) == greedy(r.lines)
            ends = r.p.starts[1:] + [len(r.lines)]
            assert all(t <= LIMIT or b - a == 1 for t, a, b in zip(r.p.sums, r.p.starts, ends))

    check()


def test_path_confidence_range_and_symmetry(spark):
    part = st.sampled_from(["a", "b", ":x", ":y"])
    path = st.lists(part, min_size=1, max_size=4).map(lambda p: "/" + "/".join(p))

    @settings(max_examples=2, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.tuples(path, path), min_size=50, max_size=200))
    def check(pairs):
        df = spark.createDataFrame(pairs, "a string, b string")
        for r in df.select("a", "b", X.path_confidence(F.col("a"), F.col("b")).alias("x"), X.path_confidence(F.col("b"), F.col("a")).alias("y")).collect():
            assert 0 <= r.x <= 1 and r.x == r.y
            assert (r.x == 1.0) == (r.a == r.b)

    check()


def test_cosine_bounds(spark):
    rows = [([1.0, 0.0], [0.0, 2.0], 0.0), ([1.0, 1.0], [2.0, 2.0], 1.0), ([1.0, 0.0], [-3.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 1.0], 0.0)]
    df = spark.createDataFrame(rows, "a array<double>, b array<double>, want double")
    assert all(abs(r.c - r.want) < 1e-9 for r in df.select("want", X.cosine(F.col("a"), F.col("b")).alias("c")).collect())


def test_globs():
    import re

    def hit(glob, path):
        return re.match(glob_regex(glob).replace(r"\z", r"\Z"), path) is not None

    assert hit("**/*.ts", "a.ts") and hit("**/*.ts", "x/y/a.ts") and not hit("**/*.ts", "a.tsx")
    assert hit("**/node_modules/**", "node_modules/a/b/c.ts") and hit("**/node_modules/**", "p/node_modules/c.ts") and not hit("**/node_modules/**", "my_node_modules/c.ts")
    assert hit("**/*.test.*", "q/a.test.tsx") and not hit("*.ts", "x/a.ts")
