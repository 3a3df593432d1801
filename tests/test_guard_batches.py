"""The classifier callback is asked once per batch, and its failures block only the texts that cause them."""

from weftgraph.operators import policy as P


def test_one_call_per_batch(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def fn(texts):
        with open(calls, "a") as f:
            f.write(f"{len(texts)}\n")
        if any("bad" in t for t in texts):
            raise ValueError("broken")
        return [("safe", None, t) for t in texts][: 1 if "short" in texts else None]

    def run(texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, query string").coalesce(1)
        return {r["id"]: (r["verdict"], r["reasoning"]) for r in P.guard(df, classify_fn=fn).collect()}

    assert run([f"text {i}" for i in range(20)])[7] == ("safe", "text 7")
    assert open(calls).read() == "20\n"
    got = run(["fine", "bad one", "also fine"])
    assert got[0] == ("safe", "fine") and got[2][0] == "safe" and got[1][0] == "blocked" and "broken" in got[1][1]
    assert run(["short", "x"]) == {0: ("safe", "short"), 1: ("safe", "x")}
