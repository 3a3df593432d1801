"""Rules work out what they share once a row."""

from weftgraph.operators import safety as S


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_paths_are_split_once_a_row(spark):
    df = spark.createDataFrame([("/repo/a/../.git/x",), ("/repo/../etc/.env",), ("src/A.PEM",), (None,), ("",)], "path string")
    found = S.scan_paths(df)
    assert found.columns == ["path", "rule"]
    assert {tuple(r) for r in found.collect()} >= {("/repo/a/../.git/x", "repo_config"), ("/repo/../etc/.env", "outside_root"), ("/repo/../etc/.env", "sensitive_name")}
    assert _plan(found).count("aggregate(") == 1


def test_secret_rules_run_once_a_text(spark, monkeypatch):
    monkeypatch.setattr(S.R, "SECRET_RULES", [("AKIA[A-Z]{16}", "key", True)])
    df = spark.createDataFrame([(1, "AKIA" + "A" * 16), (2, "\x00"), (3, "plain")], "doc_id int, content string")
    found = S.scan_content(df, "doc_id")
    assert {(r["doc_id"], r["kind"]) for r in found.collect()} == {(1, "secret"), (2, "binary")}
    assert _plan(found).count("AKIA") == 1
