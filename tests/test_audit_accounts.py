"""The accounted audit stream: each line is an event or refused, and running it again changes nothing."""

import json

from pyspark.sql import functions as F

from weftgraph.streaming import audit as SA


def event(i, ts):
    return json.dumps({"timestamp": ts, "session_id": f"s{i}", "event_type": "FILE_WRITE", "details": {"k": "v"}})


def counts(spark, out, refused):
    found = {r["reason"]: r["n"] for r in spark.read.parquet(refused).groupBy("reason").agg(F.sum("n").alias("n")).collect()}
    return spark.read.parquet(out).count(), found


def test_counts_add_up(spark, tmp_path):
    source, out, refused = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "refused")
    source.mkdir()
    first = [event(i, f"2024-01-01T0{i}:00:00Z") for i in range(5)] + [event(1, "2024-01-01T01:00:00Z"), "{no", "", "[1]", '"x"', '{"timestamp": 5, "session_id": null}', "{}"]
    (source / "a.json").write_text("\n".join(first) + "\n")
    SA.write_accounted(spark, str(source), out, refused, str(tmp_path / "mark"), "2 hours").awaitTermination()
    assert counts(spark, out, refused) == (5, {"duplicate": 1, "malformed": 4, "no time": 2})
    second = [event(3, "2024-01-01T03:00:00Z"), event(9, "2024-01-01T01:30:00Z"), event(8, "2024-01-01T02:30:00Z"), event(8, "2024-01-01T02:30:00Z"), "x"]
    (source / "b.json").write_text("\n".join(second) + "\n")
    for _ in range(2):
        SA.write_accounted(spark, str(source), out, refused, str(tmp_path / "mark"), "2 hours").awaitTermination()
        n, other = counts(spark, out, refused)
        assert (n, other) == (6, {"duplicate": 3, "malformed": 5, "no time": 2, "late": 1})
        assert n + sum(other.values()) == len(first) + len(second)
    # a batch that is run again replaces its own part
    again = str(tmp_path / "again")
    for mark in ("m1", "m2"):
        SA.write_accounted(spark, str(source), again, refused + "2", str(tmp_path / mark), "2 hours").awaitTermination()
    n, other = counts(spark, again, refused + "2")
    assert n + sum(other.values()) == len(first) + len(second)
