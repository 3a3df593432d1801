"""Audit log as JSON lines: read with a fixed schema, append without empty keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.operators.audit import AUDIT_SCHEMA


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Typed events; malformed lines are skipped."""
    return spark.read.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def append_audit(events: DataFrame, path: str) -> None:
    names = [f.name for f in AUDIT_SCHEMA.fields]
    events.select(*names).write.mode("append").option("ignoreNullFields", "true").json(path)
