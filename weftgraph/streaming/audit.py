"""Audit log as a stream: JSON lines in, typed and deduplicated events out, and an account of all the lines that are not events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.operators.audit import AUDIT_SCHEMA
from weftgraph.plans.scale import durable


def audit_stream(spark: SparkSession, path: str, delay: str = "1 hour") -> DataFrame:
    """Events from JSON-lines files; an event equal in every field passes once within the watermark."""
    raw = spark.readStream.schema(AUDIT_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    timed = raw.withColumn("ts", F.try_to_timestamp("timestamp")).filter("ts is not null").withWatermark("ts", delay)
    hashed = timed.withColumn("_event", F.sha2(F.to_json(F.struct(*AUDIT_SCHEMA.fieldNames())), 256))
    return hashed.dropDuplicatesWithinWatermark(["_event"]).drop("_event")


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True):
    """Append to parquet exactly once per checkpoint; ``once`` works off what is there and stops."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def write_accounted(spark: SparkSession, path: str, out: str, refused: str, checkpoint: str, delay: str = "1 hour", files_per_batch: int | None = None):
    """Every line of the JSON-lines files ends in one of two folders: events in ``out``, other lines in ``refused`` with their reason.

    Reasons: ``malformed`` (no JSON object of the schema), ``no time`` (null or broken timestamp), ``late`` (older than the newest event of earlier
    batches less ``delay``), ``duplicate`` (equal in every field to an event of this or an earlier batch; one of them is the event). Empty lines are
    malformed. Both folders are split by batch and a batch that is run again replaces its own part, so each line counts once. Events are compared with
    earlier ones no older than the oldest of the batch.
    """
    def divide(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        parsed = F.from_json("value", T.StructType([*AUDIT_SCHEMA.fields, T.StructField("_corrupt", T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
        # a line that is no object parses to nulls without being marked
        is_object = F.col("value").rlike(r"^\s*\{")
        rows = batch.select("value", parsed.alias("e"), is_object.alias("_object")).withColumn("ts", F.try_to_timestamp("e.timestamp"))
        names = AUDIT_SCHEMA.fieldNames()
        events = [F.col(f"e.{name}").alias(name) for name in names]
        reason = F.when(~F.col("_object") | F.col("e").isNull() | F.col("e._corrupt").isNotNull(), "malformed").when(F.col("ts").isNull(), "no time")
        rows = durable(rows.select("value", *events, "ts", reason.alias("reason")), "batch")
        rows = rows.withColumn("_event", F.sha2(F.to_json(F.struct(*names)), 256))
        earlier = _before(session, out, number, rows.select(*names, "ts", "_event").schema)
        newest = earlier.agg(F.max("ts")).first()[0] if earlier is not None else None
        if newest is not None:
            bound = F.lit(newest) - F.expr(f"interval {delay}")
            rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.col("ts") < bound, "late")))
            oldest = rows.filter("reason is null").agg(F.min("ts")).first()[0]
            known = earlier.filter(F.col("ts") >= F.lit(oldest)).select("_event", F.lit(True).alias("_known")) if oldest is not None else None
            rows = rows.join(known, "_event", "left") if known is not None else rows.withColumn("_known", F.lit(None).cast("boolean"))
        else:
            rows = rows.withColumn("_known", F.lit(None).cast("boolean"))
        good = rows.filter("reason is null and _known is null")
        once = durable(good.groupBy("_event").agg(F.count("*").alias("_n"), F.first(F.struct(*names, "ts")).alias("_row")), "events")
        once.select("_row.*", "_event").write.mode("overwrite").parquet(f"{out}/batch={number}")
        again = once.filter("_n > 1").select(F.to_json("_row").alias("value"), F.lit("duplicate").alias("reason"), (F.col("_n") - 1).alias("n"))
        other = rows.filter("reason is not null or _known").select("value", F.coalesce("reason", F.lit("duplicate")).alias("reason"), F.lit(1).cast("bigint").alias("n"))
        other.unionByName(again).write.mode("overwrite").parquet(f"{refused}/batch={number}")

    stream = spark.readStream
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    return stream.text(path).writeStream.foreachBatch(divide).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _before(spark: SparkSession, out: str, number: int, schema) -> DataFrame | None:
    """Events of earlier batches."""
    if number == 0:
        return None
    found = spark.read.schema(schema).option("basePath", out).parquet(*[f"{out}/batch={n}" for n in range(number)])
    return found
