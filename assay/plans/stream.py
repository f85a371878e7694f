"""Streaming queries: events as a stream of predictions over the customer pool."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from assay.plans import derive as D
from assay.plans.registry import query
from assay.session import ensure_checkpoint_dir
from assay.streaming import ingest as S


def prediction_stream(spark, sf):
    schema = D.table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.select(
        F.col("event_type").alias("judge_id"),
        F.col("user_id").cast("string").alias("record_id"),
        F.when(F.col("event_type") == "error", "rate_limited").otherwise("ok").alias("execution_status"),
        F.when(F.col("event_type") != "signup", "pass").alias("label"),
        F.col("value").alias("latency_ms"),
        F.col("event_id").alias("ordinal"),
    )


def _scratch(spark) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


_TAKEN = """e AS (SELECT event_type AS judge_id, user_id::VARCHAR AS record_id, event_id AS ordinal, value AS latency_ms,
  CASE event_type WHEN 'error' THEN 'rate_limited' ELSE 'ok' END AS raw_status, user_id IN (SELECT c_custkey FROM customer) AS in_pool,
  row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS nth FROM events)"""


def ingested(spark, sf):
    """Ingest all events once; the folder with ``rows`` and ``rows-rejects``."""
    pool = D.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("record_id"))
    base = _scratch(spark)
    S.ingest_predictions(prediction_stream(spark, sf), pool, f"{base}/rows", f"{base}/state").awaitTermination()
    return base


@query(
    "STR1",
    f"""WITH {_TAKEN} SELECT judge_id, record_id, ordinal, latency_ms,
 CASE WHEN judge_id='signup' OR latency_ms < 0 THEN 'provider_error' ELSE raw_status END AS execution_status,
 CASE WHEN judge_id='signup' OR latency_ms < 0 THEN NULL ELSE 'pass' END AS label,
 CASE WHEN judge_id='signup' THEN 'missing_label' WHEN latency_ms < 0 THEN 'negative_latency' END AS error_kind
 FROM e WHERE in_pool AND nth = 1""",
)
def streamed_predictions(spark, sf):
    rows = spark.read.parquet(f"{ingested(spark, sf)}/rows")
    return rows.select("judge_id", "record_id", "ordinal", "latency_ms", "execution_status", "label", "error_kind")


@query(
    "STR1",
    f"""WITH {_TAKEN} SELECT judge_id, record_id, ordinal, raw_status AS execution_status,
 CASE WHEN in_pool THEN 'duplicate_prediction' ELSE 'unknown_record' END AS rule FROM e WHERE NOT in_pool OR nth > 1""",
)
def streamed_rejects(spark, sf):
    """What the ingest refused, with the rule and the key."""
    return spark.read.parquet(f"{ingested(spark, sf)}/rows-rejects").select("judge_id", "record_id", "ordinal", "execution_status", "rule")


@query(
    "STR2",
    """SELECT event_type AS judge_id, CASE event_type WHEN 'error' THEN 'rate_limited' ELSE 'ok' END AS execution_status, count(*) AS count FROM events GROUP BY ALL""",
)
def streamed_progress(spark, sf):
    base = _scratch(spark)
    run = (
        S.progress(prediction_stream(spark, sf))
        .writeStream.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{base}/counts"))
        .option("checkpointLocation", f"{base}/state")
        .outputMode("complete")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(f"{base}/counts")
