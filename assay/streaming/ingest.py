"""Incremental ingest of predictions, with its rejects, and running progress counts.

There is no event time in the data and so no watermark: what has been accepted is the
sink itself, one row per (judge, record) at most, and so bounded by the pool times the
judges. Every batch is judged against it and written to a folder of its own in the sink
and in the rejects; a batch that runs again replaces its folders, so a restart neither
loses nor repeats a row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assay.operators.rules import probability_problems
from assay.session import cut_lineage
from assay.vocab import STATUSES

KEYS = ["judge_id", "record_id"]


def normalise_failures(df: DataFrame) -> DataFrame:
    """A row that breaks the prediction contract becomes a provider_error instead of stopping the run."""
    status = F.col("execution_status")
    problems = {
        "unknown_status": status.isNull() | ~status.isin(*STATUSES),
        "missing_label": (status == "ok") & F.col("label").isNull(),
        "negative_latency": F.col("latency_ms") < 0,
    }
    if "probabilities" in df.columns:
        problems |= {name: bad for name, (bad, _) in probability_problems(F.col("probabilities")).items()}
    kind = reduce(lambda acc, item: acc.when(item[1], item[0]), problems.items(), F.when(F.lit(False), ""))
    out = df.withColumn("_problem", kind)
    broken = F.col("_problem").isNotNull()
    fixes = {
        "execution_status": F.when(broken, "provider_error").otherwise(status),
        "label": F.when(broken, F.lit(None).cast("string")).otherwise(F.col("label")),
        "error_kind": F.when(broken, F.col("_problem")).otherwise(
            F.col("error_kind") if "error_kind" in df.columns else F.lit(None).cast("string")
        ),
    }
    if "probabilities" in df.columns:
        fixes["probabilities"] = F.when(~broken, F.col("probabilities"))
    return out.withColumns(fixes).drop("_problem")


def judged(batch: DataFrame, pool: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """STR1: (accepted, rejects) of one batch; ``held`` are the (judge, record) keys accepted before.

    A row outside the pool breaks ``unknown_record``. Of the rows of a key the first by
    ``ordinal`` (then by arrival, where ordinals are missing or equal) is accepted unless
    the key is held; the others break ``duplicate_prediction``. Rows without a judge or
    record id break ``missing_key``. Rejects carry rule, key, ordinal and the row's status.
    """
    given = F.col("ordinal") if "ordinal" in batch.columns else F.lit(None).cast("long")
    order = F.struct(given.alias("ordinal"), F.monotonically_increasing_id().alias("arrival"))
    rows = cut_lineage(batch.withColumn("_order", order))  # arrival numbers must not change when a task runs again
    ids = pool.select("record_id").distinct().withColumn("_in_pool", F.lit(True))
    rows = rows.join(ids, "record_id", "left")
    first = rows.groupBy(*KEYS).agg(F.min("_order").alias("_first"))
    # inner: a null key joins nothing and is taken up below
    marked = rows.join(first, KEYS).join(held.select(*KEYS).distinct().withColumn("_held", F.lit(True)), KEYS, "left")
    rule = F.when(F.col("_in_pool").isNull(), "unknown_record").when(
        F.col("_held").isNotNull() | (F.col("_order") > F.col("_first")), "duplicate_prediction"
    )
    marked = marked.withColumn("rule", rule)
    bare = rows.where(F.col("judge_id").isNull() | F.col("record_id").isNull()).withColumn("rule", F.lit("missing_key"))
    told = [*KEYS, F.col("_order.ordinal").alias("ordinal"), "execution_status", "rule"]
    rejects = marked.where("rule IS NOT NULL").select(*told).unionByName(bare.select(*told))
    good = marked.where("rule IS NULL").select(*batch.columns)
    return normalise_failures(good), rejects


def ingest_predictions(
    stream: DataFrame, pool: DataFrame, sink: str, checkpoint: str, once: bool = True, rejects: str | None = None
) -> StreamingQuery:
    """STR1: accepted rows to a Parquet sink, refused ones with rule and key to ``rejects`` (default: beside the sink).

    A restart goes on where the checkpoint stopped.
    """
    spark = stream.sparkSession
    rejects = rejects or f"{sink.rstrip('/')}-rejects"
    blank = stream.sparkSession.createDataFrame([], stream.schema)
    for df, path in zip(judged(blank, pool, blank), (sink, rejects), strict=True):
        df.write.mode("ignore").parquet(f"{path}/batch=-1")  # both can be read before the first batch

    def take(batch: DataFrame, number: int) -> None:
        held = spark.read.schema("judge_id string, record_id string, batch long").parquet(sink).where(F.col("batch") < number)
        good, bad = judged(batch, pool, held)
        good.write.mode("overwrite").parquet(f"{sink}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{rejects}/batch={number}")

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def progress(stream: DataFrame) -> DataFrame:
    """STR2: rows per judge and status so far; write it in update or complete mode."""
    return stream.groupBy("judge_id", "execution_status").agg(F.count("*").alias("count"))
