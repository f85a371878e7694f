"""Run ledger: one row per run unit, read from free-form result documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.operators.metrics import ratio

# Folder names, name markers and structure flags of the ledger.
EXPERIMENT_NAME = r"^EXP-\d{8}-\d{3}-[a-z0-9-]+$"
QUARANTINE = r"paused|quarantine|abandoned"
FLAGS = (
    "has_metrics",
    "has_aggregate",
    "has_arms",
    "has_arm_accuracy",
    "has_partitions",
    "has_model_arms",
    "has_latency",
    "has_elapsed_seconds",
    "has_cost",
    "has_code_commit",
)


def _at(doc: Column, path: str) -> Column:
    return F.try_variant_get(doc, path, "variant")


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def number(value: Column) -> Column:
    """Finite numeric value; booleans and other types are absent."""
    numeric = F.rlike(_kind(value), F.lit("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"))
    x = F.when(numeric, F.try_variant_get(value, "$", "double"))
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")), x)


def integer(value: Column) -> Column:
    return F.when(_kind(value) == "BIGINT", F.try_variant_get(value, "$", "bigint"))


def text(value: Column) -> Column:
    return F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string"))


def is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(_kind(value), F.lit("OBJECT")), F.lit(False))


def ledger_paths(df: DataFrame, path: str = "path") -> DataFrame:
    """LED1: experiment, run path, scope and run id from a ``results.json`` path.

    Paths are relative to the root: ``experiments/<experiment>/.../results.json``.
    Others, and folders not named like an experiment, are left out.
    """
    parts = F.split(F.col(path), "/")
    rows = df.withColumn("_parts", parts).filter(
        (F.get("_parts", F.lit(0)) == "experiments")
        & (F.size("_parts") >= 3)
        & F.rlike(F.get("_parts", F.lit(1)), F.lit(EXPERIMENT_NAME))
    )
    rest = F.slice("_parts", F.lit(3), F.greatest(F.size("_parts") - 3, F.lit(0)))
    rows = rows.withColumn("_rest", rest)
    n, first = F.size("_rest"), F.get("_rest", F.lit(0))
    scope = (
        F.when(n == 0, "experiment")
        .when((n == 2) & (first == "runs"), "run")
        .when((n == 3) & (first == "runs"), "nested_run")
        .when((n == 2) & (first == "diagnostics"), "diagnostic")
        .otherwise("child_run")
    )
    return rows.select(
        *[c for c in df.columns if c != path],
        F.array_join(F.slice("_parts", F.lit(1), F.size("_parts") - 1), "/").alias("run_path"),
        F.get("_parts", F.lit(1)).alias("experiment"),
        scope.alias("scope"),
        F.when(n > 0, F.element_at("_rest", -1)).alias("run_id"),
    )


def accuracy_fields(doc: Column) -> Column:
    """LED2: accuracy from four places in priority order, with the place it came from."""
    places = [
        ("metrics.accuracy", number(_at(doc, "$.metrics.accuracy"))),
        ("aggregate.metrics.accuracy", number(_at(doc, "$.aggregate.metrics.accuracy"))),
        ("accuracy", number(_at(doc, "$.accuracy"))),
        (
            "correct_count/resolved_count",
            F.when(
                integer(_at(doc, "$.resolved_count")) > 0,
                ratio(integer(_at(doc, "$.correct_count")), integer(_at(doc, "$.resolved_count"))),
            ),
        ),
    ]
    source = F.coalesce(*[F.when(v.isNotNull(), F.lit(name)) for name, v in places])
    return F.struct(F.coalesce(*[v for _, v in places]).alias("accuracy"), source.alias("accuracy_source"))


def interval_fields(doc: Column) -> Column:
    """LED2: accuracy interval from an object or from one of two bound pairs."""

    def bounds(low: Column, high: Column) -> Column:
        return F.when(low.isNotNull() | high.isNotNull(), F.struct(low.alias("low"), high.alias("high")))

    shapes = [bounds(number(_at(doc, "$.accuracy_95_ci.lower")), number(_at(doc, "$.accuracy_95_ci.upper")))]
    for key in ("accuracy_wilson_95", "accuracy_95_wilson"):
        pair = F.size(F.try_variant_get(doc, f"$.{key}", "array<variant>")) == 2
        shapes.append(F.when(pair, bounds(number(_at(doc, f"$.{key}[0]")), number(_at(doc, f"$.{key}[1]")))))
    return F.coalesce(*shapes)


def ledger_fields(doc: Column) -> dict[str, Column]:
    """LED2: fields of a document, each from the first place that has it."""
    counts = F.try_variant_get(doc, "$.status_counts", "map<string,variant>")
    whole = F.transform_values(F.map_filter(counts, lambda _, v: integer(v).isNotNull()), lambda _, v: integer(v))
    return {
        "partition": text(_at(doc, "$.partition")),
        "provider": text(_at(doc, "$.provider")),
        "model": F.coalesce(F.nullif(text(_at(doc, "$.model")), F.lit("")), text(_at(doc, "$.requested_model"))),
        "created_at_utc": text(_at(doc, "$.created_at_utc")),
        "record_count": F.coalesce(
            integer(_at(doc, "$.record_count")), integer(_at(doc, "$.total_count")), integer(_at(doc, "$.aggregate.count"))
        ),
        "resolved_count": F.coalesce(integer(_at(doc, "$.resolved_count")), integer(_at(doc, "$.successful_count"))),
        "status_counts": F.coalesce(
            whole, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
        ),
        "accuracy_ci": interval_fields(doc),
    }


def ledger_structure(doc: Column) -> Column:
    """LED3: presence and type flags of a document; all false without one."""
    arms = F.try_variant_get(doc, "$.arms", "map<string,variant>")
    scored = F.exists(F.map_values(arms), lambda a: number(F.try_variant_get(a, "$.accuracy", "variant")).isNotNull())

    def flag(c: Column, name: str) -> Column:
        return F.coalesce(c, F.lit(False)).alias(name)

    return F.struct(
        flag(is_object(_at(doc, "$.metrics")), "has_metrics"),
        flag(is_object(_at(doc, "$.aggregate")), "has_aggregate"),
        flag(is_object(_at(doc, "$.arms")), "has_arms"),
        F.when(is_object(_at(doc, "$.arms")), F.size(F.map_keys(arms))).alias("arms_count"),
        flag(scored, "has_arm_accuracy"),
        flag(is_object(_at(doc, "$.partitions")), "has_partitions"),
        flag(is_object(_at(doc, "$.model_arms")), "has_model_arms"),
        flag(_at(doc, "$.latency").isNotNull() | _at(doc, "$.latency_ms").isNotNull(), "has_latency"),
        flag(number(_at(doc, "$.elapsed_seconds")).isNotNull(), "has_elapsed_seconds"),
        flag(number(_at(doc, "$.actual_cost")).isNotNull(), "has_cost"),
        flag(text(_at(doc, "$.code_commit")).isNotNull(), "has_code_commit"),
    )


def _rows(located: DataFrame, has_results: bool) -> DataFrame:
    doc = F.col("doc")
    fields = ledger_fields(doc)
    embedded_experiment, embedded_run = text(_at(doc, "$.experiment_id")), text(_at(doc, "$.run_id"))
    name = F.element_at(F.split("run_path", "/"), -1)
    if has_results:
        state = F.when(doc.isNull(), "quarantined").otherwise("complete")
        digest = F.sha2(F.regexp_replace("content", "\r\n", "\n"), 256)
    else:
        state = F.when(F.rlike(F.lower(name), F.lit(QUARANTINE)), "quarantined").otherwise("partial")
        digest = F.lit(None).cast("string")
    accuracy = accuracy_fields(doc)
    return located.select(
        "run_path",
        "scope",
        "experiment",
        F.coalesce(embedded_experiment, "experiment").alias("experiment_id"),
        F.when(embedded_experiment.isNotNull(), "embedded").otherwise("path").alias("experiment_id_source"),
        F.coalesce(embedded_run, "run_id").alias("run_id"),
        F.when(embedded_run.isNotNull(), "embedded").when(F.col("run_id").isNotNull(), "path").alias("run_id_source"),
        F.lit(has_results).alias("has_results"),
        digest.alias("results_sha256"),
        *[c.alias(n) for n, c in fields.items()],
        accuracy["accuracy"].alias("accuracy"),
        accuracy["accuracy_source"].alias("accuracy_source"),
        ledger_structure(doc).alias("structure"),
        state.alias("completeness"),
    )


def run_ledger(results: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """LED4: one row per run unit.

    ``results``: path, content, doc of every ``results.json``. ``files``: paths of
    all files; run folders without results are taken from it, leaving out
    containers of nested runs.
    """
    done = _rows(ledger_paths(results), True)
    if files is None:
        return done
    parts = F.split("path", "/")
    under_runs = (
        (F.get(parts, F.lit(0)) == "experiments") & (F.get(parts, F.lit(2)) == "runs") & (F.size(parts) >= 5)
    )
    folder = F.array_join(F.slice(parts, 1, 4), "/")
    shallow = (F.element_at(parts, -1) == "results.json") & F.size(parts).isin(5, 6)
    runs = (
        files.filter(under_runs)
        .groupBy(folder.alias("folder"))
        .agg(F.max(shallow).alias("_has"))
        .filter("NOT _has")
        .select(F.concat("folder", F.lit("/results.json")).alias("path"))
    )
    empty = runs.withColumns({"content": F.lit(None).cast("string"), "doc": F.try_parse_json(F.lit(None).cast("string"))})
    return done.unionByName(_rows(ledger_paths(empty), False))


def ledger_findings(ledger: DataFrame) -> DataFrame:
    """AGG37: repository-wide counts in long form (section, key, metric, value), in one pass."""
    one = F.lit(1).cast("bigint")

    def cell(section: str, key: Column, metric: str, value: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            key.cast("string").alias("key"),
            F.lit(metric).alias("metric"),
            value.cast("bigint").alias("value"),
        )

    has, acc = F.col("has_results"), F.col("accuracy").isNotNull()
    experiment, state = F.col("experiment"), F.col("completeness")
    total = F.lit("all")
    cells = [
        cell("totals", total, "rows", one),
        cell("totals", total, "with_results", has.cast("bigint")),
        cell("totals", total, "without_results", (~has).cast("bigint")),
        cell("totals", total, "accuracy_rows", acc.cast("bigint")),
        cell("totals", total, "results_sha256_rows", F.col("results_sha256").isNotNull()),
        cell("totals", total, "created_at_rows", F.col("created_at_utc").isNotNull()),
        cell("totals", total, "arms_total", F.coalesce("structure.arms_count", F.lit(0))),
        cell("by_scope", F.col("scope"), "rows", one),
        cell("by_completeness", state, "rows", one),
        cell("by_experiment", experiment, "rows", one),
        cell("by_experiment", experiment, "with_results", has.cast("bigint")),
        cell("by_experiment", experiment, "accuracy", acc.cast("bigint")),
        *[
            cell("by_experiment", experiment, s, (state == s).cast("bigint"))
            for s in ("complete", "partial", "quarantined")
        ],
        *[cell("structure_coverage", total, f, F.col(f"structure.{f}").cast("bigint")) for f in FLAGS],
    ]
    statuses = F.transform(
        F.map_entries("status_counts"), lambda e: cell("status_totals", e["key"], "count", e["value"])
    )
    provider = F.when(F.col("provider").isNotNull(), cell("providers", F.col("provider"), "rows", one))
    run = F.when(F.col("run_id").isNotNull(), cell("reused_run_ids", F.col("run_id"), "experiments", one))
    run = run.withField("metric", experiment)
    everything = F.concat(F.array(*cells), statuses, F.array_compact(F.array(provider, run)))
    sums = ledger.select(F.inline(everything)).groupBy("section", "key", "metric").agg(F.sum("value").alias("value"))
    # a run id has one row per experiment by now; its reuse is the number of those rows
    reuse = F.col("section") == "reused_run_ids"
    metric = F.when(reuse, "experiments").otherwise(F.col("metric"))
    value = F.when(F.first("section") == "reused_run_ids", F.count("*")).otherwise(F.sum("value"))
    out = sums.groupBy("section", "key", metric.alias("metric")).agg(value.alias("value"))
    return out.filter(~reuse | (F.col("value") > 1))


def created_range(ledger: DataFrame) -> DataFrame:
    """AGG37: first and last creation time."""
    return ledger.agg(F.min("created_at_utc").alias("first"), F.max("created_at_utc").alias("last"))


def missing_results(ledger: DataFrame) -> DataFrame:
    """AGG37: run units without results."""
    return ledger.filter(~F.col("has_results")).select("run_path")
