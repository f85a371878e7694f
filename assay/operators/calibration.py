"""Temperature and Platt calibration as distributed reductions.

Only calibration rows may be fitted. Rows and parameters stay on the executors;
the driver only asks whether a group still moves.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.text import refuse
from assay.operators.metrics import class_vector, classification_report
from assay.session import cut_lineage
from assay.vocab import PROBABILITY_FLOOR

LOG_T_RANGE = (-6.0, 6.0)
PASSES = 100
TOLERANCE = 1e-8  # of log T


def check_fit_rows(df: DataFrame) -> None:
    """Fitting takes calibration rows with an ok label and a probability map, and nothing else."""
    bad = df.agg(
        F.count_if(F.col("split") == "test").alias("test"),
        F.count_if(F.col("split") != "calibration").alias("other"),
        F.count_if((F.col("execution_status") != "ok") | F.col("label").isNull()).alias("failed"),
        F.count_if(F.col("probabilities").isNull()).alias("bare"),
        F.count("*").alias("rows"),
    ).first()
    if bad["test"]:
        raise ValueError("test rows must not be fitted")
    if bad["other"]:
        raise ValueError("only rows of the calibration split may be fitted")
    if bad["failed"]:
        raise ValueError("only ok rows with a label may be fitted")
    if bad["bare"]:
        raise ValueError("rows to fit need a probability map")
    if not bad["rows"]:
        raise ValueError("there is nothing to fit")


def _log_vector(probabilities: Column, classes: Column) -> Column:
    floor = F.lit(PROBABILITY_FLOOR)
    return F.transform(class_vector(probabilities, classes), lambda p: F.log(F.greatest(p, floor)))


def _moments() -> list[dict[str, Column]]:
    """Loss, slope and curvature of -log softmax(s * logs)[gold] in ``s``, the inverse temperature, in three steps.

    Built once per fit: making the expressions anew for every pass costs more than a pass.
    """
    add = lambda xs: F.aggregate(xs, F.lit(0.0), lambda acc, v: acc + v)
    top, mass, e1 = F.array_max("_logs"), F.col("_m"), F.col("_e1")
    return [
        {"_w": F.transform("_logs", lambda v: F.exp((v - F.array_max("_logs")) * F.col("_s")))},
        {"_m": add(F.col("_w"))},
        {
            "_e1": add(F.zip_with("_w", "_logs", lambda w, v: w * v)) / mass,
            "_e2": add(F.zip_with("_w", "_logs", lambda w, v: w * v * v)) / mass,
        },
        {
            "_loss": F.log(mass) + (top - F.col("_gold")) * F.col("_s"),
            "_slope": e1 - F.col("_gold"),
            "_curve": F.col("_e2") - e1 * e1,
        },
    ]


def _newton(keys: Sequence[str]) -> list[dict[str, Column] | list[Column | str]]:
    """The bracket, the next place and the new parameters of a pass, built once per fit."""
    s, slope, curve, lo, hi = (F.col(c) for c in ("_s", "_slope", "_curve", "_lo", "_hi"))
    newton = s - F.try_divide(slope, curve)
    inside = F.coalesce((curve > 0) & (newton > lo) & (newton < hi), F.lit(False))
    past = (slope <= 0) & F.coalesce(newton >= hi, F.lit(True))  # towards the end of the range
    near = F.abs(F.log(F.col("_next") / s)) < TOLERANCE
    return [
        {"_lo": F.coalesce(F.when(slope <= 0, s).otherwise(lo), lo), "_hi": F.coalesce(F.when(slope > 0, s).otherwise(hi), hi)},
        {"_next": F.when(inside, newton).when(past, hi).otherwise(F.sqrt(lo * hi))},
        [*keys, F.when(F.col("_done"), s).otherwise(F.col("_next")).alias("_s"), "_lo", "_hi", (F.col("_done") | near).alias("_done")],
    ]


def fit_temperature(df: DataFrame, by: Sequence[str], classes: Column, checked: bool = True) -> DataFrame:
    """CAL1: temperature of lowest mean NLL per group; 1.0 unless it improves.

    The loss is convex in the inverse temperature: each pass is one evaluation per
    row and a Newton step per group, halving the bracket where a step leaves it.
    Parameters stay a table, so any number of groups can be fitted. The result
    names its method, split and class order, which ``apply_temperature`` checks.
    """
    if checked:
        check_fit_rows(df)
    keys = list(by) or ["_all"]
    gold_at = F.array_position(classes, F.col("gold"))
    named = refuse(df, F.coalesce(gold_at, F.lit(0)) == 0, "a calibration label is none of the classes")
    logs = _log_vector(F.col("probabilities"), classes)
    rows = named.select(
        *[(F.col(c).cast("string") if by else F.lit("all")).alias(c) for c in keys],
        logs.alias("_logs"),
        F.element_at(logs, gold_at.cast("int")).alias("_gold"),
        classes.alias("_classes"),
    ).persist(StorageLevel.MEMORY_AND_DISK)
    low, high = (math.exp(x) for x in LOG_T_RANGE)

    moments, (bracket, onward, result) = _moments(), _newton(keys)
    means = [F.avg(c).alias(c) for c in ("_loss", "_slope", "_curve")]

    def measured(params: DataFrame) -> DataFrame:
        out = rows.join(params, keys)
        for columns in moments:
            out = out.withColumns(columns)
        return out.groupBy(*keys).agg(*means)

    def moved(params: DataFrame) -> DataFrame:
        step = params.join(measured(params.where("not _done").select(*keys, "_s")), keys, "left")
        return step.withColumns(bracket).withColumns(onward).select(*result)

    try:
        start = rows.groupBy(*keys).agg(F.count("*").alias("fit_rows"), F.any_value("_classes").alias("class_order"))
        start = cut_lineage(start)
        params = start.select(
            *keys, F.lit(1.0).alias("_s"), F.lit(low).alias("_lo"), F.lit(high).alias("_hi"), F.lit(False).alias("_done")
        )
        for _ in range(PASSES):
            params = cut_lineage(moved(params))
            if params.where("not _done").isEmpty():
                break
        before = measured(start.select(*keys, F.lit(1.0).alias("_s"))).select(*keys, F.col("_loss").alias("nll_before"))
        after = measured(params.select(*keys, "_s")).select(*keys, F.col("_loss").alias("_after"))
        better = F.col("_after") <= F.col("nll_before")
        fitted = start.join(params, keys).join(before, keys).join(after, keys)
        return cut_lineage(
            fitted.select(
                *by,
                F.when(better, 1 / F.col("_s")).otherwise(1.0).alias("temperature"),
                "nll_before",
                F.least("_after", "nll_before").alias("nll_after"),
                "fit_rows",
                F.lit("temperature").alias("method"),
                F.lit("calibration").alias("fit_split"),
                "class_order",
            )
        )
    finally:
        rows.unpersist()


def softmax_at(probabilities: Column, temperature: Column, classes: Column) -> Column:
    """CAL2: softmax(log(p) / T) as a map in class order."""
    logits = F.transform(_log_vector(probabilities, classes), lambda v: v / temperature)
    top = F.array_max(logits)
    weights = F.transform(logits, lambda v: F.exp(v - top))
    total = F.aggregate(weights, F.lit(0.0), lambda acc, v: acc + v)
    return F.map_from_arrays(classes, F.transform(weights, lambda v: v / total))


def apply_temperature(df: DataFrame, model: DataFrame, by: Sequence[str], classes: Column) -> DataFrame:
    """CAL2/CAL5: calibrate rows that have both a model and a map; the others stay as they are.

    Reads no labels. The model has one row per group; the planner broadcasts it when it is small.
    """
    named = [c for c in ("class_order",) if c in model.columns]
    joined = df.join(model.select(*by, "temperature", *named), list(by), "left")
    if named:
        joined = refuse(joined, F.col("class_order") != classes, "the model was fitted for another class order")
        joined = joined.drop("class_order")
    joined = refuse(joined, F.col("temperature") <= 0, "a temperature is not positive")
    usable = F.col("temperature").isNotNull() & F.col("probabilities").isNotNull()
    tempered = softmax_at(F.col("probabilities"), F.col("temperature"), classes)
    return joined.withColumns(
        {
            "probabilities": F.when(usable, tempered).otherwise(F.col("probabilities")),
            "calibrated": usable,
        }
    )


def relabel(df: DataFrame, classes: Column) -> DataFrame:
    """CAL6: label = arg-max of the (calibrated) map, raw scores = log p."""
    p = F.col("probabilities")
    vector = class_vector(p, classes)
    spot = F.array_position(vector, F.array_max(vector)).cast("int")
    return df.withColumns(
        {
            "label": F.when(p.isNotNull(), F.element_at(classes, spot)).otherwise(F.col("label")),
            "raw_scores": F.transform_values(p, lambda _, v: F.log(F.greatest(v, F.lit(PROBABILITY_FLOOR)))),
        }
    )


def sigmoid(x: Column) -> Column:
    """Sign-split logistic function."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def log_odds(probability: Column) -> Column:
    p = F.coalesce(probability, F.lit(0.0))
    floor = F.lit(PROBABILITY_FLOOR)
    return F.log(F.greatest(p, floor) / F.greatest(1 - p, floor))


def fit_platt(df: DataFrame, by: Sequence[str], positive: str, checked: bool = True) -> DataFrame:
    """CAL3: binary logistic scaling by Newton steps; each step is five sums per group."""
    if checked:
        check_fit_rows(df)
    keys = list(by) or ["_all"]
    rows = df.select(
        *[(F.col(c).cast("string") if by else F.lit("all")).alias(c) for c in keys],
        log_odds(F.try_element_at("probabilities", F.lit(positive))).alias("_x"),
        (F.col("gold") == positive).cast("double").alias("_y"),
    ).persist(StorageLevel.MEMORY_AND_DISK)

    def moved(params: DataFrame) -> DataFrame:
        joined = rows.join(params.where("not _done").select(*keys, "slope", "intercept"), keys)
        joined = joined.withColumn("_q", sigmoid(F.col("slope") * F.col("_x") + F.col("intercept")))
        w = F.col("_q") * (1 - F.col("_q"))
        sums = joined.groupBy(*keys).agg(
            F.sum((F.col("_q") - F.col("_y")) * F.col("_x")).alias("g1"),
            F.sum(F.col("_q") - F.col("_y")).alias("g2"),
            (F.sum(w * F.col("_x") * F.col("_x")) + 1e-8).alias("h11"),
            F.sum(w * F.col("_x")).alias("h12"),
            (F.sum(w) + 1e-8).alias("h22"),
        )
        det = F.col("h11") * F.col("h22") - F.col("h12") * F.col("h12")
        d1 = F.when(det > 0, (F.col("h22") * F.col("g1") - F.col("h12") * F.col("g2")) / det)
        d2 = F.when(det > 0, (F.col("h11") * F.col("g2") - F.col("h12") * F.col("g1")) / det)
        return params.join(sums, keys, "left").select(
            *keys,
            (F.col("slope") - F.coalesce(d1, F.lit(0.0))).alias("slope"),
            (F.col("intercept") - F.coalesce(d2, F.lit(0.0))).alias("intercept"),
            F.coalesce(F.greatest(F.abs(d1), F.abs(d2)) < 1e-9, F.lit(True)).alias("_done"),
        )

    try:
        params = rows.select(*keys).distinct()
        params = params.select(*keys, F.lit(1.0).alias("slope"), F.lit(0.0).alias("intercept"), F.lit(False).alias("_done"))
        for _ in range(PASSES):
            params = cut_lineage(moved(params))
            if params.where("not _done").isEmpty():
                break
        return params.select(*by, "slope", "intercept")
    finally:
        rows.unpersist()


def apply_platt(df: DataFrame, model: DataFrame, by: Sequence[str], negative: str, positive: str) -> DataFrame:
    """CAL4: sigmoid(slope * score + intercept) as a two-class map."""
    joined = df.join(model, list(by), "left")
    score = log_odds(F.try_element_at("probabilities", F.lit(positive)))
    up = sigmoid(F.col("slope") * score + F.col("intercept"))
    usable = F.col("slope").isNotNull() & F.col("probabilities").isNotNull()
    scaled = F.create_map(F.lit(negative), 1 - up, F.lit(positive), up)
    return joined.withColumn("probabilities", F.when(usable, scaled).otherwise(F.col("probabilities"))).drop(
        "slope", "intercept"
    )


def apply_calibration(df: DataFrame, method: str, model: DataFrame, by: Sequence[str], classes: Column, **binary) -> DataFrame:
    """Dispatch by artifact method."""
    if method == "temperature":
        return apply_temperature(df, model, by, classes)
    if method == "platt":
        return apply_platt(df, model, by, **binary)
    raise ValueError(f"unsupported calibration method: {method}")


def fit_by_mode(df: DataFrame, classes: Column, modes: Sequence[str]) -> DataFrame:
    """CAL5: one temperature per mode; a mode without rows is marked unavailable."""
    fitted = fit_temperature(df, ["mode"], classes)
    wanted = df.sparkSession.createDataFrame([(m,) for m in modes], "mode string")
    return wanted.join(fitted, "mode", "left").withColumn(
        "status", F.when(F.col("temperature").isNull(), "unavailable").otherwise("fitted")
    )


def calibration_report(raw: DataFrame, calibrated: DataFrame, by: Sequence[str], classes: Column, missing: str = "drop") -> DataFrame:
    """CAL7: metrics before and after calibration, keyed by ``view``."""
    both = raw.withColumn("view", F.lit("raw")).unionByName(
        calibrated.select(*raw.columns).withColumn("view", F.lit("calibrated"))
    )
    return classification_report(both, ["view", *by], classes, missing=missing)
