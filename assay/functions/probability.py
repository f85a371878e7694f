"""Probability-map functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.text import strip
from assay.operators.metrics import class_vector
from assay.vocab import PAIRWISE_LABELS, PROBABILITY_FLOOR, SINGLE_LABELS, lit_array

# Spellings of the two single labels and of an abstention.
PASS_WORDS = ("pass", "correct", "true", "yes", "1")
FAIL_WORDS = ("fail", "incorrect", "false", "no", "0")
ABSTENTIONS = ("__insufficient_evidence__", "insufficient_evidence", "abstain")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _checked(p: Column) -> Column:
    bad = F.exists(F.map_values(p), lambda v: ~finite(v))
    return F.when(bad, F.raise_error("confidence must be finite").cast("map<string,double>")).otherwise(p)


def confidence(p: Column) -> Column:
    """FN10: largest probability."""
    return F.array_max(F.map_values(_checked(p)))


def margin(p: Column) -> Column:
    """FN10: gap between the two largest probabilities (the largest alone if there is one class)."""
    ordered = F.sort_array(F.map_values(_checked(p)), asc=False)
    return F.get(ordered, F.lit(0)) - F.coalesce(F.get(ordered, F.lit(1)), F.lit(0.0))


def softmax(scores: Column) -> Column:
    """FN11: softmax over a score map, shifted by its largest value."""
    top = F.array_max(F.map_values(scores))
    raised = F.transform_values(scores, lambda _, v: F.exp(v - top))
    total = F.aggregate(F.map_values(raised), F.lit(0.0), lambda acc, v: acc + v)
    return F.transform_values(raised, lambda _, v: v / total)


def log_floor(p: Column) -> Column:
    """FN11: ln(max(p, 1e-15))."""
    return F.log(F.greatest(p, F.lit(PROBABILITY_FLOOR)))


def coerce_label(value: Column, mode: Column, labels: Sequence[str] | None = None) -> Column:
    """Legal label of a spelled verdict, else null. A declared label set needs exact membership."""
    text = strip(value)
    if labels is not None:
        return F.when(text.isin(*labels), text)
    single = F.when(F.lower(text).isin(*PASS_WORDS), "pass").when(F.lower(text).isin(*FAIL_WORDS), "fail")
    pair = F.when(F.upper(text).isin(*PAIRWISE_LABELS), F.upper(text))
    return F.when(mode == "single", single).otherwise(pair)


def legal_labels(mode: Column, labels: Sequence[str] | None = None) -> Column:
    if labels is not None:
        return lit_array(labels)
    return F.when(mode == "single", lit_array(SINGLE_LABELS)).otherwise(lit_array(PAIRWISE_LABELS))


def renormalize(p: Column, mode: Column, labels: Sequence[str] | None = None) -> Column:
    """FN16: keys to legal labels, mass to one, missing labels to zero.

    Null when a key is illegal, a value is negative or not finite, or there is no mass.
    """
    entries = F.transform(
        F.map_entries(p), lambda e: F.struct(coerce_label(e["key"], mode, labels).alias("k"), e["value"].alias("v"))
    )
    bad = F.exists(entries, lambda e: e["k"].isNull() | ~finite(e["v"]) | (e["v"] < 0))
    legal = legal_labels(mode, labels)
    kept = F.transform(
        legal,
        lambda name: F.coalesce(F.try_element_at(F.filter(entries, lambda e: e["k"] == name), F.lit(-1))["v"], F.lit(0.0)),
    )
    total = F.aggregate(kept, F.lit(0.0), lambda acc, v: acc + v)
    return F.when(~bad & (total > 0), F.map_from_arrays(legal, F.transform(kept, lambda v: v / total)))


def aggregate_criteria(df: DataFrame, expected: str = "criteria_count") -> DataFrame:
    """FN17: one verdict per record from its criterion rows.

    Input rows carry ``record_id, mode, criterion_id, label, probabilities`` and
    the number of rubric criteria; a missing criterion is a parse error.
    """
    stated = F.col("label").isNotNull()
    rows = df.groupBy("record_id", "mode").agg(
        F.count_distinct(F.when(stated, F.col("criterion_id"))).alias("_seen"),
        F.max(expected).alias("_expected"),
        F.min("label").alias("_a"),
        F.max("label").alias("_b"),
        (F.count(F.when(stated, F.col("probabilities"))) == F.count("label")).alias("_maps"),
        *[
            F.avg(F.when(stated, F.coalesce(F.try_element_at("probabilities", F.lit(c)), F.lit(0.0)))).alias(f"_p_{c}")
            for c in SINGLE_LABELS + PAIRWISE_LABELS
        ],
    )
    single = F.col("mode") == "single"
    label = F.when(single, F.when((F.col("_a") == "pass") & (F.col("_b") == "pass"), "pass").otherwise("fail")).otherwise(
        F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise("TIE")
    )
    classes = legal_labels(F.col("mode"))
    means = F.when(single, F.array(*[F.col(f"_p_{c}") for c in SINGLE_LABELS])).otherwise(
        F.array(*[F.col(f"_p_{c}") for c in PAIRWISE_LABELS])
    )
    total = F.aggregate(means, F.lit(0.0), lambda acc, v: acc + v)
    scaled = F.map_from_arrays(classes, F.transform(means, lambda v: v / total))
    whole = F.col("_seen") >= F.col("_expected")
    return rows.select(
        "record_id",
        "mode",
        F.when(whole, label).alias("label"),
        F.when(whole & F.col("_maps") & (total > 0), scaled).alias("probabilities"),
        F.when(whole, "ok").otherwise("parse_error").alias("execution_status"),
    )


def normalize_choice(selected: Column, p: Column, labels: Column, tolerance: float = 1e-3) -> Column:
    """FN21: status, label, error and legal probabilities of a native choice output.

    Checks run in a fixed order, so each row reports the first problem it has.
    """
    p = F.coalesce(p, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    values = F.map_values(p)
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)
    legal = class_vector(p, labels)
    mass = F.aggregate(legal, F.lit(0.0), lambda acc, v: acc + v)
    problem = (
        F.when(F.exists(values, lambda v: ~finite(v)), "invalid_probability_value")
        .when((F.size(values) == 0) | (total <= 0), "empty_or_zero_probability_mass")
        .when(F.exists(values, lambda v: (v < 0) | (v > 1)), "probability_out_of_range")
        .when(F.abs(total - 1) > tolerance, "probability_mass_does_not_sum_to_one")
        .when(mass <= 0, "no_probability_mass_for_legal_labels")
    )
    scaled = F.transform(legal, lambda v: v / mass)
    top = F.element_at(labels, F.nullif(F.array_position(scaled, F.array_max(scaled)), F.lit(0)).cast("int"))
    chosen = F.coalesce(selected, F.lit(""))
    abstained = chosen.isin(*ABSTENTIONS)
    error = (
        F.when(chosen == "", "selected_label_missing")
        .when(abstained, problem)
        .when(~F.array_contains(labels, chosen), "selected_label_outside_declared_choices")
        .when(problem.isNotNull(), problem)
        .when(chosen != top, "selected_label_disagrees_with_probability_argmax")
    )
    good = error.isNull() & ~abstained
    semantics = F.when(
        F.size(values) > F.size(labels), "conditional on a non-abstain option"
    ).otherwise("native over declared options")
    return F.struct(
        F.when(good, "ok").when(abstained, "skipped").otherwise("parse_error").alias("execution_status"),
        F.when(good, chosen).alias("label"),
        F.when(abstained, "abstention").otherwise(error).alias("error_kind"),
        error.alias("error"),
        F.when(good, F.map_from_arrays(labels, scaled)).alias("probabilities"),
        F.when(good, semantics).alias("probability_semantics"),
    )


def labelled(values: Column, labels: Column) -> Column:
    """List output matched to labels by position; null when the counts differ."""
    return F.when(F.size(values) == F.size(labels), F.map_from_arrays(labels, values))


def normalize_choice_list(selected: Column, values: Column, labels: Column) -> Column:
    """FN21 for list input: a length mismatch is its own error."""
    out = normalize_choice(selected, labelled(values, labels), labels)
    wrong = values.isNotNull() & (F.size(values) != F.size(labels)) & F.array_contains(labels, selected)
    return (
        out.withField("error", F.when(wrong, "probability_count_mismatch").otherwise(out["error"]))
        .withField("error_kind", F.when(wrong, "probability_count_mismatch").otherwise(out["error_kind"]))
    )
