"""Aggregations over scored predictions. Undefined values are null, never zero."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.stats import wilson
from assay.functions.text import refuse
from assay.operators.running import running_totals
from assay.vocab import PROBABILITY_FLOOR, lit_array


def ratio(top: Column, bottom: Column) -> Column:
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def attach(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Join per-group values back; without groups ``right`` is one row of scalars."""
    if by:
        return left.join(right, list(by), how)
    return left.withColumns({c: right.select(c).scalar() for c in right.columns})


# --- label metrics -----------------------------------------------------------


def accuracy(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """AGG1: share of resolved rows whose label equals gold."""
    return df.groupBy(*by).agg(F.avg((F.col("gold") == F.col("label")).cast("double")).alias("accuracy"))


def confusion(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Counts per (gold, label); every label metric is derived from this small table."""
    return df.groupBy(*by, "gold", "label").agg(F.count("*").alias("n"))


def class_counts(cells: DataFrame, by: Sequence[str], classes: Sequence[str] | None = None) -> DataFrame:
    """Support, predicted and true positives per class, from a confusion table."""
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("gold") == F.col("label"), F.col("n")).otherwise(zero)
    parts = [
        F.struct(F.col("gold").alias("class"), F.col("n").alias("s"), zero.alias("p"), hit.alias("t")),
        F.struct(F.col("label").alias("class"), zero.alias("s"), F.col("n").alias("p"), zero.alias("t")),
    ]
    if classes is not None:
        parts += [
            F.struct(F.lit(c).alias("class"), zero.alias("s"), zero.alias("p"), zero.alias("t")) for c in classes
        ]
    out = cells.select(*by, F.inline(F.array(*parts))).groupBy(*by, "class").agg(
        F.sum("s").alias("support"), F.sum("p").alias("predicted"), F.sum("t").alias("true_positive")
    )
    return out if classes is None else out.filter(F.col("class").isin(*classes))


def _f1() -> Column:
    bottom = F.col("support") + F.col("predicted")
    return F.when(bottom > 0, 2 * F.col("true_positive") / bottom).otherwise(0.0)


def label_metrics(df: DataFrame, by: Sequence[str], classes: Sequence[str] | None = None) -> DataFrame:
    """Accuracy, balanced accuracy and macro F1 from one confusion pass."""
    counts = class_counts(confusion(df, by), by, classes)
    return counts.groupBy(*by).agg(
        F.sum("support").alias("count"),
        ratio(F.sum("true_positive"), F.sum("support")).alias("accuracy"),
        F.avg(ratio(F.col("true_positive"), F.col("support"))).alias("balanced_accuracy"),
        F.avg(_f1()).alias("macro_f1"),
    )


def balanced_accuracy(df: DataFrame, by: Sequence[str], classes: Sequence[str] | None = None) -> DataFrame:
    """AGG2: mean recall over classes with gold support."""
    return label_metrics(df, by, classes).select(*by, "balanced_accuracy")


def macro_f1(df: DataFrame, by: Sequence[str], classes: Sequence[str] | None = None) -> DataFrame:
    """AGG3: mean F1 over the class list (default: classes seen in gold or label)."""
    return label_metrics(df, by, classes).select(*by, "macro_f1")


def per_class(df: DataFrame, by: Sequence[str], labels: Sequence[str] | None = None) -> DataFrame:
    """AGG8: support, predicted, true positives, precision, recall and F1 per class."""
    counts = class_counts(confusion(df, by), by, labels)
    precision = ratio(F.col("true_positive"), F.col("predicted"))
    recall = ratio(F.col("true_positive"), F.col("support"))
    f1 = (
        F.when((precision > 0) & (recall > 0), 2 * precision * recall / (precision + recall))
        .when(precision.isNotNull() | recall.isNotNull(), 0.0)
    )
    return counts.withColumns({"precision": precision, "recall": recall, "f1": f1})


# --- probability metrics -----------------------------------------------------


def class_vector(probabilities: Column, classes: Column) -> Column:
    """Probabilities in class order; a class missing from the map counts as zero."""
    return F.transform(classes, lambda c: F.coalesce(F.try_element_at(probabilities, c), F.lit(0.0)))


def with_probability_scores(df: DataFrame, classes: Column) -> DataFrame:
    """Per-row Brier term, log loss, confidence and arg-max class (nulls without a map)."""
    p = F.col("probabilities")
    vector = F.when(p.isNotNull(), class_vector(p, classes))
    out = df.withColumn("_classes", classes).withColumn("_vector", vector)
    brier = F.aggregate(
        F.zip_with("_vector", "_classes", lambda v, c: F.pow(v - (c == F.col("gold")).cast("double"), F.lit(2.0))),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )
    at_gold = F.coalesce(F.try_element_at(p, F.col("gold")), F.lit(0.0))
    conf = F.array_max("_vector")
    known = F.array_contains("_classes", F.col("gold"))
    out = refuse(out, p.isNotNull() & ~known, "gold label outside the class order")
    nll = F.when(p.isNotNull(), -F.log(F.greatest(F.lit(PROBABILITY_FLOOR), at_gold)))
    return out.withColumns(
        {
            "brier_term": F.when(p.isNotNull(), brier),
            "nll_term": nll,
            "confidence": conf,
            "top_class": F.element_at("_classes", F.nullif(F.array_position("_vector", conf), F.lit(0)).cast("int")),
        }
    ).drop("_classes", "_vector")


def _all_or_drop(value: Column, missing: str) -> Column:
    if missing == "drop":
        return value
    if missing != "null":
        raise ValueError("missing must be 'null' or 'drop'")
    return F.when(F.count("probabilities") == F.count("*"), value)


def brier(df: DataFrame, by: Sequence[str], classes: Column, missing: str = "null") -> DataFrame:
    """AGG4: multiclass Brier score; one row without a map makes the slice null."""
    rows = with_probability_scores(df, classes)
    return rows.groupBy(*by).agg(_all_or_drop(F.avg("brier_term"), missing).alias("brier"))


def nll(df: DataFrame, by: Sequence[str], classes: Column, missing: str = "null") -> DataFrame:
    """AGG5: mean negative log likelihood of the gold class."""
    rows = with_probability_scores(df, classes)
    return rows.groupBy(*by).agg(_all_or_drop(F.avg("nll_term"), missing).alias("nll"))


def bin_index(value: Column, bins: int) -> Column:
    """Equal-width bin [i/n, (i+1)/n), last one closed, against the literal edges."""
    edges = lit_array([i / bins for i in range(1, bins)])
    return F.when(value.isNotNull(), F.size(F.filter(edges, lambda e: value >= e)))


def ece(df: DataFrame, by: Sequence[str], classes: Column, bins: int = 10, missing: str = "null") -> DataFrame:
    """AGG6: expected calibration error of the arg-max class."""
    return probability_metrics(df, by, classes, bins, missing).select(*by, "ece")


def probability_metrics(
    df: DataFrame, by: Sequence[str], classes: Column, bins: int = 10, missing: str = "null"
) -> DataFrame:
    """Brier, NLL and ECE in one pass: per-bin partial sums, then per-slice totals."""
    rows = with_probability_scores(df, classes).withColumn("_bin", bin_index(F.col("confidence"), bins))
    parts = rows.groupBy(*by, "_bin").agg(
        F.count("*").alias("_rows"),
        F.count("probabilities").alias("_maps"),
        F.sum("brier_term").alias("_brier"),
        F.sum("nll_term").alias("_nll"),
        F.sum((F.col("top_class") == F.col("gold")).cast("double")).alias("_hits"),
        F.sum("confidence").alias("_conf"),
    )
    usable = F.sum("_maps")
    gap = F.abs(ratio(F.col("_hits"), F.col("_maps")) - ratio(F.col("_conf"), F.col("_maps")))

    def guarded(value: Column) -> Column:
        return value if missing == "drop" else F.when(usable == F.sum("_rows"), value)

    return parts.groupBy(*by).agg(
        guarded(ratio(F.sum("_brier"), usable)).alias("brier"),
        guarded(ratio(F.sum("_nll"), usable)).alias("nll"),
        guarded(ratio(F.sum(F.col("_maps") * gap), usable)).alias("ece"),
        (usable == F.sum("_rows")).alias("probability_metrics_available"),
    )


def classification_report(
    df: DataFrame,
    by: Sequence[str],
    classes: Column,
    labels: Sequence[str] | None = None,
    bins: int = 10,
    missing: str = "null",
) -> DataFrame:
    """AGG7: label and probability metrics side by side for every slice in ``by``."""
    left = label_metrics(df, by, labels)
    right = probability_metrics(df, by, classes, bins, missing)
    return attach(left, right, by)


def reliability(df: DataFrame, by: Sequence[str], classes: Column, bins: int = 10) -> DataFrame:
    """AGG9: per-bin count, mean confidence and label accuracy; empty bins are kept."""
    rows = with_probability_scores(df, classes).filter(F.col("confidence").isNotNull())
    rows = rows.withColumn("bin", bin_index(F.col("confidence"), bins))
    parts = rows.groupBy(*by, "bin").agg(
        F.count("*").alias("n"),
        F.sum("confidence").alias("c"),
        F.sum((F.col("label") == F.col("gold")).cast("double")).alias("h"),
    )
    filled = _all_bins(parts, by, bins).groupBy(*by, "bin").agg(
        F.sum("n").alias("count"),
        ratio(F.sum("c"), F.sum("n")).alias("mean_confidence"),
        ratio(F.sum("h"), F.sum("n")).alias("accuracy"),
    )
    return filled.withColumns(
        {"bin_lower": F.col("bin") / F.lit(float(bins)), "bin_upper": (F.col("bin") + 1) / F.lit(float(bins))}
    )


def _all_bins(parts: DataFrame, by: Sequence[str], bins: int) -> DataFrame:
    """Add a zero row per bin to every part row; the final sums fold them away again."""
    measures = [c for c in parts.columns if c not in (*by, "bin")]
    own = F.struct(F.col("bin").cast("int").alias("bin"), *[F.col(m) for m in measures])
    zeros = F.transform(
        F.sequence(F.lit(0), F.lit(bins - 1)),
        lambda i: F.struct(i.alias("bin"), *[F.lit(0).cast(parts.schema[m].dataType).alias(m) for m in measures]),
    )
    return parts.select(*by, F.inline(F.concat(F.array(own), zeros)))


def histogram(df: DataFrame, by: Sequence[str], value: Column, bins: int = 10) -> DataFrame:
    """AGG10: counts per min(int(v*n), n-1) bin with every bin present."""
    rows = df.withColumn("_value", value).filter(F.col("_value").isNotNull())
    spot = F.least(F.floor(F.col("_value") * bins), F.lit(bins - 1)).cast("int")
    parts = rows.groupBy(*by, spot.alias("bin")).agg(F.count("*").alias("n"))
    return _all_bins(parts, by, bins).groupBy(*by, "bin").agg(F.sum("n").alias("count"))


# --- states, coverage, latency, cost ----------------------------------------


def unresolved_reason() -> Column:
    """Why a row is not scored; ``ok`` when it is. ``error_kind`` may come from a plain string."""
    status, kind = F.col("execution_status"), F.col("error_kind")
    return (
        F.when((status == "ok") & F.col("label").isNotNull(), "ok")
        .when((status == "skipped") & (kind == "abstention"), "abstention")
        .when((status == "skipped") & (kind == "context_limit"), "context_limit_skip")
        .when((status == "provider_error") & (kind == "timeout"), "provider_timeout")
        .otherwise(status)
    )


def status_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """AGG11: rows per status or unresolved reason."""
    return df.groupBy(*by, unresolved_reason().alias("reason")).agg(F.count("*").alias("count"))


def judge_summary(scored: DataFrame, by: Sequence[str], empty: str = "null") -> DataFrame:
    """AGG12: coverage, conditional and all-record accuracy with Wilson intervals."""
    base = scored.groupBy(*by).agg(
        F.count("*").alias("records"),
        F.sum("resolved").alias("resolved"),
        F.sum("correct").alias("correct"),
    )
    out = base.withColumns(
        {
            "coverage": ratio(F.col("resolved"), F.col("records")),
            "conditional_accuracy": ratio(F.col("correct"), F.col("resolved")),
            "all_record_accuracy": ratio(F.col("correct"), F.col("records")),
            "_cov": wilson(F.col("resolved"), F.col("records"), empty),
            "_cond": wilson(F.col("correct"), F.col("resolved"), empty),
            "_all": wilson(F.col("correct"), F.col("records"), empty),
        }
    )
    for name, tag in (("coverage", "_cov"), ("conditional", "_cond"), ("all_record", "_all")):
        out = out.withColumn(f"{name}_low", F.col(tag)["lower"]).withColumn(f"{name}_high", F.col(tag)["upper"])
    return out.drop("_cov", "_cond", "_all")


def quantiles(
    df: DataFrame, by: Sequence[str], value: Column, fractions: Mapping[str, float], method: str = "linear"
) -> DataFrame:
    """Exact quantiles of a group of any size.

    Equal values are counted first and the distinct values are ranked with
    distributed running totals, so no task holds a whole group. ``method`` is
    ``linear``, ``nearest`` (index round-half-even((n-1)f)) or ``floor``
    (index min(n-1, floor(nf))).
    """
    counted = df.select(*by, value.cast("double").alias("_x")).filter(F.col("_x").isNotNull())
    counted = counted.groupBy(*by, "_x").agg(F.count("*").alias("_n"))
    ranked = running_totals(counted, by, [F.col("_x").asc()], {"_hi": F.col("_n")})
    size = ranked.groupBy(*by).agg(F.sum("_n").alias("_size"))
    rows = attach(ranked, size, by)

    def at(index: Column) -> Column:
        inside = (F.col("_hi") - F.col("_n") <= index) & (index < F.col("_hi"))
        return F.max(F.when(inside, F.col("_x")))

    last = F.col("_size") - 1
    aggregates = []
    for name, f in fractions.items():
        if method == "linear":
            spot = last * F.lit(f)
            low = F.floor(spot)
            aggregates += [
                at(low).alias(f"_lo_{name}"),
                at(F.least(low + 1, last)).alias(f"_up_{name}"),
                F.max(spot - low).alias(f"_w_{name}"),
            ]
        elif method == "nearest":
            aggregates.append(at(F.rint(last * F.lit(f)).cast("bigint")).alias(name))
        elif method == "floor":
            aggregates.append(at(F.least(last, F.floor(F.col("_size") * F.lit(f)))).alias(name))
        else:
            raise ValueError(f"unknown quantile method {method!r}")
    out = rows.groupBy(*by).agg(*aggregates)
    if method == "linear":
        out = out.select(
            *by,
            *[
                (F.col(f"_lo_{n}") + (F.col(f"_up_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
                for n in fractions
            ],
        )
    return out


def latency_summary(df: DataFrame, by: Sequence[str], method: str = "linear") -> DataFrame:
    """AGG13: count, mean, min, max, median and p95; a negative latency fails the job."""
    df = refuse(df, F.col("latency_ms") < 0, "latencies must be non-negative")
    ms = F.col("latency_ms")
    plain = df.groupBy(*by).agg(
        F.count(ms).alias("count"), F.avg(ms).alias("mean_ms"), F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms")
    )
    ranks = quantiles(df, by, F.col("latency_ms"), {"median_ms": 0.5, "p95_ms": 0.95}, method)
    return attach(plain, ranks, by, "left")


def count_by(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG14: plain count table."""
    return df.groupBy(*cols).agg(F.count("*").alias("count"))


def acceptance_rate(df: DataFrame, by: Sequence[str], accepted: Column) -> DataFrame:
    """AGG14: accepted over requested."""
    return df.groupBy(*by).agg(
        F.count("*").alias("requests"),
        F.count_if(accepted).alias("accepted"),
        ratio(F.count_if(accepted), F.count("*")).alias("acceptance_rate"),
    )


def resource_usage(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """AGG15: tokens and cost over rows that report usage; null if none does."""
    usage = F.col("usage")
    reported = F.count(usage)

    def total(field: str) -> Column:
        value = F.sum(F.when(usage.isNotNull(), F.coalesce(usage[field].cast("double"), F.lit(0.0))))
        return F.when(reported > 0, value)

    one_model = F.min("judge_id") == F.max("judge_id")
    return df.groupBy(*by).agg(
        F.when(one_model, F.min("judge_id")).alias("model"),
        F.count("*").alias("calls"),
        reported.alias("usage_available_calls"),
        total("input_tokens").alias("input_tokens"),
        total("output_tokens").alias("output_tokens"),
        total("cost").alias("cost"),
        (1000 * ratio(total("cost"), F.count("*"))).alias("cost_per_1000"),
    )


# --- agreement, selection and stability -------------------------------------


def agreement(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG16: same label over comparable rows, from the judge-pair contingency table."""
    both = (F.col("left_outcome.resolved") == 1) & (F.col("right_outcome.resolved") == 1)
    same = both & (F.col("left_outcome.label") == F.col("right_outcome.label"))
    out = pairs.groupBy(*by, "left", "right").agg(
        F.sum(F.when(both, F.col("n")).otherwise(0)).alias("comparable"),
        F.sum(F.when(same, F.col("n")).otherwise(0)).alias("agreeing"),
    )
    return out.withColumn("agreement_rate", ratio(F.col("agreeing"), F.col("comparable")))


def mode_balanced_score(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """AGG17: mean of single and pairwise conditional accuracy; null if either is null."""

    def acc(mode: str) -> Column:
        return F.avg(F.when((F.col("mode") == mode) & (F.col("resolved") == 1), F.col("correct").cast("double")))

    return scored.groupBy(*by).agg(
        F.sum("resolved").alias("resolved"),
        ratio(F.sum("resolved"), F.count("*")).alias("coverage"),
        acc("single").alias("single_accuracy"),
        acc("pairwise").alias("pairwise_accuracy"),
        ((acc("single") + acc("pairwise")) / 2).alias("selection_score"),
    )


def select_protocol(
    summary: DataFrame,
    baseline: str,
    variant: str = "variant",
    min_resolved: int = 64,
    min_coverage: float = 0.95,
    min_gain: float = 0.10,
) -> DataFrame:
    """AGG17: best variant that passes the gate, else the baseline. One row."""
    name, score = F.col(variant), F.col("selection_score")
    base = summary.agg(F.max(F.when(name == baseline, score)).alias("b")).scalar()
    passed = (F.col("resolved") >= min_resolved) & (F.col("coverage") >= min_coverage) & (score >= base + min_gain)
    best = F.max(F.when(passed, F.struct(score.alias("s"), F.col("coverage").alias("c"), name.alias("v"))))
    base_row = F.max(F.when(name == baseline, F.struct(score.alias("s"), name.alias("v"))))
    return summary.agg(
        F.count_if(name == baseline).alias("_found"), best.alias("_best"), base_row.alias("_base")
    ).select(
        F.when(F.col("_found") == 0, F.raise_error("baseline variant is missing").cast("string"))
        .otherwise(F.lit(baseline))
        .alias("baseline_variant"),
        F.col("_base.s").alias("baseline_score"),
        F.coalesce("_best.v", "_base.v").alias("selected_variant"),
        F.coalesce("_best.s", "_base.s").alias("selected_score"),
        F.col("_best").isNotNull().alias("gate_passed"),
    )


def repeatability(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG18: share of records whose ok repeats all carry one label."""
    per_record = (
        rows.filter(F.col("execution_status") == "ok")
        .groupBy(*by, "record_id")
        .agg((F.min("label") == F.max("label")).cast("double").alias("_stable"))
    )
    return per_record.groupBy(*by).agg(
        F.count("*").alias("records"), F.avg("_stable").alias("repeatability_rate")
    )


def perturbation_agreement(rows: DataFrame, primary: DataFrame, by: Sequence[str] = ("kind",)) -> DataFrame:
    """AGG19: share of perturbed labels equal to the primary label of the record."""
    ok = rows.filter((F.col("execution_status") == "ok") & F.col("label").isNotNull())
    base = primary.select("record_id", F.col("label").alias("_primary"))
    return ok.join(base, "record_id").groupBy(*by).agg(
        F.count("*").alias("comparable"),
        F.avg((F.col("label") == F.col("_primary")).cast("double")).alias("agreement_rate"),
    )


def invert_label(label: Column) -> Column:
    return F.when(label == "A", "B").when(label == "B", "A").otherwise(label)


def swap_consistency(original: DataFrame, swapped: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AGG20: share of swapped-order labels equal to the inverted original label."""
    keys = [*by, "source_record_id"]
    left = original.select(*by, F.col("record_id").alias("source_record_id"), F.col("label").alias("_original"))
    joined = swapped.select(*keys, "label").join(left, keys)
    return joined.groupBy(*by).agg(
        F.count("*").alias("pairs"),
        F.avg((F.col("label") == invert_label(F.col("_original"))).cast("double")).alias("swap_consistency"),
    )


def majority_baseline(df: DataFrame, by: Sequence[str], label: str = "gold") -> DataFrame:
    """AGG21: most frequent label (first in the alphabet on a tie) and the score of always saying it."""
    counts = df.groupBy(*by, F.col(label).alias("_l")).agg(F.count("*").alias("_n"))
    best = counts.groupBy(*by).agg(
        F.sum("_n").alias("count"),
        F.count("*").alias("classes"),
        F.max("_n").alias("_top"),
        F.min(F.struct((-F.col("_n")).alias("k"), F.col("_l").alias("l")))["l"].alias("label"),
    )
    ties = attach(counts, best, by).filter(F.col("_n") == F.col("_top")).groupBy(*by).agg(
        (F.count("*") > 1).alias("tie")
    )
    accuracy_ = ratio(F.col("_top"), F.col("count"))
    return attach(best, ties, by).withColumns(
        {
            "accuracy": accuracy_,
            "balanced_accuracy": 1 / F.col("classes").cast("double"),
            "macro_f1": 2 * accuracy_ / (1 + accuracy_) / F.col("classes"),
        }
    ).drop("_top")


def micro_macro(family_counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """AGG22: pooled accuracy and the mean of family accuracies (null if one is null)."""
    acc = ratio(F.col("correct"), F.col("resolved"))
    return family_counts.groupBy(*by).agg(
        ratio(F.sum("correct"), F.sum("resolved")).alias("micro_accuracy"),
        F.when(F.count(acc) == F.count("*"), F.avg(acc)).alias("macro_accuracy"),
        F.count("*").alias("families"),
    )


def top_vocabulary(df: DataFrame, value: Column, n: int, other: str = "OTHER") -> DataFrame:
    """AGG23: the ``n`` most frequent trimmed upper-case values, then ``other``."""
    counts = (
        df.select(F.upper(F.trim(value)).alias("value"))
        .filter(F.col("value") != "")
        .groupBy("value")
        .agg(F.count("*").alias("count"))
    )
    top = counts.orderBy(F.desc("count"), F.asc("value")).limit(n)
    short = F.count("*") < n
    tail = top.agg(
        F.when(short, F.raise_error("fewer values than the requested vocabulary").cast("string"))
        .otherwise(F.lit(other))
        .alias("value"),
        F.lit(None).cast("bigint").alias("count"),
    )
    return top.unionByName(tail)


def census(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AGG24: full-table counts of every controlled field in one scan."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in cols],
        F.struct(F.lit("rows_scanned").alias("field"), F.lit("*").alias("value")),
    )
    return df.select(F.inline(cells)).groupBy("field", "value").agg(F.count("*").alias("count"))


def disagreement(preds: DataFrame, local: DataFrame) -> DataFrame:
    """AGG25: number of distinct ok labels that differ from the local label, per record."""
    base = local.select("record_id", F.col("label").alias("_local"))
    differs = F.when(
        (F.col("execution_status") == "ok") & ~F.col("label").eqNullSafe(F.col("_local")), F.col("label")
    )
    return base.join(preds, "record_id", "left").groupBy("record_id").agg(
        F.count_distinct(differs).alias("disagreement")
    )


def label_validity(df: DataFrame, by: Sequence[str], labels: Column) -> DataFrame:
    """AGG26: share of predicted labels inside the legal set, and rows with probabilities."""
    return df.groupBy(*by).agg(
        F.avg(F.array_contains(labels, F.col("label")).cast("double")).alias("valid_label_rate"),
        F.count("probabilities").alias("native_probability_count"),
    )
