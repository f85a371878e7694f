"""Data-quality rules. Each returns violations ``(rule, key, detail)``; ``enforce`` fails on any."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.text import strip
from assay.vocab import PAIRWISE_LABELS, PROVENANCES, SPLITS, STATUSES, lit_array


class RuleViolation(ValueError):
    """Raised by ``enforce`` with a few example rows."""


def enforce(violations: DataFrame) -> None:
    examples = violations.take(5)
    if examples:
        raise RuleViolation("; ".join(f"{r['rule']}[{r['key']}]: {r['detail']}" for r in examples))


def _row_rules(df: DataFrame, key: Column, rules: Mapping[str, tuple[Column, str]]) -> DataFrame:
    """Violations of per-row conditions in one pass, without a shuffle."""
    found = F.array_compact(
        F.array(
            *[
                F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(text).alias("detail")))
                for rule, (bad, text) in rules.items()
            ]
        )
    )
    return df.select(key.cast("string").alias("key"), F.inline(found)).select("rule", "key", "detail")


def blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def normalize_aliases(df: DataFrame, aliases: Mapping[str, Sequence[str]]) -> DataFrame:
    """VAL1: a present target column wins, else its first present alias; aliases are dropped."""
    out = df
    for target, names in aliases.items():
        present = [n for n in names if n in df.columns]
        if target not in df.columns and present:
            out = out.withColumn(target, F.col(present[0]))
        out = out.drop(*present)
    return out


def check_records(df: DataFrame) -> DataFrame:
    """VAL2: shape of a judge record by mode."""
    mode, label, b = F.col("mode"), F.col("gold"), F.col("candidate_b")
    pair = mode == "pairwise"

    def missing(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c) == "")

    return _row_rules(
        df,
        F.col("record_id"),
        {
            "record_id": (missing("record_id"), "record_id must not be empty"),
            "source_problem_id": (missing("source_problem_id"), "source_problem_id must not be empty"),
            "prompt": (missing("prompt"), "prompt must not be empty"),
            "candidate_a": (missing("candidate_a"), "candidate_a must not be empty"),
            "mode": (~mode.isin("single", "pairwise") | mode.isNull(), "mode must be single or pairwise"),
            "split": (~F.col("split").isin(*SPLITS) | F.col("split").isNull(), "unknown split"),
            "pairwise_b": (pair & (b.isNull() | (b == "")), "pairwise records require candidate_b"),
            "single_b": ((mode == "single") & b.isNotNull(), "single records must not include candidate_b"),
            "pairwise_label": (pair & ~label.isin(*PAIRWISE_LABELS), "pairwise gold label must be A, B, or TIE"),
            "gold": (label.isNull() | (label == ""), "gold label must not be empty"),
            **(
                {"rubric": (F.col("rubric").isNull() | (F.size("rubric") < 1), "rubric must not be empty")}
                if "rubric" in df.columns
                else {}
            ),
        },
    )


def probability_problems(p: Column, classes: Column | None = None, tolerance: float = 1e-6) -> dict[str, tuple[Column, str]]:
    values = F.map_values(p) if classes is None else F.transform(classes, lambda c: F.coalesce(F.try_element_at(p, c), F.lit(0.0)))
    out_of_range = F.exists(values, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1))
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return {
        "probability_empty": (p.isNotNull() & (F.size(p) == 0), "probabilities must be a non-empty mapping"),
        "probability_range": (p.isNotNull() & out_of_range, "probabilities must be finite values in [0, 1]"),
        "probability_sum": (p.isNotNull() & ~out_of_range & (F.abs(total - 1) > tolerance), "probabilities must sum to 1"),
    }


def check_probabilities(df: DataFrame, classes: Column | None = None, column: str = "probabilities") -> DataFrame:
    """VAL3: a map is non-empty, in range and sums to one; null maps are allowed."""
    return _row_rules(df, F.col("record_id"), probability_problems(F.col(column), classes))


def check_predictions(df: DataFrame) -> DataFrame:
    """VAL4: execution state of a prediction."""
    status = F.col("execution_status")
    return _row_rules(
        df,
        F.concat_ws("|", "judge_id", "record_id"),
        {
            "status": (~status.isin(*STATUSES) | status.isNull(), "unknown execution status"),
            "ok_label": ((status == "ok") & F.col("label").isNull(), "successful predictions require a label"),
            "latency": (F.col("latency_ms") < 0, "latency must be non-negative"),
        },
    )


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """VAL5: duplicate keys."""
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("_n"))
        .filter("_n > 1")
        .select(
            F.lit("unique").alias("rule"),
            F.concat_ws("|", *keys).alias("key"),
            F.concat(F.col("_n").cast("string"), F.lit(" rows share the key")).alias("detail"),
        )
    )


def check_coverage(records: DataFrame, preds: DataFrame, key: str = "record_id") -> DataFrame:
    """VAL6: IDs missing from, or extra to, the record set."""
    left, right = records.select(key).distinct(), preds.select(key).distinct()

    def named(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit("coverage").alias("rule"), F.col(key).cast("string").alias("key"), F.lit(kind).alias("detail"))

    return named(left.join(right, key, "left_anti"), "missing").unionByName(
        named(right.join(left, key, "left_anti"), "extra")
    )


def check_isolation(df: DataFrame, family: str, split: str) -> DataFrame:
    """VAL7: a source family seen in more than one split.

    Min and max of the split combine on the map side, so a hot family stays cheap.
    """
    return (
        df.groupBy(family)
        .agg(F.min(split).alias("_a"), F.max(split).alias("_b"))
        .filter(F.col("_a") != F.col("_b"))
        .select(
            F.lit("isolation").alias("rule"),
            F.col(family).cast("string").alias("key"),
            F.concat(F.lit("family spans "), F.col("_a"), F.lit(" and "), F.col("_b")).alias("detail"),
        )
    )


def check_leaks(df: DataFrame, key: str, prompt: str, candidate: str, gold: str, marker: Column) -> DataFrame:
    """VAL8: the masked field shows up as a prompt line, or the gold label inside the candidate text."""
    return _row_rules(
        df,
        F.col(key),
        {
            "prompt_leak": (
                F.exists(F.split(F.col(prompt), "\n"), lambda line: F.startswith(line, marker)),
                "masked field appears as a prompt line",
            ),
            "candidate_leak": (F.contains(F.col(candidate), F.col(gold)), "gold label appears in the candidate"),
        },
    )


def check_vocabulary(df: DataFrame, column: str, labels: Sequence[str]) -> DataFrame:
    """VAL9: non-empty values outside the declared label set, once per value."""
    value = F.col(column)
    return (
        df.filter(value.isNotNull() & (value != "") & ~F.array_contains(lit_array(labels), value))
        .groupBy(value.alias("_v"))
        .agg(F.count("*").alias("_n"))
        .select(
            F.lit("vocabulary").alias("rule"),
            F.col("_v").alias("key"),
            F.concat(F.col("_n").cast("string"), F.lit(" rows outside the label set")).alias("detail"),
        )
    )


def trusted_records(df: DataFrame, allowed: Sequence[str] = ("answer_key", "deterministic_verifier")) -> DataFrame:
    """VAL10: keep rows whose gold provenance is trusted."""
    return df.filter(F.col("provenance").isin(*allowed))


def check_provenance(df: DataFrame, banned: Sequence[str], key: str = "record_id") -> DataFrame:
    """VAL10: a banned marker anywhere in the serialised row, whatever its case."""
    text = F.lower(F.to_json(F.struct(*df.columns)))
    return _row_rules(
        df,
        F.col(key),
        {f"banned:{m}": (F.contains(text, F.lit(m.lower())), f"row mentions {m}") for m in banned}
        | {"provenance": (~F.col("provenance").isin(*PROVENANCES), "unknown provenance")},
    )


def check_task_rows(df: DataFrame, slots: Sequence[str] = (), labels: Sequence[str] = ("Yes", "No")) -> DataFrame:
    """VAL11: index, label and text contract of tabular task rows."""
    index = F.col("index").cast("string")
    number = F.expr("try_cast(`index` AS BIGINT)")
    rules = {
        "index": (number.isNull() | (number < 0), "index must be a non-negative integer"),
        "answer": (~strip(F.col("answer")).isin(*labels) | F.col("answer").isNull(), "unsupported answer label"),
        "text": (blank(F.col("text")), "text must be non-empty"),
    }
    for slot in slots:
        if slot != "text":
            rules[f"slot:{slot}"] = (blank(F.col(slot)), f"{slot} must be non-empty")
    return _row_rules(df, index, rules).unionByName(check_unique(df.select(number.alias("index")).dropna(), ["index"]))


CODE_FIELDS = ("task_id", "prompt", "entry_point", "canonical_solution", "test")


def check_code_rows(df: DataFrame) -> DataFrame:
    """VAL12: required code-task fields are non-blank and task_id is unique after trimming."""
    rules = {f: (blank(F.col(f)), f"{f} must be a non-empty string") for f in CODE_FIELDS}
    return _row_rules(df, F.col("task_id"), rules).unionByName(
        check_unique(df.select(strip(F.col("task_id")).alias("task_id")), ["task_id"])
    )


def normalize_code_rows(df: DataFrame) -> DataFrame:
    """VAL12: trimmed identifiers, one row per task, ordered by task_id."""
    return df.select(
        strip(F.col("task_id")).alias("task_id"),
        "prompt",
        strip(F.col("entry_point")).alias("entry_point"),
        "canonical_solution",
        "test",
    ).orderBy("task_id")


def check_retry(base: DataFrame, retry: DataFrame, policy: str, keys: Sequence[str] = ("judge_id", "record_id")) -> DataFrame:
    """VAL13: what a retry may replace.

    ``keep_ok``: never an ok row. ``parse_errors_only``: only parse_error rows,
    and no parse_error may be left over.
    """
    b = base.select(*keys, F.col("execution_status").alias("_base"))
    r = retry.select(*keys, F.col("execution_status").alias("_retry"))
    both = b.join(r, list(keys), "full_outer")
    name = F.concat_ws("|", *keys)
    replaced, known = F.col("_retry").isNotNull(), F.col("_base").isNotNull()
    if policy == "keep_ok":
        rules = {"retry_over_ok": (replaced & (F.col("_base") == "ok"), "a retry may not overwrite an ok row")}
    elif policy == "parse_errors_only":
        left = F.coalesce("_retry", "_base")
        rules = {
            "retry_target": (replaced & known & (F.col("_base") != "parse_error"), "only parse_error rows may be retried"),
            "unresolved": (left == "parse_error", "a parse_error remains after the retry"),
        }
    else:
        raise ValueError(f"unknown retry policy {policy!r}")
    rules["retry_unknown"] = (replaced & ~known, "retry row has no base row")
    return _row_rules(both, name, rules)


def check_training(rows: DataFrame, test: DataFrame, family: str = "source_problem_id") -> DataFrame:
    """VAL14: test splits, shared families and repeated row ids in training data."""
    direct = _row_rules(
        rows, F.col("row_id"), {"test_split": (F.col("source_split") == "test", "a test row entered training")}
    )
    shared = rows.join(test.select(family).distinct(), family, "left_semi").select(
        F.lit("shared_family").alias("rule"), F.col("row_id").alias("key"), F.lit("source family is in the test set").alias("detail")
    )
    return reduce(lambda a, b: a.unionByName(b), [direct, shared, check_unique(rows, ["row_id"])])


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """SET2: keys in both sides, only left and only right, each once."""
    left = a.select(key).distinct().withColumn("_l", F.lit(True))
    right = b.select(key).distinct().withColumn("_r", F.lit(True))
    kind = F.when(F.col("_l") & F.col("_r"), "both").when(F.col("_l"), "left_only").otherwise("right_only")
    return left.join(right, key, "full_outer").select(key, kind.alias("kind"))
