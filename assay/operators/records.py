"""Judge records built from source rows: one source row becomes one or more records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assay.functions.identity import case_key, content_id, hash_is_even, hash_mod
from assay.functions.text import let, norm_id, refuse, strip
from assay.functions.verifiers import DOMAIN_OF_VERIFIER, canonical_number, plus_one, verify
from assay.operators.metrics import invert_label
from assay.operators.rules import check_isolation, check_training, check_unique, enforce
from assay.operators.splits import entity_split, map_upstream_split, split_of
from assay.vocab import DEFAULT_SEED, PAIRWISE_LABELS, SINGLE_LABELS, lit_array


def fail_when(condition: Column, message: str, value: Column) -> Column:
    """``value``, or a failed job where the condition holds."""
    return F.when(condition, F.raise_error(message).cast("string")).otherwise(value)


def _variants(df: DataFrame, keep: Sequence[Column], variants: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """Explode one row into named variants."""
    cells = [
        F.struct(F.lit(name).alias("variant"), *[value.alias(field) for field, value in fields.items()])
        for name, fields in variants.items()
    ]
    return df.select(*keep, F.inline(F.array(*cells)))


# --- questions with choices ---------------------------------------------------


def normalize_choices(df: DataFrame, choices: str = "choices", answer: str = "answer_key") -> DataFrame:
    """GEN1: ``labels``, ``texts`` and ``answer_label`` from either choice layout.

    Choices are parallel label/text arrays or a plain list, labelled A, B, C, ...
    """
    kind = df.schema[choices].dataType.typeName()
    if kind == "struct":
        labels, texts = F.col(f"{choices}.label"), F.col(f"{choices}.text")
    else:
        texts = F.col(choices)
        labels = F.transform(F.sequence(F.lit(0), F.size(texts) - 1), lambda i: F.char(i + 65))
        labels = F.when(F.size(texts) > 0, labels).otherwise(F.array().cast("array<string>"))
    out = df.withColumns({"labels": labels, "texts": texts})
    key = F.col(answer).cast("string")
    index = F.when(F.rlike(key, F.lit("^[0-9]+$")), key.try_cast("int"))
    picked = F.when(F.array_contains("labels", key), key).otherwise(F.get(F.col("labels"), index))
    uneven = (
        (F.size("labels") < 1)
        | (F.size("labels") != F.size("texts"))
        | (F.size(F.array_distinct("labels")) != F.size("labels"))
    )
    checked = fail_when(uneven, "choices must have unique parallel labels and texts", picked)
    return out.withColumn(
        "answer_label", fail_when(picked.isNull(), "answer key does not match the choice labels", checked)
    )


def _option(label: Column, text: Column) -> Column:
    return F.concat(label, F.lit(") "), text)


def _text_of(label: Column) -> Column:
    return F.element_at("texts", F.array_position("labels", label).cast("int"))


def choice_prompt() -> Column:
    lines = F.zip_with("labels", "texts", _option)
    return F.concat(F.lit("Question: "), strip(F.col("question")), F.lit("\nChoices:\n"), F.array_join(lines, "\n"))


def _questions(df: DataFrame, seed: int, dev_fraction: float) -> DataFrame:
    blank = (strip(F.col("id")) == "") | (strip(F.col("question")) == "")
    key = fail_when(blank, "rows require a non-empty id and question", strip(F.col("id")))
    return df.withColumns(
        {
            "source_problem_id": key,
            "prompt": choice_prompt(),
            "wrong_labels": F.filter("labels", lambda x: x != F.col("answer_label")),
            "split": map_upstream_split(F.col("upstream_split"), key, seed, dev_fraction),
        }
    )


def pairwise_records(
    df: DataFrame, seed: int = DEFAULT_SEED, prefix: str = "arc-pair", dev_fraction: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """GEN2: (sources, records); the wrong choice and the candidate order come from hashes of the id.

    Input: ``id, question, labels, texts, answer_label, upstream_split``.
    """
    rows = _questions(df, seed, dev_fraction)
    key = F.col("source_problem_id")
    spot = hash_mod(F.size("wrong_labels"), seed, key, "wrong")
    none = F.size("wrong_labels") == 0
    rows = rows.withColumn("wrong_label", fail_when(none, "an incorrect choice is required", F.get("wrong_labels", spot)))
    right = _option(F.col("answer_label"), _text_of(F.col("answer_label")))
    wrong = _option(F.col("wrong_label"), _text_of(F.col("wrong_label")))
    first = hash_is_even(seed, key, "order")
    records = rows.select(
        F.concat(F.lit(prefix + ":"), key).alias("record_id"),
        "source_problem_id",
        F.lit("pairwise").alias("mode"),
        "prompt",
        F.when(first, right).otherwise(wrong).alias("candidate_a"),
        F.when(first, wrong).otherwise(right).alias("candidate_b"),
        F.when(first, "A").otherwise("B").alias("gold"),
        F.lit("answer_key").alias("provenance"),
        "split",
        "wrong_label",
    )
    sources = rows.select(
        F.concat(F.lit("arc:"), key).alias("source_id"),
        "source_problem_id",
        "split",
        "prompt",
        F.col("answer_label").alias("answer_key"),
        _text_of(F.col("answer_label")).alias("answer_text"),
        F.map_from_arrays("labels", "texts").alias("choices"),
        "upstream_split",
    )
    return sources, records


def _pass_fail(
    df: DataFrame, record_id, right: Column, wrong: Column, provenance: str = "answer_key", extra: Sequence[str] = ()
) -> DataFrame:
    out = _variants(
        df,
        [F.col("source_problem_id"), F.col("prompt"), F.col("split"), *[F.col(c) for c in extra]],
        {
            "correct": {"candidate_a": right, "gold": F.lit("pass")},
            "wrong": {"candidate_a": wrong, "gold": F.lit("fail")},
        },
    )
    return out.select(
        record_id(F.col("variant")).alias("record_id"),
        "source_problem_id",
        F.lit("single").alias("mode"),
        "prompt",
        "candidate_a",
        F.lit(None).cast("string").alias("candidate_b"),
        "gold",
        F.lit(provenance).alias("provenance"),
        "split",
        "variant",
        *extra,
    )


def single_pair(df: DataFrame, seed: int = DEFAULT_SEED, prefix: str = "arc-single", dev_fraction: float = 0.5) -> DataFrame:
    """GEN3: one correct row and one with the first non-answer choice."""
    rows = _questions(df, seed, dev_fraction)
    options = F.transform("wrong_labels", lambda x: _option(x, _text_of(x)))
    none = F.size("wrong_labels") == 0
    wrong = fail_when(none, "no wrong candidate", F.get(options, F.lit(0)))
    return _pass_fail(
        rows,
        lambda v: F.concat_ws(":", F.lit(prefix), "source_problem_id", v),
        _option(F.col("answer_label"), _text_of(F.col("answer_label"))),
        wrong,
    )


def choice_pair(df: DataFrame, dataset: str) -> DataFrame:
    """GEN4: the wrong candidate is the choice after the answer.

    Input: ``source_problem_id, question, choices array, answer_index, split``.
    """
    n, i = F.size("choices"), F.col("answer_index")
    texts = F.col("choices")
    labels = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.char(k + 65))
    rows = df.withColumns({"labels": labels, "texts": texts})
    j = F.pmod(i + 1, n)
    bad = (strip(F.col("question")) == "") | (n < 2) | (i < 0) | (i >= n)
    rows = refuse(rows, F.coalesce(bad, F.lit(True)), "a choice row needs a question, at least two choices and an answer among them")

    def say(k: Column) -> Column:
        return F.concat(F.lit("Answer: "), F.char(k + 65), F.lit(") "), F.get("choices", k))

    return _pass_fail(
        rows.withColumn("prompt", choice_prompt()),
        lambda v: F.concat_ws(":", F.lit(dataset), "source_problem_id", v),
        say(i),
        say(j),
    )


def final_answer(answer: Column) -> Column:
    """Number after ``####`` as a plain decimal without trailing zeros."""
    raw = F.regexp_extract(answer, r"(?U)####\s*([^\s]+)", 1)
    return canonical_number(F.regexp_replace(raw, "[,$]", ""))


def numeric_pair(df: DataFrame, dataset: str = "gsm8k") -> DataFrame:
    """GEN5: the wrong candidate is the answer plus one. Input: ``source_problem_id, question, answer, split``."""
    right = final_answer(F.col("answer"))
    rows = df.withColumns(
        {
            "_right": right,
            "prompt": F.concat(F.lit("Solve the math word problem.\nQuestion: "), strip(F.col("question"))),
        }
    )
    rows = refuse(rows, F.col("_right").isNull() | F.rlike("_right", F.lit("[eI]")), "the answer ends in no plain number")
    wrong = plus_one(F.col("_right"))
    return _pass_fail(
        rows,
        lambda v: F.concat_ws(":", F.lit(dataset), "source_problem_id", v),
        F.concat(F.lit("Final answer: "), "_right"),
        F.concat(F.lit("Final answer: "), wrong),
    )


# --- registry facts -----------------------------------------------------------

# Context lines, questions and fields of the registry claims.
ENTITY_LINES = (
    ("legal_name", "Legal name"),
    ("entity_category", "Entity category"),
    ("legal_jurisdiction", "Legal jurisdiction"),
    ("registration_status", "Registration status"),
    ("initial_registration_date", "Initial registration date"),
)
CLAIM_FIELDS = {
    "status": ("registration_status", "Is the recorded registration status correct?"),
    "jurisdiction": ("legal_jurisdiction", "Is the recorded legal jurisdiction correct?"),
    "entity-category": ("entity_category", "Is the recorded entity category correct?"),
}
CLASSIFIER_FAMILIES = {
    "entity-category": ("entity_category", "Which entity category applies to this entity?"),
    "registration-status": ("registration_status", "Which registration status applies to this entity?"),
    "legal-jurisdiction": ("legal_jurisdiction", "Which legal jurisdiction applies to this entity?"),
}
REGISTRY = "gleif"


def entity_context(masked: str | None = None) -> Column:
    """Entity record as text, without the masked field."""
    lines = [F.lit("GLEIF Level 1 record"), F.concat(F.lit("LEI: "), norm_id(F.col("lei")))]
    lines += [F.concat(F.lit(f"{label}: "), F.col(field)) for field, label in ENTITY_LINES if field != masked]
    return F.array_join(F.array(*lines), "\n")


def _claims(df: DataFrame, family: str, key: Column, problem: Column, context: Column, question, true: Column, wrong: Column, seed: int) -> DataFrame:
    text = question if isinstance(question, Column) else F.lit(question)
    same = fail_when(true == wrong, f"{family}: the wrong variant must differ from the true value", wrong)
    rows = df.select(
        problem.alias("source_problem_id"),
        F.concat(context, F.lit("\n\nQuestion: "), text).alias("prompt"),
        entity_split(key, seed, REGISTRY).alias("split"),
        F.lit(family).alias("family"),
        true.alias("_true"),
        same.alias("_wrong"),
    )
    return _pass_fail(
        rows,
        lambda v: F.concat_ws(":", F.lit(REGISTRY), "source_problem_id", v),
        F.concat(F.lit("Answer: "), "_true"),
        F.concat(F.lit("Answer: "), "_wrong"),
        "deterministic_verifier",
        ["family"],
    )


def two_smallest(df: DataFrame, column: str) -> tuple[Column, Column]:
    """The two smallest non-empty values: all that the smallest differing value needs."""
    values = df.select(F.nullif(F.col(column), F.lit("")).alias("v"))
    first = values.agg(F.min("v").alias("v")).scalar()
    rest = values.agg(F.min(F.when(F.col("v") > first, F.col("v"))).alias("v"))
    return first, rest.scalar()


def registry_claims(df: DataFrame, seed: int, vocabulary: DataFrame | None = None) -> DataFrame:
    """GEN6: true value against the smallest differing vocabulary value.

    An entity without such a value is skipped.
    """
    vocabulary = df if vocabulary is None else vocabulary
    out = []
    for family, (field, question) in CLAIM_FIELDS.items():
        first, second = two_smallest(vocabulary, field)
        true = F.col(field)
        rows = df.withColumn("_alt", F.when(true != first, first).otherwise(second)).filter(F.col("_alt").isNotNull())
        lei = norm_id(F.col("lei"))
        problem = F.concat(F.lit(family + ":"), lei)
        out.append(_claims(rows, family, lei, problem, entity_context(), question, true, F.col("_alt"), seed))
    return reduce(lambda a, b: a.unionByName(b), out)


def date_claims(df: DataFrame, seed: int) -> DataFrame:
    """GEN7: the wrong date is one day later; an unparseable date is skipped."""
    field = F.col("initial_registration_date")
    iso = F.rlike(field, F.lit(r"^\d{4}-\d{2}-\d{2}$"))
    rows = df.withColumn("_day", F.when(iso, F.try_to_date(field, "yyyy-MM-dd"))).filter(F.col("_day").isNotNull())
    lei, family = norm_id(F.col("lei")), "initial-registration-date"
    wrong = F.date_format(F.date_add("_day", 1), "yyyy-MM-dd")
    question = "Is the recorded initial registration date correct?"
    return _claims(rows, family, lei, F.concat(F.lit(family + ":"), lei), entity_context(), question, field, wrong, seed)


def alias_claims(entities: DataFrame, aliases: DataFrame, seed: int) -> DataFrame:
    """GEN8: a name variant resolves to its own id or to another one. ``aliases``: lei, alias, wrong_lei."""
    rows = entities.join(aliases, "lei")
    lei = norm_id(F.col("lei"))
    question = F.concat(F.lit("Does the name variant '"), "alias", F.lit("' resolve to this record's LEI?"))
    return _claims(rows, "alias", lei, F.concat(F.lit("alias:"), lei), entity_context(), question, lei, norm_id(F.col("wrong_lei")), seed)


def parent_claims(rel: DataFrame, entities: DataFrame, sampled: DataFrame, order: Sequence[str], seed: int) -> DataFrame:
    """GEN9: recorded parent against the first sampled entity that is neither endpoint.

    Two endpoints can rule out at most two entities, so the first three of
    ``sampled`` decide every distractor. ``rel``: start, end, type.
    """
    head = sampled.select(norm_id(F.col("lei")).alias("lei"), *order).orderBy(*order).limit(3)
    names = F.array_sort(F.collect_list(F.struct(*order, "lei")))
    pool = head.agg(F.transform(names, lambda x: x["lei"]).alias("p")).scalar()
    rows = rel.select(
        norm_id(F.col("start")).alias("start"), norm_id(F.col("end")).alias("end"), strip(F.col("type")).alias("type")
    )
    known = entities.select(norm_id(F.col("lei")).alias("start"), F.col("legal_name").alias("_name"))
    rows = rows.join(known, "start", "left").withColumn("_pool", pool)
    free = F.filter("_pool", lambda x: (x != F.col("start")) & (x != F.col("end")))
    rows = rows.withColumn("_other", F.get(free, F.lit(0))).filter(F.col("_other").isNotNull())
    context = F.concat(
        F.lit("GLEIF Level 2 relationship record\nStart node (child): "),
        "start",
        F.lit(" ("),
        F.coalesce("_name", "start"),
        F.lit(")\nRelationship type: "),
        "type",
    )
    problem = F.concat_ws(":", F.lit("parent"), "start", "end", "type")
    question = "Is the recorded parent (end node) LEI correct?"
    return _claims(rows, "parent", F.col("start"), problem, context, question, F.col("end"), F.col("_other"), seed)


def classification_items(
    df: DataFrame, vocabularies: Mapping[str, Sequence[str]], seed: int, other: str = "OTHER"
) -> DataFrame:
    """GEN10: one closed-set item per entity and family, the target field hidden from the prompt.

    A jurisdiction outside its vocabulary becomes ``other``; any other value
    outside its vocabulary gives a row with ``skipped`` set and no gold.
    """
    lei = norm_id(F.col("lei"))
    cells = []
    for family, (field, question) in CLASSIFIER_FAMILIES.items():
        labels = list(vocabularies[family])
        known = F.col(field).isin(*labels)
        gold = F.when(known, F.col(field))
        if family == "legal-jurisdiction":
            gold = F.coalesce(gold, F.lit(other))
        prompt = F.concat(
            entity_context(field),
            F.lit(f"\n\nQuestion: {question}\nChoose exactly one option: {', '.join(labels)}"),
        )
        cells.append(
            F.struct(
                F.lit(family).alias("family"),
                F.concat_ws(":", F.lit(REGISTRY), F.lit(family), lei).alias("record_id"),
                F.concat_ws(":", F.lit(family), lei).alias("source_problem_id"),
                prompt.alias("prompt"),
                gold.alias("gold"),
                gold.isNull().alias("skipped"),
            )
        )
    return df.select(F.inline(F.array(*cells)), entity_split(lei, seed, REGISTRY).alias("split"))


# --- templates, code, swaps, fixtures -----------------------------------------


def fill_template(template: str, slots: Mapping[str, Column]) -> Column:
    """GEN11: prompt text; every ``{{slot}}`` must occur exactly once in the template."""
    for slot in slots:
        if template.count("{{" + slot + "}}") != 1:
            raise ValueError(f"the template must contain exactly one {{{{{slot}}}}} slot")
    out = F.lit(template)
    for slot, value in slots.items():
        out = F.replace(out, F.lit("{{" + slot + "}}"), strip(value))
    return out


def task_records(df: DataFrame, task: str, template: str, slots: Sequence[str], split: Column, prefix: str = "legalbench") -> DataFrame:
    """GEN11: tabular task rows as single-choice records; rows sharing a text share a problem."""
    text = strip(F.col("text"))
    return df.select(
        F.concat_ws(":", F.lit(f"{prefix}-{task}"), split, F.col("index").cast("int").cast("string")).alias("record_id"),
        F.concat_ws(":", F.lit(f"{prefix}-{task}"), F.lit("case"), case_key(text)).alias("source_problem_id"),
        fill_template(template, {s: F.col(s) for s in slots}).alias("prompt"),
        text.alias("candidate_a"),
        strip(F.col("answer")).alias("gold"),
        split.alias("split"),
    )


def code_records(df: DataFrame, gold: DataFrame, dataset: str, revision: str) -> DataFrame:
    """GEN12: task prompt plus candidate; test material never enters the row.

    ``df``: task_id, prompt, candidate_code, candidate_origin, candidate_slot, split.
    """
    identity = {
        "dataset_id": F.lit(dataset),
        "dataset_revision": F.lit(revision),
        "task_id": F.col("task_id"),
        "candidate_sha256": F.sha2("candidate_code", 256),
        "candidate_origin": F.col("candidate_origin"),
        "candidate_slot": F.col("candidate_slot"),
    }
    # the digest travels as 32 bytes, and texts are put together after the join, so a candidate travels once
    digest = F.unhex(content_id(identity)).alias("_id")
    rows = df.select(digest, "task_id", F.col("prompt").alias("_asked"), "candidate_code", "split")
    labels = gold.where(F.col("record_id").rlike("^[0-9a-f]{64}\\z")).select(F.unhex("record_id").alias("_id"), F.col("label").alias("gold"))
    return rows.join(labels, "_id").select(
        F.lower(F.hex("_id")).alias("record_id"),
        F.col("task_id").alias("source_problem_id"),
        F.lit("single").alias("mode"),
        F.concat("_asked", F.lit("\n\nCandidate completion:\n"), "candidate_code").alias("prompt"),
        F.col("candidate_code").alias("candidate_a"),
        "split",
        "gold",
    )


def swap_pairs(df: DataFrame) -> DataFrame:
    """GEN13: candidates swapped, A and B inverted, the original id recorded; single rows fail."""
    fields = {
        "candidate_a": fail_when(F.col("mode") != "pairwise", "only pairwise records can be swapped", F.col("candidate_b")),
        "candidate_b": F.col("candidate_a"),
        "gold": invert_label(F.col("gold")),
    }
    mark = F.create_map(F.lit("kind"), F.lit("ab_swap"), F.lit("source_record_id"), F.col("record_id"))
    if "perturbation" in df.columns:
        old = F.map_filter(
            F.coalesce("perturbation", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))),
            lambda k, _: ~k.isin("kind", "source_record_id"),
        )
        mark = F.map_concat(old, mark)
    return df.withColumns(fields | {"perturbation": mark, "source_record_id": F.col("record_id")})


def fixture_variants(sources: DataFrame, seed: int = DEFAULT_SEED) -> DataFrame:
    """GEN14: three verified single rows and both orders of one pair per source.

    ``sources``: source_problem_id, verifier_id, prompt, reference, correct, subtle, obvious.
    """
    rows = sources.withColumn("split", split_of(F.col("source_problem_id"), seed))
    none = F.lit(None).cast("string")

    def single(name: str) -> dict[str, Column]:
        gold = verify(F.col("verifier_id"), F.col(name), F.col("reference"))["label"]
        return {
            "record_id": F.concat_ws("-", F.lit("single"), "source_problem_id", F.lit(name)),
            "mode": F.lit("single"),
            "candidate_a": F.col(name),
            "candidate_b": none,
            "gold": gold,
        }

    def pair(name: str, a: str, b: str, gold: str) -> dict[str, Column]:
        return {
            "record_id": F.concat_ws("-", F.lit("pair"), "source_problem_id", F.lit(name)),
            "mode": F.lit("pairwise"),
            "candidate_a": F.col(a),
            "candidate_b": F.col(b),
            "gold": F.lit(gold),
        }

    variants = {name: single(name) for name in ("correct", "subtle", "obvious")}
    variants["correct-first"] = pair("correct-first", "correct", "subtle", "A")
    variants["incorrect-first"] = pair("incorrect-first", "subtle", "correct", "B")
    keep = [F.col(c) for c in ("source_problem_id", "prompt", "split", "verifier_id")]
    return _variants(rows, keep, variants)


# Criteria of the two built-in label spaces.
CRITERIA = {
    "pass": "The candidate is objectively correct.",
    "fail": "The candidate is objectively incorrect.",
    "A": "Candidate A is better or more correct.",
    "B": "Candidate B is better or more correct.",
    "TIE": "The candidates are objectively equivalent.",
}
INSTRUCTION = "Return the single objective verdict for the candidate record."


def _ordered_criteria(labels: Sequence[str], criteria: Mapping[str, str]) -> Column:
    return F.array(
        *[F.struct(F.lit(x).alias("id"), F.lit(criteria.get(x, x)).alias("description")) for x in labels]
    )


def request_packets(
    df: DataFrame,
    labels: Sequence[str] | None = None,
    criteria: Mapping[str, str] | None = None,
    order: Sequence[str] | None = None,
    instruction: str = INSTRUCTION,
) -> DataFrame:
    """GEN15: state, question and ordered label criteria per record; gold never enters."""
    if labels is not None:
        if len(labels) < 2 or len(set(labels)) != len(labels):
            raise ValueError("a label set needs at least two unique labels")
        if criteria is not None and set(criteria) != set(labels):
            raise ValueError("criteria keys must exactly match the label set")
        names = list(labels)
        if order is not None:
            if sorted(order) != sorted(names):
                raise ValueError("the label order must be a permutation of the legal labels")
            names = list(order)
        options = _ordered_criteria(names, criteria or {})
        legal = lit_array(names)
    else:
        single = F.col("mode") == "single"
        options = F.when(single, _ordered_criteria(SINGLE_LABELS, CRITERIA)).otherwise(
            _ordered_criteria(PAIRWISE_LABELS, CRITERIA)
        )
        legal = F.when(single, lit_array(SINGLE_LABELS)).otherwise(lit_array(PAIRWISE_LABELS))
    state = F.concat(
        F.lit("User prompt: "),
        "prompt",
        F.lit("\nCandidate A: "),
        "candidate_a",
        F.when(F.col("mode") == "pairwise", F.concat(F.lit("\nCandidate B: "), "candidate_b")).otherwise(""),
    )
    packet = F.struct(
        legal.alias("labels"), options.alias("options"), F.lit(instruction).alias("question"), F.col("record_id"), state.alias("state")
    )
    return df.select("record_id", "mode", F.to_json(packet).alias("packet"))


def review_batch(records: DataFrame, local: DataFrame, hard: DataFrame) -> DataFrame:
    """GEN16: hard cases with the local prediction and without their gold label."""
    shown = records.drop("gold", "provenance", "correct", "resolved")
    picked = shown.join(hard.select("record_id").distinct(), "record_id", "left_semi")
    mine = local.select("record_id", F.col("label").alias("local_label"), F.col("probabilities").alias("local_probabilities"))
    return picked.join(mine, "record_id", "left")


# --- training rows ------------------------------------------------------------

CANONICAL_CRITERION = "The candidate matches the deterministic answer key."


def training_arm(
    records: DataFrame,
    arm: str,
    negatives: DataFrame | None = None,
    paraphrases: Mapping[str, str] | None = None,
) -> DataFrame:
    """GEN17: rows of arm A (canonical), B (+ criterion paraphrase), C (+ hard negatives) or D (both).

    ``records`` and ``negatives`` carry record_id, source_problem_id, split,
    domain, prompt, candidate_a, gold, criterion_text.
    """
    if arm not in ("A", "B", "C", "D"):
        raise ValueError("training arm must be A, B, C, or D")

    def rows(df: DataFrame, kind: str, augmentation: str) -> DataFrame:
        base = df.filter(F.col("split") == "train")
        canonical = F.struct(F.lit(augmentation).alias("augmentation"), F.col("criterion_text").alias("criterion_text"))
        options = [canonical]
        if arm in ("B", "D") and paraphrases:
            table = F.create_map(*[F.lit(x) for pair in paraphrases.items() for x in pair])
            other = F.try_element_at(table, F.col("domain"))
            mark = F.concat(F.lit("criterion-paraphrase:"), "domain")
            options.append(
                F.when(other.isNotNull() & (other != ""), F.struct(mark.alias("augmentation"), other.alias("criterion_text")))
            )
        cells = F.array_compact(F.array(*options))
        return base.select(
            "record_id",
            "source_problem_id",
            F.col("split").alias("source_split"),
            "domain",
            "prompt",
            F.col("candidate_a").alias("candidate"),
            F.col("gold").alias("label"),
            F.lit(kind).alias("source_kind"),
            F.inline(cells),
        ).withColumn("row_id", F.concat_ws(":", "record_id", "augmentation"))

    out = rows(records.filter(F.col("mode") == "single"), "objective", "canonical")
    if arm in ("C", "D") and negatives is not None:
        bad = F.when(F.col("gold") != "fail", F.raise_error("hard negatives must carry fail labels").cast("string"))
        checked = negatives.withColumn("gold", bad.otherwise(F.col("gold")))
        out = out.unionByName(rows(checked, "verified_hard_negative", "verified-hard-negative"))
    return out


def enforce_training(rows: DataFrame, test: DataFrame) -> None:
    """VAL14 applied to an assembled arm."""
    enforce(check_training(rows, test))


def domain_of_verifier(verifier_id: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in DOMAIN_OF_VERIFIER.items() for x in pair])
    return F.coalesce(F.try_element_at(table, verifier_id), F.lit("unknown"))


def render_text(with_domain: bool, criterion: str = "criterion_text", candidate: str = "candidate") -> Column:
    """GEN18: classifier input; training texts name the domain, inference texts do not."""
    parts = [
        F.lit("Task: decide whether the candidate satisfies the rubric."),
        F.concat(F.lit("Rubric: "), F.col(criterion)),
        *([F.concat(F.lit("Domain: "), F.col("domain"))] if with_domain else []),
        F.concat(F.lit("Prompt: "), F.col("prompt")),
        F.concat(F.lit("Candidate: "), F.col(candidate)),
    ]
    return F.concat_ws("\n", *parts)


def accept_negatives(
    candidates: DataFrame, sources: DataFrame, allowed: Sequence[str], defaults: Mapping[str, str]
) -> tuple[DataFrame, DataFrame]:
    """GEN19: (accepted, rejected); a candidate that verifies as correct is not a negative.

    ``candidates``: source_problem_id, candidate, failure_mode. ``sources``:
    source_problem_id, split, domain, prompt, verifier_id, reference.
    """
    rows = candidates.join(sources, "source_problem_id")
    rows = rows.withColumn("_v", verify(F.col("verifier_id"), F.col("candidate"), F.col("reference")))
    table = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    mode = F.when(F.col("failure_mode").isin(*allowed, *defaults.values()), F.col("failure_mode")).otherwise(
        F.try_element_at(table, F.col("domain"))
    )
    accepted = rows.filter(~F.col("_v.is_correct")).select(
        F.concat(F.lit("hard-negative:"), "source_problem_id", F.lit(":001")).alias("record_id"),
        "source_problem_id",
        "split",
        "domain",
        "prompt",
        "candidate",
        mode.alias("failure_mode"),
        F.lit("fail").alias("gold"),
        F.lit("deterministic_verifier").alias("provenance"),
        F.col("_v.verifier_id").alias("verifier_id"),
    )
    rejected = rows.filter(F.col("_v.is_correct")).select(
        "source_problem_id", "candidate", F.lit("teacher_candidate_verified_correct").alias("reason")
    )
    return accepted, rejected


# --- sets of records ----------------------------------------------------------


def union_families(*families: DataFrame) -> DataFrame:
    """SET1: one table of several benchmark families."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), families)


def check_union(records: DataFrame, partition: str | None = None) -> DataFrame:
    """SET1: duplicate record ids, and source families that cross partitions."""
    out = check_unique(records, ["record_id"])
    if partition is not None:
        out = out.unionByName(check_isolation(records, "source_problem_id", partition))
    return out


def majority_judge(records: DataFrame, public: DataFrame, judge_id: str = "majority_baseline") -> DataFrame:
    """SET3: the most frequent public label per mode as a full prediction set.

    A tie goes to the earlier legal label.
    """
    legal = lit_array(SINGLE_LABELS + PAIRWISE_LABELS)
    counts = public.groupBy("mode", "gold").agg(F.count("*").alias("_n"))
    order = W.partitionBy("mode").orderBy(F.desc("_n"), F.array_position(legal, F.col("gold")))
    best = counts.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("mode", F.col("gold").alias("label"))
    return records.join(best, "mode", "left").select(
        F.lit(judge_id).alias("judge_id"),
        "record_id",
        "label",
        F.when(F.col("label").isNull(), "skipped").otherwise("ok").alias("execution_status"),
    )
