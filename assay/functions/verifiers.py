"""Deterministic answer checks and the verifier registry."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assay.functions.text import let, strip

Check = Callable[[Column, Column], Column]

_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_INFINITE = r"(?i)^[+-]?inf(?:inity)?$"
# Values whose first digit stands this far from the point are spelled with an exponent.
_WIDEST = 400


def canonical_number(c: Column) -> Column:
    """One spelling per decimal value, null when the text is not a number.

    The value is never put into a decimal or double: an exponent moves the point
    in the digit string, so any number of digits compares exactly.
    """

    def spell(x: Column) -> Column:
        whole = F.regexp_extract(x, r"^[+-]?([0-9]*)", 1)
        part = F.regexp_extract(x, r"\.([0-9]*)", 1)
        shift = F.coalesce(F.nullif(F.regexp_extract(x, r"[eE]([+-]?[0-9]+)$", 1), F.lit("")), F.lit("0"))
        digits = F.regexp_replace(F.concat(whole, part), "^0+", "")
        # place: how many digits stand before the point, once leading zeros are gone
        place = shift.try_cast("bigint") + F.length(digits) - F.length(part)
        shape = F.struct(F.regexp_replace(digits, "0+$", "").alias("d"), place.alias("p"))
        return let(shape, lambda s: signed(x, placed(s["d"], s["p"])))

    def placed(d: Column, p: Column) -> Column:
        n = F.length(d)
        near = F.abs(p) <= _WIDEST
        pad = F.when(near, p).otherwise(0).cast("int")
        whole = F.when(pad >= n, F.rpad(d, pad, "0")).otherwise(F.concat(F.substr(d, F.lit(1), pad), F.lit("."), F.substr(d, pad + 1)))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -pad), d)
        return (
            F.when(d == "", "0")
            .when(p.isNull(), F.lit(None).cast("string"))
            .when(~near, F.concat(F.lit("0."), d, F.lit("e"), p.cast("string")))
            .when(p > 0, whole)
            .otherwise(small)
        )

    def signed(x: Column, d: Column) -> Column:
        return F.when(F.startswith(x, F.lit("-")) & (d != "0"), F.concat(F.lit("-"), d)).otherwise(d)

    def read(x: Column) -> Column:
        return F.when(F.rlike(x, F.lit(_NUMBER)), spell(x)).when(
            F.rlike(x, F.lit(_INFINITE)), signed(x, F.lit("Infinity"))
        )

    return let(F.regexp_replace(strip(c.cast("string")), "[,_]", ""), read)


def plus_one(number: Column) -> Column:
    """A canonical plain number plus one, digit by digit."""

    def bumped(whole: Column, old: str, new: str, run: str, back: str) -> Column:
        """The last digit before a trailing ``run`` moves by one and the run turns to ``back``."""
        tail = F.regexp_extract(whole, f"({run}*)$", 1)
        head = F.substr(whole, F.lit(1), F.length(whole) - F.length(tail))
        moved = F.concat(
            F.substr(head, F.lit(1), F.length(head) - 1), F.translate(F.right(head, F.lit(1)), old, new)
        )
        return F.concat(moved, F.translate(tail, run, back))

    def add(x: Column) -> Column:
        whole = F.regexp_extract(x, r"^-?([0-9]+)", 1)
        part = F.regexp_extract(x, r"(\.[0-9]+)$", 1)
        up = F.concat(bumped(F.concat(F.lit("0"), whole), "012345678", "123456789", "9", "0"), part)
        down = F.concat(F.lit("-"), bumped(whole, "123456789", "012345678", "0", "9"), part)
        last = F.right(part, F.lit(1))
        rest = F.substr(part, F.lit(1), F.length(part) - 1)
        over = F.concat(
            F.lit("0"), F.translate(rest, "0123456789", "9876543210"), F.translate(last, "123456789", "987654321")
        )
        negative = F.startswith(x, F.lit("-"))
        return canonical_number(F.when(negative & (whole == "0"), over).when(negative, down).otherwise(up))

    return let(number, add)


def choice_letter(c: Column) -> Column:
    """Leading option letter, or the whole trimmed text, in upper case."""
    text = strip(c.cast("string"))
    letter = F.regexp_extract(text, r"(?U)^([A-Za-z])(?:[.)\s]|$)", 1)
    return F.upper(F.when(letter != "", letter).otherwise(text))


def canonical_document(c: Column) -> Column:
    """JSON text with sorted keys and one spelling of whole numbers; null if malformed."""
    text = F.try_parse_json(c).cast("string")
    return F.regexp_replace(text, r'("(?:[^"\\]|\\.)*")|(-?[0-9]+)\.0(?![0-9eE])', "$1$2")


def plain_output(c: Column) -> Column:
    """Whole text trimmed, every line right-trimmed."""
    lines = F.split(strip(c.cast("string")), r"\R|\x0b|\x0c|[\x1c-\x1e]")
    return F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, r"(?U)[\s\x1c-\x1f]+$", "")), "\n")


def _verdict(correct: Column, verifier_id: str, evidence: Mapping[str, Column]) -> Column:
    right = F.coalesce(correct, F.lit(False))
    entries = [x for k, v in evidence.items() for x in (F.lit(k), v.cast("string"))]
    return F.struct(
        right.alias("is_correct"),
        F.when(right, "pass").otherwise("fail").alias("label"),
        F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull()).alias("evidence"),
        F.lit(verifier_id).alias("verifier_id"),
    )


def verify_numeric(candidate: Column, expected: Column) -> Column:
    """FN1: decimal equality; an unparseable side fails with a note."""
    a, b = canonical_number(candidate), canonical_number(expected)
    note = F.when(a.isNull() | b.isNull(), "candidate is not a valid decimal number")
    return _verdict(
        a == b,
        "arithmetic-v1",
        {"candidate": candidate, "expected": expected, "candidate_value": a, "expected_value": b, "error": note},
    )


def verify_choice(candidate: Column, expected: Column) -> Column:
    """FN2: option letters agree; ``expected`` may be an object with ``answer``."""
    inner = F.try_variant_get(F.try_parse_json(expected), "$.answer", "string")
    a, b = choice_letter(candidate), choice_letter(F.coalesce(inner, expected))
    return _verdict(
        a == b, "multiple-choice-v1", {"candidate": candidate, "candidate_choice": a, "expected_choice": b}
    )


def verify_json(candidate: Column, expected: Column) -> Column:
    """FN3: parsed documents agree, whatever their key order. ``true`` and ``1`` stay different."""
    a, b = canonical_document(candidate), canonical_document(expected)
    note = F.when(a.isNull(), "candidate is not valid JSON")
    return _verdict(
        a == b, "structured-output-v1", {"candidate": candidate, "parsed": a, "expected": b, "error": note}
    )


def verify_text(candidate: Column, expected: Column) -> Column:
    """FN4: normalised outputs are equal; nothing is executed."""
    a, b = plain_output(candidate), plain_output(expected)
    return _verdict(a == b, "code-output-v1", {"candidate_output": a, "expected_output": b})


# Verifier ids and the statuses of a trusted code run.
REGISTRY: dict[str, Check] = {
    "arithmetic-v1": verify_numeric,
    "multiple-choice-v1": verify_choice,
    "structured-output-v1": verify_json,
    "code-output-v1": verify_text,
}
DOMAIN_OF_VERIFIER = {
    "arithmetic-v1": "arithmetic",
    "multiple-choice-v1": "multiple_choice",
    "structured-output-v1": "structured",
    "code-output-v1": "code_output",
}
GOLD_STATUSES = ("pass", "test_failure", "syntax_error")
RUN_STATUSES = GOLD_STATUSES + (
    "timeout",
    "crash",
    "import_error",
    "verifier_error",
    "sandbox_unavailable",
    "malformed_output",
    "provider_failure",
)


def register_verifier(verifier_id: str, check: Check) -> None:
    """UDF1: add a check; it must return the same struct as the built-in ones."""
    if verifier_id in REGISTRY:
        raise ValueError(f"verifier {verifier_id!r} is already registered")
    REGISTRY[verifier_id] = check


def verify(verifier_id: Column, candidate: Column, expected: Column) -> Column:
    """UDF1: dispatch on the verifier id; an unknown id fails the job."""
    out = None
    for name, check in REGISTRY.items():
        result = check(candidate, expected)
        out = F.when(verifier_id == name, result) if out is None else out.when(verifier_id == name, result)
    unknown = F.raise_error(F.concat(F.lit("unknown verifier: "), verifier_id))
    return out.otherwise(
        unknown.cast("struct<is_correct:boolean,label:string,evidence:map<string,string>,verifier_id:string>")
    )


def gold_from_execution(df: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """FN5: (gold rows, rejected rows); only three run states can become gold."""
    state = F.lower(strip(F.col(status)))
    known = F.when(state.isin(*RUN_STATUSES), state).otherwise(
        F.raise_error(F.concat(F.lit("unknown execution status: "), F.col(status))).cast("string")
    )
    rows = df.withColumn(status, known)
    eligible = F.col(status).isin(*GOLD_STATUSES)
    gold = rows.filter(eligible).withColumn("label", F.when(F.col(status) == "pass", "pass").otherwise("fail"))
    return gold, rows.filter(~eligible)
