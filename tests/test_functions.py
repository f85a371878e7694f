"""Scalar functions: verifiers, parsers, probability maps, slugs."""

import json
import math

import pytest
from pyspark.sql import functions as F

from assay.functions import probability as P
from assay.functions import text as T
from assay.functions import verdicts as W
from assay.functions import verifiers as X
from assay.functions.identity import case_key, content_id, hash_unit
from assay.vocab import lit_array


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "check,candidate,expected,want",
    [
        (X.verify_numeric, "12.0", "12", True),
        (X.verify_numeric, " 1,234.50 ", "1234.5", True),
        (X.verify_numeric, "1e3", "1000", True),
        (X.verify_numeric, "-0", "0", True),
        (X.verify_numeric, "12345678901234567890123456789012345678901", "12345678901234567890123456789012345678902", False),
        (X.verify_numeric, "True", "1", False),
        (X.verify_numeric, "twelve", "12", False),
        (X.verify_choice, "b) because", "B", True),
        (X.verify_choice, "B", '{"answer": "b"}', True),
        (X.verify_choice, "Because", "B", False),
        (X.verify_json, '{"b": 1, "a": [1, 2]}', '{"a": [1, 2], "b": 1}', True),
        (X.verify_json, '{"a": 3.0}', '{"a": 3}', True),
        (X.verify_json, '{"a": 1e2}', '{"a": 100}', True),
        (X.verify_json, '{"a": "1.0"}', '{"a": "1"}', False),
        (X.verify_json, '{"a": ', '{"a": 1}', False),
        (X.verify_text, "\na  \r\nb\t\n", "a\nb", True),
        (X.verify_text, "a\n b", "a\nb", False),
    ],
)
def test_verifiers(spark, check, candidate, expected, want):
    got = value(spark, check(F.lit(candidate), F.lit(expected)))
    assert got["is_correct"] is want and got["label"] == ("pass" if want else "fail")


def test_unknown_verifier_fails(spark):
    with pytest.raises(Exception, match="unknown verifier"):
        value(spark, X.verify(F.lit("nobody-v0"), F.lit("1"), F.lit("1")))


def test_registered_verifier(spark):
    def shout(c, e):
        return X._verdict(F.upper(c) == F.upper(e), "shout-v1", {"candidate": c})

    X.register_verifier("shout-v1", shout)
    try:
        assert value(spark, X.verify(F.lit("shout-v1"), F.lit("ok"), F.lit("OK")))["is_correct"]
        with pytest.raises(ValueError):
            X.register_verifier("shout-v1", shout)
    finally:
        del X.REGISTRY["shout-v1"]


def test_execution_gold(spark):
    df = spark.createDataFrame([("pass",), ("test_failure",), ("timeout",)], "status string")
    gold, rest = X.gold_from_execution(df)
    assert sorted((r["status"], r["label"]) for r in gold.collect()) == [("pass", "pass"), ("test_failure", "fail")]
    assert [r["status"] for r in rest.collect()] == ["timeout"]


@pytest.mark.parametrize(
    "raw,slug",
    [("35 U.S.C. § 101", "35-usc-101"), ("37 CFR 1.56", "37-cfr-1-56"), ("37 c.f.r. 1.56", "37-cfr-1-56"), ("MPEP § 1002.02", "mpep-1002-02"), (None, "")],
)
def test_citation_slug(spark, raw, slug):
    assert value(spark, T.citation_slug(F.lit(raw).cast("string"))) == slug


def test_short_citation_is_not_echoed_when_empty(spark):
    assert value(spark, T.is_echoed(F.lit("t"), F.lit("see 35 USC 101."), F.lit("35 U.S.C. § 101"))) is True
    assert value(spark, T.is_echoed(F.lit("t"), F.lit("x"), F.lit("§"))) is False


@pytest.mark.parametrize(
    "text,mode,want",
    [
        ('{"label": "PASS"}', "single", "pass"),
        ('x {"a": [{"verdict": "b"}]} y', "pairwise", "B"),
        ('{"result": "{\\"choice\\": \\"fail\\"}"}', "single", "fail"),
        ('{"label": {"choice": "TIE"}}', "pairwise", "TIE"),
        ("first pass, then FAIL.", "single", "fail"),
        ('{"label": "unsure"} so fail', "single", "fail"),
        ('{"label": "pass"', "single", "pass"),
        ("no verdict", "single", None),
        ("{" * 50 + "passing", "single", None),
    ],
)
def test_free_verdict(spark, text, mode, want):
    assert value(spark, W.parse_verdict(F.lit(text), F.lit(mode))) == want


@pytest.mark.parametrize(
    "text,mode,scheme,want",
    [
        ("I think pass", "single", "plain", (None, "unresolved")),
        ("LABEL: fail\nFINAL_LABEL = Pass", "single", "plain", ("pass", "marker")),
        ('{"label": "A_BETTER"}', "pairwise", "semantic", ("A", "json")),
        ('{"label": "A"}', "pairwise", "semantic", (None, "unresolved")),
    ],
)
def test_strict_verdict(spark, text, mode, scheme, want):
    assert tuple(value(spark, W.parse_verdict_strict(F.lit(text), F.lit(mode), scheme))) == want


@pytest.mark.parametrize(
    "doc,mode,labels,want",
    [
        ({"result": {"label": True}}, "single", None, ("ok", "pass", None)),
        ({"label": True}, "pairwise", None, ("parse_error", None, None)),
        ({"choices": [{"message": {"content": "Sure {\"label\": \"a\"}"}}]}, "pairwise", None, ("ok", "A", None)),
        ({"answers": {"q": {"verdict": "yes", "probs": {"pass": 3, "fail": 1}}}}, "single", None, ("ok", "pass", {"pass": 0.75, "fail": 0.25})),
        ({"label": "X"}, "single", ("X", "Y"), ("ok", "X", None)),
        ({"label": "x"}, "single", ("X", "Y"), ("parse_error", None, None)),
        ({"label": True}, "single", ("X", "Y"), ("parse_error", None, None)),
        ({"label": "pass", "probs": {"pass": -1}}, "single", None, ("parse_error", None, None)),
        ({"note": 1}, "single", None, ("parse_error", None, None)),
    ],
)
def test_typed_response(spark, doc, mode, labels, want):
    got = value(spark, W.normalize_response(F.lit(json.dumps(doc)), F.lit(mode), labels))
    assert (got["execution_status"], got["label"], got["probabilities"]) == want


def test_surfaced_models(spark):
    text = 'log {"model": "m2", "x": [{"modelUsage": {"m1": 1}}]} {"resolved_model": "m2"}'
    assert value(spark, W.surfaced_models(F.lit(text))) == ["m1", "m2"]
    assert value(spark, W.surfaced_models(F.lit("nothing"))) == []


def test_proposal(spark):
    good = '{"candidate": " x ", "failure_mode": "f", "rationale": "r"}'
    assert value(spark, W.parse_proposal(F.lit("Here: " + good)))["candidate"] == "x"
    assert value(spark, W.parse_proposal(F.lit('{"candidate": " ", "failure_mode": "f", "rationale": "r"}'))) is None
    assert value(spark, W.parse_proposal(F.lit('{"candidate": 1, "failure_mode": "f", "rationale": "r"}'))) is None


def test_assembled_stream(spark):
    lines = [
        'data: {"model": "m", "choices": [{"delta": {"content": "Hel"}}], "usage": {"total_tokens": 1}}',
        "data: {oops",
        ": comment",
        'data: {"choices": [{"delta": {"content": "lo"}}], "usage": {"total_tokens": 5}}',
        "data: [DONE]",
    ]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)], "response_id string, seq int, line string")
    got = W.assemble_responses(df.repartition(3)).first()
    assert (got["content"], got["models"], got["total_tokens"], got["cost"]) == ("Hello", ["m"], 5.0, None)


LABELS = ["x", "y"]


@pytest.mark.parametrize(
    "selected,p,want",
    [
        ("x", {"x": 0.6, "y": 0.4}, ("ok", None)),
        ("x", {"x": 0.5, "y": 0.3, "abstain": 0.2}, ("ok", None)),
        (None, {"x": 1.0}, ("parse_error", "selected_label_missing")),
        ("abstain", None, ("skipped", "abstention")),
        ("z", {"x": 1.0}, ("parse_error", "selected_label_outside_declared_choices")),
        ("x", None, ("parse_error", "empty_or_zero_probability_mass")),
        ("x", {"x": float("nan"), "y": 1.0}, ("parse_error", "invalid_probability_value")),
        ("x", {"x": 1.5, "y": -0.5}, ("parse_error", "probability_out_of_range")),
        ("x", {"x": 0.5, "y": 0.3}, ("parse_error", "probability_mass_does_not_sum_to_one")),
        ("x", {"other": 1.0}, ("parse_error", "no_probability_mass_for_legal_labels")),
        ("x", {"x": 0.4, "y": 0.6}, ("parse_error", "selected_label_disagrees_with_probability_argmax")),
        ("y", {"x": 0.5, "y": 0.5}, ("parse_error", "selected_label_disagrees_with_probability_argmax")),
    ],
)
def test_choice_output(spark, selected, p, want):
    df = spark.createDataFrame([(selected, p)], "s string, p map<string,double>")
    got = df.select(P.normalize_choice(F.col("s"), F.col("p"), lit_array(LABELS)).alias("r")).first()["r"]
    assert (got["execution_status"], got["error_kind"]) == want


def test_choice_list_length(spark):
    got = value(spark, P.normalize_choice_list(F.lit("x"), F.array(F.lit(1.0)), lit_array(LABELS)))
    assert got["error"] == "probability_count_mismatch"
    assert value(spark, P.normalize_choice_list(F.lit("x"), F.array(F.lit(0.7), F.lit(0.3)), lit_array(LABELS)))["label"] == "x"


def test_renormalize_last_spelling_wins(spark):
    p = F.create_map(*[F.lit(x) for x in ("yes", 1.0, "true", 3.0, "no", 1.0)])
    got = value(spark, P.renormalize(p, F.lit("single")))
    assert got == {"pass": 0.75, "fail": 0.25}


def test_margin_and_softmax(spark):
    df = spark.createDataFrame([({"a": 0.7, "b": 0.3}, {"a": 1000.0, "b": 999.0}), ({"a": 1.0}, {"a": 0.0})], "p map<string,double>, s map<string,double>")
    a, b = df.select(P.margin(F.col("p")).alias("m"), P.softmax(F.col("s")).alias("s")).collect()
    assert a["m"] == pytest.approx(0.4) and b["m"] == 1.0
    assert a["s"]["a"] == pytest.approx(1 / (1 + math.exp(-1)))


def test_criteria(spark):
    schema = "record_id string, mode string, criterion_id string, label string, probabilities map<string,double>, criteria_count int"
    rows = [
        ("1", "single", "c1", "pass", {"pass": 0.8, "fail": 0.2}, 2),
        ("1", "single", "c2", "fail", {"pass": 0.4, "fail": 0.6}, 2),
        ("2", "pairwise", "c1", "A", None, 2),
        ("2", "pairwise", "c2", "B", {"A": 0.4, "B": 0.6}, 2),
        ("3", "single", "c1", "pass", None, 2),
        ("4", "single", "c1", None, None, 2),
    ]
    got = {r["record_id"]: r for r in P.aggregate_criteria(spark.createDataFrame(rows, schema)).collect()}
    assert got["1"]["label"] == "fail" and got["1"]["probabilities"]["pass"] == pytest.approx(0.6)
    assert got["2"]["label"] == "TIE" and got["2"]["probabilities"] is None
    assert got["3"]["execution_status"] == got["4"]["execution_status"] == "parse_error"


def test_hash_identities(spark):
    import hashlib

    digest = hashlib.sha256(b"7:x:y").digest()
    assert value(spark, hash_unit(7, "x", F.lit("y"))) == int.from_bytes(digest[:8], "big") / 2**64
    assert value(spark, case_key(F.lit("a \n\t b "))) == hashlib.sha256(b"a b").hexdigest()[:16]
    want = hashlib.sha256(json.dumps({"a": 1, "b": None, "c": "é"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert value(spark, content_id({"c": F.lit("é"), "a": F.lit(1), "b": F.lit(None).cast("string")})) == want


def test_source_group(spark):
    assert value(spark, T.source_group(F.lit("cais/mmlu:law"))) == "MMLU (8 subjects)"
    with pytest.raises(Exception, match="unknown source"):
        value(spark, T.source_group(F.lit("elsewhere")))
