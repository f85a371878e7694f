"""Temperature, Platt, text judge, routing."""

import math
import random

import pytest
from pyspark.sql import functions as F

from assay.operators import calibration as C
from assay.operators import learned as T
from assay.operators import routing as P
from assay.vocab import lit_array

SCHEMA = "mode string, split string, gold string, label string, execution_status string, probabilities map<string,double>"
AB = ("A", "B")


def rows(n, seed, split="calibration", sharp=3.0):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x = rng.gauss(0, 1.5)
        gold = "A" if rng.random() < 1 / (1 + math.exp(-x)) else "B"
        p = 1 / (1 + math.exp(-sharp * x))
        out.append(("m", split, gold, "A" if p >= 0.5 else "B", "ok", {"A": p, "B": 1 - p}))
    return out


def nll(data, t):
    total = 0.0
    for _, _, gold, _, _, p in data:
        logits = [math.log(max(p[c], 1e-15)) / t for c in AB]
        top = max(logits)
        total += top + math.log(sum(math.exp(v - top) for v in logits)) - logits[AB.index(gold)]
    return total / len(data)


@pytest.mark.parametrize("by", [[], ["mode"]])
def test_temperature_fit(spark, by):
    data = rows(300, 1)
    r = C.fit_temperature(spark.createDataFrame(data, SCHEMA), by, lit_array(AB)).first()
    best = min((nll(data, math.exp(x / 500)), math.exp(x / 500)) for x in range(-3000, 3001))
    assert r["nll_after"] <= best[0] + 1e-9
    assert r["temperature"] == pytest.approx(best[1], rel=5e-3)
    assert r["nll_before"] == pytest.approx(nll(data, 1.0)) and r["fit_rows"] == 300


def test_applying_keeps_ranking_and_mass(spark):
    df = spark.createDataFrame(rows(20, 2), SCHEMA)
    model = spark.createDataFrame([("m", 3.0)], "mode string, temperature double")
    out = C.apply_temperature(df, model, ["mode"], lit_array(AB))
    for r in C.relabel(out, lit_array(AB)).collect():
        assert sum(r["probabilities"].values()) == pytest.approx(1) and r["calibrated"]
    other = C.apply_temperature(df.withColumn("mode", F.lit("x")), model, ["mode"], lit_array(AB))
    assert other.filter("calibrated").count() == 0


@pytest.mark.parametrize(
    "change,message",
    [
        ({1: "test"}, "test rows"),
        ({1: "dev"}, "only rows of the calibration split"),
        ({4: "parse_error"}, "only ok rows"),
        ({5: None}, "need a probability map"),
        ({2: "C"}, "none of the classes"),
    ],
)
def test_fitting_is_fail_closed(spark, change, message):
    bad = list(rows(1, 3)[0])
    for i, v in change.items():
        bad[i] = v
    df = spark.createDataFrame(rows(5, 3) + [tuple(bad)], SCHEMA)
    with pytest.raises(Exception, match=message):
        C.fit_temperature(df, ["mode"], lit_array(AB)).collect()


def test_platt_gradient_vanishes(spark):
    data = rows(300, 4, sharp=1.3)
    r = C.fit_platt(spark.createDataFrame(data, SCHEMA), ["mode"], "A").first()
    grad = [0.0, 0.0]
    for _, _, gold, _, _, p in data:
        x = math.log(max(p["A"], 1e-15) / max(1 - p["A"], 1e-15))
        q = 1 / (1 + math.exp(-(r["slope"] * x + r["intercept"])))
        grad[0] += (q - (gold == "A")) * x
        grad[1] += q - (gold == "A")
    assert grad == pytest.approx([0, 0], abs=1e-5)


def test_unfitted_mode_is_unavailable(spark):
    model = C.fit_by_mode(spark.createDataFrame(rows(50, 5), SCHEMA), lit_array(AB), ["m", "other"])
    assert {r["mode"]: r["status"] for r in model.collect()} == {"m": "fitted", "other": "unavailable"}


def test_text_judge_learns_saves_and_restores(spark, tmp_path):
    rng = random.Random(1)
    train = [(f"{'good fine' if i % 3 else 'bad awful'} word{rng.randrange(9)} it's", "pass" if i % 3 else "fail") for i in range(90)]
    judge = T.fit_text_judge(spark.createDataFrame(train, "text string, label string"))
    ask = spark.createDataFrame([("1", "single", "good fine"), ("2", "single", "bad awful"), ("3", "pairwise", "x")], "record_id string, mode string, text string")
    got = {r["record_id"]: r for r in judge.predict(ask).collect()}
    assert (got["1"]["label"], got["2"]["label"], got["3"]["execution_status"]) == ("pass", "fail", "skipped")
    assert sum(got["1"]["probabilities"].values()) == pytest.approx(1)
    judge.save(str(tmp_path / "judge"))
    again = {r["record_id"]: r for r in T.load_text_judge(spark, str(tmp_path / "judge")).predict(ask).collect()}
    assert again["1"]["probabilities"] == pytest.approx(got["1"]["probabilities"])
    with pytest.raises(ValueError):
        T.fit_text_judge(spark.createDataFrame([("x", "maybe")], "text string, label string"))


def test_routes_accept_equality(spark):
    df = spark.createDataFrame([("1", "A", {"A": 0.7, "B": 0.3}), ("2", "A", {"A": 0.6, "B": 0.4})], "record_id string, label string, probabilities map<string,double>")
    got = {r["record_id"]: r["route"] for r in P.route(df, 0.7).collect()}
    assert got == {"1": "local", "2": "escalate"}


def test_escalation_never_falls_back(spark):
    schema = "record_id string, judge_id string, label string, execution_status string"
    routed = spark.createDataFrame([("1", "escalate"), ("2", "escalate"), ("3", "local"), ("4", "local")], "record_id string, route string")
    local = spark.createDataFrame([(i, "l", "A", "ok" if i != "4" else "parse_error") for i in "1234"], schema)
    away = spark.createDataFrame([("1", "p", None, "rate_limited")], schema)
    got = {r["record_id"]: (r["final_label"], r["provider_status"], r["provider_error"]) for r in P.resolve(routed, local, away).collect()}
    assert got == {
        "1": (None, "rate_limited", None),
        "2": (None, "not_called", "provider_not_available"),
        "3": ("A", "not_called", None),
        "4": (None, "not_called", None),
    }


def test_local_risk_counts_missing_labels(spark):
    rows_ = [("local", "A", "A", "not_called"), ("local", None, "A", "not_called"), ("escalate", None, "A", "rate_limited")]
    df = spark.createDataFrame(rows_, "route string, final_label string, gold string, provider_status string")
    r = P.routing_summary(df.withColumn("k", F.lit(1)), ["k"]).first()
    assert r["local_accepted_risk"] == 0.5 and r["final_resolved_risk"] == 0.0 and r["external_calls"] == 1
    empty = P.routing_summary(df.filter("route = 'escalate'").withColumn("k", F.lit(1)), ["k"]).first()
    assert empty["local_accepted_risk"] == 0.0 and empty["final_resolved_risk"] is None
    assert (empty["local_risk_low"], empty["local_risk_high"]) == (0.0, 1.0)


def test_model_of_another_class_order_is_refused(spark):
    df = spark.createDataFrame(rows(50, 5), SCHEMA)
    model = C.fit_temperature(df, ["mode"], lit_array(AB))
    assert model.first()["class_order"] == list(AB)
    with pytest.raises(Exception, match="another class order"):
        C.apply_temperature(df, model, ["mode"], lit_array(AB[::-1])).select("mode").collect()
