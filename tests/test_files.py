"""Sources, sinks, ledger and streaming over small files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from assay.operators import identity as I
from assay.operators import ledger as L
from assay.sources import readers as S
from assay.sources import writers as K
from assay.streaming import ingest


def test_prediction_lines(spark, tmp_path):
    rows = [
        {"record_id": "1", "judge_id": "j", "label": "pass", "execution_status": "ok", "probabilities": {"pass": 1.0}, "error": None},
        {"record_id": "outer", "gold_label": "A", "prediction": {"record_id": "2", "judge_id": "j", "label": None, "execution_status": "provider_error", "error": {"kind": "timeout"}}},
        {"record_id": "3", "judge_id": "j", "execution_status": "provider_error", "error": "timeout"},
    ]
    (tmp_path / "p.jsonl").write_text("\n\n".join(json.dumps(r) for r in rows) + "\n")
    got = {r["record_id"]: r for r in S.read_predictions(spark, str(tmp_path)).collect()}
    assert set(got) == {"1", "2", "3"}
    assert got["2"]["label"] is None and got["2"]["gold_label"] == "A"
    assert got["2"]["error_kind"] == got["3"]["error_kind"] == "timeout"


def test_nested_records(spark, tmp_path):
    row = {"dataset": "d", "partition": "blind", "source_problem_id": "s", "record": {"record_id": "r", "mode": "single", "gold": {"label": "pass", "provenance": "answer_key", "evidence": {"x": 1}}, "split": "test", "rubric": [{"criterion_id": "c", "weight": 1.0}]}}
    (tmp_path / "r.jsonl").write_text(json.dumps(row))
    got = S.read_records(spark, str(tmp_path)).first()
    assert (got["record_id"], got["gold"], got["source_problem_id"], got["rubric"][0]["criterion_id"]) == ("r", "pass", "s", "c")


ALIASES = {"lei": ("LEI", "id"), "name": ("Name",)}


def test_registry_csv(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("﻿id,Extra,Name\n" + f"{'a' * 20},1,\"x, \"\"y\"\"\"\nshort,2,z\n", encoding="utf-8")
    got = S.read_registry_csv(spark, str(path), ALIASES).collect()
    assert [(r["lei"], r["name"]) for r in got] == [("a" * 20, 'x, "y"')]
    with pytest.raises(ValueError, match="none of"):
        S.read_registry_csv(spark, str(path), {"lei": ("nope",)})
    path.write_text(f"id,Extra,Name\n{'a' * 20},1\n", encoding="utf-8")
    with pytest.raises(Exception):
        S.read_registry_csv(spark, str(path), ALIASES).collect()


def test_tsv_contract(spark, tmp_path):
    path = tmp_path / "t.tsv"
    path.write_text("index\tanswer\ttext\n1\tYes\thello\n")
    assert S.read_tsv(spark, str(path), ["index", "answer", "text"]).first()["text"] == "hello"
    with pytest.raises(ValueError, match="missing=\\['slice'\\]"):
        S.read_tsv(spark, str(path), ["index", "answer", "text", "slice"])
    with pytest.raises(ValueError, match="extra=\\['text'\\]"):
        S.read_tsv(spark, str(path), ["index", "answer"])


def test_corpus_nulls_and_empty_graph(spark, tmp_path):
    spark.createDataFrame([("d", None, "t")], "entry_cid string, title string, text string").write.parquet(str(tmp_path / "c"))
    got = S.read_corpus(spark, str(tmp_path / "c")).first()
    assert (got["title"], got["citation"], got["body"]) == ("", "", "\nt")
    (tmp_path / "none").mkdir()
    with pytest.raises(Exception):
        S.read_graph(spark, str(tmp_path / "none"), ["a"])


def read_lines(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*")))


def test_jsonl_sink_is_deterministic(spark, tmp_path):
    rows = [(f"k{i:02d}", {"b": 1.0, "a": 2.0}, None if i % 2 else (1, "x")) for i in range(30)]
    df = spark.createDataFrame(rows, "key string, m map<string,double>, a struct<z: int, y: string>")
    K.write_jsonl(df, str(tmp_path / "one"), "key")
    K.write_jsonl(df.repartition(7).select("a", "m", "key"), str(tmp_path / "two"), "key")
    text = read_lines(tmp_path / "one")
    assert text == read_lines(tmp_path / "two")
    assert text.splitlines()[0] == '{"a":{"y":"x","z":1},"key":"k00","m":{"a":2.0,"b":1.0}}'
    assert '"a":null' in text.splitlines()[1]
    with pytest.raises(Exception, match="share the key"):
        K.write_jsonl(df.unionByName(df), str(tmp_path / "three"), "key")
    with pytest.raises(Exception, match="NaN"):
        K.write_jsonl(df.withColumn("v", F.lit(float("nan"))), str(tmp_path / "four"), "key")


def test_revisions_and_manifest(spark, tmp_path):
    root = tmp_path / "set"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"one\r\ntwo\n")
    (root / "sub" / "b.txt").write_bytes(b"three")
    digests = I.file_digests(spark, str(root))
    got = {r["file"]: r["sha256"] for r in digests.collect()}
    assert got == {"a.txt": hashlib.sha256(b"one\ntwo\n").hexdigest(), "sub/b.txt": hashlib.sha256(b"three").hexdigest()}
    before = I.content_revision(digests).first()["revision"]
    (root / "a.txt").write_bytes(b"one\ntwo\n")
    assert I.content_revision(I.file_digests(spark, str(root))).first()["revision"] == before
    (root / "a.txt").write_bytes(b"one\ntwo!\n")
    assert I.content_revision(I.file_digests(spark, str(root))).first()["revision"] != before
    manifest = tmp_path / "sums"
    manifest.write_text(f"{got['a.txt']}  a.txt\n{got['sub/b.txt']}  sub/b.txt\n{'0' * 64}  gone.txt\n")
    bad = I.verify_manifest(I.read_manifest(spark, str(manifest)), I.file_digests(spark, str(root)))
    assert sorted((r["key"], r["detail"]) for r in bad.collect()) == [("a.txt", "checksum mismatch"), ("gone.txt", "missing file")]


def test_ledger_tree(spark, tmp_path):
    e = tmp_path / "experiments" / "EXP-20260101-001-demo"
    docs = {
        "results.json": {"accuracy": 0.5, "experiment_id": "EXP-X"},
        "runs/r1/results.json": {"metrics": {"accuracy": 1}, "status_counts": {"ok": 2, "bad": True, "x": 1.5}, "accuracy_95_ci": {"lower": 0.1, "upper": None}},
        "runs/g/arm/results.json": {"correct_count": 3, "resolved_count": 4, "arms": {"a": {"accuracy": True}}, "latency": None},
        "runs/r3/results.json": [1],
        "diagnostics/d/results.json": {"accuracy": True, "elapsed_seconds": 3},
    }
    for name, doc in docs.items():
        (e / name).parent.mkdir(parents=True, exist_ok=True)
        (e / name).write_text(json.dumps(doc))
    (e / "runs/r2-Paused").mkdir()
    (e / "runs/r2-Paused/log.txt").write_text("x")
    (e / "runs/r4").mkdir()
    (e / "runs/r4/log.txt").write_text("x")
    (tmp_path / "experiments" / "notes").mkdir()
    (tmp_path / "experiments" / "notes" / "results.json").write_text("{}")
    ledger = L.run_ledger(S.read_result_tree(spark, str(tmp_path)), S.list_files(spark, str(tmp_path)))
    got = {r["run_path"].replace("experiments/EXP-20260101-001-demo", "."): r for r in ledger.collect()}
    assert {k: (r["scope"], r["completeness"]) for k, r in got.items()} == {
        ".": ("experiment", "complete"),
        "./runs/r1": ("run", "complete"),
        "./runs/g/arm": ("nested_run", "complete"),
        "./runs/r3": ("run", "quarantined"),
        "./diagnostics/d": ("diagnostic", "complete"),
        "./runs/r2-Paused": ("run", "quarantined"),
        "./runs/r4": ("run", "partial"),
    }
    assert (got["."]["experiment_id"], got["."]["experiment_id_source"], got["."]["run_id"]) == ("EXP-X", "embedded", None)
    r1 = got["./runs/r1"]
    assert (r1["accuracy"], r1["status_counts"], r1["accuracy_ci"]["low"]) == (1.0, {"ok": 2}, 0.1)
    arm = got["./runs/g/arm"]
    assert arm["accuracy"] == 0.75 and arm["structure"]["has_latency"] and not arm["structure"]["has_arm_accuracy"]
    assert got["./diagnostics/d"]["accuracy"] is None and got["./diagnostics/d"]["structure"]["has_elapsed_seconds"]
    findings = {(r["section"], r["key"], r["metric"]): r["value"] for r in L.ledger_findings(ledger).collect()}
    assert findings["totals", "all", "rows"] == 7 and findings["totals", "all", "without_results"] == 2
    assert findings["by_completeness", "quarantined", "rows"] == 2
    assert {r["run_path"].rsplit("/", 1)[1] for r in L.missing_results(ledger).collect()} == {"r2-Paused", "r4"}


SCHEMA = "judge_id string, record_id string, execution_status string, label string, latency_ms double, probabilities map<string,double>"


def test_ingest_resumes_without_duplicates(spark, tmp_path):
    src, sink, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    pool = spark.createDataFrame([("1",), ("2",), ("3",)], "record_id string")

    def land(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").json(src)
        stream = spark.readStream.schema(SCHEMA).json(src)
        ingest.ingest_predictions(stream, pool, sink, state).awaitTermination()
        return sorted((r["judge_id"], r["record_id"], r["execution_status"], r["error_kind"]) for r in spark.read.parquet(sink).collect())

    first = land([("j", "1", "ok", "pass", 1.0, None), ("j", "1", "ok", "pass", 1.0, None), ("j", "9", "ok", "pass", 1.0, None)])
    assert first == [("j", "1", "ok", None)]
    second = land([("j", "1", "ok", "fail", 1.0, None), ("j", "2", "ok", None, 1.0, None), ("j", "3", "ok", "pass", 1.0, {"pass": 2.0})])
    assert second == [
        ("j", "1", "ok", None),
        ("j", "2", "provider_error", "missing_label"),
        ("j", "3", "provider_error", "probability_range"),
    ]
    bad = sorted((r["judge_id"], r["record_id"], r["rule"]) for r in spark.read.parquet(f"{sink}-rejects").collect())
    assert bad == [("j", "1", "duplicate_prediction"), ("j", "1", "duplicate_prediction"), ("j", "9", "unknown_record")]


def test_a_batch_keeps_the_first_by_ordinal_and_can_run_again(spark, tmp_path):
    schema = "judge_id string, record_id string, ordinal long, execution_status string, label string, latency_ms double"
    pool = spark.createDataFrame([("1",), ("2",)], "record_id string")
    rows = [("j", "1", 7, "ok", "fail", 1.0), ("j", "1", 3, "ok", "pass", 1.0), ("j", "1", 9, "ok", "fail", 1.0), ("k", "1", 4, "ok", "pass", 1.0)]
    rows += [("j", "2", 5, "ok", "pass", 1.0), (None, "2", 6, "ok", "pass", 1.0), ("j", None, 8, "ok", "pass", 1.0), ("j", "x", 1, "ok", "pass", 1.0)]
    held = spark.createDataFrame([("j", "2")], "judge_id string, record_id string")
    for n in (1, 5):
        good, bad = ingest.judged(spark.createDataFrame(rows, schema).repartition(n), pool, held)
        assert sorted((r["judge_id"], r["record_id"], r["ordinal"]) for r in good.collect()) == [("j", "1", 3), ("k", "1", 4)]
        assert sorted((r["ordinal"], r["rule"]) for r in bad.collect()) == [
            (1, "unknown_record"), (5, "duplicate_prediction"), (6, "missing_key"), (7, "duplicate_prediction"), (8, "missing_key"), (9, "duplicate_prediction"),
        ]

