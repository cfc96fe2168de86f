import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from corvane.operators import evaluate, index, rank
from corvane.service import evaluation as E

DAY = datetime.date(2026, 1, 2)


@pytest.fixture
def root(tmp_path):
    (tmp_path / "90-system/evals").mkdir(parents=True)
    return tmp_path


@pytest.fixture(scope="module")
def documents(spark):
    rows = [
        ("a/alpha.md", "Alpha", "concept", "# Alpha\n\n## Proof\nretrieval works", "concept", ["search"]),
        ("a/beta.md", "Beta", "concept", "# Beta\nretrieval of beta", "concept", []),
        ("a/gamma.md", "Gamma", "moc", "# Gamma\nretrieval retrieval", "moc", []),
    ]
    d = spark.createDataFrame(rows, "path string, title string, meta string, body string, type string, tags array<string>")
    return d.withColumn("size", F.octet_length("body").cast("bigint")).withColumn("updated", F.lit(""))


def put(root, name, rows):
    (root / "90-system/evals" / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")
    return f"90-system/evals/{name}"


def test_retrieval_report_threshold_and_evidence(spark, root, documents):
    cases = [
        {"id": "one", "query": "retrieval works", "expected": "a/alpha.md", "evidence": [{"path": "a/alpha.md", "heading": "Proof"}], "forbidden": "a/gamma.md", "category": "B"},
        {"id": "two", "query": "retrieval", "expected": ["a/beta.md"], "type": "concept", "category": "a"},
        {"id": "three", "query": "retrieval", "expected": ["a/beta.md"], "tags": ["SEARCH"], "category": "a"},
    ]
    path = put(root, "c.jsonl", cases)
    code, out = E.retrieval(spark, str(root), documents, path, ks=(1, 5), least_recall=0.5, report="90-system/evals/r.json", today=DAY)
    assert code == 0 and out["threshold"] == {"k": 5, "minimum_recall": 0.5, "passed": True}
    by = {r["id"]: r for r in out["results"]}
    assert by["one"]["top_paths"][0] == "a/alpha.md" and by["one"]["forbidden_hits_at_k"]["5"] == ["a/gamma.md"]
    assert set(by["two"]["top_paths"]) == {"a/alpha.md", "a/beta.md"} and by["three"]["top_paths"] == ["a/alpha.md"]
    assert out["metrics"]["recall_at_k"]["5"] == 0.666667 and out["metrics"]["evidence_recall_at_k"]["5"] == 1.0 and out["metrics"]["evidence_case_count"] == 1
    assert out["metrics"]["forbidden_hit_rate_at_k"]["5"] == 1.0 and list(out["categories"]) == ["a", "B"]
    assert json.loads((root / "90-system/evals/r.json").read_text()) == json.loads(E.emitted(out)) and out["report"] == "90-system/evals/r.json"
    assert E.retrieval(spark, str(root), documents, path, ks=(1, 5), least_recall=0.9, today=DAY)[0] == 1


def test_wrong_input_is_told(spark, root, documents):
    assert E.retrieval(spark, str(root), documents, "../x.jsonl") == (2, {"error": "outside_vault", "requested": "../x.jsonl"})
    assert E.retrieval(spark, str(root), documents, "a/x.jsonl")[1]["error"] == "cases_path_not_allowed"
    assert E.retrieval(spark, str(root), documents, "90-system/evals/none.jsonl")[1]["error"] == "cases_not_found"
    assert E.retrieval(spark, str(root), documents, put(root, "e.jsonl", []))[1]["details"] == [{"error": "no_cases", "path": "90-system/evals/e.jsonl"}]
    assert E.retrieval(spark, str(root), documents, put(root, "w.jsonl", [{"query": "q"}]))[1]["details"] == [{"line": 1, "error": "expected_required"}]
    assert E.retrieval(spark, str(root), documents, "x", least_recall=2)[1]["error"] == "invalid_recall_threshold"
    good = put(root, "g.jsonl", [{"query": "q", "expected": "a/alpha.md"}])
    assert E.retrieval(spark, str(root), documents, good, report="a/r.json")[1]["error"] == "report_path_not_allowed"


def test_usability_report_and_gate(spark, root):
    stage = lambda s, ok=True: {"success": ok, "evidence_found": True, "seconds": s, "files_opened": 2}
    rows = [{"task": "t", "category": "Capture" if i < 3 else "find", "baseline": stage(10), "candidate": stage(10 if i < 3 else 6)} for i in range(12)]
    rows.append({"task": "t", "baseline": stage(50)})
    code, out = E.usability(spark, str(root), put(root, "u.jsonl", rows), must_support=True, today=DAY)
    assert code == 0 and out["gate"]["reasons"] == ["measured_usability_gate_passed"] and out["gate"]["time_improvement"] == 0.4
    assert out["recorded_cases"] == 13 and out["paired_cases"] == 12 and out["categories"]["capture"]["candidate"]["median_seconds"] == 10.0
    code, out = E.usability(spark, str(root), put(root, "v.jsonl", rows[:2]), must_support=True, today=DAY)
    assert code == 1 and out["gate"]["reasons"] == ["insufficient_paired_cases", "time_improvement_target_not_met"]
    assert E.usability(spark, str(root), "x", evaluate.Limits(pairs=0))[1]["error"] == "minimum_case_counts_must_be_positive"


def test_emitted_layouts():
    assert E.emitted({"a": "é"}, compact=True) == '{"a":"é"}' and E.emitted({"a": 1}) == '{\n  "a": 1\n}'


def test_stored_index_is_made_once_and_again_when_files_change(spark, documents, tmp_path):
    at = f"{tmp_path}/docs"
    documents.write.parquet(at)
    one = index.stored(spark.read.parquet(at))
    assert index.stored(spark.read.parquet(at)) is one
    documents.limit(1).write.mode("append").parquet(at)
    assert index.stored(spark.read.parquet(at)).path != one.path


def test_audit_rows_are_appended(spark, tmp_path):
    from corvane.streaming import sessions

    rows = spark.createDataFrame([("2024-01-01T00:00:00Z", "PreToolUse", "t")], "at string, event string, tool string")
    for _ in range(2):
        sessions.write_audit(rows, f"{tmp_path}/audit")
    assert spark.read.json(f"{tmp_path}/audit").count() == 2
    rows.write.parquet(f"{tmp_path}/in")
    sessions.write_audit(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/audit", f"{tmp_path}/ck").awaitTermination(60)
    assert spark.read.json(f"{tmp_path}/audit").count() == 3
    # the batch comes again when its commit was lost
    for name in ("0", ".0.crc"):
        os.remove(f"{tmp_path}/ck/commits/{name}")
    sessions.write_audit(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/audit", f"{tmp_path}/ck").awaitTermination(60)
    assert spark.read.json(f"{tmp_path}/audit").count() == 3
