import json

from corvane.sources import judgments as J

NOTES = [("a/one.md", "# One\n\n## How it works ##\n"), ("a/two.md", "# Two\n"), ("90-system/templates/t.md", "# T\n")]


def case(**k):
    return json.dumps({"query": "q", "expected": ["a/one.md"], **k})


def test_lines_and_byte_order_mark(spark):
    files = spark.createDataFrame([("x.jsonl", "﻿{}\r\n\n  \n[1]\n")], "path string, content string")
    assert [(r["line"], r["raw"]) for r in J.json_lines(files).orderBy("line").collect()] == [(1, "{}"), (4, "[1]")]


def test_judgments_give_cases_and_errors(spark):
    lines = [
        "{",
        "[1]",
        json.dumps({"expected": "a/one.md"}),
        json.dumps({"query": " ", "expected": "a/one.md"}),
        json.dumps({"query": "q", "expected": [1]}),
        case(expected=[" "]),
        case(type=[1]),
        case(tags=None),
        case(forbidden=3),
        case(evidence={}),
        case(expected=["../x.md"]),
        case(expected=["a/none.md", "90-system/templates/t.md"], forbidden="/abs.md"),
        case(forbidden=["a/./one.md", "/abs.md", "nowhere.md"]),
        case(evidence=[1, {}, {"path": "a/one.md"}, {"path": "a/two.md", "heading": "Two"}, {"path": "a/one.md", "heading": "Other"}, {"path": "../a", "heading": "h"}]),
        case(id="dup", evidence=[{"path": "a/one.md", "heading": "## how it works"}], forbidden="a/two.md", category=7, type="note", tags=["x", " "]),
        case(id="dup", expected=["nowhere.md"]),
        case(id=" "),
        case(id=True, expected="a\\sub\\..\\two.md"),
        case(),
    ]
    rows = spark.createDataFrame([("c.jsonl", i, x) for i, x in enumerate(lines, 1)], "path string, line int, raw string")
    cases, errors = J.judgments(rows, spark.createDataFrame(NOTES, "path string, body string"))
    got = sorted((r["line"], r["error"], r["detail"]) for r in errors.collect())
    want = {
        (1, "invalid_json"), (2, "case_must_be_object"), (3, "query_required"), (4, "query_required"), (5, "expected_required"), (6, "expected_required"),
        (7, "filters_must_be_strings"), (8, "filters_must_be_strings"), (9, "forbidden_must_be_strings"), (10, "evidence_must_be_array"),
        (11, "expected_outside_vault"), (12, "expected_note_not_found"), (12, "expected_note_excluded"), (13, "forbidden_note_is_expected"),
        (13, "forbidden_outside_vault"), (13, "forbidden_note_not_found"), (14, "evidence_must_be_object"), (14, "evidence_path_required"),
        (14, "evidence_heading_required"), (14, "evidence_path_not_expected"), (14, "evidence_heading_not_found"), (14, "evidence_outside_vault"),
        (16, "case_id_missing_or_duplicate"), (17, "case_id_missing_or_duplicate"),
    }
    assert {(a, b) for a, b, _ in got} == want and len(got) == len(want)
    assert {(12, "a/none.md"), (13, "a/one.md"), (14, "a/one.md#Other"), (16, "dup")} <= {(a, c) for a, _, c in got}
    by = {r["line"]: r for r in cases.collect()}
    assert set(by) == {15, 18, 19}
    r = by[15]
    assert (r["case_id"], r["category"], r["types"], r["tags"], r["forbidden"], [tuple(e) for e in r["evidence"]]) == ("dup", "7", ["note"], ["x"], ["a/two.md"], [("a/one.md", "how it works")])
    assert by[18]["case_id"] == "True" and by[18]["expected"] == ["a/two.md"] and by[19]["case_id"] == "line-19"


def stage(**k):
    return {"success": True, "evidence_found": False, "seconds": 1.5, "files_opened": 2} | k


def test_observations_give_cases_and_errors(spark):
    lines = [
        json.dumps({"id": "a", "task": "t", "baseline": stage(), "candidate": stage(seconds=3), "category": "Capture"}),
        json.dumps({"id": "a", "task": "", "baseline": 1}),
        json.dumps({"task": " ", "baseline": stage()}),
        json.dumps({"task": "t"}),
        json.dumps({"task": "t", "baseline": stage(success=1)}),
        json.dumps({"task": "t", "baseline": stage(evidence_found=None)}),
        json.dumps({"task": "t", "baseline": stage(seconds=-1)}),
        json.dumps({"task": "t", "baseline": stage(seconds=True)}),
        json.dumps({"task": "t", "baseline": stage(files_opened=1.5)}),
        json.dumps({"task": "t", "baseline": stage(), "candidate": "x"}),
        json.dumps({"task": "t", "baseline": stage(), "candidate": None}),
        "nope",
    ]
    cases, errors = J.observations(spark.createDataFrame([("o.jsonl", i, x) for i, x in enumerate(lines, 1)], "path string, line int, raw string"))
    assert sorted((r["line"], r["error"]) for r in errors.collect()) == [
        (2, "case_id_missing_or_duplicate"), (3, "task_required"), (4, "baseline_must_be_object"), (5, "baseline_success_must_be_boolean"),
        (6, "baseline_evidence_found_must_be_boolean"), (7, "baseline_seconds_must_be_nonnegative"), (8, "baseline_seconds_must_be_nonnegative"),
        (9, "baseline_files_opened_must_be_nonnegative_integer"), (10, "candidate_must_be_object"), (12, "invalid_json"),
    ]
    by = {r["line"]: r for r in cases.collect()}
    assert set(by) == {1, 11} and by[1]["category"] == "capture" and by[1]["candidate"]["seconds"] == 3.0 and by[11]["candidate"] is None
