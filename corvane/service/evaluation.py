"""Evaluation commands over files: cases in, metrics, gates and a report out.

A command returns (exit code, payload): 0 when it passes, 1 when a threshold
or gate that was asked for fails, 2 when the input is wrong. Cases are read
and ranked in Spark; what comes to the driver is a row for each case.
"""

from __future__ import annotations

import datetime
import json
import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import evaluate, index, mutate, rank
from ..sources import judgments as J

SCHEMA_VERSION = 1


def emitted(payload: Any, compact: bool = False) -> str:
    """JSON as commands print it: one line, or indented by two; other scripts stay readable."""
    layout: dict = {"separators": (",", ":")} if compact else {"indent": 2}
    return json.dumps(payload, ensure_ascii=False, default=str, **layout)


def evals_path(root: str, requested: str, suffix: str, wrong: str) -> tuple[str, str]:
    """(absolute, relative) path of a file in the folder for evaluations; an InputError otherwise."""
    try:
        full = mutate.inside(root, requested)
    except ValueError:
        raise InputError({"error": "report_outside_vault" if suffix == ".json" else "outside_vault", "requested": requested}) from None
    relative = os.path.relpath(full, os.path.realpath(root)).replace(os.sep, "/")
    if not relative.startswith(C.EVALS_FOLDER) or os.path.splitext(relative)[1].lower() != suffix:
        raise InputError({"error": wrong, "path": relative, "allowed": f"{C.EVALS_FOLDER}*{suffix}"})
    return full, relative


class InputError(Exception):
    """Wrong input; its argument is the payload."""


def lines_of(spark: SparkSession, root: str, requested: str) -> tuple[DataFrame, str]:
    full, relative = evals_path(root, requested, ".jsonl", "cases_path_not_allowed")
    if not os.path.isfile(full):
        raise InputError({"error": "cases_not_found", "path": relative})
    files = spark.read.text(full, wholetext=True).select(F.lit(relative).alias("path"), F.col("value").alias("content"))
    return J.json_lines(files), relative


def sound(cases: DataFrame, errors: DataFrame, relative: str, kind: str) -> list:
    """The cases' rows in the order of lines; any error, or no case at all, is wrong input."""
    wrong = [{k: v for k, v in r.asDict().items() if v is not None and k != "path"} for r in errors.orderBy("line", "error").collect()]
    rows = [] if wrong else cases.orderBy("line").collect()
    if not rows and not wrong:
        wrong = [{"error": "no_cases", "path": relative}]
    if wrong:
        raise InputError({"error": f"invalid_{kind}_cases", "cases": relative, "details": wrong})
    return rows


def written(payload: dict, root: str, report: str | None) -> dict:
    """The payload, also stored as the report if one is asked for."""
    if report:
        full, relative = evals_path(root, report, ".json", "report_path_not_allowed")
        payload = payload | {"report": relative}
        os.makedirs(os.path.dirname(full), exist_ok=True)
        mutate.write_atomic(full, emitted(payload) + "\n")
    return payload


def figures(row: Any, ks: tuple[int, ...]) -> dict:
    at = lambda name: {str(k): row[f"{name}_{k}"] for k in ks}
    return {
        "case_count": row["cases"], "recall_at_k": at("recall"), "mrr": row["mrr"],
        "evidence_case_count": row["evidence_cases"], "evidence_recall_at_k": at("evidence"),
        "forbidden_case_count": row["forbidden_cases"], "forbidden_hit_rate_at_k": at("forbidden"), "mean_context_bytes_at_k": at("bytes"),
    }


def retrieval(spark: SparkSession, root: str, documents: DataFrame, requested: str, ks: tuple[int, ...] = (1, 3, 5), fuzzy: bool = False, least_recall: float | None = None, report: str | None = None, today: datetime.date | None = None) -> tuple[int, dict]:
    """Rank all judged cases with the production ranker; ``documents`` as for ranking, with size and body."""
    try:
        if least_recall is not None and not 0 <= least_recall <= 1:
            raise InputError({"error": "invalid_recall_threshold", "value": least_recall})
        lines, relative = lines_of(spark, root, requested)
        cases, errors = J.judgments(lines, documents)
        rows = sound(cases, errors, relative, "retrieval")
        options = rank.Options(limit=max(ks), fuzzy=fuzzy)
        queries = cases.select(F.col("case_id").alias("query_id"), "query", "types", "tags")
        ranked = rank.rank(queries, documents, options, index.live(index.tokenised(documents.select("path", "title", "meta", "body")))).persist()
        try:
            results = evaluate.case_results(ranked, cases, documents.select("path", "size"), ks)
            means = evaluate.metrics(results, ks)
            overall = means.where("category is null").first()
            by = {r["category"]: figures(r, ks) for r in means.where("category is not null").collect()}
            gate = evaluate.trial_gate(means).first().asDict() if 5 in ks else None
            tops = {r["query_id"]: [p["path"] for p in r["top"]] for r in ranked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "path"))).alias("top")).collect()}
            per = {r["case_id"]: r.asDict() for r in results.collect()}
        finally:
            ranked.unpersist()
        recall = overall[f"recall_{max(ks)}"]
        passed = least_recall is None or recall >= least_recall
        payload = {
            "schema_version": SCHEMA_VERSION, "engine": "lexical-bm25f", "generated_on": (today or datetime.date.today()).isoformat(), "cases": relative, "k": list(ks), "fuzzy": fuzzy,
            "metrics": figures(overall, ks), "categories": dict(sorted(by.items(), key=lambda x: x[0].casefold())),
            "results": [
                {
                    "id": r["case_id"], "category": r["category"], "expected": r["expected"], "evidence": [e.asDict() for e in r["evidence"]], "forbidden": r["forbidden"],
                    "first_relevant_rank": per[r["case_id"]]["first_rank"], "recall_at_k": {str(k): per[r["case_id"]][f"recall_{k}"] for k in ks},
                    "forbidden_hits_at_k": {str(k): sorted(set(tops.get(r["case_id"], [])[:k]) & set(r["forbidden"])) for k in ks}, "top_paths": tops.get(r["case_id"], []),
                }
                for r in rows
            ],
            "threshold": {"k": max(ks), "minimum_recall": least_recall, "passed": passed}, "semantic_gate": gate,
        }
        return int(not passed), written(payload, root, report)
    except InputError as wrong:
        return 2, wrong.args[0]


def stage_figures(row: Any, stage: str) -> dict:
    return {"success_rate": row[f"{stage}_success"], "evidence_found_rate": row[f"{stage}_evidence"], "median_seconds": row[f"{stage}_seconds"], "median_files_opened": row[f"{stage}_files"]}


def usability(spark: SparkSession, root: str, requested: str, limits: evaluate.Limits = evaluate.Limits(), must_support: bool = False, report: str | None = None, today: datetime.date | None = None) -> tuple[int, dict]:
    """Metrics and the rollout gate of recorded before/after observations, overall and by category."""
    try:
        if limits.pairs <= 0 or limits.captures <= 0:
            raise InputError({"error": "minimum_case_counts_must_be_positive"})
        for name, value in (("time_improvement", limits.time_gain), ("capture_regression", limits.capture_loss)):
            if not 0 <= value <= 1:
                raise InputError({"error": f"invalid_{name}", "value": value})
        lines, relative = lines_of(spark, root, requested)
        cases, errors = J.observations(lines)
        rows = sound(cases, errors, relative, "usability")
        both = evaluate.paired_metrics(cases).first()
        by = {r["category"]: {"baseline": stage_figures(r, "baseline"), "candidate": stage_figures(r, "candidate"), "case_count": r["pairs"]} for r in evaluate.paired_metrics(cases, "category").collect()}
        gate = evaluate.rollout_gate(cases, limits).first()
        recorded = cases.agg(*evaluate.stage_metrics(cases, "baseline")).first()
        payload = {
            "schema_version": SCHEMA_VERSION, "generated_on": (today or datetime.date.today()).isoformat(), "cases": relative, "recorded_cases": len(rows), "paired_cases": gate["pairs"],
            "recorded_baseline": stage_figures(recorded, "baseline"), "paired": {s: stage_figures(both, s) for s in ("baseline", "candidate")}, "categories": dict(sorted(by.items())),
            "gate": {
                "rollout_supported": gate["supported"], "evidence_sufficient": gate["pairs"] >= limits.pairs and gate["captures"] >= limits.captures, "paired_cases": gate["pairs"], "capture_cases": gate["captures"],
                "time_improvement": gate["time_improvement"], "capture_time_regression": gate["capture_regression"], "success_not_regressed": gate["success_kept"], "evidence_not_regressed": gate["evidence_kept"],
                "criteria": {"minimum_paired_cases": limits.pairs, "minimum_capture_cases": limits.captures, "target_time_improvement": limits.time_gain, "maximum_capture_time_regression": limits.capture_loss},
                "reasons": gate["reasons"].split(","),
            },
            "results": [{"id": r["id"], "category": r["category"], "has_candidate": r["candidate"] is not None} for r in rows],
        }
        return int(must_support and not gate["supported"]), written(payload, root, report)
    except InputError as wrong:
        return 2, wrong.args[0]
