"""Retrieval quality and before/after experiments."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.parse import bounded
from . import index as I
from .rank import Options, rank


class Passages:
    """Texts that are sought in many documents at once, as bytes: by eight bytes of each, from its longest word on."""

    MIX, BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(48)

    def __init__(self, texts: list[str]):
        self.texts = [t.encode() for t in texts]
        self.short = [i for i, t in enumerate(self.texts) if len(t) < 8]
        self.keys: dict[int, list[tuple[int, int]]] = {}
        for i, t in enumerate(self.texts):
            if len(t) >= 8:
                at = min(t.index(max(t.split(), key=len, default=b"")), len(t) - 8)
                self.keys.setdefault(int.from_bytes(t[at : at + 8], "little"), []).append((i, at))
        self.known = np.array(sorted(self.keys), np.uint64)
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.known * self.MIX >> self.BITS] = True

    def held(self, documents: pa.StringArray) -> set[tuple[int, int]]:
        """Places of a document and of a passage that it holds."""
        ends = np.frombuffer(documents.buffers()[1], np.int32)[documents.offset : documents.offset + len(documents) + 1]
        data = documents.buffers()[2] if len(ends) and ends[-1] else None
        own = memoryview(data).cast("B")[ends[0] : ends[-1]] if data is not None else memoryview(b"")
        ends = ends - ends[0]
        real = documents.is_valid().to_numpy(zero_copy_only=False)
        out = set()
        for shift in range(min(8, max(len(own) - 7, 0))):
            windows = np.frombuffer(own, "<u8", (len(own) - shift) // 8, shift)
            likely = np.flatnonzero(self.maybe[windows * self.MIX >> self.BITS])
            for k in likely[np.isin(windows[likely], self.known)]:
                for i, at in self.keys[int(windows[k])]:
                    start = int(k) * 8 + shift - at
                    d = int(np.searchsorted(ends, start, "right")) - 1
                    if start >= 0 and start + len(self.texts[i]) <= ends[d + 1] and own[start : start + len(self.texts[i])] == self.texts[i]:
                        out.add((d, i))
        if self.short:
            out |= {(d, i) for d in range(len(documents)) for i in self.short if real[d] and self.texts[i] in bytes(own[ends[d] : ends[d + 1]])}
        return out


def holding(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """path, case_id: the documents (path, body) that hold a passage's text, of a table of passages that the driver can hold.

    The passages go to the documents, which are read once and not moved.
    """
    bounded(documents.sparkSession)
    rows = passages.where("text is not null").select("case_id", "text").collect()
    names, sought = pa.array([r["case_id"] for r in rows], pa.string()), Passages([r["text"] for r in rows])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted(sought.held(batch["body"]))
            at, which = (pa.array([f[i] for f in found], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch["path"].take(at), names.take(which)], names=["path", "case_id"])

    return documents.select("path", "body").mapInArrow(run, "path string, case_id string")


def case_results(ranked: DataFrame, cases: DataFrame, sizes: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """A row per case: recall, first relevant rank, forbidden hits, evidence and bytes at each k.

    cases: case_id, category, expected (array of paths), and optionally
    forbidden (array) and evidence (array of paths, or of structs of path and
    heading, that hold the evidence: each counts by itself); ranked: query_id
    (the case), rank, path; sizes: path, size.
    """
    have = set(cases.columns)
    if dict(cases.dtypes).get("evidence", "").startswith("array<struct"):
        cases = cases.withColumn("evidence", F.transform("evidence", lambda e: e["path"]))
    nothing = F.array().cast("array<string>")
    cases = cases.withColumns({c: F.coalesce(c, nothing) if c in have else nothing for c in ("forbidden", "evidence")})
    cases = cases.select("case_id", "category", "expected", "forbidden", "evidence")
    rows = ranked.withColumnRenamed("query_id", "case_id").join(sizes.select("path", "size"), "path")
    running = F.sum("size").over(Window.partitionBy("case_id").orderBy("rank"))
    rows = rows.withColumn("bytes", running).join(cases, "case_id", "right")
    hit = lambda c: F.coalesce(F.array_contains(c, F.col("path")), F.lit(False))
    at = lambda c, k: F.count(F.when(hit(c) & (F.col("rank") <= k), 1))
    first = F.min(F.when(hit("expected"), F.col("rank"))).alias("first_rank")
    size = lambda c: F.max(F.size(c))
    cols: list[Column] = [first, size("forbidden").alias("n_forbidden"), size("evidence").alias("n_evidence")]
    for k in ks:
        cols.append(F.round(at("expected", k) / size("expected"), 6).alias(f"recall_{k}"))
        shown = F.sum(F.when(F.col("rank") <= k, F.size(F.filter("evidence", lambda e: e == F.col("path")))).otherwise(0))
        cols.append(F.when(size("evidence") > 0, F.round(shown / size("evidence"), 6)).alias(f"evidence_{k}"))
        cols.append(F.when(size("forbidden") > 0, (at("forbidden", k) > 0).cast("double")).alias(f"forbidden_{k}"))
        cols.append(F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("bytes"))), F.lit(0)).alias(f"bytes_{k}"))
    return rows.groupBy("case_id", "category").agg(*cols)


def metrics(results: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Macro means overall (category null) and by category, in one pass."""
    mean = lambda c, n=6: F.round(F.avg(c), n)
    cols = [F.count("*").alias("cases"), mean(F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).alias("mrr"), F.count_if(F.col("n_evidence") > 0).alias("evidence_cases"), F.count_if(F.col("n_forbidden") > 0).alias("forbidden_cases")]
    for k in ks:
        cols += [mean(f"recall_{k}").alias(f"recall_{k}"), mean(f"evidence_{k}").alias(f"evidence_{k}"), mean(f"forbidden_{k}").alias(f"forbidden_{k}"), mean(f"bytes_{k}", 2).alias(f"bytes_{k}")]
    return results.rollup("category").agg(*cols)


def evaluate(cases: DataFrame, documents: DataFrame, ks: tuple[int, ...] = (1, 3, 5), options: Options | None = None, index: I.Index | None = None) -> DataFrame:
    """Rank all cases in one plan, each with its own types and tags if it has them, and give their results; ``documents`` has a size."""
    options = options or Options(limit=max(ks))
    queries = cases.select(F.col("case_id").alias("query_id"), "query", *(c for c in ("types", "tags") if c in cases.columns))
    return case_results(rank(queries, documents, options, index), cases, documents.select("path", "size"), ks)


def threshold(metric_rows: DataFrame, ks: tuple[int, ...], least: float | None) -> DataFrame:
    """One row: the largest k, the least recall asked for there, the recall, and whether it passes."""
    k = max(ks)
    recall = F.coalesce(F.col(f"recall_{k}"), F.lit(0.0))
    passed = F.lit(True) if least is None else recall >= least
    return metric_rows.where("category is null").select(F.lit(k).alias("k"), F.lit(least).cast("double").alias("minimum_recall"), recall.alias("recall"), passed.alias("passed"))


def trial_gate(metric_rows: DataFrame) -> DataFrame:
    """Whether a trial of another ranker is justified: needs recall_5 in the metrics."""
    overall, low = F.col("category").isNull(), F.col("recall_5")
    cases = F.max(F.when(overall, F.col("cases")))
    weak = F.count_if(~overall & (F.col("cases") >= C.TRIAL_CATEGORY_CASES) & (low < C.TRIAL_CATEGORY_RECALL))
    poor = F.max(F.when(overall, low)) < C.TRIAL_RECALL
    return metric_rows.agg(cases.alias("cases"), weak.alias("weak_categories"), ((cases >= C.TRIAL_MIN_CASES) & (poor | (weak > 0))).alias("justified"))


def stage_metrics(pairs: DataFrame, stage: str) -> list[Column]:
    """Rates and exact medians of one stage (a struct column)."""
    s = F.col(stage)
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return [rate(s["success"]).alias(f"{stage}_success"), rate(s["evidence_found"]).alias(f"{stage}_evidence"), F.round(F.median(s["seconds"]), 3).alias(f"{stage}_seconds"), F.round(F.median(s["files_opened"]), 3).alias(f"{stage}_files")]


def paired_metrics(observations: DataFrame, by: str | None = None) -> DataFrame:
    """Metrics of both stages over the pairs that are complete, overall or by a column."""
    pairs = observations.where("candidate is not null")
    cols = [F.count("*").alias("pairs"), *stage_metrics(pairs, "baseline"), *stage_metrics(pairs, "candidate")]
    return pairs.groupBy(by).agg(*cols) if by else pairs.agg(*cols)


@dataclass(frozen=True)
class Limits:
    """What a rollout takes."""

    pairs: int = C.GATE_MIN_PAIRS
    captures: int = C.GATE_MIN_CAPTURES
    time_gain: float = C.GATE_TIME_GAIN
    capture_loss: float = C.GATE_CAPTURE_LOSS


def rollout_gate(observations: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row: gains, regressions and whether a rollout is supported, with the reasons."""
    pairs = observations.where("candidate is not null").withColumn("capture", F.lower("category") == "capture")
    seconds = lambda stage, only=None: F.round(F.median(F.when(only, F.col(stage)["seconds"]) if only is not None else F.col(stage)["seconds"]), 3)
    rate = lambda stage, f: F.avg(F.col(stage)[f].cast("double"))
    row = pairs.agg(
        F.count("*").alias("pairs"),
        F.count_if("capture").alias("captures"),
        seconds("baseline").alias("b"),
        seconds("candidate").alias("c"),
        seconds("baseline", F.col("capture")).alias("cb"),
        seconds("candidate", F.col("capture")).alias("cc"),
        (rate("candidate", "success") >= rate("baseline", "success")).alias("success_kept"),
        (rate("candidate", "evidence_found") >= rate("baseline", "evidence_found")).alias("evidence_kept"),
    )
    gain = F.when(F.col("b") > 0, F.round((F.col("b") - F.col("c")) / F.col("b"), 6))
    loss = F.when(F.col("cb") > 0, F.round((F.col("cc") - F.col("cb")) / F.col("cb"), 6))
    row = row.withColumns({"time_improvement": gain, "capture_regression": loss})
    kept = lambda c: F.coalesce(c, F.lit(False))
    fails = (
        F.col("pairs") < limits.pairs,
        F.col("captures") < limits.captures,
        ~kept(F.col("success_kept")),
        ~kept(F.col("evidence_kept")),
        ~kept(F.col("time_improvement") >= limits.time_gain),
        ~kept(F.col("capture_regression") <= limits.capture_loss),
    )
    reasons = F.array_compact(F.array(*(F.when(f, r) for f, r in zip(fails, C.GATE_FAILURES, strict=True))))
    supported = F.size(reasons) == 0
    row = row.withColumn("supported", supported).withColumn("reasons", F.when(supported, F.array(F.lit(C.GATE_PASSED))).otherwise(reasons))
    return row.select("pairs", "captures", "time_improvement", "capture_regression", "success_kept", "evidence_kept", F.array_join("reasons", ",").alias("reasons"), "supported")
