"""Retrieval judgments and before/after observations from JSON lines.

Each line is one case. What is wrong with a line comes back as rows (path,
line, error, detail) instead of stopping the scan; a line with errors gives no
case. A case's id may be used once per file: the first sound line has it.
JSON is read as a variant, so types are checked without a schema; an object
that repeats a key counts as invalid JSON.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as X

LINE = ("path", "line")


def json_lines(files: DataFrame) -> DataFrame:
    """path, line (from 1) and raw of the non-blank lines of files (path, content)."""
    text = F.regexp_replace(F.coalesce("content", F.lit("")), "^﻿", "")
    rows = files.select("path", F.posexplode(X.lines(text)).alias("pos", "raw"))
    return rows.where(F.col("raw").rlike(r"\S")).select("path", (F.col("pos") + 1).alias("line"), "raw")


# -- values of a variant ----------------------------------------------------
def member(name: str, of: str = "item") -> Column:
    """A member as a variant: null if absent, a variant null if null."""
    return F.try_variant_get(of, f"$.{name}", "variant")


def kind(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v), F.lit("ABSENT"))


def as_string(v: Column) -> Column:
    """The text of a string, null for anything else."""
    return F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def printed(v: Column, otherwise: Column) -> Column:
    """Any value as text; ``otherwise`` if absent."""
    k = kind(v)
    text = F.when(k == "ABSENT", otherwise).when(k == "VOID", "None").when(k == "BOOLEAN", F.initcap(F.to_json(v))).when(k == "STRING", as_string(v)).otherwise(F.to_json(v))
    return F.trim(text)


def strings(v: Column) -> Column:
    """Trimmed, non-empty strings of a string or a list of strings; null for anything else."""
    items = F.try_variant_get(v, "$", "array<variant>")
    plain = F.when(kind(v) == "STRING", F.array(as_string(v))).when(F.startswith(kind(v), F.lit("ARRAY")) & F.forall(items, lambda x: kind(x) == "STRING"), F.transform(items, lambda x: as_string(x)))
    return F.filter(F.transform(plain, lambda x: F.trim(x)), lambda x: x != "")


def number(v: Column) -> Column:
    return F.when(kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(v, "$", "double"))


# -- shared steps -----------------------------------------------------------
def parsed(lines: DataFrame) -> DataFrame:
    return lines.withColumn("item", F.try_parse_json("raw"))


def first_error(checks: list[tuple[Column, str, Column | None]]) -> Column:
    """The struct (error, detail) of the first check that holds; null if none does."""
    none = F.lit(None).cast("string")
    entry = lambda error, detail: F.struct(F.lit(error).alias("error"), (none if detail is None else detail.cast("string")).alias("detail"))
    return reduce(lambda out, x: out.when(F.coalesce(x[0], F.lit(False)), entry(x[1], x[2])), checks[1:], F.when(F.coalesce(checks[0][0], F.lit(False)), entry(checks[0][1], checks[0][2])))


def shape_checks() -> list[tuple[Column, str, Column | None]]:
    return [(F.col("item").isNull(), "invalid_json", None), (~F.startswith(kind(F.col("item")), F.lit("OBJECT")), "case_must_be_object", None)]


def settled(rows: DataFrame, sound: Column) -> tuple[DataFrame, DataFrame]:
    """(cases, lines whose id is missing or taken), of rows with case_id; ``sound`` tells lines without an error of their own."""
    holder = F.min(F.when(sound & (F.col("case_id") != ""), F.col("line"))).over(Window.partitionBy("path", "case_id"))
    rows = rows.withColumn("holder", holder)
    taken = (F.col("case_id") == "") | F.coalesce(F.col("line") > F.col("holder"), F.lit(False))
    return rows.where(~taken & sound).drop("holder"), rows.where(taken).select(*LINE, F.lit("case_id_missing_or_duplicate").alias("error"), F.col("case_id").alias("detail"))


def errors_of(rows: DataFrame, column: str = "wrong") -> DataFrame:
    return rows.where(F.col(column).isNotNull()).select(*LINE, f"{column}.error", f"{column}.detail")


# -- judgments --------------------------------------------------------------
def judgments(lines: DataFrame, notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, errors) of lines (path, line, raw) against the corpus (notes: path, body).

    cases: path, line, case_id, category, query, expected, types, tags,
    forbidden, evidence (structs of path and heading).
    """
    rows = parsed(lines).select(
        *LINE,
        "item",
        as_string(member("query")).alias("query"),
        strings(member("expected")).alias("expected"),
        *(F.when(kind(member(m)) == "ABSENT", F.array().cast("array<string>")).otherwise(strings(member(m))).alias(c) for m, c in (("type", "types"), ("tags", "tags"), ("forbidden", "forbidden"))),
        F.when(kind(member("evidence")) == "ABSENT", F.array().cast("array<variant>")).when(F.startswith(kind(member("evidence")), F.lit("ARRAY")), F.try_variant_get(member("evidence"), "$", "array<variant>")).alias("evidence"),
        printed(member("id"), F.concat(F.lit("line-"), F.col("line"))).alias("case_id"),
        F.coalesce(F.nullif(printed(member("category"), F.lit("default")), F.lit("")), F.lit("default")).alias("category"),
    )
    checks = [
        *shape_checks(),
        (F.coalesce(F.trim("query"), F.lit("")) == "", "query_required", None),
        (F.coalesce(F.size("expected"), F.lit(0)) <= 0, "expected_required", None),
        (F.col("types").isNull() | F.col("tags").isNull(), "filters_must_be_strings", None),
        (F.col("forbidden").isNull(), "forbidden_must_be_strings", None),
        (F.col("evidence").isNull(), "evidence_must_be_array", None),
    ]
    rows = rows.withColumn("wrong", first_error(checks))
    sound = rows.where("wrong is null").drop("item", "wrong")
    named = _references(sound)
    plain = lambda h: X.fold(F.trim(F.regexp_replace(F.trim(h), "#+$", "")))
    known = notes.select(F.col("path").alias("target"), F.transform(F.regexp_extract_all("body", F.lit(r"(?m)^(#{1,6})\s+(.+?)\s*$"), F.lit(2)), plain).alias("headings"))
    met = named.join(known, "target", "left")
    # what a case expects decides about the rest of it
    wanted = F.collect_set(F.when(F.col("role") == "expected", F.col("target"))).over(Window.partitionBy(*LINE))
    met = met.withColumn("wanted", wanted)
    absent = F.col("headings").isNull() | ~F.lower("target").endswith(".md")
    role = lambda r: F.col("role") == r
    checks = [
        (role("expected") & F.col("target").isNull(), "expected_outside_vault", F.col("value")),
        (role("expected") & absent, "expected_note_not_found", F.col("target")),
        (role("expected") & X.contains_any_prefix(F.col("target"), C.RETRIEVAL_EXCLUDED), "expected_note_excluded", F.col("target")),
        (role("forbidden") & F.col("target").isNull(), "forbidden_outside_vault", F.col("value")),
        (role("forbidden") & absent, "forbidden_note_not_found", F.col("target")),
        (role("forbidden") & F.array_contains("wanted", F.col("target")), "forbidden_note_is_expected", F.col("target")),
        (role("evidence") & ~F.col("is_object"), "evidence_must_be_object", None),
        (role("evidence") & (F.coalesce(F.trim("value"), F.lit("")) == ""), "evidence_path_required", None),
        (role("evidence") & (F.coalesce(F.trim("heading"), F.lit("")) == ""), "evidence_heading_required", None),
        (role("evidence") & F.col("target").isNull(), "evidence_outside_vault", F.col("value")),
        (role("evidence") & ~F.array_contains("wanted", F.col("target")), "evidence_path_not_expected", F.col("target")),
        (role("evidence") & ~F.coalesce(F.array_contains("headings", X.fold(F.col("clean"))), F.lit(False)), "evidence_heading_not_found", F.concat_ws("#", "target", "clean")),
    ]
    met = met.withColumn("clean", F.trim(F.regexp_replace(F.trim("heading"), "^#+", ""))).withColumn("wrong", first_error(checks))
    # a wrong expected note ends the line: its other references aren't looked at
    ends = F.max(role("expected") & F.col("wrong").isNotNull()).over(Window.partitionBy(*LINE))
    met = met.withColumn("ends", ends)
    wrong = met.where(F.col("wrong").isNotNull() & (~F.col("ends") | role("expected")))
    found = lambda r, c: F.array_sort(F.collect_list(F.when(role(r), F.struct("pos", c.alias("v")))))
    per = met.groupBy(*LINE).agg(
        F.count_if(F.col("wrong").isNotNull()).alias("n_wrong"),
        *(F.array_distinct(F.transform(found(r, F.col("target")), lambda x: x["v"])).alias(c) for r, c in (("expected", "expected"), ("forbidden", "forbidden"))),
        F.transform(found("evidence", F.struct(F.col("target").alias("path"), F.col("clean").alias("heading"))), lambda x: x["v"]).alias("evidence"),
    )
    cases, taken = settled(sound.drop("expected", "forbidden", "evidence").join(per, list(LINE)), F.col("n_wrong") == 0)
    wrong = errors_of(wrong).join(taken.select(*LINE), list(LINE), "left_anti")
    cases = cases.select(*LINE, "case_id", "category", F.trim("query").alias("query"), "expected", "types", "tags", "forbidden", "evidence")
    return cases, errors_of(rows).unionByName(wrong).unionByName(taken)


def _references(rows: DataFrame) -> DataFrame:
    """path, line, role, pos, value, heading, is_object and target: a row for each note that a line names."""
    text = F.lit(None).cast("string")
    plain = lambda c: F.transform(F.col(c), lambda v, i: F.struct(F.lit(c).alias("role"), i.alias("pos"), v.alias("value"), text.alias("heading"), F.lit(True).alias("is_object")))
    of = lambda v, m: as_string(F.try_variant_get(v, f"$.{m}", "variant"))
    proof = F.transform("evidence", lambda v, i: F.struct(F.lit("evidence").alias("role"), i.alias("pos"), of(v, "path").alias("value"), of(v, "heading").alias("heading"), F.startswith(kind(v), F.lit("OBJECT")).alias("is_object")))
    each = rows.select(*LINE, F.explode(F.concat(plain("expected"), plain("forbidden"), proof)).alias("r")).select(*LINE, "r.*")
    return each.withColumn("target", X.inside(F.col("value")))


# -- observations -----------------------------------------------------------
def observations(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, errors) of before/after observations.

    cases: path, line, case_id, task, category, baseline and candidate (structs
    of success, evidence_found, seconds, files_opened; candidate may be null).
    """
    stages = ("baseline", "candidate")
    rows = parsed(lines).select(
        *LINE,
        "item",
        as_string(member("task")).alias("task"),
        printed(member("id"), F.concat(F.lit("line-"), F.col("line"))).alias("case_id"),
        X.fold(F.coalesce(F.nullif(printed(member("category"), F.lit("find")), F.lit("")), F.lit("find"))).alias("category"),
        *(F.when(~kind(member(s)).isin("ABSENT", "VOID"), member(s)).alias(s) for s in stages),
    )
    flag = lambda s, m: F.when(kind(member(m, s)) == "BOOLEAN", F.try_variant_get(s, f"$.{m}", "boolean"))
    seconds = lambda s: F.when(number(member("seconds", s)) >= 0, number(member("seconds", s)))
    files = lambda s: F.when(kind(member("files_opened", s)) == "BIGINT", F.try_variant_get(s, "$.files_opened", "bigint"))

    def stage_checks(s: str) -> list[tuple[Column, str, Column | None]]:
        there = F.lit(True) if s == "baseline" else F.col(s).isNotNull()
        return [
            (there & ~F.startswith(kind(F.col(s)), F.lit("OBJECT")), f"{s}_must_be_object", None),
            (there & flag(s, "success").isNull(), f"{s}_success_must_be_boolean", None),
            (there & flag(s, "evidence_found").isNull(), f"{s}_evidence_found_must_be_boolean", None),
            (there & (seconds(s).isNull() | F.isnan(seconds(s)) | (seconds(s) == float("inf"))), f"{s}_seconds_must_be_nonnegative", None),
            (there & ~F.coalesce(files(s) >= 0, F.lit(False)), f"{s}_files_opened_must_be_nonnegative_integer", None),
        ]

    own = [(F.coalesce(F.trim("task"), F.lit("")) == "", "task_required", None), *stage_checks("baseline"), *stage_checks("candidate")]
    rows = rows.withColumn("shape", first_error(shape_checks())).withColumn("wrong", first_error(own))
    sound = rows.where("shape is null")
    cases, taken = settled(sound, F.col("wrong").isNull())
    wrong = errors_of(sound).join(taken.select(*LINE), list(LINE), "left_anti")
    stage = lambda s: F.when(F.col(s).isNotNull(), F.struct(flag(s, "success").alias("success"), flag(s, "evidence_found").alias("evidence_found"), seconds(s).alias("seconds"), files(s).cast("int").alias("files_opened")))
    cases = cases.select(*LINE, F.col("case_id").alias("id"), F.trim("task").alias("task"), "category", *(stage(s).alias(s) for s in stages))
    return cases, errors_of(rows, "shape").unionByName(wrong).unionByName(taken)
