"""Validation: each rule family is a DataFrame of findings (severity, family, path, issue, detail)."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as X
from ..functions.parse import KIND_LIST, KIND_STRING, meta, meta_kind
from . import graph as G
from . import store

#: Paths that one finding lists.
LISTED_PATHS = 100

SEVERITY = dict.fromkeys(C.ERROR_FAMILIES, "error") | dict.fromkeys(C.WARNING_FAMILIES, "warning")


def finding(rows: DataFrame, family: str, path: Column, issue: Column, detail: Column = None) -> DataFrame:
    detail = F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit(""))
    return rows.select(F.lit(SEVERITY[family]).alias("severity"), F.lit(family).alias("family"), path.alias("path"), issue.alias("issue"), detail.alias("detail"))


def exempt() -> Column:
    """Root files, templates, skills and indexes have no schema."""
    return F.col("path").isin(*C.SCHEMA_EXEMPT_ROOT) | X.contains_any_prefix(F.col("path"), C.SCHEMA_EXEMPT)


def governed(notes: DataFrame) -> DataFrame:
    return notes.where(~exempt())


def exploded(rows: DataFrame, family: str, issues: list[Column]) -> DataFrame:
    """One finding for each struct(issue, detail) that isn't null: one pass, no join."""
    each = rows.select("path", F.explode(F.array_compact(F.array(*issues))).alias("x"))
    return finding(each, family, F.col("path"), F.col("x.issue"), F.col("x.detail"))


def when(condition: Column, issue: str, detail: Column | None = None) -> Column:
    return F.when(condition, F.struct(F.lit(issue).alias("issue"), (F.lit("") if detail is None else F.coalesce(detail.cast("string"), F.lit(""))).alias("detail")))


def _repeated(rows: DataFrame, name: str) -> DataFrame:
    """name, n and paths (the LISTED_PATHS least) of values that several notes have; :func:`members` gives all as rows."""
    rows = store.written(rows, "values")  # so that the notes are parsed once
    first = Window.partitionBy(name).orderBy("path")
    counts = rows.groupBy(name).agg(F.count("*").alias("n")).where("n > 1")
    # the least paths: of each of several parts first
    part = Window.partitionBy(name, F.pmod(F.xxhash64("path"), F.lit(32))).orderBy("path")
    least = rows.join(counts.select(name), name, "left_semi").withColumn("place", F.row_number().over(part)).where(F.col("place") <= LISTED_PATHS)
    least = least.withColumn("place", F.row_number().over(first)).where(F.col("place") <= LISTED_PATHS)
    return counts.join(least.groupBy(name).agg(F.sort_array(F.collect_list("path")).alias("paths")), name).select(name, "n", "paths")


def id_rows(notes: DataFrame) -> DataFrame:
    """id (folded), path."""
    return notes.select(X.fold(meta("id")).alias("id"), "path").where("id <> ''")


def title_rows(notes: DataFrame) -> DataFrame:
    """title (folded), path; root files, templates and redirects aside."""
    rows = notes.where(~F.col("path").isin(*C.SCHEMA_EXEMPT_ROOT) & ~F.col("path").startswith("90-system/templates/") & (F.col("type") != "redirect"))
    return rows.select(X.fold(F.col("title")).alias("title"), "path")


def duplicate_ids(notes: DataFrame) -> DataFrame:
    """id, n, paths of ids (folded) that several notes have."""
    return _repeated(id_rows(notes), "id")


def duplicate_titles(notes: DataFrame) -> DataFrame:
    """title, n, paths of titles (folded) that several notes have; root files, templates and redirects aside."""
    return _repeated(title_rows(notes), "title")


def members(rows: DataFrame, repeated: DataFrame, name: str) -> DataFrame:
    """All notes of repeated values as rows (:func:`id_rows` or :func:`title_rows`), however many one has."""
    return rows.join(repeated.select(name), name, "left_semi")


def metadata_issues(notes: DataFrame) -> DataFrame:
    out = [when(meta(k) == "", "missing", F.lit(k)) for k in C.REQUIRED_KEYS]
    out.append(when((meta("review_on") != "") & X.strict_date(meta("review_on")).isNull(), "invalid_review_on", meta("review_on")))
    out.append(when((F.col("type") != "") & ~F.col("type").isin(*C.KNOWN_TYPES), "unknown_type", F.col("type")))
    return exploded(governed(notes), "metadata_issues", out + evidence_issues())


def evidence_issues() -> list[Column]:
    """Rules for evidence records: feedback captures and code patterns."""
    feedback, pattern = meta("capture_kind") == "feedback", F.col("type") == "code-pattern"
    record = feedback | pattern
    required = feedback | F.col("status").isin("active", "accepted", "ready")
    control = r"[\x00-\x1f]"
    out = []
    for key in ("scope", "confidence"):
        odd = F.coalesce(meta_kind(key) != KIND_STRING, F.lit(False)) | meta(key).rlike(control)
        out.append(when(record & odd, "invalid_field", F.lit(key)))
        out.append(when(record & ~odd & required & (meta(key) == ""), "missing", F.lit(key)))
    out.append(when(record & (F.coalesce(meta_kind("confidence"), F.lit(KIND_STRING)) == KIND_STRING) & (meta("confidence") != "") & ~meta("confidence").isin(*C.CONFIDENCE), "invalid_confidence", meta("confidence")))
    values = F.coalesce(F.try_element_at("metadata", F.lit("evidence"))["values"], F.array().cast("array<string>"))
    odd = F.coalesce(meta_kind("evidence") != KIND_LIST, F.lit(False)) | F.exists(values, lambda v: (F.trim(v) == "") | v.rlike(control))
    out.append(when(record & odd, "invalid_field", F.lit("evidence")))
    out.append(when(record & ~odd & required & (F.size(values) == 0), "missing", F.lit("evidence")))
    verified = meta("last_verified")
    out.append(when(record & (verified != "") & X.strict_date(verified).isNull(), "invalid_field", F.lit("last_verified")))
    out.append(when(pattern & required & (verified == ""), "missing", F.lit("last_verified")))
    return out


def placement(notes: DataFrame) -> DataFrame:
    """Notes outside the home folder of their type."""
    home = F.create_map(*(F.lit(x) for kv in C.TYPE_FOLDERS.items() for x in kv))[F.col("type")]
    rows = governed(notes).withColumn("home", home).where(F.col("home").isNotNull() & ~F.col("type").isin(*C.PLACEMENT_UNCONSTRAINED) & ~X.contains_any_prefix(F.col("path"), C.PLACEMENT_EXEMPT))
    rows = rows.where(~F.startswith(F.col("path"), F.concat("home", F.lit("/"))))
    return finding(rows, "placement", F.col("path"), F.col("type"), F.col("home"))


def stale(notes: DataFrame, as_of: datetime.date, days: int = C.STALE_DAYS) -> DataFrame:
    """Active notes not updated for more than ``days`` days."""
    age = F.datediff(F.lit(as_of), X.strict_date(meta("updated")))
    rows = governed(notes).where(F.col("status") == "active").withColumn("age", age).where(F.col("age") > days)
    return finding(rows, "stale", F.col("path"), F.lit("stale"), F.col("age"))


def freshness(notes: DataFrame, as_of: datetime.date) -> DataFrame:
    mode = meta("freshness")
    known = mode.isin(*C.FRESHNESS_MODES)
    snapshot, pointer = mode == "snapshot", mode == "pointer"
    source_kind = F.coalesce(meta_kind("truth_source"), F.lit(KIND_STRING))
    verified, raw_window = X.strict_date(meta("last_verified")), meta("freshness_window_days")
    window = F.coalesce(X.positive_int(raw_window), F.lit(C.FRESHNESS_DAYS))
    start, end = meta("valid_from"), meta("valid_until")
    first, last = X.strict_date(start), X.strict_date(end)
    bounded = ~end.isin("", "present")
    age = F.datediff(F.lit(as_of), verified)
    return exploded(
        governed(notes).where(mode != ""),
        "freshness",
        [
            when(~known, "unknown_mode", mode),
            when(snapshot & X.strict_date(meta("observed")).isNull(), "snapshot_missing_observed_date"),
            when(pointer & (source_kind != KIND_STRING), "pointer_truth_source_must_be_scalar"),
            when(pointer & (source_kind == KIND_STRING) & (meta("truth_source") == ""), "pointer_missing_truth_source"),
            when(pointer & verified.isNull(), "pointer_missing_last_verified"),
            when(pointer & verified.isNotNull() & (raw_window != "") & X.positive_int(raw_window).isNull(), "invalid_freshness_window_days", raw_window),
            when(pointer & (age > window), "verification_expired", age),
            when(known & (start != "") & first.isNull(), "invalid_valid_from"),
            when(known & bounded & last.isNull(), "invalid_valid_until"),
            when(known & bounded & (last < first), "valid_until_before_valid_from"),
        ],
    )


def ai_review(notes: DataFrame) -> DataFrame:
    state = meta("ai_review")
    marked = F.contains(X.fold(F.col("body")), F.lit(C.DRAFT_CALLOUT))
    return exploded(governed(notes), "ai_review", [when(~state.isin("", "pending"), "invalid_state", state), when((state == "pending") & ~marked, "missing_visible_callout")])


def payload(body: Column) -> Column:
    """The sealed payload: between exactly one pair of marks, one line break off each side, breaks as LF; else null."""
    begin, end = F.lit(C.PAYLOAD_BEGIN), F.lit(C.PAYLOAD_END)
    times = lambda m: (F.length(body) - F.length(F.replace(body, m))) / F.length(m)
    inner = F.substring_index(F.substring_index(body, C.PAYLOAD_BEGIN, -1), C.PAYLOAD_END, 1)
    plain = F.regexp_replace(inner, "\r\n?", "\n")
    trimmed = F.regexp_replace(F.regexp_replace(plain, "^\n", ""), "\n$", "")
    return F.when((times(begin) == 1) & (times(end) == 1) & (F.locate(C.PAYLOAD_BEGIN, body) < F.locate(C.PAYLOAD_END, body)), trimmed)


def sealed(notes: DataFrame) -> DataFrame:
    """Integrity of immutable raw sources by the payload's digest."""
    rows = governed(notes).where("type = 'raw-source' and status = 'immutable'").withColumn("payload", payload(F.col("body")))
    recorded = meta(C.PAYLOAD_HASH_KEY)
    issue = F.when(F.col("payload").isNull(), "invalid_or_missing_payload_boundary").when(recorded == "", "missing_content_sha256").when(recorded != F.sha2("payload", 256), "payload_changed_after_seal")
    rows = rows.withColumn("issue", issue).where("issue is not null")
    return finding(rows, "raw_source_integrity", F.col("path"), F.col("issue"), recorded)


def raw_drafts(notes: DataFrame) -> DataFrame:
    rows = governed(notes).where("type = 'raw-source' and status <> 'immutable'")
    return finding(rows, "raw_source_drafts", F.col("path"), F.lit("draft"), F.when(F.col("status") == "", "missing").otherwise(F.col("status")))


def tag_counts(notes: DataFrame) -> DataFrame:
    """tag, n over all notes, a note counting as often as it repeats a tag."""
    return notes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def tag_vocabulary(notes: DataFrame, limit: int = C.MAX_TAGS) -> DataFrame:
    """The tags used once, if there are more than ``limit`` distinct ones."""
    counts = tag_counts(notes)
    over = counts.agg(F.count("*").alias("total")).where(F.col("total") > limit)
    rows = counts.where("n = 1").join(F.broadcast(over))  # one row or none
    return finding(rows, "tag_vocabulary", F.lit(""), F.col("tag"), F.col("total"))


def skill_pointers(stubs: DataFrame, notes: DataFrame) -> DataFrame:
    """Adapter stubs against the skill that each must refer to.

    Both are notes (path, body, metadata); a stub names its skill in code marks,
    by a path relative to its own folder.
    """
    named = F.regexp_extract_all("body", F.lit(C.SKILL_REFERENCE), F.lit(1))
    rows = stubs.select("path", meta("name").alias("name"), meta("description").alias("description"), named.alias("named"))
    folder = F.regexp_replace("path", "/[^/]*$", "")
    rows = rows.withColumn("target", F.when(F.size("named") == 1, F.replace(F.col("named")[0], F.lit("\\"), F.lit("/"))))
    rows = rows.withColumn("odd", F.col("target").rlike("^(/|[A-Za-z]:)")).withColumn("ref", F.when(~F.col("odd"), X.inside(F.concat(folder, F.lit("/"), "target"))))
    own = notes.where(F.col("path").startswith(C.SKILLS_FOLDER)).select(F.col("path").alias("ref"), meta("name").alias("c_name"), meta("description").alias("c_description"))
    rows = rows.join(own, "ref", "left")
    one, there = F.col("target").isNotNull(), F.col("c_name").isNotNull()
    usable = one & ~F.col("odd")
    return exploded(
        rows,
        "skill_pointers",
        [
            when(F.size("named") == 0, "no_canonical_reference"),
            when(F.size("named") > 1, "multiple_canonical_references"),
            when(one & F.col("odd"), "nonportable_reference", F.col("target")),
            when(usable & F.col("ref").isNull(), "outside_vault", F.col("target")),
            when(usable & ~F.col("ref").startswith(C.SKILLS_FOLDER), "unexpected_target", F.col("ref")),
            when(usable & F.col("ref").startswith(C.SKILLS_FOLDER) & ~there, "missing_target", F.col("ref")),
            when(there & (F.col("name") != F.col("c_name")), "name_mismatch", F.col("ref")),
            when(there & (F.col("description") != F.col("c_description")), "description_mismatch", F.col("ref")),
            when(there & (F.regexp_extract("path", "([^/]+)/[^/]*$", 1) != F.col("c_name")), "directory_name_mismatch", F.col("ref")),
        ],
    )


def relation_findings(notes: DataFrame) -> DataFrame:
    valid, errors = G.relations(governed(notes))
    rows = finding(errors, "typed_relation_integrity", F.col("src"), F.col("issue"), F.concat_ws(":", "relation", "target"))
    missing = G.missing_inverses(valid)
    rows = rows.unionByName(finding(missing, "typed_relation_inverses", F.col("src"), F.concat_ws(":", "relation", "missing_inverse"), F.col("dst")))
    return rows.unionByName(_cycle_rows(valid.where("relation = 'supersedes'").select("src", "dst"), "typed_relation_integrity", "supersession_cycle"))


def redirect_findings(notes: DataFrame) -> DataFrame:
    edges, found = G.redirects(governed(notes))
    rows = finding(found, "redirect_integrity", F.col("path"), F.col("issue"), F.col("target"))
    return rows.unionByName(_cycle_rows(edges, "redirect_integrity", "redirect_cycle"))


def _cycle_rows(edges: DataFrame, family: str, issue: str) -> DataFrame:
    return finding(G.rings(edges), family, F.col("ring")[0], F.lit(issue), F.array_join("ring", " -> "))


def findings(notes: DataFrame, as_of: datetime.date, assets: DataFrame | None = None, stubs: DataFrame | None = None, stale_days: int = C.STALE_DAYS, max_tags: int = C.MAX_TAGS) -> DataFrame:
    """All families over one table of notes, which is worth writing first as each family reads it; ``stubs`` are adapter notes."""
    targets = G.link_targets(notes, assets)
    edges = G.edges(targets)
    ids, titles = duplicate_ids(notes), duplicate_titles(notes)
    parts = [
        finding(G.unresolved(targets), "unresolved_links", F.col("src"), F.lit("unresolved"), F.col("target")),
        finding(ids, "duplicate_ids", F.col("paths")[0], F.col("id"), F.array_join("paths", ", ")),
        finding(titles, "duplicate_titles", F.col("paths")[0], F.col("title"), F.array_join("paths", ", ")),
        sealed(notes),
        relation_findings(notes),
        redirect_findings(notes),
        metadata_issues(notes),
        placement(notes),
        finding(G.hub_uncovered(governed(notes), edges), "moc_coverage", F.col("path"), F.col("type")),
        finding(G.orphans(notes, edges), "orphans", F.col("path"), F.lit("orphan")),
        stale(notes, as_of, stale_days),
        tag_vocabulary(notes, max_tags),
        raw_drafts(notes),
        freshness(notes, as_of),
        ai_review(notes),
        *([] if stubs is None else [skill_pointers(stubs, notes)]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def totals(found: DataFrame) -> DataFrame:
    """severity, family, n."""
    return found.groupBy("severity", "family").agg(F.count("*").alias("n"))


def exit_code(found: DataFrame, strict: bool = False) -> int:
    """1 on any error, or on any warning if strict."""
    bad = found if strict else found.where("severity = 'error'")
    return int(bool(bad.take(1)))
