"""Further queries over the driver's tables: rules that need notes of special kinds, judgments, redirects, signals."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formats
from ..functions import text as X
from ..functions.parse import notes
from ..operators import checks, evaluate, graph, index, rank, readability, reports, store, views
from ..sources import clips, judgments, viewfiles
from ..streaming import dispatch, sessions, transcripts
from . import render as R
from . import sql as Q
from .queries import KS, ORACLES, QUERIES, TOPICS, _cases, asked, query

S = F.lit


# -- notes of special kinds -------------------------------------------------
KINDS = ("bug", "incident", "experiment", "concept", "code-pattern", "note")
HOMES = ("10-projects", "10-projects", "10-projects", "40-knowledge/concepts", "40-knowledge/concepts", "00-inbox")


def kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A note for each part: work items, concepts, patterns and inbox notes, with review and evidence metadata."""
    k = F.col("p_partkey")
    of = lambda names: F.element_at(F.array(*(S(n) for n in names)), (F.floor(k % 24 / 4) + 1).cast("int"))
    head = [
        ("id", F.concat(S("kind-"), k)), ("type", of(KINDS)), ("status", F.when(k % 5 == 0, "draft").otherwise("active")), ("created", S("2020-01-01")), ("updated", S("2020-01-02")),
        ("ai_review", F.when(k % 4 == 0, "pending").when(k % 4 == 1, "odd")), ("capture_kind", F.when(k % 7 < 3, "feedback")), ("scope", F.when(k % 7 != 0, "repo")),
        ("confidence", F.when(k % 8 == 0, "sure").otherwise("observed")), ("evidence", F.when(k % 9 != 0, '["a log"]')),
        ("last_verified", F.when(k % 11 == 0, "2020-13-01").when(k % 11 < 6, "2020-01-02")),
    ]
    body = F.concat(S("# Kind "), k, S("\n\n"), F.when(k % 8 == 0, "> [!WARNING] AI draft\n").otherwise("Text.\n"))
    return notes(R.table(spark, sf_dir, "part").select(*R.file(F.concat(of(HOMES), S("/kind-"), k, S(".md")), head, body)))


_K = f"(SELECT p_partkey AS k, [{', '.join(repr(n) for n in KINDS)}][p_partkey % 24 // 4 + 1] AS type, concat([{', '.join(repr(n) for n in HOMES)}][p_partkey % 24 // 4 + 1], '/kind-', p_partkey, '.md') AS path FROM part)"
for _name, _where in {
    "Investigations": "type IN ('bug', 'incident', 'experiment')",
    "Concepts": "type = 'concept'",
    "Patterns": "type = 'code-pattern'",
    "AI review": "k % 4 = 0",
    "Feedback": "type = 'note' AND k % 7 < 3 AND k % 4 = 0",
}.items():
    _key = "view_" + _name.lower().replace(" ", "_")
    QUERIES[_key] = lambda spark, sf_dir, name=_name: views.view(kinds(spark, sf_dir), name, views.Context(datetime.date(2020, 6, 1))).select("path")
    ORACLES[_key] = f"SELECT path FROM {_K} WHERE {_where}"


@query(f"SELECT path, 'invalid_state' AS issue, 'odd' AS detail FROM {_K} WHERE k % 4 = 1 UNION ALL SELECT path, 'missing_visible_callout', '' FROM {_K} WHERE k % 4 = 0 AND k % 8 <> 0")
def ai_review_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.ai_review(kinds(spark, sf_dir)).select("path", "issue", "detail")


_RECORD = "(type = 'code-pattern' OR k % 7 < 3)"
_DUE = "(k % 7 < 3 OR k % 5 <> 0)"


@query(
    f"""SELECT path, 'missing' AS issue, 'scope' AS detail FROM {_K} WHERE {_RECORD} AND {_DUE} AND k % 7 = 0
UNION ALL SELECT path, 'invalid_confidence', 'sure' FROM {_K} WHERE {_RECORD} AND k % 8 = 0
UNION ALL SELECT path, 'missing', 'evidence' FROM {_K} WHERE {_RECORD} AND {_DUE} AND k % 9 = 0
UNION ALL SELECT path, 'invalid_field', 'last_verified' FROM {_K} WHERE {_RECORD} AND k % 11 = 0
UNION ALL SELECT path, 'missing', 'last_verified' FROM {_K} WHERE type = 'code-pattern' AND {_DUE} AND k % 11 >= 6"""
)
def evidence_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.metadata_issues(kinds(spark, sf_dir)).select("path", "issue", "detail")


def _mixed(spark: SparkSession, sf_dir: str, even: str, odd: str, name: str, head: list, body: Column) -> DataFrame:
    """Notes of nations, even and odd ones in different folders."""
    k = F.col("n_nationkey")
    path = F.concat(F.when(k % 2 == 0, even).otherwise(odd), S(f"/{name}-"), k, S(".md"))
    return notes(R.table(spark, sf_dir, "nation").select(*R.file(path, head, body)))


@query("SELECT concat('20-areas/n-', n_nationkey, '.md') AS path, 'missing' AS issue, unnest(['id', 'status', 'created', 'updated']) AS detail FROM nation WHERE n_nationkey % 2 = 1")
def schema_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates needn't have the required keys."""
    table = _mixed(spark, sf_dir, "90-system/templates", "20-areas", "n", [("type", S("area"))], F.concat(S("# "), F.col("n_name"), S("\n")))
    return checks.metadata_issues(table).select("path", "issue", "detail")


@query("SELECT concat('40-knowledge/nation-', n_nationkey, '.md') AS path, concat('nat-', n_regionkey, ' ', CASE WHEN n_regionkey < 2 THEN 'moc' ELSE 'resource' END, ' active 2020-01-01 2020-01-02') AS meta_text FROM nation")
def metadata_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(R.nations(spark, sf_dir)).select("path", "meta_text")


@query(
    """WITH h AS (SELECT concat(CASE WHEN p_size % 2 = 0 THEN '10-projects' ELSE '30-resources' END, '/part-', p_partkey, '.md') AS path, unnest([p_name, 'Use', CASE WHEN p_size % 3 = 0 THEN 'Deep' ELSE 'Near' END, 'Not one', CASE WHEN p_size % 2 = 0 THEN 'USE' ELSE 'End' END]) AS heading FROM part)
SELECT path, heading FROM h"""
)
def heading_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes(R.parts(spark, sf_dir)).select("path", F.explode("headings").alias("heading"))


@query("SELECT concat('30-resources/sources/raw/r-', n_nationkey, '.md') AS path, concat('around-', n_nationkey) AS link FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT concat('50-journal/daily/r-', n_nationkey, '.md'), unnest([concat('within-', n_nationkey), concat('around-', n_nationkey)]) FROM nation WHERE n_nationkey % 2 = 1")
def payload_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links within an untrusted payload don't count; in other notes the marks mean nothing."""
    k = F.col("n_nationkey")
    body = F.concat(S("# R\n\n" + R.PAYLOAD_BEGIN + "\n[[within-"), k, S("]]\n" + R.PAYLOAD_END + "\n\n[[around-"), k, S("]]\n"))
    table = _mixed(spark, sf_dir, "30-resources/sources/raw", "50-journal/daily", "r", [("type", F.when(k % 2 == 0, "raw-source").otherwise("journal"))], body)
    return table.select("path", F.explode("links").alias("link"))


@query(
    """SELECT concat('20-areas/i-', n_nationkey, '.md') AS src, concat('pic-', n_nationkey, '.png') AS target, CASE WHEN n_nationkey % 3 <> 0 THEN concat('99-attachments/pic-', n_nationkey, '.png') END AS asset FROM nation WHERE n_nationkey % 2 = 0
UNION ALL SELECT concat('30-resources/i-', n_nationkey, '.md'), concat('99-attachments/pic-', n_nationkey, '.png'), CASE WHEN n_nationkey % 3 <> 0 THEN concat('99-attachments/pic-', n_nationkey, '.png') END FROM nation WHERE n_nationkey % 2 = 1"""
)
def links_to_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even notes name a picture, odd ones give its path; every third picture is missing."""
    k = F.col("n_nationkey")
    link = F.concat(F.when(k % 2 == 0, "![[").otherwise("![[99-attachments/"), S("pic-"), k, S(".png|300]]\n"))
    table = _mixed(spark, sf_dir, "20-areas", "30-resources", "i", [("type", S("area"))], F.concat(S("# I\n\n"), link))
    assets = R.table(spark, sf_dir, "nation").where(k % 3 != 0).select(F.concat(S("99-attachments/pic-"), k, S(".png")).alias("path"))
    return graph.link_targets(table, assets).select("src", "target", "asset")


# -- redirects and cycles ---------------------------------------------------
def _redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of nations, and a redirect for each customer: to two notes, nowhere, itself, the next redirect or its nation."""
    k = F.col("c_custkey")
    target = F.when(k % 5 == 0, "[one, two]").when(k % 5 == 1, '"[[nowhere]]"').when(k % 5 == 2, F.concat(S('"[[r-'), k, S(']]"')))
    target = target.when(k % 5 == 3, F.concat(S('"[[r-'), k + 1, S(']]"'))).otherwise(F.concat(S('"[[nation-'), F.col("c_nationkey"), S(']]"')))
    head = [("id", F.concat(S("r-"), k)), ("type", S("redirect")), ("status", F.when(k % 4 != 0, "superseded").otherwise("active")), ("redirect_to", target)]
    own = R.table(spark, sf_dir, "customer").select(*R.file(F.concat(S("80-archive/r-"), k, S(".md")), head, S("# Moved\n")))
    return notes(R.nations(spark, sf_dir).union(own))


_R = "concat('80-archive/r-', c_custkey, '.md')"


@query(
    f"""SELECT {_R} AS path, 'redirect_status_must_be_superseded' AS issue, '' AS target FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT {_R}, 'redirect_to_must_be_one_wikilink', '' FROM customer WHERE c_custkey % 5 = 0
UNION ALL SELECT {_R}, 'redirect_target_missing', 'nowhere' FROM customer WHERE c_custkey % 5 = 1
UNION ALL SELECT {_R}, 'redirect_targets_self', '' FROM customer WHERE c_custkey % 5 = 2
UNION ALL SELECT {_R}, CASE WHEN c_custkey < m THEN 'redirect_chain' ELSE 'redirect_target_missing' END, CASE WHEN c_custkey < m THEN concat('80-archive/r-', c_custkey + 1, '.md') ELSE concat('r-', c_custkey + 1) END
FROM customer, (SELECT max(c_custkey) AS m FROM customer) WHERE c_custkey % 5 = 3"""
)
def redirect_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.redirects(_redirects(spark, sf_dir))[1]


@query(f"SELECT {_R} AS path FROM customer WHERE c_custkey % 5 = 4 AND c_nationkey = 3")
def redirects_to_a_note(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.inbound_redirects(_redirects(spark, sf_dir), "40-knowledge/nation-3.md")


@query(
    """WITH g AS (SELECT s_suppkey // 3 AS g, list(concat('s-', s_suppkey) ORDER BY s_suppkey) AS p FROM supplier GROUP BY 1 HAVING count(*) = 3)
SELECT CASE least(p[1], p[2], p[3]) WHEN p[1] THEN concat_ws(' > ', p[1], p[2], p[3]) WHEN p[2] THEN concat_ws(' > ', p[2], p[3], p[1]) ELSE concat_ws(' > ', p[3], p[1], p[2]) END AS ring FROM g"""
)
def supersession_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers that supersede each other in threes, and each the one three before, which closes nothing."""
    k = F.col("s_suppkey")
    node = lambda c: F.concat(S("s-"), c)
    own = R.table(spark, sf_dir, "supplier")
    edges = own.select(node(k).alias("src"), node(F.when(k % 3 == 2, k - 2).otherwise(k + 1)).alias("dst")).union(own.where(k % 3 == 0).select(node(k), node(k - 3)))
    held = own.select(node(k).alias("dst"))
    return graph.rings(edges.join(held, "dst", "left_semi").select("src", "dst")).select(F.array_join("ring", " > ").alias("ring"))


# -- reports and readability ------------------------------------------------
@query("WITH t AS (SELECT count(DISTINCT c_mktsegment) + count(*) FILTER (c_custkey % 10 = 0) AS n FROM customer) SELECT concat('only-', c_custkey) AS issue, n::VARCHAR AS detail FROM customer, t WHERE c_custkey % 10 = 0 AND n > 60")
def tag_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of customers: the segment, and for every tenth a tag of its own."""
    k = F.col("c_custkey")
    tags = F.concat(S("["), F.col("c_mktsegment"), F.when(k % 10 == 0, F.concat(S(", only-"), k)).otherwise(""), S("]"))
    table = R.table(spark, sf_dir, "customer").select(*R.file(F.concat(S("40-knowledge/people/c-"), k, S(".md")), [("tags", tags)], S("# C\n")))
    return checks.tag_vocabulary(notes(table)).select("issue", "detail")


@query(f"SELECT tag, n FROM ({Q.TAGS}) WHERE n >= 40")
def tags_least(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tags(notes(R.customers(spark, sf_dir).union(R.parts(spark, sf_dir))), 40)


@query(f"SELECT * FROM ({Q.tasks('O')}) WHERE starts_with(path, '10-projects/order-1')")
def tasks_in_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tasks(notes(R.task_orders(spark, sf_dir)), "open", "10-projects/order-1").select("path", "line", "text")


_WORDS = lambda x: f"len(regexp_extract_all({x}, '{Q.WORD}'))"


@query(
    f"""WITH d AS (SELECT doc_id, replace(replace(text, '#', ' '), '`', ' ') AS t FROM documents), w AS (SELECT doc_id, {_WORDS('t')} AS n FROM d)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'missing_lead' ELSE 'buried_lead' END AS issue, (n + CASE doc_id % 3 WHEN 0 THEN 1 ELSE 3 END)::INTEGER AS words
FROM w WHERE (doc_id % 3 = 0 AND n + 1 >= 250) OR (doc_id % 3 = 1 AND n + 1 > 120)"""
)
def lead_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a lead, with a late one, and with one at the start."""
    k, text = F.col("doc_id"), F.replace(F.replace("text", S("#"), S(" ")), S("`"), S(" "))
    lead = S("## Summary\n\nShort\n\n")
    body = F.when(k % 3 == 0, F.concat(S("# T\n\n"), text)).when(k % 3 == 1, F.concat(S("# T\n\n"), text, S("\n\n"), lead)).otherwise(F.concat(S("# T\n\n"), lead, text))
    table = R.table(spark, sf_dir, "documents").select(k.cast("string").alias("path"), body.alias("content"))
    return readability.leads(notes(table)).select(F.col("path").cast("bigint").alias("doc_id"), "issue", "words")


# -- retrieval --------------------------------------------------------------
@query(Q.ranked(TOPICS, limit=10, where="NOT starts_with(path, 'en/')"))
def bm25f_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excluded folders count in the statistics and are never returned."""
    documents = R.corpus(spark, sf_dir)
    options = rank.Options(limit=10, prefix=False, phrase=False, excluded=("en/",))
    return rank.rank(asked(spark, TOPICS), documents, options, index.stored(documents)).select("query_id", "rank", "path", F.round("score", 6).alias("score"))


@query(f"WITH {Q.case_rows()} SELECT 5 AS k, 0.5::DOUBLE AS minimum_recall, round(avg(round(r5, 6)), 6) AS recall, round(avg(round(r5, 6)), 6) >= 0.5 AS passed FROM c")
def eval_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, cases = _cases(spark, sf_dir)
    results = evaluate.evaluate(cases, d, KS, rank.Options(limit=5, prefix=False, phrase=False), index.stored(d, inverted=False))
    return evaluate.threshold(evaluate.metrics(results, KS), KS, 0.5)


@query(f"WITH {Q.case_rows()}, h AS (SELECT case_id, CASE WHEN case_id IN (SELECT concat('b', item_id) FROM benchmark WHERE item_id % 2 = 0) THEN r5 END AS v FROM c) SELECT count(v) AS forbidden_cases, round(avg((v > 0)::INTEGER), 6) AS forbidden_5, count(v) AS evidence_cases, round(avg(round(v, 6)), 6) AS evidence_5 FROM h")
def eval_evidence_and_forbidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For the even items what is expected is evidence too, and forbidden."""
    d, cases = _cases(spark, sf_dir)
    even = F.substring("case_id", 2, 20).cast("int") % 2 == 0
    proof = F.transform("expected", lambda p: F.struct(p.alias("path"), S("any").alias("heading")))
    nothing = F.array().cast("array<struct<path: string, heading: string>>")
    cases = cases.withColumns({"forbidden": F.when(even, F.col("expected")).otherwise(F.array().cast("array<string>")), "evidence": F.when(even, proof).otherwise(nothing)})
    results = evaluate.evaluate(cases, d, KS, rank.Options(limit=5, prefix=False, phrase=False), index.stored(d, inverted=False))
    return evaluate.metrics(results, KS).where("category is null").select("forbidden_cases", "forbidden_5", "evidence_cases", "evidence_5")


# -- cases from lines -------------------------------------------------------
def _lines(spark: SparkSession, sf_dir: str, raw: Column) -> DataFrame:
    return R.table(spark, sf_dir, "supplier").select(S("90-system/evals/c.jsonl").alias("path"), F.col("s_suppkey").cast("int").alias("line"), raw.alias("raw"))


def _judgments(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("s_suppkey")
    note = F.concat(S('"40-knowledge/nation-'), F.col("s_nationkey"), S('.md"'))
    case = lambda *more: F.concat(S('{"query": "q", "expected": ['), note, S("]"), *more, S("}"))
    raw = F.when(k % 8 == 0, "{").when(k % 8 == 1, case(S(', "id": "s'), k, S('", "tags": "x"'))).when(k % 8 == 2, F.concat(S('{"expected": '), note, S("}")))
    raw = raw.when(k % 8 == 3, '{"query": "q", "expected": [1]}').when(k % 8 == 4, '{"query": "q", "expected": "../x.md"}').when(k % 8 == 5, F.concat(S('{"query": "q", "expected": "nowhere-'), k, S('.md"}')))
    raw = raw.when(k % 8 == 6, case(S(', "evidence": [{"path": '), note, S(', "heading": "none"}]'))).otherwise(case(S(', "id": "same"')))
    return judgments.judgments(_lines(spark, sf_dir, raw), notes(R.nations(spark, sf_dir)))


_SAME = "(SELECT min(s_suppkey) FROM supplier WHERE s_suppkey % 8 = 7)"


@query(
    f"""SELECT s_suppkey::INTEGER AS line, CASE s_suppkey % 8 WHEN 0 THEN 'invalid_json' WHEN 2 THEN 'query_required' WHEN 3 THEN 'expected_required' WHEN 4 THEN 'expected_outside_vault' WHEN 5 THEN 'expected_note_not_found'
WHEN 6 THEN 'evidence_heading_not_found' ELSE 'case_id_missing_or_duplicate' END AS error, CASE s_suppkey % 8 WHEN 4 THEN '../x.md' WHEN 5 THEN concat('nowhere-', s_suppkey, '.md')
WHEN 6 THEN concat('40-knowledge/nation-', s_nationkey, '.md#none') WHEN 7 THEN 'same' END AS detail FROM supplier WHERE s_suppkey % 8 NOT IN (1, 7) OR (s_suppkey % 8 = 7 AND s_suppkey > {_SAME})"""
)
def judgment_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _judgments(spark, sf_dir)[1].select("line", "error", "detail")


@query(
    f"""SELECT s_suppkey::INTEGER AS line, CASE s_suppkey % 8 WHEN 1 THEN concat('s', s_suppkey) ELSE 'same' END AS case_id, 'default' AS category, concat('40-knowledge/nation-', s_nationkey, '.md') AS expected,
CASE s_suppkey % 8 WHEN 1 THEN 'x' ELSE '' END AS tags FROM supplier WHERE s_suppkey % 8 = 1 OR s_suppkey = {_SAME}"""
)
def judgment_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _judgments(spark, sf_dir)[0]
    return cases.select("line", "case_id", "category", F.array_join("expected", "|").alias("expected"), F.array_join("tags", "|").alias("tags"))


@query(
    """SELECT s_suppkey::INTEGER AS line, CASE s_suppkey % 7 WHEN 1 THEN 'task_required' WHEN 2 THEN 'baseline_must_be_object' WHEN 3 THEN 'baseline_success_must_be_boolean' WHEN 4 THEN 'baseline_seconds_must_be_nonnegative'
ELSE 'candidate_files_opened_must_be_nonnegative_integer' END AS error FROM supplier WHERE s_suppkey % 7 BETWEEN 1 AND 5"""
)
def observation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    stage = lambda success="true", seconds="1.5", files="2": f'{{"success": {success}, "evidence_found": true, "seconds": {seconds}, "files_opened": {files}}}'
    case = lambda task, base, more="": F.concat(S(f'{{"id": "'), k, S(f'", "task": "{task}", "baseline": {base}{more}}}'))
    raw = F.when(k % 7 == 1, case(" ", stage())).when(k % 7 == 2, case("t", "[]")).when(k % 7 == 3, case("t", stage(success="1"))).when(k % 7 == 4, case("t", stage(seconds="-1")))
    raw = raw.when(k % 7 == 5, case("t", stage(), f', "candidate": {stage(files="1.5")}')).otherwise(case("t", stage(), f', "candidate": {stage()}'))
    return judgments.observations(_lines(spark, sf_dir, raw))[1].select("line", "error")


# -- pointers ---------------------------------------------------------------
@query(
    """WITH s AS (SELECT s_suppkey AS k, concat('.agents/skills/s', s_suppkey, '/SKILL.md') AS path, concat('90-system/skills/s', s_suppkey, '/SKILL.md') AS ref FROM supplier)
SELECT path, 'no_canonical_reference' AS issue, '' AS detail FROM s WHERE k % 6 = 0 UNION ALL SELECT path, 'multiple_canonical_references', '' FROM s WHERE k % 6 = 1
UNION ALL SELECT path, 'missing_target', concat('90-system/skills/no', k, '/SKILL.md') FROM s WHERE k % 6 = 2 UNION ALL SELECT path, 'outside_vault', concat('../../../../../90-system/skills/s', k, '/SKILL.md') FROM s WHERE k % 6 = 3
UNION ALL SELECT path, 'description_mismatch', ref FROM s WHERE k % 6 = 4"""
)
def skill_pointers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    own = R.table(spark, sf_dir, "supplier")
    note = lambda description, body: F.concat(S("---\nname: s"), k, S("\ndescription: "), description, S("\n---\n"), body, S("\n"))
    to = lambda up, name: F.concat(S("`" + "../" * up + "90-system/skills/"), S(name), k, S("/SKILL.md`"))
    body = F.when(k % 6 == 0, "nothing").when(k % 6 == 1, F.concat(to(3, "s"), to(3, "no"))).when(k % 6 == 2, to(3, "no")).when(k % 6 == 3, to(5, "s")).otherwise(to(3, "s"))
    stubs = own.select(F.concat(S(".agents/skills/s"), k, S("/SKILL.md")).alias("path"), note(F.when(k % 6 == 4, "other").otherwise("same"), body).alias("content"))
    skills = own.select(F.concat(S("90-system/skills/s"), k, S("/SKILL.md")).alias("path"), note(S("same"), S("x")).alias("content"))
    return checks.skill_pointers(notes(stubs), notes(skills)).select("path", "issue", "detail")


# -- sessions ---------------------------------------------------------------
def _hooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as session activity with hooks: sign-ups end a turn, errors submit a prompt."""
    e = R.table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "view", "turn").when(F.col("event_type") == "click", "edit").when(F.col("event_type") == "purchase", "capture").otherwise("hook")
    event = F.when(F.col("event_type") == "signup", "Stop").when(F.col("event_type") == "error", "UserPromptSubmit")
    flag = lambda c: c.cast("boolean")
    return e.select(
        F.col("user_id").cast("string").alias("session"), F.col("event_id").cast("bigint").alias("seq"), kind.alias("kind"), S("").alias("path"), S("").alias("call"), event.alias("event"), F.unix_timestamp("ts").cast("double").alias("at"),
        flag(F.col("user_id") % 2 == 0).alias("stop_continues"), flag(F.col("user_id") % 10 == 0).alias("in_corpus"), *(S(False).alias(c) for c in ("plan", "extended", "agent")),
    )


@query(
    """WITH RECURSIVE e AS (SELECT user_id AS u, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, CASE event_type WHEN 'view' THEN 'turn' WHEN 'click' THEN 'edit' WHEN 'purchase' THEN 'capture' WHEN 'signup' THEN 'Stop' ELSE 'UserPromptSubmit' END AS k, floor(epoch(ts))::DOUBLE AS t FROM events),
r AS (SELECT DISTINCT u, 0::BIGINT AS i, 0::BIGINT AS turns, 0::BIGINT AS edits, false AS held, NULL::DOUBLE AS last, 0::BIGINT AS n, false AS told, NULL::BIGINT AS seq, '' AS k, NULL::DOUBLE AS "at", 0::BIGINT AS ot, 0::BIGINT AS oe FROM e
UNION ALL SELECT u, i, CASE WHEN told OR k = 'capture' THEN 0 ELSE turns + (k = 'turn')::INT END, CASE WHEN told OR k = 'capture' THEN 0 ELSE edits + (k = 'edit')::INT END,
 CASE WHEN told OR k = 'capture' THEN false ELSE held OR (wanted AND NOT text) END, CASE WHEN told THEN t ELSE last END, n + told::INT, told, seq, k, t, turns, edits
FROM (SELECT *, wanted AND text AS told FROM (SELECT e.u, e.i, e.seq, e.k, e.t, r.turns, r.edits, r.held, r.last, r.n, e.k = 'UserPromptSubmit' OR (e.k = 'Stop' AND e.u % 2 = 0) AS text,
 e.k IN ('Stop', 'UserPromptSubmit') AND e.u % 10 <> 0 AND (r.held OR ((r.turns >= 12 OR r.edits >= 5) AND (r.last IS NULL OR e.t - r.last >= 600))) AS wanted FROM r JOIN e ON e.u = r.u AND e.i = r.i + 1)))
SELECT u::VARCHAR AS session, seq, k AS event, "at", ot AS turns, oe AS edits, n AS number FROM r WHERE told"""
)
def session_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispatch.signals(_hooks(spark, sf_dir))


@query("SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN concat('a/', s_suppkey) WHEN 1 THEN concat('b/', s_suppkey) WHEN 3 THEN concat('c/d/', s_suppkey) END AS path FROM supplier")
def confined_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths within the corpus without detours; null where they lead outside."""
    k = F.col("s_suppkey")
    raw = F.when(k % 4 == 0, F.concat(S("./a/x/../"), k)).when(k % 4 == 1, F.concat(S("x\\..\\b\\"), k)).when(k % 4 == 2, F.concat(S("x/../../"), k)).otherwise(F.concat(S("c//d/./"), k))
    return R.table(spark, sf_dir, "supplier").select("s_suppkey", X.inside(raw).alias("path"))


# -- orders and clips -------------------------------------------------------
def _trails(depth: int) -> str:
    fold = lambda x: f"replace(lower({x}), 'ß', 'ss')"
    start = "40-knowledge/people/customer-1.md"
    hops = [f"e AS ({Q.LINKS_RESOLVED}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), s0 AS (SELECT '{start}' AS path, 0 AS distance, ['{start}'] AS trail)"]
    for i in range(1, depth + 1):
        hops.append(f"s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT u.dst, {i}, min(list_append(s.trail, {fold('u.dst')})) FROM u JOIN s{i - 1} s ON u.src = s.path AND s.distance = {i - 1} WHERE u.dst NOT IN (SELECT path FROM s{i - 1}) GROUP BY u.dst)")
    return f"WITH {', '.join(hops)} SELECT path, row_number() OVER (ORDER BY distance, trail, path)::INTEGER AS place FROM s{depth} WHERE distance > 0"


@query(_trails(2))
def related_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbourhood in the order of a breadth-first search; it is numbered, as it is small."""
    table = R.linked(spark, sf_dir)
    found = graph.related_in_order(table.where("path = '40-knowledge/people/customer-1.md'").select("path"), graph.edges(graph.link_targets(table)), 2)
    return found.select("path", F.row_number().over(Window.orderBy("distance", "trail", "path")).alias("place"))


@query("SELECT n_name, row_number() OVER (ORDER BY k, n_name)::INTEGER AS place FROM (SELECT n_name, translate(concat(CASE WHEN n_nationkey % 2 = 0 THEN 'É' ELSE 'e' END, n_name), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM nation)")
def stored_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents are ordered by ASCII letters without regard to case, all others as they are."""
    key = X.ascii_fold(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "É").otherwise("e"), "n_name"))
    return R.table(spark, sf_dir, "nation").select("n_name", F.row_number().over(Window.orderBy(key, "n_name")).alias("place"))


@query(
    """SELECT concat('30-resources/sources/raw/2024-05-06 070809 - Page ', page_id, ' a b.md') AS path, concat('raw-web-20240506-070809-page-', page_id, '-a-b') AS id, coalesce(url, '') AS source_url, trim(replace(replace(html, chr(13), ''), chr(10), ' ')) AS payload, 'draft' AS status
FROM pages"""
)
def clipped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as clips, read back from their notes."""
    k = F.col("page_id")
    clip = R.table(spark, sf_dir, "pages").select(
        F.concat(S("Page "), k, S(": a/b")).alias("title"), "url", S("site").alias("site"), S(None).cast("string").alias("author"), S("2024-05-01").alias("published"),
        F.replace("html", S("\r"), S("")).alias("content"), F.to_timestamp(S("2024-05-06 07:08:09")).alias("clipped_at"),
    )
    table = notes(clips.clipped(clip))
    return table.select("path", checks.meta("id").alias("id"), checks.meta("source_url").alias("source_url"), F.trim(F.replace(checks.payload(F.col("body")), S("\n"), S(" "))).alias("payload"), "status")


# -- transcripts ------------------------------------------------------------
def transcript_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of session transcripts: even users' in one shape, odd users' in the other, a fifth in no known one.

    Views are assistant turns, sign-ups edits, purchases captures, of which every fourth fails in a line of its own.
    """
    e = store.spread(R.table(spark, sf_dir, "events").select(F.col("user_id").alias("u"), F.col("event_id").alias("id"), F.col("event_type").alias("t")))
    call = F.concat(S("c"), "id")
    path = F.when(F.col("id") % 3 != 0, F.concat(S("p"), F.col("id") % 7))
    own = lambda *content: F.to_json(F.struct(S("assistant").alias("type"), F.struct(S("assistant").alias("role"), F.array(*map(F.to_variant_object, content)).alias("content")).alias("message")))
    said = F.struct(S("text").alias("type"), F.concat(S("event "), "id").alias("text"))
    use = lambda name, given: F.struct(S("tool_use").alias("type"), call.alias("id"), S(name).alias("name"), given.alias("input"))
    first = F.when(F.col("t") == "view", own(said)).when(F.col("t") == "signup", own(said, use("Edit", F.struct(path.alias("file_path"))))).when(F.col("t") == "purchase", own(use("mcp__brain__capture_note", F.struct(S("x").alias("title")))))
    item = lambda payload: F.to_json(F.struct(S("response_item").alias("type"), payload.alias("payload")))
    function = lambda name, given: item(F.struct(S("function_call").alias("type"), S(name).alias("name"), call.alias("call_id"), F.to_json(given).alias("arguments")))
    patch = F.struct(F.array(S("apply_patch"), S("*** Begin Patch")).alias("command"), path.alias("path"))
    second = F.when(F.col("t") == "view", item(F.struct(S("message").alias("type"), S("assistant").alias("role")))).when(F.col("t") == "signup", function("shell", patch)).when(F.col("t") == "purchase", function("capture_note", F.struct(S("x").alias("title"))))
    other = F.to_json(F.struct(S("user").alias("type"), F.struct(S("user").alias("role"), F.col("t").alias("content")).alias("message")))
    unknown = F.to_json(F.struct(F.col("t").alias("event"), F.array("id").alias("ids")))
    line = F.when(F.col("u") % 5 == 4, unknown).when(F.col("u") % 2 == 0, first).otherwise(second)
    result = F.struct(S("tool_result").alias("type"), call.alias("tool_use_id"), S(True).alias("is_error"))
    failed = F.to_json(F.struct(S("user").alias("type"), F.struct(F.array(result).alias("content")).alias("message")))
    fails = F.array(F.struct((F.col("id") * 2 + 1).alias("seq"), failed.alias("line")))
    each = F.array(F.struct((F.col("id") * 2).alias("seq"), F.coalesce(line, other).alias("line")))
    each = F.when((F.col("t") == "purchase") & (F.col("id") % 4 == 0) & (F.col("u") % 5 != 4), F.concat(each, fails)).otherwise(each)
    return e.select(F.col("u").cast("string").alias("session"), F.inline(each))


TRANSCRIPTS = """WITH e AS (SELECT user_id AS u, event_id AS id, event_type AS t, user_id % 5 <> 4 AS known FROM events),
l AS (SELECT u, max(id * 2) AS last_capture FROM e WHERE known AND t = 'purchase' AND id % 4 <> 0 GROUP BY 1),
r AS (SELECT e.*, last_capture, last_capture IS NULL OR id * 2 > last_capture AS inside FROM e LEFT JOIN l USING (u))
SELECT u::VARCHAR AS session,
       CASE WHEN u % 5 = 4 THEN count(*) // 4 ELSE count(*) FILTER (inside AND (t = 'view' OR u % 2 = 0 AND t IN ('signup', 'purchase'))) END::BIGINT AS turns,
       (count(DISTINCT id % 7) FILTER (known AND inside AND t = 'signup' AND id % 3 <> 0) + count(*) FILTER (known AND inside AND t = 'signup' AND id % 3 = 0))::BIGINT AS edits,
       count(*) FILTER (known AND t = 'purchase') AS captures, any_value(last_capture) AS last_capture
FROM r GROUP BY u"""


@query(TRANSCRIPTS)
def transcript_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.activity(transcripts.events(transcript_lines(spark, sf_dir)))


@query(f"SELECT session, turns, edits FROM ({TRANSCRIPTS}) WHERE turns >= 12 OR edits >= 5")
def transcripts_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions_due(transcripts.activity(transcripts.events(transcript_lines(spark, sf_dir)))).select("session", "turns", "edits")


#: Lines as a table of kinds, to see what the walk finds in each.
@query("""SELECT sum((known AND (t = 'view' OR u % 2 = 0 AND t IN ('signup', 'purchase')))::INT)::BIGINT AS turns, sum((known AND t = 'signup')::INT)::BIGINT AS edits,
sum((known AND t = 'purchase')::INT)::BIGINT AS captures, sum((known AND t = 'purchase' AND id % 4 = 0)::INT)::BIGINT AS failed
FROM (SELECT user_id AS u, event_id AS id, event_type AS t, user_id % 5 <> 4 AS known FROM events)""")
def transcript_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transcripts.events(transcript_lines(spark, sf_dir))
    return found.agg(F.sum(F.col("turn").cast("int")).alias("turns"), *(F.sum(F.size(c)).alias(c) for c in ("edits", "captures", "failed")))


# -- recall -----------------------------------------------------------------
_PROMPTS = "SELECT concat(conv_id, '/', turn) AS query_id, substr(trim(text), 1, 500) AS query FROM conversations WHERE role = 'user' AND length(trim(text)) >= 40 AND NOT starts_with(trim(text), '/')"
_RANKED = Q.ranked([("x", "x")], limit=4, prefix=True, phrase=True).replace("q(query_id, query) AS (VALUES ('x', 'x'))", f"q AS ({_PROMPTS})")


@query(f"""SELECT split_part(query_id, '/', 1)::BIGINT AS conv_id, split_part(query_id, '/', 2)::BIGINT AS turn, string_agg(path, ',' ORDER BY rank) AS paths, count(*)::INTEGER AS notes, true AS within_budget, true AS names_all
FROM ({_RANKED}) GROUP BY query_id""")
def recalled_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bundle of packed text for every prompt; its paths, and that it keeps its budget and names its notes."""
    c = R.table(spark, sf_dir, "conversations").where("role = 'user'")
    hooks = c.select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.col("text").alias("prompt"), S(None).cast("string").alias("source"), S(False).alias("in_corpus"))
    d = R.corpus(spark, sf_dir)
    made = dispatch.recall_bundles(hooks, d, index.stored(d, inverted=False))
    named = F.forall("paths", lambda p: F.contains("bundle", F.concat(S("Source: "), p)))
    return made.select(F.col("session").alias("conv_id"), F.col("seq").alias("turn"), F.array_join("paths", ",").alias("paths"), "notes", (F.col("chars") <= 4800).alias("within_budget"), named.alias("names_all"))


# -- view files -------------------------------------------------------------
_ODD_VIEW = """
filters: file.inFolder("10-projects") && !(status == "active")
views:
  - name: Old snapshots
    filters:
      or:
        - freshness == "snapshot" && updated < today() - "2 years" + "1 week"
        - not:
            - freshness != null
            - updated >= date("1993-01-01")
        - freshness_window_days >= 480 || file.name.startsWith("order-77")
    groupBy: updated
    order: [freshness, updated]
"""


@query("""SELECT freshness, count(*) AS notes, min(updated) AS first FROM (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'pointer' WHEN 1 THEN 'snapshot' ELSE '' END AS freshness, strftime(o_orderdate, '%Y-%m-%d') AS updated, o_orderkey AS k FROM orders WHERE o_orderstatus <> 'O')
WHERE freshness = 'snapshot' AND updated < '1996-06-08' OR freshness = '' AND updated < '1993-01-01' OR k % 50 >= 48 OR starts_with(k::VARCHAR, '77') GROUP BY freshness""")
def view_of_a_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view with nested conditions, read from a file's text, registered, and counted in SQL."""
    (own,) = viewfiles.views_in(_ODD_VIEW)
    (name,) = views.register(notes(R.orders(spark, sf_dir)), [own], views.Context(datetime.date(1998, 6, 1)), prefix="file_")
    return spark.sql(f"SELECT freshness, count(*) AS notes, min(updated) AS first FROM {name} GROUP BY freshness")


# -- formats ----------------------------------------------------------------
@query("SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS week, strftime(o_orderdate, '%A, %-d %B %Y at %H:%M') AS spelled, strftime(o_orderdate, '%a %-d.%-m.%y') AS short FROM orders")
def order_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of every order in three formats of note templates."""
    of = lambda pattern: formats.moment(F.col("o_orderdate"), pattern)
    return R.table(spark, sf_dir, "orders").select("o_orderkey", of("GGGG-[W]WW").alias("week"), of("dddd, D MMMM YYYY [at] HH:mm").alias("spelled"), of("ddd D.M.YY").alias("short"))


_SPELLED = "replace(replace(replace(replace(replace(replace(replace({}, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue')"
_SLUG = f"coalesce(nullif(lower(trim(regexp_replace(strip_accents({_SPELLED}), '[^a-zA-Z0-9]+', '-', 'g'), '-')), ''), 'note')"


@query(f"SELECT p_partkey, {_SLUG.format('''p_name || ' – Größe ' || p_size || ' / ' || p_brand || ' à la Ñandú' ''')} AS slug FROM part")
def part_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The id of a note on each part, from a title with accents and marks."""
    title = F.concat("p_name", S(" – Größe "), F.col("p_size").cast("string"), S(" / "), "p_brand", S(" à la Ñandú"))
    return R.table(spark, sf_dir, "part").select("p_partkey", formats.slug(title).alias("slug"))


@query(f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN {_SLUG.format('text')} END AS slug FROM documents")
def document_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of every whole text, in all its languages."""
    return store.spread(R.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", formats.slug(F.col("text")).alias("slug"))
