"""DuckDB SQL of the queries in :mod:`corvane.plans.queries`."""

WORD = r"[\p{L}\p{N}]+(?:[-''][\p{L}\p{N}]+)*"


def tok(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, '{WORD}'), lambda w: replace(lower(w), 'ß', 'ss'))"


#: Documents as notes: term lists by field, and their lengths.
CORPUS = f"""
b AS (SELECT concat_ws('/', lang, source, doc_id) AS path, text AS body, lang, source AS type, octet_length(encode(text)) AS size,
       strftime(DATE '2024-01-01' + (doc_id % 365)::INTEGER, '%Y-%m-%d') AS updated, {tok("text")} AS tb, {tok("concat_ws(' ', lang, source)")} AS tm FROM documents),
d AS (SELECT *, tb[1:6] AS tt, len(tb) AS lb, len(tm) AS lm, len(tb[1:6]) AS lt FROM b),
st AS (SELECT count(*) AS n, greatest(avg(lt), 1) AS gt, greatest(avg(lm), 1) AS gm, greatest(avg(lb), 1) AS gb FROM d)"""

VOCABULARY = "voc AS (SELECT DISTINCT unnest(tt || tm || tb) AS term FROM d)"


def scores() -> str:
    """From w(query_id, term, weight) to s(query_id, path, score)."""
    tf = lambda f: f"len(list_filter(t{f}, lambda x: x = term))"
    x = " + ".join(f"{w} * tf{f} / (0.25 + 0.75 * l{f} / g{f})" for f, w in (("t", 8.0), ("m", 3.0), ("b", 1.0)))
    return f"""
hit AS (SELECT t.term, d.path, d.lt, d.lm, d.lb, {tf("t")} AS tft, {tf("m")} AS tfm, {tf("b")} AS tfb FROM (SELECT DISTINCT term FROM w) t, d WHERE list_contains(tb, term) OR list_contains(tm, term)),
df AS (SELECT term, count(*) AS df FROM hit GROUP BY 1),
x AS (SELECT term, path, {x} AS x FROM hit, st),
s AS (SELECT w.query_id, x.path, round(sum(w.weight * ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * x.x * 2.2 / (x.x + 1.2)), 9) AS score
      FROM x JOIN w USING (term) JOIN df USING (term), st GROUP BY 1, 2)"""


EXACT = f"""
qt AS (SELECT query_id, query, unnest({tok("query")}) AS term, generate_subscripts({tok("query")}, 1) AS pos FROM q),
e AS (SELECT query_id, term, min(pos) AS pos FROM qt GROUP BY 1, 2)"""


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def ranked(queries: list[tuple[str, str]], limit: int, where: str = "true", prefix: bool = False, phrase: bool = False) -> str:
    values = ", ".join(f"('{i}', '{t}')" for i, t in queries)
    weights = "w AS (SELECT query_id, term, 1.0::DOUBLE AS weight FROM e)"
    if prefix:
        weights = f"""{VOCABULARY},
miss AS (SELECT * FROM e WHERE term NOT IN (SELECT term FROM voc) AND length(term) >= 3),
ex AS (SELECT m.query_id, m.pos, v.term, row_number() OVER (PARTITION BY m.query_id, m.term ORDER BY v.term) AS sub FROM miss m JOIN voc v ON starts_with(v.term, m.term)),
al AS (SELECT query_id, term, pos, 0 AS sub, 1.0::DOUBLE AS weight FROM e UNION ALL SELECT query_id, term, pos, sub, 0.6::DOUBLE FROM ex WHERE sub <= 24),
w AS (SELECT query_id, term, weight FROM al QUALIFY row_number() OVER (PARTITION BY query_id, term ORDER BY pos, sub) = 1)"""
    order = f"ORDER BY score DESC, {fold('path')}, path"
    final = f"f AS (SELECT s.query_id, s.path, s.score FROM s JOIN d USING (path) WHERE {where})"
    if phrase:
        title, q = fold("array_to_string(tt, ' ')"), fold("query")
        final = f"""
p AS (SELECT s.query_id, s.path, s.score, row_number() OVER (PARTITION BY s.query_id {order.replace('path', 's.path')}) AS place FROM s JOIN d USING (path) WHERE {where}),
f AS (SELECT p.query_id, p.path, p.score + CASE WHEN contains({title}, {q}) THEN 12.0 WHEN contains({fold('body')}, {q}) THEN 4.0 ELSE 0.0 END AS score
      FROM p JOIN d USING (path) JOIN q USING (query_id) WHERE place <= 50)"""
    return f"""WITH q(query_id, query) AS (VALUES {values}), {CORPUS}, {EXACT}, {weights}, {scores()}, {final},
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id {order}))::INTEGER AS rank, path, round(score, 6) AS score FROM f)
SELECT query_id, rank, path, score FROM r WHERE rank <= {limit}"""


EXCERPTS = rf"""
WITH p AS (SELECT doc_id, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda s: trim(s)) AS x FROM documents)),
h AS (SELECT doc_id, p, i, len(list_intersect(['the', 'that', 'die', 'les', 'con'], {tok("p")})) AS hits FROM p WHERE p <> '' AND NOT starts_with(p, '#') AND NOT starts_with(p, '<!--') AND NOT starts_with(p, '```')),
b AS (SELECT doc_id, trim(regexp_replace(p, '\s+', ' ', 'g')) AS p FROM h QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, i) = 1)
SELECT d.doc_id, coalesce(CASE WHEN length(p) > 160 THEN concat(rtrim(substr(p, 1, 157)), '...') ELSE p END, '') AS excerpt FROM documents d LEFT JOIN b USING (doc_id)"""

TERM_STATS = f"""WITH {CORPUS}, o AS (SELECT unnest(tt) AS term, 't' AS f FROM d UNION ALL SELECT unnest(tm), 'm' FROM d UNION ALL SELECT unnest(tb), 'b' FROM d)
SELECT term, count(*) FILTER (f = 't') AS n_title, count(*) FILTER (f = 'm') AS n_meta, count(*) FILTER (f = 'b') AS n_body FROM o GROUP BY 1"""
DOC_FREQ = f"WITH {CORPUS} SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(tt || tm || tb)) AS term FROM d) GROUP BY 1"
CORPUS_STATS = f"WITH {CORPUS} SELECT count(*) AS n_docs, round(avg(lt), 6) AS avg_title, round(avg(lm), 6) AS avg_meta, round(avg(lb), 6) AS avg_body FROM d"
PADDED = "concat('  ', term, ' ')"
TRIGRAMS = f"list_distinct(list_transform(range(1, length({PADDED}) - 1), lambda i: substr({PADDED}, i, 3)))"
INDEX_STATS = f"""WITH {CORPUS}, {VOCABULARY}, p AS (SELECT unnest(list_distinct(tt || tm || tb)) AS term FROM d)
SELECT (SELECT count(*) FROM d) AS docs, (SELECT count(*) FROM p) AS postings, (SELECT count(*) FROM voc) AS terms, (SELECT sum(len({TRIGRAMS}))::BIGINT FROM voc) AS trigrams"""


def trigram_candidates(terms: list[str]) -> str:
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""WITH {CORPUS}, {VOCABULARY}, a(term) AS (VALUES {values}), t AS (SELECT term, unnest({TRIGRAMS}) AS tri FROM voc),
m AS (SELECT term AS asked, unnest({TRIGRAMS}) AS tri FROM a), c AS (SELECT asked, term, count(*) AS shared FROM m JOIN t USING (tri) GROUP BY 1, 2),
r AS (SELECT *, (row_number() OVER (PARTITION BY asked ORDER BY shared DESC, term))::INTEGER AS place FROM c) SELECT asked, term, shared, place FROM r WHERE place <= 200"""


def _longest(a: str, b: str) -> str:
    """{k, ni, nj}: length and negated places of the longest block that two strings share, the first in a and then in b."""
    block = f"{{'k': k, 'ni': -i, 'nj': -instr({b}, substr({a}, i, k))}}"
    own = f"list_filter(list_transform(range(1, length({a}) - i + 2), lambda k: {block}), lambda x: x.nj < 0)"
    return f"list_max(flatten(list_transform(range(1, length({a}) + 1), lambda i: {own})))"


def similar_terms(terms: str, length: int, ratio: float, most: int) -> str:
    """From a(term) to fz(asked, term, sub, ratio): similar terms by the blocks that recursive halving finds."""
    near = f"""t AS (SELECT term, unnest({TRIGRAMS}) AS tri FROM voc),
m AS (SELECT term AS asked, unnest({TRIGRAMS}) AS tri FROM a), c AS (SELECT asked, term, count(*) AS shared FROM m JOIN t USING (tri) GROUP BY 1, 2),
n AS (SELECT asked, term FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY shared DESC, term) AS place FROM c) WHERE place <= 200 AND abs(length(asked) - length(term)) <= {length})"""
    sides = "[{'a': substr(a, 1, -m.ni - 1), 'b': substr(b, 1, -m.nj - 1)}, {'a': substr(a, -m.ni + m.k), 'b': substr(b, -m.nj + m.k)}]"
    return f"""a(term) AS ({terms}), {near},
rec AS (SELECT asked, term, asked AS a, term AS b, {_longest("asked", "term")} AS m FROM n
        UNION ALL SELECT asked, term, p.a, p.b, {_longest("p.a", "p.b")} FROM (SELECT asked, term, unnest({sides}) AS p FROM rec WHERE m IS NOT NULL) WHERE length(p.a) > 0 AND length(p.b) > 0),
ra AS (SELECT asked, term, 2.0::DOUBLE * sum(coalesce(m.k, 0)) / (length(asked) + length(term)) AS ratio FROM rec GROUP BY asked, term),
fz AS (SELECT asked, term, ratio, (row_number() OVER (PARTITION BY asked ORDER BY ratio DESC, term))::INTEGER AS sub FROM ra WHERE ratio >= {ratio} QUALIFY sub <= {most})"""


def fuzzy_terms(terms: list[str], **bounds) -> str:
    values = " UNION ALL ".join(f"SELECT '{t}'" for t in terms)
    return f"WITH RECURSIVE {CORPUS}, {VOCABULARY}, {similar_terms(values, **bounds)} SELECT asked, term, sub, round(ratio, 6) AS ratio FROM fz"


def ranked_fuzzy(queries: list[tuple[str, str]], limit: int, weight: float, **bounds) -> str:
    """:func:`ranked` where terms found nowhere also count by similar ones."""
    plain = "w AS (SELECT query_id, term, 1.0::DOUBLE AS weight FROM e)"
    missing = "SELECT DISTINCT term FROM e WHERE term NOT IN (SELECT term FROM voc)"
    fuzzy = f"""{VOCABULARY}, {similar_terms(missing, **bounds)},
al AS (SELECT query_id, term, pos, 0 AS sub, 1.0::DOUBLE AS weight FROM e UNION ALL SELECT e.query_id, fz.term, e.pos, fz.sub + 100, {weight}::DOUBLE FROM fz JOIN e ON e.term = fz.asked),
w AS (SELECT query_id, term, weight FROM al QUALIFY row_number() OVER (PARTITION BY query_id, term ORDER BY pos, sub) = 1)"""
    return ranked(queries, limit).replace(plain, fuzzy).replace("WITH q(", "WITH RECURSIVE q(", 1)


# -- rendered notes ---------------------------------------------------------
CUSTOMER = "concat(CASE WHEN c_custkey % 5 = 0 THEN '00-inbox' ELSE '40-knowledge/people' END, '/customer-', c_custkey, '.md')"
SUPPLIER = "concat('40-knowledge/organizations/supplier-', s_suppkey, '.md')"
NATION, REGION = "concat('40-knowledge/nation-', n_nationkey, '.md')", "concat('20-areas/region-', r_regionkey, '.md')"
ORDER = "concat('10-projects/order-', o_orderkey, '.md')"
PART = "concat(CASE WHEN p_size % 2 = 0 THEN '10-projects' ELSE '30-resources' END, '/part-', p_partkey, '.md')"
LINKS_RESOLVED = f"""SELECT {NATION} AS src, concat('20-areas/region-', n_regionkey, '.md') AS dst FROM nation
UNION ALL SELECT {SUPPLIER}, concat('40-knowledge/nation-', s_nationkey, '.md') FROM supplier WHERE s_suppkey % 2 = 0
UNION ALL SELECT {CUSTOMER}, concat('40-knowledge/nation-', c_nationkey, '.md') FROM customer WHERE c_custkey % 7 <> 0"""
PAGE_LINKS = r"""WITH l AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages),
k AS (SELECT *, lower(regexp_replace(regexp_replace(target, '^/+|/+$', '', 'g'), '\.md$', '', 'i')) AS key FROM l)
SELECT target, count(*) AS n FROM k WHERE key NOT IN (SELECT concat('page-', page_id) FROM pages) GROUP BY 1"""


def related(depth: int) -> str:
    hops = [f"e AS ({LINKS_RESOLVED}), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), s0 AS (SELECT '40-knowledge/people/customer-1.md' AS path, 0 AS distance)"]
    for i in range(1, depth + 1):
        hops.append(f"s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT DISTINCT u.dst, {i} FROM u JOIN s{i - 1} s ON u.src = s.path AND s.distance = {i - 1} WHERE u.dst NOT IN (SELECT path FROM s{i - 1}))")
    return f"WITH {', '.join(hops)} SELECT path, distance FROM s{depth} WHERE distance > 0"


NODES = f"nodes AS (SELECT {CUSTOMER} AS path, 'person' AS type FROM customer UNION ALL SELECT {SUPPLIER}, 'organization' FROM supplier UNION ALL SELECT {NATION}, CASE WHEN n_regionkey < 2 THEN 'moc' ELSE 'resource' END FROM nation UNION ALL SELECT {REGION}, 'area' FROM region)"
ORPHANS = f"WITH e AS ({LINKS_RESOLVED}), {NODES} SELECT path FROM nodes WHERE path NOT IN (SELECT src FROM e) AND path NOT IN (SELECT dst FROM e)"
HUB_COVERAGE = f"WITH e AS ({LINKS_RESOLVED}), {NODES} SELECT path, type FROM nodes WHERE type <> 'moc' AND path NOT IN (SELECT e.src FROM e JOIN nodes m ON e.dst = m.path WHERE m.type = 'moc')"
OUTBOUND = f"SELECT src AS path, dst AS resolved, '' AS missing FROM ({LINKS_RESOLVED}) UNION ALL SELECT {SUPPLIER}, '', concat('nowhere-', s_suppkey) FROM supplier WHERE s_suppkey % 2 = 1"
MISSING_INVERSE = f"SELECT {ORDER} AS src, 'depends_on' AS relation, concat('40-knowledge/people/customer-', o_custkey, '.md') AS dst, 'required_by' AS missing_inverse FROM orders WHERE o_orderkey % 11 <> 0 AND o_orderkey % 2 = 1"
MISSING_METADATA = f"""SELECT {PART} AS path, 'missing' AS issue, 'status' AS detail FROM part WHERE p_size % 5 = 0 UNION ALL SELECT {PART}, 'missing', 'updated' FROM part WHERE p_size % 4 = 0
UNION ALL SELECT {PART}, 'unknown_type', 'gadget' FROM part WHERE p_size % 7 = 0"""
SEALED = """SELECT concat('30-resources/sources/raw/', doc_id, '.md') AS path, CASE doc_id % 10 WHEN 5 THEN 'invalid_or_missing_payload_boundary' WHEN 3 THEN 'missing_content_sha256' ELSE 'payload_changed_after_seal' END AS issue
FROM documents WHERE doc_id % 10 IN (0, 3, 5)"""
AGE = "datediff('day', o_orderdate::DATE, DATE '1998-12-31')"
STALE = f"SELECT {ORDER} AS path, {AGE}::INTEGER AS days FROM orders WHERE o_orderstatus = 'O' AND {AGE} > 180"
STALE_REPORT = f"""SELECT {PART} AS path, CASE WHEN p_size % 7 = 0 THEN 'gadget' ELSE 'resource' END AS type, CASE WHEN p_size % 5 = 0 THEN '' ELSE 'active' END AS status,
CASE WHEN p_size % 4 <> 0 THEN '2020-01-02' END AS updated, CASE WHEN p_size % 4 <> 0 THEN 151 END AS days FROM part"""
WINDOW = "(CASE WHEN o_orderkey % 50 = 0 THEN 30 ELSE o_orderkey % 50 * 10 END)"
FRESHNESS = f"""SELECT {ORDER} AS path, 'snapshot_missing_observed_date' AS issue, '' AS detail FROM orders WHERE o_orderkey % 3 = 1
UNION ALL SELECT {ORDER}, 'pointer_truth_source_must_be_scalar', '' FROM orders WHERE o_orderkey % 6 = 3
UNION ALL SELECT {ORDER}, 'invalid_freshness_window_days', '0' FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 50 = 0
UNION ALL SELECT {ORDER}, 'verification_expired', {AGE}::VARCHAR FROM orders WHERE o_orderkey % 3 = 0 AND {AGE} > {WINDOW}"""
CHECK_TOTALS = f"""WITH e AS ({LINKS_RESOLVED}), {NODES}, t(severity, family, n) AS (
SELECT 'error', 'unresolved_links', (SELECT count(*) FROM supplier WHERE s_suppkey % 2 = 1) UNION ALL
SELECT 'error', 'duplicate_ids', (SELECT count(*) FROM (SELECT n_regionkey FROM nation GROUP BY 1 HAVING count(*) > 1)) UNION ALL
SELECT 'error', 'duplicate_titles', (SELECT count(*) FROM (SELECT lower(t) FROM (SELECT n_name AS t FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT s_name FROM supplier UNION ALL SELECT c_name FROM customer) GROUP BY 1 HAVING count(*) > 1)) UNION ALL
SELECT 'warning', 'moc_coverage', (SELECT count(*) FROM ({HUB_COVERAGE})) UNION ALL
SELECT 'warning', 'orphans', (SELECT count(*) FROM ({ORPHANS})) UNION ALL
SELECT 'warning', 'placement', (SELECT count(*) FROM nation WHERE n_regionkey >= 2))
SELECT * FROM t WHERE n > 0"""
TAGS = """SELECT tag, count(*) AS n FROM (SELECT c_mktsegment AS tag FROM customer UNION ALL SELECT concat('n', c_nationkey) FROM customer UNION ALL SELECT replace(p_brand, ' ', '-') FROM part UNION ALL SELECT replace(p_type, ' ', '-') FROM part) GROUP BY 1"""


def tasks(status: str) -> str:
    return f"""WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_linestatus = 'F') AS i FROM lineitem)
SELECT concat('10-projects/order-', l_orderkey, '.md') AS path, (i + 3)::INTEGER AS line, concat('ship part ', l_partkey) AS text FROM l WHERE (l_linestatus = 'F') = ('{status}' = 'F')"""


PARAGRAPHS = rf"""SELECT doc_id, words FROM (SELECT doc_id, line, len(regexp_extract_all(line, '{WORD}'))::INTEGER AS words FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n')) AS line FROM documents))
WHERE words > 120 AND NOT regexp_matches(line, '^\s*(#|>|[-*+]\s|\||<!--|\d+[.)]\s)')"""
WORDS_MEDIAN = f"SELECT count(*) AS notes, median(len({tok('text')}))::DOUBLE AS median_words FROM documents"


def case_rows() -> str:
    """c(case_id, category, ...) of the evaluation's cases, up to r(query_id, rank, path)."""
    return f"""{CORPUS},
i AS (SELECT concat('b', item_id) AS case_id, concat('c', item_id % 3) AS category, text, {tok("text")} AS t FROM benchmark),
x0 AS (SELECT i.case_id, i.category, d.path FROM i JOIN d ON contains(d.body, i.text)),
n AS (SELECT case_id, category, count(*) AS expected FROM x0 GROUP BY 1, 2),
q AS (SELECT case_id AS query_id, array_to_string(t[1:5], ' ') AS query FROM i WHERE case_id IN (SELECT case_id FROM n)),
{EXACT}, w AS (SELECT query_id, term, 1.0::DOUBLE AS weight FROM e), {scores()},
r AS (SELECT query_id AS case_id, path, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {fold('path')}, path) AS rank FROM s QUALIFY rank <= 5),
k AS (SELECT r.case_id, r.rank, d.size, (x0.path IS NOT NULL) AS good FROM r JOIN d USING (path) LEFT JOIN x0 ON x0.case_id = r.case_id AND x0.path = r.path),
c AS (SELECT n.case_id, n.category, coalesce(1.0 / min(rank) FILTER (good), 0) AS rr, count(*) FILTER (good AND rank <= 1) / n.expected AS r1, count(*) FILTER (good AND rank <= 3) / n.expected AS r3,
      count(*) FILTER (good AND rank <= 5) / n.expected AS r5, coalesce(sum(size), 0) AS bytes FROM n LEFT JOIN k USING (case_id) GROUP BY n.case_id, n.category, n.expected)"""


MEANS = "count(*) AS cases, round(avg(rr), 6) AS mrr, round(avg(r1), 6) AS recall_1, round(avg(r3), 6) AS recall_3, round(avg(r5), 6) AS recall_5, round(avg(bytes), 2) AS bytes_5"


def evaluation(by_category: bool) -> str:
    return f"WITH {case_rows()} SELECT {'category, ' if by_category else ''}{MEANS} FROM c{' GROUP BY 1' if by_category else ''}"


def trial_gate() -> str:
    return f"""WITH {case_rows()}, g AS (SELECT category, count(*) AS n, round(avg(r5), 6) AS r FROM c GROUP BY 1)
SELECT count(*) AS cases, (SELECT count(*) FROM g WHERE n >= 5 AND r < 0.75) AS weak_categories, count(*) >= 20 AND (round(avg(r5), 6) < 0.85 OR (SELECT count(*) FROM g WHERE n >= 5 AND r < 0.75) > 0) AS justified FROM c"""


PAIRS = """p AS (SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'Capture' ELSE 'find' END AS category, max(value) FILTER (event_type = 'view') AS b, max(value) FILTER (event_type = 'click') * 0.5 AS c,
count(*) FILTER (event_type = 'error') AS errors, user_id % 4 <> 0 AS bs, user_id % 8 <> 0 AS cs FROM events GROUP BY user_id),
o AS (SELECT * FROM p WHERE b IS NOT NULL AND c IS NOT NULL)"""
AB_GATE = f"""WITH {PAIRS}, m AS (SELECT count(*) AS pairs, count(*) FILTER (category = 'Capture') AS captures, round(median(b), 3) AS b, round(median(c), 3) AS c,
round(median(b) FILTER (category = 'Capture'), 3) AS cb, round(median(c) FILTER (category = 'Capture'), 3) AS cc, avg(cs::INT) >= avg(bs::INT) AS kept FROM o),
g AS (SELECT *, round((b - c) / b, 6) AS ti, round((cc - cb) / cb, 6) AS cr FROM m),
z AS (SELECT *, list_filter([CASE WHEN pairs < 10 THEN 'insufficient_paired_cases' END, CASE WHEN captures < 2 THEN 'insufficient_capture_cases' END, CASE WHEN NOT kept THEN 'success_rate_regressed' END,
 CASE WHEN ti < 0.2 THEN 'time_improvement_target_not_met' END, CASE WHEN cr > 0.1 THEN 'capture_time_limit_not_met' END], lambda x: x IS NOT NULL) AS reasons FROM g)
SELECT pairs, captures, ti AS time_improvement, cr AS capture_regression, kept AS success_kept, true AS evidence_kept, CASE WHEN len(reasons) = 0 THEN 'measured_usability_gate_passed' ELSE array_to_string(reasons, ',') END AS reasons, len(reasons) = 0 AS supported FROM z"""
AB_METRICS = f"""WITH {PAIRS} SELECT category, count(*) AS pairs, round(avg(bs::INT), 6) AS baseline_success, 1.0::DOUBLE AS baseline_evidence, round(median(b), 3) AS baseline_seconds, round(median(errors), 3)::DOUBLE AS baseline_files,
round(avg(cs::INT), 6) AS candidate_success, 1.0::DOUBLE AS candidate_evidence, round(median(c), 3) AS candidate_seconds, round(median(errors), 3)::DOUBLE AS candidate_files FROM o GROUP BY 1"""
SESSIONS = """SELECT session, count(*) FILTER (inside AND event_type NOT IN ('purchase', 'error', 'signup')) AS turns,
count(DISTINCT event_id % 5) FILTER (inside AND event_type = 'signup' AND event_id % 3 <> 0) + count(*) FILTER (inside AND event_type = 'signup' AND event_id % 3 = 0) AS edits, count(*) FILTER (holds) AS captures
FROM (SELECT *, last_capture IS NULL OR event_id > last_capture AS inside FROM (SELECT *, max(event_id) FILTER (holds) OVER (PARTITION BY session) AS last_capture
FROM (SELECT user_id::VARCHAR AS session, event_id, event_type, event_type = 'purchase' AND coalesce(lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) <> 'error', true) AS holds FROM events)))
GROUP BY session"""
AUDIT = """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at, CASE event_type WHEN 'click' THEN 'PreToolUse' ELSE 'PostToolUse' END AS event, concat('mcp__notes__', user_id % 7) AS tool
FROM events WHERE event_type IN ('click', 'purchase') AND user_id % 7 = 1"""
RECALL = r"""SELECT conv_id, turn FROM conversations WHERE role = 'user' AND length(trim(text)) >= 40 AND NOT starts_with(trim(text), '/')"""
MANIFEST = """SELECT 'added' AS change, count(*) AS n FROM documents WHERE doc_id % 10 = 1 UNION ALL SELECT 'removed', count(*) FROM documents WHERE doc_id % 10 = 2
UNION ALL SELECT 'changed', count(*) FROM documents WHERE doc_id % 10 = 3 UNION ALL SELECT 'unchanged', count(*) FROM documents WHERE doc_id % 10 NOT IN (1, 2, 3)"""
