import datetime

import pytest
from pyspark.sql import functions as F

from corvane.functions.parse import notes
from corvane.operators import checks, evaluate, graph, index, pack, rank, readability, reports, views
from corvane.sources import corpus

DAY = datetime.date(2026, 9, 1)


def note(id_, kind, title, body="", status="active", extra="", updated="2026-09-01"):
    return f"---\nid: {id_}\ntype: {kind}\nstatus: {status}\ncreated: 2026-01-01\nupdated: {updated}\n{extra}---\n\n# {title}\n\n{body}\n"


FILES = {
    "Home.md": note("home", "moc", "Home", "[[40-knowledge/Hub]]"),
    "40-knowledge/Hub.md": note("hub", "moc", "Hub", "[[Alpha]] [[Beta]]"),
    "40-knowledge/concepts/Alpha.md": note("alpha", "concept", "Alpha retrieval", "Up: [[Hub]]. About retrieval and ranking.", extra="tags: [search, core]\nsupports: ['[[Beta]]']\n"),
    "40-knowledge/concepts/Beta.md": note("beta", "concept", "Beta", "Nothing but [[Alpha]] and [[Missing]]. ![[pic.png]]", extra="supersedes: ['[[Gamma]]', '[[Nowhere]]', '[[Beta]]', 'text']\n"),
    "40-knowledge/concepts/Gamma.md": note("ALPHA", "concept", "beta", "- [ ] open task\n- [x] done task\n", extra="supersedes: '[[Beta]]'\n", updated="2025-01-01"),
    "10-projects/Old.md": note("old", "redirect", "Old", status="superseded", extra="redirect_to: '[[Alpha]]'\n"),
    "10-projects/Bad.md": note("bad", "redirect", "Bad", extra="redirect_to: '[[Old]]'\n"),
    "10-projects/Lost.md": note("lost", "concept", "Lost", "alone", extra="freshness: pointer\nfreshness_window_days: x\nlast_verified: 2026-06-01\ntruth_source: [a]\nai_review: pending\nreview_on: soon\n"),
    "90-system/templates/T.md": note("", "concept", "T", "[[Nope]] retrieval"),
}


@pytest.fixture(scope="module")
def table(spark):
    return notes(spark.createDataFrame(list(FILES.items()), "path string, content string")).persist()


@pytest.fixture(scope="module")
def documents(table):
    updated = F.coalesce(F.try_element_at("metadata", F.lit("updated"))["values"][0], F.lit(""))
    return table.select("path", "title", F.col("meta_text").alias("meta"), "body", "type", "tags", updated.alias("updated"), "links", "size").persist()


def paths(df):
    return [r["path"] for r in df.orderBy("rank").collect()]


def ask(spark, *texts):
    return spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(texts)], "query_id string, query string")


def test_rank_title_prefix_fuzzy_filters(spark, documents):
    assert paths(rank.rank(ask(spark, "retrieval"), documents))[0].endswith("Alpha.md")
    assert not any("templates" in p for p in paths(rank.rank(ask(spark, "retrieval"), documents)))
    assert paths(rank.rank(ask(spark, "retrie"), documents))[0].endswith("Alpha.md")
    assert paths(rank.rank(ask(spark, "retreival"), documents)) == []
    assert paths(rank.rank(ask(spark, "retreival"), documents, rank.Options(fuzzy=True)))[0].endswith("Alpha.md")
    assert paths(rank.rank(ask(spark, "retrieval"), documents, rank.Options(types=("moc",)))) == []
    assert paths(rank.rank(ask(spark, "retrieval"), documents, rank.Options(any_tags=("SEARCH",)))) == ["40-knowledge/concepts/Alpha.md"]
    assert paths(rank.rank(ask(spark, "beta"), documents, rank.Options(since="2026-01-01", types=("concept",)))) == ["40-knowledge/concepts/Beta.md", "40-knowledge/concepts/Alpha.md"]
    assert paths(rank.rank(ask(spark, ""), documents)) == []


def test_many_queries_in_one_plan_and_results(spark, documents):
    queries = ask(spark, "alpha", "beta ranking", "zzz")
    ranked = rank.rank(queries, documents)
    assert {r["query_id"] for r in ranked.collect()} == {"q0", "q1"}
    rows = rank.results(ranked, queries, documents).where("query_id = 'q1' and title = 'Alpha retrieval'").collect()
    assert "ranking" in rows[0]["excerpt"] and rows[0]["links"] == ["Beta", "Hub"]


def test_graph(spark, table):
    assets = spark.createDataFrame([("99-attachments/pic.png",)], "path string")
    targets = graph.link_targets(table, assets)
    assert {(r["src"][-8:], r["target"]) for r in graph.unresolved(targets).where("src not like '90%'").collect()} >= {("/Beta.md", "Missing"), ("/Beta.md", "Nowhere")}
    edges = graph.edges(targets)
    start = table.where("path = 'Home.md'").select("path")
    near = {r["path"]: r["distance"] for r in graph.related(start, edges, 2).collect()}
    assert near == {"40-knowledge/Hub.md": 1, "40-knowledge/concepts/Alpha.md": 2, "40-knowledge/concepts/Beta.md": 2}
    with pytest.raises(ValueError):
        graph.related(start, edges, 4)
    assert {r["path"] for r in graph.orphans(table, edges).collect()} == {"10-projects/Lost.md", "90-system/templates/T.md"}
    assert graph.cycles(spark.createDataFrame([("b", "c"), ("c", "a"), ("a", "b"), ("x", "y")], "src string, dst string")) == [["a", "b", "c"]]


def test_ambiguous_stems_do_not_resolve(spark):
    t = notes(spark.createDataFrame([("a/X.md", "[[x]]"), ("b/X.md", ""), ("c/Y.md", "[[wrong/Z.md|z]] [[a\\X]]"), ("d/Z.md", "")], "path string, content string"))
    got = {(r["src"], r["target"], r["dst"]) for r in graph.link_targets(t).collect()}
    assert got == {("a/X.md", "x", None), ("c/Y.md", "wrong/Z", "d/Z.md"), ("c/Y.md", "a/X", "a/X.md")}


def test_findings(table):
    found = {(r["family"], r["path"], r["issue"]) for r in checks.findings(table, DAY).collect()}
    beta, gamma, lost = "40-knowledge/concepts/Beta.md", "40-knowledge/concepts/Gamma.md", "10-projects/Lost.md"
    assert {
        ("typed_relation_integrity", beta, "dangling_target"), ("typed_relation_integrity", beta, "self_relation"), ("typed_relation_integrity", beta, "target_must_be_one_wikilink"),
        ("typed_relation_integrity", beta, "supersession_cycle"), ("typed_relation_inverses", "40-knowledge/concepts/Alpha.md", "supports:supported_by"),
        ("redirect_integrity", "10-projects/Bad.md", "redirect_status_must_be_superseded"), ("redirect_integrity", "10-projects/Bad.md", "redirect_chain"),
        ("duplicate_ids", "40-knowledge/concepts/Alpha.md", "alpha"), ("duplicate_titles", beta, "beta"), ("placement", lost, "concept"), ("moc_coverage", lost, "concept"),
        ("orphans", lost, "orphan"), ("stale", gamma, "stale"), ("freshness", lost, "pointer_truth_source_must_be_scalar"), ("freshness", lost, "invalid_freshness_window_days"),
        ("freshness", lost, "verification_expired"), ("ai_review", lost, "missing_visible_callout"), ("metadata_issues", lost, "invalid_review_on"), ("unresolved_links", beta, "unresolved"),
    } <= found
    assert not any(p.startswith("90-system") for f, p, _ in found if f not in ("orphans", "unresolved_links"))
    assert checks.exit_code(checks.findings(table, DAY)) == 1


def test_evidence_rules(spark):
    rows = [
        ("40-knowledge/concepts/a.md", note("a", "code-pattern", "A", status="draft")),
        ("40-knowledge/concepts/b.md", note("b", "code-pattern", "B")),
        ("00-inbox/c.md", note("c", "note", "C", status="draft", extra="capture_kind: feedback\nscope: x\nconfidence: sure\nevidence: text\n")),
    ]
    found = {(r["path"][-4:], r["issue"], r["detail"]) for r in checks.metadata_issues(notes(spark.createDataFrame(rows, "path string, content string"))).collect()}
    assert found == {("b.md"[-4:], "missing", k) for k in ("scope", "confidence", "evidence", "last_verified")} | {("c.md"[-4:], "invalid_confidence", "sure"), ("c.md"[-4:], "invalid_field", "evidence")}


def stub(name, body, description="d"):
    return f"---\nname: {name}\ndescription: {description}\n---\n{body}\n"


def test_skill_pointers_from_files(spark, tmp_path):
    put = lambda at, text: ((tmp_path / at).parent.mkdir(parents=True, exist_ok=True), (tmp_path / at).write_text(text))
    for name in ("a", "b", "e"):
        put(f"90-system/skills/{name}/SKILL.md", stub("bb" if name == "b" else name, "x"))
    up = "../../../90-system/skills"
    put(".claude/skills/a/SKILL.md", stub("a", f"See `{up}/a/SKILL.md`."))
    put(".claude/skills/b/SKILL.md", stub("b", f"See `{up}/b/SKILL.md`.", "other"))
    put(".claude/skills/c/SKILL.md", stub("c", "nothing"))
    put(".agents/skills/d/SKILL.md", stub("d", f"`{up}/a/SKILL.md` and `{up}/b/SKILL.md`"))
    put(".agents/skills/f/SKILL.md", stub("f", "`C:/90-system/skills/a/SKILL.md`"))
    put(".agents/skills/g/SKILL.md", stub("g", "`../../../../90-system/skills/a/SKILL.md`"))
    put(".agents/skills/h/SKILL.md", stub("h", f"`{up}/none/SKILL.md`"))
    put(".agents/skills/i/SKILL.md", stub("i", "`../../../x/90-system/skills/a/SKILL.md`"))
    stubs, table = notes(corpus.scan(spark, str(tmp_path), "adapters")), notes(corpus.scan(spark, str(tmp_path)))
    assert {(r["path"].split("/")[2], r["issue"]) for r in checks.skill_pointers(stubs, table).collect()} == {
        ("b", "name_mismatch"), ("b", "description_mismatch"), ("b", "directory_name_mismatch"), ("c", "no_canonical_reference"), ("d", "multiple_canonical_references"),
        ("f", "nonportable_reference"), ("g", "outside_vault"), ("h", "missing_target"), ("i", "unexpected_target"),
    }
    assert checks.findings(table, DAY, stubs=stubs).where("family = 'skill_pointers'").count() == 9


def test_rings_of_many_tangles(spark):
    edges = [(f"t{t}n{i}", f"t{t}n{(i + 1) % (t + 2)}") for t in range(12) for i in range(t + 2)] + [("x", "t0n0"), ("t1n0", "y"), ("t3n0", "t3n2"), ("z", "z")]
    got = graph.cycles(spark.createDataFrame(edges, "src string, dst string"))
    names = lambda t: [f"t{t}n{i}" for i in range(t + 2)]
    turned = lambda ring: min(ring[i:] + ring[:i] for i in range(len(ring)))
    assert {tuple(r) for r in got} >= {tuple(turned(names(t))) for t in range(12)} and len(got) == 12  # the chord closes no further one
    assert graph.cycles(spark.createDataFrame([("a", "b")], "src string, dst string")) == []


def test_merge_context(spark):
    rows = [("a.md", ["b", "Other", "c"]), ("b.md", []), ("c.md", []), ("r.md", [])]
    table = spark.createDataFrame(rows, "path string, links array<string>")
    found = graph.links_at_risk(table, "b.md", "a.md", ["C.md", "x"])
    assert [r["target"] for r in found.collect()] == ["Other"]


def test_many_notes_of_one_title_are_counted_and_listed_as_rows(spark):
    table = notes(spark.createDataFrame([(f"10-projects/n{i:03}.md", "---\nid: same\n---\n# Same\n") for i in range(250)] + [("10-projects/x.md", "# Other\n")], "path string, content string"))
    row = checks.duplicate_titles(table).collect()
    assert [(r["title"], r["n"], len(r["paths"]), r["paths"][0]) for r in row] == [("same", 250, checks.LISTED_PATHS, "10-projects/n000.md")]
    assert checks.members(checks.id_rows(table), checks.duplicate_ids(table), "id").count() == 250


def test_readability(spark):
    long = " ".join(["word"] * 130)
    text = note("r", "note", "R", f"{long}\n\n#### Deep\n\n- {long}\n\n## Use\n\n```\n## Use\n```\n\n## use\n\n{long}")
    rows = {(r["issue"], r["detail"]) for r in readability.report(notes(spark.createDataFrame([("00-inbox/r.md", text)], "path string, content string"))).collect()}
    assert rows == {("missing_lead", "395"), ("heading_jump", "13:Deep"), ("duplicate_heading", "use:17,23"), ("long_paragraph", "130")}


def test_reports_and_views(spark, table):
    assert [(r["line"], r["text"]) for r in reports.tasks(table).collect()] == [(4, "open task")]
    assert [(r["tag"], r["n"]) for r in reports.tags(table).collect()] == [("core", 1), ("search", 1)]
    assert reports.stale(table, DAY, 100).first()["path"] == "40-knowledge/concepts/Gamma.md"
    context = views.Context(DAY, "40-knowledge/concepts/Alpha.md")
    assert {r["path"] for r in views.view(table, "Linked notes", context).collect()} == {"40-knowledge/Hub.md", "40-knowledge/concepts/Beta.md", "10-projects/Old.md"}
    assert {r["path"] for r in views.view(table, "Concepts", context).collect()} == {f"40-knowledge/concepts/{n}.md" for n in ("Alpha", "Beta", "Gamma")}
    assert len(views.given(spark)) == 13
    with pytest.raises(ValueError):
        views.compiled("nonsense", context)


@pytest.mark.parametrize("budget", [10, 60, 200, 1000])
def test_pack_keeps_its_budget(budget):
    rows = [{"title": f"T{i}", "path": f"p{i}.md", "body": "line\n" * 300} for i in range(5)]
    text = pack.pack("what", rows, budget)
    assert text is None or len(text.replace("\n", "\r\n")) <= 4 * budget
    assert (text is None) == (budget == 10)


def test_evaluation_and_gates(spark):
    ranked = spark.createDataFrame([("c1", 1, "a"), ("c1", 2, "x"), ("c1", 3, "b")], "query_id string, rank int, path string")
    cases = spark.createDataFrame([("c1", "k", ["a", "b"], ["x"]), ("c2", "k", ["z"], None)], "case_id string, category string, expected array<string>, forbidden array<string>")
    sizes = spark.createDataFrame([("a", 10), ("x", 5), ("b", 1)], "path string, size long")
    rows = {r["case_id"]: r for r in evaluate.case_results(ranked, cases, sizes, (1, 3)).collect()}
    assert (rows["c1"]["recall_1"], rows["c1"]["recall_3"], rows["c1"]["forbidden_1"], rows["c1"]["forbidden_3"], rows["c1"]["bytes_3"]) == (0.5, 1.0, 0.0, 1.0, 16)
    assert rows["c2"]["recall_3"] == 0 and rows["c2"]["forbidden_3"] is None
    overall = evaluate.metrics(evaluate.case_results(ranked, cases, sizes, (1, 3)), (1, 3)).where("category is null").first()
    assert (overall["cases"], overall["mrr"], overall["recall_3"], overall["forbidden_cases"], overall["forbidden_3"]) == (2, 0.5, 0.5, 1, 1.0)
    stage = "struct<success: boolean, evidence_found: boolean, seconds: double, files_opened: int>"
    pairs = [(str(i), "capture" if i < 2 else "find", (True, True, 100.0, 3), (True, True, 70.0, 2)) for i in range(10)]
    gate = evaluate.rollout_gate(spark.createDataFrame(pairs, f"id string, category string, baseline {stage}, candidate {stage}")).first()
    assert gate["time_improvement"] == 0.3 and gate["supported"] and gate["reasons"] == "measured_usability_gate_passed"
    few = evaluate.rollout_gate(spark.createDataFrame(pairs[:3], f"id string, category string, baseline {stage}, candidate {stage}")).first()
    assert few["reasons"] == "insufficient_paired_cases" and not few["supported"]


def test_upsert(spark):
    a = spark.createDataFrame([("p", 1), ("q", 1)], "path string, v int")
    new = index.upserted(a, spark.createDataFrame([("q", 2)], "path string, v int"), spark.createDataFrame([("p",)], "path string"))
    assert [tuple(r) for r in new.collect()] == [("q", 2)]


def test_corpus_source_and_manifest(spark, tmp_path):
    for p, t in {"a/_x.md": "# X", "_d/y.MD": "y", ".git/z.md": "z", ".hid.md": "h", "pic.png": "b", "__pycache__/q.md": "q"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(t)
    listed = corpus.scan(spark, str(tmp_path))
    assert {r["path"] for r in listed.collect()} == {"a/_x.md", "_d/y.MD"}
    assert [r["path"] for r in corpus.scan(spark, str(tmp_path), "assets").collect()] == ["pic.png"]
    old = listed.where("path like 'a%'").withColumn("size", F.col("size") + 1).unionByName(listed.where("path like 'a%'").withColumn("path", F.lit("gone.md")))
    assert {(r["path"], r["change"]) for r in corpus.manifest_diff(old, listed).collect()} == {("a/_x.md", "changed"), ("_d/y.MD", "added"), ("gone.md", "removed")}
