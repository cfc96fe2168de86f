import datetime

from corvane.functions.parse import notes
from corvane.operators import graph, views


def test_notes_of_small_files_are_not_broadcast_to_their_links(spark, tmp_path):
    rows = [(f"a/n{i}.md", f"---\ntype: t{i % 2}\n---\n[[{'hub' if i % 3 else 'n1'}]]\n") for i in range(50)]
    spark.createDataFrame([*rows, ("hub.md", "# Hub\n")], "path string, content string").write.parquet(f"{tmp_path}/files")
    table = notes(spark.read.parquet(f"{tmp_path}/files"))
    out = views.view(table, "Linked notes", views.Context(datetime.date(2020, 1, 1), "hub.md"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [path#" in plan and "BroadcastHashJoin [path#" not in plan
    assert {r["path"] for r in out.collect()} == {f"a/n{i}.md" for i in range(50) if i % 3}


def test_keys_of_notes_are_not_broadcast_to_the_targets(spark, tmp_path, monkeypatch):
    plans = []
    written = graph.store.written

    def noted(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, tag)

    spark.createDataFrame([("a/x.md", ["y"]), ("b/y.md", ["a/x", "none"])], "path string, links array<string>").write.parquet(f"{tmp_path}/n")
    monkeypatch.setattr(graph.store, "written", noted)
    out = graph.link_targets(spark.read.parquet(f"{tmp_path}/n"))
    assert sorted((r["src"], r["target"], r["dst"]) for r in out.collect() if r["dst"]) == [("a/x.md", "y", "b/y.md"), ("b/y.md", "a/x", "a/x.md")]
    assert "BroadcastHashJoin" not in plans[-1] and plans[-1].count("SortMergeJoin") == 2
