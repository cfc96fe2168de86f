"""Scans that enter only the folders that conditions on the path leave."""

import os

import pytest

from corvane.sources import corpus

PATHS = ["Home.md", "10-projects/a.md", "10-projects/deep/er/b.md", "10-projects-old/c.md", "20-areas/d.md", "20-areas/pic.png", "_x/e.md", ".git/f.md"]


@pytest.fixture
def root(tmp_path):
    for p in PATHS:
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(f"# {p}\n")
    return tmp_path


def broken(root, name):
    """A file that exists in listings and fails whoever opens it."""
    os.symlink(root / name, root / name)


def paths(df):
    return sorted(r.path for r in df.select("path").collect())


def test_only_the_folder_is_opened(spark, root):
    broken(root, "20-areas/loop.md")
    broken(root, "10-projects-old/loop.md")
    own = lambda **some: paths(corpus.scan(spark, str(root), **some))
    assert own(prefixes=["10-projects/"]) == ["10-projects/a.md", "10-projects/deep/er/b.md"]
    assert own(prefixes=["10-projects/deep", "_x/"]) == ["10-projects/deep/er/b.md", "_x/e.md"]
    assert own(paths=["Home.md"]) == ["Home.md"]
    assert own(paths=["_x/e.md", "10-projects/a.md", "none.md", ".git/f.md"]) == ["10-projects/a.md", "_x/e.md"]
    assert own(paths=["Home.md"], prefixes=["10"]) == own(prefixes=[]) == own(paths=[]) == []
    assert own(kind="assets", prefixes=["20"]) == ["20-areas/pic.png"]
    with pytest.raises(Exception, match="loop.md"):
        own(prefixes=["20"])


def test_branches_of_a_plan_keep_their_own_rows(spark, root):
    rows = corpus.scan(spark, str(root))
    both = rows.where("startswith(path, '10-projects/')").unionByName(rows.where("path = 'Home.md'")).unionByName(rows)
    assert both.count() == 2 + 1 + 6


@pytest.mark.parametrize("on_driver", ["1", "2", "3", "4096"])
def test_listing_in_tasks_gives_the_same(spark, root, on_driver):
    corpus.register(spark)
    rows = spark.read.format("corpus").option("foldersOnDriver", on_driver)
    assert paths(rows.load(str(root))) == sorted(p for p in PATHS if p.endswith(".md") and not p.startswith("."))
    assert paths(rows.option("prefixes", '["10-projects/deep"]').load(str(root))) == ["10-projects/deep/er/b.md"]


def test_folders_that_are_entered(root, monkeypatch):
    entered = []
    own = corpus.entries
    monkeypatch.setattr(corpus, "entries", lambda at, folder: entered.append(folder) or own(at, folder))

    def listed(**options):
        entered.clear()
        reader = corpus.CorpusReader({"path": str(root), **options})
        return [r[0] for part in reader.partitions() for r in reader.read(part)]

    assert listed(prefixes='["10-projects/"]') == ["10-projects/a.md", "10-projects/deep/er/b.md"]
    assert entered == ["", "10-projects", "10-projects/deep", "10-projects/deep/er"]
    assert listed(only='["20-areas/d.md"]', foldersOnDriver="1") == ["20-areas/d.md"] and entered == ["", "20-areas"]
    assert listed(only='["Home.md"]') == ["Home.md"] and entered == [""]
    assert listed(prefixes='["nowhere/"]') == [] and entered == [""]
