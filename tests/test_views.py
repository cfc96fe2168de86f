"""View files and their conditions: reading, precedence, functions, refusals with their place, SQL over views."""

import datetime
import os

import pytest

from corvane.functions.parse import notes
from corvane.operators import views
from corvane.sources import viewfiles

DAY = datetime.date(2026, 9, 4)
CONTEXT = views.Context(DAY, "b/hub.md")


def note(**head):
    return "---\n" + "".join(f"{k}: {v}\n" for k, v in head.items()) + "---\n\n# T\n"


@pytest.fixture(scope="module")
def table(spark):
    rows = {
        "a/one.md": note(type="moc", status="active", review_on="2026-09-04", rank="7", tags="[x/y, z]") + "[[b/hub]]",
        "a/two.md": note(type="note", status="draft", review_on="2026-09-05", rank="12"),
        "a/deep/three.md": note(type="note", status="active", review_on="soon", rank="many", owner='"He said ""x"""'),
        "b/hub.md": note(type="hub") + "[[one]]",
        "ab/four.md": note(status="draft", tags="[zz]"),
        "five.MD": "no metadata",
    }
    return notes(spark.createDataFrame(list(rows.items()), "path string, content string"))


def held(table, text):
    own = text if isinstance(text, viewfiles.View) else viewfiles.View("v", [text], ())
    return "".join(sorted({"a/one.md": "1", "a/two.md": "2", "a/deep/three.md": "3", "b/hub.md": "h", "ab/four.md": "4", "five.MD": "5"}[r.path] for r in views.view(table, own, CONTEXT).collect()))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ('type == "moc" || type == "note" && status == "draft"', "12"),
        ('(type == "moc" || type == "note") && status == "draft"', "2"),
        ('!(status == "active") && file.inFolder("a/")', "2"),
        ('!!(note.status == "active")', "13"),
        ("'draft' == status", "24"),
        ("review_on <= today()", "1"),
        ("!(review_on <= today())", "2345h"),
        ('review_on <= today() + "1 day"', "12"),
        ('review_on > date("2026-08-01") + "1M" - "2 days"', "12"),
        ('review_on >= today() + "1y"', ""),
        ("review_on != null", "123"),
        ("null == review_on", "45h"),
        ("rank > 7.5", "2"),
        ("rank >= 7", "12"),
        ("rank > '7'", "3"),  # texts: "12" < "7" < "many"
        ("status.isEmpty()", "5h"),
        ('file.name.endsWith("e.md") && file.path.contains("deep")', "3"),
        ('tags.contains("zz") || file.hasTag("#X")', "14"),
        ('file.hasTag("z")', "1"),
        ('file.hasProperty("rank")', "123"),
        ('file.folder == "a"', "12"),
        ('file.ext == "md" && file.path != this.file.path', "12345"),
        ("file.hasLink(this.file)", "1"),
        ('file.hasLink("a/one.md") || !file.hasLink(this.file) && file.inFolder("ab")', "4h"),
        ('file.inFolder("/")', "12345h"),
        ({"not": ['status == "active"', 'status == "draft"']}, "5h"),
        ({"or": [{"and": ['type == "moc"', 'type == "hub"']}, {"not": 'file.inFolder("a")'}]}, "45h"),
        ({"or": []}, ""),
        ({"not": []}, "12345h"),
    ],
)
def test_conditions(table, text, expected):
    assert held(table, text) == expected


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("nonsense", "no condition at 1 of"),
        ('status == "a" && file.mtimes() == "x"', "unknown function file.mtimes at 18 of"),
        ("file.ctime == 3", "unknown property file.ctime at 1 of"),
        ('status == "a" &&', "a value is expected at 17 of"),
        ('(status == "a"', r"\) is expected at 15 of"),
        ('status == "a" status', "unexpected status at 15 of"),
        ("status == # 3", "what begins at 11 of"),
        ("today() < 3", "day and number can't be compared at 9 of"),
        ("status < null", "null has no order for < at 8 of"),
        ('today() + "3 hours" > updated', "a day and a duration are expected at 11 of"),
        ("file.inFolder(status)", "a constant is expected at 15 of"),
        ("file.inFolder()", "file.inFolder takes 1 arguments at 1 of"),
        ("file.inFolder(this.file)", "this.file is for hasLink at 1 of"),
        ('updated == date("2026-02-30")', "'2026-02-30' is no day at 12 of"),
        ('status && type == "x"', "no condition at 1 of"),
    ],
)
def test_refusals(text, message):
    with pytest.raises(views.Unknown, match=message):
        views.compiled(text, CONTEXT)


def test_files(spark, tmp_path, table):
    (tmp_path / "one.base").write_text(
        "# a comment\nfilters:\n  and:\n    - 'type != \"moc\"'\n    - or:\n      - file.inFolder(\"a\")\n      - status == \"draft\"\n"
        "properties:\n  status:\n    displayName: Status\nviews:\n- type: table\n  name: \"Mine: all\"\n  order:\n  - file.name\n  - status\n  groupBy:\n    property: note.type\n    direction: desc\n"
        "- name: Soon\n  filters: review_on != null\n"
    )
    (tmp_path / "two.view").write_text("views: []\n")
    (tmp_path / "notes.md").write_text("views: - broken")
    read = viewfiles.read_views(spark, str(tmp_path))
    shared = [{"and": ['type != "moc"', {"or": ['file.inFolder("a")', 'status == "draft"']}]}]
    assert read == {"Mine: all": viewfiles.View("Mine: all", shared, ("file.name", "status"), "note.type", True), "Soon": viewfiles.View("Soon", [*shared, "review_on != null"], ())}
    rows = views.view(table, read["Mine: all"], CONTEXT)
    assert [(r.path, r.status) for r in rows.collect()] == [("a/deep/three.md", "active"), ("a/two.md", "draft"), ("ab/four.md", "draft")]
    assert views.register(table, read.values(), CONTEXT) == ["view_mine_all", "view_soon"]
    assert spark.sql("SELECT m.path FROM view_mine_all m JOIN view_soon USING (path) ORDER BY 1").collect() == [("a/deep/three.md",), ("a/two.md",)]
    (tmp_path / "three.view").write_text("views:\n  - name: Soon\n")
    with pytest.raises(viewfiles.BadView, match="two.view: Soon comes twice|three.view: Soon comes twice|one.base: Soon comes twice"):
        viewfiles.read_views(spark, str(tmp_path))


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("views:\n  - order: [a]\n", "view 1 has no name"),
        ("filters:\n  xor:\n    - a == 1\nviews: []\n", "one of and, or, not, but xor"),
        ("views:\n  - name: a\n\tname: b\n", "line 3: tab"),
        ("views:\n  - name: a\n    name: b\n", "line 3: name comes twice"),
        ("views: []\n  odd\n", "line 2: unexpected 'odd'"),
        ("views:\n  - name: a\n    order: [a b]\n", "order lists properties"),
        ("views:\n  - name: a\n    groupBy:\n      property: x\n      direction: up\n", "direction is ASC or DESC"),
        ("views: 3\n", "keys filters and views are expected"),
    ],
)
def test_bad_files(text, message):
    with pytest.raises(viewfiles.BadView, match=message):
        viewfiles.views_in(text, "f.view")


def test_given_views(spark):
    own = views.given(spark)
    assert len(own) == 13 and len(os.listdir(views.GIVEN)) == 5
    assert own["Linked notes"].group == "note.type" and len(own["Review due"].filters) == 2
    for one in own.values():
        views.compiled(one.filters, CONTEXT)
