import datetime
import re

import pytest
from pyspark.sql import functions as F

from corvane.functions import parse as P
from corvane.functions import text as X


@pytest.mark.parametrize(
    ("raw", "value"),
    [
        ("", ""), ("~", ""), ("null", ""), ("true", True), ("yes", "yes"), ("1843", "1843"), ("a: b: c", "a: b: c"), ("[]", []),
        ('[a, "b, c", \'d\']', ["a", "b, c", "d"]), ("[[x]]", [["x"]]), ("'it''s'", "it's"), ('"a\\nb"', "a\nb"), ('"[[x]]"', "[[x]]"), ("text # no comment", "text # no comment"),
    ],
)
def test_scalars(raw, value):
    assert P.scalar(raw) == value


def test_frontmatter_forms():
    text = "---\nid: a\n# note\nlist:\n- x\n  - y\nmap:\n  year: 1843\n  who: me\nfold: >-\n  one\n\n  two\nempty:\n: bad\n  stray: 1\nurl: http://a:1\n---\nbody\n"
    metadata, body, offset = P.frontmatter(text)
    assert metadata == {"id": "a", "list": ["x", "y"], "map": {"year": "1843", "who": "me"}, "fold": "one two", "empty": "", "url": "http://a:1"}
    assert body == "body" and offset == 18
    assert P.frontmatter("---\nid: a\nno end") == ({}, "---\nid: a\nno end", 0)
    assert P.frontmatter("") == ({}, "", 0)


def test_tasks_and_headings():
    body = "- [ ] one\n```\n- [ ] no\n```\n* [X] two\n- [x]   \n~~~\n- [ ] no\n~~~\n"
    assert [(t["line"], t["done"], t["text"]) for t in P.task_rows(body)] == [(1, False, "one"), (5, True, "two")]
    rows = P.heading_rows("# A\n```\n## no\n```\n### B\n", 4)
    assert [(r["level"], r["name"], r["line"]) for r in rows] == [(1, "A", 5), (3, "B", 9)]


def test_notes_table(spark):
    files = [
        ("a/One.md", "﻿---\nid: one\ntype: concept\ntags: x, #y\n---\n# The Title\n\nSee [[Two|t]] and [[b/Two.md#part]] `[[no]]` [[https://x]] ![[img.png]].\r\n"),
        ("a/Two.md", "plain"),
        ("raw.md", "---\ntype: raw-source\nup: '[[hub]]'\n---\n# R\n<!-- raw-source:begin -->\n[[evil]]\n- [ ] evil\n<!-- raw-source:end -->\n[[fine]]\n"),
        ("empty.md", None),
    ]
    rows = {r["path"]: r for r in P.notes(spark.createDataFrame(files, "path string, content string")).collect()}
    one = rows["a/One.md"]
    assert one["title"] == "The Title" and one["tags"] == ["x", "y"] and one["links"] == ["Two", "b/Two", "img.png"] and one["type"] == "concept"
    assert rows["a/Two.md"]["title"] == "Two" and rows["a/Two.md"]["metadata"] == {}
    assert rows["raw.md"]["links"] == ["hub", "fine"] and rows["raw.md"]["tasks"] == []
    assert rows["empty.md"]["body"] == "" and rows["empty.md"]["title"] == "empty"


def test_column_functions(spark):
    df = spark.createDataFrame([("Straße x_y it's A-b", "2024-02-30", "a\r\nb\x0bc\u2028c\n"), ("", "2024-3-1", ""), (None, "2024-03-01", None)], "t string, d string, l string")
    r = df.select(X.tokens(F.col("t")).alias("t"), X.strict_date(F.col("d")).alias("d"), X.lines(F.col("l")).alias("l")).collect()
    assert r[0]["t"] == ["strasse", "x", "y", "it's", "a-b"] and r[2]["t"] == []
    assert [x["d"] for x in r] == [None, None, datetime.date(2024, 3, 1)]
    assert r[0]["l"] == ["a", "b", "c", "c"] and r[1]["l"] == []
    u = spark.range(1).select(X.percent_encoded(F.lit("a b/c#d~*")).alias("u"), X.trigrams(F.lit("ab")).alias("g")).first()
    assert u["u"] == "a%20b%2Fc%23d~%2A" and u["g"] == ["  a", " ab", "ab "]


def test_folding_and_words_equal_full_case_folding(spark):
    chars = [chr(i) for i in range(1, 0x20000) if not 0xD800 <= i <= 0xDFFF and chr(i).isalnum()]
    texts = ["", "ΟΔΟΣ ὈΔΥΣΣΕΎΣ straße STRASSE", "İstanbul'da ﬁne-tuned", "ŉ ǰx ΐa Ꭰꭰ", "naïve Σ'ς it's a_b x--y", "Привет МИР 日本 語"]
    rows = spark.createDataFrame([(c,) for c in chars + texts], "c string").select("c", X.fold(F.col("c")).alias("f"), X.tokens(F.col("c")).alias("t")).collect()
    assert all(r["f"] == r["c"].casefold() for r in rows)
    words = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")
    known = re.compile(r"[0-9A-Za-zÀ-ɏͰ-ӿᎠ-᏿Ḁ-῿一-鿌ꭰ-ꮿﬀ-ﬗ]+")
    assert all(r["t"] == [w.casefold() for w in words.findall(r["c"])] for r in rows if len(r["c"]) > 1 or known.fullmatch(r["c"]))
