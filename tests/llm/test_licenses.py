import random

import regex

from corvane.llm import licenses
from corvane.llm.licenses import NOTICES, Scanner, fold


def words_of(text):
    return regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", regex.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain(text):
    """Places of phrases by words, and matches of notices by one search of the whole text, without pieces."""
    words = words_of(text)
    base = sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())
    flat = " " + " ".join(words) + " " if words else " "
    near = set()
    for n in NOTICES:
        for m in regex.finditer(f"(?e)(?:{regex.escape(n.words)}){{e<={n.errors}}}", flat):
            a, b = m.span()
            a += len(m.group()) - len(m.group().lstrip(" "))
            b -= len(m.group()) - len(m.group().rstrip(" "))
            a, b = flat.rfind(" ", 0, a + 1) + 1, flat.find(" ", b)
            if n.needs <= {w.encode() for w in flat[a:b].split(" ")}:
                near.add((n.label, flat.count(" ", 0, a) - 1, sum(m.fuzzy_counts)))
    return len(words), base, near


def spoiled(text, n, rng):
    text = list(text)
    for _ in range(n):
        i = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[i] = rng.choice("xyzé")
        elif kind == 1:
            text.insert(i, rng.choice("xyzé"))
        elif len(text) > 1:
            del text[i]
    return "".join(text)


def texts_with_notices():
    rng = random.Random(3)
    filler = lambda n: " ".join("".join(rng.choices("abcdeéñlr", k=rng.randint(1, 8))) for _ in range(n))
    out = []
    for i in range(120):
        n = NOTICES[i % len(NOTICES)]
        line = spoiled(n.words.upper() if i % 3 else n.words, rng.randint(0, n.errors + 2), rng)
        line = line.replace(" ", rng.choice([" ", "\n * ", ", ", "--"]))
        out.append(f"{filler(rng.randint(0, 30))}{rng.choice(['. ', '(', chr(10)])}{line}{rng.choice([')', ' ', '. '])}{filler(rng.randint(0, 30))}")
    return out


def test_pieces_find_what_a_search_of_whole_texts_finds(spark):
    texts = texts_with_notices()
    found = Scanner().scan([t.encode() for t in texts])
    some = 0
    for text, row in zip(texts, found, strict=True):
        n, base, near = plain(text)
        assert (row["n_words"], row["n_base"]) == (n, len(base))
        flat = fold([text.encode()])
        assert {(m.notice.label, flat.count(b" ", 0, m.start) - 1, m.edits) for m in Scanner().matches(flat)} == near
        assert row["labels"] == ",".join(sorted({x for _, x in base} | {x for x, _, _ in near}))
        some += bool(near)
    assert some > 60


def test_phrases_are_found_by_words(spark):
    docs = spark.createDataFrame(
        [(1, "Under the MIT License; under  the\nmit-license. CC BY-NC 4.0"), (2, "under the mit licenses, xcc by nc, cc by ncé"), (3, None), (4, ""), (None, "... !"), (5, "Apache License, Version 2.0"), (5, "cc_by nc"), (6, "Released under teh MIT Licence."), (7, "GNU General Public License, version 3")],
        "doc_id long, text string",
    ).selectExpr("*", "1 as n_words", "'x' as labels")
    got = [tuple(r) for r in licenses.scan_licenses(docs).orderBy("doc_id", "n_words").select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels").collect()]
    assert got == [
        (None, 0, 0, None, None, "", ""),
        (1, 13, 3, 0, 8, "cc-by-nc,mit", "cc-by-nc,mit"),
        (2, 10, 0, None, None, "", ""),
        (3, 0, 0, None, None, "", ""),
        (4, 0, 0, None, None, "", ""),
        (5, 3, 1, 0, 0, "cc-by-nc", "cc-by-nc"),
        (5, 5, 1, 0, 0, "apache-2", "apache-2"),
        (6, 5, 0, None, None, "", "mit"),
        (7, 6, 0, None, None, "", "gpl-3"),
    ]
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def test_spans_are_code_points_of_the_text():
    text = "Größe — (Released  under the MIT Licence). Ende"
    (row,) = Scanner().scan([text.encode()])
    label, start, end, edits = row["notices"].split(",")[0].split(":")
    assert (label, text[int(start) : int(end)], edits) == ("mit", "Released  under the MIT Licence", "1")
    assert 0.9 < row["score"] < 1


def test_texts_are_apart_and_long_ones_are_whole():
    long = "word " * 400_000 + "released under the mit license " + "é" * 1000
    rows = Scanner().scan([b"released under", b"the mit license", long.encode(), b""])
    assert [r["labels"] for r in rows] == ["", "", "mit", ""]
    assert (rows[2]["first_word"], rows[2]["n_words"]) == (400_001, 400_006)
