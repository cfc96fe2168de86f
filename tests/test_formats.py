"""Format letters and slugs on columns against Python's calendar and decomposition."""

import datetime
import re
import unicodedata

from pyspark.sql import functions as F

from corvane.functions import constants as C
from corvane.functions import formats


def test_weeks_and_literals(spark):
    days = [datetime.date(2026, 9, 4), datetime.date(2021, 1, 3), datetime.date(2024, 12, 30), datetime.date(999, 3, 7), None]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(days)], "i int, d date")
    formed = {p: [r[0] for r in rows.orderBy("i").select(formats.moment(F.col("d"), p)).collect()] for p in ("GGGG-[W]WW", "YYYY-MM-DD", "dddd, D MMMM YY", "ddd D.M. [open", "[]W GG HH:mm:ss x")}
    iso = [d and d.isocalendar() for d in days]
    assert formed["GGGG-[W]WW"] == [d and f"{d[0]:04d}-W{d[1]:02d}" for d in iso]
    assert formed["YYYY-MM-DD"] == [d and d.isoformat() for d in days]
    assert formed["dddd, D MMMM YY"] == [d and f"{d:%A}, {d.day} {d:%B} {d.year % 100:02d}" for d in days]
    assert formed["ddd D.M. [open"] == [d and f"{d:%a} {d.day}.{d.month}. [open" for d in days]
    assert formed["[]W GG HH:mm:ss x"] == [d and f"{i[1]} {i[0] % 100:02d} 00:00:00 x" for d, i in zip(days, iso, strict=True)]


def test_clock_of_timestamps(spark):
    at = spark.createDataFrame([(datetime.datetime(2026, 9, 4, 7, 5, 9),)], "t timestamp")
    assert at.select(formats.moment(F.col("t"), "HH.mm.ss")).first()[0] == "07.05.09"
    assert at.select(formats.moment(F.col("t"), "")).first()[0] == ""


def slug(title):
    for letter, spelling in C.TRANSLITERATIONS.items():
        title = title.replace(letter, spelling)
    plain = unicodedata.normalize("NFKD", title).encode("ascii", "ignore").decode()
    return re.sub(r"[^a-zA-Z0-9]+", "-", plain).strip("-").lower() or "note"


def test_slugs(spark):
    every = ["".join(map(chr, range(i, i + 61))) for i in range(1, 0xD800 - 61, 61)] + ["".join(map(chr, range(i, i + 61))) for i in range(0x1D400, 0x1D800, 61)]
    titles = ["Größen & Maße", "Ärger  im   Büro!", "Café № 5 ﬁn", "---", "", "日本", "a\nb", "é" * 1000, "plain title", *every]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*titles, None])], "i int, t string")
    assert [r[0] for r in rows.orderBy("i").select(formats.slug(F.col("t"))).collect()] == [*map(slug, titles), None]
