"""Readability rules over headings and prose paragraphs; lines count from the file's first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as X


def heading_table(notes: DataFrame) -> DataFrame:
    """path, pos, level, name, line, start."""
    return notes.select("path", F.posexplode("heading_rows").alias("pos", "h")).select("path", "pos", "h.*")


def heading_jumps(headings: DataFrame) -> DataFrame:
    """Headings more than one level below the one before."""
    before = F.lag("level").over(Window.partitionBy("path").orderBy("pos"))
    return headings.withColumn("previous", before).where(F.col("level") > F.col("previous") + 1).select("path", "line", "name", "previous", "level")


def duplicate_headings(headings: DataFrame) -> DataFrame:
    """Headings of level 2 or lower that a note repeats (folded), with their lines."""
    rows = headings.where("level >= 2").groupBy("path", X.fold(F.col("name")).alias("heading"))
    return rows.agg(F.count("*").alias("n"), F.sort_array(F.collect_list("line")).alias("lines")).where("n > 1")


def long_paragraphs(notes: DataFrame, most: int = C.READABLE_PARAGRAPH_WORDS) -> DataFrame:
    """path, words of prose paragraphs with more than ``most`` words."""
    return notes.select("path", F.explode("prose").alias("words")).where(F.col("words") > most)


def leads(notes: DataFrame, least_words: int = C.READABLE_MIN_WORDS, most_lead: int = C.READABLE_LEAD_WORDS) -> DataFrame:
    """Long notes without a lead, and notes whose lead comes late: path, issue, words."""
    is_lead = lambda h: (h["level"] >= 2) & X.fold(F.trim(h["name"])).isin(*C.LEAD_LABELS)
    starts = F.transform(F.filter("heading_rows", is_lead), lambda h: h["start"])
    callout = F.locate("[!abstract]", F.lower("body")) - 1
    first = F.least(F.array_min(starts), F.when(callout >= 0, callout))
    rows = notes.withColumns({"words": F.size(X.tokens(F.col("body"))), "first_lead": first})
    before = F.size(X.tokens(X.without_code(F.substring("body", F.lit(1), F.col("first_lead")))))
    issue = F.when((F.col("words") >= least_words) & F.col("first_lead").isNull(), "missing_lead").when(F.col("first_lead").isNotNull() & (before > most_lead), "buried_lead")
    return rows.withColumn("issue", issue).where("issue is not null").select("path", "issue", "words")


def readable(notes: DataFrame, prefix: str = "") -> DataFrame:
    out = notes.where(F.col("type").isin(*C.READABLE_TYPES))
    return out.where(F.col("path").startswith(prefix)) if prefix else out


def report(notes: DataFrame, prefix: str = "") -> DataFrame:
    """path, issue, detail of all rules."""
    own = readable(notes, prefix)
    headings = heading_table(own)
    rows = leads(own).select("path", "issue", F.col("words").cast("string").alias("detail"))
    rows = rows.unionByName(heading_jumps(headings).select("path", F.lit("heading_jump").alias("issue"), F.concat_ws(":", "line", "name").alias("detail")))
    rows = rows.unionByName(duplicate_headings(headings).select("path", F.lit("duplicate_heading").alias("issue"), F.concat_ws(":", "heading", F.array_join(F.col("lines").cast("array<string>"), ",")).alias("detail")))
    return rows.unionByName(long_paragraphs(own).select("path", F.lit("long_paragraph").alias("issue"), F.col("words").cast("string").alias("detail")))


def summary(notes: DataFrame) -> DataFrame:
    """Notes examined and the exact median of their words."""
    return readable(notes).select(F.size(X.tokens(F.col("body"))).alias("words")).agg(F.count("*").alias("notes"), F.median("words").alias("median_words"))
