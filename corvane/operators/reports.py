"""Reports: tasks, tags, staleness, inventory, links to open a note."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.parse import meta
from .checks import tag_counts


def tasks(notes: DataFrame, state: str = "open", prefix: str = "") -> DataFrame:
    """path, line (of the body), done, text."""
    rows = notes.where(F.col("path").startswith(prefix)) if prefix else notes
    rows = rows.select("path", F.explode("tasks").alias("t")).select("path", "t.line", "t.done", "t.text")
    return rows if state == "all" else rows.where(F.col("done") == (state == "done"))


def tags(notes: DataFrame, least: int = 1) -> DataFrame:
    """tag, n by falling count, then tag."""
    return tag_counts(notes).where(F.col("n") >= least).orderBy(F.desc("n"), "tag")


def tag_summary(notes: DataFrame) -> DataFrame:
    """Distinct tags, uses, and tags used once."""
    return tag_counts(notes).agg(F.count("*").alias("distinct_tags"), F.coalesce(F.sum("n"), F.lit(0)).alias("uses"), F.count_if(F.col("n") == 1).alias("singletons"))


def stale(notes: DataFrame, as_of: datetime.date, days: int) -> DataFrame:
    """Notes not updated for more than ``days`` days, or without a proper date: path, updated, days."""
    updated = X.strict_date(meta("updated"))
    age = F.datediff(F.lit(as_of), updated)
    rows = notes.select("path", "type", "status", F.date_format(updated, "yyyy-MM-dd").alias("updated"), age.alias("days"))
    return rows.where(F.col("days").isNull() | (F.col("days") > days)).orderBy(F.desc_nulls_last("days"), X.fold(F.col("path")))


def type_histogram(notes: DataFrame) -> DataFrame:
    kind = F.when(F.coalesce("type", F.lit("")) == "", "untyped").otherwise(F.col("type"))
    return notes.groupBy(kind.alias("type")).agg(F.count("*").alias("n"))


def inventory(notes: DataFrame) -> DataFrame:
    """What the generated index lists of each note."""
    return notes.select("path", "title", "type", "status", "tags", F.size("links").alias("n_links"), F.size("tasks").alias("n_tasks"), "sha256", "size").orderBy(X.fold(F.col("path")))


def inventory_markdown(notes: DataFrame) -> DataFrame:
    """The listing as lines of Markdown, one column ``value``, in order."""
    path = F.regexp_replace("path", r"(?i)\.md$", "")
    line = F.concat(F.lit("- [["), path, F.lit("|"), F.col("title"), F.lit("]] ("), F.coalesce(F.nullif("type", F.lit("")), F.lit("untyped")), F.lit(")"))
    return notes.select(X.fold(F.col("path")).alias("k"), line.alias("value")).orderBy("k").select("value")


def open_uri(vault: Column, path: Column, heading: Column | None = None) -> Column:
    """URI that opens a note, at a heading if given."""
    file = path if heading is None else F.concat(path, F.lit("#"), heading)
    return F.concat(F.lit("obsidian://open?vault="), X.percent_encoded(vault), F.lit("&file="), X.percent_encoded(file))
