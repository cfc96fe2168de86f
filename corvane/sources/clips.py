"""Clipped web pages as raw-source notes, by the contract of browser clippers.

A clip has title, url, site, author, published, content and the time it was
taken. Its note is a draft: everything external stays within the payload
boundary until the note is reviewed and sealed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import CLIP_FOLDER, CLIP_HUB, CLIP_TAG, PAYLOAD_BEGIN, PAYLOAD_END


def kebab(c: Column) -> Column:
    """Letters and digits in lower case, all else as single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")


def safe_name(c: Column) -> Column:
    """A title as a file name: without the characters that file systems and links use."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|#^\[\]]+', " "), r"\s+", " "))


def quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def properties() -> list[tuple[str, Column]]:
    """The note's metadata in order; all dates are the day of the clip."""
    day, text = F.date_format("clipped_at", "yyyy-MM-dd"), lambda x: F.lit(x)
    return [
        ("id", F.concat(F.lit("raw-web-"), F.date_format("clipped_at", "yyyyMMdd-HHmmss"), F.lit("-"), kebab(F.col("title")))), ("type", text("raw-source")), ("status", text("draft")), ("created", day), ("updated", day),
        ("sealed", text("false")), ("content_sha256", text('""')), ("tags", text(f"[{CLIP_TAG}]")), ("source_url", quoted(F.col("url"))), ("author", quoted(F.col("author"))), ("published", quoted(F.col("published"))),
        ("accessed", day), ("capture_scope", text("excerpt")), ("freshness", text("snapshot")), ("observed", day), ("derived_notes", text("[]")),
    ]


def clipped(clips: DataFrame) -> DataFrame:
    """path and content of a note for each clip; payload marks within the content are broken up."""
    head = F.concat(*(F.concat(F.lit(f"{k}: "), v, F.lit("\n")) for k, v in properties()))
    inner = F.coalesce("content", F.lit(""))
    for mark in (PAYLOAD_BEGIN, PAYLOAD_END):
        inner = F.replace(inner, F.lit(mark), F.lit(mark.replace(":", " : ")))
    title = F.concat(F.lit("# "), F.regexp_replace("title", r"\s+", " "), F.lit(" — "), F.date_format("clipped_at", "yyyy-MM-dd HH:mm:ss"))
    context = F.concat(F.lit("Captured from ["), F.coalesce("site", F.lit("")), F.lit("]("), F.coalesce("url", F.lit("")), F.lit(") on "), F.date_format("clipped_at", "yyyy-MM-dd"), F.lit("."))
    parts = [title, F.lit(f"Parent: [[{CLIP_HUB}]]"), F.lit("> [!warning] Untrusted external capture"), F.lit("## Capture context"), context, F.lit("## Untrusted source payload"), F.lit(PAYLOAD_BEGIN), inner, F.lit(PAYLOAD_END), F.lit("## Derived notes"), F.lit("## Capture limitations")]
    name = F.concat(F.date_format("clipped_at", "yyyy-MM-dd HHmmss"), F.lit(" - "), safe_name(F.col("title")))
    return clips.select(F.concat(F.lit(CLIP_FOLDER + "/"), name, F.lit(".md")).alias("path"), F.concat(F.lit("---\n"), head, F.lit("---\n\n"), F.concat_ws("\n\n", *parts), F.lit("\n")).alias("content"))
