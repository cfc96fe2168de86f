"""Notes from files: loose metadata, structure, and derived columns.

Metadata and everything that needs a scan with state (frontmatter, fences,
headings outside code, prose paragraphs) is parsed in Arrow-batched functions,
one for the metadata, one for the body and one for its structure, so that what
a query doesn't use isn't computed; links, titles, tags and terms are column
expressions.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Callable
from itertools import accumulate
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from . import text as X
from .constants import FIELD_WEIGHTS, PATTERNS, PAYLOAD_BEGIN, PAYLOAD_END

HEADING = re.compile(PATTERNS["heading"], re.MULTILINE)
TASK = re.compile(PATTERNS["task"])
INLINE = re.compile("`[^`\n]*`")
NOT_BREAK = re.compile(r"[^\r\n]")
FENCED = re.compile(PATTERNS["fenced"], re.DOTALL)
QUOTED = re.compile(r"""(?P<mark>["'])(?P<inner>.*)(?P=mark)""", re.DOTALL)
INLINE_LIST = re.compile(r"\[(.*)\]", re.DOTALL)
LITERALS = {"true": True, "false": False, "null": "", "~": ""}
FENCE = re.compile(PATTERNS["fence"])
WORDS = re.compile(PATTERNS["words"])
NOT_PROSE = re.compile(PATTERNS["not_prose"])
BLOCK_SCALAR = {"|", ">", "|-", ">-", "|+", ">+"}

KIND_LIST, KIND_MAP, KIND_BOOL, KIND_STRING = "list", "map", "bool", "str"


# -- frontmatter ------------------------------------------------------------
def split_quoted(inner: str) -> list[str]:
    """Parts of ``a, "b, c", d``: commas within quotes do not part."""
    out, start, quote = [], 0, ""
    for i, c in enumerate(inner):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == ",":
            out.append(inner[start:i])
            start = i + 1
    out.append(inner[start:])
    return [p for p in map(str.strip, out) if p]


def unquoted(mark: str, inner: str) -> str:
    """The text between quotation marks: JSON escapes within double ones, a doubled mark within single ones."""
    if mark == "'":
        return inner.replace("''", "'")
    try:
        return json.loads(f'"{inner}"')
    except ValueError:
        return inner


def scalar(raw: str) -> Any:
    """A YAML scalar or inline list; numbers and dates stay strings, null is the empty string."""
    s = raw.strip()
    if s in LITERALS:
        return LITERALS[s]
    if m := QUOTED.fullmatch(s):
        return unquoted(m["mark"], m["inner"])
    if m := INLINE_LIST.fullmatch(s):
        return list(map(scalar, split_quoted(m[1])))
    return s


def first_lines(text: str) -> list[str]:
    """The lines up to the end of the frontmatter, if there is one."""
    opening = text[:200].splitlines()[:1]
    if not opening or opening[0].strip() != "---":
        return opening
    size = 2048
    while True:
        lines = text[:size].splitlines()
        if size >= len(text) or header_end(lines[:-1]):
            return lines
        size *= 4


def header_end(lines: list[str]) -> int:
    """Number of lines of the frontmatter, 0 without one."""
    if lines and lines[0].strip() == "---":
        for i, line in enumerate(lines[1:], 1):
            if line.strip() == "---":
                return i + 1
    return 0


def frontmatter(text: str) -> tuple[dict[str, Any], str, int]:
    """(metadata, body, lines before the body)."""
    lines = text.splitlines()
    end = header_end(lines)
    return (header(lines[1 : end - 1]), "\n".join(lines[end:]), end) if end else ({}, text, 0)


def metadata_of(text: str) -> dict[str, Any]:
    lines = first_lines(text)
    end = header_end(lines)
    return header(lines[1 : end - 1]) if end else {}


def header(lines: list[str]) -> dict[str, Any]:
    """Keys and values of the lines within a frontmatter."""
    out: dict[str, Any] = {}
    entry: list | None = None  # [key, indicator, children]
    entries = []
    for line in lines:
        bare = line.strip()
        child = not bare or line[0] == " " or line.startswith("- ")
        if entry is not None and child:
            entry[2].append(bare)
            continue
        entry = None
        if child or bare.startswith("#"):
            continue
        key, colon, value = line.partition(":")
        if not colon or not key.strip():
            continue
        if value.strip() == "" or value.strip() in BLOCK_SCALAR:
            entry = [key.strip(), value.strip(), []]
            entries.append(entry)
        else:
            entries.append([key.strip(), None, value])
    for key, indicator, rest in entries:
        if indicator is None:
            out[key] = scalar(rest)
        elif indicator:
            out[key] = " ".join(c for c in rest if c)
        else:
            rest = [c for c in rest if c and not c.startswith("#")]
            items = [scalar(c[2:]) for c in rest if c.startswith("- ")]
            pairs = {k.strip(): scalar(v) for k, _, v in (c.partition(":") for c in rest if not c.startswith("- ") and ":" in c)}
            out[key] = items or pairs or ""
    return out


def tagged(value: Any) -> dict[str, Any]:
    """A metadata value as {kind, values}; a map's values are ``key value``."""
    if isinstance(value, list):
        return {"kind": KIND_LIST, "values": [str(v) for v in value]}
    if isinstance(value, dict):
        return {"kind": KIND_MAP, "values": [f"{k} {v}" for k, v in value.items()]}
    return {"kind": KIND_BOOL if isinstance(value, bool) else KIND_STRING, "values": [str(value)]}


def structural(body: str, metadata: dict[str, Any]) -> str:
    """The body without an untrusted payload."""
    if str(metadata.get("type", "")).strip() != "raw-source":
        return body
    head, begin, rest = body.partition(PAYLOAD_BEGIN)
    if not begin:
        return ""
    _, end, tail = rest.rpartition(PAYLOAD_END)
    return head + begin + ("\n" + end + tail if end else "")


# -- structure --------------------------------------------------------------
def blanked_code(text: str) -> str:
    """Fenced and then inline code replaced by blanks of the same length; line breaks stay."""
    blanks = lambda m: NOT_BREAK.sub(" ", m.group())
    return INLINE.sub(blanks, FENCED.sub(blanks, text))


def task_rows(body: str) -> list[dict[str, Any]]:
    """Checkboxes outside fences; lines count from the body's first."""
    lines = body.splitlines()
    fences = [FENCE.match(line) is not None for line in lines]
    open_after = accumulate(fences, operator.xor)
    found = ((n, TASK.match(line)) for n, (line, fence, open_) in enumerate(zip(lines, fences, open_after, strict=True), 1) if not (fence or open_))
    return [{"line": n, "done": m[1] in "xX", "text": m[2]} for n, m in found if m and m[2]]


def heading_rows(body: str, offset: int) -> list[dict[str, Any]]:
    """Headings outside code; lines count from the file's first."""
    out, line, at = [], 1 + offset, 0
    for m in HEADING.finditer(blanked_code(body)):
        line += body.count("\n", at, m.start())
        at = m.start()
        out.append({"level": len(m[1]), "name": m[2], "line": line, "start": at})
    return out


def prose_counts(body: str) -> list[int]:
    """Words of each paragraph of plain prose outside code."""
    out = []
    for p in re.split(r"\n\s*\n", blanked_code(body)):
        rows = [r for r in p.splitlines() if r.strip()]
        if rows and not any(NOT_PROSE.match(r) for r in rows):
            out.append(len(WORDS.findall(p)))
    return out


def _struct(**fields: pa.DataType) -> pa.StructType:
    return pa.struct(list(fields.items()))


META = pa.map_(pa.string(), _struct(kind=pa.string(), values=pa.list_(pa.string())))
HEADINGS = pa.list_(_struct(level=pa.int32(), name=pa.string(), line=pa.int32(), start=pa.int32()))
TASKS = pa.list_(_struct(line=pa.int32(), done=pa.bool_(), text=pa.string()))


def head_part(raw: str) -> dict[str, Any]:
    """The metadata, of the first lines only."""
    tags = {k: tagged(v) for k, v in metadata_of(raw).items()}
    return {"metadata": list(tags.items()), "meta_text": " ".join(v for t in tags.values() for v in t["values"])}


def body_part(raw: str) -> dict[str, Any]:
    """The body, what of it counts as the note's own, and the text that may hold links."""
    metadata, body, offset = frontmatter(raw)
    own = structural(body, metadata)
    link_text = raw if own is body else head_part(raw)["meta_text"] + "\n" + own
    return {"body": body, "structural_body": own, "link_text": link_text, "body_line_offset": offset}


def structure_part(raw: str) -> dict[str, Any]:
    """Headings, tasks and paragraphs."""
    metadata, body, offset = frontmatter(raw)
    own = structural(body, metadata)
    return {"headings": [m[2].strip() for m in HEADING.finditer(own)], "heading_rows": heading_rows(body, offset), "tasks": task_rows(own), "prose": prose_counts(body)}


#: The parts by the columns they give: a query runs only the functions whose columns it uses.
PARTS = {
    head_part: _struct(metadata=META, meta_text=pa.string()),
    body_part: _struct(body=pa.string(), structural_body=pa.string(), link_text=pa.string(), body_line_offset=pa.int32()),
    structure_part: _struct(headings=pa.list_(pa.string()), heading_rows=HEADINGS, tasks=TASKS, prose=pa.list_(pa.int32())),
}


def _column(part: Callable[[str], dict], kind: pa.StructType, content: Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([part((x or "").removeprefix("﻿")) for x in texts.to_pylist()], kind)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # not deterministic for the optimizer, which else runs it once more for a condition on what it gives
    return F.arrow_udf(run, from_arrow_type(kind)).asNondeterministic()(content)


#: Bytes of an Arrow batch of texts, of which a worker holds several copies in Python; and what Spark takes else.
BATCH_BYTES, SPARKS_BYTES = 8 << 20, 64 << 20


def bounded(spark: SparkSession) -> None:
    """Bound the session's Arrow batches unless it has a bound of its own; the setting is read when a query runs."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key).removesuffix("b") == str(SPARKS_BYTES):
        spark.conf.set(key, str(BATCH_BYTES))


def parsed(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with the parsed columns in place of the content; null content is empty."""
    bounded(files.sparkSession)
    keep = [c for c in files.columns if c != content]
    names = [f"_{part.__name__}" for part in PARTS]
    out = files.select(*keep, *(_column(part, kind, F.col(content)).alias(n) for n, (part, kind) in zip(names, PARTS.items(), strict=True)))
    return out.select(*keep, *(F.col(n)[f.name].alias(f.name) for n, kind in zip(names, PARTS.values(), strict=True) for f in kind))


# -- notes ------------------------------------------------------------------
def meta(key: str) -> Column:
    """A metadata value as trimmed text, empty if absent."""
    return F.coalesce(F.trim(F.array_join(F.try_element_at("metadata", F.lit(key))["values"], " ")), F.lit(""))


def meta_kind(key: str) -> Column:
    return F.try_element_at("metadata", F.lit(key))["kind"]


def meta_values(key: str) -> Column:
    """A metadata value as a list of non-empty strings."""
    values = F.coalesce(F.try_element_at("metadata", F.lit(key))["values"], F.array().cast("array<string>"))
    return F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")


def tags() -> Column:
    """Tags without leading marks; one string is parted at commas and white space."""
    raw = F.try_element_at("metadata", F.lit("tags"))
    some = F.when(raw["kind"] == KIND_LIST, raw["values"]).when(raw["kind"] == KIND_STRING, F.split(F.array_join(raw["values"], " "), r"[,\s]+")).otherwise(F.array().cast("array<string>"))
    clean = F.filter(F.transform(F.coalesce(some, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(clean, lambda x: F.regexp_replace(x, "^#+", ""))


def notes(files: DataFrame) -> DataFrame:
    """The canonical table of notes from (path, content, optional size and mtime)."""
    have = set(files.columns)
    base = files.withColumn("sha256", F.sha2(F.coalesce("content", F.lit("")), 256))
    if "size" not in have:
        base = base.withColumn("size", F.octet_length(F.coalesce("content", F.lit(""))).cast("bigint"))
    if "mtime" not in have:
        base = base.withColumn("mtime", F.lit(None).cast("timestamp"))
    out = parsed(base.select("path", "content", "sha256", "size", "mtime"))
    stem = F.regexp_replace(X.basename(F.col("path")), r"\.[^.]*$", "")
    first = F.regexp_extract("body", r"(?m)^#\s+(.+?)\s*$", 1)
    return (
        out.withColumn("stem", stem)
        .withColumn("title", F.when(first != "", F.trim(first)).otherwise(stem))
        .withColumn("type", meta("type"))
        .withColumn("status", meta("status"))
        .withColumn("tags", tags())
        .withColumn("links", X.links(F.col("link_text")))
        .drop("link_text")
    )


def fields(table: DataFrame) -> DataFrame:
    """path and the three searchable texts of notes."""
    return table.select("path", "title", F.col("meta_text").alias("meta"), "body")


FIELDS = tuple(FIELD_WEIGHTS)
