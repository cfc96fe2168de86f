"""Transcript lines to activity, within the JVM: each line is a VARIANT tree, walked level by level.

Lines have session, seq and line (JSON). What a line holds is in columns of
its own row, so nothing is shuffled; activity takes two aggregations by
session, without a session's lines ever meeting in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..operators import store

QUARTER = 4


def _get(node: Column, key: str) -> Column:
    """A key's value as VARIANT; null only where there is no such key."""
    return F.try_variant_get(node, f"$.{key}", "variant")


def _is(node: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(node).startswith(kind), F.lit(False))


def _text(node: Column) -> Column:
    """A string's text without space around it; null where it is no string or blank."""
    text = F.trim(F.try_variant_get(node, "$", "string"))
    return F.when(_is(node, "STRING") & (text != ""), text)


def _first(node: Column, keys: tuple[str, ...]) -> Column:
    return F.coalesce(*(_text(_get(node, k)) for k in keys))


def _children(node: Column) -> Column:
    """Values of an object or an array."""
    of_object = F.map_values(F.try_variant_get(node, "$", "map<string,variant>"))
    return F.when(_is(node, "OBJECT"), of_object).when(_is(node, "ARRAY"), F.try_variant_get(node, "$", "array<variant>")).otherwise(F.array().cast("array<variant>"))


def objects(lines: DataFrame) -> DataFrame:
    """The lines with ``known`` (whether the line is JSON) and ``nodes``: all objects within, WALK_DEPTH levels below the top at most."""
    out = lines.withColumn("level_0", F.array(F.try_parse_json("line")))
    for k in range(C.WALK_DEPTH):
        out = out.withColumn(f"level_{k + 1}", F.flatten(F.transform(f"level_{k}", _children)))
    levels = [f"level_{k}" for k in range(C.WALK_DEPTH + 1)]
    nodes = F.filter(F.concat(*levels), lambda n: n.isNotNull() & _is(n, "OBJECT"))
    return out.withColumns({"nodes": nodes, "known": F.col("level_0")[0].isNotNull()}).drop(*levels)


def _is_true(node: Column, key: str, value: bool) -> Column:
    found = _get(node, key)
    return F.coalesce(_is(found, "BOOLEAN") & (F.try_variant_get(found, "$", "boolean") == value), F.lit(False))


def _arguments(node: Column) -> Column:
    """(args, raw) of a call: an object, the object that a string spells, or the string itself."""
    none = F.lit(None)

    def of(key: str) -> Column:
        value = _get(node, key)
        text = F.try_variant_get(value, "$", "string")
        spelled = F.try_parse_json(text)
        pair = lambda args, raw: F.struct(args.cast("variant").alias("args"), raw.cast("string").alias("raw"))
        return F.when(_is(value, "OBJECT"), pair(value, none)).when(_is(value, "STRING") & spelled.isNull(), pair(none, text)).when(_is(value, "STRING") & _is(spelled, "OBJECT"), pair(spelled, none))

    return F.coalesce(*(of(k) for k in C.ARGUMENT_KEYS))


def _call(node: Column) -> Column:
    """What an object says: a call of a tool (name, edits, path, capture), a failed result, an assistant's turn."""
    name = F.when(_is(_get(node, "name"), "STRING"), F.lower(F.try_variant_get(node, "$.name", "string")))
    text = lambda k: F.try_variant_get(node, f"$.{k}", "string")
    shaped = F.coalesce(text("type").isin(*C.TOOL_NODES), F.lit(False)) | _get(node, "input").isNotNull() | _get(node, "arguments").isNotNull()
    called = F.when(shaped, name)
    capture = F.coalesce(called.contains("capture_note"), F.lit(False))
    arguments = _arguments(node)
    blob = F.coalesce(arguments["raw"], F.to_json(arguments["args"]), F.lit(""))
    marked = reduce(lambda a, b: a | b, (blob.contains(m) for m in C.PATCH_MARKERS))
    edits = called.isNotNull() & ~capture & (F.substring_index(called, "__", -1).isin(*C.EDIT_TOOLS) | marked)
    failed = _is_true(node, "is_error", True) | _is_true(node, "success", False)
    turn = (F.coalesce(text("role"), F.lit("")) == "assistant") | (F.coalesce(text("type"), F.lit("")) == "assistant")
    return F.struct(
        turn.alias("turn"),
        F.when(edits, F.coalesce(_first(arguments["args"], C.PATH_KEYS), F.lit(""))).alias("edit"),
        F.when(capture, F.coalesce(_first(node, ("id", *C.RESULT_KEYS)), F.lit(""))).alias("capture"),
        F.when(failed, _first(node, C.RESULT_KEYS)).alias("failed"),
    )


def events(lines: DataFrame) -> DataFrame:
    """session, seq, turn, edits (paths, empty where there is none), captures and failed (calls), recognised.

    Works on batches and streams.
    """
    found = objects(lines.where(F.trim("line") != "")).withColumn("found", F.transform("nodes", _call))
    each = lambda c: F.filter(F.transform("found", lambda x: x[c]), lambda x: x.isNotNull())
    out = found.select("session", "seq", F.exists("found", lambda x: x["turn"]).alias("turn"), each("edit").alias("edits"), each("capture").alias("captures"), each("failed").alias("failed"))
    return out.withColumn("recognised", F.col("turn").cast("int") + F.size("edits") + F.size("captures"))


def activity(found: DataFrame) -> DataFrame:
    """session, turns, edits, captures, last_capture: what happened since each session's last capture that didn't fail.

    ``found`` is a batch of :func:`events`. A capture's own line belongs to the
    window it closes. Where no line of a session is recognised, a quarter of
    its lines count as turns.
    """
    found = store.written(found, "events")  # lines are parsed once
    captures = found.select("session", "seq", F.explode("captures").alias("call"))
    failed = found.select("session", F.explode("failed").alias("call")).distinct()
    last = captures.join(failed, ["session", "call"], "left_anti").groupBy("session").agg(F.max("seq").alias("last_capture"))
    rows = found.join(last, "session", "left")
    inside = F.col("last_capture").isNull() | (F.col("seq") > F.col("last_capture"))
    # an edit without a path counts by itself
    paths = F.when(inside, F.filter("edits", lambda p: p != ""))
    pathless = F.sum(F.when(inside, F.size(F.filter("edits", lambda p: p == ""))).otherwise(0))
    counts = rows.groupBy("session").agg(
        F.count_if(inside & F.col("turn")).alias("turns"), pathless.alias("pathless"), F.sum(F.size("captures")).alias("captures"), F.count("*").alias("lines"), F.sum("recognised").alias("recognised"), F.first("last_capture").alias("last_capture")
    )
    distinct = rows.select("session", F.explode(paths).alias("path")).groupBy("session").agg(F.countDistinct("path").alias("paths"))
    out = counts.join(distinct, "session", "left")
    turns = F.when(F.col("recognised") == 0, F.floor(F.col("lines") / QUARTER)).otherwise(F.col("turns"))
    return out.select("session", turns.alias("turns"), (F.col("pathless") + F.coalesce("paths", F.lit(0))).alias("edits"), "captures", "last_capture")
