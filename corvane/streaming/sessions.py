"""Session activity: transcripts to counters, batch and stream through one transition.

An event has a session, an order, and a kind: ``turn`` (an assistant turn),
``edit`` (with a path, maybe empty), ``capture`` and ``failed`` (the result of
the capture before). A window opens after the last capture that did not fail;
a capture counts as soon as it is seen, and its failure reopens the window.
"""

from __future__ import annotations

import json
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import constants as C
from ..operators import store


# -- reading transcripts ----------------------------------------------------
def nested_maps(node: Any, depth: int = 0) -> Iterator[dict]:
    """All JSON objects within a value, down to WALK_DEPTH."""
    if depth <= C.WALK_DEPTH:
        if isinstance(node, dict):
            yield node
        for child in node.values() if isinstance(node, dict) else node if isinstance(node, list) else ():
            yield from nested_maps(child, depth + 1)


def arguments(node: dict) -> Any:
    """A tool call's arguments, which may be JSON in a string."""
    raw = next((node[k] for k in C.ARGUMENT_KEYS if k in node), {})
    if isinstance(raw, str):
        try:
            return json.loads(raw)
        except ValueError:
            return raw
    return raw


def tool_event(node: dict) -> dict | None:
    """A capture or an edit, or nothing of interest."""
    name, args = str(node.get("name", "")), arguments(node)
    call = next((str(node[k]) for k in ("id", "call_id") if node.get(k)), "")
    if "capture_note" in name:
        return {"kind": "capture", "path": "", "call": call}
    plain = name.rsplit("__", 1)[-1].lower()
    text = args if isinstance(args, str) else json.dumps(args)
    if plain in C.EDIT_TOOLS or any(m in text for m in C.PATCH_MARKERS):
        path = next((str(args[k]) for k in C.PATH_KEYS if args.get(k)), "") if isinstance(args, dict) else ""
        return {"kind": "edit", "path": path, "call": call}
    return None


def line_events(line: str) -> list[dict] | None:
    """Events of one transcript line; None if it isn't recognised."""
    try:
        top = json.loads(line)
    except ValueError:
        return None
    if not isinstance(top, dict):
        return None
    out: list[dict] = []
    captures: list[dict] = []
    known = False
    for node in nested_maps(top):
        if node.get("is_error") and (call := next((str(node[k]) for k in C.RESULT_KEYS if node.get(k)), "")):
            known = True
            out.append({"kind": "failed", "path": "", "call": call})
        if node.get("type") in C.TOOL_NODES and (e := tool_event(node)):
            known = True
            (captures if e["kind"] == "capture" else out).append(e)
    body = top.get("payload", top)
    role = body.get("role") or (body.get("message") or {}).get("role") if isinstance(body, dict) else None
    if top.get("type") == "assistant" or role == "assistant":
        known = True
        out.insert(0, {"kind": "turn", "path": "", "call": ""})
    return out + captures if known else None


def transcript_events(lines: list[str]) -> list[dict]:
    """Events in order; if no line is recognised, a quarter of the lines count as turns."""
    found = [line_events(x) for x in lines if x.strip()]
    if found and all(f is None for f in found):
        return [{"kind": "turn", "path": "", "call": ""}] * (len(found) // 4)
    return [e for f in found if f for e in f]


# -- the transition ---------------------------------------------------------
@dataclass
class Activity:
    """Counts since the last capture that holds, and those before it in case it fails."""

    turns: int = 0
    paths: set[str] = field(default_factory=set)
    pathless: int = 0
    before: list = field(default_factory=list)

    def absorb(self, kind: str, path: str = "", call: str = "") -> None:
        if kind == "turn":
            self.turns += 1
        elif kind == "edit":
            self.paths.add(path) if path else setattr(self, "pathless", self.pathless + 1)
        elif kind == "capture":
            self.before.append([call, self.turns, sorted(self.paths), self.pathless])
            self.turns, self.paths, self.pathless = 0, set(), 0
        elif kind == "failed" and self.before:
            at = next((i for i in range(len(self.before) - 1, -1, -1) if self.before[i][0] == call or not call), None)
            if at is not None:
                _, turns, paths, pathless = self.before.pop(at)
                if at == len(self.before):  # the window that it had opened
                    self.turns, self.paths, self.pathless = self.turns + turns, self.paths | set(paths), self.pathless + pathless
                else:  # joins the window that the next capture closed
                    later = self.before[at]
                    later[1:] = [later[1] + turns, sorted(set(later[2]) | set(paths)), later[3] + pathless]

    @property
    def edits(self) -> int:
        return len(self.paths) + self.pathless

    @property
    def captures(self) -> int:
        return len(self.before)

    def dump(self) -> str:
        return json.dumps([self.turns, sorted(self.paths), self.pathless, self.before])

    @classmethod
    def load(cls, text: str) -> Activity:
        turns, paths, pathless, before = json.loads(text)
        return cls(turns, set(paths), pathless, before)


@dataclass(frozen=True)
class Thresholds:
    """When enough has happened; the early ones hold before a session's text is compacted."""

    turns: int = C.TURNS_DUE
    edits: int = C.EDITS_DUE
    early_turns: int = C.EARLY_TURNS_DUE
    early_edits: int = C.EARLY_EDITS_DUE
    cooldown: float = C.COOLDOWN_SECONDS


def due(turns: int, edits: int, seconds_since_signal: float | None, early: bool = False, when: Thresholds = Thresholds()) -> bool:
    """Enough happened and the last signal is long enough ago."""
    least_turns, least_edits = (when.early_turns, when.early_edits) if early else (when.turns, when.edits)
    rested = seconds_since_signal is None or seconds_since_signal >= when.cooldown
    return rested and (turns >= least_turns or edits >= least_edits)


def decide(state: dict, activity: Activity, now: float, deliverable: bool, early: bool = False, when: Thresholds = Thresholds(), asks: bool = True) -> bool:
    """Whether to signal now. What can't be delivered is held and later goes out whatever the counts.

    Without ``asks`` only a held signal can go out.
    """
    if activity.turns == 0 and activity.edits == 0 and state.get("captured"):
        state["pending"] = False
    since = None if state.get("last_signal") is None else now - state["last_signal"]
    wanted = bool(state.get("pending")) or (asks and due(activity.turns, activity.edits, since, early, when))
    if wanted and not deliverable:
        state["pending"] = True
        return False
    if wanted:
        state |= {"pending": False, "last_signal": now, "signals": state.get("signals", 0) + 1}
    return wanted


# -- batch ------------------------------------------------------------------
def last_captures(events: DataFrame) -> DataFrame:
    """session, last_capture, captures: captures that no failure directly follows.

    Ranges of (session, seq) part a long session among tasks; what follows the
    last row of a range is the first row of the session's next one.
    """
    ranges = events.select("session", "seq", F.coalesce("kind", F.lit("")).alias("kind")).repartitionByRange("session", "seq").withColumn("part", F.spark_partition_id())
    rows = ranges.withColumn("next_kind", F.lead("kind").over(Window.partitionBy("session", "part").orderBy("seq")))
    capture = F.col("kind") == "capture"
    parts = rows.groupBy("session", "part").agg(
        F.max(F.when(capture & (F.col("next_kind") != "failed"), F.col("seq"))).alias("inner"),
        F.count_if(capture & (F.col("next_kind") != "failed")).alias("held"),
        F.max(F.when(capture & F.col("next_kind").isNull(), F.col("seq"))).alias("open"),
        F.min_by("kind", "seq").alias("first"),
    )
    follows = F.lead("first").over(Window.partitionBy("session").orderBy("part"))
    parts = parts.withColumn("last", F.when(~F.coalesce(follows == "failed", F.lit(False)), F.col("open")))
    return parts.groupBy("session").agg(F.max(F.greatest("inner", "last")).alias("last_capture"), (F.sum("held") + F.count("last")).alias("captures"))


def windows(events: DataFrame) -> DataFrame:
    """Counters per session: session, seq, kind, path in; one row per session out.

    A failure directly follows its capture, as in event tables. The last
    captures are found and written, then the rows after them are counted where
    they lie, so a long session is no task of its own.
    """
    last = store.written(last_captures(events).withColumnRenamed("session", "_session"), "captures")
    rows = events.join(last, F.col("session").eqNullSafe(F.col("_session")), "left")
    inside = F.col("last_capture").isNull() | (F.col("seq") > F.col("last_capture"))
    out = rows.groupBy("session").agg(
        F.count_if(inside & (F.col("kind") == "turn")).alias("turns"),
        F.countDistinct(F.when(inside & (F.col("kind") == "edit") & (F.col("path") != ""), F.col("path"))).alias("paths"),
        F.count_if(inside & (F.col("kind") == "edit") & (F.col("path") == "")).alias("pathless"),
        F.max("captures").alias("captures"),
    )
    return out.select("session", "turns", (F.col("paths") + F.col("pathless")).alias("edits"), "captures")


def sessions_due(counts: DataFrame, early: bool = False) -> DataFrame:
    t, e = (C.EARLY_TURNS_DUE, C.EARLY_EDITS_DUE) if early else (C.TURNS_DUE, C.EDITS_DUE)
    return counts.where((F.col("turns") >= t) | (F.col("edits") >= e))


# -- stream -----------------------------------------------------------------
class SessionProcessor(StatefulProcessor):
    """Keeps each session's activity and emits its counters; one operator updates and emits."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("activity", "doc string", C.RETENTION_DAYS * 86_400_000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        activity = Activity.load(self.state.get()[0]) if self.state.exists() else Activity()
        frames = pd.concat(list(rows))
        for r in frames.sort_values("seq").itertuples():
            activity.absorb(r.kind, r.path or "", r.call or "")
        self.state.update((activity.dump(),))
        yield pd.DataFrame([{"session": key[0], "turns": activity.turns, "edits": activity.edits, "captures": activity.captures}])

    def close(self) -> None:
        pass


def stream_counters(events: DataFrame) -> DataFrame:
    """Streaming counterpart of :func:`windows`; events have session, seq, kind, path, call."""
    return events.groupBy("session").transformWithStateInPandas(SessionProcessor(), "session string, turns long, edits long, captures long", "Update", "ProcessingTime")


AUDITED_EVENTS = ("PreToolUse", "PostToolUse", "PostToolUseFailure")


def audit(events: DataFrame, tool_prefix: str, names: tuple[str, ...] = AUDITED_EVENTS) -> DataFrame:
    """at, event, tool of the tool calls to be kept; works on batches and streams."""
    rows = events.where(F.col("event").isin(*names) & F.col("tool").startswith(tool_prefix))
    return rows.select(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("at"), "event", "tool")


def write_audit(rows: DataFrame, path: str, checkpoint: str | None = None):
    """Append audit rows (at, event, tool) as JSON lines; for a stream, the query that does so for each of its batches.

    Each batch has a folder of its own. A stream's is named by the checkpoint
    and its number and replaced by a batch that comes again, which so adds
    nothing; others are named by the time.
    """
    if not rows.isStreaming:
        return rows.write.mode("append").json(f"{path}/stream=none/batch={time.time_ns()}")
    stream = f"{zlib.crc32(str(checkpoint).encode()):08x}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/stream={stream}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def worth_recalling(prompt: F.Column) -> F.Column:
    """Prompts long enough, not commands, not mere acknowledgements."""
    bare = F.trim(prompt)
    plain = F.trim(F.regexp_replace(F.lower(bare), r"[.!? ]+$", ""))
    return (F.length(bare) >= C.LEAST_PROMPT_CHARS) & ~bare.startswith("/") & ~plain.isin(*C.ACKNOWLEDGEMENTS)
