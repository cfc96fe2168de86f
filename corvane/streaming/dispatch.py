"""What a session's hooks lead to: signals that a capture is due, and recalled notes.

One transition (:class:`Session`) serves files, batches and streams. A session
that has been told forgets what came before; a capture that holds settles a
held signal; an event that can't carry text holds the signal for one that can.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import constants as C
from ..operators import index, mutate, pack, rank
from .sessions import Activity, Thresholds, decide, line_events, worth_recalling

# -- configuration ----------------------------------------------------------
DEFAULTS: dict[str, Any] = {
    "recall": {"budget_tokens": C.RECALL_TOKENS, "limit": C.RECALL_NOTES, "min_prompt_chars": C.LEAST_PROMPT_CHARS, "in_vault": False, "acknowledgements": list(C.ACKNOWLEDGEMENTS)},
    "harvest": {
        "assistant_turns": C.TURNS_DUE, "edits": C.EDITS_DUE, "precompact_assistant_turns": C.EARLY_TURNS_DUE,
        "precompact_edits": C.EARLY_EDITS_DUE, "cooldown_seconds": C.COOLDOWN_SECONDS, "max_notes": C.SIGNAL_NOTES,
    },
    "ledger": {"retention_days": C.RETENTION_DAYS},
}


def overlaid(defaults: dict[str, Any], override: Any) -> dict[str, Any]:
    """The defaults with an override's known keys; sections merge one level deep."""
    own = override if isinstance(override, dict) else {}
    both = lambda old, new: {**old, **new} if isinstance(old, dict) and isinstance(new, dict) else new
    copied = {k: dict(v) if isinstance(v, dict) else v for k, v in defaults.items()}
    return copied | {k: both(copied[k], own[k]) for k in copied.keys() & own.keys()}


def configuration(path: str | None = None) -> dict[str, Any]:
    """The configuration in a JSON file over the defaults; a file that can't be read counts for nothing."""
    try:
        with open(path or "", encoding="utf-8") as f:
            return overlaid(DEFAULTS, json.load(f))
    except (OSError, ValueError):
        return overlaid(DEFAULTS, None)


def thresholds(config: dict[str, Any]) -> Thresholds:
    h = config["harvest"]
    return Thresholds(int(h["assistant_turns"]), int(h["edits"]), int(h["precompact_assistant_turns"]), int(h["precompact_edits"]), float(h["cooldown_seconds"]))


# -- the transition ---------------------------------------------------------
@dataclass(frozen=True)
class Hook:
    """One event that a client reports."""

    event: str
    at: float
    stop_continues: bool = False
    in_corpus: bool = False
    plan: bool = False
    extended: bool = False
    agent: bool = False

    @property
    def heard(self) -> bool:
        return self.event in {*C.RECALL_EVENTS, *C.SIGNAL_EVENTS} and not self.agent

    @property
    def suppressed(self) -> bool:
        """In the corpus itself, while planning, or in a turn that an earlier signal extended."""
        return self.in_corpus or self.plan or self.extended

    @property
    def carries_text(self) -> bool:
        return self.event in C.RECALL_EVENTS or (self.event == "Stop" and self.stop_continues)


@dataclass
class Session:
    """Activity since the last signal, and what is kept of signals."""

    activity: Activity = field(default_factory=Activity)
    state: dict = field(default_factory=dict)

    def absorb(self, kind: str, path: str = "", call: str = "") -> None:
        self.activity.absorb(kind, path, call)
        if kind == "capture":
            self.state["pending"] = False

    def hook(self, hook: Hook, when: Thresholds = Thresholds()) -> tuple[int, int] | None:
        """The turns and edits of a signal that goes out now; else null."""
        if not hook.heard:
            return None
        counts, out = (self.activity.turns, self.activity.edits), None
        if not hook.suppressed and decide(self.state, self.activity, hook.at, hook.carries_text, hook.event == "PreCompact", when, hook.event in C.SIGNAL_EVENTS):
            out = counts
        if out or hook.event == "SessionStart":
            self.activity = Activity()
        return out

    def dump(self) -> str:
        return json.dumps([self.activity.dump(), self.state])

    @classmethod
    def load(cls, text: str) -> Session:
        activity, state = json.loads(text)
        return cls(Activity.load(activity), state)


# -- batch and stream -------------------------------------------------------
HOOK_FIELDS = ("event", "at", "stop_continues", "in_corpus", "plan", "extended", "agent")
SIGNALS = "session string, seq long, event string, at double, turns long, edits long, number long"


def stepped(own: Session, row: dict) -> dict | None:
    """Feed one row (kind, path, call, or kind ``hook`` with HOOK_FIELDS); the signal's row if one goes out."""
    if row["kind"] != "hook":
        own.absorb(row["kind"], row["path"] or "", row["call"] or "")
        return None
    told = own.hook(Hook(row["event"] or "", float(row["at"] or 0), *(bool(row[c]) for c in HOOK_FIELDS[2:])))
    return told and {"session": row["session"], "seq": row["seq"], "event": row["event"], "at": float(row["at"]), "turns": told[0], "edits": told[1], "number": own.state["signals"]}


def signals(rows: DataFrame) -> DataFrame:
    """The signals of whole sessions: rows of session, seq, kind, path, call and HOOK_FIELDS.

    Sessions lie together and in order, and stream through one transition, so
    a long session is never held as a whole.
    """
    names = SIGNALS.replace(" string", "").replace(" long", "").replace(" double", "").split(", ")
    kinds = [pa.string(), pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, Session()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["session"] != now:
                    now, own = row["session"], Session()
                if told := stepped(own, row):
                    out.append(told)
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], k) for n, k in zip(names, kinds, strict=True)], names=names)

    ordered = rows.select("session", "seq", "kind", "path", "call", *HOOK_FIELDS).repartition("session").sortWithinPartitions("session", "seq")
    return ordered.mapInArrow(run, SIGNALS)


class SignalProcessor(StatefulProcessor):
    """The same for a stream; the state goes after the retention time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept = handle.getValueState("session", "doc string", C.RETENTION_DAYS * 86_400_000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        own = Session.load(self.kept.get()[0]) if self.kept.exists() else Session()
        out = []
        for row in pd.concat(list(rows)).sort_values("seq").to_dict("records"):
            row = {k: None if v is None or v != v else v for k, v in row.items()}
            if told := stepped(own, row | {"session": key[0]}):
                out.append(told)
        self.kept.update((own.dump(),))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def stream_signals(rows: DataFrame) -> DataFrame:
    """Streaming counterpart of :func:`signals`."""
    return rows.groupBy("session").transformWithStateInPandas(SignalProcessor(), SIGNALS, "Append", "ProcessingTime")


def prompts(hooks: DataFrame) -> DataFrame:
    """query_id, query, session, seq of the prompts worth recalling (session, seq, prompt, source, in_corpus)."""
    asked = hooks.where(~F.coalesce("source", F.lit("")).isin(*C.AUTOMATED_SOURCES) & ~F.coalesce("in_corpus", F.lit(False)) & worth_recalling(F.col("prompt")))
    return asked.select(F.concat_ws("\u0001", "session", "seq").alias("query_id"), F.substring(F.trim("prompt"), 1, C.QUERY_CHARS).alias("query"), "session", "seq")


def recalled(hooks: DataFrame, documents: DataFrame, own: index.Index | None = None, limit: int = C.RECALL_NOTES) -> DataFrame:
    """session, seq, rank, path, score: the notes for each prompt worth recalling.

    For a stream call it on each micro-batch (``foreachBatch``).
    """
    asked = prompts(hooks)
    found = rank.rank(asked.select("query_id", "query"), documents, rank.Options(limit=limit), own)
    return found.join(asked.select("query_id", "session", "seq"), "query_id").select("session", "seq", "rank", "path", "score")


def recall_bundles(hooks: DataFrame, documents: DataFrame, own: index.Index | None = None, limit: int = C.RECALL_NOTES, budget_tokens: int = C.RECALL_TOKENS) -> DataFrame:
    """session, seq, bundle, notes, paths, chars: the text handed over for each prompt worth recalling that finds anything."""
    asked = prompts(hooks)
    found = rank.rank(asked.select("query_id", "query"), documents, rank.Options(limit=limit), own)
    made = pack.bundles(found, asked, documents, budget_tokens).join(asked.select("query_id", "session", "seq"), "query_id")
    return made.select("session", "seq", "bundle", "notes", "paths", "chars")


def follow_recall(hooks: DataFrame, documents: DataFrame, own: index.Index, sink: str, checkpoint: str, **options):
    """The streaming query that writes each batch's bundles into a folder of its own, so that a batch that comes again adds nothing."""

    def apply(batch: DataFrame, number: int) -> None:
        recall_bundles(batch, documents, own, **options).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return hooks.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# -- files ------------------------------------------------------------------
@dataclass(frozen=True)
class Tail:
    """What a transcript held from an offset on."""

    events: list[dict]
    end: int
    captured: int | None  # where the last capture that holds ends
    activity: Activity


def tail(path: str, offset: int, most: int = C.SCAN_BYTES) -> Tail:
    """Read a transcript from a byte offset on, its last ``most`` bytes at most; from the start if the file became shorter.

    Lines that aren't JSON are passed over; if no line is known, a quarter of them count as turns.
    """
    try:
        size = os.path.getsize(path)
        start = offset if 0 <= offset <= size else 0
        start = max(start, size - most)
        with open(path, "rb") as f:
            f.seek(start)
            data = f.read(size - start)
    except (OSError, TypeError, ValueError):
        return Tail([], offset, None, Activity())
    events, known, lines, at = [], 0, 0, start
    for raw in data.splitlines(keepends=True):
        at += len(raw)
        if raw.strip():
            lines += 1
            found = line_events(raw.decode("utf-8", "replace"))
            known += found is not None
            events += [e | {"at": at} for e in found or []]
    if not known:
        events = [{"kind": "turn", "path": "", "call": "", "at": at}] * (lines // 4)
    activity, held = Activity(), []
    for e in events:
        before = activity.captures
        activity.absorb(e["kind"], e["path"], e["call"])
        if e["kind"] == "capture":
            held.append((e["call"], e["at"]))
        elif activity.captures < before:  # the last one of that name, or the last
            i = next(i for i in range(len(held) - 1, -1, -1) if held[i][0] == e["call"] or not e["call"])
            held.pop(i)
    return Tail(events, size, held[-1][1] if held else None, activity)


def branch(folder: str) -> str:
    """The branch that a repository around the folder has checked out."""
    while True:
        try:
            with open(os.path.join(folder, ".git", "HEAD"), encoding="utf-8") as f:
                head = f.read().strip()
            return head.rsplit("/", 1)[-1] if head.startswith("ref:") else ""
        except (OSError, ValueError):
            up = os.path.dirname(folder)
            if up == folder:
                return ""
            folder = up


def opening_query(cwd: Any) -> str:
    """What to recall when a session starts: the folder's and the branch's names as words."""
    if not isinstance(cwd, str) or not cwd.strip():
        return ""
    folder = os.path.realpath(os.path.expanduser(cwd))
    words = [os.path.basename(folder).replace("_", " ").replace("-", " "), branch(folder).replace("-", " ").replace("/", " ")]
    return " ".join(w for w in words if w.strip()).strip()[: C.QUERY_CHARS]


class Dispatcher:
    """Hooks of clients over a folder of state files; ``pack(query)`` gives the notes to recall as text."""

    def __init__(self, root: str, states: str, pack: Callable[[str], str], config: dict[str, Any] | None = None, clock: Callable[[], float] = time.time):
        self.root, self.states, self.pack, self.clock = os.path.realpath(root), states, pack, clock
        self.config = config or configuration()

    def file(self, session: Any) -> str:
        name = "".join(c if c.isalnum() and c.isascii() or c in "._-" else "_" for c in str(session or "unknown"))[:64]
        return os.path.join(self.states, f"{name}.json")

    def read(self, path: str) -> dict:
        """A session's state; a file that is absent or broken is an empty one."""
        try:
            with open(path, encoding="utf-8") as f:
                state = json.load(f)
            return state if isinstance(state, dict) else {}
        except (OSError, ValueError):
            return {}

    def write(self, path: str, state: dict) -> bool:
        try:
            os.makedirs(self.states, exist_ok=True)
            mutate.write_atomic(path, json.dumps(state))
        except OSError:
            return False
        return True

    def prune(self) -> None:
        """Forget sessions not heard of for the retention time."""
        if os.path.isdir(self.states):
            for entry in os.scandir(self.states):
                if entry.name.endswith(".json") and self.clock() - entry.stat().st_mtime > 86_400 * int(self.config["ledger"]["retention_days"]):
                    os.unlink(entry.path)

    def query(self, payload: dict, hook: Hook) -> str:
        """What to recall at this event, if anything."""
        settings = self.config["recall"]
        if hook.event not in C.RECALL_EVENTS or (hook.in_corpus and not settings["in_vault"]):
            return ""
        if hook.event == "SessionStart":
            return opening_query(payload.get("cwd"))
        prompt = next((payload[k] for k in C.PROMPT_KEYS if isinstance(payload.get(k), str)), "").strip()
        plain = prompt.lower().rstrip(".!? ")
        dull = len(prompt) < int(settings["min_prompt_chars"]) or prompt.startswith("/") or plain in {str(a).lower() for a in settings["acknowledgements"]}
        return "" if dull or payload.get("source") in C.AUTOMATED_SOURCES else prompt[: C.QUERY_CHARS]

    def handle(self, payload: dict, stop_continues: bool = False) -> dict | None:
        """The text for the session at this event (event, context, signalled), or nothing.

        The offset moves when a signal goes out, past a capture, and at the
        start. A signal goes out only after its state is written: at most once.
        """
        cwd = payload.get("cwd")
        here = os.path.realpath(os.path.expanduser(cwd)) if isinstance(cwd, str) and cwd.strip() else ""
        hook = Hook(
            str(payload.get("hook_event_name")), self.clock(), stop_continues, bool(here) and (here == self.root or here.startswith(self.root + os.sep)),
            payload.get("permission_mode") == "plan", payload.get("stop_hook_active") is True, bool(payload.get("agent_id") or payload.get("agent_type")),
        )
        if not hook.heard:
            return None
        if hook.event == "SessionStart":
            self.prune()
        path = self.file(payload.get("session_id"))
        state = self.read(path)
        read = tail(payload.get("transcript_path"), int(state.get("offset") or 0))
        if read.captured is not None:
            state |= {"offset": max(int(state.get("offset") or 0), read.captured), "pending": False}
        session = Session(replace(read.activity, before=[]), state)
        told = session.hook(hook, thresholds(self.config))
        if told or hook.event == "SessionStart":
            state["offset"] = read.end
        state |= {"cwd": cwd, "updated_at": hook.at}
        parts = []
        if query := self.query(payload, hook):
            try:
                parts.append(self.pack(query))
            except Exception:  # a hook must never stop a session
                parts.append("")
        saved = self.write(path, state)
        signalled = told is not None and saved
        if signalled:
            parts.append(f"A capture is due: {told[0]} turns and {told[1]} changes since the last one. Write at most {self.config['harvest']['max_notes']} drafts, after searching for what is known.")
        text = "\n\n".join(p for p in parts if p)
        return {"event": hook.event, "context": text, "signalled": signalled} if text else None
