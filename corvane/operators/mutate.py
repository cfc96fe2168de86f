"""Guarded changes to note files: driver-side functions on text and small file writes."""

from __future__ import annotations

import contextlib
import datetime
import hashlib
import json
import os
import re
import tempfile
import time
import unicodedata
from collections.abc import Iterable

from ..functions import constants as C
from ..functions.parse import frontmatter

KEY_LINE = re.compile(r"^([^\s#:][^:]*):")
MOMENT = re.compile(r"\[([^\]]*)\]|YYYY|GGGG|YY|MMMM|MMM|MM|M|DDDD|DD|D|dddd|ddd|WW|W|HH|H|mm|m|ss|s")


# -- text -------------------------------------------------------------------
def slug(title: str) -> str:
    """ASCII id of a title: German letters spelled out, accents dropped; ``note`` if nothing is left."""
    spelled = "".join(C.TRANSLITERATIONS.get(c, c) for c in title)
    plain = unicodedata.normalize("NFKD", spelled).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-") or "note"


def moment_format(day: datetime.datetime | datetime.date, pattern: str) -> str:
    """A date in a note app's format letters; ISO week years, literals in brackets."""
    iso = day.isocalendar()
    clock = day if isinstance(day, datetime.datetime) else datetime.datetime.combine(day, datetime.time())
    values = {
        "YYYY": f"{day.year:04d}", "YY": f"{day.year % 100:02d}", "GGGG": f"{iso[0]:04d}", "MMMM": day.strftime("%B"), "MMM": day.strftime("%b"),
        "MM": f"{day.month:02d}", "M": str(day.month), "DDDD": day.strftime("%j"), "DD": f"{day.day:02d}", "D": str(day.day), "dddd": day.strftime("%A"),
        "ddd": day.strftime("%a"), "WW": f"{iso[1]:02d}", "W": str(iso[1]), "HH": f"{clock.hour:02d}", "H": str(clock.hour), "mm": f"{clock.minute:02d}",
        "m": str(clock.minute), "ss": f"{clock.second:02d}", "s": str(clock.second),
    }
    return MOMENT.sub(lambda m: m[1] if m[1] is not None else values[m[0]], pattern)


def rendered_template(template: str, title: str, now: datetime.datetime) -> str:
    """{{title}}, {{date}}, {{time}} and {{date:FORMAT}} filled in."""

    def fill(m: re.Match) -> str:
        name, _, pattern = m[1].strip().partition(":")
        if name == "title":
            return title
        default = {"date": "YYYY-MM-DD", "time": "HH:mm"}.get(name)
        return m[0] if default is None else moment_format(now, pattern or default)

    return re.sub(r"\{\{([^{}]+)\}\}", fill, template)


def yaml_scalar(value: str) -> str:
    """The value as it is if a reader gets it back so, else quoted."""
    plain = re.fullmatch(r"[A-Za-z0-9][\w ./+@-]*", value) and value == value.strip() and value not in ("true", "false", "null")
    return value if plain else json.dumps(value, ensure_ascii=False)


def yaml_lines(key: str, value: str | Iterable[str]) -> list[str]:
    if isinstance(value, str):
        return [f"{key}: {yaml_scalar(value)}"]
    items = list(value)
    return [f"{key}:", *(f"  - {yaml_scalar(v)}" for v in items)] if items else [f"{key}: []"]


def _header(text: str) -> tuple[list[str], list[str], str]:
    """(frontmatter lines without the fences, the rest with its breaks, the line break in use)."""
    brk = "\r\n" if "\r\n" in text else "\n"
    lines = text.split(brk)
    if lines[0].strip() == "---":
        for i in range(1, len(lines)):
            if lines[i].strip() == "---":
                return lines[1:i], lines[i + 1 :], brk
    return [], lines, brk


def _entries(lines: list[str]) -> list[tuple[str, list[str]]]:
    """Header lines by the key that they belong to; lines before any key have the empty key."""
    out: list[tuple[str, list[str]]] = []
    for line in lines:
        m = KEY_LINE.match(line)
        if m and not line.startswith("- "):
            out.append((m[1].strip(), [line]))
        elif out:
            out[-1][1].append(line)
        else:
            out.append(("", [line]))
    return out


def with_frontmatter(text: str, values: dict[str, str | Iterable[str]], remove: Iterable[str] = ()) -> str:
    """Keys set or removed; everything else, line breaks too, stays."""
    head, rest, brk = _header(text)
    gone, left = set(remove), dict(values)
    out: list[str] = []
    for key, own in _entries(head):
        if key in left:
            out += yaml_lines(key, left.pop(key))
        elif key not in gone:
            out += own
    for key, value in left.items():
        out += yaml_lines(key, value)
    return brk.join(["---", *out, "---", *rest]) if out or head else text


def with_body(text: str, body: str) -> str:
    head, _, brk = _header(text)
    plain = body.replace("\r\n", "\n").replace("\n", brk)
    return brk.join(["---", *head, "---", "", plain]) if head else plain


def stamped(text: str, day: datetime.date) -> str:
    """``updated`` set to the day; a text without that key, or with it, stays as it is."""
    return re.sub(r"\A(---\r?\n(?:.*\r?\n)*?updated:[ \t]*)([^\r\n]*)", lambda m: m[1] + day.isoformat() if "\n---" not in m[1] else m[0], text, count=1)


def payload(text: str) -> str | None:
    """The text between exactly one pair of payload marks, with LF breaks; else None."""
    if text.count(C.PAYLOAD_BEGIN) != 1 or text.count(C.PAYLOAD_END) != 1:
        return None
    inner = text.partition(C.PAYLOAD_BEGIN)[2]
    if C.PAYLOAD_END not in inner:
        return None
    inner = inner.partition(C.PAYLOAD_END)[0].replace("\r\n", "\n").replace("\r", "\n")
    return inner.removeprefix("\n").removesuffix("\n")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def sealed(text: str, day: datetime.date) -> str:
    """A raw source with its digest; an intact seal is kept, a broken one refused."""
    own = payload(text)
    if own is None:
        raise ValueError("invalid_or_missing_payload_boundary")
    known = str(frontmatter(text)[0].get(C.PAYLOAD_HASH_KEY, ""))
    if known:
        if known != digest(own):
            raise ValueError("payload_changed_after_seal")
        return text
    return with_frontmatter(text, {"status": "immutable", "sealed": day.isoformat(), C.PAYLOAD_HASH_KEY: digest(own)})


def with_link(hub: str, target: str) -> str:
    """A hub with a link after its anchor (or at the end); once only."""
    line = f"- [[{target}]]"
    if line in hub.splitlines():
        return hub
    brk = "\r\n" if "\r\n" in hub else "\n"
    lines = hub.split(brk)
    at = next((i for i, x in enumerate(lines) if C.LINK_ANCHOR in x), None)
    if at is None:
        return hub.rstrip("\r\n") + brk + brk + line + brk
    return brk.join([*lines[: at + 1], line, *lines[at + 1 :]])


def with_parent(text: str, parent: str) -> str:
    """A note that links to its hub; added below the first heading if missing."""
    if f"[[{parent}" in text:
        return text
    return re.sub(r"(?m)^(# .*)$", lambda m: f"{m[1]}\n\nUp: [[{parent}]]", text, count=1) if re.search(r"(?m)^# ", text) else f"{text.rstrip()}\n\nUp: [[{parent}]]\n"


def merged_unique(*lists: Iterable[str], exclude: Iterable[str] = ()) -> list[str]:
    """Union in order without regard to case, without the excluded."""
    seen, out = {x.casefold() for x in exclude}, []
    for x in (x for xs in lists for x in xs):
        if x.casefold() not in seen:
            seen.add(x.casefold())
            out.append(x)
    return out


def merge_plan(canonical: str, retired: str, body: str, links_at_risk: Iterable[str] = (), inbound: Iterable[str] = ()) -> dict:
    """What merging the retired note into the canonical one would do, with a digest over all inputs."""
    a, b = frontmatter(canonical)[0], frontmatter(retired)[0]
    as_list = lambda v: v if isinstance(v, list) else [v] if v else []
    conflicts = sorted(k for k in a.keys() & b.keys() if a[k] != b[k] and k not in ("id", "aliases", "tags", "created", "updated"))
    out = {
        "aliases": merged_unique(as_list(a.get("aliases")), as_list(b.get("aliases")), [str(b.get("id", ""))] if b.get("id") else []),
        "tags": merged_unique(as_list(a.get("tags")), as_list(b.get("tags"))),
        "conflicts": conflicts,
        "links_at_risk": sorted(links_at_risk),
        "inbound_redirects": sorted(inbound),
        "canonical_sha256": digest(canonical),
        "retired_sha256": digest(retired),
        "body_sha256": digest(body),
    }
    out["plan"] = digest(json.dumps(out, sort_keys=True, ensure_ascii=False))
    return out


def apply_merge(canonical: str, retired: str, body: str, plan: str, target: str, day: datetime.date, accept_warnings: bool = False, **context: Iterable[str]) -> tuple[str, str]:
    """(canonical, redirect) if the plan still holds; warnings must be accepted."""
    now = merge_plan(canonical, retired, body, **context)
    if now["plan"] != plan:
        raise ValueError("plan_changed")
    if now["inbound_redirects"]:
        raise ValueError("retired_note_has_inbound_redirects")
    if (now["conflicts"] or now["links_at_risk"]) and not accept_warnings:
        raise ValueError("warnings_not_accepted")
    kept = with_frontmatter(canonical, {"aliases": now["aliases"], "tags": now["tags"], "updated": day.isoformat()})
    gone = with_frontmatter(retired, {"type": "redirect", "status": "superseded", "redirect_to": f"[[{target}]]", "updated": day.isoformat()}, remove=("aliases", "tags"))
    return with_body(kept, body), with_body(gone, f"# Moved\n\nNow at [[{target}]].\n")


def new_note(template: str, title: str, now: datetime.datetime, hub: str | None = None, extra: dict | None = None) -> str:
    """A note from a template: id, dates and parent filled in."""
    text = rendered_template(template, title, now)
    day = now.date().isoformat()
    text = with_frontmatter(text, {"id": slug(title), "created": day, "updated": day, **(extra or {})})
    return with_parent(text, hub) if hub else text


def feedback_metadata(project: str, scope: str, confidence: str, evidence: Iterable[str]) -> dict:
    return {"capture_kind": "feedback", "ai_review": "pending", "project": project, "scope": scope, "confidence": confidence, "evidence": list(evidence)}


def stamps_itself(path: str) -> bool:
    """Whether an edit of this note sets its date: not root files, journals, raw sources, system files and attachments."""
    return path.endswith(".md") and path not in C.SCHEMA_EXEMPT_ROOT and not path.startswith(C.UNSTAMPED)


# -- files ------------------------------------------------------------------
def inside(root: str, relative: str) -> str:
    """The absolute path, which must lie within the root and not be hidden."""
    full = os.path.realpath(os.path.join(root, relative))
    base = os.path.realpath(root)
    if full != base and not full.startswith(base + os.sep):
        raise ValueError("path_outside")
    if any(p.startswith(".") for p in os.path.relpath(full, base).split(os.sep) if p != "."):
        raise ValueError("path_hidden")
    return full


def write_atomic(path: str, text: str) -> None:
    fd, temp = tempfile.mkstemp(dir=os.path.dirname(path), prefix=".write-")
    try:
        with os.fdopen(fd, "w", encoding="utf-8", newline="") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        with contextlib.suppress(OSError):
            os.unlink(temp)
        raise


def write_together(changes: dict[str, str]) -> None:
    """All files or none: on a failure those already written get their old text back."""
    old: dict[str, str | None] = {}
    try:
        for path, text in changes.items():
            old[path] = open(path, encoding="utf-8", newline="").read() if os.path.exists(path) else None
            write_atomic(path, text)
    except BaseException:
        for path, text in old.items():
            with contextlib.suppress(OSError):
                os.unlink(path) if text is None else write_atomic(path, text)
        raise


@contextlib.contextmanager
def write_lock(root: str, stale_seconds: float = 300.0):
    """One writer at a time across processes; a lock older than ``stale_seconds`` is taken over."""
    path = os.path.join(root, ".write.lock")
    try:
        fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        if time.time() - os.stat(path).st_mtime < stale_seconds:
            raise TimeoutError("another writer is active") from None
        os.unlink(path)
        fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    try:
        os.close(fd)
        yield
    finally:
        with contextlib.suppress(FileNotFoundError):
            os.unlink(path)
