"""Files of views: nested keys and lists by indentation, as note apps write them.

A file holds ``filters`` that all its views share, ``properties`` and ``views``,
each with ``name``, ``filters``, ``order`` (its columns) and ``groupBy``. Files
are as small as the settings of a dashboard, so the driver reads them.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import SparkSession

from ..operators import store

KEY = re.compile(r"""^([\w.-]+|"[^"]*"|'[^']*')\s*:(?:\s+(.*))?$""")
PROPERTY = re.compile(r"^[A-Za-z_][\w.-]*$")


class BadView(ValueError):
    """A view file that says what can't be understood, with its line."""


@dataclass(frozen=True)
class View:
    """``filters`` is a list of conditions that must all hold; ``group`` and its direction sort the rows."""

    name: str
    filters: list
    columns: tuple[str, ...]
    group: str | None = None
    descending: bool = False


def scalar(text: str) -> str | list:
    text = text.strip()
    if text.startswith("[") and text.endswith("]"):
        return [scalar(t) for t in text[1:-1].split(",") if t.strip()]
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    if len(text) > 1 and text[0] == text[-1] == '"':
        try:
            return json.loads(text)
        except json.JSONDecodeError:
            return text  # two quoted values with something between
    return text


def _rows(text: str) -> list[tuple[int, int, str]]:
    """Line number, indentation and content of lines that hold something."""
    out = []
    for n, line in enumerate(text.splitlines(), 1):
        own = line.strip()
        if own and not own.startswith("#") and own != "---":
            if "\t" in line[: len(line) - len(line.lstrip())]:
                raise BadView(f"line {n}: tab in the indentation")
            out.append((n, len(line) - len(line.lstrip(" ")), own))
    return out


def nested(text: str) -> dict | list | str:
    """Mappings, lists and scalars as texts; what an empty value holds is an empty text."""
    rows = _rows(text)

    def block(i: int, depth: int) -> tuple[dict | list | str, int]:
        if rows[i][2].startswith("- ") or rows[i][2] == "-":
            return items(i, depth)
        return keys(i, depth) if KEY.match(rows[i][2]) else (scalar(rows[i][2]), i + 1)

    def items(i: int, depth: int) -> tuple[list, int]:
        out = []
        while i < len(rows) and rows[i][1] == depth and (rows[i][2].startswith("- ") or rows[i][2] == "-"):
            n, _, own = rows[i]
            inner = own[1:].lstrip()
            if not inner:
                value, i = below(i + 1, depth)
            elif KEY.match(inner) or inner.startswith("- "):  # the item begins on the mark's own line
                rows[i] = (n, depth + len(own) - len(inner), inner)
                value, i = block(i, rows[i][1])
            else:
                value, i = scalar(inner), i + 1
            out.append(value)
        return out, i

    def keys(i: int, depth: int) -> tuple[dict, int]:
        out: dict = {}
        while i < len(rows) and rows[i][1] == depth and (m := KEY.match(rows[i][2])):
            key = scalar(m[1])
            if key in out:
                raise BadView(f"line {rows[i][0]}: {key} comes twice")
            if m[2]:
                out[key], i = scalar(m[2]), i + 1
            else:
                out[key], i = below(i + 1, depth, lists=True)
        return out, i

    def below(i: int, depth: int, lists: bool = False) -> tuple[dict | list | str, int]:
        if i < len(rows) and (rows[i][1] > depth or lists and rows[i][1] == depth and rows[i][2].startswith("-")):
            return block(i, rows[i][1])
        return "", i

    if not rows:
        return {}
    value, end = block(0, rows[0][1])
    if end < len(rows):
        raise BadView(f"line {rows[end][0]}: unexpected {rows[end][2]!r}")
    return value


def _conditions(value: object, where: str) -> list:
    """Conditions as a list; a mapping must have and, or or not as its only key."""
    if value in ("", None):
        return []

    def check(one: object) -> None:
        if isinstance(one, dict):
            if len(one) != 1 or (how := next(iter(one))) not in ("and", "or", "not"):
                raise BadView(f"{where}: a filter has one of and, or, not, but {', '.join(map(str, one))} is there")
            for part in one[how] if isinstance(one[how], list) else [one[how]]:
                check(part)
        elif not isinstance(one, str) or not one:
            raise BadView(f"{where}: {one!r} is no condition")

    own = value if isinstance(value, list) else [value]
    for one in own:
        check(one)
    return own


def views_in(text: str, source: str = "view file") -> list[View]:
    """The views of one file in its order."""
    try:
        top = nested(text)
    except BadView as bad:
        raise BadView(f"{source}: {bad}") from None
    if not isinstance(top, dict) or not isinstance(top.get("views", []), list):
        raise BadView(f"{source}: keys filters and views are expected")
    shared, out = _conditions(top.get("filters"), source), []
    for i, own in enumerate(top.get("views", []), 1):
        if not isinstance(own, dict) or not own.get("name"):
            raise BadView(f"{source}: view {i} has no name")
        where = f"{source}: {own['name']}"
        columns = own.get("order", [])
        if not isinstance(columns, list) or not all(isinstance(c, str) and PROPERTY.match(c) for c in columns):
            raise BadView(f"{where}: order lists properties")
        group = own.get("groupBy") or {}
        group = {"property": group} if isinstance(group, str) else group
        direction = group.get("direction", "ASC").upper()
        if direction not in ("ASC", "DESC"):
            raise BadView(f"{where}: direction is ASC or DESC")
        out.append(View(own["name"], [*shared, *_conditions(own.get("filters"), where)], tuple(columns), group.get("property"), direction == "DESC"))
    return out


def read_views(spark: SparkSession, folder: str, endings: tuple[str, ...] = (".view", ".base")) -> dict[str, View]:
    """The views of all files of a folder by name; a name that two views have is refused."""
    out: dict[str, View] = {}
    for name in sorted(n for n in store.names(spark, folder) if n.endswith(endings) and not n.startswith(".")):
        for own in views_in(store.read_text(spark, f"{folder.rstrip('/')}/{name}"), name):
            if own.name in out:
                raise BadView(f"{name}: {own.name} comes twice")
            out[own.name] = own
    return out
