"""Property views: conditions of view files compiled to columns, views as temporary views for SQL.

A condition is a text such as ``type == "moc" && !(review_on <= today())``, or
a mapping with one of the keys and, or, not (none of its conditions holds) and
a list of conditions. From weak to strong bind ``||``, ``&&``, comparisons,
``+`` and ``-`` between a day and a duration ("30d", "2 weeks"), ``!``. Names
are properties (``status``, ``note.status``, ``file.path``), and functions are
those of FUNCTIONS and METHODS. What is unknown is refused with its place.

Comparisons are of texts; with a day on one side, of days, and with a number on
one side, of numbers, where texts that are none never compare as true. A
property compared with null is one that is absent or empty. A condition is
never null, so ``!`` always turns it round.
"""

from __future__ import annotations

import datetime
import json
import operator
import os
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.parse import meta, meta_values, tags
from ..sources.viewfiles import View, read_views
from . import graph as G

#: The folder of the thirteen given views.
GIVEN = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "sources", "views")
FILE_FIELDS = {
    "file.path": lambda: F.col("path"),
    "file.name": lambda: X.basename(F.col("path")),
    "file.ext": lambda: F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)),
    "file.folder": lambda: F.regexp_extract("path", r"^(.*)/[^/]*$", 1),
    "file.size": lambda: F.col("size"),
}
TOKEN = re.compile(r"""\s*(?:(?P<text>"(?:[^"\\]|\\.)*"|'[^']*')|(?P<number>\d+(?:\.\d+)?)(?![\w.])|(?P<name>[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*)|(?P<mark>&&|\|\||[=!<>]=|[<>!(),+-]))""")
COMPARISONS = {"==": operator.eq, "!=": operator.ne, "<=": operator.le, ">=": operator.ge, "<": operator.lt, ">": operator.gt}
DURATION = re.compile(r"^\s*(\d+)\s*(d|days?|w|weeks?|M|months?|y|years?)\s*$")


@dataclass(frozen=True)
class Context:
    """What conditions refer to: the day, and the note that shows the view."""

    today: datetime.date
    this_path: str | None = None


class Unknown(ValueError):
    """A condition that can't be understood."""


@dataclass(frozen=True)
class Value:
    """A compiled operand: text, day, number, flag, null, or this (the note that shows the view)."""

    kind: str
    column: Column | None = None
    constant: str | None = None


def field(name: str) -> Column:
    return FILE_FIELDS[name]() if name in FILE_FIELDS else meta(name.removeprefix("note."))


def flag(c: Column) -> Value:
    return Value("flag", F.coalesce(c, F.lit(False)))


# -- functions --------------------------------------------------------------
def _in_folder(reader: Reader, folder: str) -> Value:
    own = folder.strip("/")
    return flag(F.col("path").startswith(own + "/") if own else F.lit(True))


def _has_tag(reader: Reader, *some: str) -> Value:
    wanted = [t.removeprefix("#").lower() for t in some]
    own = lambda t: F.lower(t).isin(wanted) | F.exists(F.array(*(F.lit(w + "/") for w in wanted)), lambda w: F.startswith(F.lower(t), w))
    return flag(F.exists(tags(), own))


def _day(reader: Reader, text: str) -> Value:
    try:
        return Value("day", F.lit(datetime.date.fromisoformat(text)))
    except ValueError:
        raise Unknown(f"{text!r} is no day") from None


#: Functions of constants by name, with the least number of arguments.
FUNCTIONS: dict[str, tuple[int, Callable[..., Value]]] = {
    "today": (0, lambda reader: Value("day", F.lit(reader.context.today))),
    "date": (1, _day),
    "file.inFolder": (1, _in_folder),
    "file.hasTag": (1, _has_tag),
    "file.hasProperty": (1, lambda reader, name: flag(F.map_contains_key("metadata", name))),
}
#: Functions of a property, called as ``property.name(constant)``.
METHODS: dict[str, tuple[int, Callable[..., Column]]] = {
    "isEmpty": (0, lambda name: field(name) == ""),
    "contains": (1, lambda name, text: F.array_contains(meta_values(name.removeprefix("note.")), text) | F.contains(field(name), F.lit(text))),
    "startsWith": (1, lambda name, text: F.startswith(field(name), F.lit(text))),
    "endsWith": (1, lambda name, text: F.endswith(field(name), F.lit(text))),
}


class Reader:
    """One condition text, read from left to right into a column.

    ``links`` collects the notes that hasLink asks for, each with the name of
    the column that must say whether a note links to it.
    """

    def __init__(self, text: str, context: Context, links: dict[str, str]):
        self.text, self.context, self.links, self.at = text, context, links, 0
        self.tokens: list[tuple[str, str, int]] = []
        place = 0
        while text[place:].strip():
            m = TOKEN.match(text, place)
            if not m:
                raise self.unknown("what begins", len(text) - len(text[place:].lstrip()))
            self.tokens.append((m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)))
            place = m.end()

    def unknown(self, what: str, place: int | None = None) -> Unknown:
        if place is None:
            place = self.tokens[self.at][2] if self.at < len(self.tokens) else len(self.text)
        return Unknown(f"{what} at {place + 1} of: {self.text}")

    def mark(self, *some: str) -> str | None:
        """The next mark, if it is one of these, which is then passed."""
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "mark" and self.tokens[self.at][1] in some:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def expect(self, mark: str) -> None:
        if not self.mark(mark):
            raise self.unknown(f"{mark} is expected")

    def condition(self) -> Column:
        out = self.truth(self.either)
        if self.at < len(self.tokens):
            raise self.unknown(f"unexpected {self.tokens[self.at][1]}")
        return out

    def truth(self, part: Callable[[], Value]) -> Column:
        start = self.at
        value = part()
        if value.kind != "flag":
            raise self.unknown("no condition", self.tokens[start][2])
        return value.column

    def chain(self, mark: str, part: Callable[[], Value], join: Callable[[Column, Column], Column]) -> Value:
        start, value = self.at, part()
        while self.mark(mark):
            if value.kind != "flag":
                raise self.unknown("no condition", self.tokens[start][2])
            value = Value("flag", join(value.column, self.truth(part)))
        return value

    def either(self) -> Value:
        return self.chain("||", self.both, operator.or_)

    def both(self) -> Value:
        return self.chain("&&", self.compared, operator.and_)

    def compared(self) -> Value:
        left = self.sum()
        place = self.at
        if not (how := self.mark(*COMPARISONS)):
            return left
        right = self.sum()
        try:
            return flag(compare(how, left, right))
        except Unknown as no:
            raise self.unknown(str(no), self.tokens[place][2]) from None

    def sum(self) -> Value:
        value = self.operand()
        while sign := self.mark("+", "-"):
            step = self.operand()
            m = DURATION.match(step.constant or "") if step.kind == "text" else None
            if value.kind != "day" or not m:
                self.at -= 1
                raise self.unknown("a day and a duration are expected")
            n = int(m[1]) * (1 if sign == "+" else -1)
            unit = "month" if m[2] == "M" else m[2]
            months = unit[0] in "my"
            n *= {"w": 7, "y": 12}.get(unit[0], 1)
            value = Value("day", F.add_months(value.column, n) if months else F.date_add(value.column, n))
        return value

    def operand(self) -> Value:
        if self.mark("!"):
            return Value("flag", ~self.truth(self.operand))
        if self.mark("("):
            value = self.either()
            self.expect(")")
            return value
        if self.at == len(self.tokens) or self.tokens[self.at][0] == "mark":
            raise self.unknown("a value is expected")
        kind, own, place = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            try:
                text = own[1:-1] if own[0] == "'" else json.loads(own)
            except json.JSONDecodeError:
                raise self.unknown("bad escape", place) from None
            return Value("text", F.lit(text), text)
        if kind == "number":
            return Value("number", F.lit(float(own)), own)
        if self.mark("("):
            return self.called(own, place)
        if own == "null":
            return Value("null")
        if own in ("true", "false"):
            return Value("text", F.lit(own), own)
        if own == "this.file":
            return Value("this")
        if own == "this.file.path":
            return Value("text", F.lit(self.context.this_path), self.context.this_path)
        if own.startswith(("file.", "this.")) and own not in FILE_FIELDS:
            raise self.unknown(f"unknown property {own}", place)
        return Value("text", field(own))

    def called(self, name: str, place: int) -> Value:
        arguments = []
        while not self.mark(")"):
            if arguments:
                self.expect(",")
            start = self.at
            value = self.operand()
            if value.kind != "this" and value.constant is None:
                raise self.unknown("a constant is expected", self.tokens[start][2])
            arguments.append(value)
        if name == "file.hasLink" and len(arguments) == 1:
            path = self.context.this_path if arguments[0].kind == "this" else arguments[0].constant
            return flag(F.col(self.links.setdefault(path, f"_linked{len(self.links)}")))
        if any(a.kind == "this" for a in arguments):
            raise self.unknown("this.file is for hasLink", place)
        constants = [a.constant for a in arguments]
        owner, _, method = name.rpartition(".")
        least, run = FUNCTIONS.get(name) or (METHODS[method] if owner and owner != "file" and method in METHODS else (0, None))
        if run is None:
            raise self.unknown(f"unknown function {name}", place)
        if len(constants) < least or len(constants) > least and name != "file.hasTag":
            raise self.unknown(f"{name} takes {least} arguments", place)
        try:
            return run(self, *constants) if name in FUNCTIONS else flag(run(owner, *constants))
        except Unknown as no:
            raise self.unknown(str(no), place) from None


def compare(how: str, left: Value, right: Value) -> Column:
    kinds = {left.kind, right.kind}
    if "null" in kinds:
        if how not in ("==", "!="):
            raise Unknown(f"null has no order for {how}")
        if kinds == {"null"}:
            return F.lit(how == "==")
        other = left if right.kind == "null" else right
        absent = other.column == "" if other.kind == "text" else other.column.isNull()
        return absent if how == "==" else ~absent
    if not kinds <= {"text", "day", "number"} or kinds >= {"day", "number"}:
        raise Unknown(f"{left.kind} and {right.kind} can't be compared")
    to = {"day": X.strict_date, "number": lambda c: c.try_cast("double")}["day" if "day" in kinds else "number"] if kinds != {"text"} else None
    a, b = (v.column if to is None or v.kind != "text" else to(v.column.cast("string")) for v in (left, right))
    return COMPARISONS[how](a, b)


def compiled(condition: str | dict | list, context: Context, links: dict[str, str] | None = None) -> Column:
    """The condition as a column; columns that ``links`` then names must be there."""
    links = {} if links is None else links
    if isinstance(condition, str):
        return Reader(condition, context, links).condition()
    if isinstance(condition, list):
        condition = {"and": condition}
    ((how, parts),) = condition.items()
    out = None
    for part in parts if isinstance(parts, list) else [parts]:
        own = compiled(part, context, links)
        out = own if out is None else out & own if how == "and" else out | own
    out = F.lit(how != "or") if out is None else out
    return ~out if how == "not" and parts else out


# -- views ------------------------------------------------------------------
def given(spark: SparkSession) -> dict[str, View]:
    """The thirteen views by name."""
    return read_views(spark, "file://" + GIVEN)


def view(notes: DataFrame, which: View | str, context: Context, edges: DataFrame | None = None) -> DataFrame:
    """path and the view's columns (``file.name`` as file_name); grouped views are sorted by the group.

    A name stands for one of the given views. ``edges`` (src, dst) are needed
    for hasLink only, and found in the notes where they are not handed over.
    """
    own = given(notes.sparkSession)[which] if isinstance(which, str) else which
    links: dict[str, str] = {}
    condition, rows = compiled(own.filters, context, links), notes
    if links and edges is None:
        edges = G.edges(G.link_targets(notes))
    for path, column in links.items():
        sources = edges.where(F.col("dst") == F.lit(path)).select(F.col("src").alias("path"), F.lit(True).alias(column)).distinct()
        rows = rows.join(sources.hint("merge"), "path", "left")  # by the size of their files notes would be taken for few and broadcast
    out = rows.where(condition).select("path", *(field(c).alias(c.replace(".", "_")) for c in own.columns))
    if not own.group:
        return out
    by = own.group.removeprefix("note.").replace(".", "_")
    if by not in out.columns:
        out = rows.where(condition).select("path", *(field(c).alias(c.replace(".", "_")) for c in (*own.columns, own.group)))
        by = out.columns[-1]
    return out.orderBy(F.col(by).desc() if own.descending else F.col(by), "path")


def register(notes: DataFrame, some: Iterable[View], context: Context, edges: DataFrame | None = None, prefix: str = "view_") -> list[str]:
    """Each view as a temporary view for SQL, by its name in lower case with underscores; gives the names."""
    names = []
    for own in some:
        name = prefix + re.sub(r"\W+", "_", own.name.lower()).strip("_")
        if name in names:
            raise ValueError(f"two views are called {name}")
        view(notes, own, context, edges).createOrReplaceTempView(name)
        names.append(name)
    return names
