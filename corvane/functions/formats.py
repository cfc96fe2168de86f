"""Dates in the format letters of note templates, and ids of titles, as expressions on columns."""

from __future__ import annotations

import json
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import TRANSLITERATIONS

#: Letters and the datetime pattern of each; week years and weeks have no pattern, see below.
LETTERS = {
    "YYYY": "yyyy", "YY": "yy", "MMMM": "MMMM", "MMM": "MMM", "MM": "MM", "M": "M", "DD": "dd", "D": "d",
    "dddd": "EEEE", "ddd": "EEE", "HH": "HH", "mm": "mm", "ss": "ss",
}
WEEKS = ("GGGG", "GG", "WW", "W")
PIECE = re.compile(r"\[([^\]]*)\]|" + "|".join(sorted((*LETTERS, *WEEKS), key=len, reverse=True)) + "|.", re.DOTALL)
#: Characters outside ASCII that compatibility decomposition leaves some ASCII of, by rule.
ASCII_OF = {c: kept for c in map(chr, range(0x80, 0x30000)) if (kept := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode())}


def _week(c: Column, letters: str) -> Column:
    year = F.extract(F.lit("YEAROFWEEK"), c)
    if letters == "GGGG":
        return F.lpad(year.cast("string"), 4, "0")
    if letters == "GG":
        return F.lpad((year % 100).cast("string"), 2, "0")
    week = F.weekofyear(c).cast("string")
    return F.lpad(week, 2, "0") if letters == "WW" else week


def moment(c: Column, pattern: str) -> Column:
    """A date or timestamp in ``pattern``: letters, literals in brackets, other characters as they are.

    The pattern is taken apart once, when the expression is built. A bracket
    that is never closed stands for itself; null gives null.
    """
    parts: list[Column] = []
    for m in PIECE.finditer(pattern):
        if m[1] is None and m[0] in LETTERS:
            parts.append(F.date_format(c, LETTERS[m[0]]))
        elif m[1] is None and m[0] in WEEKS:
            parts.append(_week(c, m[0]))
        else:
            parts.append(F.lit(m[0] if m[1] is None else m[1]))
    return F.when(c.isNotNull(), F.concat(*parts) if parts else F.lit(""))


def ascii_of(c: Column) -> Column:
    """What compatibility decomposition leaves of a text in ASCII; plain texts take the short way."""
    table = F.from_json(F.lit(json.dumps(ASCII_OF)), "map<string, string>")
    kept = lambda x: F.when(x.rlike(r"^[\x00-\x7F]$"), x).otherwise(F.coalesce(F.try_element_at(table, x), F.lit("")))
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.array_join(F.transform(F.split(c, ""), kept), "")).otherwise(c)


def slug(c: Column) -> Column:
    """ASCII id of a title: German letters spelled out, accents dropped, ``note`` if nothing is left; null stays null."""
    spelled = c
    for letter, spelling in TRANSLITERATIONS.items():
        spelled = F.replace(spelled, F.lit(letter), F.lit(spelling))
    plain = F.lower(F.regexp_replace(F.regexp_replace(ascii_of(spelled), "[^a-zA-Z0-9]+", "-"), "^-|-$", ""))
    return F.when(plain == "", F.lit("note")).otherwise(plain)
