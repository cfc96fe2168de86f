"""Text expressions on columns: all built in, so they stay within generated code."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+(?:[-'][\p{L}\p{N}]+)*"
#: Line breaks: CR LF as one, and each of LF CR VT FF FS GS RS NEL LS PS.
BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"


#: Characters that lower case leaves and full case folding changes, by rule.
FOLDED = {c: c.casefold() for c in map(chr, range(0x80, 0x20000)) if c == c.lower() and c != c.casefold()}
#: Outside these ranges folding may be more than lower case and ss for sharp s, or may part or join words.
PLAIN = "\u0000-\u00b4\u00b6-\u012f\u0131-\u0148\u014a-\u017e\u0180-\u01ef\u01f1-\u0344\u0400-\u0586\u0588-\u139f\u2000-\uab6f\uabc0-\ufaff"
ODD = f"[^{PLAIN}]"


def simply_folded(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def fold(c: Column) -> Column:
    """Full case folding; texts of plain characters take the short way."""
    to = F.from_json(F.lit(json.dumps(FOLDED)), "map<string, string>")
    spelled = lambda x: F.array_join(F.transform(F.split(F.lower(x), ""), lambda y: F.coalesce(F.try_element_at(to, y), y)), "")
    return F.when(c.rlike(ODD), spelled(c)).otherwise(simply_folded(c))


def ascii_fold(c: Column) -> Column:
    """Lower case of A-Z only, by which stored documents are ordered."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(c: Column) -> Column:
    """Folded words in order; words may hold inner hyphens and apostrophes."""
    words = lambda x: F.regexp_extract_all(x, F.lit(WORD), F.lit(0))
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike(ODD), F.transform(words(text), fold)).otherwise(words(simply_folded(text)))


def lines(c: Column) -> Column:
    """Lines of a text; a break at the end opens no further line, an empty text has none."""
    parts = F.split(F.coalesce(c, F.lit("")), BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strict_date(c: Column) -> Column:
    """A date only from exactly yyyy-MM-dd and a day that exists, else null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def positive_int(c: Column) -> Column:
    n = F.trim(c).try_cast("int")
    return F.when(n > 0, n)


def percent_encoded(c: Column) -> Column:
    """URI component encoding: a space is %20, an asterisk stays encoded."""
    return F.replace(F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def shortened(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, the last three dots if cut."""
    return F.when(F.length(c) > limit, F.concat(F.rtrim(F.substring(c, 1, limit - 3)), F.lit("..."))).otherwise(c)


def trigrams(c: Column) -> Column:
    """Distinct character trigrams of a term, padded by two spaces before and one after."""
    padded = F.concat(F.lit("  "), c, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def paragraphs(c: Column) -> Column:
    return F.split(c, r"\n\s*\n")


def without_code(c: Column) -> Column:
    """Code fences and inline code replaced by a blank."""
    return F.regexp_replace(F.regexp_replace(c, r"(?s)```.*?```", " "), "`[^`\n]*`", " ")


def links(c: Column) -> Column:
    """Targets of wikilinks outside code, in order, with repeats."""
    inside = F.regexp_extract_all(without_code(F.coalesce(c, F.lit(""))), F.lit(r"!?\[\[([^\]]+)\]\]"), F.lit(1))

    def target(x: Column) -> Column:
        bare = F.trim(F.substring_index(F.substring_index(x, "|", 1), "#", 1))
        return F.regexp_replace(bare, r"(?i)\.md$", "")

    named = F.filter(F.transform(inside, target), lambda x: (x != "") & ~x.startswith("http://") & ~x.startswith("https://"))
    return F.transform(named, lambda x: F.regexp_replace(F.replace(x, F.lit("\\"), F.lit("/")), "^/+", ""))


def contains_any_prefix(c: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | c.startswith(p)
    return out


def basename(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def link_key(c: Column) -> Column:
    """Key under which link targets and paths meet: folded, without outer slashes and .md."""
    return fold(F.regexp_replace(F.regexp_replace(c, "^/+|/+$", ""), r"(?i)\.md$", ""))


def inside(path: Column) -> Column:
    """The path relative to the corpus without ``.`` and ``..``; null if it leads outside."""

    def step(done: Column, part: Column) -> Column:
        up = F.when(F.size(done) > 0, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))  # above the root: null from here on
        return F.when(part.isin("", "."), done).when(part == "..", up).otherwise(F.concat(done, F.array(part)))

    parts = F.split(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/")
    return F.when(~F.startswith(F.trim(path), F.lit("/")), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/"))
