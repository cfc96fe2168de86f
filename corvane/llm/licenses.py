"""License scans: phrases word for word, and short notices within bounded errors.

Texts are compared as their words in lower case with one space between, so
line breaks, comment marks and punctuation are no errors. A notice with k
allowed errors is split into k + 1 pieces; k errors leave one piece untouched
(pigeonhole), so every match lies around an exact place of a piece. Only the
windows around these places are searched, by the regex library's bounded-error
matching, which counts the errors and gives the span. A notice may ask for
words that must stand in the match as they are, as one letter parts some
licenses from others. The matching takes about three times as long for each
further error, so long licenses are sought by a line of them with three.

Nulls and edge cases: a null or wordless text has no words, places or labels
and the score 0; a null doc_id is kept; repeated rows are judged each by
itself; an empty table gives an empty result; other columns are ignored.
Matches never cross documents. Of the matches of one notice that overlap the
leftmost counts; notices of different labels may overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import bounded, slices


class Notice(NamedTuple):
    label: str
    words: str
    errors: int
    needs: frozenset[bytes] = frozenset()


def _needs(*words: str) -> frozenset[bytes]:
    return frozenset(w.encode() for w in words)


# Phrases that are labelled wherever their words stand consecutively.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Opening words of published licenses and the usual lines that name them, as folded words.
NOTICES = (
    Notice("mit", "released under the mit license", 3, _needs("mit")),
    Notice("mit", "licensed under the mit license", 3, _needs("mit")),
    Notice("mit", "free of charge to any person obtaining a copy", 3),
    Notice("apache-2", "licensed under the apache license version 2 0", 3, _needs("apache", "2")),
    Notice("apache-2", "use this file except in compliance with the license", 3),
    Notice("cc-by-nc", "licensed under cc by nc 4 0", 2, _needs("cc", "by", "nc")),
    Notice("cc-by-nc", "creative commons attribution noncommercial", 3),
    Notice("cc-by-sa", "licensed under cc by sa 4 0", 2, _needs("cc", "by", "sa")),
    Notice("cc-by-sa", "creative commons attribution sharealike", 3),
    Notice("cc-by", "licensed under cc by 4 0", 2, _needs("cc", "by", "4")),
    Notice("gpl-2", "gnu general public license version 2", 3, _needs("2")),
    Notice("gpl-3", "gnu general public license version 3", 3, _needs("3")),
    Notice("lgpl", "gnu lesser general public license", 3),
    Notice("agpl-3", "gnu affero general public license version 3", 3, _needs("3")),
    Notice("bsd", "redistribution and use in source and binary forms", 3),
    Notice("mpl-2", "terms of the mozilla public license v 2 0", 3, _needs("2")),
    Notice("isc", "use copy modify and or distribute this software", 3),
    Notice("unlicense", "free and unencumbered software released into the public domain", 3),
)

#: A-Z as a-z; every other byte that is no digit, letter or part of a non-ASCII character as a space.
FOLD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Bytes that a character takes at most.
WIDE = 4


def fold(texts: list[bytes]) -> bytes:
    """The words of each text, each between single spaces; texts are parted by a line feed."""
    flat = b"\n".join(b" " + t.translate(FOLD) + b" " for t in texts)
    while b"  " in flat:
        flat = flat.replace(b"  ", b" ")
    return flat


def places(flat: bytes, part: bytes) -> Iterator[int]:
    at = flat.find(part)
    while at >= 0:
        yield at
        at = flat.find(part, at + 1)


class Match(NamedTuple):
    start: int
    end: int
    edits: int
    notice: Notice


class Scanner:
    """Notices with their pieces and patterns."""

    def __init__(self, notices: tuple[Notice, ...] = NOTICES, phrases: dict[str, str] = PHRASES):
        self.phrases = [(f" {words} ".encode(), label) for words, label in phrases.items()]
        self.notices = [(n, regex.compile(f"(?e)(?:{regex.escape(n.words)}){{e<={n.errors}}}"), self.pieces(n)) for n in notices]

    @staticmethod
    def pieces(notice: Notice) -> list[tuple[bytes, int]]:
        """errors + 1 pieces of about equal length, with where each begins."""
        words = notice.words.encode()
        cuts = np.linspace(0, len(words), notice.errors + 2).astype(int).tolist()
        return [(words[a:b], a) for a, b in zip(cuts, cuts[1:], strict=False)]

    def windows(self, flat: bytes, notice: Notice, pieces: list[tuple[bytes, int]]) -> Iterator[tuple[int, int]]:
        """Spans of single texts that hold every match, apart from each other."""
        slack = WIDE * notice.errors
        found = sorted((at, offset) for piece, offset in pieces for at in places(flat, piece))
        begin = end = -1
        for at, offset in found:
            low = max(at - offset - slack, flat.rfind(b"\n", max(0, at - offset - slack), at) + 1, 0)
            high = at - offset + len(notice.words) + slack
            stop = flat.find(b"\n", at, high)
            high = min(high, len(flat)) if stop < 0 else stop
            while low and flat[low] & 0xC0 == 0x80:
                low -= 1
            while high < len(flat) and flat[high] & 0xC0 == 0x80:
                high += 1
            if low > end:
                if end >= 0:
                    yield begin, end
                begin, end = low, high
            else:
                begin, end = min(begin, low), max(end, high)
        if end >= 0:
            yield begin, end

    def matches(self, flat: bytes) -> list[Match]:
        """Matches of all notices, as spans of ``flat`` that begin and end with words."""
        out = []
        for notice, pattern, pieces in self.notices:
            for begin, end in self.windows(flat, notice, pieces):
                for part, start in self.rows(flat, begin, end):
                    text = part.decode()
                    for m in pattern.finditer(text):
                        a = start + len(text[: m.start()].encode())
                        b = a + len(m.group().encode())
                        # whole words
                        while flat[a] == 32 and a < b:
                            a += 1
                        while flat[b - 1] == 32 and a < b:
                            b -= 1
                        a, b = flat.rfind(b" ", 0, a + 1) + 1, flat.find(b" ", b)
                        if a < b and notice.needs <= set(flat[a:b].split(b" ")):
                            out.append(Match(a, b, sum(m.fuzzy_counts), notice))
        return sorted(out)

    @staticmethod
    def rows(flat: bytes, begin: int, end: int) -> Iterator[tuple[bytes, int]]:
        """Windows of neighbouring texts may touch: each text's part by itself."""
        for part in flat[begin:end].split(b"\n"):
            yield part, begin
            begin += len(part) + 1

    def scan(self, texts: list[bytes]) -> list[dict]:
        flat = fold(texts)
        ends = np.flatnonzero(np.frombuffer(flat, np.uint8) == 10).tolist() + [len(flat)]
        begins = [0] + [e + 1 for e in ends[:-1]]
        base: list[list[tuple[int, str]]] = [[] for _ in texts]
        near: list[list[Match]] = [[] for _ in texts]
        for words, label in self.phrases:
            for at in places(flat, words):
                base[int(np.searchsorted(ends, at, "right"))].append((at + 1, label))
        for m in self.matches(flat):
            near[int(np.searchsorted(ends, m.start, "right"))].append(m)
        out = []
        for text, begin, end, exact, fuzzy in zip(texts, begins, ends, base, near, strict=True):
            row = {"n_words": max(0, flat.count(b" ", begin, end) - 1), "n_base": len(exact), "first_word": None, "last_word": None, "base_labels": "", "labels": "", "score": 0.0, "notices": ""}
            if exact or fuzzy:
                spaces = np.flatnonzero(np.frombuffer(flat, np.uint8)[begin:end] == 32) + begin
                nth = lambda at: int(np.searchsorted(spaces, at)) - 1
                starts = sorted(nth(at) for at, _ in exact)
                if starts:
                    row |= {"first_word": starts[0], "last_word": starts[-1]}
                labels = {label for _, label in exact}
                row |= {"base_labels": ",".join(sorted(labels)), "labels": ",".join(sorted(labels | {m.notice.label for m in fuzzy}))}
                row["score"] = max([float(bool(exact)), *(1 - m.edits / len(m.notice.words) for m in fuzzy)])
                row["notices"] = self.spans(text, [(m.notice.label, nth(m.start), nth(m.end) + 1, m.edits) for m in fuzzy])
            out.append(row)
        return out

    @staticmethod
    def spans(text: bytes, found: list[tuple[str, int, int, int]]) -> str:
        """label:start:end:edits of matches given by their first word and the one after their last, in code points of the text."""
        wanted = {w for _, a, b, _ in found for w in (a, b - 1)}
        place: dict[int, tuple[int, int]] = {}
        last = points = 0
        for i, m in enumerate(WORD.finditer(text)) if wanted else ():
            if i in wanted:
                points += len(text[last : m.start()].decode())
                last = m.start()
                place[i] = points, points + len(m.group().decode())
                if len(place) == len(wanted):
                    break
        return ",".join(f"{label}:{place[a][0]}:{place[b - 1][1]}:{edits}" for label, a, b, edits in found)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, notices string"
TYPES = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]


def scan_licenses(docs: DataFrame, notices: tuple[Notice, ...] = NOTICES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices.

    ``notices`` lists label:start:end:edits in code points by start; the score
    is 1 for a phrase, else the largest share of a notice that is without error.
    """
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices, phrases)
        for batch in slices(batches):
            rows = scanner.scan([v or b"" for v in batch.column("text").cast(pa.binary()).to_pylist()])
            columns = [pa.array([r[k] for r in rows], t) for k, t in zip(rows[0], TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], names=["doc_id", *rows[0]])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
