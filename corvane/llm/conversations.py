"""Conversation structure repair by a min-plus scan of matrices.

A conversation is well formed if the initials of its roles read
``(s?(ua)+)?``: four states (nothing yet, after s, after u, after a), of which
the first and the last accept. Each turn is a 4x4 matrix whose entry (i, j) is
the cheapest way from state i to j: keep the turn, give it the role user or
assistant, or delete it, followed by the closure of inserting empty turns. An
element is (cost, audit); min takes the less, plus joins. Two audits of equal
cost and the same turns are never prefixes of each other, as what follows a
prefix would be inserts, which cost; so joining keeps their order, the product
is associative, and a conversation's matrices may be multiplied in any tree.

Turns are sorted over all partitions by conversation and place. A conversation
that lies whole in a partition, in one piece, is settled there. Of the others
each partition gives one product, and products meet eight at a time, level by
level. The audit is then cut into pieces again, pieces are repaired each by
itself, and their bytes are hashed in order; SHA-256 can't be shared out, but
reads piece by piece.

Nulls and edge cases: null roles, texts, and in the damage's key also ids and
turns, are one space; rows with a null conv_id are one conversation; turns
that are equal are in the order of role, text (its first characters, then its
digest) and row; a conversation without rows after the damage has zeros and an
empty audit; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded, materialise, scratch

#: Turns and text bytes of a piece; bounds what a task holds of a conversation.
PIECE_ROWS, PIECE_BYTES = 1024, 1 << 20
#: Products that meet at once.
FAN_IN = 8
#: Characters of a text that are part of the order.
HEAD = 32
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: What a kind of edit costs, and a truncated turn that stays.
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
ROLE = {"u": "user", "a": "assistant"}
#: The state that an initial leads to.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPT = (0, 3)
STATES = range(4)
Element = tuple[int, str]
#: Rows of a matrix by start; missing entries are ways that don't exist.
Matrix = list[dict[int, Element]]


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for row in a:
        best: dict[int, Element] = {}
        for k, (cost, audit) in row.items():
            for j, (more, letters) in b[k].items():
                total = cost + more
                have = best.get(j)
                if have is None or total < have[0]:
                    best[j] = total, audit + letters
                elif total == have[0]:
                    best[j] = min(have, (total, audit + letters))
        out.append(best)
    return out


def _closure() -> Matrix:
    """Any number of inserts; more than two come back to a state."""
    one: Matrix = [{i: (0, "")} | {j: (COST[INSERT], INSERT) for (k, c), j in NEXT.items() if k == i and c in ROLE} for i in STATES]
    return times(one, one)


CLOSURE = _closure()


@lru_cache(maxsize=None)
def matrix(kind: str) -> Matrix:
    """Of a turn by its kind: D if it must go, else its initial (s, u, a or another), and t if it is truncated."""
    out: Matrix = []
    extra = TRUNCATED if kind.endswith("t") else 0
    for i in STATES:
        row = {i: (COST[DELETE], DELETE)}
        if kind != DELETE:
            for (k, c), j in NEXT.items():
                ways = [(COST[KEEP] + extra, KEEP)] * (c == kind[0]) + [(COST[REROLE] + extra, REROLE)] * (c in ROLE)
                if k == i and ways:
                    row[j] = min([*ways, row.get(j, ways[0])])
        out.append(row)
    return times(out, CLOSURE)


def kind_of(initial: str, fault: str) -> str:
    if fault in ("blank", "duplicate"):
        return DELETE
    return (initial if initial in ("s", "u", "a") else "x") + ("t" if fault == "truncated" else "")


IDENTITY: Matrix = [{i: (0, "")} for i in STATES]


def product(kinds: Iterator[str] | list[str] | tuple[str, ...], start: Matrix) -> Matrix:
    for kind in kinds:
        start = times(start, matrix(kind))
    return start


def cheapest(whole: Matrix) -> Element:
    """From the first state to one that accepts, with inserts before the first turn."""
    first = times([CLOSURE[0]], whole)[0]
    return min(first[j] for j in ACCEPT if j in first)


@lru_cache(maxsize=1 << 14)
def settled(kinds: tuple[str, ...]) -> Element:
    first = product(kinds, [CLOSURE[0]])[0]
    return min(first[j] for j in ACCEPT if j in first)


def repaired(rows: list[tuple[str, str]], audit: str, after_user: bool) -> list[str]:
    """role:text of what edits leave of (role, text) rows, beginning after a user's turn or not."""
    out, at = [], 0
    for letter in audit:
        if letter == DELETE:
            at += 1
            continue
        if letter == KEEP:
            role, text = rows[at]
        else:
            role, text = ROLE["a" if after_user else "u"], "" if letter == INSERT else rows[at][1]
        if letter != INSERT:
            at += 1
        after_user = role[:1] == "u"
        out.append(f"{role}:{text}")
    return out


class Span(NamedTuple):
    """What is known of neighbouring turns of a conversation; first and last are roles' initials."""

    rows: int
    first: str | None
    last: str | None
    low: int | None
    high: int | None
    turns: int
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    costs: list[int | None]
    audits: list[str | None]


def packed(m: Matrix) -> tuple[list[int | None], list[str | None]]:
    flat = [row.get(j, (None, None)) for row in m for j in STATES]
    return [c for c, _ in flat], [a for _, a in flat]


def unpacked(costs: list[int | None], audits: list[str | None]) -> Matrix:
    return [{j: (costs[4 * i + j], audits[4 * i + j]) for j in STATES if costs[4 * i + j] is not None} for i in STATES]


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def joined(a: Span, b: Span) -> Span:
    costs, audits = packed(times(unpacked(a.costs, a.audits), unpacked(b.costs, b.audits)))
    meet = a.last is not None and b.first is not None
    return Span(
        a.rows + b.rows,
        b.first if a.first is None else a.first,
        a.last if b.last is None else b.last,
        b.low if a.low is None else a.low,
        a.high if b.high is None else b.high,
        a.turns + b.turns - (a.high is not None and a.high == b.low),
        a.blank + b.blank,
        a.duplicate + b.duplicate,
        a.truncated + b.truncated,
        a.illegal + b.illegal + (meet and not legal(a.last, b.first)),
        costs,
        audits,
    )


class Piece:
    """Turns of one conversation in order, up to the bounds of a piece."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str]] = []
        self.kinds: list[str] = []
        self.turns: list[int] = []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.bytes = 0

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        if self.rows and not legal(self.rows[-1][0][:1], role[:1]):
            self.illegal += 1
        self.rows.append((role, text))
        self.kinds.append(kind_of(role[:1], fault))
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        if fault:
            self.faults[fault] += 1
        self.bytes += len(role) + len(text)

    def full(self) -> bool:
        return len(self.rows) >= PIECE_ROWS or self.bytes >= PIECE_BYTES

    def span(self, matrices: bool = True) -> Span:
        costs, audits = packed(product(self.kinds, IDENTITY)) if matrices else ([], [])
        first, last = (self.rows[0][0][:1], self.rows[-1][0][:1]) if self.rows else (None, None)
        low, high = (self.turns[0], self.turns[-1]) if self.turns else (None, None)
        return Span(len(self.rows), first, last, low, high, len(self.turns), *self.faults.values(), self.illegal, costs, audits)


SPAN = "rows long, first string, last string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, costs array<long>, audits array<string>"
SPAN_NAMES = [x.split()[0] for x in SPAN.split(", ")]
LIST_LONG, LIST_STRING = pa.list_(pa.int64()), pa.list_(pa.string())
SPAN_TYPES = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 7, LIST_LONG, LIST_STRING]
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def result_of(span: Span, cost: int, audit: str) -> tuple:
    gaps = 0 if span.low is None else span.high - span.low + 1 - span.turns
    return gaps, span.blank, span.duplicate, span.truncated, span.illegal, cost, audit


#: What :func:`scanned` gives: whole conversations (kind W), products of a partition (P) and pieces with their turns (T).
SCANNED = f"kind string, conv_id long, part long, seq long, gaps long, cost long, audit string, repaired_sha256 string, roles array<string>, texts array<string>, {SPAN}"
SCANNED_NAMES = [x.split()[0] for x in SCANNED.split(", ")]
SCANNED_TYPES = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.string(), LIST_STRING, LIST_STRING, *SPAN_TYPES]


def _batch(rows: list[dict], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], t) for k, t in zip(names, types, strict=True)], names=names)


def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns of a partition to rows of SCANNED. The first and the last conversation may go on in other partitions."""
    part = TaskContext.get().partitionId()
    out: list[dict] = []
    held = 0
    conv: int | None = None
    begun = first_conv = False
    piece, seq, total = Piece(), 0, None

    def pieces() -> None:
        """Give the piece with its turns, and add it to the partition's product."""
        nonlocal piece, seq, total, held
        span = piece.span()
        out.append({"kind": "T", "conv_id": conv, "part": part, "seq": seq, "roles": [r for r, _ in piece.rows], "texts": [t for _, t in piece.rows], "rows": len(piece.rows)})
        held += piece.bytes
        total = span if total is None else joined(total, span)
        piece, seq = Piece(), seq + 1

    def close(open_: bool) -> None:
        nonlocal piece, seq, total, held
        if open_ or seq:
            pieces()
            out.append({"kind": "P", "conv_id": conv, "part": part} | total._asdict())
        else:
            cost, audit = settled(tuple(piece.kinds))
            span = piece.span(matrices=False)
            names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
            text = "\n".join(repaired(piece.rows, audit, False))
            out.append({"kind": "W", "conv_id": conv, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()} | dict(zip(names, result_of(span, cost, audit), strict=True)))
            held += len(audit)
        piece, seq, total = Piece(), 0, None

    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in ("conv_id", "turn", "role", "text", "fault", "gone")]
        for c, turn, role, text, fault, gone in zip(*columns, strict=True):
            if not begun:
                conv, begun, first_conv = c, True, True
            elif c != conv:
                close(first_conv)
                conv, first_conv = c, False
            if gone:
                continue
            if piece.full():
                pieces()
            piece.add(turn, role, text, fault)
            if held >= PIECE_BYTES or len(out) >= PIECE_ROWS:
                yield _batch(out, SCANNED_NAMES, SCANNED_TYPES)
                out, held = [], 0
    if begun:
        close(True)
    if out:
        yield _batch(out, SCANNED_NAMES, SCANNED_TYPES)


def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Products of neighbouring parts, in order in a list, to one."""
    names = ["conv_id", "part", *SPAN_NAMES]
    for batch in batches:
        for row in batch.to_pylist():
            spans = [Span(*(x[k] for k in SPAN_NAMES)) for x in row["spans"]]
            whole = spans[0]
            for more in spans[1:]:
                whole = joined(whole, more)
            yield _batch([{"conv_id": row["conv_id"], "part": row["part"]} | whole._asdict()], names, [pa.int64(), pa.int64(), *SPAN_TYPES])


ROOT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
ROOT_NAMES = [x.split()[0] for x in ROOT.split(", ")]


def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole products to results."""
    for batch in batches:
        for row in batch.to_pylist():
            span = Span(*(row[k] for k in SPAN_NAMES))
            found = result_of(span, *cheapest(unpacked(span.costs, span.audits)))
            yield _batch([dict(zip(ROOT_NAMES, (row["conv_id"], *found), strict=True))], ROOT_NAMES, [*[pa.int64()] * 7, pa.string()])


CUT = "conv_id long, part long, seq long, after_user boolean, letters string"


def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An audit and the sizes of its conversation's pieces, in order, to each piece's edits and the state before."""
    names, types = [x.split()[0] for x in CUT.split(", ")], [pa.int64()] * 3 + [pa.bool_(), pa.string()]
    for batch in batches:
        for row in batch.to_pylist():
            audit, sizes = row["audit"], row["sizes"]
            # left turns are s?(ua)+, so their number tells whether there is an s
            odd = (len(audit) - audit.count(DELETE)) % 2
            out, at, left = [], 0, 0
            for k, size in enumerate(sizes):
                end, seen = at, 0
                while seen < size["rows"]:
                    step = audit[end : end + size["rows"] - seen]
                    seen += len(step) - step.count(INSERT)
                    end += len(step)
                if k == len(sizes) - 1:
                    end = len(audit)
                letters = audit[at:end]
                out.append({"conv_id": row["conv_id"], "part": size["part"], "seq": size["seq"], "after_user": left > 0 and (left - odd) % 2 == 1, "letters": letters})
                left += len(letters) - letters.count(DELETE)
                at = end
            yield _batch(out, names, types)


MENDED = "conv_id long, part long, seq long, turns long, text string"


def mended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, types = [x.split()[0] for x in MENDED.split(", ")], [pa.int64()] * 4 + [pa.string()]
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            left = repaired(list(zip(row["roles"], row["texts"], strict=True)), row["letters"], row["after_user"])
            out.append({k: row[k] for k in names[:3]} | {"turns": len(left), "text": "\n".join(left)})
        yield _batch(out, names, types)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired pieces, sorted, to a digest of each conversation; holds one piece at a time."""
    names, types = ["conv_id", "repaired_sha256"], [pa.int64(), pa.string()]
    conv = digest = None
    empty = True
    for batch in batches:
        done = []
        for c, turns, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "turns", "text")), strict=True):
            if digest is None or c != conv:
                if digest is not None:
                    done.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
                conv, digest, empty = c, hashlib.sha256(), True
            if turns:
                digest.update((text if empty else "\n" + text).encode())
                empty = False
        yield _batch(done, names, types)
    if digest is not None:
        yield _batch([{"conv_id": conv, "repaired_sha256": digest.hexdigest()}], names, types)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with a damage dealt by their ids; a dropped row stays, marked as gone, so that its conversation is known."""
    space = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), space)
    damage = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), damage.alias("damage"))
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("damage") == 0).alias("gone"), F.explode(copies).alias("copy")).drop("copy")


ORDER = ("conv_id", "turn", "role", "head", "digest", "row_id")


def with_faults(turns: DataFrame) -> DataFrame:
    """The turns with a name of each row, its place's columns and its first fault."""
    ends = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    rows = turns.withColumns({"row_id": F.monotonically_increasing_id(), "head": F.substring("text", 1, HEAD), "digest": F.sha2("text", 256), "blank": ends == "", "truncated": ~F.right(ends, F.lit(1)).isin(".", "!", "?")})
    rows = materialise(rows, "turns")
    # turns that are said again: the place of the first
    again = rows.where("not gone and not blank").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "row_id")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.row_id").alias("first_id"))
    marked = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    fault = F.when(F.col("gone"), "").when(F.col("blank"), "blank").when(F.col("first_id") != F.col("row_id"), "duplicate").when(F.col("truncated"), "truncated").otherwise("")
    return marked.select(*ORDER, "text", "gone", fault.alias("fault"))


def _next_to(a: DataFrame, b: DataFrame, *more: str) -> DataFrame:
    """Inner join on conv_id, where nulls are equal, and further columns."""
    names = ("conv_id", *more)
    b = b.select(*(F.col(c).alias(f"{c}_" if c in names else c) for c in b.columns))
    met = F.col("conv_id").eqNullSafe(F.col("conv_id_"))
    for c in more:
        met = met & (F.col(c) == F.col(f"{c}_"))
    return a.join(b, met).drop(*(f"{c}_" for c in names))


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation.

    ``turns`` has conv_id, turn, role, text (role and text not null), and may
    have gone (boolean): rows that aren't there, but whose conversation is.
    """
    bounded(turns.sparkSession)
    if "gone" not in turns.columns:
        turns = turns.withColumn("gone", F.lit(False))
    with scratch() as temporary:
        return _repair(turns, temporary)


def _repair(turns: DataFrame, temporary: Scratch) -> DataFrame:
    place = [F.col(c).asc_nulls_first() for c in ORDER]
    marked = with_faults(turns.select("conv_id", "turn", "role", "text", "gone"))
    scans = materialise(marked.repartitionByRange(*place).sortWithinPartitions(*place).mapInArrow(scanned, SCANNED), "scans")
    whole = scans.where("kind = 'W'").select(*(x.split()[0] for x in RESULT.split(", ")))
    open_ = scans.where("kind = 'P'").select("conv_id", "part", *SPAN_NAMES)
    width = 1 + (scans.where("kind = 'P'").agg(F.max("part")).first()[0] or 0)
    while width > 1:
        width = -(-width // FAN_IN)
        near = open_.groupBy("conv_id", F.floor(F.col("part") / FAN_IN).alias("part_"))
        near = near.agg(F.sort_array(F.collect_list(F.struct("part", *SPAN_NAMES))).alias("spans")).withColumnRenamed("part_", "part")  # FAN_IN at most
        open_ = near.mapInArrow(folded, f"conv_id long, part long, {SPAN}")
    roots = materialise(open_.mapInArrow(decided, ROOT), "roots")
    temporary.keep(scans, roots)
    pieces = scans.where("kind = 'T'").select("conv_id", "part", "seq", "rows", "roles", "texts")
    # sizes take less than the audit, which is a letter for each turn
    sizes = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "seq", "rows"))).alias("sizes"))
    letters = _next_to(roots.select("conv_id", "audit"), sizes).mapInArrow(cut, CUT)
    texts = _next_to(pieces, letters, "part", "seq").mapInArrow(mended, MENDED)
    digests = texts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(hashed, "conv_id long, repaired_sha256 string")
    return whole.unionByName(_next_to(roots, digests))
