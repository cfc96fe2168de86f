import hashlib
import heapq
import random
import re
import zlib

import pytest

from corvane.llm import conversations

SHAPE = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d == 0:
            continue
        if d == 1:
            text = ""
        if d == 2:
            text = re.sub("[.!?]", "", text)
        if d == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if d == 3 else 1)
    return out


def cheapest(rows, faults):
    """Least (cost, edits) by best-first search over (rows read, roles left); no matrices, no states."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, left, kept = heapq.heappop(heap)
        if (at, left[-2:], bool(left), left[:1] == "s") in seen:
            continue
        seen.add((at, left[-2:], bool(left), left[:1] == "s"))
        if at == len(rows) and SHAPE.fullmatch(left):
            return cost, audit, "\n".join(kept)
        ways = [(2, "I", at, r, f"{r}:") for r in ("user", "assistant")]
        if at < len(rows):
            role, text = rows[at]
            ways.append((3, "D", at + 1, None, None))
            if faults[at] not in ("blank", "duplicate"):
                more = faults[at] == "truncated"
                ways.append((more, "K", at + 1, role, f"{role}:{text}"))
                ways += [(2 + more, "R", at + 1, r, f"{r}:{text}") for r in ("user", "assistant")]
        for more, letter, then, role, line in ways:
            roles = left + (role[:1] if role else "") if role is not None else left
            if role is not None and not role or not re.fullmatch(r"s?(ua)*u?|", roles):
                continue
            heapq.heappush(heap, (cost + more, audit + letter, then, roles, kept if line is None else (*kept, line)))
    raise AssertionError


def brute(rows):
    out = []
    left = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in left if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][: conversations.HEAD], hashlib.sha256(r[2].encode()).hexdigest()))
        faults, seen = [], set()
        for _, role, text in own:
            body = text.rstrip(" \t\n\v\f\r")
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        cost, audit, text = cheapest([r[1:] for r in own], faults)
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def made(n, longest, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]) if rng.random() < 0.4 else ("user", "assistant")[turn % 2]
            text = rng.choice(["Yes.", "No!", "why", "", " ", "\n", None, "Éé?", "end. \n", "a" * 50, "a" * 50 + "b."]) if rng.random() < 0.5 else f"Text {rng.random()}."
            rows.append((conv if rng.random() < 0.97 else None, turn + rng.randint(0, 1) if rng.random() < 0.9 else None, role, text))
    return rows + rows[:5]


SCHEMA = "conv_id long, turn long, role string, text string"


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as gaps", "'x' as fault").repartition(3)
    got = conversations.repair(conversations.damaged(df)).collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.mark.parametrize("rows_a_piece", [1024, 2])
def test_repairs_equal_a_best_first_search(spark, monkeypatch, rows_a_piece):
    monkeypatch.setattr(conversations, "PIECE_ROWS", rows_a_piece)
    rows = made(60, 9, 5)
    assert run(spark, rows) == brute(rows)


def test_a_conversation_over_all_partitions(spark, monkeypatch):
    monkeypatch.setattr(conversations, "PIECE_ROWS", 16)
    monkeypatch.setattr(conversations, "FAN_IN", 2)
    rows = [(7, t, r, x) for _, t, r, x in made(1, 1, 1)] + [(7, t, r, x) for t, (_, _, r, x) in enumerate(made(40, 9, 8))] + [(8, 1, "user", "Hi.")]
    assert run(spark, rows) == brute(rows)


def test_products_are_associative():
    rng = random.Random(2)
    for _ in range(200):
        kinds = [rng.choice(["s", "u", "a", "x", "st", "ut", "at", "xt", "D"]) for _ in range(rng.randint(1, 12))]
        at = rng.randint(0, len(kinds))
        left, right = (conversations.product(k, conversations.IDENTITY) for k in (kinds[:at], kinds[at:]))
        assert conversations.times(left, right) == conversations.product(kinds, conversations.IDENTITY)


def test_empty_tables_and_conversations(spark):
    for conv in range(1, 6):
        assert run(spark, [(conv, None, None, None)]) == brute([(conv, None, None, None)])
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    none = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(conversations.damaged(none)).count() == 0
