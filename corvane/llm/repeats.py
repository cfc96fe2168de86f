"""Exact long-repeat removal with a run-compressed Burrows-Wheeler index.

Every byte covered by a string of LENGTH bytes that starts anywhere else too
is removed. A single index over all texts can't be shared out, so the work is
cut by content: of every LENGTH bytes at least one k-gram is an anchor (the
least hash of the window, the first of equal ones), so two equal strings have
the same anchor at the same place. Only anchors that occur more than once
matter. An anchor's context, all strings of LENGTH bytes that have it as theirs,
is a stretch of the text; each string lies in one context only. The contexts
of repeated anchors are cut out and meet by anchor.

Contexts with equal bytes are one, and repeat as a whole. The distinct
contexts of an anchor are indexed together with those of other anchors: the
suffix order gives the Burrows-Wheeler transform, of which only the runs count.
At both ends of each run the sampled suffix is compared with its neighbour in
the order; inside a run a match is the one before it, shortened by one byte,
so streaming through the text carries the sampled lengths on and yields the
matching statistics of every position. Positions with LENGTH or more are marked.

An anchor with more than MOST_CONTEXTS distinct contexts isn't indexed in one
task: all strings of LENGTH bytes around it are then counted by hash in Spark.

Nulls and edge cases: a null text is empty; texts shorter than LENGTH keep
all; a null doc_id is kept as such; rows of equal doc_id count as different
documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import U, VALUES, constants, mix, prefix, span_hash, text_bytes
from .common import drop_table, materialise, scratch, slices

LENGTH = 200
#: Byte values of a second hash.
SECOND = constants(256, 77)
#: Bytes of an anchor.
GRAM = 32
#: Distinct contexts of one anchor that are indexed together: at most 3 MB of text.
MOST_CONTEXTS = 8192
#: Bytes of contexts in one index.
INDEX_BYTES = 1 << 18
#: Bytes packed into the first sort key, nine bits each.
PACKED = 7


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of each window of ``width`` keys."""
    n = len(keys)
    pad = -n % width
    blocks = np.concatenate([keys, np.full(pad, np.iinfo(keys.dtype).max, keys.dtype)]).reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of all rows of at least ``length`` bytes.

    (first start of a string that has the anchor, number of such starts, the
    anchor's hash)
    """
    width = length - gram + 1
    n = len(raw)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U)
    start = np.arange(n - gram + 1)
    hashes = span_hash(prefix(raw), start, start + gram)
    # high bits choose, positions break ties towards the first
    bits = max(1, int(n).bit_length())
    keys = (mix(hashes) >> U(bits)) << U(bits) | start.astype(U)
    chosen = (window_minima(keys, width) & U((1 << bits) - 1)).astype(np.int64)
    # a window that runs over a row's end is no window
    last = np.repeat(offsets[1:], np.diff(offsets))[: len(chosen)] - length
    begin = np.flatnonzero(np.arange(len(chosen)) <= last)
    chosen = chosen[begin]
    # an anchor's windows are neighbours, as the choice only moves on
    new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]])[: len(chosen)])
    count = np.diff(np.append(new, len(chosen)))
    return begin[new], count, hashes[chosen[new]]


def repeated_starts(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, which positions start ``length`` bytes that occur elsewhere among the texts.

    Run-compressed Burrows-Wheeler transform, sampled run ends, streamed
    matching statistics.
    """
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 1
    data = np.zeros(n, np.int64)
    body = np.ones(n, bool)
    body[ends] = False
    data[body] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    room = np.repeat(ends, sizes + 1) - np.arange(n)
    # Suffix order by doubling, from PACKED bytes on; the ranks of each step are kept.
    key = np.zeros(n, np.int64)
    for j in range(PACKED):
        key <<= 9
        key[: n - j] |= np.where(room[: n - j] >= j, data[j:], 0)
    levels = []
    step, longest = PACKED, int(sizes.max())
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.zeros(n, np.int64)
        np.cumsum(ordered[1:] != ordered[:-1], out=new[1:])
        rank = np.empty(n, np.int64)
        rank[order] = new
        levels.append((step, rank))
        if step >= longest or new[-1] == n - 1:
            break
        key = rank * (n + 2)
        ahead = np.flatnonzero(room >= step)
        key[ahead] += rank[ahead + step] + 1
        step *= 2
    # Burrows-Wheeler transform and its runs; no two texts' beginnings make a run
    before = np.where(order > 0, data[order - 1], 0)
    same = (before[1:] == before[:-1]) & (before[1:] > 0)
    edge = np.flatnonzero(~same)
    # ends of runs: each first row against the row above, each last row against the row below
    upper, lower = order[edge], order[edge + 1]
    common = _common(data, levels, room, upper, lower)
    statistics = np.zeros(n, np.int64)
    at = np.arange(n)
    for rows in (upper, lower):  # a position is in either list once at most
        value = np.full(n, -1, np.int64)
        value[rows] = common + rows
        np.maximum(statistics, np.minimum(np.maximum.accumulate(value) - at, room), out=statistics)
    long = statistics >= length
    first = ends - sizes
    return [long[a : a + s] for a, s in zip(first.tolist(), sizes.tolist(), strict=True)]


def _common(data: np.ndarray, levels: list[tuple[int, np.ndarray]], room: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at a and b.

    Ranks of falling steps tell whether as many further bytes agree; the last
    few bytes are compared one by one.
    """
    out = np.zeros(len(a), np.int64)
    most = np.minimum(room[a], room[b])
    top = len(room) - 1
    for step, rank in reversed(levels):
        same = rank[np.minimum(a + out, top)] == rank[np.minimum(b + out, top)]
        out += np.where(same & (out + step <= most), step, 0)
    same = np.ones(len(a), bool)
    for _ in range(levels[0][0] - 1):
        same &= (out < most) & (data[np.minimum(a + out, top)] == data[np.minimum(b + out, top)])
        out += same
    return out


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """A row for each document: its name, id, size, digest of the whole, and its anchors' hashes in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, offsets = text_bytes(batch.column("text"))
            at, _, hashes = anchors(raw, offsets)
            data = raw.tobytes()
            split = np.searchsorted(at, offsets)
            sha = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            own = pa.ListArray.from_arrays(pa.array(split.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("r1", "r2", "doc_id")), pa.array(np.diff(offsets)), pa.array(sha, pa.string()), own], names=["r1", "r2", "doc_id", "n_bytes", "sha", "anchors"])

    return docs.mapInArrow(run, "r1 long, r2 long, doc_id long, n_bytes long, sha string, anchors array<long>")


def _contexts(docs: DataFrame) -> DataFrame:
    """The context of each repeated anchor (its place in the text's anchors is in ``hits``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            raw, offsets = text_bytes(batch.column("text"))
            data = raw.tobytes()
            at, count, hashes = anchors(raw, offsets)
            first = np.searchsorted(at, offsets[:-1])
            hits = [np.array(h, np.int64) + f for h, f in zip(batch.column("hits").to_pylist(), first, strict=True)]
            row = np.repeat(np.arange(len(hits)), [len(h) for h in hits])
            pick = np.concatenate([*hits, np.zeros(0, np.int64)])
            begin, end = at[pick], at[pick] + count[pick] + LENGTH - 1
            own = [data[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]
            digest = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in own), np.int64).reshape(-1, 2)
            names = [batch.column(c).take(pa.array(row)) for c in ("r1", "r2")]
            yield pa.RecordBatch.from_arrays(
                [*names, pa.array(hashes[pick].view(np.int64)), pa.array((begin - offsets[row]).astype(np.int32)), pa.array(digest[:, 0].copy()), pa.array(digest[:, 1].copy()), pa.array(own, pa.binary())],
                names=["r1", "r2", "anchor", "start", "d1", "d2", "own"],
            )

    return docs.mapInArrow(run, "r1 long, r2 long, anchor long, start int, d1 long, d2 long, own binary")


def _runs(flags: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Bytes covered by strings of ``length`` at the flagged starts."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    gap = np.flatnonzero(np.diff(at) > length)
    begin = at[np.concatenate([[0], gap + 1])]
    end = at[np.concatenate([gap, [len(at) - 1]])] + length
    return list(zip(begin.tolist(), end.tolist(), strict=True))


MARK = "anchor long, d1 long, d2 long, begin int, end int"


def _indexed(groups: DataFrame) -> DataFrame:
    """Marked spans of each distinct context."""

    def flush(rows: list) -> pa.RecordBatch:
        out = []
        for (anchor, d1, d2, _), f in zip(rows, repeated_starts([r[3] for r in rows]), strict=True):
            out += [(anchor, d1, d2, a, b) for a, b in _runs(f, LENGTH)]
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["anchor", "d1", "d2", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        size, last = 0, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "d1", "d2", "own")), strict=True):
                if size >= INDEX_BYTES and row[0] != last:
                    yield flush(rows)
                    rows, size = [], 0
                rows.append(row)
                size += len(row[3])
                last = row[0]
        if rows:
            yield flush(rows)

    return groups.mapInArrow(run, MARK)


def _counted(groups: DataFrame) -> DataFrame:
    """The same for anchors with very many contexts: all strings around them, counted by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, d1, d2, own in zip(*(batch.column(c).to_pylist() for c in ("anchor", "d1", "d2", "own")), strict=True):
                n = len(own) - LENGTH + 1
                at = np.arange(n)
                raw = np.frombuffer(own, np.uint8)
                h, h2 = (span_hash(prefix(raw, v), at, at + LENGTH).view(np.int64) for v in (VALUES, SECOND))  # 128 bits name a string
                yield pa.RecordBatch.from_arrays([*(pa.array([x] * n, pa.int64()) for x in (anchor, d1, d2)), pa.array(at.astype(np.int32)), pa.array(h), pa.array(h2)], names=["anchor", "d1", "d2", "begin", "h", "h2"])

    each = groups.mapInArrow(run, "anchor long, d1 long, d2 long, begin int, h long, h2 long")
    many = materialise(each.groupBy("anchor", "h", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "counted")
    return each.join(many, ["anchor", "h", "h2"], "left_semi").select("anchor", "d1", "d2", "begin", (F.col("begin") + LENGTH).alias("end"))


def _cut(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables: all documents' sizes and digests, the texts that hold a repeated anchor, and the spans to remove."""
    # Rows are named by 128 bits of id and text, since ids may repeat; equal rows have equal results.
    named = docs.select(F.xxhash64("doc_id", "text").alias("r1"), F.xxhash64("text", "doc_id", F.lit(1)).alias("r2"), "doc_id", "text")
    name, context = ["r1", "r2"], ["anchor", "d1", "d2"]
    scanned = materialise(_anchor_rows(named), "anchors")
    places = scanned.select("r1", "r2", F.posexplode("anchors").alias("i", "anchor"))
    # written, so that the join deals both sides anew and a hot anchor's rows can be split
    shared = materialise(places.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "shared-anchors")
    hits = materialise(places.join(shared, "anchor", "left_semi").groupBy(*name).agg(F.collect_set("i").alias("hits")), "hits")
    held = materialise(named.select("r1", "r2", "text").join(hits, name).dropDuplicates(name), "held")
    drop_table(hits)
    contexts = materialise(_contexts(held), "contexts")
    # equal contexts are one; rows that are equal as a whole count by their copies
    copies = scanned.groupBy(*name).agg(F.count("*").alias("copies")).where("copies > 1")
    # one place of each context stands for it, so that a hot context's others need not meet
    pick = F.xxhash64(*name, "start")
    seen = contexts.select(*name, *context, "start").join(copies, name, "left").groupBy(*context).agg(F.sum(F.coalesce("copies", F.lit(1))).alias("n"), F.min(pick).alias("pick"))
    seen = materialise(seen, "context-counts")
    per = materialise(seen.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1"), "anchor-kinds")
    kinds = materialise(seen.join(per, "anchor").select(*context, "pick", "kinds"), "kinds")
    one = contexts.select(*context, pick.alias("pick"), "own").join(kinds, [*context, "pick"]).groupBy(*context, "kinds").agg(F.first("own").alias("own"))
    one = materialise(one, "distinct-contexts")
    few = one.where(F.col("kinds") <= MOST_CONTEXTS).select(*context, "own")
    marks = _indexed(few.repartition("anchor").sortWithinPartitions("anchor"))
    marks = materialise(marks.union(_counted(one.where(F.col("kinds") > MOST_CONTEXTS).select(*context, "own"))), "marks")
    drop_table(one)
    where = contexts.select(*name, *context, "start", F.octet_length("own").alias("size"))
    # a context that occurs again is repeated as a whole
    spans = where.join(seen.where("n > 1").select(*context), context, "left_semi").select(*name, F.col("start").alias("a"), (F.col("start") + F.col("size")).alias("b"))
    spans = spans.union(where.join(marks, context).select(*name, (F.col("start") + F.col("begin")).alias("a"), (F.col("start") + F.col("end")).alias("b")))
    return scanned, held, materialise(spans.groupBy(*name).agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans")), "spans")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed: one row for each document.

    ``removed`` lists the removed runs as start:end in bytes.
    """
    with scratch() as temporary:
        scanned, held, cut = _cut(docs)
        temporary.keep(scanned, held, cut)
    name = ["r1", "r2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            for text, spans in zip(batch.column("text"), batch.column("spans").to_pylist(), strict=True):
                data = (text.as_py() or "").encode()
                runs: list[list[int]] = []
                for s in spans:
                    if runs and s["a"] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], s["b"])
                    else:
                        runs.append([s["a"], s["b"]])
                keep, at = hashlib.sha256(), 0
                for a, b in runs:
                    keep.update(data[at:a])
                    at = b
                keep.update(data[at:])
                for c, v in zip(out, (sum(b - a for a, b in runs), len(runs), keep.hexdigest(), ",".join(f"{a}:{b}" for a, b in runs)), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in name), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[*name, "n_removed", "n_spans", "kept", "removed"])

    changed = held.select(*name, "text").join(cut, name).mapInArrow(run, "r1 long, r2 long, n_removed long, n_spans long, kept string, removed string")
    none = F.lit(0).cast("long")
    return scanned.select(*name, "doc_id", "n_bytes", "sha").join(changed, name, "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", none).alias("n_removed"),
        F.coalesce("n_spans", none).alias("n_spans"),
        F.coalesce("kept", "sha").alias("kept_sha256"),
        F.coalesce("removed", F.lit("")).alias("removed"),
    )
