"""Packing of token sequences into windows by minimum bin slack.

A document's ids are cut at multiples of the window; whole windows stand
alone. What remains of the documents is a multiset of lengths below the
window, at most ``window - 1`` distinct ones however large the corpus is, so
the plan is made from the histogram alone. For the largest length left, a
subset-sum dynamic programme over bitsets finds the multiset of remaining
lengths that comes closest to filling the window; the chosen counts are
backtracked and the pattern is used as often as the counts permit. Spark then
ranks the pieces of each length and looks up their place in the plan.

Nulls and edge cases: a null text is empty and gives the single end id; a
null id is kept as such; repeated rows are packed each by itself, an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, materialise, slices

WINDOW = 2048
END_ID = 1
#: Words kept in a worker's cache.
CACHE_WORDS = 600_000

PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


class WordTokenizer:
    """Ids of a lower-casing word BPE as little-endian uint32 bytes, through a cache of words.

    The tokenizer's patterns never cross white space, so each word has the same
    ids anywhere. Texts with other characters than Latin ones (where normal
    forms or Unicode versions could matter) go to the library as a whole.
    """

    PLAIN = regex.compile("[\t\n\r\x20-\x7e\xa1-ɏ]*+")
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def part(self, part: str) -> bytes:
        mapped = part.encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()

    def word(self, word: str) -> bytes:
        parts = self.parts
        out = b""
        for p in (word,) if word.isalpha() else self.SPLIT.findall(word):
            got = parts.get(p)
            if got is None:
                if len(parts) >= CACHE_WORDS:
                    parts.clear()
                got = parts[p] = self.part(p)
            out += got
        return out

    def __call__(self, text: str) -> bytes:
        if not self.PLAIN.fullmatch(text) or "<|" in text:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        words = self.words
        if len(words) >= CACHE_WORDS:
            words.clear()
        found = []
        for w in text.lower().split():
            got = words.get(w)
            if got is None:
                got = self.word(w)
                if len(w) < 64:
                    words[w] = got
            found.append(got)
        return b"".join(found)


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def token_pieces(docs: DataFrame, path: str, window: int = WINDOW) -> DataFrame:
    """Pieces of each document: at most ``window`` ids each, all but the last full."""
    bounded(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                total = len(ids) // 4
                for at in range(0, total, window):
                    own = ids[4 * at : 4 * (at + window)]
                    rows.append((doc, at, len(own) // 4, zlib.crc32(own), total))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PIECES, strict=True)], schema=PIECES)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def fill(counts: dict[int, int], window: int = WINDOW) -> dict[int, int]:
    """The multiset of lengths, the largest among them, that comes closest to the window."""
    first = max(counts)
    room = window - first
    use = {first: 1}
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == first), room // length)
        take = 1
        while left > 0 and not reach >> room & 1:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    goal = reach.bit_length() - 1
    for length, take, before in reversed(steps):
        if not before >> goal & 1:
            use[length] = use.get(length, 0) + take
            goal -= length * take
    return use


def plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, how many)]) patterns that use up all counts."""
    counts = {k: v for k, v in counts.items() if v}
    out = []
    while counts:
        use = fill(counts, window)
        times = min(counts[k] // n for k, n in use.items())
        out.append((times, sorted(use.items(), reverse=True)))
        for k, n in use.items():
            counts[k] -= times * n
            if not counts[k]:
                del counts[k]
    return out


def places(patterns: list, window: int = WINDOW) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length: (first rank, first sequence, how many a sequence, first offset)."""
    out: dict[int, list] = {}
    seen: dict[int, int] = {}
    sequence = 0
    for times, use in patterns:
        offset = 0
        for length, n in use:
            out.setdefault(length, []).append((seen.get(length, 0), sequence, n, offset))
            seen[length] = seen.get(length, 0) + times * n
            offset += n * length
        sequence += times
    return out


def pack(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """Add sequence_id and offset. The plan's size is bounded by the window, not by the rows."""
    pieces = materialise(pieces, "pieces")
    spark = pieces.sparkSession
    # Ranks within a length: buckets split a length that many pieces share.
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    # A row for each length and bucket; their running sums are ranks' bases.
    per = materialise(keyed.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    totals = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    where = places(plan(totals, window), window)
    from pyspark.sql import Window as W

    base = per.withColumn("base", F.sum("n").over(W.partitionBy("length").orderBy("bucket")) - F.col("n")).select("length", "bucket", "base")
    rank = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")) - 1
    # merged on the ranking's own partitioning: no further shuffle, nothing broadcast
    ranked = keyed.withColumn("k", rank).join(base.hint("merge"), ["length", "bucket"])
    starts = {k: [p[0] for p in v] for k, v in where.items()}

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, k, start_of = (batch.column(c).to_pylist() for c in ("length", "k", "base"))
            seq, off = [], []
            for n, r, b in zip(length, k, start_of, strict=True):
                r += b
                i = bisect_right(starts[n], r) - 1
                first, sequence, many, offset = where[n][i]
                seq.append(sequence + (r - first) // many)
                off.append(offset + (r - first) % many * n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in PIECES.names), pa.array(seq, pa.int64()), pa.array(off, pa.int64())], names=[*PIECES.names, "sequence_id", "offset"])

    schema = T.StructType([T.StructField(c, T.LongType()) for c in (*PIECES.names, "sequence_id", "offset")])
    return ranked.mapInArrow(put, schema)
