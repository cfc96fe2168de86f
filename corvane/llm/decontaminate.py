"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edits.

A benchmark item of m words is sought in windows of m words at every word of
a document; a match has at most ``m * EDITS`` edits. Each edit spoils at most
two of the item's m - 1 word pairs within the window that starts where the
match does, so windows that share fewer distinct pairs with an item than must
be left can't start a match and need no walk (this loses nothing). The others
and the items go through WALKS random walks: a walk puts out the word at its
place and moves on or not by a random bit of that word, so sequences a few
edits apart fall into step again and agree in most outputs. One or two sampled
outputs of a walk are its key. Windows are looked up by their keys among the
items'; around a window and an item that meet, the edit distance over words
decides at every window that the pair bound leaves.

Measured at the limit of edits, spread over the whole item or clustered,
substituted, inserted and deleted: a walk and some window near the match share
a key with probability 0.086 at least up to 60 words (two outputs), 0.12 up to
480 (one output; deletions are the worst), so 64 walks miss 0.003 at most;
tests ask for 0.95 at least from 5 to 500 words and mostly find all.

Words are runs of letters, digits and non-ASCII characters in lower case.

Nulls and edge cases: null or wordless texts and items match nothing, nor do
items of fewer than LEAST_WORDS words, which are no evidence of a leak; a null
doc_id or item_id is kept as such; repeated rows are judged each by itself;
items of equal text match separately; an empty table gives an empty result;
other columns are ignored. Of several places the one of fewest edits, then
the first, is given.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import U, VALUES, constants, mix, prefix, span_hash, text_bytes, words
from .common import bounded, slices

#: Share of an item's words that may be edited.
EDITS = 0.25
LEAST_WORDS = 5
#: Walks (64 at most, a bit of a hash for each); a walk has STEPS steps for each word of the item.
WALKS, STEPS = 64, 2
#: Outputs sampled of a walk: PLACES for items of at most SHORT words. Edits that are spread out put walks out of step for
#: longer in longer items, which one output has to make up for.
PLACES, SHORT = 2, 60
#: Cells (window, pair, item) counted at once; bounds a worker's memory.
CELLS = 1 << 20
#: Bytes of documents searched at once: several slices, as sizes are gone through one by one.
PIECE_BYTES = 2 << 20
#: Bytes of items searched at once; more take further passes over the documents.
ITEM_BYTES = 4 << 20

#: All bytes but letters, digits and those of non-ASCII characters part words.
APART = np.ones(256, bool)
APART[48:58] = APART[65:91] = APART[97:123] = APART[128:] = False


def folded(raw: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and the Latin-1 letters."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    out = fold[raw]
    if len(out) > 1:
        tail = out[1:]
        big = (out[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)
        tail[big] += 32
    return out


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, starts, ends, first word of each row plus the total)."""
    raw = folded(raw)
    starts, ends, first = words(raw, offsets, APART)
    return span_hash(prefix(raw, VALUES), starts, ends), starts, ends, first


def pair_hashes(hashes: np.ndarray) -> np.ndarray:
    a, b = constants(2, 31)
    return mix(hashes[:-1] * a + hashes[1:] * b)


def allowed(m: int) -> int:
    return int(m * EDITS)


def least_pairs(m: int) -> int:
    """Word pairs that survive any allowed edits."""
    return max(1, m - 1 - 2 * allowed(m))


def places_of(m: int) -> int:
    return PLACES if m <= SHORT else 1


def edit_distances(items: np.ndarray, texts: np.ndarray, lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """By row, least edits turning the item into a prefix of its text of a length, and the shortest such prefix's
    length; most + 1 and 0 if more. The texts have ``most`` words more than the items, as far as they reach."""
    n, m = items.shape
    band = np.arange(2 * most + 1)  # at item word i, prefixes of i - most + band words
    big = 1 << 20
    edits, used = np.full(n, most + 1), np.zeros(n, np.int64)
    left = np.arange(n)
    text = np.concatenate([np.zeros((n, most), U), texts], axis=1)
    row = np.tile(np.where(band >= most, band - most, big).astype(np.int32), (n, 1))
    for i in range(1, m + 1):
        new = row + (text[:, i - 1 : i + 2 * most] != items[:, i - 1 : i])
        if most:
            np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
            new[:, : max(0, most - i + 1)] = big
            if i <= most:
                new[:, most - i] = i
        row = np.minimum.accumulate(new - band, axis=1) + band
        if i % 8 == 0:
            on = np.flatnonzero(row.min(axis=1) <= most)
            if len(on) < len(left):
                left, text, items, row = left[on], text[on], items[on], row[on]
    row = np.where(m - most + band <= lengths[left][:, None], row, big)
    at = row.argmin(axis=1) if len(row) else np.zeros(0, np.int64)
    least = row[np.arange(len(row)), at]
    good = least <= most
    edits[left[good]], used[left[good]] = least[good], m - most + at[good]
    return edits, used


def walk_keys(x: np.ndarray) -> np.ndarray:
    """Keys of CGK walks over sequences of the shape (rows, m): (rows, WALKS), 0 where a walk ran out of words.

    All sequences of m words take the same walks, and keys of different walks differ; a zero is no word.
    """
    n, m = x.shape
    steps, outputs = STEPS * m, places_of(m)
    places = np.sort(np.random.Generator(np.random.PCG64(62)).integers(0, steps, (WALKS, outputs)), axis=1)
    factors = constants(outputs, 63)
    shifts = np.arange(WALKS, dtype=U)
    words_, which = np.unique(np.concatenate([x, np.zeros((n, 1), U)], axis=1), return_inverse=True)
    which = which.reshape(n, m + 1)
    at = np.repeat(np.arange(n)[:, None] * (m + 1), WALKS, axis=1)
    key, out_of = np.zeros((n, WALKS), U), np.zeros((n, WALKS), bool)
    for t, seed in enumerate(constants(steps, 61)):
        for j in range(outputs):
            here = np.flatnonzero(places[:, j] == t)
            if len(here):
                word = words_[which.ravel()[at[:, here]]]
                key[:, here] += word * factors[j]
                out_of[:, here] |= word == 0
        # one hash of a word has a bit for each walk; none moves on from the end
        bits = mix(words_ ^ seed)[which]
        bits[:, m] = 0
        at += (bits.ravel()[at] >> shifts & U(1)).view(np.int64)
    key = mix(key + constants(WALKS, 64)) | U(1)
    key[out_of] = 0
    return key


def _within(code: np.ndarray, found: np.ndarray, reach: int) -> np.ndarray:
    """Which codes are at most ``reach`` from one found."""
    if not len(found):
        return np.zeros(len(code), bool)
    found = np.sort(found)
    i = np.searchsorted(found, code)
    return np.minimum(np.abs(found[np.minimum(i, len(found) - 1)] - code), np.abs(code - found[np.maximum(i - 1, 0)])) <= reach


class Items:
    """Hashed benchmark items with their pairs by size."""

    def __init__(self, rows: list[tuple[int, str]]):
        raw, offsets = text_bytes(pa.array([t for _, t in rows], pa.string()))
        hashes, _, _, first = tokens(raw, offsets)
        self.ids = [i for i, _ in rows]
        self.sequences = [hashes[first[i] : first[i + 1]] for i in range(len(rows))]
        self.by_size: dict[int, list[int]] = defaultdict(list)
        for i, s in enumerate(self.sequences):
            if len(s) >= LEAST_WORDS:
                self.by_size[len(s)].append(i)
        #: By size: sorted pairs, each once for every item that has it, and the items' places in by_size.
        self.pairs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.need: dict[int, np.ndarray] = {}
        for m, own in self.by_size.items():
            each = [np.unique(pair_hashes(self.sequences[i])) for i in own]
            pairs, owners = np.concatenate(each), np.repeat(np.arange(len(own)), [len(x) for x in each])
            order = np.argsort(pairs, kind="stable")
            self.pairs[m] = pairs[order], owners[order]
            # distinct pairs that allowed edits leave, by item
            self.need[m] = np.array([max(1, least_pairs(m) - (m - 1 - len(x))) for x in each])
        self.all_pairs = np.unique(np.concatenate([*(p for p, _ in self.pairs.values()), np.zeros(0, U)]))
        self.quick = np.zeros(1 << 22, bool)
        self.quick[(self.all_pairs & U((1 << 22) - 1)).astype(np.int64)] = True
        #: By size: sorted keys of the items' walks, and the items' places in by_size.
        self.keys: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m, own in self.by_size.items():
            keys = np.concatenate([walk_keys(np.stack([self.sequences[i] for i in own[k : k + CELLS // WALKS]])) for k in range(0, len(own), CELLS // WALKS)])
            order = np.argsort(keys, axis=None, kind="stable")
            self.keys[m] = keys.ravel()[order], order // WALKS
        #: Size classes: windows of the largest size in one must have the fewest pairs that any of them needs.
        self.classes: list[list[int]] = []
        for m in sorted(self.by_size):
            if self.classes and m <= 1.3 * self.classes[-1][0]:
                self.classes[-1].append(m)
            else:
                self.classes.append([m])

    def owners_of(self, m: int, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the owners of each pair begin among those of all pairs of the size, and how many they are."""
        known, _ = self.pairs[m]
        low = np.searchsorted(known, pairs, "left")
        return low, np.searchsorted(known, pairs, "right") - low

    def sharing(self, m: int, low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of each window whose pairs leave a match possible; a window's pairs are a row of :meth:`owners_of`."""
        _, owners = self.pairs[m]
        own, need = self.by_size[m], self.need[m]
        able = np.flatnonzero((count > 0).sum(axis=1) >= need.min())
        found = [(np.zeros(0, np.int64),) * 2]
        step = max(1, CELLS // (m * len(own)))
        for begin in range(0, len(able), step):
            some = able[begin : begin + step]
            start, span = low[some].ravel(), count[some].ravel()
            met = np.repeat(start - np.cumsum(span) + span, span) + np.arange(span.sum())
            window = np.repeat(np.arange(len(some) * (m - 1)) // (m - 1), span)
            shared = np.bincount(window * len(own) + owners[met], minlength=len(some) * len(own))
            cells = np.flatnonzero(shared.reshape(-1, len(own)) >= need)
            found.append((some[cells // len(own)], np.array(own)[cells % len(own)]))
        window, item = (np.concatenate(x) for x in zip(*found, strict=True))
        return window, item

    def candidates(self, m: int, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place in by_size) of windows (rows of words) and items that have a key in common: windows' keys are looked up among the items'."""
        known, owners = self.keys[m]
        step = CELLS // WALKS
        found = [(np.zeros(0, np.int64),) * 2]
        for begin in range(0, len(windows), step):
            keys = walk_keys(windows[begin : begin + step])
            cells = np.flatnonzero(keys.ravel() != 0)
            asked = keys.ravel()[cells]
            low = np.searchsorted(known, asked, "left")
            span = np.searchsorted(known, asked, "right") - low
            met = np.repeat(low - np.cumsum(span) + span, span) + np.arange(span.sum())
            code = np.unique((begin + np.repeat(cells // WALKS, span)) * len(self.by_size[m]) + owners[met])
            found.append((code // len(self.by_size[m]), code % len(self.by_size[m])))
        window, mine = (np.concatenate(x) for x in zip(*found, strict=True))
        return window, mine

    def hits(self, pairs: np.ndarray) -> np.ndarray:
        """Which of the hashes are word pairs of an item."""
        maybe = np.flatnonzero(self.quick[(pairs & U((1 << 22) - 1)).astype(np.int64)])
        out = np.zeros(len(pairs), bool)
        if len(maybe) and len(self.all_pairs):
            at = np.minimum(np.searchsorted(self.all_pairs, pairs[maybe]), len(self.all_pairs) - 1)
            out[maybe[self.all_pairs[at] == pairs[maybe]]] = True
        return out

    def found_at(self, m: int, at: np.ndarray, hashes: np.ndarray, owned: tuple[np.ndarray, np.ndarray, np.ndarray], row_of: np.ndarray, stop_of: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, edits, first word, words) of each match of an item of m words that starts at one of the places."""
        n = len(hashes)
        length = np.minimum(m, stop_of[row_of[at]] - at)
        index = np.minimum(at[:, None] + np.arange(m)[None, :], n - 1)
        inside = np.arange(m)[None, :] < length[:, None]
        low, count, before = owned
        first = index[:, :-1]  # a pair counts once in a window
        which, item_of = self.sharing(m, low[first], count[first] * (inside[:, 1:] & (before[first] < at[:, None])))
        if not len(which):
            return
        wanted = self.by_size[m]
        sequences = np.stack([self.sequences[i] for i in wanted])
        # a window that equals an item has all keys in common with it, and no place of that item in the row is better
        pair_of = row_of[at[which]] * len(self.ids) + item_of
        full = np.flatnonzero((length[which] == m) & (hashes[at[which]] == sequences[np.searchsorted(wanted, item_of), 0]))
        same = full[(hashes[index[which[full]]] == sequences[np.searchsorted(wanted, item_of[full])]).all(axis=1)]
        for i in same.tolist():
            yield int(row_of[at[which[i]]]), int(item_of[i]), 0, int(at[which[i]]), m
        left = np.flatnonzero(~np.isin(pair_of, pair_of[same]))
        if not len(left):
            return
        # the windows left are looked up by their keys; around a window and an item that meet, edits decide
        walked, which = np.unique(which[left], return_inverse=True)
        at, item_of = at[walked], item_of[left]
        window, mine = self.candidates(m, np.where(inside[walked], hashes[index[walked]], U(0)))
        apart = int(at.max()) + 2 * m + 1  # places of one item are apart from those of the next
        near_key = _within(np.searchsorted(wanted, item_of) * apart + at[which], mine * apart + at[window], allowed(m))
        which, item_of = which[near_key], item_of[near_key]
        reach = m + allowed(m)
        step = max(1, CELLS // (8 * reach))
        for part in range(0, len(which), step):
            begins, owners = at[which[part : part + step]], item_of[part : part + step]
            text = hashes[np.minimum(begins[:, None] + np.arange(reach), n - 1)]
            edits, used = edit_distances(sequences[np.searchsorted(wanted, owners)], text, stop_of[row_of[begins]] - begins, allowed(m))
            for i in np.flatnonzero(used).tolist():
                yield int(row_of[begins[i]]), int(owners[i]), int(edits[i]), int(begins[i]), int(used[i])

    def find(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first byte, end byte, edits) of each item found in a row."""
        hashes, starts, ends, first = tokens(raw, offsets)
        n = len(hashes)
        if n < 2 or not self.classes:
            return []
        pairs = pair_hashes(hashes)
        hit = self.hits(pairs)
        inner = first[(first > 0) & (first < n)]
        hit[inner - 1] = False  # pairs across rows
        held = np.flatnonzero(hit)
        # the place of the same pair before each
        before = np.full(n, -1, np.int64)
        order = held[np.argsort(pairs[held], kind="stable")]
        again = np.flatnonzero(pairs[order[1:]] == pairs[order[:-1]])
        before[order[again + 1]] = order[again]
        total = np.zeros(n + 1, np.int32)
        np.cumsum(hit, out=total[1:n])
        total[n] = total[n - 1]
        row_of = stop_of = None
        best: dict[tuple[int, int], list[int]] = {}
        for sizes in self.classes:
            high = min(sizes[-1], n)
            need = min(least_pairs(m) for m in sizes)
            near = np.flatnonzero(total[np.minimum(np.arange(n) + high - 1, n)] - total[:n] >= need) if high < n else np.flatnonzero(total[n] - total[:n] >= need)
            if not len(near):
                continue
            if row_of is None:
                row_of = np.repeat(np.arange(len(first) - 1), np.diff(first))
                stop_of = first[1:]
            for m in sizes:
                low, count = np.zeros(n, np.int64), np.zeros(n, np.int32)
                low[held], count[held] = self.owners_of(m, pairs[held])
                length = np.minimum(m, stop_of[row_of[near]] - near)
                places = near[length >= m - allowed(m)]
                # in parts, with the places in reach of each part
                for begin in range(0, len(places), max(1, CELLS // m)):
                    core = places[begin : begin + max(1, CELLS // m)]
                    at = places[np.searchsorted(places, core[0] - allowed(m)) : np.searchsorted(places, core[-1] + allowed(m), "right")]
                    for row, item, *new in self.found_at(m, at, hashes, (low, count, before), row_of, stop_of):
                        if (row, item) not in best or new[:2] < best[row, item][:2]:
                            best[row, item] = new
        return [(row, item, int(starts[b] - offsets[row]), int(ends[b + used - 1] - offsets[row]), edits) for (row, item), (edits, b, used) in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, first_byte, end_byte, edits: the best place of each item in each document."""
    bounded(docs.sparkSession)
    spark = docs.sparkSession
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // ITEM_BYTES))
    schema = "doc_id long, item_id long, first_byte long, end_byte long, edits int"
    out = None
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        rows = sorted(((r["item_id"], r["text"]) for r in part.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
        shared = spark.sparkContext.broadcast(rows)  # at most about ITEM_BYTES

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = None
            for batch in slices(batches, limit=PIECE_BYTES):
                known = known or Items(shared.value)
                doc = batch.column("doc_id").to_pylist()
                found = [(doc[row], known.ids[item], a, b, edits) for row, item, a, b, edits in known.find(*text_bytes(batch.column("text")))]
                if found:
                    cols = list(zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.int32())], names=["doc_id", "item_id", "first_byte", "end_byte", "edits"])

        found = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out
