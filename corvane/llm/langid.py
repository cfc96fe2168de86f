"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built of a bounded sample of labelled
text. A document is parsed against each automaton into longest matches; the
language that needs the fewest normalised phrases wins: per byte of the text,
and times the bits that name a place in the language's sample, as matches grow
with a sample. Segments of many texts run in step, one vector operation per
position, and then again from the state that the segment before leaves, until
they meet the first run: the phrases are those of one parse of the whole text.

Nulls and edge cases: a null text, an empty one, or one without any letter is
``und`` with score 0; a null doc_id is kept and is not held out; rows whose
lang is null are predicted but never learned from; ties go to the language
that sorts first; repeated rows give repeated results, and count once in a
sample; without any labelled text all is ``und``; other columns are ignored.
Whole texts are parsed, PIECE bytes at once, and learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import text_bytes
from .common import bounded, slices

#: Bytes of a segment, of which many run in step, and of texts that are handled at once.
SEGMENT, PIECE = 256, 1 << 20
#: Labelled documents per language, and bytes of them all, at most; only documents of up to SAMPLE_DOC_BYTES are
#: learned from, always as a whole, unless a language has none so short: then its shortest one is.
SAMPLE_DOCS, SAMPLE_BYTES, SAMPLE_DOC_BYTES = 64, 24_000, 4096
UNKNOWN = "und"
LETTER = r"\p{L}"


def normal(raw: np.ndarray) -> np.ndarray:
    """Lower case for a-z and the Latin-1 letters; all but letters read as a space."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    fold[:65] = 32
    fold[91:97] = 32
    fold[123:128] = 32
    out = fold[raw]
    if len(out) > 1:
        tail = out[1:]
        big = (out[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)
        tail[big] += 32
    return out


class Automaton:
    """Suffix automaton as a dense table: table[state * width + class] is the next state, 0 for none."""

    def __init__(self, sample: np.ndarray, classes: np.ndarray, width: int):
        self.width = width
        moves: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in classes[sample].tolist():
            new = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(moves)
                    moves.append(dict(moves[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        n = len(moves)
        table = np.zeros((n + 1, width), np.int32)
        for state, own in enumerate(moves):
            if own:
                table[state, list(own)] = list(own.values())
        # Class 0 pads a segment: its state is a sink without further phrases.
        table[:, 0] = n
        table[n, :] = n
        self.table = (table * width).ravel()

    def phrases(self, steps: np.ndarray, joined: np.ndarray, state: int, last: int) -> tuple[np.ndarray, int]:
        """How often a phrase ends in each segment of a parse that runs on from one to the next, and the last state.

        ``steps`` has a row for each position and a column for each segment;
        ``joined`` tells which segments go on where the one before ends, and
        ``state`` is where the first one begins; the last has ``last``
        positions, of which the others are padding. All segments run from the
        root at once; those that go on are then run from the state they
        inherit until they meet the run before, which takes a phrase or so.
        """
        table, n = self.table, steps.shape[1]
        begin = np.zeros(n, np.int32)
        begin[0] = state
        path = np.empty(steps.shape, np.int32)
        count = np.zeros(n, np.int32)
        at = begin
        for t, c in enumerate(steps):
            new = table[at + c]
            ended = np.flatnonzero(new == 0)
            if len(ended):
                count[ended] += 1
                new[ended] = table[c[ended]]
            path[t] = at = new
        todo = np.flatnonzero(joined)
        while len(todo):
            inherits = path[-1, todo - 1]
            todo, inherits = todo[inherits != begin[todo]], inherits[inherits != begin[todo]]
            run, at, before = todo, inherits, begin[todo]
            begin[todo] = inherits
            for t in range(len(steps)):
                if not len(run):
                    break
                c, old = steps[t, run], path[t, run]
                new = table[at + c]
                ended = new == 0
                new[ended] = table[c[ended]]
                count[run] += ended.astype(np.int32) - (table[before + c] == 0)
                path[t, run] = new
                on = new != old
                run, at, before = run[on], new[on], old[on]
            # of what ran to its end, the segment after inherits another state
            todo = run[run + 1 < n] + 1
            todo = todo[joined[todo]]
        return count, int(path[last - 1, -1])


class LanguageModel:
    """Automata by language; samples is {language: bytes}."""

    def __init__(self, samples: dict[str, bytes]):
        self.languages = sorted(samples)
        plain = [normal(np.frombuffer(samples[x], np.uint8)) for x in self.languages]
        seen = np.unique(np.concatenate([*plain, np.zeros(0, np.uint8)]))
        classes = np.ones(256, np.int32)  # 0 pads, 1 was never seen
        classes[seen] = np.arange(2, len(seen) + 2)
        self.classes = classes
        self.automata = [Automaton(s, classes, len(seen) + 2) for s in plain]
        #: Bits that name a place in each sample.
        self.bits = np.log2([len(s) + 1.0 for s in plain])

    def rates(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases per byte, a row for each text and a column for each language; PIECE bytes at once."""
        sizes = np.diff(offsets)
        total = np.zeros((len(sizes), len(self.automata)))
        state = [0] * len(self.automata)
        for low in range(0, len(raw), PIECE):
            high = min(low + PIECE, len(raw))
            # a letter of two bytes may begin before the piece
            coded = np.append(self.classes[normal(raw[max(low - 1, 0) : high])[low > 0 :]], 0)
            rows = np.arange(np.searchsorted(offsets, low, "right") - 1, np.searchsorted(offsets, high, "left"))
            rows = rows[sizes[rows] > 0]
            starts, stops = np.maximum(offsets[:-1][rows], low) - low, np.minimum(offsets[1:][rows], high) - low
            pieces = -(-(stops - starts) // SEGMENT)
            owner = np.repeat(np.arange(len(rows)), pieces)
            nth = np.arange(len(owner)) - (np.cumsum(pieces) - pieces)[owner]
            begin = starts[owner] + nth * SEGMENT
            at = begin[None, :] + np.arange(SEGMENT)[:, None]
            at[at >= np.minimum(begin + SEGMENT, stops[owner])[None, :]] = high - low
            steps = coded[at]
            goes_on = offsets[:-1][rows[0]] < low
            for i, a in enumerate(self.automata):
                count, state[i] = a.phrases(steps, nth > 0, state[i] if goes_on else 0, int(stops[-1] - begin[-1]))
                total[:, i] += np.bincount(rows[owner], count, len(sizes))
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(sizes[:, None] > 0, (total + 1) / sizes[:, None], np.inf)

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and phrases per byte of the language predicted."""
        n = len(column)
        if not self.automata:
            return [UNKNOWN] * n, np.zeros(n), np.full(n, np.inf)
        rates = self.rates(*text_bytes(column))
        letters = pc.fill_null(pc.match_substring_regex(column, LETTER), False).to_numpy(zero_copy_only=False)
        cost = rates * self.bits
        order = np.argsort(cost, axis=1, kind="stable")
        rows = np.arange(n)
        best = cost[rows, order[:, 0]]
        next_ = cost[rows, order[:, 1]] if len(self.automata) > 1 else np.full(n, np.inf)
        with np.errstate(invalid="ignore"):
            score = np.where(letters, 1 - best / (best + next_), 0.0) if len(self.automata) > 1 else letters.astype(float)
        return [self.languages[order[i, 0]] if letters[i] else UNKNOWN for i in range(n)], np.nan_to_num(score), rates[rows, order[:, 0]]


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_samples(docs: DataFrame) -> dict[str, bytes]:
    """Bounded labelled text per language from documents that are not held out.

    Of each language, the document of least hash in each of SAMPLE_DOCS hash
    buckets, in the order of hashes as far as whole documents fit; the bounds
    are the constants above.
    """
    size, h = F.octet_length("text"), F.xxhash64("doc_id", "text")
    train = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (size > 0))
    short = F.when(size <= SAMPLE_DOC_BYTES, 0).otherwise(size)
    bucket = F.when(size <= SAMPLE_DOC_BYTES, F.pmod(h, F.lit(SAMPLE_DOCS))).otherwise(SAMPLE_DOCS)
    # names first: texts are fetched for the chosen ones only
    picks = train.groupBy("lang", bucket.alias("b")).agg(F.min(F.struct(short.alias("size"), h.alias("h"))).alias("m"))
    chosen: dict[str, set[int]] = {}
    for r in sorted(picks.collect(), key=lambda r: r["b"]):
        if r["b"] < SAMPLE_DOCS or r["lang"] not in chosen:
            chosen.setdefault(r["lang"], set()).add(r["m"]["h"])
    names = {x for own in chosen.values() for x in own}
    rows = train.where(h.isin(sorted(names))).select("lang", h.alias("h"), F.encode("text", "UTF-8").alias("t")).distinct().collect()
    out: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["h"], bytes(r["t"]))):
        if r["h"] in chosen[r["lang"]]:
            have = out.get(r["lang"], b"")
            if not have or len(have) + len(r["t"]) < SAMPLE_BYTES:
                out[r["lang"]] = have + bytes(r["t"]) + b" "
    return out


_models: dict[int, tuple[dict, LanguageModel]] = {}


def model_of(samples: dict[str, bytes]) -> LanguageModel:
    """The model of these samples, built once in each worker."""
    key = hash(tuple(sorted(samples.items())))
    if key not in _models:
        _models.clear()
        _models[key] = (samples, LanguageModel(samples))
    return _models[key][1]


def identify(docs: DataFrame, samples: dict[str, bytes]) -> DataFrame:
    """doc_id, held_out, lang_pred, score, phrase_rate."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(samples)  # of a bounded size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in slices(batches):
            model = model or model_of(shared.value)
            langs, score, rate = model.predict(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(np.where(np.isfinite(rate), rate, 1.0), pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score", "phrase_rate"],
            )

    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, phrase_rate double")
