"""Secret scan: pattern rules, and character Markov models compared by likelihood.

The rules find assignments, access keys and hexadecimal digests. The method
adds every long run of key characters that Markov models of random strings
explain better than the model of ordinary identifiers does: the log-likelihood
ratio per character must pass a threshold. All models are trained from
labelled strings (see :func:`labelled_samples`).

Nulls and edge cases: a null text is empty and has no spans; a null doc_id is
kept; repeated rows give repeated results, an empty table an empty result;
whole texts are scanned, however long; other columns are ignored. Offsets are
code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, slices

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Runs that the Markov models judge.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
KEYWORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "markov")

ALPHABETS = {
    "hex": "0123456789abcdef",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
SYMBOLS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Documents from which ordinary words are taken, words taken at most, random strings per alphabet.
SAMPLE_DOCS, SAMPLE_WORDS, SAMPLE_RANDOM = 400, 20_000, 1500
WORD = r"(?<!\S)[A-Za-z]{2,19}(?=[.,;:!?]?(?!\S))"
#: Nats per character by which the random model must lead.
MIN_RATIO = 0.35


class Markov:
    """First-order character chain with additive smoothing."""

    def __init__(self, samples: Iterable[str], smooth: float = 0.05):
        self.index = {c: i for i, c in enumerate(SYMBOLS)}
        n = len(SYMBOLS)
        counts = np.full((n + 1, n), smooth)  # row n: the first character
        for s in samples:
            before = n
            for c in s:
                now = self.index.get(c)
                if now is not None:
                    counts[before, now] += 1
                    before = now
        self.logs = np.log(counts / counts.sum(axis=1, keepdims=True)).tolist()

    def log_likelihood(self, s: str) -> float:
        before, total = len(SYMBOLS), 0.0
        for c in s:
            now = self.index[c]
            total += self.logs[before][now]
            before = now
        return total


def apart(runs: Iterable[tuple[int, int]], spans: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What the spans leave of the runs; the runs are in order and don't overlap. One pass over either."""
    left = iter(sorted(spans))
    span = next(left, None)
    cover = 0  # end of the spans seen so far
    for begin, end in runs:
        while begin < end:
            begin = max(begin, cover)
            if span is not None and span[0] <= begin:
                cover = max(cover, span[1])
                span = next(left, None)
                continue
            stop = end if span is None else min(end, span[0])
            if begin < stop:
                yield begin, stop
            begin = max(begin, stop)


class SecretModel:
    """Models of random strings by kind against one of ordinary identifiers."""

    def __init__(self, labelled: Iterable[tuple[str, str]], min_ratio: float = MIN_RATIO):
        by: dict[str, list[str]] = {}
        for text, label in labelled:
            by.setdefault(label, []).append(text)
        self.ordinary = Markov(by.pop("ordinary", []))
        self.random = [Markov(v) for _, v in sorted(by.items())]
        self.min_ratio = min_ratio

    def ratio(self, s: str) -> float:
        """Log-likelihood ratio per character, random against ordinary."""
        return (max(m.log_likelihood(s) for m in self.random) - self.ordinary.log_likelihood(s)) / len(s)

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All spans, by start and then by kind."""
        found = []
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        runs = list(RUN.finditer(text))
        if runs:
            found += [("access", *m.span()) for m in ACCESS.finditer(text)]
            found += [("hex", *m.span()) for m in HEX.finditer(text)]
            for a, b in apart([m.span() for m in runs], [(a, b) for _, a, b in found]):
                if RUN.fullmatch(text, a, b) and self.ratio(text[a:b]) >= self.min_ratio:
                    found.append(("markov", a, b))
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def labelled_samples(docs: DataFrame, seed: int = 7) -> list[tuple[str, str]]:
    """Labelled strings: seeded random ones by alphabet, and ordinary identifiers.

    Ordinary identifiers are words of at most SAMPLE_DOCS documents (the one
    of least hash in each of as many hash buckets), alone and joined as
    identifiers are; at most SAMPLE_WORDS words are used. Only what stands
    between blanks and is all letters is a word, so pieces of secrets are none.
    """
    rng = random.Random(seed)
    out = [("".join(rng.choices(letters, k=rng.randint(20, 44))), kind) for kind, letters in ALPHABETS.items() for _ in range(SAMPLE_RANDOM)]
    h = F.xxhash64("doc_id")
    picks = docs.where("doc_id is not null").groupBy(F.pmod(h, F.lit(SAMPLE_DOCS)).alias("b")).agg(F.min(F.struct(h.alias("h"), "doc_id")).alias("m"))
    ids = [r["id"] for r in picks.select(F.col("m.doc_id").alias("id")).collect()]
    words = [
        r["w"]
        for r in docs.where(F.col("doc_id").isin(ids))
        .select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))).alias("w"))
        .distinct()
        .orderBy(F.xxhash64("w"), "w")
        .limit(SAMPLE_WORDS)
        .collect()
    ]
    words = words or ["the", "index", "value", "name", "count", "request", "handler", "default"]
    out += [(w, "ordinary") for w in words]
    for _ in range(len(words) // 2):
        some = rng.choices(words, k=rng.randint(2, 4))
        if rng.random() < 0.3:
            some.append(str(rng.randint(0, 9999)))
        joined = rng.choice("_-/") .join(some)
        out.append((rng.choice((joined, joined.lower(), joined.upper(), "".join(w.capitalize() for w in some))), "ordinary"))
    return out


def scan(docs: DataFrame, model: SecretModel) -> DataFrame:
    """doc_id, counts by kind, digest of the rules' spans, all spans."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.spans
        for batch in slices(batches):
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column(1):
                spans = find(text.as_py() or "")
                kinds = [k for k, _, _ in spans]
                for i, k in enumerate(KINDS):
                    cols[i].append(kinds.count(k))
                base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans if k != "markov")
                cols[4].append(hashlib.sha256(base.encode()).hexdigest())
                cols[5].append(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
            n_assign, n_access, n_hex, n_markov = (pa.array(c, pa.int64()) for c in cols[:4])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_assign, n_access, n_hex, pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), n_markov],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")


def mask(text: str, spans: list[tuple[str, int, int]], put: str = "[secret]") -> str:
    """The text with each maximal run of spans replaced."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], put]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: SecretModel, put: str = "[secret]") -> DataFrame:
    """The documents with secrets replaced, n_chars following; all rows and columns stay."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = shared.value.spans
        for batch in slices(batches):
            names = batch.schema.names
            texts = [None if t is None else mask(t, find(t), put) for t in batch.column("text").to_pylist()]
            out = batch.set_column(names.index("text"), "text", pa.array(texts, pa.string()))
            if "n_chars" in names:
                sizes = pa.array([n if t is None else len(t) for t, n in zip(texts, batch.column("n_chars").to_pylist(), strict=True)], pa.int64())
                out = out.set_column(names.index("n_chars"), "n_chars", sizes)
            yield out

    return docs.mapInArrow(run, docs.schema)
