"""Quality scores by co-training on text content and page metadata.

Two logistic regressions see different views of a document: its content
(words it holds, shares of kinds of characters) and its metadata (source,
language, size). In each round either view labels the unlabelled documents it
is surest of for the other. Each view is then calibrated on labelled
documents kept apart, and both are combined into one probability. This is
done for two labels, quality and toxicity; a document's score is the
probability that it is good and not toxic.

Models are fitted on bounded samples (LABELLED and UNLABELLED documents); all
documents are scored on their whole texts.

Nulls and edge cases: a null or empty text has empty content; null metadata
is a value of its own; labels that are null count for nothing, of several for
one doc_id the least holds; without labels, or with one class only, the
share of that class (or 1/2) is the probability; a null doc_id is scored too;
repeated rows give repeated results; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import U, text_bytes
from .common import bounded, materialise, only, slices
from .decontaminate import tokens

#: Documents in the samples at most.
LABELLED, UNLABELLED = 4000, 4000
#: Words kept as features, and labelled documents that must hold one.
VOCABULARY, LEAST_DOCS = 1500, 6
#: Rounds of co-training, pseudo-labels a view gives per round (by the classes' shares), and how sure it must be:
#: a view that tells nothing has every document at its class's share, so the odds must also rise by LIFT.
ROUNDS, GIVEN, SURE, LIFT = 4, 300, 0.8, 3.0
#: Least chi-square of a word with a label.
TELLING = 25
METADATA = 1 << 12

#: Kinds of bytes whose shares are features.
KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": b" \t", "line": b"\n", "stop": b".,;:", "shout": b"!?", "mark": b"|$%&*#@^~<>{}[]=_+\\/", "high": range(128, 256)}


def content(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Dense features of each text, and its distinct word hashes."""
    size = np.diff(offsets)
    columns = [np.log1p(size)]
    for members in KINDS.values():
        table = np.zeros(256, np.int64)
        table[list(members)] = 1
        sums = np.concatenate([[0], np.cumsum(table[raw])])
        columns.append((sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(size, 1))
    hashes, starts, ends, first = tokens(raw, offsets)
    count = np.diff(first)
    lengths = np.concatenate([[0], np.cumsum(ends - starts)])
    columns.append((lengths[first[1:]] - lengths[first[:-1]]) / np.maximum(count, 1) / 10)
    own = [np.unique(hashes[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    columns.append(np.array([len(x) for x in own]) / np.maximum(count, 1))
    columns.append(np.log1p(count))
    return np.stack(columns, axis=1), own


def metadata_slots(source: str | None, lang: str | None, n_chars: int | None) -> list[int]:
    """Hashed slots of the metadata view."""
    size = "none" if n_chars is None else str(int(np.log2(max(n_chars, 0) + 1) * 2))
    return [zlib.crc32(x.encode("utf-8", "replace")) % METADATA for x in (f"s:{source}", f"l:{lang}", f"n:{size}", f"sl:{source}:{lang}")]


class Logistic:
    """Class-balanced logistic regression on sparse binary and dense features."""

    def __init__(self, slots: int, rounds: int = 250, rate: float = 2.0, decay: float = 2e-4):
        self.slots, self.rounds, self.rate, self.decay = slots, rounds, rate, decay

    def fit(self, row: np.ndarray, col: np.ndarray, dense: np.ndarray, y: np.ndarray) -> Logistic:
        self.mean, self.scale = dense.mean(axis=0), dense.std(axis=0) + 1e-6
        x = (dense - self.mean) / self.scale
        self.w, self.v, self.b = np.zeros(self.slots), np.zeros(dense.shape[1]), 0.0
        each = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
        for _ in range(self.rounds):
            z = np.bincount(row, self.w[col], len(y)) + x @ self.v + self.b
            error = (y - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) * each
            self.w += self.rate * (np.bincount(col, error[row], self.slots) - self.decay * self.w)
            self.v += 0.3 * self.rate * (error @ x - self.decay * self.v)
            self.b += self.rate * error.sum()
        return self

    def logit(self, row: np.ndarray, col: np.ndarray, dense: np.ndarray) -> np.ndarray:
        x = np.clip((dense - self.mean) / self.scale, -8, 8)
        return np.bincount(row, self.w[col], len(dense)) + x @ self.v + self.b


def _stack(logits: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a small logistic regression (Platt scaling for one column), bias last."""
    x = np.concatenate([logits, np.ones((len(logits), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
    return w


class View:
    """Features of some documents in one view, by row."""

    def __init__(self, rows: list[np.ndarray], dense: np.ndarray):
        self.rows, self.dense = rows, dense

    def take(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = [self.rows[i] for i in index]
        row = np.repeat(np.arange(len(own)), [len(x) for x in own])
        return row, np.concatenate([*own, np.zeros(0, np.int64)]).astype(np.int64), self.dense[index]


def _surest(p: np.ndarray, share: float, n: int) -> np.ndarray:
    """Places of the n greatest probabilities of a class, as far as they are over SURE and odds LIFT times those of its share."""
    best = np.argsort(-p, kind="stable")[:n]
    p = p[best]
    return best[(p >= SURE) & (p * (1 - share) >= LIFT * share * (1 - p))]


class CoTrained:
    """Two views of one label, co-trained, calibrated and combined.

    Of the labelled documents three fifths train, a fifth calibrates each view,
    and a fifth weighs the views against each other. ``sizes`` holds the views'
    numbers of training documents by round.
    """

    def __init__(self, views: list[View], slots: list[int], labels: np.ndarray):
        known = np.flatnonzero(labels >= 0)
        y = labels[known].astype(float)
        self.models, self.sizes = None, []
        self.prior = float(y.mean()) if len(y) else 0.5
        if len(y) < 20 or y.min() == y.max():
            return
        part = np.arange(len(known)) % 5
        train, check, weigh = known[part < 3], known[part == 3], known[part == 4]
        if any(len(set(labels[x])) < 2 for x in (train, check, weigh)):
            return
        # what each view may learn from, and of which documents it has no label yet
        held = [dict(zip(train.tolist(), labels[train].tolist(), strict=True)) for _ in views]
        pool = [np.flatnonzero(labels < 0) for _ in views]
        share = labels[train].mean()
        quota = [max(1, round(GIVEN * (1 - share))), max(1, round(GIVEN * share))]
        for turn in range(ROUNDS + 1):
            models = []
            for v, s, g in zip(views, slots, held, strict=True):
                at = np.fromiter(g, np.int64, len(g))
                models.append(Logistic(s).fit(*v.take(at), np.fromiter(g.values(), float, len(g))))
            scaled = [_stack(m.logit(*v.take(check))[:, None], labels[check].astype(float)) for m, v in zip(models, views, strict=True)]
            self.sizes.append([len(g) for g in held])
            if turn == ROUNDS:
                break
            gifts = []
            for i, (m, v, w) in enumerate(zip(models, views, scaled, strict=True)):
                open_ = pool[1 - i]  # the other view's
                p = 1 / (1 + np.exp(-np.clip(m.logit(*v.take(open_)) * w[0] + w[1], -30, 30)))
                gifts.append({int(open_[j]): label for label, n in enumerate(quota) for j in _surest(p if label else 1 - p, share if label else 1 - share, n)})
            for i, gift in enumerate(gifts):
                held[1 - i] |= gift
                pool[1 - i] = pool[1 - i][~np.isin(pool[1 - i], list(gift))]
        self.models = models
        logits = np.stack([m.logit(*v.take(weigh)) * w[0] + w[1] for m, v, w in zip(models, views, scaled, strict=True)], axis=1)
        self.scaled, self.weights = scaled, _stack(logits, labels[weigh].astype(float))

    def p(self, features: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
        if self.models is None:
            return np.full(len(features[0][2]), self.prior)
        z = self.weights[-1]
        for m, f, w, k in zip(self.models, features, self.scaled, self.weights, strict=False):
            z = z + k * (m.logit(*f) * w[0] + w[1])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class QualityModel:
    """vocabulary: word hashes of the content view; heads by label."""

    def __init__(self, rows: list[dict]):
        dense = np.array([r["dense"] for r in rows], float).reshape(len(rows), -1)
        words = [np.frombuffer(r["words"], U) for r in rows]
        chosen: list[np.ndarray] = []
        targets = {}
        for label in ("quality", "toxic"):
            y = np.array([-1 if r[label] is None else int(r[label] > 0) for r in rows], np.int64)
            targets[label] = y
            # the words whose presence tells most, without the documents kept apart
            known = np.flatnonzero(y >= 0)
            known = known[np.arange(len(known)) % 5 < 3]
            if len(known):
                all_words = np.concatenate([words[i] for i in known])
                of = np.repeat(y[known], [len(words[i]) for i in known])
                unique, inverse, n = np.unique(all_words, return_inverse=True, return_counts=True)
                ones = np.bincount(inverse, of, len(unique))
                share = y[known].mean()
                chi = (ones - n * share) ** 2 / np.maximum(n * share * (1 - share), 1e-9)
                chi[n < LEAST_DOCS] = -1
                best = np.argsort(-chi, kind="stable")[:VOCABULARY]
                chosen.append(unique[best[chi[best] > TELLING]])
        self.vocabulary = np.unique(np.concatenate([*chosen, np.zeros(0, U)]))
        own = [self.slots(w) for w in words]
        views = [View(own, dense), View([np.array(metadata_slots(r["source"], r["lang"], r["n_chars"])) for r in rows], np.zeros((len(rows), 1)))]
        sizes = [len(self.vocabulary) + 1, METADATA]
        self.heads = {k: CoTrained(views, sizes, y) for k, y in targets.items()}

    def slots(self, words: np.ndarray) -> np.ndarray:
        if not len(self.vocabulary):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return at[self.vocabulary[at] == words]

    def score(self, raw: np.ndarray, offsets: np.ndarray, meta: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """(probability of quality, probability of toxicity) of each text."""
        dense, words = content(raw, offsets)
        index = np.arange(len(words))
        features = [View([self.slots(w) for w in words], dense).take(index), View([np.array(m) for m in meta], np.zeros((len(meta), 1))).take(index)]
        return self.heads["quality"].p(features), self.heads["toxic"].p(features)


def _meta(batch: pa.RecordBatch) -> list[list[int]]:
    return [metadata_slots(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True)]


def sample_rows(docs: DataFrame, labels: DataFrame) -> list[dict]:
    """Features of the sampled documents: in each of as many hash buckets the one of least hash."""
    h = F.xxhash64("doc_id")

    def picked(ids: DataFrame, n: int) -> DataFrame:
        return ids.groupBy(F.pmod(h, F.lit(n)).alias("b")).agg(F.min(F.struct(h.alias("h"), "doc_id")).alias("m")).select("m.doc_id")

    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"))
    ids = docs.select("doc_id").where("doc_id is not null")
    few = materialise(picked(ids.join(known, "doc_id", "left_semi"), LABELLED).union(picked(ids.join(known, "doc_id", "left_anti"), UNLABELLED)), "sample")
    chosen = only(docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars")), few, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            dense, words = content(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "source", "lang", "n_chars")), pa.array(dense.tolist(), pa.list_(pa.float64())), pa.array([w.tobytes() for w in words], pa.binary())],
                names=["doc_id", "source", "lang", "n_chars", "dense", "words"],
            )

    rows = chosen.mapInArrow(run, "doc_id long, source string, lang string, n_chars long, dense array<double>, words binary")
    out = [r.asDict() for r in rows.collect()]  # bounded by the sample
    label = {r["doc_id"]: r for r in only(known, few, "doc_id").collect()}
    seen: dict = {}
    for r in sorted(out, key=lambda r: (r["doc_id"], bytes(r["words"]))):
        r["quality"], r["toxic"] = (label[r["doc_id"]]["quality"], label[r["doc_id"]]["toxic"]) if r["doc_id"] in label else (None, None)
        seen.setdefault(r["doc_id"], r)
    # an order that does not follow the ids, for the part kept apart
    return sorted(seen.values(), key=lambda r: zlib.crc32(str(r["doc_id"]).encode()))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score, p_quality, p_toxic, keep."""
    bounded(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good, bad = shared.value.score(*text_bytes(batch.column("text")), _meta(batch))
            score = good * (1 - bad)
            keep = (good >= 0.5) & (bad < 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x) for x in (score, good, bad, keep))], names=["doc_id", "score", "p_quality", "p_toxic", "keep"])

    rows = docs.select("doc_id", "text", "source", "lang", F.col("n_chars").cast("long").alias("n_chars"))
    return rows.mapInArrow(run, "doc_id long, score double, p_quality double, p_toxic double, keep boolean")
