"""Hard-negative mining: full score sorts of each anchor, block by block.

Vectors are packed into blocks, anchors into blocks of their own, and every
block of anchors meets every block of rows (the anchors are a stated query
set). A first pass keeps each anchor's best rows of its own label, the
positives. In the second, a block's scores of an anchor are sorted by score
and id; for each positive a binary search finds the upper limit, and the
first rows of another label from there that are above the lower limit are
read. The best of all blocks are the best of the whole sort, so only these
few leave a task and none holds an anchor's whole list.

Blocks of rows are dealt over groups, so that an anchor's scores are shared
out, whichever id or label is frequent.

Nulls and edge cases: rows with a null label, a null vector, or a null or
non-finite component take no part; a row of a null id is no anchor and comes
last among equal scores; rows that share an id are rows of their own, in an
order that the table's files give; vectors of different length don't meet;
scores are exact, whatever their size (a result beyond a long is held at its
limit); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded, materialise, scratch

POSITIVES, NEGATIVES = 5, 10
#: A negative's score is from LOW to HIGH percent of the positive's.
LOW, HIGH = 30, 90
SCALE = 256
#: Rows and anchors of a block, and blocks of rows that one task goes through for a block of anchors at most.
ROWS, ANCHORS, BLOCKS = 1024, 256, 1024
#: Tasks for each core that the pairs of blocks are dealt over, if there are as many.
TASKS = 4
#: Sums below this are exact as doubles; keys of score and place below 2**62 fit a long.
EXACT = 1 << 50
NO_ID = (1 << 63) - 1
LONG = (-(1 << 63), (1 << 63) - 1)


def marked(embeddings: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """The rows with labels that are moved on by one where the id is divisible."""
    label = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return embeddings.select("vec_id", label.cast("long").alias("label"), "embedding")


class Block(NamedTuple):
    """Rows in order of id, as columns."""

    ids: np.ndarray
    names: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    scores: list | None = None

    @staticmethod
    def of(row: dict, prefix: str = "") -> Block:
        ids, names, labels = (np.frombuffer(row[prefix + k], np.int64) for k in ("ids", "names", "labels"))
        vectors = np.frombuffer(row[prefix + "vectors"], np.int16 if row[prefix + "small"] else np.float64)
        return Block(ids, names, labels, vectors.reshape(len(ids), -1).astype(np.float64), row.get(prefix + "positives"))


BLOCK = "dim long, ids binary, names binary, labels binary, small boolean, vectors binary"
BLOCK_NAMES = [x.split()[0] for x in BLOCK.split(", ")]
BLOCK_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_(), pa.binary()]


def _packer(most: int, by: str | None = None):
    """Rows to blocks of one dimension (and of one value of ``by``), ``most`` rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict]] = {}
        own = None

        def block(rows: list[dict]) -> pa.RecordBatch:
            rows.sort(key=lambda r: (NO_ID if r["vec_id"] is None else r["vec_id"], r["name"]))
            vectors = np.floor(np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), -1) * SCALE)
            small = bool((np.abs(vectors) < 1 << 15).all())
            columns = [np.array([NO_ID if r[k] is None else r[k] for r in rows], np.int64).tobytes() for k in ("vec_id", "name", "label")]
            values = [vectors.shape[1], *columns, small, (vectors.astype(np.int16) if small else vectors).tobytes()]
            names, types = list(BLOCK_NAMES), list(BLOCK_TYPES)
            if by:
                values += [rows[0][by], [list(map(str, r["scores"])) for r in rows]]
                names += [by, "positives"]
                types += [pa.int64(), pa.list_(pa.list_(pa.string()))]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        for batch in batches:
            for at in range(0, batch.num_rows, most):
                for row in batch.slice(at, most).to_pylist():
                    if by and row[by] != own:
                        for rows in held.values():
                            yield block(rows)
                        held, own = {}, row[by]
                    rows = held.setdefault(len(row["embedding"]), [])
                    rows.append(row)
                    if len(rows) == most:
                        yield block(held.pop(len(row["embedding"])))
        for rows in held.values():
            yield block(rows)

    return run


def scores_of(anchors: Block, block: Block) -> np.ndarray:
    """Inner products of whole numbers, as longs, or as Python's integers where they could be too large."""
    a, b = anchors.vectors, block.vectors
    most = (np.abs(a).sum(axis=1).max(initial=0)) * np.abs(b).max(initial=0)
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = [np.array([int(x) for x in v.ravel()], object).reshape(v.shape) for v in (a, b)]
    return whole[0] @ whole[1].T if whole[0].shape[1] else np.zeros((len(a), len(b)), np.int64)


def sorted_scores(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's scores in falling order, and their places; of equal scores the first place, hence the least id, leads."""
    n = scores.shape[1]
    if scores.dtype == object:
        order = np.argsort(-scores, axis=1, kind="stable")
        return np.take_along_axis(scores, order, axis=1), order
    bits = max(1, (n - 1).bit_length())
    # one key holds both that are sorted by
    keys = np.sort((-scores << bits) | np.arange(n), axis=1)
    return -(keys >> bits), keys & ((1 << bits) - 1)


class Best:
    """The best of an anchor so far, as (-score, id, name)."""

    def __init__(self, most: int):
        self.most = most
        self.of: dict[tuple, list[tuple[int, int, int]]] = {}

    def add(self, key: tuple, found: list[tuple[int, int, int]]) -> None:
        if found:
            self.of[key] = sorted(self.of.get(key, []) + found)[: self.most]


def positives_in(anchors: Block, block: Block, best: Best) -> None:
    for label in np.unique(anchors.labels):
        rows, same = np.flatnonzero(anchors.labels == label), np.flatnonzero(block.labels == label)
        if not len(same):
            continue
        part = Block(*(x[same] for x in block[:4]))
        scores, order = sorted_scores(scores_of(Block(*(x[rows] for x in anchors[:4])), part))
        for i, row in enumerate(rows.tolist()):
            first = order[i, : POSITIVES + 1]  # one more, as the anchor itself is among them
            found = [(-int(s), int(part.ids[j]), int(part.names[j])) for s, j in zip(scores[i], first, strict=False) if part.names[j] != anchors.names[row]]
            best.add((int(anchors.ids[row]), int(anchors.names[row])), found[:POSITIVES])


def negatives_in(anchors: Block, block: Block, best: Best) -> None:
    scores = scores_of(anchors, block)
    for label in np.unique(anchors.labels):
        rows, other = np.flatnonzero(anchors.labels == label), np.flatnonzero(block.labels != label)
        if not len(other):
            continue
        part, order = sorted_scores(scores[np.ix_(rows, other)])
        for i, row in enumerate(rows.tolist()):
            falling = part[i]
            limits = [int(s) for s in anchors.scores[row]]
            upper = [s * HIGH // 100 for s in limits]
            lower = [-(-s * LOW // 100) for s in limits]
            # the first place of a score that is not above the limit
            begins = np.searchsorted(-falling, [-u for u in upper]).tolist() if falling.dtype != object else [int(sum(x > u for x in falling)) for u in upper]
            for rank, (begin, least) in enumerate(zip(begins, lower, strict=True)):
                some = [(-int(s), int(j)) for s, j in zip(falling[begin : begin + NEGATIVES], order[i, begin : begin + NEGATIVES], strict=True) if s >= least]
                best.add((int(anchors.names[row]), rank), [(s, int(block.ids[other[j]]), int(block.names[other[j]])) for s, j in some])


def _pairs(kind: str):
    """Pairs of blocks to the best of each key; groups come one after another, or a few at a time if joined by broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Best] = {}
        known: dict[tuple, Block] = {}

        def give(best: Best) -> Iterator[pa.RecordBatch]:
            rows = [(*key, s, i, name) for key, found in best.of.items() for s, i, name in found]
            if rows:
                a, b, score, ids, names = zip(*rows, strict=True)
                # falling scores as text, as they may be larger than a long
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([str(-s) for s in score]), pa.array(ids, pa.int64()), pa.array(names, pa.int64())], names=["a", "b", "score", "vec_id", "name"])

        for batch in batches:
            for i in range(batch.num_rows):
                (row,) = batch.slice(i, 1).to_pylist()
                key = (row["anchors_id"], row["salt"])
                if key not in states:
                    if len(states) >= 4:
                        oldest = next(iter(states))
                        yield from give(states.pop(oldest))
                        known.pop(oldest)
                    states[key], known[key] = Best(POSITIVES if kind == "positives" else NEGATIVES), Block.of(row, "a_")
                (positives_in if kind == "positives" else negatives_in)(known[key], Block.of(row), states[key])
        for best in states.values():
            yield from give(best)

    return run


def _met(blocks: DataFrame, anchors: DataFrame, kind: str, n_blocks: int, n_anchors: int) -> DataFrame:
    """(a, b, score, vec_id, name): the best that blocks of rows have for each anchor, of all pairs of blocks."""
    spark = blocks.sparkSession
    groups = max(-(-n_blocks // BLOCKS), min(n_blocks, -(-TASKS * spark.sparkContext.defaultParallelism // n_anchors)))
    salted = anchors.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    salted = salted.select("anchors_id", "salt", F.col("dim").alias("a_dim"), *(F.col(c).alias(f"a_{c}") for c in anchors.columns if c not in ("dim", "anchors_id")))
    rows = blocks.withColumn("salt", F.pmod(F.col("block_id"), F.lit(groups)).cast("int")).join(salted, "salt").where("dim = a_dim")
    rows = rows.repartition(F.col("anchors_id"), F.col("salt")).sortWithinPartitions("anchors_id", "salt")
    return rows.mapInArrow(_pairs(kind), "a long, b long, score string, vec_id long, name long")


def mine(embeddings: DataFrame, anchors_every: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``embeddings`` has vec_id, label and embedding; anchors are the rows whose
    vec_id is divisible by ``anchors_every``.
    """
    with scratch() as temporary:
        return _mine(embeddings, anchors_every, temporary)


def _mine(embeddings: DataFrame, anchors_every: int, temporary: Scratch) -> DataFrame:
    bounded(embeddings.sparkSession)
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # a NaN counts as larger
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = materialise(rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).withColumn("name", F.monotonically_increasing_id()), "vectors")
    blocks = materialise(rows.mapInArrow(_packer(ROWS), BLOCK).withColumn("block_id", F.monotonically_increasing_id()), "blocks")
    asked = rows.where(F.col("vec_id") % anchors_every == 0)
    parts = max(1, -(-asked.count() // ANCHORS))
    group = F.pmod(F.xxhash64("vec_id", "name"), F.lit(parts)).alias("group")

    def packed(anchors: DataFrame) -> DataFrame:
        dealt = anchors.select("vec_id", "name", "label", "embedding", "scores", group).repartition("group").sortWithinPartitions("group")
        made = dealt.mapInArrow(_packer(ANCHORS, "group"), f"{BLOCK}, group long, positives array<array<string>>").drop("group")
        return materialise(made.withColumn("anchors_id", F.monotonically_increasing_id()), "anchors")

    exact = F.col("score").cast("decimal(38,0)")
    ranked = lambda key: Window.partitionBy(*key).orderBy(exact.desc(), F.col("vec_id"), F.col("name"))
    long = lambda c: F.least(F.greatest(F.col(c).cast("decimal(38,0)"), F.lit(LONG[0])), F.lit(LONG[1])).cast("long")
    known = lambda c: F.when(F.col(c) != NO_ID, F.col(c))

    first = packed(asked.withColumn("scores", F.array().cast("array<string>")))
    n_blocks, n_anchors = max(1, blocks.count()), max(1, first.count())
    best = _met(blocks, first, "positives", n_blocks, n_anchors).withColumn("nth", F.row_number().over(ranked(["b"]))).where(F.col("nth") <= POSITIVES)
    positives = materialise(best.select(F.col("a").alias("anchor_id"), F.col("b").alias("anchor"), (F.col("nth") - 1).alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    limits = positives.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("nth", "positive_score")))["positive_score"].alias("scores"))  # POSITIVES at most
    second = packed(asked.join(limits.withColumnRenamed("anchor", "name"), "name"))
    temporary.keep(blocks, positives, second)
    found = _met(blocks, second, "negatives", n_blocks, n_anchors).withColumn("rank", F.row_number().over(ranked(["a", "b"]))).where(F.col("rank") <= NEGATIVES)
    found = found.select(F.col("a").alias("anchor"), F.col("b").cast("int").alias("nth"), "rank", known("vec_id").alias("negative_id"), long("score").alias("negative_score"))
    out = found.join(positives, ["anchor", "nth"])
    return out.select("anchor_id", known("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), "negative_id", long("positive_score").alias("positive_score"), "negative_score")
