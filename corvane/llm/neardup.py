"""Near-duplicate documents by b-bit MinHash.

Each document's distinct word shingles give MINIMA hash minima. Bands of
minima choose candidates; the low bits of all minima, packed, estimate the
similarity of a candidate pair by counting equal positions and correcting for
chance; pairs that pass are confirmed on the full shingle sets.

Equal sets are one node. Within a bucket of a band not all pairs are made.
First its nodes are compared with one pivot; nodes known to be linked have one
label and need no comparison. While that helps, those outside a bucket's
largest label are compared with a few pivots within it, which costs a row for
each. What is then still apart meets in blocks, where full sets confirm a pair
at once and labels merge, so a block gives fewer links than it has labels. No
bucket is cut short, and everything stays in Spark.

Nulls and edge cases: a null or wordless text has an empty set and is linked
with nothing; with fewer words than a shingle takes, the whole sequence is
the only shingle; a null doc_id has no component and is kept; rows that share
a doc_id are each returned with their own set's size, but are one document in
the links: what either text is linked with belongs to one component; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import U, constants, mix, shingles, text_bytes
from .common import materialise, only, scratch, slices
from .components import components

WORDS = 5
#: Bands of minima: a pair of similarity 0.75 shares a band with probability 0.9996.
BANDS, ROWS = 40, 6
MINIMA = BANDS * ROWS
#: Low bits kept of each minimum.
BITS = 4
#: 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Pairs whose estimate is below are not confirmed: four standard errors (0.029) under the threshold.
LEAST_ESTIMATE = 0.633
#: Nodes, and bytes of their sets, on a side of a block of comparisons.
BLOCK, BLOCK_BYTES = 1024, 16 << 20
#: Further pivots of a bucket in a round; another round follows while at most this share of nodes stays apart.
PIVOTS, WORTH = 8, 0.75
#: What names a shingle set.
SET = ["d1", "d2", "n_shingles"]

SIGNATURE = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>"


def _packed(minima: np.ndarray) -> np.ndarray:
    """BITS low bits of each minimum, packed into bytes."""
    low = (minima & U((1 << BITS) - 1)).astype(np.uint8)
    each = 8 // BITS
    out = low[:, 0::each].copy()
    for j in range(1, each):
        out |= low[:, j::each] << (BITS * j)
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def distinct_sets(raw: np.ndarray, offsets: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the first of each plus the total."""
    hashes, at = shingles(raw, offsets, size)
    own = [np.unique(hashes[at[i] : at[i + 1]]) for i in range(len(at) - 1)]
    first = np.zeros(len(own) + 1, np.int64)
    np.cumsum([len(x) for x in own], out=first[1:])
    return np.concatenate([*own, np.zeros(0, U)]), first


def _minima(sets: np.ndarray, first: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash minima of each set, zeros for empty ones, and which sets aren't empty."""
    full = np.flatnonzero(np.diff(first))
    minima = np.zeros((len(first) - 1, len(factors)), U)
    if len(full):
        starts = first[:-1][full]
        for j, f in enumerate(factors):
            minima[full, j] = np.minimum.reduceat(sets * f, starts)
    return minima, full


def _digests(sets: np.ndarray, first: np.ndarray, full: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Both halves of each set's digest, zeros for empty ones."""
    out = np.zeros((2, len(first) - 1), U)
    if len(full):
        for half, salt in zip(out, (U(0), constants(1, 6)[0]), strict=True):
            half[full] = np.add.reduceat(mix(sets ^ salt), first[:-1][full])
    return _signed(out[0]), _signed(out[1])


def signatures(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """Set size, set digest and band keys of each document."""
    factors = constants(MINIMA, 5)
    salt = constants(BANDS, 6)
    step = constants(ROWS, 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, first = distinct_sets(*text_bytes(batch.column("text")), size)
            count = np.diff(first)
            minima, full = _minima(sets, first, factors)
            keys = mix((minima.reshape(len(count), BANDS, ROWS) * step).sum(axis=2, dtype=U) + salt)
            flat = _signed(keys[count > 0].ravel())
            offs = np.zeros(len(count) + 1, np.int32)
            np.cumsum(np.where(count > 0, BANDS, 0), out=offs[1:])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count), *_digests(sets, first, full), pa.ListArray.from_arrays(pa.array(offs), flat)], names=["doc_id", "n_shingles", "d1", "d2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, SIGNATURE)


def member_sets(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """Set digest and size, packed low bits, and the shingle set as sorted 64-bit hashes."""
    factors = constants(MINIMA, 5)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, first = distinct_sets(*text_bytes(batch.column("text")), size)
            minima, full = _minima(sets, first, factors)
            own = [sets[first[i] : first[i + 1]].tobytes() for i in range(len(first) - 1)]
            bits = [b.tobytes() for b in _packed(minima)]
            yield pa.RecordBatch.from_arrays([*_digests(sets, first, full), pa.array(np.diff(first)), pa.array(bits, pa.binary()), pa.array(own, pa.binary())], names=["d1", "d2", "n_shingles", "bits", "items"])

    return docs.select("text").mapInArrow(run, "d1 long, d2 long, n_shingles long, bits binary, items binary")


def _bits(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, MINIMA * BITS // 8)


def estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Similarity from packed low bits (last axis), corrected for chance equality."""
    x = x ^ y
    same = np.zeros(x.shape[:-1], np.int64)
    for j in range(8 // BITS):
        same += (((x >> (BITS * j)) & ((1 << BITS) - 1)) == 0).sum(axis=-1)
    chance = 1.0 / (1 << BITS)
    return (same / MINIMA - chance) / (1 - chance)


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the threshold."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def estimated(pairs: DataFrame, sets: DataFrame, least: float = LEAST_ESTIMATE) -> DataFrame:
    """The pairs (a, b) whose estimated similarity is at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = estimate(_bits(batch.column("x")), _bits(batch.column("y"))) >= least
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = sets.select(F.col("node").alias("a"), F.col("bits").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("bits").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(np.frombuffer(x.as_py(), U), np.frombuffer(y.as_py(), U), percent) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("items").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def block_links(key: int, sides: list[pa.Table], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links between the labels of two sides of a block: enough to join every label that a pair of the block joins.

    A pair counts only in the first bucket it shares.
    """
    if not all(s.num_rows for s in sides):
        return []
    (ids, size, bits, bands, items), (ids2, size2, bits2, bands2, items2) = (
        (s["node"].to_numpy(), s["n_shingles"].to_numpy(), _bits(s["bits"]), np.array(s["bands"].to_pylist()), s["items"]) for s in sides
    )
    _, codes = np.unique(np.concatenate([s["label"].to_numpy() for s in sides]), return_inverse=True)
    mine, theirs = codes[: len(ids)], codes[len(ids) :]
    out = []
    for i in range(len(ids)):
        small, large = np.minimum(size[i], size2), np.maximum(size[i], size2)
        near = np.flatnonzero((theirs != mine[i]) & (100 * small >= percent * large))
        share = estimate(bits[i], bits2[near])
        near, share = near[share >= LEAST_ESTIMATE], share[share >= LEAST_ESTIMATE]
        if not len(near):
            continue
        first = (bands2[near] == bands[i]).argmax(axis=1)
        ok = bands[i][first] == key
        x = np.frombuffer(items[i].as_py(), U)
        for j in near[ok][np.argsort(-share[ok], kind="stable")].tolist():
            if theirs[j] != mine[i] and linked(x, np.frombuffer(items2[j].as_py(), U), percent):
                out.append((int(ids[i]), int(ids2[j])))
                old, new = theirs[j], mine[i]
                mine[mine == old] = new
                theirs[theirs == old] = new
    return out


def left_over(grouped: DataFrame, apart: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that join what is still apart within buckets.

    ``grouped`` is (key, node, label), ``apart`` the buckets with several
    labels. In each, the nodes outside its largest label meet all others, in
    blocks of at most about BLOCK by BLOCK nodes and BLOCK_BYTES a side.
    """
    sized = grouped.join(apart, "key").join(sets.select("node", F.octet_length("items").alias("w")), "node")
    sized = materialise(sized, "apart-members")
    few_ = F.col("label") != F.col("most")
    blocks = lambda n, w: F.greatest(F.ceil(n / BLOCK), F.ceil(w / BLOCK_BYTES)).cast("int")
    per = sized.groupBy("key").agg(F.count("*").alias("m"), F.sum("w").alias("w"), F.sum(few_.cast("int")).alias("fm"), F.sum(F.when(few_, F.col("w"))).alias("fw"))
    per = materialise(per.select("key", blocks(F.col("fm"), F.col("fw")).alias("nf"), blocks(F.col("m"), F.col("w")).alias("na")), "blocks")
    rows = sized.select("key", "node", "label", "most").join(per, "key")
    part = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    few = rows.where(few_).select("key", part(F.col("nf"), 1).alias("f"), every(F.col("na")).alias("a"), F.lit(0).alias("side"), "node", "label")
    rest = rows.select("key", every(F.col("nf")).alias("f"), part(F.col("na"), 2).alias("a"), F.lit(1).alias("side"), "node", "label")
    met = few.union(rest).join(sets.select("node", "n_shingles", "bits", "bands", "items"), "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            group = pa.Table.from_batches(held)
            side = group["side"].to_numpy()
            found = block_links(now[0], [group.filter(pa.array(side == s)) for s in (0, 1)], percent)
            if found:
                a, b = (np.array(x, np.int64) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, f, a = (batch.column(c).to_numpy() for c in ("key", "f", "a"))
            edge = np.flatnonzero((key[1:] != key[:-1]) | (f[1:] != f[:-1]) | (a[1:] != a[:-1])) + 1
            for begin, end in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows], strict=True):
                own = (int(key[begin]), int(f[begin]), int(a[begin]))
                if own != now:
                    if held:
                        yield from flush()
                    now, held = own, []
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from flush()

    ordered = met.select("key", "f", "a", "side", "node", "label", "n_shingles", "bits", "bands", "items").repartition("key", "f", "a").sortWithinPartitions("key", "f", "a")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def with_labels(members: DataFrame, stars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, node, label), and the buckets that hold several labels with the most frequent one."""
    label = stars.select("node", F.col("component").alias("label"))
    grouped = materialise(members.join(label, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "labelled")
    per = grouped.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key")
    per = per.agg(F.sum("n").alias("m"), F.max("n").alias("top"), F.max_by("label", "n").alias("most")).where("m > top")
    return grouped, materialise(per.select("key", "m", "most"), "apart")


def pivot_pairs(grouped: DataFrame, apart: DataFrame, turn: int) -> DataFrame:
    """Each node outside its bucket's largest label with PIVOTS nodes within it, in the largest of its buckets only."""
    seed = lambda i: F.xxhash64("node", F.lit(turn * PIVOTS + i))
    rows = grouped.join(apart, "key")
    chosen = rows.where("label = most").groupBy("key").agg(*(F.min_by("node", seed(i)).alias(f"p{i}") for i in range(PIVOTS)))
    chosen = materialise(chosen.select("key", F.array_distinct(F.array(*(f"p{i}" for i in range(PIVOTS)))).alias("pivots")), "chosen")
    few = rows.where("label <> most").groupBy("node").agg(F.max_by("key", "m").alias("key"))
    pairs = few.join(chosen, "key").select("node", F.explode("pivots").alias("pivot"))
    return pairs.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def same_ids(filled: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the nodes of rows that share a doc_id."""
    several = filled.groupBy("doc_id").agg(*(f("d1").alias(f"{n}1") for f, n in ((F.min, "a"), (F.max, "b"))), *(f("d2").alias(f"{n}2") for f, n in ((F.min, "a"), (F.max, "b"))))
    several = materialise(several.where("a1 <> b1 or a2 <> b2").select("doc_id"), "repeated-ids")
    held = materialise(only(filled.select("doc_id", *SET), several, "doc_id").distinct().join(classes.select(*SET, "node"), SET).select("doc_id", "node"), "repeated-nodes")
    least = held.groupBy("doc_id").agg(F.min("node").alias("b"))
    return held.join(least, "doc_id").where("node <> b").select(F.col("node").alias("a"), "b")


def near_duplicates(docs: DataFrame, size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each document."""
    with scratch() as temporary:
        marks, placed = _placed(docs, size, percent)
        temporary.keep(marks, placed)
    out = marks.select("doc_id", *SET).join(placed, SET, "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _placed(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Tables: the documents' set digests, and the component of each distinct set."""
    marks = materialise(signatures(docs, size), "signatures")
    filled = marks.where("n_shingles > 0 and doc_id is not null")
    classes = filled.groupBy(*SET).agg(F.min("doc_id").alias("head"), F.first("bands").alias("bands"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    keys = classes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("high")).where("pivot < high")
    shared = materialise(shared.select("key", "pivot"), "buckets")
    members = materialise(keys.join(shared, "key").select("key", "node", "pivot"), "members")
    wanted = materialise(classes.join(members.select("node").distinct(), "node", "left_semi"), "wanted")
    ids = materialise(wanted.select(F.col("head").alias("doc_id")).distinct(), "member-ids")
    sets = member_sets(only(docs.select("doc_id", "text"), ids, "doc_id"), size)
    sets = materialise(sets.join(wanted.select(*SET, "node", "bands"), SET).dropDuplicates(["node"]), "sets")
    # one pivot for each bucket
    pairs = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = same_ids(filled, classes).union(confirmed(estimated(pairs, sets), sets, percent))
    stars = components(links)
    # then more pivots, as long as they join a good part of what is apart
    turn, before = 0, None
    while True:
        grouped, apart = with_labels(members, stars)
        few = grouped.join(apart, "key").where("label <> most").agg(F.count_distinct("node")).first()[0]
        if not few or (before is not None and few > WORTH * before):
            break
        turn, before = turn + 1, few
        found = confirmed(estimated(pivot_pairs(grouped, apart, turn), sets), sets, percent)
        stars = components(found.union(stars.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    if few:
        found = left_over(grouped, apart, sets, percent)
        stars = components(found.union(stars.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    # the least doc_id of each component, for all its classes
    heads = stars.join(classes.select("node", *SET, "head"), "node")
    least = heads.groupBy("component").agg(F.min("head").alias("component_id"))
    linked_ = heads.join(least, "component").select(*SET, "component_id")
    placed = classes.select(*SET, "head").join(linked_, SET, "left").select(*SET, F.coalesce("component_id", "head").alias("component_id"))
    # written, so that the join with all documents deals both sides anew and a hot set's rows can be split
    return marks, materialise(placed, "placed")
