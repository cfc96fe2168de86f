"""Nearest vectors by multiprobe p-stable hashing.

Each table cuts a few random projections into cells. A query visits, in each
table, its own cell and neighbouring ones in the order of their estimated
success (the squared distances to the cells' borders, summed), and what the
tables' buckets hold is ranked by the exact inner product.

Largest inner products are nearest points once every vector carries one more
component that brings all to one norm. Width and number of probes are fitted
to the true neighbours of TRIALS sampled queries, sought among all, so that
the target recall takes the fewest candidates; every vector is indexed.

Equal vectors are one class with one entry in the index. Full buckets are
split into blocks that all queries of the bucket visit; a part of the index is
copied once for every QUERIES queries that want one of its buckets, so what is
moved follows the work that the buckets leave. The projections grow with the
number of vectors, so that buckets need not. A query that finds too few
candidates in its buckets is compared with all vectors, in blocks.

Nulls and edge cases: vectors that are null, zero, or hold null or non-finite
components take no part, nor do rows with a null vec_id; rows that share a
vec_id count once, with the least of their vectors; shorter vectors are padded
with zeros; equal scores go by vec_id; with k or fewer other vectors all are
returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytesops import U, constants, mix
from .common import materialise

#: Tables; rows of the sample; share of a query's nearest vectors to be found there.
TABLES, SAMPLE, TARGET = 3, 8192, 0.96
#: Asking vectors whose true neighbours the hashing is fitted to, and sampled ones that tell how many a probe meets.
TRIALS, MET = 96, 1024
#: Index entries per block, and queries compared with a block at once.
BLOCK, QUERIES = 8192, 8192
#: Vectors a cell should hold, from which the number of projections follows.
CELL = 300
#: Difference of two sums of one product, as a share of the largest squared norm.
SLACK = 1e-9
#: Projections up to which every move to a neighbouring cell may be probed; with more, those along CHANGES of them.
ALL_MOVES, CHANGES = 7, 3


def moves(k: int) -> np.ndarray:
    """Moves to neighbouring cells, one row each: of 0, -1 and 1, in the order of their digits 0, 1 and 2."""
    if k <= ALL_MOVES:
        return np.array(list(itertools.product((0, -1, 1), repeat=k)), np.int64)
    out = [np.zeros(k, np.int64)]
    for n in range(1, CHANGES + 1):
        for at in itertools.combinations(range(k), n):
            for signs in itertools.product((-1, 1), repeat=n):
                out.append(np.zeros(k, np.int64))
                out[-1][list(at)] = signs
    made = np.array(out)
    return made[np.argsort(code(made), kind="stable")]


def code(made: np.ndarray) -> np.ndarray:
    """A number for each move (last axis)."""
    return (np.where(made < 0, 1, np.where(made > 0, 2, 0)) * 3 ** np.arange(made.shape[-1] - 1, -1, -1)).sum(axis=-1)


class Hashing:
    """Projections and cells of all tables; probes in estimated success order."""

    def __init__(self, dims: int, projections: int, width: float, probes: int, tables: int = TABLES, seed: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.k, self.width, self.probes, self.tables = projections, width, probes, tables
        self.a = rng.standard_normal((dims, tables * projections))
        self.b = rng.random(tables * projections)
        self.moves = moves(projections)

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell coordinates, and the place within the cell as a share of its width: (rows, tables, k)."""
        z = (x @ self.a) / self.width + self.b
        h = np.floor(z)
        shape = (len(x), self.tables, self.k)
        return h.astype(np.int64).reshape(shape), (z - h).reshape(shape)

    def keys(self, cells: np.ndarray) -> np.ndarray:
        """64-bit names of cells of the shape (..., tables, k)."""
        factors = constants(self.k, 41)
        salt = constants(self.tables, 42)
        return mix((cells.astype(U) * factors).sum(axis=-1, dtype=U) + salt)

    def order(self, place: np.ndarray) -> np.ndarray:
        """Indices into ``moves``, best first, for places of the shape (rows, k)."""
        cost = np.stack([np.zeros_like(place), place**2, (1 - place) ** 2])
        total = np.zeros((len(place), len(self.moves)))
        for j in range(self.k):
            total += cost[self.moves[:, j]][:, :, j].T
        return np.argsort(total, axis=1, kind="stable")

    def ranks(self, queries: np.ndarray, others: np.ndarray) -> np.ndarray:
        """By query, after how many probes each of its ``others`` (queries, n, dims) is met in some table; len(moves) if never."""
        mine, place = self.cells(queries)
        known = code(self.moves)
        best = np.full(others.shape[:2], len(self.moves))
        for i in range(len(queries)):
            cells, _ = self.cells(others[i])
            for t in range(self.tables):
                rank = np.argsort(self.order(place[i : i + 1, t])[0])
                move = cells[:, t] - mine[i, t]
                own = code(move)
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                inside = (np.abs(move) <= 1).all(axis=1) & (known[at] == own)
                best[i] = np.where(inside, np.minimum(best[i], rank[at]), best[i])
        return best

    def probe_keys(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables, probes) bucket names."""
        cells, place = self.cells(x)
        n = min(self.probes, len(self.moves))
        out = np.zeros((len(x), self.tables, n), U)
        for t in range(self.tables):
            best = self.order(place[:, t])[:, :n]
            moved = cells[:, t][:, None, :] + self.moves[best]
            out[:, t] = mix((moved.astype(U) * constants(self.k, 41)).sum(axis=-1, dtype=U) + constants(self.tables, 42)[t])
        return out


def fitted(sample: np.ndarray, queries: np.ndarray, near: np.ndarray, weight: np.ndarray, count: int) -> Hashing:
    """The hashing that finds TARGET of the queries' true neighbours with the fewest candidates.

    ``near`` holds each query's neighbours among all vectors, of the shape
    (queries, neighbours, dims), and ``weight`` how many vectors each counts for;
    ``sample`` tells how many vectors a probe meets.
    """
    k = max(1, round(np.log(max(count / CELL, 1)) / np.log(3.5)))
    spread = float(np.sqrt(sample.var(axis=0).sum())) or 1.0
    best = None
    for step in range(-6, 40):
        h = Hashing(sample.shape[1], k, 1.4 * spread * 1.25**step, len(moves(k)))
        hits = h.ranks(queries, near).ravel()
        order = np.argsort(hits, kind="stable")
        enough = np.cumsum(weight.ravel()[order]) >= TARGET * weight.sum()
        need = hits[order[enough.argmax()]] if len(hits) else 0
        if need < len(h.moves):
            h.probes = int(need) + 1
            met = float((h.ranks(queries, np.broadcast_to(sample, (len(queries), *sample.shape))) <= need).mean()) if len(sample) else 0.0
            if best is None or met < best[0]:
                best = met, h
            if need == 0 or met > 0.999:
                break
    return best[1]


def _matrix(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dims)


def clean(vectors: DataFrame) -> DataFrame:
    """vec_id and its components as a binary of doubles: only usable vectors, each vec_id once."""
    x = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))
    one = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where(fine).groupBy("vec_id").agg(F.min("x").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # 0.0 is added so that -0.0 and 0.0 are one
            v = [(np.array(r, np.float64) + 0.0).tobytes() for r in batch.column("x").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(v, pa.binary())], names=["vec_id", "v"])

    return one.mapInArrow(run, "vec_id long, v binary")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: of each vec_id divisible by ``every`` the k nearest others."""
    spark = vectors.sparkSession
    rows = materialise(clean(vectors), "vectors")
    size = rows.agg(F.coalesce(F.max(F.octet_length("v")), F.lit(8))).first()[0]
    dims = size // 8
    rows = rows.withColumn("v", F.rpad("v", F.lit(size), F.lit(bytearray(1)))) if dims else rows
    classes = materialise(rows.groupBy("v").agg(F.min("vec_id").alias("class"), F.max(F.pmod("vec_id", F.lit(every)) == 0).alias("asked")), "vector-classes")
    member = rows.join(classes.select("v", "class"), "v").select("vec_id", "class")
    # a class can give at most its k + 1 least members to a query: of each of several buckets of it, then of all
    bucket = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    least = member.withColumn("r", F.row_number().over(Window.partitionBy("class", bucket).orderBy("vec_id"))).where(F.col("r") <= k + 1)
    least = least.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    least = materialise(least.groupBy("class").agg(F.sort_array(F.collect_list("vec_id")).alias("members")), "least-members")
    count = classes.count()
    h = F.xxhash64("class")
    some = classes.groupBy(F.pmod(h, F.lit(SAMPLE)).alias("b")).agg(F.min(F.struct(h.alias("h"), "class", "v")).alias("m")).select("m.class", "m.v").collect()
    if not some:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = np.frombuffer(b"".join(bytes(r["v"]) for r in some), np.float64).reshape(-1, dims)

    def norms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(0), dims)
                yield pa.RecordBatch.from_arrays([pa.array([float((x * x).sum(axis=1).max())])], names=["n"])

    longest = classes.select("v").mapInArrow(norms, "n double").agg(F.max("n")).first()[0]

    def lifted(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x, np.sqrt(np.maximum(longest - (x * x).sum(axis=1), 0))[:, None]], axis=1)

    def level(x: np.ndarray) -> np.ndarray:
        return np.concatenate([x * np.sqrt(longest / (x * x).sum(axis=1))[:, None], np.zeros((len(x), 1))], axis=1)

    def best(scored: DataFrame) -> DataFrame:
        by_score = Window.partitionBy("query").orderBy(F.desc("score"), "class")
        return scored.groupBy("query", "class").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= k + 1).drop("r")

    def against_all(few: list) -> DataFrame:
        """The k + 1 nearest classes of each of the given (class, v) rows, by comparison with all."""
        sent = spark.sparkContext.broadcast((np.array([r["class"] for r in few]), b"".join(bytes(r["v"]) for r in few)))  # QUERIES at most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, q = sent.value
            q = np.frombuffer(q, np.float64).reshape(-1, dims)
            ids, scores = np.zeros((len(q), 0), np.int64), np.zeros((len(q), 0))
            for batch in batches:
                x, own = _matrix(batch.column("v"), dims), batch.column("class").to_numpy()
                for a in range(0, len(own), 512):
                    exact = np.stack([np.einsum("j,ij->i", one, x[a : a + 512]) for one in q])
                    ids = np.concatenate([ids, np.broadcast_to(own[a : a + 512], exact.shape)], axis=1)
                    scores = np.concatenate([scores, exact], axis=1)
                    pick = np.lexsort((ids, -scores), axis=1)[:, : k + 1]
                    ids, scores = np.take_along_axis(ids, pick, axis=1), np.take_along_axis(scores, pick, axis=1)
            if ids.size:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(of, ids.shape[1])), pa.array(ids.ravel()), pa.array(scores.ravel())], names=["query", "class", "score"])

        return best(classes.select("class", "v").mapInArrow(run, "query long, class long, score double"))

    # fitted to the true neighbours of a few of the vectors that ask; a class counts as often as it is met among them
    asking_hash = F.xxhash64("vec_id")
    asks = member.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy(F.pmod(asking_hash, F.lit(TRIALS)).alias("b")).agg(F.min_by("class", asking_hash).alias("class"))
    times = Counter(r["class"] for r in asks.collect())
    if not times:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    trial = classes.where(F.col("class").isin(list(times))).select("class", "v").collect()
    truth = materialise(against_all(trial), "trial-neighbours")
    truth = truth.join(classes.select("class", "v"), "class").join(least.select("class", F.size("members").alias("n")), "class")
    nearest_of: dict[int, list] = {r["class"]: [] for r in trial}
    for r in truth.collect():  # TRIALS * (k + 1) rows at most
        nearest_of[r["query"]].append((r["score"], r["n"] - (r["query"] == r["class"]), bytes(r["v"])))
    each_near = min(len(v) for v in nearest_of.values())
    near, weight = b"", np.zeros((len(trial), each_near))
    for i, own in enumerate(nearest_of.values()):
        room = k  # a class weighs as many of the k nearest as its members are
        for j, (_, n, v) in enumerate(sorted(own, key=lambda x: -x[0])[:each_near]):
            weight[i, j] = min(n, room) * times[trial[i]["class"]]
            room -= min(n, room)
            near += v
    near = lifted(np.frombuffer(near, np.float64).reshape(-1, dims)).reshape(len(trial), each_near, dims + 1)
    hashing = fitted(lifted(sample[:MET]), level(_matrix(pa.array([bytes(r["v"]) for r in trial]), dims)), near, weight, count)
    shared = spark.sparkContext.broadcast(hashing)  # dims x tables x projections numbers

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = shared.value
                keys = own.keys(own.cells(lifted(_matrix(batch.column("v"), dims)))[0])
                offs = pa.array((np.arange(len(keys) + 1) * own.tables).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("v"), pa.ListArray.from_arrays(offs, pa.array(keys.ravel().view(np.int64)))], names=["class", "v", "keys"])

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = shared.value
                keys = own.probe_keys(level(_matrix(batch.column("v"), dims))).reshape(batch.num_rows, -1)
                offs = pa.array((np.arange(len(keys) + 1) * keys.shape[1]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("class"), pa.ListArray.from_arrays(offs, pa.array(keys.ravel().view(np.int64)))], names=["class", "keys"])

    index = classes.select("class", "v").mapInArrow(entries, "class long, v binary, keys array<long>")
    index = index.select("class", "v", F.explode("keys").alias("key"))
    full = materialise(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "full-buckets")
    asked = classes.where("asked").select("class", "v")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count * TABLES // BLOCK))
    one = F.lit(1)
    block = F.pmod(F.xxhash64("class", F.lit(1)), F.coalesce("blocks", one)).cast("int")
    part = F.pmod(F.xxhash64("key", "block"), F.lit(parts)).cast("int")
    wanted = asked.mapInArrow(probes, "class long, keys array<long>").select("class", F.explode("keys").alias("key"))
    wanted = wanted.join(full, "key", "left").select("class", "key", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", one) - 1)).alias("block"))
    wanted = materialise(wanted.withColumn("part", part).groupBy("part", "class").agg(F.collect_set("key").alias("keys")), "wanted")
    # a part has as many shares as its own queries need
    shares = materialise(wanted.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("shares")), "shares")
    wanted = wanted.join(shares, "part").withColumn("share", F.pmod(F.xxhash64("class", F.lit(2)), "shares").cast("int")).drop("shares")
    wanted = wanted.join(asked, "class")
    index = index.join(full, "key", "left").withColumn("block", block).withColumn("part", part).join(shares, "part")
    index = index.select("part", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "key", "class", "v")

    def ranked(queries: pa.Table, entries: pa.Table) -> pa.Table:
        """The k + 1 nearest of each query among the entries of its buckets; each bucket meets only the queries that want it."""
        out: list[tuple] = []
        if queries.num_rows and entries.num_rows:
            ids, x, keys = entries["class"].to_numpy(), _matrix(entries["v"], dims), entries["key"].to_numpy()
            order = np.argsort(keys, kind="stable")
            ids, x, keys = ids[order], x[order], keys[order]
            buckets, low = np.unique(keys, return_index=True)
            high = np.append(low[1:], len(keys))
            q, of = _matrix(queries["v"], dims), queries["class"].to_numpy()
            wants = queries["keys"].combine_chunks()
            wanting = np.repeat(np.arange(len(q)), np.diff(wants.offsets.to_numpy()))
            key = wants.flatten().to_numpy()
            at = np.minimum(np.searchsorted(buckets, key), len(buckets) - 1)
            there = np.flatnonzero(buckets[at] == key)
            there = there[np.argsort(at[there], kind="stable")]
            edge = np.searchsorted(at[there], np.arange(len(buckets) + 1))
            near: list[list[np.ndarray]] = [[] for _ in range(len(q))]
            for b in range(len(buckets)):
                mine = wanting[there[edge[b] : edge[b + 1]]]
                entry = np.arange(low[b], high[b])
                for i in range(0, len(mine), 256):
                    scores = q[mine[i : i + 256]] @ x[entry].T
                    if len(entry) > 2 * (k + 1):
                        cut = np.partition(scores, len(entry) - (k + 1), axis=1)[:, len(entry) - (k + 1)]
                        # with room for the rounding of the product, so that equal scores stay together
                        some = scores >= cut[:, None] - SLACK * longest
                    else:
                        some = np.ones(scores.shape, bool)
                    for j, own in zip(mine[i : i + 256].tolist(), some, strict=True):
                        near[j].append(entry[own])
            for j, lists in enumerate(near):
                if lists:
                    own = np.concatenate(lists)
                    _, once = np.unique(ids[own], return_index=True)  # tables may give one class several times
                    own = own[once]
                    exact = np.einsum("j,ij->i", q[j], x[own])
                    pick = np.lexsort((ids[own], -exact))[: k + 1]
                    out += zip([of[j]] * len(pick), ids[own[pick]], exact[pick], strict=True)
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table({"query": pa.array(cols[0], pa.int64()), "class": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    found = wanted.groupBy("part", "share").cogroup(index.groupBy("part", "share")).applyInArrow(ranked, "query long, class long, score double")
    found = materialise(best(found), "nearest")
    # queries whose buckets held too few vectors are compared with all
    total = least.select(F.sum(F.size("members"))).first()[0]
    enough = found.join(least, "class").groupBy("query").agg(F.sum(F.size("members")).alias("n")).where(F.col("n") >= min(k + 1, total)).select(F.col("query").alias("class"))
    short = materialise(asked.join(enough, "class", "left_anti"), "short")
    n_short = short.count()
    if n_short:
        found = found.join(short.select(F.col("class").alias("query")), "query", "left_anti")
        for turn in range(-(-n_short // QUERIES)):
            few = short.where(F.pmod(F.xxhash64("class"), F.lit(-(-n_short // QUERIES))) == turn).collect()
            found = found.union(against_all(few))
    # classes back to vectors: the k + 1 nearest of a query class serve all its members
    each = found.join(least, "class").select("query", "score", F.explode("members").alias("vec_id"))
    each = each.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1)
    # written, so that the join deals both sides anew and a hot class's queries can be split
    each = materialise(each, "answers")
    asking = member.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("class").alias("query"))
    pairs = asking.join(each, "query").where("query_id <> vec_id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
