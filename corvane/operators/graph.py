"""Link graph: resolution, edges, neighbourhoods, cycles, orphans, typed relations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as X
from ..functions.parse import meta_values
from . import store

INVERSES = list(C.RELATION_INVERSES.items())


def note_keys(notes: DataFrame) -> DataFrame:
    """key, path: notes by folded path without extension; of equal keys the last path."""
    return notes.groupBy(X.link_key(F.col("path")).alias("key")).agg(F.max("path").alias("hit"))


def stem_keys(notes: DataFrame) -> DataFrame:
    """key, path: notes by folded stem, only stems of one note."""
    return notes.groupBy(X.link_key(X.basename(F.col("path"))).alias("key")).agg(F.count("*").alias("n"), F.max("path").alias("hit")).where("n = 1").drop("n")


def resolved(targets: DataFrame, notes: DataFrame, assets: DataFrame | None = None, column: str = "target") -> DataFrame:
    """Add ``dst`` (a note) and ``asset``: by path first, then by a name that is unique.

    Targets are reduced to distinct ones, which are looked up and written; the
    rows then meet that table, so that a target of very many links is no hot
    key of the lookups, and its rows can be split in the last join. The notes
    are never broadcast, for which small files of theirs would be taken.
    """
    rows = store.written(targets, "targets")
    each = rows.select(F.col(column).alias("_target")).distinct()
    own = F.col("_target")
    each = each.withColumns({"_key": X.link_key(own), "_base": X.link_key(X.basename(F.regexp_replace(own, "/+$", "")))})
    each = each.join(note_keys(notes).select(F.col("key").alias("_key"), F.col("hit").alias("_by_path")).hint("merge"), "_key", "left")
    each = each.join(stem_keys(notes).select(F.col("key").alias("_base"), F.col("hit").alias("_by_stem")).hint("merge"), "_base", "left")
    each = each.withColumn("dst", F.coalesce("_by_path", "_by_stem"))
    if assets is None:
        each = each.withColumn("asset", F.lit(None).cast("string"))
    else:
        full = X.fold(F.regexp_replace(own, "^/+|/+$", ""))
        by_path = assets.groupBy(X.fold(F.col("path")).alias("_full")).agg(F.max("path").alias("_asset_path"))
        by_name = assets.groupBy(X.fold(X.basename(F.col("path"))).alias("_name")).agg(F.count("*").alias("_n"), F.max("path").alias("_asset_name")).where("_n = 1").drop("_n")
        each = each.withColumns({"_full": full, "_name": X.basename(full)}).join(by_path, "_full", "left").join(by_name, "_name", "left")
        each = each.withColumn("asset", F.when(F.col("dst").isNull(), F.coalesce("_asset_path", "_asset_name")))
    found = store.written(each.where("dst is not null or asset is not null").select("_target", "dst", "asset"), "resolved")
    return rows.join(found, F.col(column) == F.col("_target"), "left").drop("_target")


def link_rows(notes: DataFrame) -> DataFrame:
    """src, target: a row for each link, repeats too."""
    return notes.select(F.col("path").alias("src"), F.explode("links").alias("target"))


def link_targets(notes: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """src, target, dst, asset for each distinct link."""
    return resolved(link_rows(notes).distinct(), notes.select("path"), assets)


def unresolved(targets: DataFrame) -> DataFrame:
    return targets.where("dst is null and asset is null").select("src", "target").distinct()


def edges(targets: DataFrame) -> DataFrame:
    """src, dst: distinct links from note to note."""
    return targets.where("dst is not null").select("src", "dst").distinct()


def undirected(edges_: DataFrame) -> DataFrame:
    return edges_.union(edges_.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def related_in_order(start: DataFrame, edges_: DataFrame, depth: int) -> DataFrame:
    """path, distance, trail: notes within ``depth`` hops of the start notes (a column path), not these.

    Sorted by (distance, trail) they come as a breadth-first search finds them:
    the trail holds the folded names on the first way to a note.
    """
    if not 1 <= depth <= 3:
        raise ValueError("depth must be 1 to 3")
    both = undirected(edges_)
    own = lambda c: F.array(F.struct(X.fold(F.col(c)).alias("k"), F.col(c).alias("p")))
    seen = start.distinct().select("path", F.lit(0).alias("distance"), own("path").alias("trail"))
    front = seen
    for hop in range(1, depth + 1):
        step = both.join(front.select(F.col("path").alias("src"), "trail"), "src").select(F.col("dst").alias("path"), F.concat("trail", own("dst")).alias("trail"))
        front = step.join(seen.select("path"), "path", "left_anti").groupBy("path").agg(F.min("trail").alias("trail")).select("path", F.lit(hop).alias("distance"), "trail")
        seen = seen.unionByName(front)
    return seen.where("distance > 0").select("path", "distance", F.transform("trail", lambda x: x["k"]).alias("trail"))


def related(start: DataFrame, edges_: DataFrame, depth: int) -> DataFrame:
    """path, distance: notes within ``depth`` hops of the start notes (a column path), not these."""
    return related_in_order(start, edges_, depth).select("path", "distance")


def orphans(notes: DataFrame, edges_: DataFrame) -> DataFrame:
    """Notes without any link to or from a note; a link to itself counts."""
    linked = edges_.select(F.explode(F.array("src", "dst")).alias("path")).distinct()
    return notes.select("path").where((F.col("path") != "Home.md") & ~F.contains(F.col("path"), F.lit("/_template/"))).join(linked, "path", "left_anti")


def _joined(edges_: DataFrame, own: DataFrame, column: str) -> DataFrame:
    """Edges whose ``column`` is one of ``own`` (a column node)."""
    return edges_.join(own.select(F.col("node").alias(column)), column, "left_semi").select("src", "dst")


def _degrees(now: DataFrame) -> DataFrame:
    """node, ins, outs, and the only node before and after where there is but one."""
    ends = now.select(F.col("src").alias("node"), F.lit(None).cast("string").alias("p"), F.col("dst").alias("s"))
    ends = ends.union(now.select(F.col("dst").alias("node"), F.col("src").alias("p"), F.lit(None).cast("string").alias("s")))
    return ends.groupBy("node").agg(F.count("p").alias("ins"), F.count("s").alias("outs"), F.max("p").alias("p"), F.max("s").alias("s"))


def _shortened(now: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Edges without nodes that lie on no cycle's way or only hand one edge on, and node, p, s of the latter.

    Of nodes with one edge in and one out, those go whose hash of this turn is
    less than that of such nodes beside them, so no two neighbours go at once;
    the edge from the one before to the one after takes their place. On a long
    chain a third of the nodes goes in each turn.
    """
    degrees = store.written(_degrees(now).where("ins > 0 and outs > 0"), "degrees")
    rank = lambda c: F.struct(F.xxhash64(F.lit(turn), c), F.col(c))
    single = degrees.where("ins = 1 and outs = 1").select("node", "p", "s")
    beside = single.select(F.col("node").alias("beside"))
    low = single
    for c in ("p", "s"):
        low = low.join(beside, low[c] == beside["beside"], "left").where(F.col("beside").isNull() | (rank("node") < rank(c))).drop("beside")
    gone = store.written(low, "gone")
    kept = degrees.select("node").join(gone.select("node"), "node", "left_anti")
    inner = _joined(_joined(now, kept, "src"), kept, "dst")
    bridges = gone.select(F.col("p").alias("src"), F.col("s").alias("dst")).where("src <> dst")
    bridges = _joined(_joined(bridges, kept, "src"), kept, "dst")
    out = store.written(inner.union(bridges).distinct(), "shortened")
    store.delete(now.sparkSession, degrees.corvane_path)
    return out, gone


def _spread(now: DataFrame, label: DataFrame, jump: bool) -> DataFrame:
    """Labels (node, label) carried along the edges, the greatest of each node, until nothing changes."""
    spark = now.sparkSession
    while True:
        come = now.join(label.select(F.col("node").alias("src"), "label"), "src").select(F.col("dst").alias("node"), "label")
        new = label.unionByName(come).groupBy("node").agg(F.max("label").alias("label"))
        if jump:  # a label is a node from which a way leads here, and so is that node's own label
            above = label.select(F.col("node").alias("label"), F.col("label").alias("further"))
            new = new.join(above, "label", "left").select("node", F.greatest("label", "further").alias("label"))
        new = store.written(new, "labels")
        same = new.count() == label.count() and new.join(label, ["node", "label"], "left_anti").isEmpty()
        store.delete(spark, label.corvane_path)
        label = new
        if same:
            return label


def _coloured(now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node, label of some strongly connected components, and the edges that others may lie on.

    Forward, each node takes the greatest node that leads to it as its colour;
    backward, what leads to that node within its colour is its component. Each
    colour gives one, and no component crosses colours.
    """
    spark = now.sparkSession
    nodes = now.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    colour = _spread(now, store.written(nodes.select("node", F.col("node").alias("label")), "labels"), jump=True)
    of = lambda c, name: colour.select(F.col("node").alias(c), F.col("label").alias(name))
    within = store.written(now.join(of("src", "a"), "src").join(of("dst", "b"), "dst").where("a = b").select("src", "dst"), "within")
    back = within.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    own = _spread(back, store.written(colour.where("node = label"), "labels"), jump=False)
    rest = within.join(own.select(F.col("node").alias("src")), "src", "left_anti").join(own.select(F.col("node").alias("dst")), "dst", "left_anti")
    rest = store.written(rest.select("src", "dst"), "left")
    for done in (colour, within):
        store.delete(spark, done.corvane_path)
    return own, rest


def _followed(gone: DataFrame, label: DataFrame) -> DataFrame:
    """Labels of shortened nodes: that of the nodes before and after, if it is one; a lone node that they circle is its own."""
    of = lambda c, name: label.select(F.col("node").alias(c), F.col("label").alias(name))
    rows = gone.join(of("p", "a"), "p", "left").join(of("s", "b"), "s", "left").where("p = s or a = b")
    own = F.coalesce("a", "p")
    pair = lambda c: F.struct(F.col(c).alias("node"), own.alias("label"))
    both = F.when(F.col("a").isNull(), F.array(pair("node"), pair("p"))).otherwise(F.array(pair("node")))
    return rows.select(F.inline(both)).distinct()


def parts_of(edges_: list[tuple[str, str]]) -> dict[str, str]:
    """The strongly connected component of every node, by one of its nodes: one search, two stacks."""
    ahead: dict[str, list[str]] = {}
    for src, dst in edges_:
        ahead.setdefault(src, []).append(dst)
        ahead.setdefault(dst, [])
    order: dict[str, int] = {}
    label: dict[str, str] = {}
    undecided, borders = [], []
    for start in ahead:
        way = [] if start in order else [start]
        while way:
            node = way[-1]
            if node not in order:
                order[node] = len(order)
                undecided.append(node)
                borders.append(node)
            if ahead[node]:
                nxt = ahead[node].pop()
                if nxt not in order:
                    way.append(nxt)
                elif nxt not in label:
                    while order[borders[-1]] > order[nxt]:
                        borders.pop()
                continue
            way.pop()
            if borders[-1] == node:
                borders.pop()
                while node not in label:
                    label[undecided.pop()] = node
    return label


def _in_one_task(now: DataFrame) -> DataFrame:
    """node, label of all components; for edges of a checked number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [e for b in batches for e in zip(b.column("src").to_pylist(), b.column("dst").to_pylist(), strict=True)]
        label = parts_of(own)
        yield pa.RecordBatch.from_arrays([pa.array(list(label), pa.string()), pa.array(list(label.values()), pa.string())], names=["node", "label"])

    return store.written(now.select("src", "dst").coalesce(1).mapInArrow(run, "node string, label string"), "labels")


def components(edges_: DataFrame, one_task: int = 100_000) -> DataFrame:
    """node, component: nodes of strongly connected components of two nodes or more, by their least node.

    Chains are shortened and what lies on no cycle is left off until neither
    is possible; what remains is coloured, and both begin anew with what that
    leaves. As soon as ``one_task`` edges at most are left, a task searches
    them at once. Then the shortened nodes follow, the last ones first. Turns:
    logarithmic in the length of chains, but as many as the layers of a graph
    without cycles and chains, and as the longest of the shortest ways within
    a component.
    """
    spark = edges_.sparkSession
    now = store.written(edges_.where("src <> dst").select("src", "dst").distinct(), "edges")
    label = store.written(spark.createDataFrame([], "node string, label string"), "found")
    count, turns = now.count(), []

    def more(rows: DataFrame) -> DataFrame:
        new = store.written(label.unionByName(rows), "found")
        for done in (label, rows):
            store.delete(spark, done.corvane_path)
        return new

    while count > one_task:
        before, former = count, now
        now, gone = _shortened(former, len(turns))
        turns.append(gone)
        count = now.count()
        store.delete(spark, former.corvane_path)
        if count == before:
            found, rest = _coloured(now)
            label = more(found)
            store.delete(spark, now.corvane_path)
            now, count = rest, rest.count()
    if count:
        label = more(_in_one_task(now))
    store.delete(spark, now.corvane_path)
    for gone in reversed(turns):
        rows = store.written(_followed(gone, label), "followed")
        if rows.isEmpty():
            store.delete(spark, rows.corvane_path)
        else:
            label = more(rows)
        store.delete(spark, gone.corvane_path)
    least = label.groupBy("label").agg(F.min("node").alias("component"), F.count("*").alias("n")).where("n > 1")
    out = store.written(label.join(least, "label").select("node", "component"), "components")
    store.delete(spark, label.corvane_path)
    return out


def on_cycles(edges_: DataFrame) -> DataFrame:
    """src, dst, component: the edges that lie on a cycle of two nodes or more."""
    own = components(edges_)
    of = lambda c, name: own.select(F.col("node").alias(c), F.col("component").alias(name))
    return edges_.select("src", "dst").distinct().where("src <> dst").join(of("src", "component"), "src").join(of("dst", "b"), "dst").where("component = b").select("src", "dst", "component")


def closed_ways(edges_: list[tuple[str, str]]) -> list[list[str]]:
    """Cycles of one component: for every edge that leads back to a node on the way a search is on, that way.

    The search goes from the first name in folded order and takes names in that
    order; a cycle begins with its least name, and each comes once.
    """
    names = sorted({n for e in edges_ for n in e}, key=lambda n: (n.casefold(), n))
    number = {n: i for i, n in enumerate(names)}
    ahead: list[list[int]] = [[] for _ in names]
    for src, dst in edges_:
        ahead[number[src]].append(number[dst])
    waiting = [sorted(a, reverse=True) for a in ahead]
    came_from: list[int | None] = [None] * len(names)
    open_, seen, out = [False] * len(names), [False] * len(names), set()
    for start in range(len(names)):
        here: int | None = None if seen[start] else start
        while here is not None:
            seen[here] = open_[here] = True
            if not waiting[here]:
                open_[here] = False
                here = came_from[here]
                continue
            there = waiting[here].pop()
            if open_[there]:
                way, at = [], here
                while at != there:
                    way.append(names[at])
                    at = came_from[at]
                way = [names[there], *reversed(way)]
                first = way.index(min(way))
                out.add((*way[first:], *way[:first]))
            elif not seen[there]:
                came_from[there], here = here, there
    return [list(r) for r in sorted(out)]


def rings(edges_: DataFrame) -> DataFrame:
    """ring: the cycles, sought in each strongly connected component by itself; a task holds one component at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = lambda own: pa.RecordBatch.from_arrays([pa.array(closed_ways(own), pa.list_(pa.string()))], names=["ring"])
        now, own = None, []
        for batch in batches:
            for component, *edge in zip(*(batch.column(c).to_pylist() for c in ("component", "src", "dst")), strict=True):
                if component != now:
                    if own:
                        yield flush(own)
                    now, own = component, []
                own.append(tuple(edge))
        if own:
            yield flush(own)

    return on_cycles(edges_).select("component", "src", "dst").repartition("component").sortWithinPartitions("component").mapInArrow(run, "ring array<string>")


def cycles(edges_: DataFrame) -> list[list[str]]:
    """The rings on the driver, in order."""
    return sorted(r["ring"] for r in rings(edges_).collect())


def relation_rows(notes: DataFrame) -> DataFrame:
    """src, relation, raw, targets: a row for each value of a typed relation field."""

    def of(r: str) -> Column:
        return F.transform(meta_values(r), lambda v: F.struct(F.lit(r).alias("relation"), v.alias("raw")))

    each = F.concat(*map(of, C.RELATION_INVERSES))
    return notes.select(F.col("path").alias("src"), F.explode(each).alias("x")).select("src", "x.relation", "x.raw").withColumn("targets", X.links(F.col("raw")))


def relations(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid relations src, relation, dst; errors src, relation, target, issue)."""
    rows = relation_rows(notes)
    single = rows.where(F.size("targets") == 1).withColumn("target", F.col("targets")[0])
    found = resolved(single, notes.select("path"))
    issue = F.when(F.col("dst").isNull(), "dangling_target").when(F.col("dst") == F.col("src"), "self_relation")
    bad = rows.where(F.size("targets") != 1).select("src", "relation", F.col("raw").alias("target"), F.lit("target_must_be_one_wikilink").alias("issue"))
    bad = bad.unionByName(found.select("src", "relation", F.coalesce("dst", "target").alias("target"), issue.alias("issue")).where("issue is not null"))
    return found.where("dst is not null and dst <> src").select("src", "relation", "dst").distinct(), bad


def missing_inverses(relations_: DataFrame) -> DataFrame:
    """src, relation, dst, missing_inverse where the target doesn't declare the inverse."""
    inverse = F.create_map(*(F.lit(x) for pair in INVERSES for x in pair))
    want = relations_.withColumn("missing_inverse", inverse[F.col("relation")])
    have = relations_.select(F.col("src").alias("dst"), F.col("relation").alias("missing_inverse"), F.col("dst").alias("src"))
    return want.join(have, ["src", "dst", "missing_inverse"], "left_anti").select("src", "relation", "dst", "missing_inverse")


def redirects(notes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(redirect edges src, dst; findings path, issue, target)."""
    rows = notes.where("type = 'redirect'").select(F.col("path").alias("src"), "status", meta_values("redirect_to").alias("values_"))
    rows = rows.withColumn("targets", F.when(F.size("values_") == 1, X.links(F.col("values_")[0])).otherwise(F.array().cast("array<string>")))
    status = rows.where("status <> 'superseded'").select("src", F.lit("redirect_status_must_be_superseded").alias("issue"), F.lit("").alias("target"))
    arity = rows.where(F.size("targets") != 1).select("src", F.lit("redirect_to_must_be_one_wikilink").alias("issue"), F.lit("").alias("target"))
    one = resolved(rows.where(F.size("targets") == 1).withColumn("target", F.col("targets")[0]), notes.select("path"))
    kinds = notes.select(F.col("path").alias("dst"), F.col("type").alias("dst_type"))
    one = one.join(kinds, "dst", "left")
    issue = F.when(F.col("dst").isNull(), "redirect_target_missing").when(F.col("dst") == F.col("src"), "redirect_targets_self").when(F.col("dst_type") == "redirect", "redirect_chain")
    found = one.select("src", issue.alias("issue"), F.when(F.col("dst") == F.col("src"), "").otherwise(F.coalesce("dst", "target")).alias("target")).where("issue is not null")
    edges_ = one.where("dst is not null and dst <> src").select("src", "dst").distinct()
    return edges_, status.unionByName(arity).unionByName(found).withColumnRenamed("src", "path")


def outbound(targets: DataFrame) -> DataFrame:
    """path, resolved, missing: sorted distinct targets of each note."""
    hit = F.coalesce("dst", "asset")
    fold_sorted = lambda c: F.transform(F.array_sort(F.transform(c, lambda x: F.struct(X.fold(x).alias("k"), x.alias("v")))), lambda s: s["v"])
    each = targets.groupBy(F.col("src").alias("path")).agg(F.collect_set(hit).alias("r"), F.collect_set(F.when(hit.isNull(), F.col("target"))).alias("m"))
    return each.select("path", fold_sorted(F.col("r")).alias("resolved"), fold_sorted(F.col("m")).alias("missing"))


def links_at_risk(notes: DataFrame, canonical: str, retired: str, final_links: list[str]) -> DataFrame:
    """target: links of a note to be retired that the final note would not hold.

    Links are the same if they lead to the same note, or else by their folded
    text; those to the canonical note itself are safe.
    """
    asked = notes.sparkSession.createDataFrame([(x,) for x in final_links], "target string").withColumn("kept", F.lit(True))
    own = notes.where(F.col("path") == retired).select(F.explode("links").alias("target")).distinct().withColumn("kept", F.lit(False))
    found = resolved(own.unionByName(asked), notes.select("path"))
    found = found.withColumn("identity", X.fold(F.coalesce("dst", F.regexp_replace("target", r"\.md$", ""))))
    safe = found.where("kept").select("identity").distinct()
    at_risk = found.where(~F.col("kept") & (F.col("identity") != F.lit(canonical.casefold()))).join(safe, "identity", "left_anti")
    return at_risk.select("target").distinct().orderBy(X.fold(F.col("target")), "target")


def merge_context(notes: DataFrame, canonical: str, retired: str, final_links: list[str]) -> dict[str, list[str]]:
    """What a merge must know of the rest of the corpus; lists of one note's links and of its redirects."""
    at_risk = [r["target"] for r in links_at_risk(notes, canonical, retired, final_links).collect()]
    return {"links_at_risk": at_risk, "inbound": sorted((r["path"] for r in inbound_redirects(notes, retired).collect()), key=str.casefold)}


def inbound_redirects(notes: DataFrame, path: str) -> DataFrame:
    return redirects(notes)[0].where(F.col("dst") == path).select(F.col("src").alias("path"))


def hub_uncovered(notes: DataFrame, edges_: DataFrame) -> DataFrame:
    """path, type of notes that should link to a hub and don't."""
    hubs = notes.where("type = 'moc'").select(F.col("path").alias("dst"))
    covered = edges_.join(hubs, "dst", "left_semi").select(F.col("src").alias("path")).distinct()
    due = notes.where(~F.col("type").isin(*C.HUB_FREE_TYPES) & ~X.contains_any_prefix(F.col("path"), C.HUB_EXEMPT))
    return due.select("path", "type").join(covered, "path", "left_anti")

