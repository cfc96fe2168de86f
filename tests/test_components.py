"""Strongly connected components and cycles against a search on the driver."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import graph


def reached(start, ahead):
    seen, left = set(), [start]
    while left:
        for n in ahead.get(left.pop(), ()):
            if n not in seen:
                seen.add(n)
                left.append(n)
    return seen


def expected(edges):
    ahead = {}
    for a, b in edges:
        if a != b:
            ahead.setdefault(a, set()).add(b)
    ways = {n: reached(n, ahead) for n in {x for e in edges for x in e}}
    parts = {n: frozenset(m for m in ways[n] if n in ways[m]) for n in ways}
    return {n: min(p) for n, p in parts.items() if len(p) > 1}


def found(spark, edges, one_task):
    rows = graph.components(spark.createDataFrame(edges, "src string, dst string"), one_task).collect()
    assert len(rows) == len({r.node for r in rows})
    return {r.node: r.component for r in rows}


def chain(prefix, n, close=False):
    names = [f"{prefix}{i:04d}" for i in range(n)]
    return [*zip(names, names[1:], strict=False), *([(names[-1], names[0])] if close else [])]


CASES = {
    "empty": [],
    "chain": chain("a", 40),
    "pair and loop": [("a", "b"), ("b", "a"), ("c", "c"), ("a", "b")],
    "ring": chain("r", 57, close=True),
    "star of rings": [e for i in range(5) for e in [("hub", f"x{i}"), (f"x{i}", f"y{i}"), (f"y{i}", "hub")]],
    "rings in a row": [*chain("a", 9, close=True), ("a0003", "b0001"), *chain("b", 12, close=True), ("b0004", "c0000"), *chain("c", 20), ("c0007", "d"), ("d", "e"), ("e", "d")],
    "eight": [*chain("a", 6, close=True), ("a0002", "z1"), ("z1", "z2"), ("z2", "a0002")],
    "ladder": [("p0", "p1"), ("q0", "q1"), ("p0", "q0"), ("p1", "q1"), ("p1", "p2"), ("q1", "q2"), ("p2", "q2"), ("q2", "x"), ("x", "p2")],
    "all with all": [(a, b) for a in "abcd" for b in "abcd"],
}


@pytest.mark.parametrize("case", CASES)
def test_search_in_a_task(case):
    label = graph.parts_of([e for e in CASES[case] if e[0] != e[1]])
    parts = {}
    for node, own in label.items():
        parts.setdefault(own, []).append(node)
    assert {n: min(p) for p in parts.values() if len(p) > 1 for n in p} == expected(CASES[case])


def test_components_in_spark(spark):
    """All cases as one graph, by turns in Spark alone, and with a task for what a few turns leave."""
    edges = [(f"{case}/{a}", f"{case}/{b}") for case, own in CASES.items() for a, b in own]
    r = random.Random(4)
    edges += [(f"r{g}/{r.randrange(30):02d}", f"r{g}/{r.randrange(30):02d}") for g, n in enumerate((24, 34, 50)) for _ in range(n)]
    assert found(spark, edges, 0) == found(spark, edges, 40) == found(spark, edges, 10_000) == expected(edges)
    assert found(spark, [], 0) == {}


def test_long_chain_with_a_ring_at_its_end(spark):
    n = 30_000
    name = lambda c: F.format_string("n%06d", c)
    edges = spark.range(n).select(name(F.col("id")).alias("src"), name(F.when(F.col("id") == n - 1, n - 5_000).otherwise(F.col("id") + 1)).alias("dst"))
    rows = graph.components(edges, 1_000).groupBy("component").agg(F.count("*").alias("n")).collect()
    assert [(r.component, r.n) for r in rows] == [(f"n{n - 5_000:06d}", 5_000)]


def test_rings(spark):
    edges = [("b", "C"), ("C", "a"), ("a", "b"), ("a", "x"), ("x", "y"), ("y", "a"), ("tail", "a"), ("a", "end"), ("u", "v"), ("v", "u")]
    rows = graph.rings(spark.createDataFrame(edges, "src string, dst string")).collect()
    assert sorted(r.ring for r in rows) == [["C", "a", "b"], ["a", "x", "y"], ["u", "v"]]


def test_every_ring_is_one(spark):
    r = random.Random(7)
    edges = list({(f"n{r.randrange(12)}", f"n{r.randrange(12)}") for _ in range(40)})
    rows = [x.ring for x in graph.rings(spark.createDataFrame(edges, "src string, dst string")).collect()]
    known = set(edges)
    assert rows and all(e in known for ring in rows for e in zip(ring, [*ring[1:], ring[0]], strict=True))
    assert len({tuple(x) for x in rows}) == len(rows) and all(min(x) == x[0] and len(set(x)) == len(x) > 1 for x in rows)


def test_a_target_of_half_of_all_links_is_split(spark):
    n = 60_000
    target = F.when(F.col("id") % 2 == 0, "Hub").otherwise(F.concat(F.lit("n"), F.col("id") % 50))
    links = spark.range(n).select(F.concat(F.lit("s"), F.col("id")).alias("src"), target.alias("target"))
    own = spark.createDataFrame([("x/hub.md",), *((f"y/n{i}.md",) for i in range(40))], "path string")
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20k",
    }
    former = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = graph.resolved(links.repartition(8), own)
        got = {r.dst: r.n for r in rows.groupBy("dst").agg(F.count("*").alias("n")).collect()}
        rows.collect()
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in former.items():
            spark.conf.set(k, v)
    assert got["x/hub.md"] == n // 2 and got["y/n1.md"] == n // 50 and got[None] == n // 2 - 20 * (n // 50)
    assert "skew=true" in plan
