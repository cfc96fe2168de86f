import math
import random

import numpy as np
import pytest

from corvane.llm import negatives


def brute(rows):
    kept = []
    for n, (i, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if i is not None and i % 7 == 0:
            label = (label + 1) % 10
        kept.append((math.inf if i is None else i, n, label, [math.floor(256 * x) for x in vector]))
    out = []
    for i, n, label, v in kept:
        if i == math.inf or i % 100:
            continue
        ranked = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, m, other) for j, m, other, w in kept if m != n and len(w) == len(v))
        for score, positive, *_ in [r for r in ranked if r[3] == label][:5]:
            p = -score
            fit = [(-s, j) for s, j, _, other in ranked if other != label and 30 * p <= -100 * s <= 90 * p][:10]
            out += [(i, positive, rank + 1, j, p, s) for rank, (s, j) in enumerate(fit)]
    name = lambda x: None if x == math.inf else x
    return sorted(((a, name(p), r, name(j), x, y) for a, p, r, j, x, y in out), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int"


def run(spark, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).selectExpr("*", "1 as rank", "2 as scores").coalesce(1)
    return sorted((tuple(r) for r in negatives.mine(negatives.marked(df)).collect()), key=str)


def made(n, dim, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i * 5, [float(np.float32(rng.gauss(0.3, 1) * spread)) for _ in range(dim)], rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize("rows,anchors", [(1024, 256), (16, 2)])
def test_negatives_equal_whole_sorts(spark, monkeypatch, rows, anchors):
    monkeypatch.setattr(negatives, "ROWS", rows)
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    table = made(220, 6, 3)
    got = run(spark, table)
    assert got == brute(table)
    assert len(got) > 300


def test_ties_repeats_nulls_and_odd_vectors(spark):
    table = made(60, 3, 4) + [(0, [1.0, 1.0, 1.0], 1), (100, [1.0, 1.0, 1.0], 1)] + [(k, [0.5, 0.5, 0.5], 2) for k in range(400, 420)]
    table += [(None, [0.5, 0.5, 0.5], 2), (None, [2.0, 2.0, 2.0], 1), (500, None, 1), (501, [1.0, None, 1.0], 1), (502, [1.0, float("nan"), 1.0], 1), (503, [1.0, float("inf"), 1.0], 1), (600, [1.0, 1.0, 1.0], None)]
    table += [(700, [1.0, 2.0], 1), (701, [2.0, 2.0], 2), (702, [0.5, 0.5], 3), (800, [], 1), (801, [], 2)]
    assert run(spark, table) == brute(table)


def test_large_components_are_exact(spark):
    table = [(i, [x * 1e9 for x in v], label) for i, v, label in made(40, 2, 6)] + [(900, [0.25, 0.5], 1)]
    schema = "vec_id long, embedding array<double>, label int"
    want = brute(table)
    limits = lambda r: (*r[:4], *(max(negatives.LONG[0], min(negatives.LONG[1], x)) for x in r[4:]))
    assert run(spark, table, schema) == sorted(map(limits, want), key=str)
    assert want


def test_empty_tables_and_lone_anchors(spark):
    assert run(spark, []) == []
    assert run(spark, [(100, [1.0], 1)]) == []
    assert run(spark, [(5, [1.0], 1), (6, [1.0], 2)]) == []
