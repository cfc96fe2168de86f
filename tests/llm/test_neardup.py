import random
import re

import pytest

from corvane.llm import components, neardup


def sets_of(docs):
    out = {}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for d, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower))
        out[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def brute(docs):
    sets = sets_of(docs)
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(1, 6)))
    docs = [(i, " ".join(word() for _ in range(rng.randint(20, 120)))) for i in range(40)]
    for i in range(40, 120):  # chains of near copies
        w = docs[rng.choice([3, 7, i - 1])][1].split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = word()
        docs.append((i, " ".join(w)))
    docs += [(200, None), (201, ""), (202, " \n\t"), (203, "One Two"), (204, "one two"), (205, "one"), (206, "é É"), (207, docs[5][1].upper()), (208, " ".join(["same"] * 400))]
    return docs


@pytest.mark.parametrize("block", [neardup.BLOCK, 3])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    docs = corpus(2)
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, d1 int, key string")
    rows = neardup.near_duplicates(df).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got == brute(docs)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_large_group_around_the_threshold(spark, monkeypatch):
    """Many pairs just over and just under: what pivots leave open is settled in blocks."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    monkeypatch.setattr(neardup, "PIVOTS", 2)
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    docs = []
    for i in range(140):
        w = list(base)
        for _ in range(rng.randint(2, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    rows = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got == brute(docs)
    assert 1 < len({c for _, c in got.values()}) < 140


@pytest.mark.parametrize("order", [(0, 1, 2, 3), (1, 0, 3, 2), (3, 1, 2, 0)])
def test_rows_of_one_id_with_different_texts(spark, order):
    rng = random.Random(3)
    a, b = ([f"{c}{rng.randrange(10**6)}" for _ in range(60)] for c in "ab")
    near = lambda w: " ".join(w[:-1] + ["other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b))]
    df = spark.createDataFrame([rows[i] for i in order], "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 1}


def test_block_links_join_all_labels_once():
    """A block gives fewer links than labels, and as many as it takes."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    n, same = 40, neardup.MINIMA * neardup.BITS // 8
    items = [np.sort(rng.choice(10**6, 50, replace=False).astype(np.uint64)) for _ in range(2)]
    table = pa.table(
        {
            "node": pa.array(range(n)), "label": pa.array(range(n)), "n_shingles": pa.array([50] * n), "bits": pa.array([bytes([i % 2 * 255]) * same for i in range(n)]),
            "bands": pa.array([[7, i % 2] for i in range(n)]), "items": pa.array([items[i % 2].tobytes() for i in range(n)]),
        }
    )
    links = neardup.block_links(7, [table.slice(0, 10), table])
    root = list(range(n))
    for a, b in links:
        x, y = root[a], root[b]
        root = [x if r == y else r for r in root]
    assert len(links) == n - 2 and len(set(root)) == 2 and len({root[i] for i in range(0, n, 2)}) == 1
    assert neardup.block_links(8, [table.slice(0, 10), table]) == []


def test_null_ids_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    rows = sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect())
    assert rows == [("1", 1, True), ("1", 1, True), ("2", 1, False), ("None", None, True)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 105), (105, 101)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 105: 100}
