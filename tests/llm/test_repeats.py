import hashlib
import random
from collections import Counter

import pytest

from corvane.llm import repeats


def brute_starts(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    return [[i for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1] for t in texts]


def brute(docs, length=repeats.LENGTH):
    data = [(d, (t or "").encode()) for d, t in docs]
    starts = brute_starts([b for _, b in data], length)
    out = []
    for (doc, b), own in zip(data, starts, strict=True):
        gone = set()
        for i in own:
            gone |= set(range(i, i + length))
        spans = sum(1 for i in gone if i - 1 not in gone)
        kept = bytes(b[i] for i in range(len(b)) if i not in gone)
        out.append((doc, len(b), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(30))
def test_index_marks_what_brute_force_marks(seed):
    rng = random.Random(seed)
    letters = "ab" if seed % 3 else "abcdef"
    stock = ["".join(rng.choices(letters, k=rng.randint(5, 60))) for _ in range(6)]
    texts = ["".join(rng.choices(stock, k=rng.randint(1, 6))).encode() for _ in range(rng.randint(1, 12))]
    length = rng.choice([3, 8, 20])
    got = [[i for i, f in enumerate(fl) if f] for fl in repeats.repeated_starts(texts, length)]
    assert got == brute_starts(texts, length)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(2, 8)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(4)]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(1, 50))) for _ in range(rng.randint(1, 3))]
        if i % 3 == 0:
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        docs.append((i, " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "a" * 900), (103, "ab" * 300), (104, "x" * 199), (105, docs[3][1]), (3, docs[3][1]), (106, "é" * 250), (None, docs[0][1])]
    return docs


@pytest.mark.parametrize("most", [repeats.MOST_CONTEXTS, 1])
def test_query_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_CONTEXTS", most)  # 1: all anchors by counting
    docs = corpus(5)
    df = spark.createDataFrame([(d, t, "row", 1) for d, t in docs], "doc_id long, text string, row string, r1 int")
    got = repeats.remove_repeats(df).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute(docs)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert repeats.remove_repeats(df).count() == 0


def test_very_long_texts(spark):
    rng = random.Random(3)
    long = "".join(rng.choices("abcdefgh ", k=1_500_000))
    part = long[700_000:700_260]
    df = spark.createDataFrame([(1, long), (2, "x" + part + "y"), (3, "z" * 150)], "doc_id long, text string")
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in repeats.remove_repeats(df).collect()}
    assert rows == {1: (1_500_000, 260, 1), 2: (262, 260, 1), 3: (150, 0, 0)}
