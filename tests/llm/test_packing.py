import random
import zlib

import numpy as np
import pytest

from corvane.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["it's we'll DON'T x2y3 ½ ²", "naïve ﬁ Σας İstanbul", "<|endoftext|> hi", "a  b c\x85d", "", "é é 日本", "ª º ß ŉ Ǆ ſ", "\x00 a\x1cb", "word," * 50]


def test_ids_equal_the_library():
    t = packing.tokenizer(PATH)
    for s in ODD:
        assert t(s) == np.array(t.whole.encode(s, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("seed", range(8))
def test_plan_uses_all_and_fills_best(seed):
    rng = random.Random(seed)
    window = rng.choice([10, 64, 300])
    counts = {rng.randint(1, window - 1): rng.randint(1, 30) for _ in range(rng.randint(1, 20))}
    plan = packing.plan(dict(counts), window)
    used: dict = {}
    for times, use in plan:
        assert sum(k * n for k, n in use) <= window
        for k, n in use:
            used[k] = used.get(k, 0) + times * n
    assert used == counts


def test_fill_equals_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        counts = {rng.randint(1, 29): rng.randint(1, 3) for _ in range(4)}
        use = packing.fill(counts, 30)
        first = max(counts)
        sums = {first}
        for k, n in counts.items():
            for _ in range(n - (k == first)):
                sums |= {s + k for s in sums if s + k <= 30}
        assert sum(k * n for k, n in use.items()) == max(sums)
        assert all(n <= counts[k] for k, n in use.items())


def test_pieces_round_trip(spark):
    rng = random.Random(1)
    texts = [None, "", *ODD, " ".join(rng.choice(["alpha", "beta", "gamma,"]) for _ in range(6000))] + ["same text"] * 20
    docs = spark.createDataFrame([(i, t, 5, "x") for i, t in enumerate(texts)], "doc_id long, text string, length int, start string")
    rows = packing.pack(packing.token_pieces(docs, PATH)).toPandas()
    t = packing.tokenizer(PATH)
    for i, text in enumerate(texts):
        ids = np.frombuffer(t(text or ""), "<u4").tolist() + [1]
        own = rows[rows.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        for r in own.itertuples():
            assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.length.sum() <= 2048 and (g.offset == g.length.cumsum() - g.length).all()
    assert packing.pack(packing.token_pieces(docs.limit(0), PATH)).count() == 0


def test_null_ids_and_equal_rows_are_packed_each_by_itself(spark):
    long = " ".join(f"word{i}" for i in range(3000))
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "a b c"), (7, "a b c"), (7, long), (None, None)], "doc_id long, text string")
    rows = packing.pack(packing.token_pieces(docs, PATH)).collect()
    ids = lambda t: len(packing.tokenizer(PATH)(t)) // 4 + 1
    assert sum(r["length"] for r in rows) == 4 * ids("a b c") + ids(long) + 1
    assert sum(r["doc_id"] is None for r in rows) == 3 and len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
