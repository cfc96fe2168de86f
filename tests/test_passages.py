import random

import pyarrow as pa

from corvane.operators import evaluate


def test_passages_are_found_as_by_search(spark):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choices(["the", "Straße", "und", "x", "zeppelin", "né", "\n"], k=n))
    texts = [None if i % 9 == 0 else say(rng.randint(0, 60)) for i in range(300)]
    items = [say(rng.randint(1, 6)) for _ in range(60)] + [texts[5], texts[5][-20:], "the", "", "nowhere at all", texts[7], texts[7]]
    want = {(d, i) for d, t in enumerate(texts) if t is not None for i, x in enumerate(items) if x in t}
    whole = pa.array(texts, pa.string())
    sought = evaluate.Passages(items)
    assert sought.held(whole) == want and len(want) > 500
    assert sought.held(whole.slice(20, 50)) == {(d - 20, i) for d, i in want if 20 <= d < 70}
    assert sought.held(pa.array([], pa.string())) == set() and sought.held(pa.array([None, "x"])) == {(1, i) for i, x in enumerate(items) if x in "x"}
    assert evaluate.Passages([]).held(whole) == set()

    d = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)], "path string, body string")
    cases = spark.createDataFrame([*((f"c{i}", x) for i, x in enumerate(items)), ("none", None)], "case_id string, text string")
    found = evaluate.holding(d, cases)
    assert sorted(map(tuple, found.collect())) == sorted((f"p{a}", f"c{b}") for a, b in want)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
