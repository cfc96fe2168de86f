import json

import pytest
from pyspark.sql import functions as F

from corvane.streaming import sessions as S


def run(events):
    a = S.Activity()
    for e in events:
        a.absorb(*e)
    return a


def test_capture_window():
    turns = [("turn",)] * 20
    a = run([*turns, ("capture", "", "c1")])
    assert (a.turns, a.edits) == (0, 0)
    a = run([*turns, ("capture", "", "c1"), *[("turn",)] * 7, ("edit", "a"), ("edit", "b"), ("edit", "a")])
    assert (a.turns, a.edits) == (7, 2)
    a = run([*turns, ("capture", "", "c1"), ("turn",), ("failed", "", "c1")])
    assert a.turns == 21
    a = run([("turn",), ("capture", "", "c1"), ("turn",), ("capture", "", "c2"), ("turn",), ("failed", "", "c1")])
    assert a.turns == 1
    a = run([("turn",), ("capture", "", "c1"), ("turn",), ("capture", "", "c2"), ("turn",), ("failed", "", "c1"), ("failed", "", "c2")])
    assert a.turns == 3 and S.Activity.load(a.dump()) == a


@pytest.mark.parametrize(("turns", "edits", "early", "want"), [(11, 4, False, False), (12, 0, False, True), (0, 5, False, True), (6, 0, False, False), (6, 0, True, True), (0, 3, True, True)])
def test_due(turns, edits, early, want):
    assert S.due(turns, edits, None, early) is want
    assert S.due(12, 0, 599) is False and S.due(12, 0, 600) is True


def test_held_signal_goes_out_later_whatever_the_counts():
    state: dict = {}
    assert not S.decide(state, S.Activity(turns=12), 0, deliverable=False) and state["pending"]
    assert S.decide(state, S.Activity(turns=1), 1, deliverable=True) and state == {"pending": False, "last_signal": 1, "signals": 1}
    assert not S.decide(state, S.Activity(turns=12), 2, deliverable=True)


def test_transcripts():
    call = lambda name, i, **kw: {"type": "tool_use", "id": i, "name": name, "input": kw}
    lines = [
        json.dumps({"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "x"}, call("Edit", "1", file_path="a.py")]}}),
        json.dumps({"type": "response_item", "payload": {"type": "message", "role": "assistant"}}),
        json.dumps({"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": json.dumps({"cmd": "*** Begin Patch"})}}),
        "not json",
        json.dumps({"type": "assistant", "message": {"content": [call("mcp__x__capture_note", "c")]}}),
        json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "c", "is_error": True}]}}),
    ]
    events = S.transcript_events(lines)
    assert [e["kind"] for e in events] == ["turn", "edit", "turn", "edit", "turn", "capture", "failed"]
    a = run([(e["kind"], e["path"], e["call"]) for e in events])
    assert (a.turns, a.edits) == (3, 2)
    assert len(S.transcript_events(["{}"] * 12)) == 3


def test_stream_equals_batch(spark, tmp_path):
    rows = [(s, i, k, p, "") for s in ("a", "b") for i, (k, p) in enumerate([("turn", ""), ("edit", "x"), ("capture", ""), ("turn", ""), ("edit", "y"), ("edit", ""), ("capture", ""), ("failed", ""), ("turn", "")])]
    schema = "session string, seq long, kind string, path string, call string"
    df = spark.createDataFrame(rows, schema)
    df.where("seq < 5").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    df.where("seq >= 5").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = S.stream_counters(stream).writeStream.format("memory").queryName("counters").outputMode("update").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    batch = {r["session"]: (r["turns"], r["edits"], r["captures"]) for r in S.windows(df).collect()}
    last = {r["session"]: (r["turns"], r["edits"], r["captures"]) for r in spark.table("counters").groupBy("session").agg(F.max_by(F.struct("turns", "edits", "captures"), F.col("turns") + F.col("edits")).alias("m")).select("session", "m.*").collect()}
    assert batch == {"a": (2, 2, 1), "b": (2, 2, 1)} == last


def test_prompts(spark):
    rows = [("x" * 40, True), ("x" * 39, False), ("/" + "x" * 60, False), ("ok", False)]
    df = spark.createDataFrame(rows, "p string, want boolean")
    assert df.where(S.worth_recalling(F.col("p")) != F.col("want")).count() == 0


def test_counters_of_a_hot_session_are_those_of_a_walk(spark):
    """One session holds most rows, in many ranges; captures end on range borders and some are followed by failures."""
    kinds = F.element_at(F.array(*(F.lit(k) for k in ("turn", "edit", "capture", "failed", "hook", "capture", "turn"))), (F.abs(F.xxhash64("id")) % 7 + 1).cast("int"))
    session = F.when(F.col("id") % 5 > 0, "hot").when(F.col("id") % 10 == 0, F.concat(F.lit("s"), F.col("id") % 30))
    rows = spark.range(6000).select(session.alias("session"), (F.col("id") * 3).alias("seq"), kinds.alias("kind"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("p"), F.col("id") % 40)).otherwise("").alias("path"))
    rows = rows.where("not (kind = 'capture' and seq > 17900)")
    former = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.session: (r.turns, r.edits, r.captures) for r in S.windows(rows).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", former)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    by = {}
    for r in rows.orderBy("seq").collect():
        by.setdefault(r.session, []).append(r)
    expected = {}
    for name, own in by.items():
        held = [i for i, r in enumerate(own) if r.kind == "capture" and (i + 1 == len(own) or own[i + 1].kind != "failed")]
        after = own[held[-1] + 1 :] if held else own
        paths = {r.path for r in after if r.kind == "edit" and r.path}
        expected[name] = (sum(r.kind == "turn" for r in after), len(paths) + sum(r.kind == "edit" and not r.path for r in after), len(held))
    assert got == expected and len(got) == 5
