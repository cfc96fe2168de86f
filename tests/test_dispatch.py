import json
import os

import pytest

from corvane.streaming import dispatch as D
from corvane.streaming.sessions import Thresholds

TURN = json.dumps({"type": "assistant"})
CAPTURE = json.dumps({"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "c", "name": "x__capture_note", "parameters": {}}]}})
FAILED = json.dumps({"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "c", "is_error": True}]}})


def test_configuration_overlays_known_keys(tmp_path):
    got = D.overlaid(D.DEFAULTS, {"harvest": {"edits": 9}, "unknown": 1, "recall": 3})
    assert got["harvest"]["edits"] == 9 and got["harvest"]["assistant_turns"] == 12 and "unknown" not in got and got["recall"] == 3
    assert D.DEFAULTS["harvest"]["edits"] == 5 and D.overlaid(D.DEFAULTS, [1]) == D.DEFAULTS
    (tmp_path / "bad.json").write_text("{")
    assert D.configuration(str(tmp_path / "bad.json")) == D.DEFAULTS == D.configuration(None)


def test_tail_reads_from_an_offset(tmp_path):
    f = tmp_path / "t.jsonl"
    f.write_text("\n".join([TURN] * 3 + ["nope", "", CAPTURE, TURN]) + "\n")
    whole = D.tail(str(f), 0)
    assert (whole.activity.turns, whole.end) == (1, f.stat().st_size) and whole.captured == f.stat().st_size - len(TURN) - 1
    assert D.tail(str(f), whole.captured).activity.turns == 1
    assert D.tail(str(f), 10**9).activity.turns == 1  # the file became shorter: from the start
    assert D.tail(str(f), 0, most=len(TURN) + 1).activity.turns == 1
    f.write_text("\n".join([TURN] * 2 + [CAPTURE, FAILED]) + "\n")
    assert D.tail(str(f), 0).captured is None and D.tail(str(f), 0).activity.turns == 3
    f.write_text("{}\n" * 9)
    assert D.tail(str(f), 0).activity.turns == 2
    assert D.tail("/no/such", 7).end == 7 and D.tail(None, 7).end == 7


@pytest.fixture
def place(tmp_path):
    (tmp_path / "root").mkdir()
    (tmp_path / "work").mkdir()
    f = tmp_path / "t.jsonl"
    f.write_text("")
    now = [1000.0]
    d = D.Dispatcher(str(tmp_path / "root"), str(tmp_path / "states"), lambda q: f"notes for {q}", clock=lambda: now[0])

    def send(event, lines=(), cwd="work", **more):
        with f.open("a") as out:
            out.writelines(x + "\n" for x in lines)
        payload = {"hook_event_name": event, "session_id": "s/1", "cwd": str(tmp_path / cwd), "transcript_path": str(f)} | more
        got = d.handle(payload, stop_continues=more.pop("stop_continues", True))
        return bool(got and got["signalled"])

    return d, send, now, tmp_path


def test_delivery_cooldown_hold_and_watermark(place):
    d, send, now, _ = place
    assert not send("Stop", [TURN] * 11) and send("Stop", [TURN])
    assert not send("Stop", [TURN] * 12)  # within the cooldown, and the watermark has moved
    now[0] += 600
    assert send("Stop")
    assert not send("PreCompact", [TURN] * 6)  # cooldown again
    now[0] += 600
    assert not send("PreCompact") and d.read(d.file("s/1"))["pending"]  # due at lower thresholds, but it can't carry text: held
    assert send("UserPromptSubmit") and not d.read(d.file("s/1"))["pending"]
    now[0] += 600
    assert not send("PreCompact", [TURN] * 6) and not send("UserPromptSubmit", [CAPTURE])  # a capture settles what was held
    assert os.path.basename(d.file("s/1")) == "s_1.json"


def test_suppression_and_start(place):
    _, send, now, _ = place
    for more in ({"cwd": "root"}, {"permission_mode": "plan"}, {"stop_hook_active": True}, {"agent_id": "a"}):
        assert not send("Stop", [TURN] * 12, **more)
    assert send("Stop") and not send("Other", [TURN] * 12)
    now[0] += 600
    assert not send("SessionStart") and not send("Stop")  # a start moves the watermark


def test_no_signal_without_saved_state(place, monkeypatch):
    d, send, _, _ = place
    monkeypatch.setattr(d, "write", lambda *a: False)
    assert not send("Stop", [TURN] * 12)


def test_recall(place):
    d, _, _, tmp = place
    hook = lambda e, **k: D.Hook(e, 0.0, **k)
    prompt = "please explain how the retrieval index is built"
    assert d.query({"prompt": prompt}, hook("UserPromptSubmit")) == prompt == d.query({"user_prompt": prompt}, hook("UserPromptSubmit"))
    assert d.query({"prompt": prompt, "source": "system"}, hook("UserPromptSubmit")) == "" == d.query({"prompt": "ok!"}, hook("UserPromptSubmit"))
    assert d.query({"prompt": prompt}, hook("UserPromptSubmit", in_corpus=True)) == "" == d.query({"prompt": prompt}, hook("Stop"))
    (tmp / "my-big_repo/.git").mkdir(parents=True)
    (tmp / "my-big_repo/.git/HEAD").write_text("ref: refs/heads/fix-it\n")
    assert d.query({"cwd": str(tmp / "my-big_repo")}, hook("SessionStart")) == "my big repo fix it"


def test_old_states_go(place):
    d, send, now, tmp = place
    send("Stop")
    old = tmp / "states/old.json"
    old.write_text("{}")
    os.utime(old, (0, 0))
    now[0] = 40 * 86_400.0
    send("SessionStart")
    assert not old.exists()


ROWS = "session string, seq long, kind string, path string, call string, event string, at double, stop_continues boolean, in_corpus boolean, plan boolean, extended boolean, agent boolean"


def rows_of(session, kinds):
    out = []
    for i, k in enumerate(kinds):
        hook = k in ("Stop", "UserPromptSubmit", "PreCompact", "SessionStart")
        out.append((session, i, "hook" if hook else k, "", "", k if hook else None, float(i * 100), session != "b", session == "c", False, False, False))
    return out


def test_stream_signals_equal_batch(spark, tmp_path):
    kinds = ["turn"] * 12 + ["Stop"] + ["edit"] * 5 + ["Stop", "UserPromptSubmit", "turn", "capture", "turn", "UserPromptSubmit", "PreCompact"] + ["turn"] * 13 + ["Stop", "UserPromptSubmit"]
    df = spark.createDataFrame([r for s in "abc" for r in rows_of(s, kinds)], ROWS)
    batch = sorted(tuple(r) for r in D.signals(df).collect())
    assert {r[0] for r in batch} == {"a", "b"} and [r[6] for r in batch if r[0] == "a"] == list(range(1, 1 + sum(r[0] == "a" for r in batch)))
    df.where("seq < 15").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    df.where("seq >= 15").coalesce(1).write.parquet(f"{tmp_path}/in/2")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        q = D.stream_signals(stream).writeStream.format("memory").queryName("told").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert sorted(tuple(r) for r in spark.table("told").collect()) == batch


def test_recalled_notes_for_prompts(spark):
    docs = spark.createDataFrame([("a.md", "Alpha", "", "the retrieval index is built from postings"), ("b.md", "Beta", "", "something else")], "path string, title string, meta string, body string")
    hooks = spark.createDataFrame([("s", 1, "please explain how the retrieval index is built", None, False), ("s", 2, "ok", None, False), ("s", 3, "please explain how the retrieval index is built", "system", False)], "session string, seq long, prompt string, source string, in_corpus boolean")
    assert [(r["session"], r["seq"], r["rank"], r["path"]) for r in D.recalled(hooks, docs).collect()] == [("s", 1, 1, "a.md")]


def test_thresholds_from_configuration():
    assert D.thresholds(D.overlaid(D.DEFAULTS, {"harvest": {"edits": 2}})) == Thresholds(edits=2)
