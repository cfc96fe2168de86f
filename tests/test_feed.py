import json
import os

from corvane.functions.parse import fields, notes
from corvane.operators import index, segments
from corvane.sources import feed, transcripts
from corvane.streaming import transcripts as T


def put(root, path, text, at=None):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "w", encoding="utf-8") as f:
        f.write(text)
    if at:
        os.utime(full, ns=(at, at))


def batches(stream, checkpoint):
    """Rows of each batch that is there now, by number."""
    got = {}
    query = stream.writeStream.foreachBatch(lambda b, n: got.__setitem__(n, b.collect())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return got


def test_changes_are_given_once(spark, tmp_path):
    root, log, ck = f"{tmp_path}/notes", f"{tmp_path}/log", f"{tmp_path}/ck"
    put(root, "a.md", "# A\n\nalpha")
    put(root, "x/b.md", "# B\n\nbeta")
    put(root, "x/.hidden.md", "no")
    put(root, "x/c.txt", "no")
    read = lambda: sorted((r["path"], r["change"], r["content"]) for rows in batches(feed.changes(spark, root, log), ck).values() for r in rows)
    assert read() == [("a.md", "added", "# A\n\nalpha"), ("x/b.md", "added", "# B\n\nbeta")]
    assert read() == []
    put(root, "a.md", "# A\n\nalpha two")
    put(root, "y/_d.MD", "﻿new")
    os.remove(f"{root}/x/b.md")
    assert read() == [("a.md", "changed", "# A\n\nalpha two"), ("x/b.md", "removed", None), ("y/_d.MD", "added", "new")]
    os.utime(f"{root}/a.md", ns=(1, 1))
    assert read() == [("a.md", "changed", "# A\n\nalpha two")]


def test_a_restart_in_the_middle_repeats_the_same_batch(spark, tmp_path):
    root, log, ck = f"{tmp_path}/notes", f"{tmp_path}/log", f"{tmp_path}/ck"
    put(root, "a.md", "one")

    def fail(batch, number):
        batch.collect()
        raise RuntimeError("lost")

    query = feed.changes(spark, root, log).writeStream.foreachBatch(fail).option("checkpointLocation", ck).trigger(availableNow=True).start()
    try:
        query.awaitTermination(120)
        raise AssertionError
    except Exception as e:
        assert "lost" in str(e)
    put(root, "b.md", "two")
    again = [sorted(r["path"] for r in rows) for _ in range(3) for rows in batches(feed.changes(spark, root, log), ck).values()]
    assert [x for x in again if x] == [["a.md"], ["b.md"]]


def test_only_shards_that_differ_are_written(tmp_path):
    root, log = f"{tmp_path}/notes", feed.Log(f"{tmp_path}/log")
    for i in range(30):
        put(root, f"f{i}/n.md", "x")
    assert log.follow(root) == 1 == log.follow(root)
    put(root, "f3/m.md", "y")
    assert log.follow(root) == 2
    assert [n for n in os.listdir(f"{log.at}/shards") if n.startswith("2-")] == [f"2-{feed.shard_of('f3')}.json"]


def test_the_index_follows_a_folder(spark, tmp_path):
    root = f"{tmp_path}/notes"
    put(root, "a.md", "# A\n\nalpha")
    put(root, "b.md", "---\ntype: note\n---\n# B\n\nbeta")
    own = segments.Segments(spark, f"{tmp_path}/index")
    empty = spark.createDataFrame([], "path string, title string, meta string, body string")
    own.build(empty)

    def follow():
        rows = feed.changes(spark, root, f"{tmp_path}/log")
        own.follow_files(rows, f"{tmp_path}/ck").awaitTermination(180)

    follow()
    assert {r["term"]: r["df"] for r in own.open().terms.collect()} == {"a": 1, "alpha": 1, "b": 1, "beta": 1, "note": 1}
    os.remove(f"{root}/a.md")
    put(root, "c.md", "# C\n\nbeta")
    follow()
    assert {r["term"]: r["df"] for r in own.open().terms.collect()} == {"b": 1, "beta": 2, "note": 1, "c": 1}
    live = index.live(index.tokenised(fields(notes(spark.createDataFrame([("b.md", "---\ntype: note\n---\n# B\n\nbeta"), ("c.md", "# C\n\nbeta")], "path string, content string")))))
    assert sorted(map(tuple, own.open().trigrams.collect())) == sorted(map(tuple, live.trigrams.collect()))


def turn(*content):
    return json.dumps({"type": "assistant", "message": {"role": "assistant", "content": [{"type": "text", "text": "x"}, *content]}})


def edit(path, name="Edit"):
    return {"type": "tool_use", "id": "t", "name": name, "input": {"file_path": path}}


def capture(call):
    return turn({"type": "tool_use", "id": call, "name": "mcp__brain__capture_note", "input": {"title": "t"}})


def failed(call):
    return json.dumps({"type": "user", "message": {"role": "user", "content": [{"type": "tool_result", "tool_use_id": call, "is_error": True}]}})


def codex(arguments):
    return json.dumps({"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": arguments}})


def counts(spark, lines):
    rows = [(s, i, x) for s, own in lines.items() for i, x in enumerate(own)]
    found = T.events(spark.createDataFrame(rows, "session string, seq long, line string"))
    return {r["session"]: (r["turns"], r["edits"], r["captures"], r["last_capture"]) for r in T.activity(found).collect()}


def test_lines_to_activity(spark):
    deep = {"type": "assistant"}
    for _ in range(12):
        deep = {"a": [deep]} if _ % 2 else {"a": deep}
    patch = json.dumps({"command": ["apply_patch", "*** Begin Patch\n*** Update File: f.c\n"]})
    got = counts(
        spark,
        {
            "a": [turn(edit("x")), turn(edit("x")), turn(edit(" y ")), turn(edit(""), edit(3))],
            "b": [json.dumps({"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": []}}), codex(patch), codex(patch), codex("*** Begin Patch"), codex('{"path": "f"}'), codex('["apply_patch"]')],
            "c": [turn(), capture("k1"), turn(edit("z")), failed("k1"), turn()],
            "d": [turn(), capture("k1"), turn(edit("z")), capture("k2"), failed("k2"), turn(edit("w"))],
            "e": ["{}", "[1]", "broken", "{\"x\": 1}", "7", "", "  "],
            "f": [json.dumps({"a": {"a": [deep]}}), json.dumps(deep), json.dumps({"role": "assistant", "success": False, "call_id": "k"})],
            "g": [json.dumps({"type": "assistant", "name": "capture_note", "input": None}), json.dumps({"name": "Write", "arguments": {"path": "p"}}), json.dumps({"name": "Write"})],
        },
    )
    assert got == {"a": (4, 4, 0, None), "b": (1, 3, 0, None), "c": (4, 1, 1, None), "d": (3, 2, 2, 1), "e": (1, 0, 0, None), "f": (1, 0, 0, None), "g": (0, 1, 1, 0)}


def test_a_tail_gives_each_line_once(spark, tmp_path):
    root, ck = f"{tmp_path}/sessions", f"{tmp_path}/ck"
    put(root, "s1.jsonl", turn() + "\n" + turn()[:20])
    put(root, "s2.jsonl", "one\n")
    put(root, "other.txt", "no\n")
    read = lambda: sorted((r["session"], r["line"]) for rows in batches(transcripts.lines(spark, root, stream=True), ck).values() for r in rows)
    assert read() == [("s1", turn()), ("s2", "one")]
    assert read() == []
    put(root, "s1.jsonl", turn() + "\n" + turn() + "\r\n\nmore\n")
    assert read() == sorted([("s1", turn()), ("s1", "more")])
    # a file that became shorter is another
    put(root, "s2.jsonl", "x\n")
    assert read() == [("s2", "x")]
    put(root, "s3.jsonl", "a\n" * 3)
    os.remove(f"{root}/s1.jsonl")
    assert read() == [("s3", "a")] * 3
    assert {r["line"] for r in transcripts.lines(spark, root).collect()} == {"x", "a"}


def test_a_stream_of_lines_to_events(spark, tmp_path):
    root = f"{tmp_path}/sessions"
    put(root, "s.jsonl", "\n".join([turn(edit("x")), capture("k")]) + "\n")
    rows = [r for b in batches(T.events(transcripts.lines(spark, root, stream=True)), f"{tmp_path}/ck").values() for r in b]
    assert [(r["turn"], r["edits"], r["captures"]) for r in sorted(rows, key=lambda r: r["seq"])] == [(True, ["x"], []), (True, [], ["k"])]
