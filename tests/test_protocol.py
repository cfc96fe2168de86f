import json
import threading
import time

import pytest

from corvane.service import protocol as P
from corvane.service import tools


class Fake:
    """Tools without Spark: ``read_note`` waits until it is let go."""

    def __init__(self):
        self.go, self.stopped, self.ran = threading.Event(), [], []
        self.spark = self
        self.sparkContext = self

    def cancelJobGroup(self, group):  # noqa: N802
        self.stopped.append(group)
        self.go.set()

    def call(self, name, arguments, deadline=30.0, group=None):
        self.ran.append(name)
        if name == "read_note":
            self.go.wait(5)
        if arguments.get("path") == "busy":
            raise FileExistsError("lock")
        if arguments.get("path") == "bad":
            raise tools.InputError("no")
        return {"name": name}


def request(i, method="ping", **params):
    return {"jsonrpc": "2.0", "id": i, "method": method} | ({"params": params} if params else {})


def call(i, name, **arguments):
    return request(i, "tools/call", name=name, arguments=arguments)


def run(messages, fake=None, between=None):
    fake, out = fake or Fake(), []
    desk = P.Desk(fake, lambda b: out.append(json.loads(b)))
    for m in messages:
        desk.take(m if isinstance(m, bytes) else json.dumps(m).encode())
        if between:
            between(fake, desk)
    fake.go.set()
    desk.close()
    return fake, out


def test_both_generations():
    _, out = run([request(1, "initialize", protocolVersion="2025-03-26"), request(2, "initialize", protocolVersion="x"), request(3, "server/discover"), request(4, "tools/list"), request(5, "tools/list", _meta={P.VERSION_KEY: P.PER_REQUEST})])
    by = {m["id"]: m["result"] for m in out}
    assert by[1]["protocolVersion"] == "2025-03-26" and by[2]["protocolVersion"] == P.NEGOTIATED[0]
    assert by[3]["supportedVersions"] == [P.PER_REQUEST] and by[3]["resultType"] == "complete"
    assert len(by[4]["tools"]) == 7 and "ttlMs" not in by[4] and by[5]["ttlMs"] and by[5]["_meta"]["serverInfo"] == P.SERVER


@pytest.mark.parametrize(
    ("message", "code"),
    [
        (b"{", -32700), (b'{"a": NaN}', -32700), (json.dumps({"x": "\ud800"}).encode(), -32700), (b"[" * 80 + b"]" * 80, -32700), (b'"' + b"x" * P.FRAME_BYTES + b'"', -32700),
        ([], -32600), ({"id": 1, "method": "ping"}, -32600), ({"jsonrpc": "2.0", "id": True, "method": "ping"}, -32600), ({"jsonrpc": "2.0", "id": 1}, -32600),
        (request(1, "zzz"), -32601), (request(1, "initialize"), -32602), (request(1, "tools/list", cursor="2"), -32602), (request(1, "tools/call", name=3), -32602), (call(1, "nothing"), -32602),
    ],
)
def test_wrong_messages(message, code):
    _, out = run([message])
    assert [m["error"]["code"] for m in out] == [code]


def test_notifications_have_no_answer():
    assert run([{"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "method": "ping"}])[1] == []


def test_admission_duplicates_and_failures():
    messages = [call(0, "read_note", path="a"), call(0, "vault_status"), request("p"), *(call(i, "vault_status") for i in range(1, 12)), call(20, "related_notes", path="busy")]
    fake, out = run(messages)
    kinds = {(m["id"], "error" in m): m for m in out}
    assert kinds[0, True]["error"]["code"] == -32600 and out.index(kinds["p", False]) < out.index(kinds[0, False])
    busy = [m for m in out if m.get("result", {}).get("isError")]
    assert [json.loads(m["result"]["content"][0]["text"])["error"] for m in busy] == ["server_busy"] * (len(busy))
    assert len(busy) == 5 and fake.ran.count("vault_status") == P.PENDING - 1
    _, out = run([call(1, "related_notes", path="busy"), call(2, "related_notes", path="bad")])
    assert [json.loads(m["result"]["content"][0]["text"]) for m in out] == [{"error": "cache_busy", "message": "Another writer is at work; try again shortly.", "retryable": True}, {"error": "invalid_arguments", "message": "no"}]


def test_cancelling():
    cancel = lambda i: {"jsonrpc": "2.0", "method": "notifications/cancelled", "params": {"requestId": i}}
    wait = lambda fake, desk: time.sleep(0.05)
    fake, out = run([call(1, "read_note", path="a"), call(2, "vault_status"), cancel(2), cancel(99), cancel(1), request(3)], between=wait)
    assert [m["id"] for m in out] == [3] and fake.ran == ["read_note"] and len(fake.stopped) == 1
    fake, out = run([call(1, "capture_note", title="t", content="b"), cancel(1)], between=wait)
    assert fake.ran == ["capture_note"] and fake.stopped == []


def test_deadline_counts_from_the_receipt():
    fake, out = Fake(), []
    desk = P.Desk(fake, lambda b: out.append(json.loads(b)), deadline=0.05)
    desk.take(json.dumps(call(1, "read_note", path="a")).encode())
    desk.take(json.dumps(call(2, "vault_status")).encode())
    desk.take(json.dumps(call(3, "capture_note", title="t", content="b")).encode())
    time.sleep(0.1)
    fake.go.set()
    desk.close()
    assert json.loads(out[1]["result"]["content"][0]["text"])["error"] == "read_timeout" and not out[2]["result"]["isError"]


def test_large_answers_are_refused(monkeypatch):
    monkeypatch.setattr(P, "RESPONSE_BYTES", 50)
    assert run([request(1, "tools/list")])[1][0]["error"]["code"] == P.TOO_LARGE
