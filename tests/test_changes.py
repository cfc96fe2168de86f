import datetime
import json
import os

import pytest

from corvane.operators import mutate as M
from corvane.service import tools

DAY = datetime.date(2026, 9, 1)


def test_text_changes():
    assert M.slug("Über Größe!") == "ueber-groesse" and M.slug("!!!") == "note"
    assert M.moment_format(DAY, "GGGG-[W]WW MMM D") == "2026-W36 Sep 1" and M.moment_format(datetime.date(2027, 1, 1), "GGGG-[W]WW") == "2026-W53"
    text = "---\r\nid: a\r\nupdated: 2020-01-01\r\n---\r\nupdated: body\r\n"
    once = M.stamped(text, DAY)
    assert once == text.replace("2020-01-01", "2026-09-01") == M.stamped(once, DAY)
    assert M.stamped("no header\nupdated: x", DAY) == "no header\nupdated: x"
    changed = M.with_frontmatter("---\na: 1\nb:\n  - x\nc: 2\n---\nbody\n", {"b": ["y, z"], "d": "e: f"}, remove=("c",))
    assert changed == '---\na: 1\nb:\n  - "y, z"\nd: "e: f"\n---\nbody\n'
    hub = "# Hub\n<!-- vault:links -->\n- [[b]]\n"
    assert M.with_link(hub, "a") == "# Hub\n<!-- vault:links -->\n- [[a]]\n- [[b]]\n" and M.with_link(M.with_link(hub, "a"), "a") == M.with_link(hub, "a")
    assert M.with_parent("# T\n\nx", "Hub") == "# T\n\nUp: [[Hub]]\n\nx" and M.with_parent("[[Hub]]", "Hub") == "[[Hub]]"


def test_seal():
    raw = "---\ntype: raw-source\n---\n<!-- raw-source:begin -->\r\none\r\ntwo\r\n<!-- raw-source:end -->\n"
    assert M.payload(raw) == M.payload(raw.replace("\r\n", "\n")) == "one\ntwo"
    done = M.sealed(raw.replace("\r\n", "\n"), DAY)
    assert M.digest("one\ntwo") in done and M.sealed(done, DAY) == done
    with pytest.raises(ValueError, match="payload_changed"):
        M.sealed(done.replace("two", "three"), DAY)
    with pytest.raises(ValueError, match="boundary"):
        M.sealed("nothing", DAY)


def test_merge_needs_its_plan():
    a, b = "---\nid: a\nscope: x\ntags: [t]\n---\nA\n", "---\nid: b\nscope: y\ntags: [T, u]\n---\nB\n"
    plan = M.merge_plan(a, b, "new body")
    assert plan["tags"] == ["t", "u"] and plan["conflicts"] == ["scope"] and plan["aliases"] == ["b"]
    with pytest.raises(ValueError, match="warnings"):
        M.apply_merge(a, b, "new body", plan["plan"], "a", DAY)
    with pytest.raises(ValueError, match="plan_changed"):
        M.apply_merge(a, b, "other", plan["plan"], "a", DAY, accept_warnings=True)
    kept, gone = M.apply_merge(a, b, "new body", plan["plan"], "a", DAY, accept_warnings=True)
    assert "new body" in kept and 'redirect_to: "[[a]]"' in gone and "type: redirect" in gone


def test_files(tmp_path):
    root = str(tmp_path)
    for bad in ("../x", ".hid/x", "/etc/passwd"):
        with pytest.raises(ValueError):
            M.inside(root, bad)
    one, two = os.path.join(root, "1"), os.path.join(root, "nowhere", "2")
    M.write_atomic(one, "old")
    with pytest.raises(OSError):
        M.write_together({one: "new", two: "x"})
    assert open(one).read() == "old"
    with M.write_lock(root), pytest.raises(TimeoutError), M.write_lock(root):
        pass


@pytest.mark.parametrize(
    ("tool", "arguments"),
    [("nope", {}), ("search_vault", {}), ("search_vault", {"query": "x", "limit": 21}), ("search_vault", {"query": "x", "limit": True}), ("search_vault", {"query": "a\x00"}), ("search_vault", {"query": "x", "more": 1}), ("search_vault", {"query": "x", "tags": ["a", "A"]}), ("search_vault", {"query": "x", "since": "2024-13-01"}), ("vault_status", []), ("search_vault", {"query": "x", "types": ["nope"]}), ("search_vault", {"query": "x", "fuzzy": 1}), ("capture_note", {"title": "con", "content": "x"}), ("capture_note", {"title": "a[b", "content": "x"}), ("capture_note", {"title": "a", "content": "x", "tags": ["#t"]}), ("capture_note", {"title": "a", "content": "x", "feedback": {"scope": "s"}}), ("capture_raw_source", {"title": "a", "content": "x", "capture_scope": "some"})],
)
def test_arguments_refused(tool, arguments):
    with pytest.raises(tools.InputError):
        tools.validated(tool, arguments)


def test_service(spark, tmp_path):
    (tmp_path / "40-knowledge").mkdir()
    (tmp_path / "40-knowledge/Hub.md").write_text("---\nid: hub\ntype: moc\n---\n# Hub\n<!-- vault:links -->\n[[Alpha]]\n")
    (tmp_path / "40-knowledge/Alpha.md").write_text("---\nid: alpha\ntype: concept\n---\n# Alpha\n\nSemantic widgets. [[Hub]]\n")
    service = tools.Service(spark, str(tmp_path), lambda: DAY)
    call = lambda name, **kw: service.handle({"jsonrpc": "2.0", "id": 1, "method": "tools/call", "params": {"name": name, "arguments": kw}})["result"]
    found = json.loads(call("search_vault", query="widgets")["content"][0]["text"])
    assert found["results"][0]["path"] == "40-knowledge/Alpha.md" and "untrusted" in found["notice"]
    assert json.loads(call("related_notes", path="40-knowledge/Hub.md")["content"][0]["text"])["related"] == [{"path": "40-knowledge/Alpha.md", "distance": 1}]
    assert not call("capture_note", title="New Thing", content="text", hub="40-knowledge/Hub")["isError"]
    assert "[[00-inbox/new-thing]]" in (tmp_path / "40-knowledge/Hub.md").read_text()
    assert call("capture_note", title="New Thing", content="text")["isError"]
    assert call("read_note", path="../x")["isError"] and len(service.handle({"jsonrpc": "2.0", "id": 2, "method": "tools/list"})["result"]["tools"]) == 7
    assert "unresolved_capture_links" in call("capture_note", title="Other", content="see [[Nowhere]]")["content"][0]["text"]
    assert not call("capture_note", title="Lesson", content="see [[Alpha]]", feedback={"scope": "all", "evidence": ["a log"]})["isError"]
    assert "capture_kind: feedback" in (tmp_path / "00-inbox/lesson.md").read_text()
    assert not call("capture_raw_source", title="Source", content="[[untrusted]] text", source_url="https://x.example", tags=["web/page"])["isError"]
    read = json.loads(call("read_note", path="30-resources/sources/raw/source.md")["content"][0]["text"])
    assert read["type"] == "raw-source" and read["status"] == "immutable" and not read["truncated"] and read["content_chars"] == len(read["content"])
    assert call("capture_raw_source", title="Source 2", content="x", source_url="ftp://x")["isError"]
    assert json.loads(call("vault_status")["content"][0]["text"])["families"].get("raw_source_integrity") is None
    answers: list[bytes] = []
    tools.serve(service, iter([b'{"jsonrpc": "2.0", "id": 3, "method": "ping"}', b"{broken", b'{"jsonrpc": "2.0", "id": 4, "method": "zzz"}', b'{"jsonrpc": "2.0", "method": "note"}']), answers.append)
    assert [json.loads(a).get("id") for a in answers] == [3, None, 4]
