import json
from datetime import datetime, timezone

from pyspark.sql import functions as F

from auditspark.operators import prompt
from auditspark.plans import audit
from auditspark.session import materialize
from auditspark.sources import srctree

MOMENT = datetime(2026, 1, 2, 3, 4, 5, tzinfo=timezone.utc)


def test_from_trees_to_reports(spark, table, tmp_path):
    sources = {
        "agent/a.py": "from langgraph.graph import StateGraph\ndef f(x): return x\n",
        "agent/b.js": "import { tool } from '@langchain/core';\nfunction g(y) { return y; }\n",
        "agent/c.py": "@tool\ndef broken(\n",
        "agent/plain.py": "def h(): pass\n",
        "agent/node_modules/d.js": "tool()\n",
        "small/only.py": "class A: pass\n",
    }
    for name, text in sources.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    targets = {name: str(tmp_path / name) for name in ("agent", "small", "gone")}
    scans = table([(n, p, "fast") for n, p in targets.items()], "scan_id string, target_path string, model string")

    listed = srctree.entries(spark, targets)
    ready = audit.prepare(scans, listed, srctree.files_of(listed), srctree.dirs_of(listed))
    assert {r["scan_id"]: r["error"] is None for r in ready.status.collect()} == {"agent": True, "small": True, "gone": False}
    assert {r["scan_id"]: tuple(r)[1:] for r in ready.census.collect()} == {"agent": (4, 3, 1), "small": (1, 1, 0)}
    assert [r["names"] for r in ready.pruned.collect()] == [["node_modules"]]
    assert [r["path"] for r in ready.parse_errors.collect()] == [f"{targets['agent']}/c.py"]
    assert {tuple(r) for r in ready.skipped.collect()} == {("agent", "parse_error", 1)}
    asked = ready.asked.orderBy("scan_id", "file_order").collect()
    assert [(r["scan_id"], r["path"].rsplit("/", 1)[1], r["file_order"]) for r in asked] == [
        ("agent", "a.py", 1), ("agent", "b.js", 2), ("small", "only.py", 1),
    ]
    assert {r["model_key"] for r in ready.prompts.collect()} == {"fast"}

    def answer(title, severity):
        return json.dumps([{"owasp_id": "ASI01", "title": title, "description": "d" * 12, "severity": severity, "file": "x"}])

    replies = {"a.py": answer("A", "low"), "b.js": "```json\n" + answer("B", "critical") + "\n```", "only.py": "nothing"}

    def make_client():
        return lambda url, body, deadline: next(raw for name, raw in replies.items() if f"/{name}\\\"" in body)

    responses = materialize(prompt.ask(prompt.requests(ready.prompts, "Find what is wrong."), make_client, tasks=2))
    done = audit.conclude(scans, ready.asked, responses, MOMENT)
    rows = done.findings.orderBy("scan_id", "report_pos").collect()
    assert [(r["scan_id"], r["id"], r["title"]) for r in rows] == [("agent", "GG-002", "B"), ("agent", "GG-001", "A")]
    assert {r["scan_id"]: r["gate_failed"] for r in done.gate.collect()} == {"agent": True, "small": False, "gone": False}
    assert [(r["scan_id"], r["reason"]) for r in done.rejects.collect()] == [("small", "not_json")]
    assert {r["scan_id"]: r["kept"] for r in done.counters.collect()} == {"agent": 2}
    reports = {(r["scan_id"], r["report_pos"]): json.loads(r["report"]) for r in done.report.collect()}
    assert [reports["agent", n]["title"] for n in (1, 2)] == ["B", "A"]
    assert set(reports) == {("agent", 0), ("agent", 1), ("agent", 2), ("small", 0), ("gone", 0)}
    assert done.summary.filter(F.col("total_findings") > 0).count() == 1
