import json
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from auditspark.operators import report, score
from auditspark.sources import tables

FINDINGS = (
    "scan_id string, seq bigint, id string, owasp_id string, title string, description string, "
    "severity string, file string, line bigint, remediation string"
)
MOMENT = datetime(2026, 1, 2, 3, 4, 5, 60, tzinfo=timezone.utc)
RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}
VECTORS = ["ASI01", "ASI02", "ASI03", "ASI05", "ASI06", "ASI07", "ASI08"]


def _finding(seq, title="Title", severity="high", vector="ASI01", file="a.py", line=1, scan="s", description="d" * 20):
    return (scan, seq, f"GG-{seq:03}", vector, title, description, severity, file, line, "one\n\n  two \n")


def _kept(table, *rows):
    ranked = score.score(table(list(rows), FINDINGS)).collect()
    return [row.asDict() for row in sorted(ranked, key=lambda row: (row["scan_id"], row["report_pos"]))]


def test_validation_names_the_first_failing_check(table):
    rows = [
        _finding(1), _finding(2, vector="ASI99"), _finding(3, vector="ASI04"), _finding(4, description="d" * 9),
        _finding(5, description="d" * 10), _finding(6, title="Untitled finding"), _finding(7, title=""),
        _finding(8, title=" "), _finding(9, title="", vector="x", description=""),
        _finding(10, description="\U0001f600" * 9),
    ]
    made = score.with_reject_reason(table(rows, FINDINGS)).orderBy("seq").collect()
    assert [row["reject_reason"] for row in made] == [
        None, "vector", "vector", "description", None, "title", "title", None, "title", "description",
    ]


def test_duplicates_keep_the_worst_and_of_equals_the_earliest(table):
    kept = _kept(table, _finding(1, severity="medium"), _finding(2, severity="critical"), _finding(3, severity="critical", line=9))
    assert [(row["seq"], row["severity"], row["first_seq"]) for row in kept] == [(2, "critical", 1)]


def test_lines_do_not_tell_findings_apart_but_titles_do(table):
    kept = _kept(table, _finding(1, line=None), _finding(2, line=5), _finding(3, title="Other", line=None))
    assert [row["seq"] for row in kept] == [1, 3]


def test_a_better_copy_takes_the_place_of_the_first_member(table):
    kept = _kept(table, _finding(1, "A", "low"), _finding(2, "B", "high"), _finding(3, "A", "high"))
    assert [(row["title"], row["seq"]) for row in kept] == [("A", 3), ("B", 2)]


def test_worst_severity_comes_first(table):
    kept = _kept(table, _finding(1, "A", "low"), _finding(2, "B", "critical"), _finding(3, "C", "medium"))
    assert [row["severity"] for row in kept] == ["critical", "medium", "low"]


def _model(rows):
    """Dedup and order of one scan, stated plainly."""
    first, best = {}, {}
    for row in sorted(rows, key=lambda r: r[1]):
        key = (row[7], row[3], row[4])
        first.setdefault(key, row[1])
        if key not in best or RANK[row[6]] > RANK[best[key][6]]:
            best[key] = row
    order = sorted(best, key=lambda key: (-RANK[best[key][6]], first[key]))
    return [best[key][1] for key in order]


def test_random_findings_agree_with_a_plain_model_in_any_partitioning(table):
    dice = random.Random(7)
    rows = []
    for seq in range(1, 1501):
        scan = "hot" if dice.random() < 0.4 else f"s{dice.randrange(4)}"
        rows.append(_finding(
            seq, f"T{dice.randrange(6)}", dice.choice(list(RANK)),
            dice.choice(VECTORS[:3]), f"f{dice.randrange(9)}", dice.choice([None, 0, 4]), scan,
        ))
    expected = {scan: _model([r for r in rows if r[0] == scan]) for scan in {r[0] for r in rows}}
    for parts in (1, 4, 17):
        ranked = score.score(table(rows, FINDINGS).repartition(parts)).collect()
        made = {}
        for row in sorted(ranked, key=lambda row: row["report_pos"]):
            made.setdefault(row["scan_id"], []).append(row["seq"])
        assert made == expected


def test_positions_over_sparse_numbers(table):
    rows = [_finding(i * (1 << 34) + 5, f"T{i}", ["low", "high"][i % 2]) for i in range(40)]
    ranked = score.score(table(rows, FINDINGS)).collect()
    made = [row["seq"] for row in sorted(ranked, key=lambda row: row["report_pos"])]
    assert [row["report_pos"] for row in sorted(ranked, key=lambda r: r["report_pos"])] == list(range(1, 41))
    assert made == _model(rows)


def test_counters(table):
    rows = [_finding(1), _finding(2), _finding(3, "B"), _finding(4, title=""), _finding(5, vector="x", scan="t")]
    made = {row["scan_id"]: tuple(row)[1:] for row in score.counters(table(rows, FINDINGS)).collect()}
    assert made == {"s": (4, 1, 1, 2), "t": (1, 1, 0, 0)}


def test_summary_and_gate_cover_scans_without_findings(table):
    scans = table([("s",), ("t",), ("u",)], "scan_id string")
    found = table([_finding(1), _finding(2, "B", "low", scan="t")], FINDINGS)
    made = report.summary(found, scans)
    assert {row["scan_id"]: tuple(row)[1:] for row in made.collect()} == {
        "s": (0, 1, 0, 0, 1), "t": (0, 0, 0, 1, 1), "u": (0, 0, 0, 0, 0),
    }
    assert {row["scan_id"]: row["gate_failed"] for row in report.gate(made).collect()} == {"s": True, "t": False, "u": False}


def test_report_has_one_layout(table, tmp_path):
    scans = table([("s",), ("quiet",)], "scan_id string")
    unique = score.deduplicate(score.valid(table([_finding(i, f"T{i}", "low", line=None) for i in range(1, 8)], FINDINGS)))
    lines = report.report(unique, score.rank(unique), scans, MOMENT)
    made = {(row["scan_id"], row["report_pos"]): json.loads(row["report"]) for row in lines.collect()}
    assert set(made) == {("quiet", 0), *(("s", n) for n in range(8))}
    assert made["s", 0] == {
        "tool_version": "0.1.0", "timestamp": MOMENT.isoformat(), "total_findings": 7,
        "summary": {"critical": 0, "high": 0, "medium": 0, "low": 7},
    }
    assert made["quiet", 0]["total_findings"] == 0
    assert [made["s", n]["id"] for n in range(1, 8)] == [f"GG-00{n}" for n in range(1, 8)]
    assert made["s", 1]["line"] is None
    tables.write_reports(lines, str(tmp_path / "report"))
    written = [json.loads(line) for file in sorted((tmp_path / "report").glob("*.json")) for line in file.read_text().splitlines()]
    assert [(row["scan_id"], row["report_pos"]) for row in written] == sorted(made)
    assert all(json.loads(row["report"]) == made[row["scan_id"], row["report_pos"]] for row in written)


def test_findings_sink(spark, table, tmp_path):
    rows = score.findings_rows(score.score(table([_finding(1), _finding(2, "B", "critical")], FINDINGS)))
    tables.write_findings(rows, str(tmp_path / "findings"))
    back = spark.read.parquet(str(tmp_path / "findings")).orderBy("report_pos").collect()
    assert [(row["id"], row["severity"]) for row in back] == [("GG-002", "critical"), ("GG-001", "high")]


def test_printed_rows(table):
    ranked = score.score(table([_finding(1, line=0)], FINDINGS))
    row = report.findings_table(ranked).first()
    assert (row["id"], row["severity"], row["location"]) == ("GG-001", "HIGH", "a.py")
    steps = report.remediation_steps(ranked).orderBy("step").collect()
    assert [(row["step"], row["text"]) for row in steps] == [(0, "one"), (1, "two")]
    assert len(score.in_report_order(ranked).collect()) == 1


def test_report_time(spark, table):
    moments = [datetime(2026, 1, 2, 3, 4, 5, micro, tzinfo=timezone.utc) for micro in (0, 1000, 123456)]
    rows = table([(moment,) for moment in moments], "t timestamp")
    made = rows.select(report.iso_time(rows.t), report.header_time(rows.t)).collect()
    assert [row[0] for row in made] == [moment.isoformat() for moment in moments]
    assert made[0][1] == "2026-01-02 03:04 UTC"


def test_one_report_file_per_scan(spark, table, tmp_path):
    scans = {"hot": 300_000, "a/b ü": 5, "only head": 0, "x" * 300: 2}
    rows = spark.createDataFrame(list(scans.items()), "scan_id string, n long")
    lines = rows.select("scan_id", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("report_pos"))
    lines = lines.withColumn("report", F.concat(F.lit('{"é":'), F.col("report_pos").cast("string"), F.lit("}"))).repartition(7)
    path = tmp_path / "reports"
    tables.write_report_files(lines, str(path))
    assert sorted(p.name for p in path.iterdir()) == sorted(map(tables.report_file, scans))
    for scan, n in scans.items():
        text = (path / tables.report_file(scan)).read_text()
        assert text == "".join(f'{{"é":{at}}}\n' for at in range(n + 1))
    with pytest.raises(Exception):
        tables.write_report_files(lines, str(path))
    tables.write_report_files(lines.filter("scan_id = 'hot' and report_pos < 3"), str(path), overwrite=True)
    assert [p.name for p in path.iterdir()] == ["hot.jsonl"]


def test_a_run_that_fails_leaves_no_report(spark, tmp_path):
    lines = spark.range(50).select(
        F.lit("s").alias("scan_id"), F.col("id").alias("report_pos"), F.lit("{}").alias("report")
    )
    broken = F.udf(lambda at: 1 // (at - 40) and "{}", "string")
    with pytest.raises(Exception):
        tables.write_report_files(lines.withColumn("report", broken("report_pos")), str(tmp_path / "reports"))
    assert not [p for p in tmp_path.iterdir() if not p.name.startswith("reports.part-")] and not (tmp_path / "reports").exists()
