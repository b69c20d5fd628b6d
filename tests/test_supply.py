import pytest

from auditspark.operators import supply
from auditspark.plans import audit
from auditspark.sources import tables

INSTALLED = "scan_id string, package string, version string"


@pytest.mark.parametrize("limit", [100, 0])
def test_inventories_against_the_sample_advisories(spark, table, limit):
    installed = table([
        ("a", "langgraph", "1.1.9"), ("a", "LangChain_Core", "1.0"), ("a", "requests", "0.1"), ("a", "langchain-community", "0.3.0"),
        ("b", "langgraph", "1.2rc1"), ("b", "langchain.core", None), ("c", "langgraph-checkpoint-sqlite", "junk"),
    ], INSTALLED)
    found = supply.vulnerable(installed, tables.advisories(spark), max_rows=limit)
    assert sorted((row["scan_id"], row["adv_pos"], row["package"], row["installed"]) for row in found.collect()) == [
        ("a", 1, "langchain-core", "1.0"), ("a", 2, "langgraph", "1.1.9"), ("c", 0, "langgraph-checkpoint-sqlite", "junk"),
    ]
    assert supply.vulnerability_rows(found).columns == [
        "scan_id", "package", "installed", "affected_below", "cve", "severity", "description", "remediation",
    ]


def test_long_digit_runs_compare_by_value(table):
    from auditspark.functions.text import is_below

    long = "9" * 60
    cases = [("0.2." + long, "0.3", True), ("0." + long, "0.3", False), ("1." + long, "1." + long + "0", True), ("01.002", "1.2", False), ("1.10", "1.9", False)]
    rows = table([(*case[:2],) for case in cases], "a string, b string")
    assert [row[0] for row in rows.select(is_below(rows.a, rows.b)).collect()] == [case[2] for case in cases]


def test_check(spark, table):
    scans = table([("a",), ("b",)], "scan_id string")
    shown, status = audit.check(scans, table([("a", "langgraph", "1.0")], INSTALLED), tables.advisories(spark))
    assert [(row["severity"], row["fix"]) for row in shown.collect()] == [("CRITICAL", "Fix: Upgrade langgraph to >= 1.2.0")]
    assert {row["scan_id"]: (row["n_vulnerable"], row["clean"]) for row in status.collect()} == {"a": (1, False), "b": (0, True)}


def test_several_advisories_of_one_package_all_match(table):
    known = [(i, "p", f"id{i}", below, "low", "d", "r") for i, below in enumerate(["2", "1.5", "1"])]
    schema = "adv_pos int, package string, cve string, affected_below string, severity string, description string, remediation string"
    found = supply.vulnerable(table([("a", "p", "1.2")], INSTALLED), table(known, schema))
    assert sorted(row["cve"] for row in found.collect()) == ["id0", "id1"]


def test_pins(table):
    text = 'R = ["lang-x==0.2.5", \'A_b==1.0rc1\', "c>=2", "d== 3"]\n-e f==1;python\n' + "x" * 200_000
    made = supply.pinned(table([("s", "p", text)], "scan_id string, path string, text string"))
    assert sorted((row["package"], row["version"]) for row in made.collect()) == [("A_b", "1.0rc1"), ("f", "1"), ("lang-x", "0.2.5")]
