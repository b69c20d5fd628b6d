import json

from pyspark.sql import functions as F

from auditspark.operators import decode

RESPONSES = "scan_id string, path string, file_order bigint, status string, raw string, detail string"
ONE = {
    "owasp_id": "ASI01", "title": "T", "description": "long enough text", "severity": "high",
    "file": "a.py", "line": 3, "remediation": "fix",
}
TEXT = json.dumps(ONE)


def _decode(table, *raws, scan="s"):
    rows = [(scan, f"f{i}", i, "ok", raw, None) for i, raw in enumerate(raws, 1)]
    found, rejects = decode.decode(table(rows, RESPONSES))
    return (
        sorted((row.asDict() for row in found.collect()), key=lambda row: row["seq"]),
        [row.asDict() for row in rejects.collect()],
    )


# reply -> findings in it, numbers used up
CASES = {
    f"[{TEXT}]": (1, 1),
    f"<think>hm [x]</think>\n[{TEXT}]": (1, 1),
    f"```json\n[{TEXT}]\n```": (1, 1),
    f"```\n[{TEXT}]```": (1, 1),
    f"text ```\nnothing``` more ```json\n [{TEXT}] ```": (1, 1),
    "no problems here": (0, 0),
    "[]": (0, 0),
    "": (0, 0),
    TEXT.replace("high", "extreme").join("[]"): (0, 1),
    TEXT.replace("high", "HIGH").join("[]"): (0, 1),
    f"Here: [{TEXT}] as asked": (1, 1),
    f"[{TEXT}] and [{TEXT}]": (0, 0),
    f'{{"findings":[{TEXT}]}}': (1, 1),
    '{"a":1,"b":2}': (0, 2),
    '{"a":1,"a":2}': (0, 1),
    f'["x",{TEXT}]': (1, 2),
    "[{}]": (1, 1),
    '[{"title":null}]': (0, 1),
    '[{"title":5}]': (0, 1),
    f"[{TEXT},]": (0, 0),
    '"abc"': (0, 3),
    "17": (0, 0),
    "null": (0, 0),
    "] [": (0, 0),
    " [{}]　": (1, 1),
    "```json\n{}\n```": (0, 0),
    "[[1],null,true]": (0, 3),
}


def test_numbers_of_any_size_keep_their_finding(table):
    lines = ["12345678901234567890", '"' + "9" * 20 + '"', '"' + "9" * 60 + '"', "1" + "0" * 60, "7"]
    found, rejects = _decode(table, *[TEXT.replace('"line": 3', f'"line": {line}').join("[]") for line in lines])
    assert not rejects
    assert [row["line"] for row in found] == [12345678901234567890, int("9" * 20), None, None, 7]


def test_numbers_that_are_none_spoil_their_item_only(table):
    for word in ("NaN", "Infinity", "-Infinity"):
        bad = TEXT.replace('"line": 3', f'"line": {word}')
        other = TEXT.replace('"T"', '"NaN, \\"-Infinity\\" and so on"')
        extra = TEXT.replace("{", f'{{"score": {word}, ', 1)
        found, rejects = _decode(table, f"[{bad},{other},{extra}]")
        assert [row["title"] for row in found] == ['NaN, "-Infinity" and so on', "T"]
        assert [row["reason"] for row in rejects] == ["bad_line"]


def test_each_reply_gives_its_findings_and_numbers(table):
    probe = TEXT.replace('"T"', '"probe"')
    rows = []
    for i, raw in enumerate(CASES):
        rows.append((f"c{i}", "a", 1, "ok", raw, None))
        rows.append((f"c{i}", "b", 2, "ok", f"[{probe}]", None))
    found, _ = decode.decode(table(rows, RESPONSES))
    made = {}
    for row in found.collect():
        n, used = made.get(row["scan_id"], (0, None))
        made[row["scan_id"]] = (n, row["seq"] - 1) if row["title"] == "probe" else (n + 1, used)
    assert {raw: made[f"c{i}"] for i, raw in enumerate(CASES)} == CASES


def test_defaults_fill_missing_keys_only(table):
    found, _ = _decode(table, "[{}]")
    expected = {
        "id": "GG-001", "owasp_id": "UNKNOWN", "title": "Untitled finding",
        "description": "No description provided", "severity": "medium", "file": "unknown", "line": None,
        "remediation": "No remediation provided",
    }
    assert {key: found[0][key] for key in expected} == expected


def test_last_value_of_a_repeated_key_wins(table):
    found, _ = _decode(table, '[{"title":"a","title":"b","line":1,"line":"2"}]')
    assert (found[0]["title"], found[0]["line"]) == ("b", 2)


def test_given_id_is_overwritten_and_file_is_taken_as_written(table):
    found, _ = _decode(table, '[{"id":"X-9","file":"elsewhere.py"}]')
    assert (found[0]["id"], found[0]["file"], found[0]["path"]) == ("GG-001", "elsewhere.py", "f1")


def test_rejects_carry_stage_reason_and_number(table):
    _, rejects = _decode(table, '["x",{"severity":"bad"},{"line":4.5},{"file":null}]', "nope", "17")
    assert sorted((r["stage"], r["reason"], r["seq"]) for r in rejects if r["stage"] == "item") == [
        ("item", "bad_file", 4), ("item", "bad_line", 3), ("item", "bad_severity", 2), ("item", "not_an_object", 1),
    ]
    assert sorted((r["reason"], r["payload"]) for r in rejects if r["stage"] == "reply") == [
        ("not_iterable", "17"), ("not_json", "nope"),
    ]


def test_ids_grow_past_three_digits(table):
    found, _ = _decode(table, "[" + ",".join(["{}"] * 999) + "]", "[{}]")
    assert [row["id"] for row in found if row["seq"] in (1, 12, 999, 1000)] == [
        "GG-001", "GG-012", "GG-999", "GG-1000",
    ]


def test_lost_connection_ends_a_scan_and_other_failures_a_file(table):
    def scan(name, third):
        states = {1: "ok", 2: "ok", 3: third, 4: "ok"}
        return [(name, f"f{i}", i, state, "[{}]" if state == "ok" else None, None) for i, state in states.items()]

    responses = table(scan("lost", "connect_error") + scan("failed", "error"), RESPONSES)
    for limit in (100, 0):
        reached = decode.before_connection_loss(responses, max_rows=limit)
        kept = sorted((r["scan_id"], r["path"]) for r in decode.answered(reached).collect())
        assert kept == [("failed", "f1"), ("failed", "f2"), ("failed", "f4"), ("lost", "f1"), ("lost", "f2")]
    found, rejects = decode.decode(responses)
    assert sorted((r["scan_id"], r["path"], r["seq"]) for r in found.collect()) == [
        ("failed", "f1", 1), ("failed", "f2", 2), ("failed", "f4", 3), ("lost", "f1", 1), ("lost", "f2", 2),
    ]
    assert [(r["scan_id"], r["path"], r["stage"]) for r in rejects.collect()] == [("failed", "f3", "call")]


def test_numbers_do_not_depend_on_partitions_or_sparse_file_order(spark, table):
    rows = []
    expected = {}
    for scan, step in (("a", 1), ("b", 70_000), ("c", 1 << 33)):
        used = 0
        for i in range(60):
            n = i % 4
            rows.append((scan, f"f{i:03}", i * step, "ok", "[" + ",".join(["{}"] * n) + "]", None))
            expected[scan, f"f{i:03}"] = list(range(used + 1, used + n + 1))
            used += n
    for parts in (1, 4, 17):
        found, _ = decode.decode(table(rows, RESPONSES).repartition(parts))
        made = {}
        for row in found.collect():
            made.setdefault((row["scan_id"], row["path"]), []).append(row["seq"])
        assert {k: sorted(v) for k, v in made.items()} == {k: v for k, v in expected.items() if v}


def test_findings_per_file_count_empty_replies_and_totals(table):
    rows = [("s", "a", 1, "ok", "[{},{},5]", None), ("s", "b", 2, "ok", "[]", None), ("s", "c", 3, "ok", "x", None)]
    made = decode.findings_per_file(decode.decode_items(table(rows, RESPONSES))).collect()
    assert {row["path"]: row["n_findings"] for row in made} == {"a": 2, "b": 0, "c": 0, None: 2}


def test_envelope(table):
    body = json.dumps({"choices": [{"message": {"content": "[]\né"}}]})
    made = decode.envelope_text(table([(body,), ("{}",), ("x",)], "body string"))
    assert [row["raw"] for row in made.collect()] == ["[]\né", None, None]
    assert made.filter(F.col("raw").isNull()).count() == 2
