import json

import pytest
from pyspark.sql import functions as F

from auditspark import fixed_values as V
from auditspark.operators import facts, prompt, select

FILES = "scan_id string, path string, content binary, read_error string"


def _extract(table, sources):
    rows = [("s", p, c if isinstance(c, bytes) else c.encode(), None) for p, c in sources.items()]
    extracted = facts.extract(select.with_suffix(table(rows, FILES)))
    return {row["path"]: row.asDict(recursive=True) for row in extracted.collect()}


def _one(table, content, path="x.py"):
    return _extract(table, {path: content})[path]


def test_python_functions_and_what_they_leave_out(table):
    made = _one(table, "@mark(1)\ndef f(a, /, b, *c, d=1, **e):\n    def g(x, y): pass\nasync def h(): pass\nk = lambda q: q\n"
                       "class A:\n    def m(self): pass\n")
    assert made["functions"] == [
        {"name": "f", "lineno": 2, "args": ["b"], "decorators": ["mark(1)"]},
        {"name": "g", "lineno": 3, "args": ["x", "y"], "decorators": []},
        {"name": "m", "lineno": 7, "args": ["self"], "decorators": []},
    ]


def test_python_classes_and_imports(table):
    made = _one(table, "import os, sys as s\nfrom a.b import (c,\n  d)\nclass S(Base, x.Y, metaclass=M):\n    import q\n")
    assert made["classes"] == [{"name": "S", "lineno": 4, "bases": ["Base", "x.Y"]}]
    assert made["imports"] == ["import os, sys as s", "from a.b import c, d", "import q"]


def test_python_calls_are_breadth_first_with_nested_ones(table):
    made = _one(table, "def f():\n    return g( h( 1 ) )\nx = k()\n")
    assert made["calls"] == [
        {"call": "k()", "lineno": 3}, {"call": "g(h(1))", "lineno": 2}, {"call": "h(1)", "lineno": 2},
    ]


def test_python_assignments_and_what_they_leave_out(table):
    made = _one(table, "a = b = c\nx: int = 1\ny += 2\nif (z := 3): pass\nd[0], e.f = 1, 2\n")
    assert made["assignments"] == [
        {"targets": ["a", "b"], "value": "c", "lineno": 1},
        {"targets": ["(d[0], e.f)"], "value": "(1, 2)", "lineno": 5},
    ]


def test_literals_are_kept_above_and_cut_at_the_limits(table):
    texts = ["x" * 20, "y" * 21, "z" * 250, "é" * 201]
    made = _one(table, "\n".join(f'"{t}"' for t in texts) + '\nf"{a} and more than twenty {b}"\nb"' + "w" * 30 + '"\n"\\ud800' + "s" * 30 + '"\n')
    assert [s["value"] for s in made["strings"]] == ["y" * 21, "z" * 200, "é" * 200, "?" + "s" * 30, " and more than twenty "]


@pytest.mark.parametrize("content", ["def broken(", "\ufeffx = 1", "x\x00", b"\xff\xfe", "(" * 5000, "x = 'a"])
def test_unparseable_python_is_an_error_row(table, content):
    made = _one(table, content)
    assert made["error"] and made["functions"] is None


def test_error_texts(table):
    made = _extract(table, {"d/p.py": "def broken(\n", "q.py": b"ab\xff"})
    assert made["d/p.py"]["error"] == "'(' was never closed (p.py, line 1)"
    assert made["q.py"]["error"] == "'utf-8' codec can't decode byte 0xff in position 2: invalid start byte"


def test_line_ends_are_unified_and_empty_files_are_no_errors(table):
    made = _extract(table, {"a.py": "x = 1\r\ny = 2\rz = 3\n", "b.py": ""})
    assert [a["lineno"] for a in made["a.py"]["assignments"]] == [1, 2, 3]
    assert made["b.py"]["error"] is None and made["b.py"]["functions"] == []


def test_read_errors_are_passed_on(table):
    rows = [("s", "a.py", None, "denied"), ("s", "b.js", None, "denied")]
    extracted = facts.extract(select.with_suffix(table(rows, FILES)))
    assert sorted(tuple(row) for row in facts.parse_rejects(extracted).collect()) == [
        ("s", "a.py", "parse", "denied"), ("s", "b.js", "parse", "denied"),
    ]


def test_js_functions(table):
    made = _one(table, (
        "function f(x, y) {}\nexport default async function g(a, ...rest) {}\nfunction* gen(q) {}\n"
        "const h = (a, b = 2) => a;\nlet k = x => x;\nvar v = (z) => z;\nconst e = function (w) {};\n"
        "class A extends Base {\n  method(p) {\n  }\n}\nexport const m = async ({ a, b }, c) => a;\n"
    ), "x.js")
    assert [(f["name"], f["lineno"], f["args"], f["decorators"]) for f in made["functions"]] == [
        ("f", 1, ["x", "y"], []), ("g", 2, ["a", "rest"], []), ("h", 4, ["a", "b"], []), ("k", 5, ["x"], []), ("m", 12, ["c"], []),
    ]
    assert made["classes"] == [{"name": "A", "lineno": 8, "bases": ["Base"]}]


def test_ts_parameters(table):
    made = _one(table, "function f(a: string, b?: number, c: () => void = noop) {}\n", "x.ts")
    assert made["functions"][0]["args"] == ["a", "b", "c"]


def test_js_imports_calls_assignments_and_strings(table):
    made = _one(table, (
        'import fs from "fs";\nimport {\n  a,\n} from \'./b\'\nconst x = new Foo(bar(1));\nx.y = z;\nx += 1;\n'
        '// skipped(1)\nlet w;\nif (check(w)) { run(w) }\nconst s = "a quoted text that is long enough" + `templates that are long ${w} and short`;\n'
    ), "x.mjs")
    assert made["imports"] == ['import fs from "fs";', "import {\n  a,\n} from './b'"]
    assert [c["call"] for c in made["calls"]] == ["new Foo(bar(1))", "bar(1)", "check(w)", "run(w)"]
    assert [(a["targets"], a["lineno"]) for a in made["assignments"]] == [(["x"], 5), (["x.y"], 6), (["w"], 9), (["s"], 11)]
    assert made["assignments"][2]["value"] == ""
    assert [s["value"] for s in made["strings"]] == ["a quoted text that is long enough", "templates that are long "]


@pytest.mark.parametrize("content", ["function broken(\n", "const a = {;\n", b"\xff"])
def test_unbalanced_js_is_an_error_row(table, content):
    assert _one(table, content, "x.js")["error"]


def test_delimiters_in_strings_and_comments_do_not_count(table):
    assert _one(table, 'const a = "(";\n// (\nconst b = 1; // {\nconst c = `[`;\n', "x.js")["error"] is None


def test_js_over_several_lines(table):
    made = _one(table, (
        "async function spread<T>(\n  input: string,\n  depth = max(1, 2),\n  { a, b },\n  ...rest\n): Promise<void> {\n"
        '  return eval(input, "x(y)");\n}\nconst prompt = `first line of a system prompt\nsecond ${prompt} line that is quite long`;\n'
        "const chain = g.compile({ saver: new MemorySaver(),\n  x: 1 })\nconst arrow = (p, q) =>\n  p + q;\n"
        "step(1).then(go)\n  .catch(stop);\nlet m: Map<string, number> = new Map();\nconst f: (a: string) => void = async item => { foo(item) }\n"
    ), "x.ts")
    assert [(f["name"], f["lineno"], f["args"]) for f in made["functions"]] == [
        ("spread", 1, ["input", "depth", "rest"]), ("arrow", 13, ["p", "q"]), ("f", 18, ["item"]),
    ]
    assert [(c["call"], c["lineno"]) for c in made["calls"]] == [
        ("max(1, 2)", 3), ('eval(input, "x(y)")', 7), ("g.compile({ saver: new MemorySaver(),\n  x: 1 })", 11), ("new MemorySaver()", 11),
        ("step(1)", 15), ("then(go)", 15), ("catch(stop)", 16), ("new Map()", 17), ("foo(item)", 18),
    ]
    assert [(a["targets"], a["value"]) for a in made["assignments"]] == [
        (["prompt"], "`first line of a system prompt\nsecond ${prompt} line that is quite long`"),
        (["chain"], "g.compile({ saver: new MemorySaver(),\n  x: 1 })"), (["arrow"], "(p, q) =>\n  p + q"),
        (["m"], "new Map()"), (["f"], "async item => { foo(item) }"),
    ]
    assert [(s["value"], s["lineno"]) for s in made["strings"]] == [
        ("first line of a system prompt\nsecond ", 9), (" line that is quite long", 9),
    ]


def test_js_type_parameters(table):
    made = _one(table, (
        "const f = <T>(x: T) => x\nconst g = async <T extends Array<U>>(x: T, y = {a: 1}): Promise<Map<T, U>> => y;\n"
        "function q<T extends Array<U>>(x: T) { eval(x) }\nlet m: Map<string, Array<number>> = new Map<string, Array<number>>(), n = a < b, o = c > d;\n"
        "const k = (z: (a: string) => void): void => { z(1) };\nclass P<T extends Q<R>> extends Base<T> {}\n"
    ), "x.ts")
    assert [(f["name"], f["args"]) for f in made["functions"]] == [("f", ["x"]), ("g", ["x", "y"]), ("q", ["x"]), ("k", ["z"])]
    assert [c["call"] for c in made["calls"]] == ["eval(x)", "new Map<string, Array<number>>()", "z(1)"]
    assert [(a["targets"][0], a["value"]) for a in made["assignments"]][2:5] == [
        ("m", "new Map<string, Array<number>>()"), ("n", "a < b"), ("o", "c > d"),
    ]
    assert [(c["name"], c["bases"]) for c in made["classes"]] == [("P", ["Base"])]


def test_js_slashes(table):
    made = _one(table, (
        "if (ok) /[(]/.test(s);\nx =                            /[(]/ ;\nfor (const x of xs) /a(b/.test(x);\nx = y++ / 2; z = (a) / (b);\n"
        "const m = {a: 1} / 2;\nfunction f() {} /[{]/.exec(q);\nreturn /'/;\nlet z = new               Foo(1);\n"
    ), "x.js")
    assert made["error"] is None
    assert [c["call"] for c in made["calls"]] == ["test(s)", "test(x)", "exec(q)", "new               Foo(1)"]
    assert [a["value"] for a in made["assignments"]] == ["/[(]/", "y++ / 2", "(a) / (b)", "{a: 1} / 2", "new               Foo(1)"]


def test_js_templates_and_tags_inside_one_another(table):
    made = _one(table, (
        'const t = `a ${x ? `b ${y(`c ${"a string deep inside it"} d`)} a fragment of the second` : "}"} and the tail of the first`;\n'
        'const el = <div className="a long class name" {...rest}>don\'t ( {run(x, <b>it\'s</b>)}\n<br/> <A.B c={`${call(2)}`}/></div>;\n'
        "const e = <><i/>)</>;\nstep(3);\n"
    ), "x.js")
    assert made["error"] is None
    assert [(s["value"], s["lineno"]) for s in made["strings"]] == [
        (" and the tail of the first", 1), (" a fragment of the second", 1), ("a string deep inside it", 1),
    ]
    assert [(c["call"], c["lineno"]) for c in made["calls"]] == [
        ('y(`c ${"a string deep inside it"} d`)', 1), ("run(x, <b>it's</b>)", 2), ("call(2)", 3), ("step(3)", 5),
    ]
    assert [a["targets"][0] for a in made["assignments"]] == ["t", "el", "e"]


def test_js_brackets_of_any_depth(table):
    made = _one(table, "const d = " + "f([{a: " * 60 + "eval(x)" + "}])" * 60 + ";\nafter(1);\n", "x.js")
    assert len(made["calls"]) == 62 and made["calls"][60]["call"] == "eval(x)"
    assert made["calls"][0]["call"] == "f([{a: " * 60 + "eval(x)" + "}])" * 60
    assert _one(table, "(" * 501 + ")" * 501, "x.js")["error"] and not _one(table, "(" * 499 + ")" * 499, "x.js")["error"]
    assert _one(table, "`${" * 200 + "}`" * 200, "x.js")["error"]


def test_several_js_constructs_on_one_line(table):
    made = _one(table, "const a = 1, b = (x) => x; function line(x) { const y = wrap(x); y.z = 2; return y; }\nif (a) c = d;\n", "x.js")
    assert [(f["name"], f["args"]) for f in made["functions"]] == [("b", ["x"]), ("line", ["x"])] or (
        [(f["name"], f["args"]) for f in made["functions"]] == [("line", ["x"]), ("b", ["x"])]
    )
    assert [(a["targets"][0], a["value"]) for a in made["assignments"]] == [("a", "1"), ("b", "(x) => x"), ("y", "wrap(x)"), ("y.z", "2"), ("c", "d")]


@pytest.mark.parametrize("content", [
    "x = 1; // don't\n", "/* one (\n call(1) function ghost() {\n*/ x = 1;\n", "const odd = /[(]/.test(x);\n", "x = a / b / c;\n",
    "const a = x++; y--;\n", "export * from 'x';\n", "<div>don't</div>;\n", "const t = `a ${b ? `c(` : 1}'`;\n", "* leading\n",
])
def test_valid_js_is_kept(table, content):
    made = _one(table, content, "x.js")
    assert made["error"] is None
    assert not any("call" in c["call"] or "ghost" in c["call"] for c in made["calls"])
    assert all(f["name"] != "ghost" for f in made["functions"])


@pytest.mark.parametrize("content", ["return x +;\n", "x = ([)];\n", "} {\n", "x = 'abc\n", "/* open\n", "a = `abc\n", "const = 3;\n", "x;\nfunction () {}\n", "f(`${a)}`);\n"])
def test_broken_js_is_an_error_row(table, content):
    assert _one(table, content, "x.js")["error"]


LONG = {
    "blanks": "let a" + " " * 100_000 + "b", "tabs": "x = b" + "\t" * 100_000 + "c", "types": "const a = " + ") :" * 33_000,
    "open": "(" * 100_000, "colons": ":" * 100_000, "calls": "a(" * 50_000, "nested": "a(" * 30_000 + ")" * 30_000, "quotes": "'" * 100_000,
    "templates": "`${" * 30_000, "slashes": "=/a" * 30_000, "equals": "a = " * 30_000, "lines": "a =\n" * 20_000, "types again": "const a: " * 20_000,
    "comments": "/*" * 50_000, "escapes": '"' + "\\n" * 60_000 + '"', "tags": "<a" * 40_000, "imports": "import " * 20_000, "chain": "a(1).b(2)" * 10_000,
}


@pytest.mark.parametrize("name", LONG)
def test_time_grows_with_length_only(table, name):
    """A pattern that goes back and forth over such a text takes minutes."""
    import time

    def seconds(content):
        start = time.perf_counter()
        _one(table, content, "x.ts")
        return time.perf_counter() - start

    seconds("x = 1;")
    assert seconds(LONG[name]) < seconds("x = 1;") + 5


def test_very_long_lines(table):
    long = 'const s = "' + "a\\n" * 60_000 + '"; const t = f(' + "(1)," * 5_000 + "2);\n"
    made = _one(table, long + "function g(" + "a(1)," * 3_000 + "b) {}\n", "x.js")
    assert made["error"] is None and made["functions"][0]["name"] == "g"


def test_eligibility_and_skips(table):
    rows = [
        ("s", "a.py", b"def f(): pass", None), ("s", "b.py", b"class A: pass", None), ("s", "c.py", b"x = 1", None),
        ("s", "d.py", b"async def g(): pass", None), ("s", "e.py", b"def (", None), ("s", "f.py", b"", None),
    ]
    extracted = facts.extract(select.with_suffix(table(rows, FILES)))
    assert sorted(row["path"] for row in facts.eligible(extracted).collect()) == ["a.py", "b.py"]
    made = {row["skip_reason"]: row["n_files"] for row in facts.skip_census(extracted).collect()}
    assert made == {"empty": 3, "parse_error": 1}


def test_prompts_hold_indented_json_with_the_facts_in_order(table):
    rows = [("s", "é.py", "def f(a): return 'ünïcode text that is long'".encode(), None), ("s", "long.py", b"def f(): pass\n" + b"x = y\n" * 500, None)]
    made = {r["path"]: r["prompt"] for r in prompt.prompts(facts.extract(select.with_suffix(table(rows, FILES)))).collect()}
    body = {
        "é.py": {
            "filepath": "é.py",
            "functions": [{"name": "f", "lineno": 1, "args": ["a"], "decorators": []}],
            "classes": [], "imports": [], "calls": [], "assignments": [],
            "strings": [{"value": "ünïcode text that is long", "lineno": 1}],
        }
    }
    assert made["é.py"] == V.PROMPT_PREAMBLE + json.dumps(body, indent=2)
    assert made["long.py"].endswith(V.PROMPT_CUT_MARK)
    assert len(made["long.py"]) == len(V.PROMPT_PREAMBLE) + 12000 + len(V.PROMPT_CUT_MARK)


def test_routing(table):
    scans = table([("a", "fast"), ("b", "reasoning"), ("c", "other"), ("d", None)], "scan_id string, model string")
    routed = {row["scan_id"]: row["model_key"] for row in prompt.route(scans).collect()}
    assert routed == {"a": "fast", "b": "reasoning", "c": "fast", "d": "fast"}
    prompts = table([("a", "p", "x"), ("b", "q", "y")], "scan_id string, path string, prompt string")
    for limit in (100, 0):
        made = prompt.route_prompts(prompts, scans, max_rows=limit)
        assert {row["path"]: row["model_name"] for row in made.collect()} == {"p": V.ENDPOINTS[0][2], "q": V.ENDPOINTS[1][2]}


def test_prompts_without_response_count_as_failed(table):
    prompts = table([("s", "a", 1), ("s", "b", 2)], "scan_id string, path string, file_order bigint")
    given = table([("s", "a", "ok", "[]", None)], "scan_id string, path string, status string, raw string, detail string")
    made = prompt.match_responses(prompts, given).orderBy("path").collect()
    assert [(row["status"], row["detail"], row["file_order"]) for row in made] == [("ok", None, 1), ("error", "no response", 2)]


def test_fact_rows(table):
    extracted = facts.extract(select.with_suffix(table([("s", "a.py", b"import os\nf(g())", None)], FILES)))
    assert [tuple(row) for row in facts.fact_rows(extracted, "imports").collect()] == [("s", "a.py", 0, "import os")]
    assert facts.fact_rows(extracted, "calls").filter(F.col("pos") == 1).first()["call"] == "g()"


def test_requests_carry_all_parameters(table):
    prompts = table([("s", "a.py", "look at é", "u", "m")], "scan_id string, path string, prompt string, url string, model_name string")
    row = prompt.requests(prompts, "be strict").first()
    assert (row["url"], row["deadline_s"]) == ("u", 120)
    assert json.loads(row["body"]) == {
        "model": "m", "temperature": 0.1, "max_tokens": 2048,
        "messages": [{"role": "system", "content": "be strict"}, {"role": "user", "content": "look at é"}],
    }


def test_calls_to_a_model_become_rows(table):
    def make_client():
        def client(url, body, deadline):
            if body == "lost":
                raise ConnectionError("no server")
            if body == "bad":
                raise ValueError("status 500")
            return f"{body} {url} {deadline}"

        return client

    rows = [("s", name, "u", name, 9) for name in ("fine", "lost", "bad", *(f"n{n}" for n in range(60)))]
    asked = table(rows, "scan_id string, path string, url string, body string, deadline_s int").coalesce(1)
    answered = prompt.ask(asked, make_client, tasks=5, threads=3)
    assert answered.rdd.getNumPartitions() == 5
    made = {row["path"]: (row["status"], row["raw"], row["detail"]) for row in answered.collect()}
    assert len(made) == 63 and made["n7"] == ("ok", "n7 u 9", None)
    assert {name: made[name] for name in ("fine", "lost", "bad")} == {
        "fine": ("ok", "fine u 9", None), "lost": ("connect_error", None, "no server"), "bad": ("error", None, "status 500"),
    }


def _noting_client(log, failing=()):
    """A client that notes every call and fails for some bodies."""

    def make_client():
        def client(url, body, deadline):
            with open(log, "a") as stream:
                stream.write(body + "\n")
            if body in failing:
                raise RuntimeError("gone")
            return f"answer to {body}"

        return client

    return make_client


def test_a_later_run_asks_only_what_is_not_answered(table, tmp_path):
    rows = [("s", f"p{n}", "u", f"b{n}", 1) for n in range(40)]
    asked = table(rows, "scan_id string, path string, url string, body string, deadline_s int")
    journal, log = f"file://{tmp_path}/journal", tmp_path / "log"
    first = prompt.ask(asked.filter("path < 'p3'"), _noting_client(log, ("b1", "b21")), tasks=3, threads=2, journal=journal).collect()
    assert sum(row["status"] == "ok" for row in first) == len(first) - 2
    before = log.read_text().split()
    again = prompt.ask(asked, _noting_client(log), tasks=5, threads=2, journal=journal).collect()
    assert sorted((r["path"], r["status"], r["raw"]) for r in again) == sorted((p, "ok", f"answer to {b}") for _, p, _, b, _ in rows)
    later = log.read_text().split()[len(before):]
    assert sorted(later) == sorted({f"b{n}" for n in range(40)} - set(before) | {"b1", "b21"})
    changed = asked.withColumn("body", F.concat("body", F.lit("!"))).filter("path = 'p7'")
    assert prompt.ask(changed, _noting_client(log), tasks=1, journal=journal).first()["raw"] == "answer to b7!"


def test_a_task_that_runs_again_repeats_no_answered_call(table, tmp_path):
    """The task dies in the middle of its calls; Spark's own evaluation starts it again."""
    rows = [("s", f"p{n:02}", "u", f"b{n:02}", 1) for n in range(24)]
    asked = table(rows, "scan_id string, path string, url string, body string, deadline_s int")
    log, dead = tmp_path / "log", tmp_path / "dead"

    def make_client():
        def client(url, body, deadline):
            with open(log, "a") as stream:
                stream.write(body + "\n")
            if len(open(log).read().split()) > 13 and not dead.exists():
                dead.write_text("")
                raise SystemExit(1)
            return body.upper()

        return client

    answered = prompt.ask(asked, make_client, tasks=1, journal=f"file://{tmp_path}/journal")
    with pytest.raises(Exception):
        answered.collect()
    made = answered.select("*").collect()
    assert sorted((row["path"], row["raw"]) for row in made) == [(p, b.upper()) for _, p, _, b, _ in rows]
    calls = log.read_text().split()
    # Calls of the last, unfinished handful are asked again, those of whole ones are not.
    assert len(calls) <= 24 + 4 and len(set(calls)) == 24
