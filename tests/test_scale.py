"""Work and memory that must not grow with the number of files a task holds."""

import gc
import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from auditspark import fixed_values as V
from auditspark.operators import extract_py, facts, js_scan, prompt
from auditspark.operators.extract_js import js_facts
from auditspark.operators.extract_py import python_facts
from auditspark.plans import derived, queries

FILES = "scan_id string, path string, content binary, read_error string"


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_parse_errors_pass_over_a_file_once(table):
    files = table([("s", "a.js", b"f(", None), ("s", "b.js", b"f()", None)], FILES).repartition(2)
    found = facts.parse_rejects(js_facts(files))
    assert len(re.findall("MapInArrow|ArrowEvalPython", _plan(found))) == 1
    assert [row["path"] for row in found.collect()] == ["a.js"]


def test_the_pass_hands_over_results_in_small_batches():
    text = "call(1);\n" * 2000
    rows = [{"scan_id": "s", "path": f"{at}.js", "read_error": None, "_text": text if at % 9 else None, "_tags": True} for at in range(300)]
    schema = pa.schema([("scan_id", pa.string()), ("path", pa.string()), ("read_error", pa.string()), ("_text", pa.string()), ("_tags", pa.bool_())])
    made = list(js_scan._scan_all(iter([pa.RecordBatch.from_pylist(rows, schema)])))
    assert max(batch.num_rows for batch in made) < 80
    whole = pa.Table.from_batches(made).to_pylist()
    assert [row["path"] for row in whole] == [row["path"] for row in rows]
    assert [row["_scan"] is None for row in whole] == [not row["_read"] for row in whole] == [at % 9 == 0 for at in range(300)]


def test_python_files_are_taken_in_small_slices():
    contents = [b"x" * 400_000, None, b"y" * 700_000, b"", b"z" * 3_000_000, b"q"]
    batch = pa.RecordBatch.from_arrays([pa.array(contents, pa.binary())], ["content"])
    made = list(extract_py.pieces(batch, "content"))
    assert [piece.num_rows for piece in made] == [3, 2, 1]
    assert pa.Table.from_batches(made)["content"].to_pylist() == contents


def test_nodes_come_in_the_order_of_a_plain_walk():
    code = (
        "import a.b as c\n@m(1)\nclass A(B, x.Y):\n    z: int = f(g(1))\n    def h(self, q=w('d'), *r, **s):\n"
        "        global t\n        with o() as p, u(): v = [i(j) for j in k() if l()]\n        try: e()\n"
        "        except n() as y: del y[aa()]\n        match bb():\n            case C(x=1) | [_, *rest]: dd = ee = lambda ff=gg(): hh(ii())\n"
        "async def jj():\n    return await kk(**ll(), mm=nn()), f'{oo()!r:>{pp()}}', qq() < rr() is ss(), -tt(), {uu(): vv()}\n"
        "type ww[T: xx()] = yy()\n"
    )
    tree = extract_py.ast.parse(code)
    wanted = [node for node in extract_py.ast.walk(tree) if type(node) in extract_py._KINDS]
    assert [node for node in extract_py._nodes(tree) if type(node) in extract_py._KINDS] == wanted


def test_nested_columns_are_the_rows():
    rows = [
        {"scan_id": "s", "path": "a", "lang": "py"} | extract_py.facts_of("a", b"@m\ndef f(a, b): g(a)\nx = y = h()\nclass A(B): pass\nimport q\n", None),
        {"scan_id": "s", "path": "b", "lang": "py", "error": "e"},
        {"scan_id": "s", "path": "c", "lang": "py"} | extract_py.facts_of("c", b"", None),
    ]
    assert extract_py._batch(rows).equals(pa.RecordBatch.from_pylist(rows, schema=extract_py._ARROW))


def test_the_collector_rests_while_files_are_read(monkeypatch):
    """It would walk through every tree of syntax again and again; small slices bound what it leaves."""
    seen = []

    class Files:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            return run

    def facts_of(*file):
        seen.append(gc.isenabled())
        if file[0] == "bad":
            raise OSError
        return whole(*file)

    whole = extract_py.facts_of
    monkeypatch.setattr(extract_py, "facts_of", facts_of)
    run = python_facts(Files())

    def batch(*paths):
        rows = [{"scan_id": "s", "path": path, "content": b"x = y\n" * 10_000, "read_error": None} for path in paths]
        kinds = [("scan_id", pa.string()), ("path", pa.string()), ("content", pa.binary()), ("read_error", pa.string())]
        return iter([pa.RecordBatch.from_pylist(rows, pa.schema(kinds))])

    made = []
    for one in run(batch(*"abcdefg")):
        assert gc.isenabled()
        made.append(one)
    assert seen == [False] * 7 and [one.num_rows for one in made] == [3, 3, 1]
    assert pa.Table.from_batches(made)["path"].to_pylist() == list("abcdefg")
    with pytest.raises(OSError):
        list(run(batch("bad")))
    assert gc.isenabled()


def _facts(draw, kind, absent):
    """Random facts of an Arrow type, some of them absent."""
    if absent and draw.random() < 0.1:
        return None
    if pa.types.is_list(kind):
        length = draw.choice([0, 1, 2, 3, 40, 1300]) if draw.random() < 0.1 else draw.randrange(3)
        return [_facts(draw, kind.value_type, absent) for _ in range(length)]
    if pa.types.is_struct(kind):
        return {one.name: _facts(draw, one.type, absent) for one in kind}
    if pa.types.is_integer(kind):
        return draw.choice([0, 7, 12345, -3])
    if draw.random() < 0.02:
        return draw.choice(["x", "é", '"']) * draw.choice([11_990, 12_000, 30_000])
    return "".join(draw.choice('ab<[] "\\/\n\t\x00\x1f\x7f\x80é\u2028€😀') for _ in range(draw.randrange(12)))


def test_prompts_are_written_by_columns():
    """The text is that of ``json``, which no fact is handed to: most facts of a long file lie behind the cut."""
    draw = random.Random(7)
    path, kinds = extract_py._ARROW.field("path").type, [extract_py._ARROW.field(kind) for kind in prompt.schemas.FACT_TYPES]
    for absent in (False, True, False, True):
        rows = [{"filepath": _facts(draw, path, absent)} | {one.name: _facts(draw, one.type, absent) for one in kinds} for _ in range(50)]
        documents = pa.array(rows, pa.struct([("filepath", path), *kinds]))
        wanted = []
        for row in rows:
            text = json.dumps({row["filepath"]: row}, indent=2)
            cut = text[: V.PROMPT_LIMIT] + V.PROMPT_CUT_MARK
            wanted.append(V.PROMPT_PREAMBLE + (cut if len(text) > V.PROMPT_LIMIT else text))
        assert any(text.endswith(V.PROMPT_CUT_MARK) for text in wanted) and not all(text.endswith(V.PROMPT_CUT_MARK) for text in wanted)
        assert prompt._prompts(documents).to_pylist() == wanted
        assert prompt._prompts(documents.slice(7, 20)).to_pylist() == wanted[7:27]


@pytest.mark.parametrize("over", [-1, 0, 1])
def test_the_cut_begins_behind_the_limit(over):
    draw = random.Random(1)
    kinds = [extract_py._ARROW.field(kind) for kind in prompt.schemas.FACT_TYPES]
    row = {"filepath": "a.py"} | {one.name: [] for one in kinds} | {"strings": [_facts(draw, kinds[-1].type.value_type, False) for _ in range(9)]}
    row["imports"] = ["i" * (V.PROMPT_LIMIT + over - len(json.dumps({"a.py": row | {"imports": [""]}}, indent=2)))]
    text = json.dumps({"a.py": row}, indent=2)
    assert len(text) == V.PROMPT_LIMIT + over
    made = prompt._prompts(pa.array([row], pa.struct([("filepath", pa.string()), *kinds]))).to_pylist()
    assert made == [V.PROMPT_PREAMBLE + (text[: V.PROMPT_LIMIT] + V.PROMPT_CUT_MARK if over > 0 else text)]


@pytest.mark.parametrize("line", ["x = y\n", "import q\n", "f()\n"])
def test_facts_behind_the_cut_are_not_handed_over(table, line):
    content = "def f(): pass\n" + line * 20_000
    found = python_facts(table([("s", "a.py", content.encode(), None)], FILES))
    made = prompt.prompts(found)
    assert "slice(" in _plan(made)
    row = found.first().asDict(recursive=True)
    whole = json.dumps({"a.py": {"filepath": "a.py"} | {kind: row[kind] for kind in prompt.schemas.FACT_TYPES}}, indent=2)
    assert made.first()["prompt"] == V.PROMPT_PREAMBLE + whole[: V.PROMPT_LIMIT] + V.PROMPT_CUT_MARK


def test_a_table_of_one_row_group_is_spread(spark, tmp_path):
    spark.range(1000).select("id", F.sha2(F.col("id").cast("string"), 512).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    kept = {key: spark.conf.get(key) for key in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for key in kept:
            spark.conf.set(key, "4096")
        assert spark.read.parquet(f"{tmp_path}/t.parquet").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
        spread = derived.table(spark, str(tmp_path), "t")
        assert spread.select(F.spark_partition_id()).distinct().count() >= spark.sparkContext.defaultParallelism
        assert spread.count() == 1000
    finally:
        for key, value in kept.items():
            spark.conf.set(key, value)


def test_a_screen_stores_the_facts_it_reads(table):
    sources = table([("s", "a.py", ".py", b"f()", None), ("s", "a.js", ".js", b"f()", None)], "scan_id string, path string, ext string, content binary, read_error string")
    stored = queries._stored_facts(sources, "calls")
    assert stored.columns == ["scan_id", "path", "lang", "calls"]
    assert [len(row["calls"]) for row in stored.collect()] == [1, 1]


def test_a_search_reads_a_text_once_for_all_its_groups(table):
    facts_of_one = js_facts(table([("s", "a.js", b"const a = f(1), b = (c) => g(c);", None)], FILES)).select("calls")
    plan = _plan(facts_of_one)
    assert plan.count("(?<arguments>") == 1


def test_files_of_words_are_dealt_over_many_tasks(spark, tmp_path, monkeypatch):
    """Whole tables of few row groups, and of more rows than a task takes; the texts stay where they are."""
    texts = F.array(F.lit("a b  c"), F.lit(""), F.lit(None), F.lit(" "), F.lit("one\nline"))
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), texts[(F.col("id") % 5).cast("int")].alias("text"), F.lit("s").alias("source"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(derived, "WORD_FILES_PER_TASK", 300)
    files = derived.word_files(spark, str(tmp_path))
    held = [row["count"] for row in files.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) == 10 and max(held) <= 310
    moved = _plan(files).split("Exchange RoundRobinPartitioning(10)")
    assert len(moved) == 2 and "repeat(" in moved[0] and "split(" in moved[1]
    lines = {0: 4, 1: 1, 2: None, 3: 2, 4: 1}
    for row in files.collect():
        known = lines[int(row["path"].removeprefix("/repos/d").removesuffix(".py")) % 5]
        assert row["content"] == (None if known is None else b"def f(a):\n    pass\n" + b"x = y\n" * known)


def test_no_more_facts_are_handed_over_than_reach_the_limit(table):
    """Absent facts take less room, so that more of them lie before the cut."""
    call, text = {"call": "", "lineno": 1}, ["s", "a.py", "py", None, [{"name": "f", "lineno": 1, "args": [], "decorators": []}], [], []]
    many = [[call] * 2000, [None] * 900, [call] * 30 + [None] * 600, [None] * 2000]
    rows = [(*text, calls, [], []) for calls in many]
    found = table(rows, prompt.schemas.FACTS)
    documents = [json.dumps({"a.py": {"filepath": "a.py", "functions": row[4], "classes": [], "imports": [], "calls": row[7], "assignments": [], "strings": []}}, indent=2) for row in rows]
    cut = [text[: V.PROMPT_LIMIT] + V.PROMPT_CUT_MARK if len(text) > V.PROMPT_LIMIT else text for text in documents]
    assert [one.endswith(V.PROMPT_CUT_MARK) for one in cut] == [True, False, False, True]
    assert sorted(row["prompt"] for row in prompt.prompts(found).collect()) == sorted(V.PROMPT_PREAMBLE + one for one in cut)
    one, two = (len(json.dumps({"a.py": {"calls": [call] * number}}, indent=2)) for number in (1, 2))
    handed = found.select(F.size(prompt._before_cut(found, "calls")).alias("n")).collect()
    assert sorted(row["n"] for row in handed) == [V.PROMPT_LIMIT // (two - one) + 1, 630, 900, 1001]
