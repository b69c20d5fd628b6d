import os

import pytest
from pyspark.sql import functions as F

from auditspark.operators import select
from auditspark.session import materialize
from auditspark.sources import srctree

FILES = "scan_id string, path string, rel_path string, content binary, read_error string"


def _tree(root, names):
    for name in names:
        path = root / name
        if name.endswith("/"):
            path.mkdir(parents=True, exist_ok=True)
        else:
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(name.encode())
    return str(root)


def _names(frame, column="rel_path"):
    return sorted(row[column] for row in frame.select(column).collect())


NAMES = [
    "a.py", "A.PY", ".f.py", "__init__.py", ".py", "x.tsx", "x.jsx", "readme.txt", "s/b.js", "s/c.ts", "s/d.mjs",
    "node_modules/x/dist/a.js", ".hidden/a.py", "build/", "Build/a.py", "public/a.js", "s/.venv/lib/q.py", "s/t/u/v/w.py",
]
KEPT = [
    ".f.py", "A.PY", "Build/a.py", "__init__.py", "a.py", "public/a.js", "s/b.js", "s/c.ts", "s/d.mjs", "s/t/u/v/w.py",
]


@pytest.mark.parametrize("splits", [1, 3, 64])
def test_a_tree_gives_its_source_files_however_it_is_split(spark, tmp_path, splits):
    listed = srctree.entries(spark, {"s": _tree(tmp_path, NAMES)}, splits)
    files = srctree.files_of(listed, task_bytes=1 << 17)
    assert _names(select.collect_files(files)) == KEPT
    assert {row["rel_path"]: row["content"].decode() for row in files.collect()} == {n: n for n in _names(files)}
    named = select.pruned_directories(srctree.dirs_of(listed))
    assert [(row["n_names"], row["names"]) for row in named.collect()] == [(3, [".venv", "build", "node_modules"])]
    assert select.directory_sample(named).first()["sample"] == ".venv, build, node_modules"


def test_a_table_of_scans_lists_the_same_entries(spark, table, tmp_path):
    targets = {"s": _tree(tmp_path / "s", NAMES), "t": str(tmp_path / "s/a.py"), "u": str(tmp_path / "gone")}
    scans = table(list(targets.items()), "scan_id string, target_path string")
    made = sorted(map(tuple, srctree.entries_of(scans, tasks=3).collect()))
    assert made == sorted(map(tuple, srctree.entries(spark, targets).collect()))
    assert {row[0] for row in made if row[2] == "target"} == {"s", "t"}


def test_a_file_as_target_is_never_pruned(spark, tmp_path):
    _tree(tmp_path, ["dist/a.py", "dist/b.txt"])
    targets = {"py": str(tmp_path / "dist/a.py"), "txt": str(tmp_path / "dist/b.txt")}
    files = srctree.files_of(srctree.entries(spark, targets))
    assert _names(select.collect_files(files), "path") == [targets["py"]]


def test_a_target_below_a_pruned_name_is_scanned(spark, tmp_path):
    root = tmp_path / "build" / "app"
    root.mkdir(parents=True)
    files = srctree.files_of(srctree.entries(spark, {"s": _tree(root, ["a.py"])}))
    assert _names(select.collect_files(files)) == ["a.py"]


def test_linked_directories_are_not_followed_and_dangling_links_are_errors(spark, tmp_path):
    root = tmp_path / "root"
    root.mkdir()
    _tree(tmp_path / "other", ["x.py"])
    os.symlink(tmp_path / "other", root / "link")
    os.symlink(tmp_path / "nowhere.py", root / "gone.py")
    files = srctree.files_of(srctree.entries(spark, {"s": _tree(root, ["a.py"])}))
    made = {row["rel_path"]: row["read_error"] for row in files.collect()}
    assert made["a.py"] is None and "No such file" in made["gone.py"] and set(made) == {"a.py", "gone.py"}


@pytest.mark.parametrize("listing", ["source", "table"])
def test_nothing_is_lost_beside_odd_entries(spark, table, tmp_path, listing):
    root = tmp_path / "root"
    deep = "/".join(f"l{n}" for n in range(10)) + "/x.py"
    _tree(root, ["a.py", "b.py", "c/d.py", "e/f.js", "g.ts", "h.mjs", deep])
    os.symlink(root / "self.py", root / "self.py")
    with open(os.fsencode(str(root)) + b"/caf\xe9.py", "w") as stream:
        stream.write("x = 1\n")
    (root / "closed").mkdir()
    (root / "closed" / "y.py").write_text("y = 1\n")
    os.chmod(root / "closed", 0)
    try:
        if listing == "source":
            listed = srctree.entries(spark, {"s": str(root)})
        else:
            listed = srctree.entries_of(table([("s", str(root))], "scan_id string, target_path string"))
        made = {row["rel_path"]: (row["content"], row["read_error"]) for row in srctree.files_of(listed).collect()}
    finally:
        os.chmod(root / "closed", 0o700)
    names = {"a.py", "b.py", "c/d.py", "e/f.js", "g.ts", "h.mjs", deep}
    assert names <= set(made) and all(made[name][1] is None for name in names)
    odd = f"caf{srctree.ESCAPE}e9.py"
    assert bytes(made[odd][0]) == b"x = 1\n"
    assert made["self.py"][1]
    assert set(made) - names - {odd, "self.py"} <= {"closed/y.py"}


def test_missing_targets_have_an_error_and_empty_ones_have_none(spark, table, tmp_path):
    (tmp_path / "empty").mkdir()
    targets = {"empty": str(tmp_path / "empty"), "gone": str(tmp_path / "gone")}
    listed = srctree.entries(spark, targets)
    scans = table(list(targets.items()), "scan_id string, target_path string")
    made = {row["scan_id"]: row["error"] for row in select.scan_status(scans, listed).collect()}
    assert made == {"empty": None, "gone": f"target path does not exist: {targets['gone']}"}


def _files(table, rows):
    """Rows of (scan, path, content)."""
    return select.with_suffix(
        table([(s, p, p, c if isinstance(c, bytes) else c.encode(), None) for s, p, c in rows], FILES)
    )


def test_markers_are_tested_per_language(table):
    files = _files(table, [
        ("s", "a.py", "from langgraph.graph import X"), ("s", "b.py", "import { x } from '@langchain/core'"),
        ("s", "c.js", "import { x } from '@langchain/core'"), ("s", "d.ts", "mytool(1)"), ("s", "e.mjs", "from langgraph"),
        ("s", "f.py", b"\xff\xfeStateGraph\x80"), ("s", "g.py", "@tool\n"), ("s", "h.py", ""),
    ])
    made = {row["path"]: row["relevant"] for row in select.with_relevance(files).collect()}
    assert made == {
        "a.py": True, "b.py": False, "c.js": True, "d.ts": True, "e.mjs": False, "f.py": False, "g.py": True, "h.py": False,
    }


@pytest.mark.parametrize("buckets", [1, 5, None])
def test_scans_without_relevant_files_keep_all(table, buckets):
    files = select.stored_files(_files(table, [
        ("one", "a.py", "StateGraph"), ("one", "b.py", "x"), ("one", "c.js", "y"),
        ("none", "a.py", "x"), ("none", "b.js", "y"), ("broken", "a.py", b"\xff"),
    ]), buckets)
    counts = materialize(select.relevance_counts(files))
    chosen = select.select_files(files, counts)
    assert sorted((row["scan_id"], row["path"]) for row in chosen.collect()) == [
        ("broken", "a.py"), ("none", "a.py"), ("none", "b.js"), ("one", "a.py"),
    ]
    made = {row["scan_id"]: tuple(row)[1:] for row in select.census(counts).collect()}
    assert made == {"one": (3, 1, 2), "none": (2, 2, 0), "broken": (1, 1, 0)}
    assert [row["path"] for row in select.unreadable(chosen).collect()] == ["a.py"]


def test_contents_are_not_moved(table):
    rows = [(f"s{n % 40}", f"a{n}.py", "StateGraph" if n % 40 > 20 else "x") for n in range(400)]
    files = select.stored_files(_files(table, rows + [("none", "b.js", "y")]).repartition(7))
    counts = materialize(select.relevance_counts(files))
    chosen = select.select_files(files, counts)
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ShuffledHashJoin" in plan and "Sort" not in plan
    assert chosen.count() == 401
    counted = select.relevance_counts(files)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<scan_id:string,relevant:boolean>" in counted


def test_tasks_read_equal_bytes_and_a_huge_file_stands_alone(table):
    shape = "scan_id string, path string, rel_path string, size long"
    rows = [("hot" if n % 3 else f"s{n % 5}", f"{n:05}.py", "", 1000 * (n % 9)) for n in range(4000)] + [("s1", "00500x.py", "", 50 << 20)]
    target = 8 << 20
    dealt, slots = srctree.shared_out(table(rows, shape).repartition(6), target)
    made = dealt.collect()
    assert sorted(tuple(row)[:4] for row in made) == sorted(rows)
    loads = {}
    for row in made:
        loads.setdefault(row["slot"], []).append(row["size"] + srctree.OPENING)
    assert set(loads) == set(range(slots))
    assert [len(some) for some in loads.values() if max(some) > target] == [1]
    rest = sorted(sum(some) for some in loads.values() if max(some) <= target)
    assert rest[-1] < target + srctree.OPENING + 8000 and rest[1] > target - srctree.OPENING - 8000
    files = srctree.files_of(table([("s", "file", "/nowhere/a.py", "a.py", 5)] * 2, "scan_id string, kind string, path string, rel_path string, size long"), 1)
    assert files.rdd.getNumPartitions() == 3 and files.filter("read_error is null").count() == 0


def test_filters_are_taken_over_by_the_source(spark, tmp_path):
    root = _tree(tmp_path, [*NAMES, "s/t/x.js", "s/tt/y.js", "st/z.js"])
    listed = srctree.entries(spark, {"s": root}, 4)
    some = listed.filter(F.col("kind") == "file").filter(F.col("ext").isin(".js", ".ts")).filter(F.startswith("rel_path", F.lit("s/t")))
    assert _names(some) == ["s/t/x.js", "s/tt/y.js"]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan" in plan and "Filter (" not in plan
    assert _names(listed.filter("kind = 'file' and rel_path like '%.mjs'")) == ["s/d.mjs"]
    os.chmod(os.path.join(root, "st"), 0)
    try:
        reader = srctree.SourceTreeReader({"scans": '{"s": "%s"}' % root, "splits": "64"})
        left = list(reader.pushFilters([srctree.StringStartsWith(("rel_path",), "s/t/u")]))
        assert left == [] and {share.directory for share in reader.partitions()} == {
            root, *(os.path.join(root, name) for name in ("s", "s/t", "s/t/u", "s/t/u/v")),
        }
    finally:
        os.chmod(os.path.join(root, "st"), 0o700)


def test_file_order_is_code_point_order_in_any_partitioning(spark, table):
    paths = ["a/b.py", "a-b/x.py", "a.py", "A/z.py", "é.py", "\U0001f600.py", "￿.py", "a/b/c.py", *[f"n{i}.py" for i in range(300)]]
    rows = [(scan, path, path, b"", None) for scan in ("s", "t") for path in paths]
    expected = {path: i for i, path in enumerate(sorted(paths), 1)}
    for parts in (1, 4, 17):
        numbered = select.number_files(table(rows, FILES).repartition(parts))
        for scan in ("s", "t"):
            made = numbered.filter(F.col("scan_id") == scan).collect()
            assert {row["path"]: row["file_order"] for row in made} == expected
