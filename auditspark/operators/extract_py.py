"""Facts of Python files: one pass of the standard library's ``ast`` per file, in Arrow batches."""

import ast
import gc
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from itertools import accumulate, chain
from operator import itemgetter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from auditspark import fixed_values as V
from auditspark import schemas

_KINDS = {
    ast.FunctionDef: "functions",
    ast.ClassDef: "classes",
    ast.Import: "imports",
    ast.ImportFrom: "imports",
    ast.Call: "calls",
    ast.Assign: "assignments",
    ast.Constant: "strings",
}
_PLACE = ("lineno", pa.int32())
_TEXTS = pa.list_(pa.string())
_ARROW = pa.schema([
    ("scan_id", pa.string()),
    ("path", pa.string()),
    ("lang", pa.string()),
    ("error", pa.string()),
    ("functions", pa.list_(pa.struct(
        [("name", pa.string()), _PLACE, ("args", _TEXTS), ("decorators", _TEXTS)]))),
    ("classes", pa.list_(pa.struct([("name", pa.string()), _PLACE, ("bases", _TEXTS)]))),
    ("imports", _TEXTS),
    ("calls", pa.list_(pa.struct([("call", pa.string()), _PLACE]))),
    ("assignments", pa.list_(pa.struct([("targets", _TEXTS), ("value", pa.string()), _PLACE]))),
    ("strings", pa.list_(pa.struct([("value", pa.string()), _PLACE]))),
])
# Source text per output batch: facts take many times the room of the text they come from.
FLUSH_BYTES = 1 << 20
# Less for Python files, whose facts are objects at first: few of them stay near the processor.
PYTHON_BYTES = 1 << 17
# Fields without a node that could be a fact, and values that are no such node and have none below them.
_PLAIN_FIELDS = frozenset(("ctx", "op", "ops", "id", "name", "names", "arg", "attr", "module", "type_comment"))
_LEAVES = frozenset((
    ast.Name, ast.Pass, ast.Break, ast.Continue, ast.Global, ast.Nonlocal, ast.alias, str, int, bool, type(None),
))
_UNREADABLE = (SyntaxError, ValueError, RecursionError, MemoryError)


class _Fields(dict):
    """Fields in which facts may lie, by kind of node."""

    def __missing__(self, kind: type) -> tuple[str, ...]:
        inner = () if kind is ast.Constant else (name for name in kind._fields if name not in _PLAIN_FIELDS)
        self[kind] = tuple(inner)
        return self[kind]


_FIELDS = _Fields()


def _nodes(tree: ast.AST) -> list[ast.AST]:
    """All nodes that can be facts, in the order of ``ast.walk``."""
    found = [tree]
    # The list grows while it is walked: breadth first.
    for node in found:
        for name in _FIELDS[type(node)]:
            inner = getattr(node, name)
            if type(inner) is list:
                for one in inner:
                    if type(one) not in _LEAVES:
                        found.append(one)
            elif type(inner) not in _LEAVES:
                found.append(inner)
    return found


def _literal(text: str) -> str:
    """A cut literal in a form that Arrow can hold (lone surrogates become ``?``)."""
    return text[: V.LITERAL_CUT].encode("utf-8", "replace").decode("utf-8")


def _is_long_text(value: object) -> bool:
    return isinstance(value, str) and len(value) > V.LITERAL_MIN


# How a node becomes a fact, its fields in the order of the schema; ``text`` turns an expression into its source.
_SHAPES = {
    "functions": lambda n, text: (
        n.name, n.lineno, [parameter.arg for parameter in n.args.args], [text(mark) for mark in n.decorator_list],
    ),
    "classes": lambda n, text: (n.name, n.lineno, [text(base) for base in n.bases]),
    "imports": lambda n, text: text(n),
    "calls": lambda n, text: (text(n), n.lineno),
    "assignments": lambda n, text: ([text(target) for target in n.targets], text(n.value), n.lineno),
    "strings": lambda n, text: (_literal(n.value), n.lineno),
}


def facts_of(path: str, content: bytes | None, read_error: str | None) -> dict:
    """The facts of one file, or its error."""
    if read_error is not None or content is None:
        return {"error": read_error or "no content"}
    found = {kind: [] for kind in schemas.FACT_TYPES}
    # A call that is assigned is asked for twice.
    written = cache(ast.unparse)

    def text(node: ast.AST) -> str:
        # A bare name, by far the most frequent expression, needs no unparser.
        return node.id if type(node) is ast.Name else written(node)

    try:
        code = content.decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
        # Breadth first: the order of every list below.
        for node in _nodes(ast.parse(code, filename=path)):
            kind = _KINDS.get(type(node))
            if kind is not None and (kind != "strings" or _is_long_text(node.value)):
                found[kind].append(_SHAPES[kind](node, text))
    except _UNREADABLE as problem:
        return {"error": str(problem)}
    return found


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """An Arrow array of nested values, made field by field from flat lists."""
    if pa.types.is_list(kind):
        absent = None in values
        held = [one or () for one in values] if absent else values
        offsets = list(accumulate(map(len, held), initial=0))
        inner = _column(list(chain.from_iterable(held)), kind.value_type)
        if absent:
            # An absent list is an absent offset.
            offsets[:-1] = [None if one is None else at for one, at in zip(values, offsets)]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner, type=kind)
    if pa.types.is_struct(kind):
        return pa.StructArray.from_arrays(
            [_column(list(map(itemgetter(at), values)), field.type) for at, field in enumerate(kind)], fields=list(kind)
        )
    return pa.array(values, kind)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [_column([row.get(field.name) for row in rows], field.type) for field in _ARROW], schema=_ARROW
    )


def pieces(batch: pa.RecordBatch, column: str, most: int = FLUSH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of a column of texts."""
    begin = size = 0
    for at, length in enumerate(pc.binary_length(batch.column(column)).to_pylist(), 1):
        size += length or 0
        if size > most or at == batch.num_rows:
            yield batch.slice(begin, at - begin)
            begin, size = at, 0


@contextmanager
def _no_collection() -> Iterator[None]:
    """Trees of syntax hold no cycles, so a search for some would only walk through them again and again."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def python_facts(files: DataFrame) -> DataFrame:
    """One row of facts per file of ``files(scan_id, path, content, read_error)``."""

    def batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for piece in pieces(batch, "content", PYTHON_BYTES):
                with _no_collection():
                    rows = []
                    for row in piece.to_pylist():
                        known = {"scan_id": row["scan_id"], "path": row["path"], "lang": "py"}
                        rows.append(known | facts_of(row["path"], row["content"], row["read_error"]))
                    made = _batch(rows)
                yield made

    needed = files.select("scan_id", "path", "content", "read_error")
    return needed.mapInArrow(batches, schemas.FACTS)
