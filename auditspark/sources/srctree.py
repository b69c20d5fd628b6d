"""``spark.read.format("srctree")`` lists the source files below target paths; contents come after.

For a table of targets use :func:`entries_of`, which lists the trees level by level as Spark jobs.

Options of the format: ``scans`` (JSON object of scan id to target path) and ``splits`` (about how
many partitions to plan, default 64). Planning looks at directory names, breadth first, until there
are enough directories to share out; the rest of the walk happens in the tasks. Names that start
with a dot or an underscore are listed like all others. Filters on ``kind``, ``ext`` and the beginning
of ``rel_path`` are taken over by the source: directories that such a beginning rules out are not
opened.

Listing yields names and sizes. Contents are read after the names were spread over tasks of about
equal bytes, so neither a directory or scan that holds a third of all files nor a huge file holds up
the others.
"""

import json
import os
import re
from collections import deque
from collections.abc import Iterator
from functools import reduce
from itertools import batched, chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringStartsWith

from auditspark import fixed_values as V
from auditspark.session import materialize

ENTRIES = "scan_id string, target_path string, kind string, path string, rel_path string, ext string, size long"
TYPES = [pa.int64() if field.endswith(" long") else pa.string() for field in ENTRIES.split(", ")]
# A task reads about so many bytes; opening a file counts like reading some.
READ_BYTES = 256 << 20
OPENING = 1 << 16
# Stands before a byte of a file name that is not UTF-8; no path holds this character itself.
ESCAPE = "\x00"
CONTENTS = "scan_id string, path string, rel_path string, content binary, read_error string"


class Share(InputPartition):
    """Part of one target: a directory with all below it, or only the entries of its own level."""

    def __init__(self, scan_id: str, target: str, directory: str, deep: bool):
        self.scan_id, self.target, self.directory, self.deep = scan_id, target, directory, deep


def _pruned(name: str) -> bool:
    return name.startswith(".") or name in V.PRUNED_DIRECTORIES


def _level(directory: str) -> tuple[list[str], list[str]]:
    """Names of the sub-directories and of the other entries of a directory.

    An entry whose kind cannot be told, such as a link to itself, is no directory; it takes nothing
    else with it. A directory that cannot be read is empty.
    """
    dirs, files = [], []
    try:
        entries = os.scandir(directory)
    except OSError:
        return dirs, files
    with entries:
        while True:
            try:
                entry = next(entries, None)
            except OSError:
                break
            if entry is None:
                break
            try:
                inner = entry.is_dir()
            except OSError:
                inner = False
            (dirs if inner else files).append(entry.name)
    return dirs, files


def _below(directory: str, dirs: list[str]) -> list[str]:
    """Sub-directories that a walk enters: neither pruned nor symbolic links."""
    paths = [os.path.join(directory, name) for name in dirs if not _pruned(name)]
    return [path for path in paths if not os.path.islink(path)]


def _text(path: str) -> str:
    """A path as valid text. Bytes of a name that are not UTF-8 are spelled out; :func:`_path` undoes it."""
    return "".join(
        f"{ESCAPE}{ord(char) - 0xDC00:02x}" if 0xDC80 <= ord(char) <= 0xDCFF else char for char in path
    )


def _path(text: str) -> str:
    return re.sub(f"{ESCAPE}([89a-f][0-9a-f])", lambda found: chr(0xDC00 + int(found[1], 16)), text)


class Wanted:
    """What filters leave of a listing; a None leaves all."""

    def __init__(self):
        self.allowed: dict[str, set[str] | None] = {"kind": None, "ext": None}
        self.beginnings: list[str] = []

    def take(self, one: Filter) -> bool:
        """Take over a filter, if it is of a known form."""
        name = one.attribute[0] if len(getattr(one, "attribute", ())) == 1 else None
        if name is not None and isinstance(one, IsNotNull):
            # No column of a listing is ever null.
            return True
        if name in self.allowed and isinstance(one, (EqualTo, In)):
            values = set(one.value if isinstance(one, In) else [one.value])
            known = self.allowed[name]
            self.allowed[name] = values if known is None else known & values
            return True
        if name == "rel_path" and isinstance(one, StringStartsWith):
            self.beginnings.append(one.value)
            return True
        return False

    def keeps(self, row: tuple) -> bool:
        _, _, kind, _, rel_path, ext, _ = row
        return (
            all(known is None or value in known for known, value in zip(self.allowed.values(), (kind, ext)))
            and all(rel_path.startswith(begin) for begin in self.beginnings)
        )

    def enters(self, rel_path: str) -> bool:
        """Can anything below the directory be wanted?"""
        inside = f"{rel_path}/"
        return all(inside.startswith(begin) or begin.startswith(inside) for begin in self.beginnings)


def _walk(scan_id: str, target: str, start: str, deep: bool, wanted: Wanted | None = None) -> Iterator[tuple]:
    """Entries of one directory, or of all below it, or the one entry of a file.

    A walk of one level ends with an ``enter`` entry for each directory that goes on.
    """

    start, wanted = _path(start), wanted or Wanted()

    def inner(path: str) -> str:
        return _text(os.path.relpath(path, target) if path != target else os.path.basename(path))

    def row(kind: str, path: str) -> tuple:
        ext, size = "", 0
        if kind == "file":
            ext = os.path.splitext(path)[1].lower()
            try:
                size = os.stat(path).st_size
            except OSError:
                size = 0
        return (scan_id, target, kind, _text(path), inner(path), ext, size)

    def entered(directory: str, dirs: list[str]) -> list[str]:
        return [path for path in _below(directory, dirs) if wanted.enters(inner(path))]

    if os.path.isfile(start):
        yield row("target", start)
        if os.path.splitext(start)[1].lower() in V.SOURCE_SUFFIXES:
            yield row("file", start)
        return
    if start == target and os.path.exists(target):
        yield row("target", target)
    waiting = [start]
    while waiting:
        directory = waiting.pop()
        dirs, files = _level(directory)
        for name in dirs:
            yield row("dir", os.path.join(directory, name))
        for name in files:
            if os.path.splitext(name)[1].lower() in V.SOURCE_SUFFIXES:
                yield row("file", os.path.join(directory, name))
        if deep:
            waiting.extend(entered(directory, dirs))
        else:
            yield from (row("enter", path) for path in entered(directory, dirs))


class SourceTreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.scans = json.loads(options["scans"])
        self.splits = int(options.get("splits", "64"))
        self.wanted = Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take over what the walk can use; Spark tests the rest."""
        return (one for one in filters if not self.wanted.take(one))

    def partitions(self) -> list[Share]:
        existing = {scan: path for scan, path in self.scans.items() if os.path.exists(path)}
        waiting = deque((scan_id, target, target) for scan_id, target in existing.items())
        shares = []
        while waiting and len(waiting) + len(shares) < self.splits:
            scan_id, target, directory = waiting.popleft()
            shares.append(Share(scan_id, target, directory, deep=False))
            if os.path.isdir(directory):
                dirs, _ = _level(directory)
                below = ((path, _text(os.path.relpath(path, target))) for path in _below(directory, dirs))
                waiting.extend((scan_id, target, path) for path, inside in below if self.wanted.enters(inside))
        return shares + [Share(*rest, deep=True) for rest in waiting]

    def read(self, share: Share) -> Iterator[tuple]:
        found = _walk(share.scan_id, share.target, share.directory, share.deep, self.wanted)
        yield from (row for row in found if row[2] != "enter" and self.wanted.keeps(row))


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "srctree"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema) -> SourceTreeReader:
        return SourceTreeReader(self.options)


def entries(spark: SparkSession, targets: dict[str, str], splits: int = 64) -> DataFrame:
    """Files, directories and existing targets of ``targets``, a scan id to target path mapping.

    Pruned directories are listed but not entered; ``kind`` is ``file``, ``dir`` or ``target``.
    """
    spark.dataSource.register(SourceTree)
    # Spark refuses a source that takes over filters unless this is set.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("srctree").option("scans", json.dumps(targets))
    return reader.option("splits", splits).load()


def entries_of(scans: DataFrame, tasks: int | None = None) -> DataFrame:
    """The same for a table ``scans(scan_id, target_path)`` of any length and trees of any depth.

    Spark lists one level of all trees, spreads the directories found over the tasks, lists the next
    level, and so on until no directory is left. A task holds single directories only, names never
    pass through the driver, and a tree with a third of all files is shared out like all others.
    """
    tasks = tasks or 4 * scans.sparkSession.sparkContext.defaultParallelism
    names = [field.split()[0] for field in ENTRIES.split(", ")]

    def walk(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = (start for batch in source for start in batch.to_pylist())
        rows = chain.from_iterable(
            _walk(start["scan_id"], start["target_path"], start["path"], deep=False) for start in starts
        )
        for some in batched(rows, 10_000):
            columns = [pa.array(column, kind) for column, kind in zip(zip(*some), TYPES)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    starts = scans.select("scan_id", "target_path", F.col("target_path").alias("path"))
    found = []
    while True:
        listed = materialize(starts.repartition(tasks, "scan_id", "path").mapInArrow(walk, ENTRIES))
        found.append(listed.filter(F.col("kind") != "enter"))
        starts = listed.filter(F.col("kind") == "enter").select("scan_id", "target_path", "path")
        if starts.isEmpty():
            return reduce(DataFrame.unionByName, found)


def dirs_of(listed: DataFrame) -> DataFrame:
    return listed.filter(F.col("kind") == "dir").select("scan_id", "rel_path")


def shared_out(named: DataFrame, task_bytes: int = READ_BYTES) -> tuple[DataFrame, int]:
    """Add ``slot`` to ``named(scan_id, path, size, ...)``, and say how many slots there are.

    Files follow one another by scan and path, and a slot ends where the running sum of their sizes
    passes the next multiple of ``task_bytes``. A file of that size or more has a slot of its own.
    """
    weight, huge = F.col("size") + OPENING, F.col("size") + OPENING >= task_bytes
    ranged = materialize(
        named.repartitionByRange("scan_id", "path")
        .sortWithinPartitions("scan_id", "path")
        .select("*", F.when(huge, 0).otherwise(weight).alias("_weight"), huge.cast("long").alias("_huge"))
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_slice", F.spark_partition_id())
    )
    sums = [F.coalesce(F.sum(name), F.lit(0)).alias(f"{name}_sum") for name in ("_weight", "_huge")]
    # One row per range partition, of which there are as many as shuffle partitions at most.
    slices = ranged.groupBy("_slice").agg(*sums)
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select("_slice", *[F.coalesce(F.sum(f"{name}_sum").over(earlier), F.lit(0)).alias(f"{name}_start") for name in ("_weight", "_huge")])
    bytes_, n_huge = ranged.agg(*sums).first()
    n_small = bytes_ // task_bytes + 1
    inside = Window.partitionBy("_slice").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    before = {name: F.col(f"{name}_start") + F.coalesce(F.sum(name).over(inside), F.lit(0)) for name in ("_weight", "_huge")}
    small = F.floor(before["_weight"] / F.lit(task_bytes))
    slot = F.when(F.col("_huge") == 1, before["_huge"] + n_small).otherwise(small).cast("int")
    dealt = ranged.join(F.broadcast(starts), "_slice").withColumn("slot", slot)
    return dealt.select(*named.columns, "slot"), n_small + n_huge


def files_of(listed: DataFrame, task_bytes: int = READ_BYTES) -> DataFrame:
    """The listed files with their bytes, or with the reason why they cannot be read.

    Every task reads about ``task_bytes``, whatever the number of files and of cores.
    """

    def read(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for row in batch.to_pylist():
                content = error = None
                try:
                    with open(_path(row["path"]), "rb") as stream:
                        content = stream.read()
                except OSError as problem:
                    error = _text(str(problem))
                yield pa.RecordBatch.from_pydict(
                    {name: [value] for name, value in row.items()}
                    | {
                        "content": pa.array([content], pa.binary()),
                        "read_error": pa.array([error], pa.string()),
                    }
                )

    named, slots = shared_out(listed.filter(F.col("kind") == "file").select("scan_id", "path", "rel_path", "size"), task_bytes)
    dealt = named.repartitionById(slots, F.col("slot")).select("scan_id", "path", "rel_path")
    return dealt.mapInArrow(read, CONTENTS)
