"""Texts of whole Arrow batches as byte arrays, and helpers to run functions over them.

Python stages work on slices of a batch that hold at most ``SLICE_BYTES`` of text (one text, if it
alone is longer). In a slice all texts lie behind one another in one array, so tokens, hashes and
sums are computed for many texts at once.
"""

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditspark.session import materialize

SLICE_BYTES = 1 << 19
# An exchange with Python hands over at most so many bytes at a time.
BATCH_BYTES = 8 << 20

_RANDOM = np.random.default_rng(20240607)
BYTE_CODES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(pattern: str) -> np.ndarray:
    """Table over bytes: True where the byte, taken as Latin-1, matches a one-character pattern."""
    import re

    compiled = re.compile(pattern)
    return np.array([compiled.fullmatch(chr(code)) is not None for code in range(256)])


class Texts:
    """The texts of a slice: ``data`` holds their bytes, text ``i`` is ``data[starts[i]:ends[i]]``."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = column.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        body = column.buffers()[2]
        data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        self.data = data[offsets[0]:offsets[-1]]
        if lower:
            self.data = LOWER[self.data]
        self.starts = offsets[:-1] - offsets[0]
        self.ends = offsets[1:] - offsets[0]
        self.size = len(column)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        """Flags of the first and of the last byte of every text that has bytes."""
        first = np.zeros(len(self.data), bool)
        last = np.zeros(len(self.data), bool)
        some = self.ends > self.starts
        first[self.starts[some]] = True
        last[self.ends[some] - 1] = True
        return first, last

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of bytes of a class; a run never crosses texts."""
        member = inside[self.data]
        first, last = self.edges()
        begin = member.copy()
        begin[1:] &= ~member[:-1] | first[1:]
        end = member
        end[:-1] &= ~member[1:] | last[:-1]
        return np.flatnonzero(begin), np.flatnonzero(end) + 1

    def bounds(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text the range of those ``starts`` that lie in it."""
        return np.searchsorted(starts, self.starts), np.searchsorted(starts, self.ends)


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, kept between calls."""
    if len(_powers["up"]) < size:
        for name, base in (("up", BASE), ("down", BASE_INVERSE)):
            table = np.full(max(size, SLICE_BYTES), base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:size], _powers["down"][:size]


def mix(values: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    values = values ^ (values >> np.uint64(32))
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    values *= np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    return values


class SpanHash:
    """64-bit hashes of any spans of a byte array, from one running sum."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODES[data] * up[:-1], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(raw + (ends - starts).astype(np.uint64))


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number each; beyond the end stand zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i], starts[i]+1, ...`` for every span, behind one another."""
    total = int(lengths.sum())
    shift = np.repeat(starts - np.cumsum(lengths) + lengths, lengths)
    return shift + np.arange(total)


def segment_sums(values: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Sums of ``values[low:high]``, also of empty ranges."""
    totals = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=totals[1:])
    return totals[highs] - totals[lows]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds at most ``limit`` bytes of ``column``, or a single row."""
    for batch in batches:
        values = batch.column(column).cast(pa.large_string()).fill_null("")
        if not len(values):
            continue
        offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
        low = 0
        while low < len(values):
            high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
            high = max(high, low + 1)
            yield batch.slice(low, high - low)
            low = high


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bound on the bytes of an Arrow batch to ``BATCH_BYTES``, if it is higher.

    Documents may be long, and a batch is held on both sides of the exchange.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def release() -> None:
    """Give memory that Arrow and the allocator keep for later back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        # Not every C library can do that.
        return


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], every: int = 32) -> Callable:
    """``run`` as a function of batches that gives unused memory back after some results and at its end.

    Workers stay for later stages, and what they keep adds up.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(run(batches), 1):
            yield batch
            if number % every == 0:
                del batch
                release()
        release()

    return wrapped


def map_slices(
    frame: DataFrame,
    function: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    column: str = "text",
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """Apply ``function`` to slices of ``frame`` of bounded text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, limit):
            yield function(batch)

    bound_batches(frame.sparkSession)
    return frame.mapInArrow(lean(run), schema)


def list_array(values: pa.Array, lengths: np.ndarray) -> pa.Array:
    """A list column of consecutive pieces of ``values``."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def free_name(frame: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``frame`` has it in any case."""
    taken = {column.lower() for column in frame.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_row_key(docs: DataFrame, name: str = "__row") -> DataFrame:
    """``docs`` with the column ``name``, a number of its own for every row.

    The document number serves where every row has one of its own; a count of that one column tells.
    Otherwise rows are numbered and stored, so that the numbers stay the same.
    """
    number = F.col("doc_id").cast("long")
    seen = docs.groupBy(number.alias("doc_id")).agg(F.count("*").alias("n"))
    if seen.filter("n > 1 or doc_id is null").isEmpty():
        return docs.withColumn(name, number)
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()))


def label_fold(column: str, parts: int):
    """The remainder that decides which labelled rows may be learned from; a null counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(parts))


def split_groups(members: DataFrame, key: list[str], item: str, limit: int) -> DataFrame:
    """Cut groups of more than ``limit`` members into blocks and meet every two blocks of a group.

    Adds ``unit``: rows of one key and unit are to be compared with each other. A group of ``k``
    blocks gives ``k * (k - 1) / 2`` units of two blocks each, every member is in ``k - 1`` of them,
    so any two members meet in a unit and no unit holds much more than ``2 * limit`` members.
    """
    counts = members.groupBy(*key).agg(F.count("*").alias("_n")).filter("_n > 1")
    blocks = F.ceil(F.col("_n") / F.lit(limit)).cast("int")
    own = F.pmod(F.xxhash64(item), F.col("_blocks").cast("bigint")).cast("int")
    every = F.sequence(F.lit(0), F.col("_blocks") - 1)
    pairs = F.transform(every, lambda other: F.struct(F.least(own, other), F.greatest(own, other)))
    units = F.when(F.col("_blocks") == 1, F.array(F.lit(0))).otherwise(
        F.transform(
            F.filter(pairs, lambda pair: pair["col1"] != pair["col2"]),
            lambda pair: pair["col1"] * F.col("_blocks") + pair["col2"],
        )
    )
    return (
        members.join(counts, key)
        .withColumn("_blocks", blocks)
        .withColumn("unit", F.explode(units))
        .drop("_n", "_blocks")
    )
