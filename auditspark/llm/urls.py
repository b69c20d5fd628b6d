"""Allow and block lists of hosts and paths, looked up in cascades of Bloom filters.

A rule is a host with a path; its key is one after the other. A url has one key for each of its
host's suffixes and each length of path that rules have; a rule fits if its key is among them. The
first filter of a cascade holds the listed keys. Those keys of the whole corpus that pass it by
chance go into the second, the listed keys that pass the second by chance into the third, and so on
until none is left; for keys of this corpus the answer of the cascade is then exact.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import mix
from auditspark.session import materialize

BITS_PER_KEY = 10
PROBES = 7
MAX_BYTES = 64 << 20
MAX_LEVELS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
AUTHORITY = r"://([^/?#]*)([^?#]*)"


class Filter:
    """One Bloom filter over pairs of 64-bit hashes; ``level`` keeps the filters of a cascade apart."""

    def __init__(self, level: int, size: int, words: np.ndarray):
        self.level, self.size, self.words = level, size, words

    @staticmethod
    def places(one: np.ndarray, two: np.ndarray, level: int, size: int) -> np.ndarray:
        base, step = mix(one + np.uint64(level)), mix(two + np.uint64(level)) | np.uint64(1)
        times = np.arange(PROBES, dtype=np.uint64)
        return (base[:, None] + step[:, None] * times[None, :]) % np.uint64(size)

    def holds(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        at = self.places(one, two, self.level, self.size)
        return ((self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).all(axis=1)


def listed(cascade: list[Filter], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether keys, given by their hashes, are listed."""
    answer = np.zeros(len(one), bool)
    open_keys = np.arange(len(one))
    for level in cascade:
        passed = level.holds(one[open_keys], two[open_keys])
        answer[open_keys[~passed]] = level.level % 2 == 1
        open_keys = open_keys[passed]
        if not len(open_keys):
            return answer
    answer[open_keys] = len(cascade) % 2 == 1
    return answer


def _hashed(keys: DataFrame) -> DataFrame:
    return keys.select("key", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"))


def _pair(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(name).to_numpy().view(np.uint64) for name in ("h1", "h2"))


def build_filter(keys: DataFrame, level: int, number: int, pair: Callable = _pair) -> Filter:
    """A filter over a table of ``number`` keys; tasks set bits, words of bits come together by OR.

    ``pair`` takes two 64-bit hashes per row out of a batch, by default the columns ``h1, h2``.
    """
    size = max(64, -(-number * BITS_PER_KEY // 64) * 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = Filter.places(*pair(batch), level, size).ravel()
            bits = np.uint64(1) << (at & np.uint64(63))
            columns = pa.array((at >> np.uint64(6)).astype(np.int64)), pa.array(bits.view(np.int64))
            yield pa.RecordBatch.from_arrays(list(columns), ["word", "bits"])

    rows = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return Filter(level, size, words)


def passing(keys: DataFrame, level: Filter) -> DataFrame:
    """Those of ``key, h1, h2`` that a filter holds, or seems to hold."""
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.holds(*_pair(batch))))

    return keys.mapInArrow(run, "key string, h1 long, h2 long")


def build_cascade(keys: DataFrame, universe: DataFrame, max_bytes: int = MAX_BYTES) -> list[Filter] | None:
    """The cascade for ``keys(key)`` that is exact on ``universe(key)``; None if it would be too large.

    The universe is passed over once; only keys that the first filter lets through are kept.
    """
    inside = materialize(_hashed(keys.select("key").distinct()))
    number = inside.count()
    if not number:
        return []
    if number * BITS_PER_KEY // 8 > max_bytes:
        return None
    cascade = [build_filter(inside, 0, number)]
    by_chance = passing(_hashed(universe), cascade[0]).distinct()
    outside = materialize(by_chance.join(inside.select("key"), "key", "left_anti").select("key", "h1", "h2"))
    while len(cascade) < MAX_LEVELS:
        number = outside.count()
        if not number:
            return cascade
        if number * BITS_PER_KEY // 8 > max_bytes:
            return None
        cascade.append(build_filter(outside, len(cascade), number))
        inside, outside = outside, materialize(passing(inside, cascade[-1]))
    return None


def with_host_and_path(pages: DataFrame) -> DataFrame:
    """Add ``host`` and ``path``; both are empty where the url is null or has no ``://``."""
    part = [F.coalesce(F.regexp_extract("url", AUTHORITY, n), F.lit("")) for n in (1, 2)]
    return pages.withColumn("host", F.translate(part[0], UPPER, LOWER)).withColumn("path", part[1])


def keys_of(lengths: list[int], labels: int) -> Column:
    """Keys of ``host`` and ``path``: suffixes of at most ``labels`` labels by beginnings of the lengths."""
    names = F.split("host", r"\.", -1)
    first = F.greatest(F.lit(1), F.size(names) - labels + 1)
    suffixes = F.transform(
        F.sequence(first, F.size(names)), lambda at: F.array_join(F.slice(names, at, F.size(names)), ".")
    )
    fitting = F.filter(F.array(*[F.lit(length) for length in lengths]), lambda length: length <= F.char_length("path"))
    beginnings = F.transform(fitting, lambda length: F.substring(F.col("path"), F.lit(1), length))
    keys = F.flatten(F.transform(suffixes, lambda host: F.transform(beginnings, lambda path: F.concat(host, path))))
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(keys)


def _ordered(key: str, blocks: bool) -> tuple:
    """Longest key first, then the longer host; of one key in both lists the block counts."""
    return len(key), len(key.split("/", 1)[0]), key, blocks


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", max_bytes: int = MAX_BYTES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every row of ``pages``.

    ``rules(host, path, verdict)`` are at most one list of ``allow`` and one of ``block``; rows with
    a null or an unknown verdict count for nothing. The longest fitting rule decides (of equally
    long ones that with the longer host), a key in both lists blocks, and where no rule fits the
    cascades list nothing, ``rule`` is null and the verdict is ``default``. Repeated rows stay
    repeated. Lists too large for filters of ``max_bytes`` are joined instead.
    """
    clean = materialize(
        rules.filter("host is not null and path is not null and verdict in ('allow', 'block')").select(
            F.concat(F.translate("host", UPPER, LOWER), F.col("path")).alias("key"),
            F.char_length("path").alias("length"),
            F.size(F.split("host", r"\.", -1)).alias("labels"),
            "verdict",
        )
    )
    shape = clean.agg(F.collect_set("length").alias("lengths"), F.max("labels").alias("labels")).first()
    addressed = with_host_and_path(pages.select("page_id", "url")).drop("url")
    keyed = addressed.withColumn("keys", keys_of(sorted(shape["lengths"]) or [0], shape["labels"] or 1))
    universe = addressed.select("host", "path").distinct().select(
        F.explode(keys_of(sorted(shape["lengths"]) or [0], shape["labels"] or 1)).alias("key")
    )
    lists = [clean.filter(F.col("verdict") == verdict).select("key") for verdict in ("allow", "block")]
    cascades = [build_cascade(keys, universe, max_bytes) for keys in lists]
    if None in cascades:
        return _joined(keyed, clean, default)
    shared = pages.sparkSession.sparkContext.broadcast(cascades)
    hashed = keyed.withColumns(
        {
            "h1": F.transform("keys", lambda key: F.xxhash64(key)),
            "h2": F.transform("keys", lambda key: F.xxhash64(F.lit("second"), key)),
        }
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("keys")
            one, two = (batch.column(name).flatten().to_numpy().view(np.uint64) for name in ("h1", "h2"))
            allows, blocks = (listed(cascade, one, two) for cascade in shared.value)
            found = np.flatnonzero(allows | blocks)
            flat, owner = keys.flatten(), keys.value_parent_indices().to_numpy()
            best: dict[int, tuple] = {}
            for at in found.tolist():
                rank = _ordered(flat[at].as_py(), bool(blocks[at]))
                best[int(owner[at])] = max(best.get(int(owner[at]), rank), rank)
            rule = [best[row][2] if row in best else None for row in range(batch.num_rows)]
            verdict = [("block" if best[row][3] else "allow") if row in best else default for row in range(batch.num_rows)]
            columns = [batch.column(name) for name in ("page_id", "host", "path")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    kind = dict(pages.dtypes)["page_id"]
    return hashed.mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string")


def _joined(keyed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same by a join, for lists of any size."""
    rows = materialize(keyed.withColumn("_row", F.monotonically_increasing_id()))
    host = F.char_length(F.substring_index("key", "/", 1))
    rank = F.struct(F.char_length("key").alias("a"), host.alias("b"), "key", "verdict")
    hits = (
        rows.select("_row", F.explode("keys").alias("key"))
        .join(rules.select("key", "verdict").distinct(), "key")
        .groupBy("_row")
        .agg(F.max(rank).alias("best"))
    )
    return rows.join(hits, "_row", "left").select(
        "page_id",
        "host",
        "path",
        F.col("best.key").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
