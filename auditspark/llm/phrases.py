"""Phrases of two to five words that occur more often than their parts would by chance.

Which phrases are frequent is found in two steps. First every n-gram is hashed to 64 bits, and each
hash partition gets a Misra-Gries summary: tasks count the n-grams of what they read, the counts of
a partition are merged, and whenever a merge leaves more counters than the capacity, the count of
the first one too many is taken off all of them. The capacity exceeds the partition's mass divided
by the threshold, so less than the threshold is ever taken off: every n-gram that reaches the
threshold survives. Second, the survivors are counted exactly, by their words.

An n-gram cannot be frequent unless its parts are. So summaries are made for single words, then for
pairs of surviving words, then for longer n-grams whose pairs survive. Survivors travel as a Bloom
filter of bounded size; passing it by chance costs time, never a wrong result. The exact pass takes
as many rounds as filters of that size need to hold all survivors.

Odd input: a null or empty text has no words, a null language counts as ``und``; rows that share a
document number, or have none, count like others; no other column is looked at.
"""

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm import bloom
from auditspark.llm.common import SpanHash, Texts, bound_batches, byte_class, lean, mix, ragged, slices
from auditspark.session import materialize

LONGEST = 5
THRESHOLD = 100
TOP = 2000
# A phrase goes if a longer one has at least this percentage of its occurrences.
COVER = 100
BREAK = byte_class(r"[.,;:!?\x0A-\x0D]")
BLANK = byte_class(r"[\x20\x09]")
WORD = ~(BREAK | BLANK)
# Counters that a task holds before it hands them on.
FLUSH = 1 << 21
PART_BYTES = 64 << 20
LEAST_PARTS, MOST_PARTS = 64, 1 << 16
RANK_BUCKETS = 64


@cache
def _seed(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Grams:
    """The n-grams of the texts of a slice, with one blank between words."""

    def __init__(self, batch: pa.RecordBatch):
        texts = Texts(batch.column("text"), lower=True)
        blank = BLANK[texts.data]
        data = np.where(blank, np.uint8(32), texts.data)
        kept = ~blank
        kept[1:] |= WORD[data[:-1]]
        place = np.concatenate([[0], np.cumsum(kept)])
        self.data = texts.data = data[kept]
        texts.starts, texts.ends = place[texts.starts], place[texts.ends]
        self.starts, self.ends = texts.runs(WORD)
        self.owner = np.searchsorted(texts.ends, self.starts, "right")
        self.piece = np.cumsum(BREAK[self.data])[self.starts] + self.owner
        self.langs = [lang if lang is not None else "und" for lang in batch.column("lang").to_pylist()]
        seeds = np.array([_seed(lang) for lang in self.langs], np.uint64)
        self.words = SpanHash(self.data).of(self.starts, self.ends)
        self.seeds = seeds[self.owner] if len(self.owner) else np.zeros(0, np.uint64)

    def keys(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each size up to ``longest``: key of the n-gram at every word, and whether one starts there."""
        key, number = self.words ^ self.seeds, len(self.words)
        for size in range(1, longest + 1):
            if size > 1:
                if number < size:
                    return
                key = mix(key[:number - size + 1] * np.uint64(31) + self.words[size - 1:])
            yield size, mix(key + np.uint64(size)), self.piece[:number - size + 1] == self.piece[size - 1:]


def _both(flags: np.ndarray, size: int) -> np.ndarray:
    """Whether ``size`` flags in a row are set, for every place with as many."""
    out = flags[:len(flags) - size + 1].copy()
    for step in range(1, size):
        out &= flags[step:len(flags) - size + 1 + step]
    return out


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counters with the counts of equal keys added up, in order of the keys."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[heads], np.add.reduceat(counts, heads)


def pruned(keys: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """At most ``capacity`` counters, and what was taken off each of them."""
    if len(keys) <= capacity:
        return keys, counts, 0
    place = len(keys) - capacity - 1
    off = int(np.partition(counts, place)[place])
    left = counts > off
    return keys[left], counts[left] - off, off


class Summary:
    """A Misra-Gries summary of a mass that is known beforehand."""

    def __init__(self, mass: int, threshold: int):
        self.threshold, self.capacity = threshold, mass // threshold + 1
        self.off, self.pending, self.size = 0, [], 0

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.pending.append((keys, counts))
        self.size += len(keys)
        if self.size > max(2 * self.capacity, FLUSH):
            self._settle()

    def _settle(self) -> tuple[np.ndarray, np.ndarray]:
        keys, counts = (np.concatenate([pair[n] for pair in self.pending]) for n in (0, 1))
        keys, counts, off = pruned(*added(keys, counts), self.capacity)
        self.off += off
        self.pending, self.size = [(keys, counts)], len(keys)
        return keys, counts

    def survivors(self) -> np.ndarray:
        """Keys whose count may reach the threshold."""
        if not self.pending:
            return np.zeros(0, np.uint64)
        keys, counts = self._settle()
        return keys[counts + self.off >= self.threshold]


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Counters in order of their keys as bytes: differences of keys, bytes of equal weight together, then counts."""
    steps = np.diff(keys, prepend=np.uint64(0))
    narrow = counts.astype(np.uint8) if counts.max() < 256 else counts.astype(np.uint64)
    return pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes() + narrow.tobytes(), codec="lz4", asbytes=True)


def unpacked(data: pa.Buffer, number: int, wide: bool) -> tuple[np.ndarray, np.ndarray]:
    """What ``packed`` packed: ``number`` counters, with counts of eight bytes or of one."""
    body = np.frombuffer(pa.decompress(data, number * (16 if wide else 9), codec="lz4"), np.uint8)
    steps = np.ascontiguousarray(body[:8 * number].reshape(8, -1).T).view(np.uint64).ravel()
    counts = np.frombuffer(body[8 * number:], np.uint64 if wide else np.uint8)
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


_COUNTED = "part int, mass long, number int, wide boolean, counters binary, lang string"


def _counted(docs: DataFrame, sizes: tuple[int, ...], parts: int, known: np.ndarray | None) -> DataFrame:
    """Counts of the n-grams of ``sizes`` per hash partition; for single words also the mass per language.

    For every partition a task gives a row with its counters and one with only their mass; languages
    count as partitions below zero. With ``known``, a filter, n-grams need all their words (pairs)
    or all their pairs (longer ones) in it.
    """
    shift = np.uint64(64 - (parts.bit_length() - 1))
    shared = None if known is None else docs.sparkSession.sparkContext.broadcast(known)

    def chosen(grams: Grams) -> list[np.ndarray]:
        found, flags = [], None
        for size, key, whole in grams.keys(max(sizes)):
            if shared is not None and size == min(sizes) - 1:
                flags = whole & bloom.holds(shared.value, key)
            if size in sizes:
                if flags is not None:
                    whole = whole & _both(flags, size - min(sizes) + 2)
                found.append(key[whole])
        return found

    def table_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.string())
        arrays = [pa.array([row[at] for row in out], kind) for at, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays(arrays, ["part", "mass", "number", "wide", "counters", "lang"])

    def rows(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        part = (keys >> shift).astype(np.int64)
        heads = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
        out = []
        for low, high in zip(heads.tolist(), np.r_[heads[1:], len(part)].tolist()):
            some = counts[low:high]
            out.append((int(part[low]), int(some.sum()), None, None, None, None))
            out.append((int(part[low]), None, high - low, bool(some.max() > 255), packed(keys[low:high], some), None))
        return table_of(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, mass = [], 0, {}
        for batch in slices(batches, "text"):
            grams = Grams(batch)
            if 1 in sizes:
                number = np.bincount(grams.owner, minlength=len(grams.langs))
                for lang, words in zip(grams.langs, number.tolist()):
                    mass[lang] = mass.get(lang, 0) + words
            for keys in chosen(grams):
                held.append(np.unique(keys, return_counts=True))
                size += len(held[-1][0])
            if size > FLUSH:
                yield rows(*added(*(np.concatenate([pair[n] for pair in held]) for n in (0, 1))))
                held, size = [], 0
        if size:
            yield rows(*added(*(np.concatenate([pair[n] for pair in held]) for n in (0, 1))))
        yield table_of([(-1 - _seed(lang) % 64, number, None, None, None, lang) for lang, number in mass.items()])

    bound_batches(docs.sparkSession)
    return docs.mapInArrow(lean(run), _COUNTED)


def _surviving(counted: DataFrame, threshold: int) -> DataFrame:
    """``key`` of all n-grams that may reach the threshold, and ``lang, mass`` of the languages; a stored table.

    Of each partition the masses come first, so its capacity is known before the counters are merged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(keys: np.ndarray) -> pa.RecordBatch:
            none = [pa.nulls(len(keys), pa.string()), pa.nulls(len(keys), pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *none], ["key", "lang", "mass"])

        part, total, summary = None, 0, None
        for batch in batches:
            langs = batch.filter(pa.compute.is_valid(batch.column("lang")))
            yield pa.RecordBatch.from_arrays([pa.nulls(langs.num_rows, pa.int64()), langs.column("lang"), langs.column("mass")], ["key", "lang", "mass"])
            columns = (batch.column(name) for name in ("part", "mass", "number", "wide", "counters"))
            for which, mass, number, wide, counters in zip(*columns):
                if which.as_py() != part:
                    if summary is not None:
                        yield done(summary.survivors())
                    part, total, summary = which.as_py(), 0, None
                if not counters.is_valid:
                    total += mass.as_py()
                    continue
                if summary is None:
                    summary = Summary(total, threshold)
                summary.merge(*unpacked(counters.as_buffer(), number.as_py(), wide.as_py()))
        if summary is not None:
            yield done(summary.survivors())

    laid = counted.repartition("part").sortWithinPartitions("part", F.col("counters").isNotNull())
    return materialize(laid.mapInArrow(lean(run), "key long, lang string, mass long"))


def _exactly(docs: DataFrame, longest: int, words: np.ndarray, group: int, groups: int) -> DataFrame:
    """``lang, phrase, size, f`` of the n-grams that a filter over one group of survivors holds."""
    shared = docs.sparkSession.sparkContext.broadcast(words)
    mask = np.uint64(groups - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            grams = Grams(batch)
            langs = pa.array(grams.langs, pa.string())
            for size, key, whole in grams.keys(longest):
                if groups > 1:
                    whole = whole & ((key >> np.uint64(32)) & mask == np.uint64(group))
                at = np.flatnonzero(whole)
                at = at[bloom.holds(shared.value, key[at])]
                _, first, counts = np.unique(key[at], return_index=True, return_counts=True)
                first = at[first]
                begin, length = grams.starts[first], grams.ends[first + size - 1] - grams.starts[first]
                offsets = np.zeros(len(first) + 1, np.int32)
                np.cumsum(length, out=offsets[1:])
                body = pa.py_buffer(grams.data[ragged(begin, length)].tobytes())
                phrases = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), body)
                columns = [langs.take(pa.array(grams.owner[first])), phrases, pa.array(np.full(len(first), size, np.int32)), pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "size", "f"])

    found = docs.mapInArrow(lean(run), "lang string, phrase string, size int, f long")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))


def frequent(
    docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD, filter_bytes: int = bloom.MAX_BYTES
) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, size, f`` of all phrases of up to ``longest`` words with ``f >= threshold``,
    and ``lang, n`` with the number of words per language; both stored.
    """
    texts = docs.select("text", F.col("lang").cast("string").alias("lang"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = min(MOST_PARTS, max(LEAST_PARTS, 1 << max(0, (-(-total // PART_BYTES) - 1).bit_length())))
    rounds = [(1,), (2,), tuple(range(3, longest + 1))][:min(longest, 3)]
    survivors, known, mass = [], None, None
    for sizes in rounds:
        found = _surviving(_counted(texts, sizes, parts, known), threshold)
        if mass is None:
            mass = materialize(found.filter("lang is not null").groupBy("lang").agg(F.sum("mass").alias("n")))
        keys = found.filter("lang is null").select("key")
        survivors.append(keys)
        number = keys.count()
        if not number:
            break
        # Beyond the bound the filter only lets more n-grams through.
        known = bloom.build(keys.select(F.lit(0).alias("shard"), "key"), {0: bloom.words_for(number, filter_bytes)})[0]
    every = survivors[0]
    for keys in survivors[1:]:
        every = every.unionByName(keys)
    number = every.count()
    groups, room = 1, filter_bytes // 8 * bloom.KEYS_PER_WORD
    while groups * room < number:
        groups *= 2
    found = None
    for group in range(groups):
        some = every.filter(F.expr(f"shiftrightunsigned(key, 32) & {groups - 1}") == group).select(F.lit(0).alias("shard"), "key")
        words = bloom.build(some, {0: bloom.words_for(-(-number // groups), filter_bytes)})[0]
        part = materialize(_exactly(texts, longest, words, group, groups).filter(F.col("f") >= threshold))
        found = part if found is None else found.unionByName(part)
    return found, mass



def scored(found: DataFrame, mass: DataFrame) -> DataFrame:
    """``lang, phrase, size, a, l, r, n, score`` of all phrases of at least two words, at their lowest cut.

    Numbers are multiplied as decimals of 38 digits: exact while 1000 a n is below 10**38.
    """
    counts = found.select("lang", "phrase", "f")
    cuts = (
        found.filter("size > 1")
        .withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
        .withColumn("head", F.expr("substring_index(phrase, ' ', k)"))
        .withColumn("rest", F.expr("substring_index(phrase, ' ', k - size)"))
        .withColumnRenamed("f", "a")
        .join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
        .join(counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
        # One row per language.
        .join(F.broadcast(mass), "lang")
        .withColumn(
            "score",
            F.expr(
                "(cast(1000 * a as decimal(19, 0)) * cast(n as decimal(19, 0))) "
                "div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))"
            ),
        )
    )
    least = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return cuts.groupBy("lang", "phrase", "size", "a", "n").agg(least).select(
        "lang", "phrase", "size", "a", "cut.l", "cut.r", "n", "cut.score"
    )


def uncovered(phrases: DataFrame, cover: int = COVER) -> DataFrame:
    """Those of ``lang, phrase, size, a, ...`` that no longer phrase covers.

    What a phrase two words longer covers, the one between them covers too, so only phrases of one
    word more are looked at.
    """
    inner = phrases.filter("size > 2").select(
        "lang",
        F.explode(F.array(F.expr("substring_index(phrase, ' ', size - 1)"), F.expr("substring_index(phrase, ' ', 1 - size)"))).alias("phrase"),
        "a",
    )
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    joined = phrases.join(longer, ["lang", "phrase"], "left")
    return joined.filter(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a"))).drop("longer")


def ranked(phrases: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language with their ``rank``.

    Buckets of phrases give up all but their own first ones, so no task orders a whole language.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    bucket = F.pmod(F.xxhash64("phrase"), F.lit(RANK_BUCKETS))
    some = phrases.withColumn("bucket", bucket).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    return (
        some.filter(F.col("place") <= top)
        .withColumn("rank", rank)
        .filter(F.col("rank") <= top)
        .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    )


def collocations(docs: DataFrame, longest: int = LONGEST, threshold: int = THRESHOLD, cover: int = COVER, top: int = TOP) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases.

    ``a`` counts the phrase, ``l`` and ``r`` its parts at the cut that scores lowest, ``n`` all words
    of the language.
    """
    phrases = materialize(scored(*frequent(docs, longest, threshold)))
    return ranked(uncovered(phrases, cover), top)
