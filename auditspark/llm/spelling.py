"""Groups of spelling variants: words of a vocabulary that differ by one character.

The vocabulary comes from all texts; every word knows how often it occurs. For each word all
shorter words that lack one of its characters and all words of its length with one other, lower,
character are looked up in blocked Bloom filters of the vocabulary, sharded by word length and, for
lengths with very many words, by hash. Insertions and higher characters need no look-up: the other
word of such a pair finds it, and plain letters, which come first, are replaced least. An edit's hash follows from running sums over the word, so only edits that some
filter holds become strings. These meet the vocabulary in an exact join.

Filters are broadcast in groups of bounded size; more words mean more groups, each over those words
whose edits have the lengths of the group.

Odd input: a null text has no words, a null ``doc_id`` counts as an empty string, equal rows count
each. No other column is looked at. Words may be of any length.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm import bloom
from auditspark.llm.common import BASE, BASE_INVERSE, lean, mix
from auditspark.session import materialize

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# All that a word can hold, as Latin-1.
ALPHABET = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], np.uint8)
MIN_LENGTH = 6
MIN_COUNT = 5
DOMINANCE = 5
NOISE = 199
# Words of this length and above share a shard.
LONG = 64
SHARD_KEYS = 1 << 20
# Edits that are hashed at a time.
EDITS = 1 << 20

_RANDOM = np.random.default_rng(13)
CODES = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(docs: DataFrame, min_length: int = MIN_LENGTH, noise: int = NOISE) -> DataFrame:
    """``word``, one row per run of letters: in lower case (A-Z only), some of them with a character missing.

    A run goes without character ``h % length`` where ``noise`` divides ``h``, the crc32 of document
    number and run. Only words of at least ``min_length`` characters are returned.
    """
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    run = F.translate("run", UPPER, LOWER)
    found = docs.select(number.alias("number"), F.explode(runs).alias("run")).select(
        run.alias("run"), F.crc32(F.concat_ws(":", "number", run).cast("binary")).alias("h")
    )
    at = F.pmod("h", F.char_length("run"))
    shorter = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", at.cast("int") + 2, F.char_length("run")))
    word = F.when(F.col("h") % noise == 0, shorter).otherwise(F.col("run"))
    return found.select(word.alias("word")).filter(F.char_length("word") >= min_length)


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, noise: int = NOISE) -> DataFrame:
    """``word, n`` of the words with at least ``min_count`` occurrences; a stored table."""
    counts = words_of(docs, min_length, noise).groupBy("word").agg(F.count("*").alias("n"))
    return materialize(counts.filter(F.col("n") >= min_count))


class Words:
    """Words of a batch as Latin-1 bytes, with the hash of each and of all its beginnings.

    The raw hash of a word sums ``CODES[c] * BASE**i`` over its characters.
    """

    def __init__(self, words: list[str]):
        self.sizes = np.array([len(word) for word in words], np.int64)
        self.data = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.up, self.down = (_powers(base, len(self.data) + 1) for base in (BASE, BASE_INVERSE))
        self.sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(CODES[self.data] * self.up[:-1], out=self.sums[1:])
        self.raw = (self.sums[self.ends] - self.sums[self.starts]) * self.down[self.starts]

    def keys(self) -> np.ndarray:
        return finished(self.raw, self.sizes)

    def edits(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Portions of ``key, length, place, letter`` of all edits; letter 0 stands for a deletion.

        A place is one in ``data``. Of a run of equal characters only the last one is deleted.
        """
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        inner = np.arange(len(self.data)) - self.starts[owner]
        last = np.ones(len(self.data), bool)
        last[:-1] = (self.data[1:] != self.data[:-1]) | (owner[1:] != owner[:-1])
        for low in range(0, len(self.data), EDITS // len(ALPHABET)):
            at = np.arange(low, min(low + EDITS // len(ALPHABET), len(self.data)))
            word, code = owner[at], CODES[self.data[at]]
            place, letter = np.nonzero(ALPHABET[None, :] < self.data[at][:, None])
            raw = self.raw[word][place] + (CODES[ALPHABET[letter]] - code[place]) * self.up[inner[at]][place]
            size = self.sizes[word][place]
            yield finished(raw, size), size, at[place], ALPHABET[letter]
            at = at[last[at]]
            word, start = owner[at], self.starts[owner[at]]
            before = (self.sums[at] - self.sums[start]) * self.down[start]
            after = (self.sums[self.ends[word]] - self.sums[at + 1]) * self.down[start] * BASE_INVERSE
            size = self.sizes[word] - 1
            yield finished(before + after, size), size, at, np.zeros(len(at), np.uint8)


_kept_powers: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, size: int) -> np.ndarray:
    table = _kept_powers.get(int(base))
    if table is None or len(table) < size:
        table = np.full(max(size, 1 << 16), base, np.uint64)
        table[0] = 1
        table = _kept_powers[int(base)] = np.multiply.accumulate(table)
    return table[:size]


def finished(raw: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(raw + size.astype(np.uint64))


def shards_of(size: np.ndarray, key: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """Shard numbers: the length, with the hash's part where a length has several (``parts``)."""
    length = np.minimum(size, LONG)
    part = ((key >> np.uint64(32)) % np.maximum(parts[length], 1).astype(np.uint64)).astype(np.int64)
    return length + (LONG + 1) * part


def _keyed(words: DataFrame, parts: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = Words(batch.column("word").to_pylist())
            key = some.keys()
            columns = [pa.array(shards_of(some.sizes, key, parts).astype(np.int32)), pa.array(key.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "key"])

    return words.select("word").mapInArrow(lean(run), "shard int, key long")


def _grouped(shards: dict[int, int], max_bytes: int) -> list[dict[int, int]]:
    """Shards with their sizes in words, put into groups of at most ``max_bytes`` (or of one shard)."""
    groups, room = [], 0
    for shard in sorted(shards, key=lambda shard: (shard % (LONG + 1), shard)):
        need = 8 * shards[shard]
        if need > room:
            groups.append({})
            room = max_bytes
        groups[-1][shard] = shards[shard]
        room -= need
    return groups


def _probed(words: DataFrame, held: dict[int, np.ndarray], parts: np.ndarray) -> DataFrame:
    """``key, word, n``: edits of ``words(word, n)`` that one of the filters holds or seems to hold."""
    shared = words.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = np.array(sorted(shared.value), np.int64)
        for batch in batches:
            texts = batch.column("word").to_pylist()
            some = Words(texts)
            for key, size, place, letter in some.edits():
                shard = shards_of(size, key, parts)
                found = np.zeros(len(key), bool)
                for number in shards[np.isin(shards, np.unique(shard))]:
                    at = np.flatnonzero(shard == number)
                    found[at] = bloom.holds(shared.value[int(number)], key[at])
                hit = np.flatnonzero(found)
                owner = np.searchsorted(some.ends, place[hit], "right")
                inner = place[hit] - some.starts[owner]
                made = [
                    texts[w][:i] + (chr(c) if c else "") + texts[w][i + 1:]
                    for w, i, c in zip(owner.tolist(), inner.tolist(), letter[hit].tolist())
                ]
                rows = batch.take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), rows.column("word"), rows.column("n")], ["key", "word", "n"])

    return words.select("word", "n").mapInArrow(lean(run), "key string, word string, n long")


def near_pairs(words: DataFrame, max_bytes: int = bloom.MAX_BYTES, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``a, n_a, b, n_b``, each unordered pair of words once that differ by one character; stored.

    ``words(word, n)`` is a stored table of distinct words.
    """
    length = F.least(F.char_length("word"), F.lit(LONG))
    # One row per length below LONG, and one for the rest.
    counts = {row["length"]: row["number"] for row in words.groupBy(length.alias("length")).agg(F.count("*").alias("number")).collect()}
    parts = np.zeros(LONG + 1, np.int64)
    for size, number in counts.items():
        parts[size] = -(-number // shard_keys)
    shards = {
        size + (LONG + 1) * part: bloom.words_for(-(-number // int(parts[size])), max_bytes)
        for size, number in counts.items() for part in range(int(parts[size]))
    }
    found = None
    for group in _grouped(shards, max_bytes):
        held = bloom.build(_keyed(words, parts), group)
        wanted = {shard % (LONG + 1) for shard in group}
        wanted |= {min(size + 1, LONG) for size in wanted}
        probes = _probed(words.filter(length.isin(sorted(wanted))), held, parts)
        exact = words.select(F.col("word").alias("key"), F.col("n").alias("n_b"))
        pairs = materialize(
            probes.join(exact, "key").select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("key").alias("b"), "n_b")
        )
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        found = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("word").alias("b"), F.col("n").alias("n_b")).limit(0)
    return found


def _forms(words: DataFrame, pairs: DataFrame, dominance: int) -> DataFrame:
    turned = pairs.select(F.col("b").alias("a"), F.col("n_b").alias("n_a"), F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form"))).alias("best")
    near = pairs.unionByName(turned).groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best)
    joined = words.join(near, "word", "left")
    good: Column = -F.col("best.less") >= dominance * F.col("n")
    return joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n"),
    )


def _roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words with a form; every round doubles the steps that a pointer spans.

    A form occurs at least ``dominance`` times as often, so ways are short and end.
    """
    current = materialize(forms.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        following = current.join(onward, "root", "left")
        if following.filter("next is not null").isEmpty():
            return current
        current = materialize(following.select("word", F.coalesce("next", "root").alias("root")))


def variants(
    docs: DataFrame,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    dominance: int = DOMINANCE,
    noise: int = NOISE,
    max_bytes: int = bloom.MAX_BYTES,
) -> DataFrame:
    """``word, n, n_near, form, form_n, root`` for every word of the vocabulary of ``docs``.

    A word's form is its most frequent near word (ties: the first in code-point order), if that
    occurs at least ``dominance`` times as often; its root is where following forms ends.
    ``dominance`` has to be above 1.
    """
    words = vocabulary(docs, min_length, min_count, noise)
    forms = materialize(_forms(words, near_pairs(words, max_bytes), dominance))
    joined = forms.join(_roots(forms), "word", "left")
    return joined.withColumn("root", F.coalesce("root", "word"))
