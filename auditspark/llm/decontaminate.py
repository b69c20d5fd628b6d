"""Overlap of documents with benchmark items, found by winnowing.

Words of both sides are hashed; a fingerprint is the smallest hash of ``GRAM`` words in every run of
``WINDOW - GRAM + 1`` of them, so any ``WINDOW`` words that a document shares with an item share a
fingerprint. Fingerprints of the documents are looked up among those of the items, and each hit is
extended word by word in both directions; only runs of a whole window count. Items shorter than a
window are one window each and are looked up whole.

Items travel to the tasks, documents stay where they are. A part of the benchmark holds at most
``PART_BYTES`` of text; a larger benchmark is cut into parts by item, one pass over the documents
each, whose hits are put together per document afterwards.
"""

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import SpanHash, Texts, byte_class, free_name, list_array, map_slices, mix, with_row_key
from auditspark.session import materialize

WINDOW = 13
GRAM = 5
PART_BYTES = 4 << 20
WORD_BYTES = ~byte_class(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
NOTHING = np.uint64((1 << 64) - 1)
_STEP = np.uint64(0x9FB21C651E98DF25)


class Words:
    """The words of a slice of texts: spans, hashes, and the range of words of each text."""

    def __init__(self, column: pa.Array):
        self.texts = Texts(column, lower=True)
        self.starts, self.ends = self.texts.runs(WORD_BYTES)
        self.low, self.high = self.texts.bounds(self.starts)
        self.hashes = SpanHash(self.texts.data).of(self.starts, self.ends)
        self.owner = np.repeat(np.arange(self.texts.size), self.high - self.low)

    def grams(self, size: int) -> np.ndarray:
        """Hash of ``size`` words from each word on; ``NOTHING`` where the text ends before."""
        out = np.full(len(self.hashes), NOTHING, np.uint64)
        number = len(out) - size + 1
        if number > 0:
            value = np.zeros(number, np.uint64)
            for at in range(size):
                value = value * _STEP + self.hashes[at:at + number]
            whole = self.owner[:number] == self.owner[size - 1:]
            out[:number] = np.where(whole, mix(value) >> np.uint64(1), NOTHING)
        return out

    def word(self, at: int) -> bytes:
        return self.texts.data[self.starts[at]:self.ends[at]].tobytes()


def _sliding(values: np.ndarray, size: int, choose) -> np.ndarray:
    """``choose`` over every ``size`` consecutive values."""
    done, out = 1, values
    while done < size:
        step = min(done, size - done)
        out = choose(out[:len(out) - step], out[step:])
        done += step
    return out


def winnowed(grams: np.ndarray, width: int) -> np.ndarray:
    """Positions of the hashes that are smallest in some run of ``width``; all of them if fewer."""
    if len(grams) <= width:
        return np.flatnonzero(grams != NOTHING)
    least = _sliding(grams, width, np.minimum)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    return np.flatnonzero((_sliding(padded, width, np.maximum) == grams) & (grams != NOTHING))


@dataclass
class Part:
    """Fingerprints of some benchmark items: per gram size the sorted hashes and where they stand."""

    words: list[list[bytes]]
    items: list
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    filters: dict[int, np.ndarray]
    window: int


def build_part(items: list, texts: pa.Array, window: int = WINDOW, gram: int = GRAM) -> Part:
    """Index items; a size below ``window`` is that of the items which have so many words."""
    split = Words(texts)
    found: dict[int, list] = defaultdict(list)
    long_grams = split.grams(gram)
    for at, (low, high) in enumerate(zip(split.low.tolist(), split.high.tolist())):
        size = high - low
        if size >= window:
            places = winnowed(long_grams[low:high], window - gram + 1)
            found[0].append((long_grams[low:high][places], np.full(len(places), at), places))
        elif size:
            found[size].append((split.grams(size)[low:low + 1], np.array([at]), np.array([0])))
    tables, filters = {}, {}
    for size, rows in found.items():
        hashes, owner, place = (np.concatenate([row[n] for row in rows]) for n in range(3))
        order = np.argsort(hashes, kind="stable")
        tables[size] = hashes[order], owner[order], place[order]
        filters[size] = np.zeros(1 << 20, bool)
        filters[size][(hashes >> np.uint64(43)).astype(np.int64)] = True
    words = [[split.word(n) for n in range(low, high)] for low, high in zip(split.low, split.high)]
    return Part(words, items, tables, filters, window)


def _seeds(split: Words, part: Part, gram: int) -> dict[int, set[tuple[int, int, int]]]:
    """Per text the seeds ``(size, item, shift)``; shift is the place in the text less that in the item."""
    seeds: dict[int, set] = defaultdict(set)
    for size, (hashes, owner, place) in part.tables.items():
        grams = split.grams(size or gram)
        if size:
            at = np.flatnonzero(grams != NOTHING)
        else:
            at = winnowed(grams, part.window - gram + 1)
        values = grams[at]
        maybe = part.filters[size][(values >> np.uint64(43)).astype(np.int64)]
        at, values = at[maybe], values[maybe]
        first, last = np.searchsorted(hashes, values, "left"), np.searchsorted(hashes, values, "right")
        for spot, begin, end in zip(at.tolist(), first.tolist(), last.tolist()):
            text = int(split.owner[spot])
            inside = spot - int(split.low[text])
            for row in range(begin, end):
                seeds[text].add((size, int(owner[row]), inside - int(place[row]), int(place[row])))
    return seeds


def _extend(split: Words, text: int, part: Part, seeds: set) -> tuple[list[tuple[int, int]], set[int]]:
    """Merged runs of hit words of a text, and the items (by position) with windows in it."""
    base, size = int(split.low[text]), int(split.high[text] - split.low[text])
    runs, items, done = [], set(), {}
    for length, item, shift, place in sorted(seeds):
        words = part.words[item]
        need = length or part.window
        if done.get((item, shift), -1) > place:
            continue
        left = right = place
        while left > 0 and left + shift > 0 and split.word(base + left - 1 + shift) == words[left - 1]:
            left -= 1
        while right < len(words) and right + shift < size and split.word(base + right + shift) == words[right]:
            right += 1
        done[item, shift] = right
        if right - left >= need:
            runs.append((left + shift, right + shift))
            items.add(item)
    merged: list[tuple[int, int]] = []
    for low, high in sorted(runs):
        if merged and low <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(high, merged[-1][1])
        else:
            merged.append((low, high))
    return merged, items


def _hits_of(column: pa.Array, part: Part, gram: int) -> tuple[np.ndarray, list, list]:
    """Words per text, merged runs per text, item numbers per text."""
    split = Words(column)
    runs: list[list] = [[]] * split.texts.size
    items: list[list] = [[]] * split.texts.size
    for text, seeds in _seeds(split, part, gram).items():
        merged, found = _extend(split, text, part, seeds)
        runs[text], items[text] = merged, [part.items[item] for item in sorted(found)]
    return split.high - split.low, runs, items


def _parts(benchmark: DataFrame, limit: int, window: int, gram: int):
    """The indexed parts of the benchmark, one after the other; none holds more text than the limit
    allows, unless a single item does."""
    items = materialize(
        benchmark.filter("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    )
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    number = -(-total * 2 // limit) or 1
    slot = F.pmod(F.xxhash64("item_id"), F.lit(number))
    for wanted in range(number):
        rows = (items if number == 1 else items.filter(slot == wanted)).toArrow().combine_chunks()
        texts = rows.column("text").combine_chunks()
        yield build_part(rows.column("item_id").to_pylist(), texts, window, gram)


def _one_pass(docs: DataFrame, part: Part, gram: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(part)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, runs, items = _hits_of(batch.column("text"), shared.value, gram)
        lengths = np.array([len(found) for found in runs], np.int32)
        flat = [edge for found in runs for edge in found]
        low = pa.array([edge[0] for edge in flat], pa.int32())
        high = pa.array([edge[1] for edge in flat], pa.int32())
        spans = list_array(pa.StructArray.from_arrays([low, high], ["low", "high"]), lengths)
        named = list_array(pa.array([name for found in items for name in found], pa.string()), np.array([len(found) for found in items], np.int32))
        columns = [batch.column("row_key"), batch.column("doc_id"), pa.array(counts.astype(np.int64)), spans, named]
        return pa.RecordBatch.from_arrays(columns, ["row_key", "doc_id", "n_words", "spans", "items"])

    schema = "row_key long, doc_id long, n_words long, spans array<struct<low:int,high:int>>, items array<string>"
    return map_slices(docs.select("row_key", "doc_id", "text"), run, schema)


def _summed(hits: DataFrame) -> DataFrame:
    """Join the hits of several passes over the same row."""

    def run(batches):
        for batch in batches:
            merged, named = [], []
            for spans, items in zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist()):
                kept: list[dict] = []
                for span in sorted((span for part in spans for span in part), key=lambda span: span["low"]):
                    if kept and span["low"] <= kept[-1]["high"]:
                        kept[-1]["high"] = max(kept[-1]["high"], span["high"])
                    else:
                        kept.append(dict(span))
                merged.append(kept)
                named.append([name for part in items for name in part])
            kind = batch.schema.field("spans").type.value_type
            yield pa.RecordBatch.from_arrays(
                [batch.column("row_key"), batch.column("doc_id"), batch.column("n_words"), pa.array(merged, kind), pa.array(named, pa.list_(pa.string()))],
                ["row_key", "doc_id", "n_words", "spans", "items"],
            )

    gathered = hits.groupBy("row_key").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_words").alias("n_words"),
        F.collect_list("spans").alias("spans"),
        F.collect_list("items").alias("items"),
    )
    return gathered.select("row_key", "doc_id", "n_words", "spans", "items").mapInArrow(run, hits.schema)


def overlaps(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, part_bytes: int = PART_BYTES
) -> DataFrame:
    """``doc_id, n_words, spans, items`` for every row of ``docs``.

    ``spans`` are the runs of hit words (first word, word after the last), ``items`` the benchmark
    items with a window in the text, sorted as text. Null texts have no words; items without words
    or without a number are left out; items that share a number count as one. Repeated rows of
    ``docs`` stay repeated, other columns are not looked at.
    """
    parts = _parts(benchmark, part_bytes, window, gram)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = next(parts)
    second = next(parts, None)
    if second is None:
        hits = _one_pass(source.withColumn("row_key", F.lit(0).cast("long")), first, gram)
    else:
        # Passes meet again by a number of the row, so the numbered rows are stored.
        keyed = materialize(source.withColumn("row_key", F.monotonically_increasing_id()))
        hits = materialize(_one_pass(keyed, first, gram))
        part = second
        while part is not None:
            following = _one_pass(keyed, part, gram).filter("size(items) > 0")
            hits = hits.unionByName(materialize(following))
            part = next(parts, None)
        hits = _summed(hits)
    return hits.select("doc_id", "n_words", "spans", F.array_sort(F.array_distinct("items")).alias("items"))


def _judged(found: DataFrame) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["high"] - span["low"])
    return found.withColumn("n_hit", hit).withColumn("contaminated", F.expr("n_hit > 0 and 20 * n_hit >= n_words"))


def report(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """One row per document: ``n_words, n_hit, n_items, items_sha256, contaminated``.

    A document is contaminated when at least a twentieth of its words, and at least one, is hit.
    """
    return _judged(overlaps(docs, benchmark, **settings)).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def clean(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, part_bytes: int = PART_BYTES
) -> DataFrame:
    """``docs`` without its contaminated rows, each judged by its own text; all columns are kept.

    With one part of the benchmark rows are dropped where they lie.
    """
    parts = _parts(benchmark, part_bytes, window, gram)
    first, second = next(parts), next(parts, None)
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, runs, _ = _hits_of(batch.column("text"), shared.value, gram)
            hit = np.array([sum(high - low for low, high in found) for found in runs])
            return batch.filter(pa.array((hit == 0) | (20 * hit < counts)))

        return map_slices(docs, run, docs.schema)
    row = free_name(docs, "__row")
    numbered = with_row_key(docs, row)
    found = overlaps(numbered.select(F.col(row).alias("doc_id"), "text"), benchmark, window, gram, part_bytes)
    bad = materialize(_judged(found).filter("contaminated").select(F.col("doc_id").alias(row)))
    return numbered.join(bad, row, "left_anti").select(*docs.columns)
