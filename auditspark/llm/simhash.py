"""Near-duplicate documents by SimHash and a Gray-ordered hierarchical index.

A fingerprint has 64 bits: a bit is set if more than half of the text's shingles have it set in
their XXH64. Texts whose fingerprints differ in at most ``radius`` bits are linked.

Search. The bits are cut into ``radius + 2`` blocks; two fingerprints within the radius agree in at
least two blocks, so every pair of blocks is one view, and linked fingerprints share the key of some
view. Inside a key the fingerprints are sorted by Gray rank, which brings fingerprints with common
bits together; runs of them form nodes that hold the bits all members share (a mask and a pattern),
runs of nodes form upper nodes. A search walks down from the upper nodes, adds up the differences in
the bits each node newly fixes, and leaves a node with all its members once the sum passes the
radius. Of a key's links only as many pairs leave its task as are needed to connect the same
fingerprints.
"""

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from auditspark.llm.common import Texts, byte_class, free_name, map_slices, split_groups, with_row_key
from auditspark.llm.components import components, hook
from auditspark.session import materialize

BITS = 64
FANOUT = 8
GROUP_LIMIT = 4096
BUFFER_ROWS = 60_000
FRONTIER = 1 << 21
WORD_BYTES = ~byte_class(r"[\x20\x09-\x0D]")


def _shingle_spans(texts: Texts, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Spans of the shingles in the texts with words set apart by one blank, and shingles per text."""
    starts, ends = texts.runs(WORD_BYTES)
    lengths = ends - starts
    fresh = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int((lengths + 1).sum()), 32, np.uint8)
    member = WORD_BYTES[texts.data]
    place = np.repeat(fresh - starts, lengths) + np.flatnonzero(member)
    joined[place] = texts.data[member]
    low, high = texts.bounds(starts)
    count = high - low
    made = np.where(count == 0, 0, np.maximum(count - words + 1, 1))
    first = np.repeat(low - np.cumsum(made) + made, made) + np.arange(int(made.sum()))
    last = np.minimum(first + words, np.repeat(high, made)) - 1
    return fresh[first], fresh[last] + lengths[last], made, np.cumsum(made) - made, joined.tobytes()


def _majority(hashes: np.ndarray, made: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bits set in more than half of the hashes of each text.

    Eight 8-bit counters lie in one word, so sums run over pieces of at most 255 hashes.
    """
    pieces = -(-made // 255)
    owner = np.repeat(np.arange(len(made)), pieces)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cuts = offsets[owner] + 255 * inner
    counts = np.zeros((len(made), BITS), np.int64)
    if len(cuts):
        lanes = np.uint64(0x0101010101010101)
        for shift in range(8):
            sums = np.add.reduceat((hashes >> np.uint64(shift)) & lanes, cuts)
            by_lane = sums.astype("<u8").view(np.uint8).reshape(-1, 8)
            np.add.at(counts, (owner[:, None], np.arange(8)[None, :] * 8 + shift), by_lane)
    bits = 2 * counts > made[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()


def fingerprints_of(column: pa.Array, words: int = 4) -> np.ndarray:
    """Fingerprints of texts; null texts and texts without words get zero."""
    texts = Texts(column, lower=True)
    begin, end, made, offsets, joined = _shingle_spans(texts, words)
    digest = (xxh64_intdigest(joined[a:b], 42) for a, b in zip(begin.tolist(), end.tolist()))
    hashes = np.fromiter(digest, np.uint64, len(begin))
    return _majority(hashes, made, offsets)


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``doc_id, fingerprint`` (64 bits as a signed number) of every row of ``docs``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = fingerprints_of(batch.column("text"), words).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "fingerprint"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_slices(source, run, "doc_id long, fingerprint long")


def blocks_of(radius: int) -> list[tuple[int, int]]:
    """``(shift, width)`` of ``radius + 2`` blocks that cover all bits."""
    cuts = np.linspace(0, BITS, radius + 3).round().astype(int)
    return [(int(a), int(b - a)) for a, b in zip(cuts[:-1], cuts[1:])]


def _views(distinct: DataFrame, radius: int) -> DataFrame:
    """Each fingerprint once per pair of blocks, with those blocks' bits and the view as its key."""
    blocks = blocks_of(radius)
    keys = []
    for number, (one, two) in enumerate(combinations(blocks, 2)):
        parts = [
            F.shiftrightunsigned("fingerprint", shift).bitwiseAND(F.lit((1 << width) - 1)) for shift, width in (one, two)
        ]
        bits = F.shiftleft(parts[0], two[1]).bitwiseOR(parts[1])
        keys.append(bits * F.lit(len(blocks) ** 2) + F.lit(number))
    return distinct.select("fingerprint", F.explode(F.array(*keys)).alias("key"))


def gray_rank(values: np.ndarray) -> np.ndarray:
    """Position of each value in the Gray sequence."""
    rank = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Hierarchical index over fingerprints of many groups, one tree per group.

    ``levels[0]`` are the fingerprints in order of group and Gray rank, each higher level joins runs
    of ``FANOUT`` nodes of one group, the last has one node per group. A node knows the bits all
    fingerprints below it share: ``mask`` says which, ``pattern`` their values.
    """

    def __init__(self, values: np.ndarray, groups: np.ndarray):
        self.order = np.lexsort((gray_rank(values), groups))
        self.values = values[self.order]
        group = groups[self.order]
        ones, some = self.values, self.values
        self.levels = [(self.values, np.full(len(values), ~np.uint64(0)), None, None)]
        while True:
            heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            sizes = np.diff(np.r_[heads, len(group)])
            if sizes.max() == 1:
                break
            place = np.arange(len(group)) - np.repeat(heads, sizes)
            cuts = np.flatnonzero(place % FANOUT == 0)
            ones, some = np.bitwise_and.reduceat(ones, cuts), np.bitwise_or.reduceat(some, cuts)
            mask = ~(ones ^ some)
            self.levels.append((ones & mask, mask, cuts, np.diff(np.r_[cuts, len(group)])))
            group = group[cuts]
        self.group_of_root = group

    def search(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query position, fingerprint position) within the radius, below the given roots."""
        at, node = np.arange(len(queries)), roots
        pattern, mask, _, _ = self.levels[-1]
        spent = np.bitwise_count((queries ^ pattern[node]) & mask[node])
        for level in range(len(self.levels) - 1, 0, -1):
            near = spent <= radius
            at, node, spent = at[near], node[near], spent[near]
            _, fixed, first, number = self.levels[level]
            pattern, mask, _, _ = self.levels[level - 1]
            times = number[node]
            known = np.repeat(fixed[node], times)
            at, spent = np.repeat(at, times), np.repeat(spent, times)
            start = first[node]
            node = np.arange(len(at)) + np.repeat(start - np.cumsum(times) + times, times)
            spent = spent + np.bitwise_count((queries[at] ^ pattern[node]) & mask[node] & ~known)
        near = spent <= radius
        return at[near], node[near]


def linked(values: np.ndarray, groups: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect what the links inside every group connect: each fingerprint and its smallest relative."""
    if not len(values):
        return values, values
    index = GrayIndex(values, groups)
    group = groups[index.order]
    root = np.cumsum(np.r_[0, group[1:] != group[:-1]])
    sizes = np.bincount(root)[root]
    labels = np.arange(len(values))
    low = 0
    loads = np.cumsum(sizes)
    while low < len(values):
        high = max(low + 1, int(np.searchsorted(loads, (loads[low - 1] if low else 0) + FRONTIER)))
        at, found = index.search(index.values[low:high], root[low:high], radius)
        at = at + low
        later = found > at
        hook(labels, at[later], found[later])
        low = high
    child = np.flatnonzero(labels != np.arange(len(values)))
    return index.values[child], index.values[labels[child]]


def _link_groups(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of rows ``key, unit, fingerprint`` that arrive with equal keys and units together."""
    held: list[pa.RecordBatch] = []

    def emit(table: pa.Table) -> pa.RecordBatch:
        values = table.column("fingerprint").to_numpy().view(np.uint64)
        key, unit = table.column("key").to_numpy(), table.column("unit").to_numpy()
        changes = np.r_[0, (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])]
        one, two = linked(values, np.cumsum(changes), radius)
        return pa.RecordBatch.from_arrays([pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(len(part) for part in held) < BUFFER_ROWS:
            continue
        table = pa.Table.from_batches(held)
        key, unit = table.column("key").to_numpy(), table.column("unit").to_numpy()
        changes = np.flatnonzero((key[1:] != key[:-1]) | (unit[1:] != unit[:-1]))
        cut = int(changes[-1]) + 1 if len(changes) else 0
        if cut:
            yield emit(table.slice(0, cut))
            held = table.slice(cut).to_batches()
    if held and sum(len(part) for part in held):
        yield emit(pa.Table.from_batches(held))


def links(distinct: DataFrame, radius: int = 4, limit: int = GROUP_LIMIT) -> DataFrame:
    """``a, b``: pairs of fingerprints that connect whatever links within the radius connect."""
    units = split_groups(_views(distinct, radius), ["key"], "fingerprint", limit)
    laid = units.repartition("key", "unit").sortWithinPartitions("key", "unit")
    return laid.select("key", "unit", "fingerprint").mapInArrow(
        lambda batches: _link_groups(batches, radius), "a long, b long"
    )


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, limit: int = GROUP_LIMIT) -> DataFrame:
    """``doc_id, fingerprint, component_id, n_links`` for every row of ``docs``.

    ``component_id`` is the smallest document number that links lead to, the row's own included;
    ``n_links`` counts the links that it takes to hold its component together. Null and empty texts have fingerprint
    zero and are linked like any other. A row without ``doc_id`` is fingerprinted and linked, and
    never gives its component a name; where no row of a component has a number, the name is null.
    Repeated rows stay repeated. Other columns are not looked at.
    """
    marked = materialize(fingerprints(docs, words))
    distinct = marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    member = materialize(components(links(distinct.select("fingerprint"), radius, limit)))
    rooted = distinct.join(member, distinct["fingerprint"] == member["node"], "left").select(
        "fingerprint", "first", F.coalesce("root", "fingerprint").alias("root")
    )
    names = rooted.groupBy("root").agg(
        F.min("first").alias("component_id"), (F.count("*") - 1).alias("n_links")
    )
    named = rooted.join(names, "root").select("fingerprint", "component_id", "n_links")
    return marked.join(named, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id", "n_links"
    )


def distinct_documents(docs: DataFrame, words: int = 4, radius: int = 4, limit: int = GROUP_LIMIT) -> DataFrame:
    """The rows of ``docs`` that lead their component, with all columns.

    Of each component the row with the smallest document number stays, of repeated rows with that
    number one. Where no row of a component has a number, one of its rows stays.
    """
    row = free_name(docs, "__row")
    numbered = with_row_key(docs, row)
    plain = numbered.select(F.col(row).alias("doc_id"), "text")
    found = near_duplicates(plain, words, radius, limit)
    placed = found.select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__row")
    ordered = numbered.select("doc_id", F.col(row).alias("__row")).select("__row", order.alias("order"))
    ranked = materialize(ordered.join(placed, "__row"))
    leaders = ranked.groupBy("__group").agg(F.min("order").alias("first"))
    # Most documents stay, so the table of those that go is the smaller one.
    goes = ranked.join(leaders, ranked["__group"] == leaders["__group"])
    gone = materialize(goes.filter(F.col("__row") != F.col("first.__row")).select(F.col("__row").alias(row)))
    return numbered.join(gone, row, "left_anti").select(*docs.columns)
