"""Removal of lines that repeat, also with small changes, across all documents.

Equal lines meet by a 128-bit hash. Every distinct line has a MinHash signature over its character
shingles. Bands of the signature bring similar lines together; the exact Jaccard similarity of their
shingle sets decides. Links become components, and of each component the line that comes first in the corpus (by
document number, then line number) is kept. Lines belong to rows, so rows that share a document number
take part like others; rows without one are left as they are.

Pairs of a band are not listed. First every line of a band is compared with the band's smallest
line only. After that, bands whose lines still lie in different components are compared fully, in
tasks that get the lines' texts and skip what is already connected; large ones are cut into blocks.
Every link goes into one search for components.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import (
    SpanHash, Texts, bound_batches, eight_bytes, free_name, lean, map_slices, mix, slices, split_groups, with_row_key,
)
from auditspark.llm.components import components
from auditspark.llm.urls import BITS_PER_KEY, MAX_BYTES, Filter, build_filter
from auditspark.session import materialize

SHINGLE = 8
SIMILAR = 0.8
BANDS = 12
ROWS = 4
GROUP_LIMIT = 512
SLICE = 1 << 18
# More lines than a document can have.
LINES = 1 << 32
# White space of all kinds but the line feed; a line of nothing else is blank.
WHITE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Bits of the picture of a shingle set.
PICTURE = 2048


def _numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with ``row``, a number of its own for every row, in the order of the corpus."""
    numbered = with_row_key(docs, row)
    number = F.col("doc_id").cast("long")
    if numbered.filter(~F.col(row).eqNullSafe(number)).isEmpty():
        return numbered
    # Sorted partitions follow one another, so numbers counted in them rise with the order.
    places = materialize(
        numbered.select(number.alias("doc_id"), F.col(row).alias("__row"))
        .orderBy(F.col("doc_id").asc_nulls_last(), "__row")
        .select(F.col("__row").alias("__old"), F.monotonically_increasing_id().alias("__place"))
    )
    joined = numbered.join(places, numbered[row] == places["__old"])
    return materialize(joined.select(*(numbered[name] for name in docs.columns), F.col("__place").alias(row)))


def _plain(numbered: DataFrame, row: str) -> DataFrame:
    return numbered.select(F.col(row).alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def lines_of(docs: DataFrame) -> DataFrame:
    """``__row, line_no, line, h1, h2`` for every line that is not blank, of rows with a document number; numbers start at 0."""
    split = docs.filter("doc_id is not null").select("__row", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return split.filter(F.btrim("line", F.lit(WHITE)) != "").select(
        "*", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("second"), "line").alias("h2")
    )


class Places:
    """Row and line number as one number of the same order: a long where the rows' numbers are small, else a decimal."""

    def __init__(self, docs: DataFrame):
        self.short = docs.filter(~F.col("__row").between(0, (1 << 31) - 1)).isEmpty()

    def of(self) -> Column:
        if self.short:
            return F.shiftleft("__row", 32) + F.col("line_no")
        return (F.col("__row").cast("decimal(20,0)") * F.lit(LINES) + F.col("line_no")).cast("decimal(38,0)")

    def row(self, place: str) -> Column:
        if self.short:
            return F.shiftright(place, 32)
        return F.expr(f"({place} - pmod({place}, {LINES})) div {LINES}").cast("long")

    def line(self, place: str) -> Column:
        if self.short:
            return F.col(place).bitwiseAND(LINES - 1).cast("int")
        return F.expr(f"pmod({place}, {LINES})").cast("int")


def _ends(starts: np.ndarray, size: int, before: np.ndarray) -> np.ndarray:
    """Where ``size`` characters from each start end; ``before`` counts the bytes inside characters ahead of each place."""
    ends = starts + size
    while True:
        # A byte at the end itself that belongs to the last character counts too.
        further = starts + size + (before[ends + 1] - before[starts])
        if np.array_equal(further, ends):
            return ends
        ends = further


def _char_shingles(texts: Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hash of every shingle of ``size`` characters, and how many each text has (one if shorter).

    A shingle of eight bytes is hashed as one number, any other one as a span.
    """
    data = texts.data
    inside = (data & 0xC0) == 0x80
    inner = np.flatnonzero(inside)
    chars = texts.ends - texts.starts
    if len(inner):
        before = np.zeros(len(data) + 2, np.int64)
        np.cumsum(inside, out=before[1:-1])
        before[-1] = before[-2]
        chars = chars - (before[texts.ends] - before[texts.starts])
    made = np.where(chars == 0, 0, np.maximum(chars - size + 1, 1))
    # Every character begins a shingle but for the last ones of a text; a short text is one shingle.
    kept, some = ~inside, np.flatnonzero(chars)
    first, last = texts.starts[some], texts.ends[some]
    for _ in range(size - 1):
        last = np.maximum(last - 1, first)
        for _ in range(3 if len(inner) else 0):
            last = last - inside[last]
        kept[last] = False
    short = np.flatnonzero((chars > 0) & (chars < size))
    kept[texts.starts[short]] = True
    eights = eight_bytes(data)[:-1].copy()
    values = eights >> np.uint64(29)
    values ^= eights
    values *= np.uint64(0x9FB21C651E98DF25)
    values >>= np.uint64(32)
    values = values.astype(np.uint32)[kept]
    places, starts, ends = (np.cumsum(made) - made)[short], texts.starts[short], texts.ends[short]
    if size != 8 or len(inner):
        # A shingle of eight characters in other than eight bytes has a byte inside a character among its own.
        wide = np.full(len(data), size != 8)
        for back in range(1, 9):
            wide[np.maximum(inner - back, 0)] = True
        wide &= kept
        wide[starts] = False
        begins = np.flatnonzero(wide)
        places, starts = np.append(places, np.flatnonzero(wide[kept])), np.append(starts, begins)
        ends = np.append(ends, _ends(begins, size, before) if len(inner) else begins + size)
    other = np.flatnonzero(ends - starts != 8)
    if len(other):
        values[places[other]] = SpanHash(data).of(starts[other], ends[other]) >> np.uint64(32)
    return values, made


def signatures(column: pa.Array, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit value per text and band; texts that are equal as shingle sets get equal values.

    A band's value mixes ``rows`` minima, each over all shingles of the text in an order of its own.
    """
    texts = Texts(column)
    short, made = _char_shingles(texts, size)
    some = np.flatnonzero(made)
    cuts = (np.cumsum(made) - made)[some]
    orders = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    value = np.zeros((texts.size, bands), np.uint64)
    if not len(cuts):
        return value ^ mix(np.arange(bands, dtype=np.uint64))[None, :]
    # One array serves all orders; a new one each time would cost more than the sums.
    product, least = np.empty_like(short), np.empty((rows, len(cuts)), np.uint32)
    for band in range(bands):
        for row in range(rows):
            np.multiply(short, orders[band * rows + row], out=product)
            np.minimum.reduceat(product, cuts, out=least[row])
        mixed = np.zeros(len(cuts), np.uint64)
        for row in least:
            mixed = mix(mixed * np.uint64(31) + row)
        value[some, band] = mixed
    return value ^ mix(np.arange(bands, dtype=np.uint64))[None, :]


def _signed(lines: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = signatures(batch.column("line"), size, bands, rows)
        flat = [pa.array(np.ascontiguousarray(values[:, at]).view(np.int64)) for at in range(bands)]
        return pa.RecordBatch.from_arrays([*(batch.column(name) for name in names), *flat], [*names, *made])

    names, made = ["__row", "line_no", "h1", "h2"], [f"b{at}" for at in range(bands)]
    schema = ", ".join(["__row long, line_no int, h1 long, h2 long", *(f"{name} long" for name in made)])
    return map_slices(lines, run, schema, "line", SLICE)


def shingle_set(line: str, size: int = SHINGLE) -> set[str]:
    """Character shingles of a line; a shorter line is its own only shingle."""
    return {line[at:at + size] for at in range(max(1, len(line) - size + 1))}


def similar(one: set[str], two: set[str], least: float = SIMILAR) -> bool:
    """Jaccard similarity of at least ``least``, decided in whole numbers of a thousandth."""
    small, large = sorted((len(one), len(two)))
    bound = round(least * 1000)
    if small * 1000 < bound * large:
        return False
    common = len(one & two)
    return common * 1000 >= bound * (small + large - common)


class Exact:
    """Comparisons of lines by their shingles themselves, which are kept for lines that come again.

    Where both lines are Latin-1, a shingle of eight characters is one number of eight bytes.
    """

    def __init__(self, size: int, least: float):
        self.size, self.least = size, least
        self.numbers: dict[str, np.ndarray | None] = {}
        self.sets: dict[str, set[str]] = {}

    def _numbers(self, line: str) -> np.ndarray | None:
        if line not in self.numbers:
            try:
                data = np.frombuffer(line.encode("latin-1"), np.uint8)
                fits = self.size == 8 <= len(data)
            except UnicodeEncodeError:
                fits = False
            self.numbers[line] = self._sorted(eight_bytes(data)[:len(data) - 7]) if fits else None
        return self.numbers[line]

    @staticmethod
    def _sorted(numbers: np.ndarray) -> np.ndarray:
        """The distinct numbers in order; for so few, sorting takes less than ``np.unique``."""
        numbers = np.sort(numbers)
        first = np.ones(len(numbers), bool)
        np.not_equal(numbers[1:], numbers[:-1], out=first[1:])
        return numbers[first]

    def _set(self, line: str) -> set[str]:
        if line not in self.sets:
            self.sets[line] = shingle_set(line, self.size)
        return self.sets[line]

    def similar(self, one: str, two: str) -> bool:
        left, right = self._numbers(one), self._numbers(two)
        if left is None or right is None:
            return similar(self._set(one), self._set(two), self.least)
        small, large = sorted((len(left), len(right)))
        bound = round(self.least * 1000)
        if small * 1000 < bound * large:
            return False
        both = np.sort(np.concatenate([left, right]))
        common = int(np.count_nonzero(both[1:] == both[:-1]))
        return common * 1000 >= bound * (small + large - common)


def _pictures(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of bits per line, in which each shingle sets the bit that its hash names, and the number of shingles."""
    pictures, counts = np.zeros((len(column), PICTURE // 64), np.uint64), np.zeros(len(column), np.int64)
    for low in range(0, len(column), 512):
        short, made = _char_shingles(Texts(column.slice(low, 512)), size)
        bits = np.zeros((len(made), PICTURE), bool)
        bits.ravel()[np.repeat(np.arange(len(made)) * PICTURE, made) + short % np.uint32(PICTURE)] = True
        pictures[low:low + 512] = np.packbits(bits, axis=1).view(np.uint64)
        counts[low:low + 512] = made
    return pictures, counts


def _may_be_similar(ones: np.ndarray, n_ones: np.ndarray, twos: np.ndarray, n_twos: np.ndarray, least: float) -> np.ndarray:
    """False for pairs of pictures whose lines cannot reach the similarity.

    Every bit that only one picture has stands for a shingle that the lines do not share.
    """
    lacks = np.bitwise_count(ones & ~twos).sum(axis=-1, dtype=np.int64)
    more = np.bitwise_count(twos & ~ones).sum(axis=-1, dtype=np.int64)
    common = np.minimum(n_ones - lacks, n_twos - more)
    return common * 1000 >= round(least * 1000) * (common + lacks + more)


def _verify(pairs: DataFrame, size: int, least: float) -> DataFrame:
    """Those of ``a, b, line_a, line_b`` that are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Pairs with one line in common follow one another.
            coded = batch.column("line_a").dictionary_encode()
            pictures, counts = _pictures(coded.dictionary, size)
            at = coded.indices.to_numpy()
            maybe = _may_be_similar(pictures[at], counts[at], *_pictures(batch.column("line_b"), size), least)
            batch, exact = batch.filter(pa.array(maybe)), Exact(size, least)
            lines = zip(batch.column("line_a").to_pylist(), batch.column("line_b").to_pylist())
            good = [exact.similar(one, two) for one, two in lines]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "line_a", "line_b").mapInArrow(lean(run), "a long, b long")


def _small_filter(keys: DataFrame, pair: Callable) -> Filter | None:
    """A Bloom filter over a stored table, for a broadcast; None if it would pass the bound on its size."""
    number = keys.count()
    return build_filter(keys, 0, number, pair) if number * BITS_PER_KEY // 8 <= MAX_BYTES else None


def _once_or_twice(bands: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every band in order, with its smallest node; bands that came more than once come twice."""
    order = np.argsort(bands)
    bands, nodes = bands[order], nodes[order]
    first = np.flatnonzero(np.append(bands[:1] == bands[:1], bands[1:] != bands[:-1]))
    times = np.minimum(np.diff(np.append(first, len(bands))), 2)
    least = np.minimum.reduceat(nodes, first) if len(first) else nodes
    return np.repeat(bands[first], times), np.repeat(least, times)


def _shared(distinct: DataFrame, tasks: int) -> DataFrame:
    """``band, least``: every band that several distinct lines have, with the smallest node among them.

    Bands are dealt to ``tasks`` by their order, many in a row. Two rows tell that a band is shared, so
    no more of them travel from a batch or stay in memory.
    """
    cuts = np.array([(at << 64) // tasks for at in range(1, tasks)], np.uint64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("bands")
            owner = column.value_parent_indices()
            bands, nodes = _once_or_twice(column.flatten().to_numpy().view(np.uint64), batch.column("node").take(owner).to_numpy())
            ends = [*np.searchsorted(bands, cuts).tolist(), len(bands)]
            spans = [(at, low, high) for at, (low, high) in enumerate(zip([0, *ends], ends)) if low < high]
            packed = [pa.array([values[low:high].tobytes() for _, low, high in spans], pa.binary()) for values in (bands, nodes)]
            yield pa.RecordBatch.from_arrays([pa.array([at for at, _, _ in spans], pa.int32()), *packed], ["part", "bands", "nodes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, number = (np.zeros(0, np.uint64), np.zeros(0, np.int64)), [], 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            return _once_or_twice(*(np.concatenate([piece[n] for piece in [held, *waiting]]) for n in (0, 1)))

        for batch in batches:
            for bands, nodes in zip(batch.column("bands").to_pylist(), batch.column("nodes").to_pylist()):
                waiting.append((np.frombuffer(bands, np.uint64), np.frombuffer(nodes, np.int64)))
                number += len(waiting[-1][0])
                if number > len(held[0]) + SLICE:
                    held, waiting, number = merged(), [], 0
        bands, nodes = merged()
        at = np.flatnonzero(bands[1:] == bands[:-1])
        for low in range(0, len(at), SLICE):
            some = at[low:low + SLICE]
            yield pa.RecordBatch.from_arrays([pa.array(bands[some].view(np.int64)), pa.array(nodes[some])], ["band", "least"])

    packed = distinct.select("node", "bands").mapInArrow(lean(pack), "part int, bands binary, nodes binary")
    return packed.repartitionById(tasks, "part").mapInArrow(lean(meet), "band long, least long")


def _members(distinct: DataFrame, shared: DataFrame) -> DataFrame:
    """``node, row, line_no, band, least`` for every line in a band of several lines.

    A filter of those bands, if it is small enough, leaves out most of the others before the join.
    """

    def pair(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        band = batch.column("band").to_numpy().view(np.uint64)
        return band, mix(band)

    known = _small_filter(shared.select("band"), pair)
    narrow = distinct.select("node", F.col("first_row").alias("row"), F.col("first_line").alias("line_no"), "bands")
    if known is None:
        rows = narrow.select("node", "row", "line_no", F.explode("bands").alias("band"))
    else:
        held = distinct.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bands = batch.column("bands")
                flat = bands.flatten().to_numpy().view(np.uint64)
                kept = np.flatnonzero(held.value.holds(flat, mix(flat)))
                owner = bands.value_parent_indices().take(pa.array(kept))
                columns = [batch.column(name).take(owner) for name in ("node", "row", "line_no")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(flat[kept].view(np.int64))], ["node", "row", "line_no", "band"])

        rows = narrow.mapInArrow(lean(run), "node long, row long, line_no int, band long")
    return rows.join(shared.select("band", "least"), "band")


def _split(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``row, line_no, line`` for all lines of the texts of a batch ``row, text``, ``SLICE`` of them at most at a time."""
    split = pc.split_pattern(batch.column("text"), "\n")
    counts = pc.fill_null(pc.list_value_length(split), 0).to_numpy()
    lines, owner = split.flatten(), np.repeat(np.arange(len(counts)), counts)
    numbers = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
    for low in range(0, len(owner), SLICE):
        some = slice(low, low + SLICE)
        columns = [batch.column("row").take(pa.array(owner[some])), pa.array(numbers[some]), lines[some].cast(pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["row", "line_no", "line"])


def _texts_of(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """``node, line`` for the nodes of ``needed(node, row, line_no)``, a stored table with one place per node.

    A filter of the needed places, if it is small enough, keeps most other lines from the join.
    """

    def pair(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        row = batch.column("row").to_numpy().view(np.uint64)
        line = batch.column("line_no").to_numpy().astype(np.uint64)
        return mix(row * np.uint64(LINES) + line), mix(row ^ mix(line + np.uint64(1)))

    known = _small_filter(needed.select("row", "line_no"), pair)
    if known is None:
        rows = lines_of(docs).select(F.col("__row").alias("row"), "line_no", "line")
    else:
        held = docs.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                for lines in _split(batch):
                    yield lines.filter(pa.array(held.value.holds(*pair(lines))))

        texts = docs.filter("doc_id is not null").select(F.col("__row").alias("row"), "text")
        bound_batches(docs.sparkSession)
        rows = texts.mapInArrow(lean(run), "row long, line_no int, line string")
    return rows.join(needed, ["row", "line_no"]).select("node", "line")


def _fully(batches: Iterator[pa.RecordBatch], size: int, least: float) -> Iterator[pa.RecordBatch]:
    """Links inside groups of ``band, unit, node, root, line`` that arrive in order of band and unit."""

    def emit(group: list[tuple]) -> list[tuple[int, int]]:
        """``group`` holds parts of columns: nodes, roots, lines, pictures and numbers of shingles."""
        nodes, roots, lines = ([value for part in group for value in part[n]] for n in range(3))
        if len(nodes) < 2:
            return []
        pictures, counts = (np.concatenate([part[n] for part in group]) for n in (3, 4))
        parent, exact, found = {}, Exact(size, least), []

        def find(node: int) -> int:
            while parent.setdefault(node, node) != node:
                parent[node] = parent[parent[node]]
                node = parent[node]
            return node

        # So many lines at a time are looked at against all others, as small groups are the rule.
        step = max(1, (1 << 14) // len(nodes))
        for low in range(0, len(nodes), step):
            some = slice(low, low + step)
            maybe = _may_be_similar(pictures[some, None], counts[some, None], pictures[None], counts[None], least)
            for at, other in zip(*np.nonzero(maybe)):
                at, other = low + int(at), int(other)
                if other < at and find(roots[at]) != find(roots[other]) and exact.similar(lines[at], lines[other]):
                    parent[find(roots[at])] = find(roots[other])
                    found.append((nodes[at], nodes[other]))
        return found

    key, group = None, []
    for batch in batches:
        found = []
        band, unit = (batch.column(name).to_numpy() for name in ("band", "unit"))
        nodes, roots, lines = (batch.column(name).to_pylist() for name in ("node", "root", "line"))
        pictures, counts = _pictures(batch.column("line"), size)
        cuts = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (unit[1:] != unit[:-1])]).tolist() if len(band) else []
        for low, high in zip(cuts, [*cuts[1:], len(band)]):
            if (band[low], unit[low]) != key:
                found += emit(group)
                key, group = (band[low], unit[low]), []
            group.append((nodes[low:high], roots[low:high], lines[low:high], pictures[low:high], counts[low:high]))
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])
    found = emit(group)
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _classes(
    docs: DataFrame,
    size: int = SHINGLE,
    least: float = SIMILAR,
    bands: int = BANDS,
    rows: int = ROWS,
    limit: int = GROUP_LIMIT,
) -> DataFrame:
    """``__row, line_no, keeper_row, keeper_line`` for every line of a class of several lines of numbered rows.

    A class holds the lines that similarity of at least ``least`` connects; its keeper is the line
    with the smallest row and line number. Blank lines and rows without a document number
    belong to no class.
    """
    lines, places = lines_of(docs), Places(docs)
    signed = materialize(_signed(lines, size, bands, rows))
    # One row per distinct line. Its number is made once and stored with it.
    # Its first place is one number, and its bands are single numbers, so that they aggregate by hash.
    distinct = materialize(
        signed.groupBy("h1", "h2")
        .agg(
            F.min(places.of()).alias("first"), F.count("*").alias("n"),
            *[F.first(f"b{at}").alias(f"b{at}") for at in range(bands)],
        )
        .select(
            "h1", "h2", "first", "n", F.array(*[f"b{at}" for at in range(bands)]).alias("bands"),
            places.row("first").alias("first_row"), places.line("first").alias("first_line"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    # Costs of tasks in Python do not show in their bytes, so the number of tasks is named.
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = materialize(_shared(distinct, tasks))
    members = materialize(_members(distinct, shared))
    needed = materialize(members.select("node", "row", "line_no").distinct())
    texts = materialize(_texts_of(docs, needed))
    pairs = members.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()
    filled = (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("line").alias("line_b")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("line").alias("line_a")), "a")
    )
    first_links = materialize(_verify(filled, size, least))
    # Lines of one label are connected. Which labels belong together is found at the end, at once.
    labels = materialize(first_links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")))
    # What is left are pairs without the band's smallest line, in bands of three lines or more. Bands of
    # the same lines, as most bands of close copies are, count once.
    placed = members.filter("node <> least").join(labels, "node", "left").select(
        "band", "node", F.coalesce("root", "node").alias("root")
    )
    apart = (
        placed.groupBy("band")
        .agg(
            F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"),
            F.bit_xor(F.xxhash64("node")).alias("one"), F.bit_xor(F.xxhash64("node", F.lit("second"))).alias("two"),
        )
        .filter("low <> high")
        .groupBy("n", "one", "two")
        .agg(F.min("band").alias("band"))
    )
    mixed = split_groups(placed.join(apart.select("band"), "band"), ["band"], "node", limit)
    laid = mixed.join(texts, "node").repartition(tasks, "band", "unit").sortWithinPartitions("band", "unit", "root", "node")
    more_links = materialize(
        laid.select("band", "unit", "node", "root", "line").mapInArrow(
            lean(lambda batches: _fully(batches, size, least)), "a long, b long"
        )
    )
    joined = materialize(components(first_links.unionByName(more_links)))
    rooted = distinct.join(joined, "node", "left").select("h1", "h2", "first", "n", "root", F.coalesce("root", "node").alias("class"))
    keepers = rooted.filter("root is not null").groupBy("class").agg(F.min("first").alias("keeper"))
    several = (
        rooted.filter("root is not null or n > 1")
        .join(keepers, "class", "left")
        .select("h1", "h2", F.coalesce("keeper", "first").alias("keeper"))
    )
    return signed.select("__row", "line_no", "h1", "h2").join(several, ["h1", "h2"]).select(
        "__row",
        "line_no",
        places.row("keeper").alias("keeper_row"),
        places.line("keeper").alias("keeper_line"),
    )


def _named(classes: DataFrame, plain: DataFrame) -> DataFrame:
    """Add ``keeper_doc``, the document number of the keeper's row."""
    if plain.filter(~F.col("__row").eqNullSafe(F.col("doc_id"))).isEmpty():
        return classes.withColumn("keeper_doc", F.col("keeper_row"))
    names = plain.select(F.col("__row").alias("keeper_row"), F.col("doc_id").alias("keeper_doc"))
    return classes.join(names, "keeper_row")


def repeated_lines(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, line_no, keeper_doc, keeper_line`` for every line of a class of several lines.

    The keeper of a class is the line with the smallest document and line number. Rows that share a
    number are compared like others. Rows without one belong to no class.
    """
    row = free_name(docs, "__row")
    plain = materialize(_plain(_numbered(docs, row), row))
    found = _named(_classes(plain, **settings), plain).join(plain.select("__row", "doc_id"), "__row")
    return found.select("doc_id", "line_no", "keeper_doc", "keeper_line")


def _going(classes: DataFrame) -> DataFrame:
    return classes.filter("__row <> keeper_row or line_no <> keeper_line")


def dropped_lines(docs: DataFrame, **settings) -> DataFrame:
    """``__row, dropped``: the sorted numbers of the lines that go, for numbered rows that lose any."""
    return _going(_classes(docs, **settings)).groupBy("__row").agg(F.array_sort(F.collect_set("line_no")).alias("dropped"))


def _line_count(text: Column) -> Column:
    return F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0))


def line_report(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, n_lines, n_dropped, dropped, keepers`` for every row of ``docs``; null text has no lines.

    ``keepers`` says for every dropped line, in the same order, which line of which document stays.
    """
    row = free_name(docs, "__row")
    plain = _plain(_numbered(docs, row), row)
    counts = plain.select(
        "__row", "doc_id", F.when(F.col("text").isNull(), 0).otherwise(_line_count(F.col("text"))).alias("n_lines")
    )
    goes = _named(_going(_classes(plain, **settings)), plain)
    kept = F.struct("line_no", "keeper_doc", "keeper_line")
    # The lines of one document.
    found = goes.groupBy("__row").agg(F.sort_array(F.collect_list(kept)).alias("keepers"))
    none = F.array().cast("array<struct<line_no: int, keeper_doc: bigint, keeper_line: int>>")
    joined = counts.join(found, "__row", "left").withColumn("keepers", F.coalesce("keepers", none))
    return joined.select(
        "doc_id", "n_lines", F.size("keepers").alias("n_dropped"), F.col("keepers.line_no").alias("dropped"), "keepers"
    )


def without_repeats(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text`` and ``n_chars`` set anew where present.

    A document that consisted of repeated lines only goes. A text that was null, empty or blank
    before stays as it is, and so do rows without a document number. All columns are kept.
    """
    row, of, gone = (free_name(docs, name) for name in ("__row", "__doc", "__dropped"))
    numbered = _numbered(docs, row)
    found = materialize(dropped_lines(_plain(numbered, row), **settings)).select(
        F.col("__row").alias(of), F.col("dropped").alias(gone)
    )
    # Documents that lose lines are as many as documents, so both sides are shuffled at every size.
    joined = numbered.join(found.hint("merge"), numbered[row] == found[of], "left").drop(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for at, dropped in enumerate(batch.column(gone).to_pylist()):
                if dropped:
                    out = set(dropped)
                    texts[at] = "\n".join(x for n, x in enumerate(texts[at].split("\n")) if n not in out)
            place = batch.schema.get_field_index("text")
            yield batch.set_column(place, "text", pa.array(texts, pa.string()))

    cut = joined.mapInArrow(lean(run), joined.schema)
    blank = F.col(gone).isNotNull() & (F.btrim("text", F.lit(WHITE + "\n")) == "")
    left = cut.filter(~F.coalesce(blank, F.lit(False)))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*docs.columns)
