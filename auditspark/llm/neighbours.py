"""Nearest vectors by cosine through an inverted multi-index.

Unit vectors are cut in two halves, each half has its own codebook, and a vector lies in the cell of
its two nearest centroids. A query walks over the centroid pairs in order of their summed distance,
with a heap, until the cells it has passed hold a share of all vectors. The share is measured on the
sample that the codebooks come from: it is what the walk needs there to meet ``recall`` of the true
neighbours, so well separated data are searched narrowly and shapeless data widely. All vectors of
the cells passed are compared exactly.

Cells are packed into blocks of bounded size, large cells are cut into several. A task holds one
block and lets the queries that reach it stream by; no side is gathered or broadcast.
"""

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditspark.session import materialize

CENTROIDS = 32
SAMPLE = 8192
PROBES = 256
RECALL = 0.97
MIN_BLOCK, MAX_BLOCK, BLOCKS = 1024, 65_536, 48
QUERY_ROWS = 256


@dataclass
class Codebooks:
    """Centroids of the two halves, and the share of all vectors that a walk has to meet."""

    halves: tuple[np.ndarray, np.ndarray]
    share: float

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances of both halves to the centroids of their codebook."""
        cut = self.halves[0].shape[1]
        parts = unit[:, :cut], unit[:, cut:]
        return tuple(
            np.maximum((part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)[None, :], 0)
            for part, book in zip(parts, self.halves)
        )

    def cells(self, unit: np.ndarray) -> np.ndarray:
        one, two = self.distances(unit)
        return one.argmin(1) * len(self.halves[1]) + two.argmin(1)


def _units(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt(np.einsum("ij,ij->i", vectors, vectors))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    """List column of equally long rows as doubles, each row scaled to components below 1.

    The scale is a power of two, so cosines stay what they are to the last bit, and no product
    of extreme components overflows or vanishes.
    """
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    if not flat.size:
        return flat
    _, exponents = np.frexp(np.abs(flat).max(axis=1))
    return np.ldexp(flat, -exponents[:, None])


def _means(points: np.ndarray, number: int, rounds: int = 12) -> np.ndarray:
    """k-means from evenly spaced points; an empty cluster keeps its centroid."""
    number = min(number, len(points))
    centres = points[np.linspace(0, len(points) - 1, number).astype(int)].copy()
    for _ in range(rounds):
        nearest = ((centres**2).sum(1)[None, :] - 2 * points @ centres.T).argmin(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=number)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def walk(one: np.ndarray, two: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells in order of summed distance until they hold ``wanted`` vectors or none is left."""
    first, second = np.argsort(one, kind="stable").tolist(), np.argsort(two, kind="stable").tolist()
    one, two, width = one[first].tolist(), two[second].tolist(), len(two)
    sizes = counts.tolist()
    heap, passed, held = [(one[0] + two[0], 0, 0)], [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = first[i] * width + second[j]
        if sizes[cell]:
            passed.append(cell)
            held += sizes[cell]
        # Every pair has one predecessor, so it enters the heap once.
        if j + 1 < width:
            heapq.heappush(heap, (one[i] + two[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(one):
            heapq.heappush(heap, (one[i + 1] + two[0], i + 1, 0))
    return passed


def fit(sample: np.ndarray, nearest: int, recall: float = RECALL, centroids: int = CENTROIDS) -> Codebooks:
    """Codebooks of a sample, and the share of it that walks must meet to find ``recall`` of the neighbours."""
    unit = _units(sample)
    cut = max(1, unit.shape[1] // 2)
    books = Codebooks((_means(unit[:, :cut], centroids), _means(unit[:, cut:], centroids)), 1.0)
    cells = books.cells(unit)
    counts = np.bincount(cells, minlength=len(books.halves[0]) * len(books.halves[1]))
    probes = unit[:PROBES]
    near = probes @ unit.T
    near[np.arange(len(probes)), np.arange(len(probes))] = -np.inf
    found = min(nearest, len(unit) - 1)
    if found < 1:
        return books
    true = np.argsort(-near, axis=1)[:, :found]
    needs = []
    for at, (one, two) in enumerate(zip(*books.distances(probes))):
        order = walk(one, two, counts, len(unit))
        before = dict(zip(order, np.cumsum(counts[order]) - counts[order]))
        needs += [before[cell] + 1 for cell in cells[true[at]].tolist()]
    books.share = float(np.quantile(needs, recall)) / len(unit)
    return books


def valid(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part.

    Left out are rows without a number, and vectors that are null, empty, zero, or hold null or
    non-finite components.
    """
    kind = dict(vectors.dtypes)["embedding"]
    wanted = kind if kind in ("array<float>", "array<double>") else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(wanted).alias("embedding"))
    finite = F.forall("embedding", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    some = F.exists("embedding", lambda x: x != 0)
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite & some, F.lit(False)))


def _placed(good: DataFrame, books: Codebooks) -> DataFrame:
    shared = good.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = shared.value.cells(_units(_matrix(batch.column("embedding"))))
                yield batch.append_column("cell", pa.array(cells.astype(np.int32)))

    return good.mapInArrow(run, f"vec_id long, embedding {dict(good.dtypes)['embedding']}, cell int")


def _layout(counts: np.ndarray, rows: int) -> list[tuple[int, int, int]]:
    """``cell, first block, blocks``: small cells share a block, a large one has several."""
    layout, block, held = [], 0, 0
    for cell in np.flatnonzero(counts).tolist():
        if held and held + counts[cell] > rows:
            block, held = block + 1, 0
        parts = -(-int(counts[cell]) // rows)
        layout.append((cell, block, parts))
        if parts > 1:
            block, held = block + parts, 0
        else:
            held += int(counts[cell])
    return layout


def _probes(queries: DataFrame, books: Codebooks, counts: np.ndarray, layout: list, wanted: int) -> DataFrame:
    """Each query once per block that it reaches, with the cells it passed there."""
    plan = {cell: range(block, block + parts) for cell, block, parts in layout}
    shared = queries.sparkSession.sparkContext.broadcast((books, counts, plan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, counts, plan = shared.value
        for whole in batches:
            for low in range(0, whole.num_rows, QUERY_ROWS):
                batch = whole.slice(low, QUERY_ROWS)
                row, block, cells = [], [], []
                for at, (one, two) in enumerate(zip(*books.distances(_units(_matrix(batch.column("embedding")))))):
                    reached: dict[int, list] = {}
                    for cell in walk(one, two, counts, wanted):
                        for number in plan[cell]:
                            reached.setdefault(number, []).append(cell)
                    for number, passed in reached.items():
                        row.append(at)
                        block.append(number)
                        cells.append(passed)
                picked = batch.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block, pa.int32()), picked.column("vec_id"), picked.column("embedding"), pa.array(cells, pa.list_(pa.int32()))],
                    ["block", "vec_id", "embedding", "cells"],
                )

    kind = dict(queries.dtypes)["embedding"]
    return queries.select("vec_id", "embedding").mapInArrow(run, f"block int, vec_id long, embedding {kind}, cells array<int>")


def _best(queries: np.ndarray, names: np.ndarray, cells: list, block: tuple, nearest: int) -> tuple:
    """Rows ``query, vector, score`` of the nearest of a block for some queries."""
    ids, vectors, units, cell = block
    near = _units(queries) @ units.T
    allowed = np.zeros((len(names), int(cell.max()) + 1), bool)
    for at, passed in enumerate(cells):
        inside = np.array([number for number in passed if number < allowed.shape[1]], np.int64)
        allowed[at, inside] = True
    near[~allowed[:, cell] | (names[:, None] == ids[None, :])] = -np.inf
    found = min(nearest, len(ids))
    edge = np.partition(near, len(ids) - found, axis=1)[:, len(ids) - found]
    at, place = np.nonzero((near >= edge[:, None] - 1e-9) & (near > -np.inf))
    left, right = queries[at], vectors[place]
    dot = np.einsum("ij,ij->i", left, right)
    lengths = np.sqrt(np.einsum("ij,ij->i", left, left)) * np.sqrt(np.einsum("ij,ij->i", right, right))
    score = dot / lengths
    order = np.lexsort((ids[place], -score, at))
    at, place, score = at[order], place[order], score[order]
    heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, np.int64)
    rank = np.arange(len(at)) - np.repeat(heads, np.diff(np.r_[heads, len(at)]))
    kept = rank < nearest
    return names[at[kept]], ids[place[kept]], score[kept]


def _compare(batches: Iterator[pa.RecordBatch], nearest: int) -> Iterator[pa.RecordBatch]:
    """Rows in order of block, a block's vectors before its queries."""
    current, held, block = None, [], None
    for whole in batches:
        numbers = whole.column("block").to_numpy()
        kinds = whole.column("is_query").to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, (numbers[1:] != numbers[:-1]) | (kinds[1:] != kinds[:-1])])
        for low, high in zip(cuts.tolist(), np.r_[cuts[1:], len(numbers)].tolist()):
            if numbers[low] != current:
                current, held, block = numbers[low], [], None
            part = whole.slice(low, high - low)
            if not kinds[low]:
                held.append(part)
                continue
            if block is None and held:
                vectors = np.concatenate([_matrix(rows.column("embedding")) for rows in held])
                ids, cell = (np.concatenate([rows.column(name).to_numpy() for rows in held]) for name in ("vec_id", "cell"))
                block, held = (ids, vectors, _units(vectors), cell), []
            if block is None:
                continue
            for at in range(0, part.num_rows, QUERY_ROWS):
                rows = part.slice(at, QUERY_ROWS)
                names = rows.column("vec_id").to_numpy()
                found = _best(_matrix(rows.column("embedding")), names, rows.column("cells").to_pylist(), block, nearest)
                yield pa.RecordBatch.from_arrays([pa.array(values) for values in found], ["query_id", "vec_id", "score"])


def nearest_neighbours(
    vectors: DataFrame, is_query, nearest: int = 5, recall: float = RECALL, sample: int = SAMPLE
) -> DataFrame:
    """``query_id, rank, vec_id, score`` for every row that ``is_query`` (a condition) admits.

    Candidates are all rows with another number and as many components; vectors of several lengths
    are searched length by length. ``score`` is the cosine of the original vectors in
    double precision; ties go to the smaller number. A query has fewer than ``nearest`` rows only if
    there are fewer candidates. See :func:`valid` for rows that take no part. A number that occurs
    in several rows gives several candidates, and as a query a single list over all its rows.
    Other columns are not looked at; an empty table gives an empty result.
    """
    good = valid(vectors)
    # One row per length.
    lengths = [row["length"] for row in good.select(F.size("embedding").alias("length")).distinct().collect()]
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [
        _nearest(good.filter(F.size("embedding") == length) if len(lengths) > 1 else good, is_query, nearest, recall, sample)
        for length in sorted(lengths)
    ]
    every = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= nearest).select(
        "query_id", "rank", "vec_id", "score"
    )


def _nearest(good: DataFrame, is_query, nearest: int, recall: float, sample: int) -> DataFrame:
    """``query_id, vec_id, score``: of every block the nearest of each query, for vectors of one length."""
    spark = good.sparkSession
    chosen = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toArrow().combine_chunks()
    books = fit(_matrix(chosen.column("embedding").combine_chunks()), nearest, recall)
    index = materialize(_placed(good, books))
    counts = np.zeros(len(books.halves[0]) * len(books.halves[1]), np.int64)
    for row in index.groupBy("cell").count().collect():
        counts[row["cell"]] = row["count"]
    total = int(counts.sum())
    layout = _layout(counts, min(max(total // BLOCKS, MIN_BLOCK), MAX_BLOCK))
    places = spark.createDataFrame(layout, "cell int, first int, parts int")
    own = F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("parts").cast("long")).cast("int")
    queries = index.filter(is_query)
    # The share decides how far walks go; a few cells more keep them above the number asked for.
    wanted = max(int(np.ceil(books.share * total)), 4 * nearest + 4)
    probes = _probes(queries, books, counts, layout, wanted)
    kept = index.join(F.broadcast(places), "cell").select(
        own.alias("block"), F.lit(False).alias("is_query"), "vec_id", "embedding", "cell", F.lit(None).cast("array<int>").alias("cells")
    )
    asked = probes.select("block", F.lit(True).alias("is_query"), "vec_id", "embedding", F.lit(0).alias("cell"), "cells")
    laid = kept.unionByName(asked).repartition("block").sortWithinPartitions("block", "is_query")
    return laid.mapInArrow(lambda batches: _compare(batches, nearest), "query_id long, vec_id long, score double")
