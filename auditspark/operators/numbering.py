"""Positions and running sums per scan without handing a whole scan to one task.

A plain window over ``scan_id`` sorts all rows of a scan in a single task. Here the rows of a scan
are cut into consecutive blocks, blocks into larger blocks, and windows run inside each: over the
rows of a block, over the totals of the blocks, over the totals of the larger blocks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.operators.joins import attach
from auditspark.session import materialize

# Each level holds at most this many bits' worth of distinct numbers per block of the level above.
BLOCK_BITS = 16


def blocks_of(number: str, lead: tuple[str, ...] = ()) -> tuple[list[Column], list[list[str]]]:
    """Block columns of a whole-number column, and their levels for :func:`running_sum`.

    Numbers need not be dense: two levels leave the last window one row per 2**32 numbers.
    ``lead`` names columns that order rows ahead of the number, ``-`` for descending.
    """
    names = ["_block", "_superblock"]
    columns = [
        F.shiftright(number, BLOCK_BITS * (level + 1)).alias(name) for level, name in enumerate(names)
    ]
    return columns, [[*lead, name] for name in names]


def _bare(names: list[str]) -> list[str]:
    return [name.removeprefix("-") for name in names]


def _directions(names: list[str]) -> list[Column]:
    return [F.desc(name[1:]) if name.startswith("-") else F.asc(name) for name in names]


def running_sum(
    rows: DataFrame,
    by: list[str],
    levels: list[list[str]],
    order: list[str],
    weight: Column,
    out: str,
) -> DataFrame:
    """Add ``out``, the sum of ``weight`` over the rows of ``by`` that come before the row.

    ``levels`` names columns, finest first, whose order agrees with ``order`` and whose groups are
    small; ``-`` means descending. ``rows`` is read twice, so it should be a stored table.
    """
    if not levels:
        window = Window.partitionBy(*by).orderBy(*_directions(order))
        window = window.rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(out, F.coalesce(F.sum(weight).over(window), F.lit(0)))
    group = [*by, *_bare(levels[0])]
    coarser = [name for level in levels[1:] for name in _bare(level) if name not in group]
    total, base, inside = f"{out}_total", f"{out}_base", f"{out}_inside"
    totals = rows.groupBy(*group, *coarser).agg(F.sum(weight).alias(total))
    bases = running_sum(totals, by, levels[1:], levels[0], F.col(total), base)
    within = running_sum(rows, group, [], order, weight, inside)
    return (
        within.join(bases.select(*group, base), group)
        .withColumn(out, F.col(base) + F.col(inside))
        .drop(base, inside)
    )


def number_by_text(rows: DataFrame, by: str, text: str, out: str) -> DataFrame:
    """Number the rows of each ``by`` from 1 in code-point order of the unique column ``text``.

    Text has no blocks of its own, so Spark's range partitioning makes them. Range bounds come from
    a sample and may differ between two runs of a plan; therefore the ranged rows are written once,
    sorted, each with its place in its partition. What comes before a partition's share of a group is
    a sum over a small table with a row per group and partition.
    """
    ranged = materialize(
        rows.select(by, text)
        .repartitionByRange(by, text)
        .sortWithinPartitions(by, text)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_slice", F.spark_partition_id())
    )
    shares = ranged.groupBy(by, "_slice").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    known = materialize(shares.select(by, "_slice", "_first", before))
    numbered = attach(ranged, known, [by, "_slice"], [text], how="inner")
    return numbered.select(by, text, (F.col("_before") + F.col("_place") - F.col("_first") + 1).alias(out))
