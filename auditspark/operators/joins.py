"""Joins of a large table with one row per key, and explodes of computed arrays."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 32 << 20
SALTS = 64


def fits_broadcast(frame: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True when ``frame`` is within the row and byte bounds; counting stops one row past them."""
    size = F.sum(F.octet_length(F.to_json(F.struct(*frame.columns))))
    row = frame.limit(max_rows + 1).agg(F.count("*").alias("n"), size.alias("size")).first()
    return row["n"] <= max_rows and (row["size"] or 0) <= BROADCAST_BYTES


def attach(
    large: DataFrame,
    small: DataFrame,
    on: list[str],
    spread: list[str],
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``small``, a stored or constant table, to every row of ``large`` by the columns ``on``.

    Within the bounds the small side is broadcast and the large side does not move. Beyond them both
    sides are shuffled by ``on`` and a salt: the rows of one key are spread over ``salts`` tasks by
    the columns ``spread``, and the small side is repeated once per salt.
    """
    if fits_broadcast(small, max_rows):
        return large.join(F.broadcast(small), on, how)
    salted = large.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)))
    every_salt = F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))
    repeated = small.select("*", F.explode(every_salt).alias("_salt"))
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")


def positions(
    frame: DataFrame, keep: list[str], array: Column | str, at: str = "pos", item: str = "item"
) -> DataFrame:
    """``keep`` with one row per element of ``array`` and its position.

    A plain explode makes the optimizer test the array's size below the projections that compute
    it, which would compute it twice. The outer form with a filter on the position does not.
    """
    exploded = frame.select(*keep, F.posexplode_outer(array).alias(at, item))
    return exploded.filter(F.col(at).isNotNull())

