"""Blocked Bloom filters in shards of bounded size.

A key is a well mixed 64-bit hash. It sets four bits of one 64-bit word, so a look-up reads memory
once. A filter is a set of shards, each with as many words as a power of two; tasks build chunks of
shards from the keys that fall into them, and only the finished chunks go to the driver.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import lean

# Sixteen to thirty-two bits of a filter for every key.
KEYS_PER_WORD = 4
MAX_BYTES = 64 << 20
CHUNK_WORDS = 1 << 11


def words_for(number: int, max_bytes: int = MAX_BYTES) -> int:
    """How many words the shard of ``number`` keys gets: a power of two, never above ``max_bytes``."""
    wanted = 1 << max(0, (-(-number // KEYS_PER_WORD) - 1).bit_length())
    return min(wanted, 1 << ((max_bytes // 8).bit_length() - 1))


def bits_of(keys: np.ndarray) -> np.ndarray:
    """The bits that each key sets in its word."""
    one = np.uint64(1)
    out = np.zeros(len(keys), np.uint64)
    for shift in (40, 46, 52, 58):
        out |= one << ((keys >> np.uint64(shift)) & np.uint64(63))
    return out


def holds(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the shard ``words`` holds, or seems to hold, each key."""
    bits = bits_of(keys)
    return words[(keys & np.uint64(len(words) - 1)).view(np.int64)] & bits == bits


def build(keys: DataFrame, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """Shards over a table ``shard int, key long``; ``sizes`` says how many words each shard has.

    Keys of shards without a size are left out. The caller bounds the sum of the sizes.
    """
    if not sizes:
        return {}
    numbers = np.array(sorted(sizes), np.int64)
    masks = np.array([sizes[number] - 1 for number in numbers.tolist()], np.uint64)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = batch.column("shard").to_numpy().astype(np.int64)
            key = batch.column("key").to_numpy().view(np.uint64)
            place = np.minimum(np.searchsorted(numbers, shard), len(numbers) - 1)
            known = numbers[place] == shard
            shard, key, place = shard[known], key[known], place[known]
            word = (key & masks[place]).view(np.int64)
            columns = [pa.array(shard), pa.array(word // CHUNK_WORDS), pa.array(key.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["shard", "chunk", "key"])

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = None, None

        def row() -> pa.RecordBatch:
            columns = [pa.array([held[0]], pa.int64()), pa.array([held[1]], pa.int64()), pa.array([words.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["shard", "chunk", "bits"])

        for batch in batches:
            shard, chunk = (batch.column(name).to_numpy() for name in ("shard", "chunk"))
            key = batch.column("key").to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.r_[True, (np.diff(shard) != 0) | (np.diff(chunk) != 0)]) if len(key) else []
            for low, high in zip(cuts, np.r_[cuts[1:], len(key)].astype(int)):
                if held != (shard[low], chunk[low]):
                    if held is not None:
                        yield row()
                    held = (shard[low], chunk[low])
                    words = np.zeros(min(CHUNK_WORDS, sizes[int(held[0])]), np.uint64)
                some = key[low:high]
                at = (some & np.uint64(sizes[int(held[0])] - 1)).view(np.int64) % CHUNK_WORDS
                np.bitwise_or.at(words, at, bits_of(some))
        if held is not None:
            yield row()

    chunks = (
        keys.select(F.col("shard").cast("int").alias("shard"), "key")
        .mapInArrow(placed, "shard long, chunk long, key long")
        .repartition("shard", "chunk")
        .sortWithinPartitions("shard", "chunk")
        .mapInArrow(lean(set_bits), "shard long, chunk long, bits binary")
        .toArrow()
    )
    out = {number: np.zeros(size, np.uint64) for number, size in sizes.items()}
    columns = (chunks.column(name) for name in ("shard", "chunk", "bits"))
    for shard, chunk, bits in zip(*columns):
        part = np.frombuffer(bits.as_buffer(), np.uint64)
        low = chunk.as_py() * CHUNK_WORDS
        out[shard.as_py()][low:low + len(part)] = part
    return out
