"""Token sequences in training order, as records of fixed size.

Documents are tokenised once into a stored table; each ends with an end mark and is cut into
sequences of a fixed number of tokens, the last one filled up. A sequence's index is its place in
that table, its slot a keyed permutation of the index: a Feistel network over the next even number of
bits, walked until the value is below the number of sequences. Slots are a bijection, so every
sequence has exactly one place and no table of places is needed. Records are then moved once, to the
shard that holds their slot, and lie there in order of slot with a fixed stride: record ``k`` of the
whole order is found by arithmetic, and reading can stop and go on at any slot.
"""

import base64
import os
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import bound_batches, mix, slices
from auditspark.session import materialize

SEQUENCE_TOKENS = 512
SHARD_RECORDS = 16_384
ROUNDS = 6
RANKS = "byte_bpe_50k.tiktoken"
END_MARK = 50_256
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_ranks() -> str:
    """The place of the public vocabulary: ``TOKENIZER_DIR``, else the installed tokenizer folder."""
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), RANKS)


@cache
def encoder(path: str):
    """The byte-pair encoder of a file of ranks; it is kept in the worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """Slots of indices below ``size``: a bijection of that range that depends on the key."""
    bits = max(2, (size - 1).bit_length())
    half = np.uint64((bits + 1) // 2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    start = np.uint64(key * 0x9E3779B97F4A7C15 % (1 << 64))
    keys = mix(np.arange(ROUNDS, dtype=np.uint64) + start)

    def once(values: np.ndarray) -> np.ndarray:
        left, right = values >> half, values & mask
        for round_key in keys:
            left, right = right, left ^ (mix(right + round_key) & mask)
        return (left << half) | right

    slots = once(index.astype(np.uint64))
    outside = np.flatnonzero(slots >= np.uint64(size))
    while len(outside):
        slots[outside] = once(slots[outside])
        outside = outside[slots[outside] >= np.uint64(size)]
    return slots.astype(np.int64)


def tokenised(docs: DataFrame, ranks: str, length: int) -> DataFrame:
    """Stored rows ``task, start, doc_id, n_sequences, tokens``; ``start`` counts sequences in the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, task, start = encoder(ranks), TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            tokens, counts, starts, ids = [], [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                row = np.array([*encoding.encode_ordinary(text), END_MARK], "<u2")
                tokens.append(row.tobytes())
                counts.append(-(-len(row) // length))
                starts.append(start)
                ids.append(doc)
                start += counts[-1]
            columns = [pa.array([task] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(ids, pa.int64())]
            columns += [pa.array(counts, pa.int32()), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["task", "start", "doc_id", "n_sequences", "tokens"])

    bound_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(source.mapInArrow(run, "task int, start long, doc_id long, n_sequences int, tokens binary"))


def training_order(
    docs: DataFrame,
    key: int = 1,
    ranks: str | None = None,
    length: int = SEQUENCE_TOKENS,
    shard_records: int = SHARD_RECORDS,
) -> DataFrame:
    """``slot, shard, position, doc_id, part, n_tokens, record`` in order of slot, a partition per shard.

    ``record`` has ``length`` 16-bit token numbers (little endian), filled up with end marks;
    ``part`` numbers the sequences of a document from 0 and ``n_tokens`` counts its own tokens, the
    end mark included. Null and empty texts have no sequence. Repeated rows give sequences each, a
    row without a number too. Other columns are ignored; an empty table gives an empty result.
    The table of tokens is written once, so slots stay the same whatever is computed again.
    """
    stored = tokenised(docs, ranks or default_ranks(), length)
    spark = docs.sparkSession
    # One row per writing task; their number is that of the scan's partitions.
    tasks = stored.groupBy("task").agg(F.sum("n_sequences").alias("n")).orderBy("task").collect()
    total = sum(row["n"] for row in tasks)
    bases, base = [], 0
    for row in tasks:
        bases.append((row["task"], base))
        base += row["n"]
    placed = stored.join(F.broadcast(spark.createDataFrame(bases, "task int, base long")), "task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                counts = batch.column("n_sequences").to_numpy()
                starts = batch.column("start").to_numpy() + batch.column("base").to_numpy()
                part = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
                slot = permuted(np.repeat(starts, counts) + part, total, key)
                records = np.full((len(part), length), END_MARK, "<u2")
                used = np.zeros(len(part), np.int32)
                at = 0
                for tokens, count in zip(batch.column("tokens").to_pylist(), counts.tolist()):
                    row = np.frombuffer(tokens, "<u2")
                    records[at:at + count].reshape(-1)[:len(row)] = row
                    used[at:at + count] = np.minimum(length, len(row) - length * np.arange(count))
                    at += count
                offsets = np.arange(len(part) + 1, dtype=np.int32) * (2 * length)
                payload = pa.BinaryArray.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(records.tobytes())])
                docs_of = batch.column("doc_id").take(pa.array(np.repeat(np.arange(batch.num_rows), counts)))
                columns = [pa.array(slot), docs_of, pa.array(part.astype(np.int32)), pa.array(used), payload]
                yield pa.RecordBatch.from_arrays(columns, ["slot", "doc_id", "part", "n_tokens", "record"])

    rows = placed.select("start", "base", "doc_id", "n_sequences", "tokens").mapInArrow(
        run, "slot long, doc_id long, part int, n_tokens int, record binary"
    )
    shard = F.floor(F.col("slot") / shard_records).cast("int")
    shards = max(1, -(-total // shard_records))
    return (
        rows.withColumn("shard", shard)
        .repartitionById(shards, F.col("shard"))
        .sortWithinPartitions("slot")
        .select("slot", "shard", (F.col("slot") % shard_records).cast("int").alias("position"), "doc_id", "part", "n_tokens", "record")
    )


def shard_name(shard: int) -> str:
    return f"shard-{shard:06d}.bin"


def write_shards(order: DataFrame, folder: str) -> DataFrame:
    """Write a file of records per shard to a folder (a path or URI that all tasks reach).

    Returns ``shard, first_slot, n_records, bytes``. A task writes to a name of its own and moves
    the whole file into place, so a task that runs again leaves the same file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        system.create_dir(root)
        out, current, own, facts = None, None, None, []

        def close() -> None:
            if out is not None:
                out.close()
                system.move(own, f"{root}/{shard_name(current)}")

        for batch in batches:
            columns = (batch.column(name).to_pylist() for name in ("shard", "slot", "record"))
            for shard, slot, record in zip(*columns):
                if shard != current:
                    close()
                    current, own = shard, f"{root}/.{shard_name(shard)}.{uuid.uuid4().hex}"
                    out = system.open_output_stream(own)
                    facts.append([shard, slot, 0, 0])
                out.write(record)
                facts[-1][2] += 1
                facts[-1][3] += len(record)
        close()
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())
        columns = [pa.array([fact[n] for fact in facts], kind) for n, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "first_slot", "n_records", "bytes"])

    return order.select("shard", "slot", "record").mapInArrow(run, "shard int, first_slot long, n_records long, bytes long")


def read_slots(folder: str, first: int, number: int, length: int = SEQUENCE_TOKENS, shard_records: int = SHARD_RECORDS) -> np.ndarray:
    """Records ``first`` to ``first + number - 1`` of the training order, as rows of token numbers."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    rows = []
    while number > 0:
        shard, position = divmod(first, shard_records)
        take = min(number, shard_records - position)
        with system.open_input_file(f"{root}/{shard_name(shard)}") as file:
            data = file.read_at(take * 2 * length, position * 2 * length)
        rows.append(np.frombuffer(data, "<u2").reshape(-1, length))
        first, number = first + take, number - take
    return np.concatenate(rows) if rows else np.zeros((0, length), "<u2")
