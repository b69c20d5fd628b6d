"""Quality of documents by the votes of similar labelled documents.

Terms of a text are the shapes of its words (which kinds of characters follow each other, and
whether the word repeats the one before), pairs of neighbouring shapes, and the words themselves.
Term weights of a bounded sample of labelled texts are factored (truncated SVD); texts become short
vectors in that latent space. The sample's vectors are broadcast, every document is compared with
all of them by blocked products, and the nearest vote with their similarity.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm.common import LOWER, SpanHash, Texts, byte_class, map_slices, mix, slices
from auditspark.operators.joins import fits_broadcast

TERMS = 1 << 15
DIMENSIONS = 32
NEIGHBOURS = 15
SAMPLE_PER_CLASS = 1500
# All labelled texts together; how long one of them is does not matter.
SAMPLE_BYTES = 16 << 20
KIND_WEIGHT = np.array([1.0, 1.0, 0.5])

WORD_BYTES = ~byte_class(r"[\x20\x09-\x0D]")
# Letters and digits fall together, other characters stand for themselves, bytes beyond ASCII are left out.
SHAPES = np.arange(256, dtype=np.uint8)
SHAPES[65:91], SHAPES[97:123], SHAPES[48:58], SHAPES[128:] = 65, 97, 48, 0


@dataclass
class Model:
    """``basis`` maps terms to the latent space, ``vectors`` and ``labels`` are the voters."""

    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def _all_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The same for a column of any size, slice by slice."""
    batch, parts, size = pa.RecordBatch.from_arrays([column], ["text"]), [], 0
    for part in slices(iter([batch]), "text"):
        text, term, count, rows = _terms(part.column("text"))
        parts.append((text + size, term, count))
        size += rows
    text, term, count = (np.concatenate([part[n] for part in parts] or [np.zeros(0, np.int64)]) for n in range(3))
    return text, term, count, size


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sorted distinct (text, term) pairs with counts: text, term, count; and the number of texts."""
    texts = Texts(column)
    starts, ends = texts.runs(WORD_BYTES)
    low, high = texts.bounds(starts)
    owner = np.repeat(np.arange(texts.size), high - low)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, texts.size
    kinds = SHAPES[texts.data]
    changes = kinds != 0
    changes[1:] &= kinds[1:] != kinds[:-1]
    first = np.zeros(len(kinds), bool)
    first[starts] = True
    changes |= first & (kinds != 0)
    changes &= WORD_BYTES[texts.data]
    place = np.r_[0, np.cumsum(changes)]
    shape = SpanHash(kinds[changes]).of(place[starts], place[ends])
    word = SpanHash(LOWER[texts.data]).of(starts, ends)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    shape = mix(shape + again.astype(np.uint64))
    pair = mix(shape[:-1] * np.uint64(3) + shape[1:])[owner[:-1] == owner[1:]]
    pair_owner = owner[:-1][owner[:-1] == owner[1:]]
    third = np.uint64(TERMS // 4)
    term = np.concatenate([shape % third, third + pair % third, np.uint64(2) * third + word % (np.uint64(2) * third)])
    keys = np.concatenate([owner, pair_owner, owner]) * TERMS + term.astype(np.int64)
    keys, counts = np.unique(keys, return_counts=True)
    return keys // TERMS, keys % TERMS, counts, texts.size


def _weights(text: np.ndarray, term: np.ndarray, count: np.ndarray, size: int, idf: np.ndarray) -> np.ndarray:
    """Damped counts by inverse frequency; each kind of term has a fixed share of a text's length."""
    kind = np.minimum(term // (TERMS // 4), 2)
    weight = (1 + np.log(count)) * idf[term]
    norm = np.sqrt(np.bincount(text * 3 + kind, weight * weight, size * 3))
    return weight / np.maximum(norm[text * 3 + kind], 1e-12) * KIND_WEIGHT[kind]


def _project(text: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int, basis: np.ndarray) -> np.ndarray:
    out = np.zeros((size, basis.shape[1]), np.float32)
    if len(text):
        heads = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        out[text[heads]] = np.add.reduceat(basis[term] * weight[:, None].astype(np.float32), heads, axis=0)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1)


def fit(texts: pa.Array, labels: np.ndarray, prior: float, dimensions: int = DIMENSIONS) -> Model:
    """Factor the sample's term weights by randomised subspace iteration and keep its vectors."""
    text, term, count, size = _all_terms(texts)
    seen = np.bincount(term, minlength=TERMS)
    idf = np.where(seen > 0, np.log1p(size / np.maximum(seen, 1)), 0.0)
    weight = _weights(text, term, count, size, idf)
    by_term = np.argsort(term, kind="stable")

    def times(right: np.ndarray) -> np.ndarray:
        out = np.zeros((size, right.shape[1]))
        for column in range(right.shape[1]):
            out[:, column] = np.bincount(text, weight * right[term, column], size)
        return out

    def turned(left: np.ndarray) -> np.ndarray:
        out = np.zeros((TERMS, left.shape[1]))
        for column in range(left.shape[1]):
            out[:, column] = np.bincount(term[by_term], (weight * left[text, column])[by_term], TERMS)
        return out

    width = max(1, min(dimensions, size))
    space = np.linalg.qr(turned(np.random.default_rng(7).standard_normal((size, width))))[0]
    for _ in range(4):
        space = np.linalg.qr(turned(np.linalg.qr(times(space))[0]))[0]
    basis = space.astype(np.float32)
    return Model(idf, basis, _project(text, term, weight, size, basis), labels.astype(np.float32), prior)


def vote(model: Model, column: pa.Array, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Scores of texts; a text without any known term gets the share of label 1."""
    text, term, count, size = _terms(column)
    weight = _weights(text, term, count, size, model.idf)
    vectors = _project(text, term, weight, size, model.basis)
    nearest = min(neighbours, len(model.labels))
    scores = np.full(size, model.prior)
    if not nearest:
        return scores
    for low in range(0, size, 1024):
        near = vectors[low:low + 1024] @ model.vectors.T
        pick = np.argpartition(-near, nearest - 1, axis=1)[:, :nearest]
        voice = np.clip(np.take_along_axis(near, pick, axis=1), 0, None).astype(np.float64) ** 4
        total = voice.sum(axis=1)
        known = total > 0
        votes = (voice * model.labels[pick]).sum(axis=1)
        scores[low:low + 1024][known] = np.clip(votes[known] / total[known], 0, 1)
    return scores


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, learn, per_class: int, sample_bytes: int
) -> tuple[pa.Table, float]:
    """Texts and labels of some labelled rows, and the share of label 1.

    Rows come from the labelled rows that ``learn`` (a condition on ``doc_id``) admits, in the order
    of a hash of their number, short and long ones alike: of each class the first ``per_class``
    documents, as far as their texts hold no more than half of ``sample_bytes`` together. Numbers with
    contradictory labels or without a text are left out. The share is that of all admitted labels.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("_other"))
        .filter("label = _other")
        .select("doc_id", "label")
    )
    share = known.agg(F.coalesce(F.avg("label"), F.lit(0.5))).first()[0]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).filter("text is not null")
    # Spare numbers make up for labelled rows whose text is missing.
    order = F.xxhash64("doc_id", F.lit("sample"))
    chosen = known.filter("label = 0").orderBy(order, "doc_id").limit(4 * per_class).unionByName(
        known.filter("label = 1").orderBy(order, "doc_id").limit(4 * per_class)
    )
    side = F.broadcast(chosen) if fits_broadcast(chosen) else chosen
    sizes = (
        texts.select("doc_id", F.octet_length("text").cast("long").alias("size"))
        .join(side, "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.sum("size").alias("size"))
    )
    # No more than four times ``per_class`` rows of two numbers for each class.
    before = Window.partitionBy("label").orderBy(order, "doc_id")
    taken = (
        sizes.withColumn("place", F.row_number().over(before))
        .withColumn("sum", F.sum("size").over(before.rowsBetween(Window.unboundedPreceding, 0)))
        .filter((F.col("place") <= per_class) & (F.col("sum") <= sample_bytes // 2))
        .select("doc_id", "label")
    )
    listed = docs.sparkSession.createDataFrame(taken.collect(), "doc_id long, label int")
    rows = texts.join(F.broadcast(listed), "doc_id").select("doc_id", "label", "text")
    return rows.orderBy("label", order, "doc_id", "text").toArrow().combine_chunks(), float(share)


def learned(
    docs: DataFrame, labels: DataFrame, learn, per_class: int = SAMPLE_PER_CLASS, sample_bytes: int = SAMPLE_BYTES
) -> Model:
    """The model of the labelled rows that ``learn`` admits."""
    rows, share = labelled_sample(docs, labels, "quality", learn, per_class, sample_bytes)
    texts = rows.column("text").combine_chunks()
    return fit(texts, rows.column("label").to_numpy(), share)


def scores(docs: DataFrame, model: Model, neighbours: int = NEIGHBOURS) -> DataFrame:
    """``doc_id, score`` for every row of ``docs``, from its whole text and nothing else.

    Null, empty and blank texts get the share of label 1 among the labels learned from. Repeated
    rows stay repeated; rows without a number are scored; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = vote(shared.value, batch.column("text"), neighbours)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values)], ["doc_id", "score"])

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, "doc_id long, score double")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5, neighbours: int = NEIGHBOURS) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns; nothing moves."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(vote(shared.value, batch.column("text"), neighbours) >= threshold))

    return map_slices(docs, run, docs.schema)
