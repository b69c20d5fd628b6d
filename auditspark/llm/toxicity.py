"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over hashed words, word
beginnings and word ends; the document's score is the noisy-or of its sentences. Weights are learned
from document labels alone: in a toxic document the blame goes to the sentences that score highest,
in a clean one every sentence must score low. Only features that clearly go with label 1 get a weight. The sentence scores then locate the offending parts.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import SpanHash, Texts, byte_class, list_array, map_slices, slices
from auditspark.llm.quality import SAMPLE_BYTES, labelled_sample

BUCKETS = 1 << 18
EDGES = (4, 5, 6)
SAMPLE_PER_CLASS = 1200
ROUNDS = 100
WORD_BYTES = byte_class(r"[0-9a-z\x80-\xFF]")
STOPS = byte_class(r"[.!?\n]")


@dataclass
class Model:
    """A weight per feature bucket and a base score per sentence."""

    weights: np.ndarray
    base: float


class Sentences:
    """Sentences of some texts, with the features of their words.

    ``low``/``high`` are the sentences of each text, ``of_word`` the sentence of each word.
    """

    def __init__(self, column: pa.Array):
        self.texts = Texts(column, lower=True)
        self.starts, self.ends = self.texts.runs(~STOPS)
        self.low, self.high = self.texts.bounds(self.starts)
        begin, end = self.texts.runs(WORD_BYTES)
        hashes = SpanHash(self.texts.data)
        word, sentence = hashes.of(begin, end), np.searchsorted(self.starts, begin, "right") - 1
        # A word that only repeats the one before it says nothing new.
        fresh = np.ones(len(word), bool)
        fresh[1:] = (word[1:] != word[:-1]) | (sentence[1:] != sentence[:-1])
        begin, end, self.of_word = begin[fresh], end[fresh], sentence[fresh]
        kinds = [word[fresh]]
        for width in EDGES:
            kinds.append(hashes.of(begin, np.minimum(begin + width, end)) + np.uint64(width << 20))
            kinds.append(hashes.of(np.maximum(end - width, begin), end) + np.uint64(width << 28))
        self.features = [(kind % np.uint64(BUCKETS)).astype(np.int32) for kind in kinds]

    @classmethod
    def joined(cls, column: pa.Array) -> "Sentences":
        """Sentences of a column of any size, made slice by slice; their places are not kept."""
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        parts = [cls(part.column("text")) for part in slices(iter([batch]), "text")]
        whole = cls(pa.array([], pa.string()))
        shifts = np.cumsum([0, *(len(part.starts) for part in parts)])
        for name in ("low", "high", "of_word"):
            setattr(whole, name, np.concatenate([getattr(whole, name), *(getattr(part, name) + at for part, at in zip(parts, shifts))]))
        whole.starts = np.zeros(int(shifts[-1]), np.int8)
        whole.features = [np.concatenate([one, *(part.features[n] for part in parts)]) for n, one in enumerate(whole.features)]
        return whole

    def logits(self, model: Model) -> np.ndarray:
        by_word = np.zeros(len(self.of_word))
        for feature in self.features:
            by_word += model.weights[feature]
        return np.bincount(self.of_word, by_word, len(self.starts)) + model.base


def _softplus(values: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, values)


def _bag(sentences: Sentences, each: np.ndarray) -> np.ndarray:
    totals = np.r_[0, np.cumsum(each)]
    return totals[sentences.high] - totals[sentences.low]


def _marked(sentences: Sentences, owner: np.ndarray, labels: np.ndarray, evidence: float, ratio: float) -> np.ndarray:
    """Features whose presence speaks for label 1: a likelihood ratio beyond chance, and frequent odds.

    Only whether a feature is in a text counts. Chance would let rare features of a few toxic texts
    in, and the odds keep out ordinary words, which long texts have more of.
    """
    positive, present = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for feature in sentences.features:
        keys = np.unique(owner[sentences.of_word] * BUCKETS + feature)
        present += np.bincount(keys % BUCKETS, minlength=BUCKETS)
        positive += np.bincount(keys % BUCKETS, labels[keys // BUCKETS], BUCKETS)
    size, toxic = len(labels), float((labels == 1).sum())
    clean, negative = size - toxic, present - positive

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0)

    tested = 2 * (
        part(positive, present * toxic / size)
        + part(negative, present * clean / size)
        + part(toxic - positive, (size - present) * toxic / size)
        + part(clean - negative, (size - present) * clean / size)
    )
    odds = (positive + 0.5) / (toxic + 1) > ratio * (negative + 0.5) / (clean + 1)
    return (tested >= evidence) & odds


def fit(
    texts: pa.Array,
    labels: np.ndarray,
    rounds: int = ROUNDS,
    rate: float = 0.3,
    decay: float = 1e-3,
    evidence: float = 20.0,
    ratio: float = 5.0,
    base: float = -11.0,
) -> Model:
    """Minimise the log loss of the noisy-or by full steps with a rate per weight."""
    model = Model(np.zeros(BUCKETS), base)
    sentences = Sentences.joined(texts)
    if not len(labels):
        return Model(model.weights.astype(np.float32), base)
    owner = np.repeat(np.arange(len(labels)), sentences.high - sentences.low)
    marked = _marked(sentences, owner, labels, evidence, ratio)
    useful = np.zeros(len(sentences.of_word), bool)
    for feature in sentences.features:
        useful |= marked[feature]
    sentences.of_word = sentences.of_word[useful]
    sentences.features = [feature[useful] for feature in sentences.features]
    steps, base_step = np.full(BUCKETS, 1e-8), 1e-8
    share = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    for _ in range(rounds):
        logits = sentences.logits(model)
        each = 1 / (1 + np.exp(-np.clip(logits, -50, 50)))
        clean = np.exp(-_bag(sentences, _softplus(logits)))
        push = np.where(labels == 1, -clean / np.maximum(1 - clean, 1e-12), 1.0) * share
        slope = each * push[owner] * len(labels)
        by_word = slope[sentences.of_word]
        gradient = decay * model.weights
        for feature in sentences.features:
            gradient = gradient + np.bincount(feature, by_word, BUCKETS)
        gradient[~marked] = 0
        steps += gradient * gradient
        model.weights = model.weights - rate * gradient / np.sqrt(steps)
        total = float(slope.sum())
        base_step += total * total
        model.base -= 0.1 * total / base_step**0.5
    return Model(model.weights.astype(np.float32), float(model.base))


def learned(
    docs: DataFrame, labels: DataFrame, learn, per_class: int = SAMPLE_PER_CLASS, sample_bytes: int = SAMPLE_BYTES
) -> Model:
    """The model of at most ``per_class`` labelled rows of each class that ``learn`` admits."""
    rows, _ = labelled_sample(docs, labels, "toxic", learn, per_class, sample_bytes)
    return fit(rows.column("text").combine_chunks(), rows.column("label").to_numpy())


def judged(column: pa.Array, model: Model, offends: float) -> tuple[np.ndarray, pa.Array]:
    """Score per text, and its sentences that score at least ``offends``, worst bounds in characters."""
    sentences = Sentences(column)
    logits = sentences.logits(model)
    score = -np.expm1(-_bag(sentences, _softplus(logits)))
    each = 1 / (1 + np.exp(-np.clip(logits, -50, 50)))
    bad = np.flatnonzero(each >= offends)
    owner = np.repeat(np.arange(sentences.texts.size), sentences.high - sentences.low)[bad]
    chars = np.r_[0, np.cumsum((sentences.texts.data & 0xC0) != 0x80)]
    shift = chars[sentences.texts.starts[owner]]
    spans = pa.StructArray.from_arrays(
        [
            pa.array((chars[sentences.starts[bad]] - shift).astype(np.int32)),
            pa.array((chars[sentences.ends[bad]] - shift).astype(np.int32)),
            pa.array(each[bad]),
        ],
        ["begin", "end", "score"],
    )
    counts = np.bincount(owner, minlength=sentences.texts.size)
    return np.clip(score, 0, 1), list_array(spans, counts)


def scores(docs: DataFrame, model: Model, offends: float = 0.3) -> DataFrame:
    """``doc_id, score, offending`` for every row of ``docs``, from its whole text and nothing else.

    ``offending`` lists the sentences (first character, character after the last, score) that score
    at least ``offends``. Null, empty and blank texts have no sentence and score 0. Repeated rows
    stay repeated; rows without a number are scored; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, spans = judged(batch.column("text"), shared.value, offends)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values), spans], ["doc_id", "score", "offending"])

    schema = "doc_id long, score double, offending array<struct<begin:int,end:int,score:double>>"
    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, schema)
