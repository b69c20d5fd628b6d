"""Noisy-or and votes of fitted models, written out in plain Python."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditspark.llm import common, quality, queries, toxicity
from auditspark.llm.common import label_fold

SF_DIR = "/root/testdata/sf0.001"
TOP = (1 << 64) - 1
CODES = [int(code) for code in common.BYTE_CODES]


def mixed(value):
    for _ in range(2):
        value ^= value >> 32
        value = value * 0xD6E8FEB86659FD93 & TOP
    return value ^ value >> 32


def hashed(data):
    """The hash of a span of bytes."""
    total = 0
    for at, byte in enumerate(data):
        total += CODES[byte] * pow(int(common.BASE), at, 1 << 64)
    return mixed((total + len(data)) & TOP)


def toxic_score(text, model):
    clean = 1.0
    for sentence in re.split(rb"[.!?\n]", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())):
        if not sentence:
            continue
        logit, last = float(model.base), None
        for word in re.findall(rb"[0-9a-z\x80-\xff]+", sentence):
            if word == last:
                continue
            last = word
            keys = [hashed(word)]
            for width in toxicity.EDGES:
                keys += [hashed(word[:width]) + (width << 20), hashed(word[-width:]) + (width << 28)]
            logit += sum(float(model.weights[(key & TOP) % toxicity.BUCKETS]) for key in keys)
        clean *= 1 - 1 / (1 + math.exp(-logit))
    return 1 - clean


def terms(text):
    third, counts, last, shapes = quality.TERMS // 4, {}, None, []
    for word in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode()):
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), word)
        # Characters beyond ASCII stand between kinds, but are none.
        marks, before = [], None
        for b in word:
            one = chr(b)
            kind = 0 if b > 127 else 65 if one.isupper() else 97 if one.islower() else 48 if one.isdigit() else b
            if kind and kind != before:
                marks.append(kind)
            before = kind
        shape = mixed(hashed(bytes(marks)) + (low == last) & TOP)
        word_term = 2 * third + hashed(low) % (2 * third)
        for term in [shape % third, word_term, *([third + mixed((shapes[-1] * 3 + shape) & TOP) % third] if shapes else [])]:
            counts[term] = counts.get(term, 0) + 1
        shapes.append(shape)
        last = low
    return counts


def vote(text, model):
    kinds = {}
    for term, count in terms(text).items():
        kinds.setdefault(min(term // (quality.TERMS // 4), 2), {})[term] = (1 + math.log(count)) * float(model.idf[term])
    vector = np.zeros(model.basis.shape[1])
    for kind, weights in kinds.items():
        norm = max(math.sqrt(sum(weight * weight for weight in weights.values())), 1e-12)
        for term, weight in weights.items():
            vector += model.basis[term].astype(float) * weight / norm * float(quality.KIND_WEIGHT[kind])
    length = math.sqrt(float(vector @ vector))
    near = sorted(((float(voter.astype(float) @ vector) / (length or 1), float(label)) for voter, label in zip(model.vectors, model.labels)), reverse=True)
    # Which of equally near voters come in is open, so there is a lowest and a highest score.
    edge, found = near[quality.NEIGHBOURS - 1][0], []
    inside = [one for one in near if one[0] > edge + 1e-5]
    ties = [one for one in near if abs(one[0] - edge) <= 1e-5]
    for order in (False, True):
        chosen = inside + sorted(ties, key=lambda one: one[1], reverse=order)[:quality.NEIGHBOURS - len(inside)]
        voices = [(max(cosine, 0) ** 4, label) for cosine, label in chosen]
        total = sum(voice for voice, _ in voices)
        found.append(sum(voice * label for voice, label in voices) / total if total > 0 else model.prior)
    return found


@pytest.fixture(scope="module")
def some_docs(spark):
    docs = queries.table(spark, SF_DIR, "documents")
    long = spark.createDataFrame([(10**6, "Some words of a very long text, né. " * 4000), (10**6 + 1, None), (10**6 + 2, " \n")], "doc_id long, text string")
    return docs.select("doc_id", "text").filter("length(text) < 3000").limit(70).unionByName(long).persist()


def test_noisy_or(spark, some_docs):
    docs, labels = (queries.table(spark, SF_DIR, name) for name in ("documents", "labels"))
    model = toxicity.learned(docs, labels, label_fold("doc_id", 4) != 2)
    assert np.count_nonzero(model.weights)
    for row in toxicity.scores(some_docs, model).join(some_docs, "doc_id").collect():
        assert row.score == pytest.approx(min(max(toxic_score(row.text, model), 0), 1), abs=1e-5)


def test_votes(spark, some_docs):
    docs, labels = (queries.table(spark, SF_DIR, name) for name in ("documents", "labels"))
    model = quality.learned(docs, labels, label_fold("doc_id", 3) != 1)
    rows = quality.scores(some_docs, model).join(some_docs, "doc_id").collect()
    assert {round(row.score) for row in rows} == {0, 1}
    for row in rows:
        low, high = vote(row.text, model)
        assert low - 1e-3 <= row.score <= high + 1e-3


def test_long_labelled_texts_are_learned_from(spark):
    rows = [(n, "word " * 30_000 if n % 2 else "word " * 30) for n in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(n, n % 2) for n in range(20)], "doc_id long, quality int")
    table, share = quality.labelled_sample(docs, labels, "quality", F.lit(True), 10, 16 << 20)
    assert table.num_rows == 20 and share == 0.5
    table, _ = quality.labelled_sample(docs, labels, "quality", F.lit(True), 10, 1_300_000)
    sizes = [len(text) for text in table.column("text").to_pylist()]
    assert sum(size > 1000 for size in sizes) == 4 and sum(size < 1000 for size in sizes) == 10


def test_held_out_is_never_null(spark, monkeypatch):
    docs = queries.table(spark, SF_DIR, "documents").limit(20).unionByName(
        queries.table(spark, SF_DIR, "documents").limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    )
    labels = queries.table(spark, SF_DIR, "labels")
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: labels if name == "labels" else docs)
    for query in (queries.op1_toxicity, queries.op7_quality):
        assert query(spark, SF_DIR).filter("held_out is null").count() == 0
