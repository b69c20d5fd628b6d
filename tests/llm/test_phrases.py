"""Misra-Gries summaries and phrase mining against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from auditspark.llm import phrases

SHAPE = "doc_id long, lang string, text string, phrase string, N long, rank string"


def model(rows, threshold, top, cover=100):
    """The same phrases by counting everything in dictionaries."""
    counts, total = defaultdict(Counter), Counter()
    for _, lang, text, *_ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, 6):
                for at in range(len(words) - size + 1):
                    counts[lang][" ".join(words[at:at + size])] += 1
    out = []
    for lang, seen in counts.items():
        good = {phrase: f for phrase, f in seen.items() if f >= threshold}
        found = []
        for phrase, a in good.items():
            words = phrase.split(" ")
            if len(words) < 2:
                continue
            longer = [f for other, f in good.items() if len(other.split(" ")) > len(words) and f" {phrase} " in f" {other} "]
            if any(100 * f >= cover * a for f in longer):
                continue
            cuts = []
            for k in range(1, len(words)):
                one, two = good[" ".join(words[:k])], good[" ".join(words[k:])]
                cuts.append((1000 * a * total[lang] // (one * two), k, one, two))
            score, _, one, two = min(cuts)
            found.append((-score, -a, phrase.encode(), one, two))
        for rank, (score, a, phrase, one, two) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, one, two, total[lang], -score))
    return sorted(out)


def cases():
    rng = random.Random(12)
    words = ["the", "of", "New", "york", "new", "São", "Paulo", "x y", "ÉTÉ", "a", "b", "c", "日本", "#"]
    joints = [" "] * 9 + ["  ", "\t", " \t ", ". ", ",", "\n", "\r\n", "\x0b", " ; ", "!?"]
    rows = []
    for n in range(300):
        text = "".join(rng.choice(words) + rng.choice(joints) for _ in range(rng.randint(0, 40)))
        if n % 5 == 0:
            text += "in the city of New York we trust. " * rng.randint(0, 3)
        rows.append((n, rng.choice(["en", "en", "en", "pt", None, "und"]), text, "own", 1, "r"))
    rows += [(1, "en", None, None, None, None), (None, None, "", None, 2, ""), (7, "xx", "only one.", None, 2, "")]
    return rows + rows[:40]


@pytest.mark.parametrize("bytes_", [64 << 20, 1024])
def test_all_phrases(spark, bytes_, monkeypatch):
    rows = cases()
    frame = spark.createDataFrame(rows, SHAPE).repartition(6)
    monkeypatch.setattr(phrases, "frequent", lambda docs, longest, threshold, whole=phrases.frequent: whole(docs, longest, threshold, bytes_))
    found = phrases.collocations(frame, threshold=4)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(tuple(row) for row in found.collect()) == model(rows, 4, 2000)


def test_top_cover_and_small_buffers(spark, monkeypatch):
    rows = cases()
    frame = spark.createDataFrame(rows, SHAPE).repartition(3)
    monkeypatch.setattr(phrases, "FLUSH", 50)
    want = model(rows, 6, 7, 60)
    assert sorted(tuple(row) for row in phrases.collocations(frame, threshold=6, top=7, cover=60).collect()) == want
    assert len(want) >= 20


def test_tables_without_phrases(spark):
    for rows in ([], [(1, "en", None, None, 1, "")], [(1, "en", "some words", None, 1, "")]):
        assert phrases.collocations(spark.createDataFrame(rows, SHAPE)).count() == 0


def test_long_texts(spark):
    text = "one two three " * 200_000 + "z" * 1_000_000
    found = phrases.collocations(spark.createDataFrame([(1, "en", text, "", 1, "")], SHAPE)).collect()
    assert {row.phrase for row in found} <= {" ".join(("one two three " * 3).split()[at:at + size]) for at in range(3) for size in range(2, 6)}
    assert max(row.a for row in found) == 200_000


def test_scores_of_large_numbers(spark):
    a, one, two, n = 3 * 10**13 + 7, 5 * 10**13 + 11, 4 * 10**13 + 3, 10**16 + 9
    found = spark.createDataFrame([("en", "x y", 2, a), ("en", "x", 1, one), ("en", "y", 1, two)], "lang string, phrase string, size int, f long")
    row = phrases.scored(found, spark.createDataFrame([("en", n)], "lang string, n long")).first()
    assert row.score == 1000 * a * n // (one * two) and (row.a, row.l, row.r) == (a, one, two)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 60), max_size=80), max_size=12), st.integers(1, 25))
def test_every_frequent_key_survives(shares, threshold):
    import unittest.mock

    with unittest.mock.patch.object(phrases, "FLUSH", 4):
        every = Counter(key for share in shares for key in share)
        summary = phrases.Summary(sum(every.values()), threshold)
        for share in shares:
            if share:
                keys, counts = np.unique(np.array(share, np.uint64), return_counts=True)
                summary.merge(keys, counts)
                assert summary.size <= max(2 * summary.capacity, 4) + 61
        kept = set(summary.survivors().tolist())
        assert {key for key, count in every.items() if count >= threshold} <= kept
        assert summary.off < threshold


def test_capacity_bounds_the_counters():
    rng = np.random.default_rng(1)
    keys = np.concatenate([np.repeat(np.uint64(5), 500), rng.integers(10, 1 << 40, 20_000, dtype=np.uint64)])
    summary = phrases.Summary(len(keys), 400)
    assert summary.capacity == len(keys) // 400 + 1
    kept, counts, off = phrases.pruned(*phrases.added(keys, np.ones(len(keys), np.int64)), summary.capacity)
    assert len(kept) <= summary.capacity and 5 in kept and off < 400


def test_masses_of_languages(spark):
    rows = cases()
    _, mass = phrases.frequent(spark.createDataFrame(rows, SHAPE), 5, 4)
    want = Counter()
    for _, lang, text, *_ in rows:
        want["und" if lang is None else lang] += len(re.findall(r"[^.,;:!?\x0A-\x0D\x20\x09]+", text or ""))
    assert {row.lang: row.n for row in mass.collect()} == dict(want)
    assert mass.agg(F.count("*")).first()[0] == len(want)


@pytest.mark.parametrize("high", [3, 1 << 40])
def test_counters_pack_and_unpack(high):
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 63, 5_000, dtype=np.uint64) * np.uint64(2))
    counts = rng.integers(1, high, len(keys))
    import pyarrow as pa

    again, numbers = phrases.unpacked(pa.py_buffer(phrases.packed(keys, counts)), len(keys), bool(counts.max() > 255))
    assert (again == keys).all() and (numbers == counts).all()
