"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from auditspark.llm import bloom, queries, spelling

SHAPE = "doc_id long, text string, word string, N long, root string"


def vocabulary(rows, min_length, min_count, noise):
    seen = Counter()
    for number, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if number is None else number}:{run}".encode())
            if h % noise == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= min_length:
                seen[run] += 1
    return {word: n for word, n in seen.items() if n >= min_count}


def near(one, two):
    if abs(len(one) - len(two)) > 1 or one == two:
        return False
    if len(one) == len(two):
        return sum(a != b for a, b in zip(one, two)) == 1
    long, short = sorted((one, two), key=len, reverse=True)
    return any(long[:at] + long[at + 1:] == short for at in range(len(long)))


def model(rows, min_length=6, min_count=5, dominance=5, noise=199):
    words = vocabulary(rows, min_length, min_count, noise)
    relatives = {word: [other for other in words if near(word, other)] for word in words}
    forms = {}
    for word, others in relatives.items():
        best = min(others, key=lambda other: (-words[other], other), default=None)
        forms[word] = best if best is not None and words[best] >= dominance * words[word] else None
    out = []
    for word, n in words.items():
        root = word
        while forms[root] is not None:
            root = forms[root]
        out.append((word, n, len(relatives[word]), forms[word], None if forms[word] is None else words[forms[word]], root))
    return sorted(out, key=str)


def cases(seed=13):
    rng = random.Random(seed)
    stems = ["colour", "coffee", "naïveté", "Straße", "aaaaaaa", "ÄÖÜäöü×÷", "ÿÿÿÿÿÿ", "ab" * 40, "c" * 63, "letters", "short", "q"]
    letters = "abczàÀßÿ×"

    def variant(word):
        for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2, 3])):
            at = rng.randrange(len(word))
            word = rng.choice([word[:at] + word[at + 1:], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1:]]) or "x"
        return word

    joints = [" ", "-", "1", "\n", "_", "Ā", "日"]
    rows = [(n, "".join(variant(rng.choice(stems)) + rng.choice(joints) for _ in range(rng.randint(0, 90))), "own", 1, "") for n in range(150)]
    rows += [(None, "coffee coffea Coffee", None, 1, ""), (None, None, None, None, None), (3, "", "", 1, ""), (4, "COFFEE" * 3000, "", 1, "")]
    return rows + rows[:20]


@pytest.mark.parametrize("settings", [{}, {"noise": 3, "min_count": 2, "dominance": 2}])
def test_variants(spark, settings):
    rows = cases()
    frame = spark.createDataFrame(rows, SHAPE).repartition(5)
    want = model(rows, **settings)
    assert len(want) > 30 and any(row[3] for row in want)
    found = spelling.variants(frame, **settings).select("word", "n", "n_near", "form", "form_n", "root")
    assert sorted((tuple(row) for row in found.collect()), key=str) == want


def test_many_groups_of_filters(spark):
    rows = cases(14)
    words = spelling.vocabulary(spark.createDataFrame(rows, SHAPE), min_count=1)
    listed = [row.word for row in words.collect()]
    found = spelling.near_pairs(words, max_bytes=256, shard_keys=20).collect()
    pairs = [tuple(sorted((row.a, row.b))) for row in found]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(one, two) for one in listed for two in listed if one < two and near(one, two)}


def test_ways_to_the_root(spark):
    chain = ["aabbccd" + "x" * n for n in range(8)]
    text = " ".join(" ".join([word] * (2 * 3 ** n)) for n, word in enumerate(chain))
    found = spelling.variants(spark.createDataFrame([(1, text, "", 1, "")], SHAPE), min_count=1, dominance=3, noise=1 << 40).collect()
    assert {row.root for row in found} == {chain[-1]} and len(found) == 8


def test_small_and_empty_tables(spark):
    for rows in ([], [(1, None, "", 1, "")], [(1, "Letter letter LETTER letter, letter", "", 1, "")]):
        found = spelling.variants(spark.createDataFrame(rows, SHAPE)).collect()
        assert sorted(((row.word, row.n, row.n_near, row.form, row.form_n, row.root) for row in found), key=str) == model(rows)


def test_edits_are_hashed_like_words():
    words = ["coffee", "aaab", "ÿÀz", "m" * 300]
    some = spelling.Words(words)
    for key, size, place, letter in some.edits():
        owner = np.searchsorted(some.ends, place, "right")
        made = []
        for w, at, c in zip(owner, place - some.starts[owner], letter):
            made.append(words[w][:at] + (chr(c) if c else "") + words[w][at + 1:])
        assert (spelling.Words(made).keys() == key).all() and [len(word) for word in made] == size.tolist()


def test_filters_hold_their_keys(spark):
    rng = np.random.default_rng(5)
    keys = rng.integers(-(1 << 62), 1 << 62, 40_000) * 2 + 1
    frame = spark.createDataFrame([(int(n % 3), int(key)) for n, key in enumerate(keys)], "shard int, key long")
    sizes = {0: bloom.words_for(13_400), 1: 8, 2: bloom.words_for(13_400, 1 << 12)}
    built = bloom.build(frame, sizes)
    values = keys.view(np.uint64)
    assert {n: len(words) for n, words in built.items()} == sizes
    assert all(bloom.holds(built[n], values[n::3]).all() for n in range(3))
    assert bloom.holds(built[0], rng.integers(0, 1 << 63, 100_000, dtype=np.uint64)).mean() < 0.05


def test_given_documents(spark):
    docs = queries.table(spark, "/root/testdata/sf0.001", "documents")
    found = queries.op13_spelling(spark, "/root/testdata/sf0.001").select("word", "n", "n_near", "form", "form_n", "root").collect()
    assert sorted((tuple(row) for row in found), key=str) == model([(row.doc_id, row.text) for row in docs.collect()])
