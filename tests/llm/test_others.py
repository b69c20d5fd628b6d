"""Vectors, urls, conversations and token records against brute force."""

import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from auditspark.llm import chat, neighbours, queries, shards, urls


def exact(rows, nearest, divisor):
    good = {}
    for number, vector in rows:
        if number is not None and vector and all(x is not None and math.isfinite(x) for x in vector) and any(vector):
            good[number] = np.array(vector, np.float64)
    out = {}
    for number in good:
        if number % divisor == 0:
            one = good[number]
            scores = [(-(one @ two) / math.sqrt(one @ one) / math.sqrt(two @ two), other) for other, two in good.items() if other != number]
            out[number] = [(other, -score) for score, other in sorted(scores)[:nearest]]
    return out


def test_nearest_vectors(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((30, 16))
    points = (centres[rng.integers(0, 30, 3000)] + 0.4 * rng.standard_normal((3000, 16))).astype(np.float32)
    points[100:160] = points[100]
    rows = [(n, [float(x) for x in point]) for n, point in enumerate(points)]
    rows += [(5000, None), (5050, []), (5100, [0.0] * 16), (5150, [float("nan")] + [1.0] * 15), (5200, [None] + [1.0] * 15), (5250, [float("inf")] * 16), (None, [1.0] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("own"))
    want = exact(rows, 5, 50)
    found = neighbours.nearest_neighbours(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    lists = {}
    for row in found:
        lists.setdefault(row.query_id, []).append((row.vec_id, row.score))
        assert row.rank == len(lists[row.query_id])
    assert set(lists) == set(want) and all(len(lists[query]) == 5 for query in want)
    hits = sum(len({v for v, _ in lists[query]} & {v for v, _ in want[query]}) for query in want)
    assert hits >= 0.9 * 5 * len(want)
    for query, near in lists.items():
        assert near == sorted(near, key=lambda pair: (-pair[1], pair[0]))
        for vector, score in near:
            one, two = points[query].astype(float), points[vector].astype(float)
            assert abs(score - one @ two / math.sqrt(one @ one) / math.sqrt(two @ two)) < 1e-12
    assert [v for v, _ in lists[100]] == [101, 102, 103, 104, 105]


def test_nearest_vectors_of_small_tables(spark):
    shape = "vec_id long, embedding array<double>"
    assert neighbours.nearest_neighbours(spark.createDataFrame([], shape), F.lit(True)).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], shape)
    assert neighbours.nearest_neighbours(one, F.lit(True)).count() == 0
    three = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, -1.0])], shape)
    found = neighbours.nearest_neighbours(three, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(row.rank, row.vec_id) for row in found] == [(1, 1), (2, 2)]


def test_large_cells_are_cut_into_blocks():
    layout = neighbours._layout(np.array([5, 0, 100, 3, 4]), 10)
    assert layout == [(0, 0, 1), (2, 1, 10), (3, 11, 1), (4, 11, 1)]


def test_walk_is_in_order_of_distance():
    rng = np.random.default_rng(1)
    one, two = rng.random(7), rng.random(9)
    cells = neighbours.walk(one, two, np.ones(63, int), 63)
    sums = [one[cell // 9] + two[cell % 9] for cell in cells]
    assert len(set(cells)) == 63 and sums == sorted(sums)


def judged(url, rules):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(mark) for mark in "/?#" if mark in rest), default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min((path.find(mark) for mark in "?#" if mark in path), default=len(path))]
    fits = [
        (len(h + p), len(h), h + p, v == "block", v)
        for h, p, v in rules
        if host and (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fits, default=None)
    return host, path, best and best[2], best[4] if best else "allow"


@pytest.mark.parametrize("max_bytes", [64 << 20, 1])
def test_url_rules(spark, max_bytes):
    rng = random.Random(6)
    rules = [*queries.RULES, ("org", "/", "block"), ("b.org", "", "allow"), ("é.net", "/ü", "block"), ("", "/x", "block")]
    rules += [(f"h{n}.com", f"/{n}/", rng.choice(["allow", "block"])) for n in range(40)]
    made = [None, "", "no scheme", "http://", "://x", "HTTP://WWW.Example.ORG/es/1?q#f", "http://example.org/en/12", "http://a.example.org/en/2"]
    made += ["http://org/x", "http://org", "http://xorg/x", "http://b.org?x", "http://a.b.org#x", "http://é.net/üb", "http://x.com/fr/://y.com/de/", "http://a.com/de/\n"]
    made += [f"http://{rng.choice(['', 'www.', 'a.b.'])}h{rng.randrange(60)}.com/{rng.randrange(60)}/{rng.randrange(9)}" for _ in range(300)]
    rows = [(n, url, "own") for n, url in enumerate(made)] + [(None, "http://x.org/", None), (0, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    listed = spark.createDataFrame([*rules, (None, "/", "block"), ("net", "/", "maybe")], "host string, path string, verdict string")
    found = urls.judge(pages, listed, max_bytes=max_bytes).collect()
    want = sorted(((number, *judged(url, rules)) for number, url, _ in rows), key=str)
    assert sorted((tuple(row) for row in found), key=str) == want
    assert urls.judge(pages.limit(0), listed, max_bytes=max_bytes).count() == 0
    none = urls.judge(pages, listed.limit(0), max_bytes=max_bytes)
    assert none.count() == len(rows) and none.filter("rule is not null or verdict <> 'allow'").count() == 0


def test_cascade_is_exact_on_its_universe(spark):
    keys = spark.createDataFrame([(f"k{n}",) for n in range(200)], "key string")
    universe = spark.range(60_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    cascade = urls.build_cascade(keys, universe)
    assert len(cascade) > 1
    batch = urls._hashed(universe).toArrow()
    one, two = (batch.column(name).to_numpy().view(np.uint64) for name in ("h1", "h2"))
    answers = dict(zip(batch.column("key").to_pylist(), urls.listed(cascade, one, two).tolist()))
    assert all(answer == (int(key[1:]) < 200) for key, answer in answers.items())


control_text = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "\n", "a", "<", "[", "n", "é"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]) | control_text, control_text), max_size=4))
def test_rendering_is_reversible(turns):
    made = [chat.render(role, text) for role, text in turns]
    assert list(chat.parse("".join(text for text, _, _ in made))) == turns
    for (role, text), (whole, low, high) in zip(turns, made):
        assert chat.unescape(whole[low:high]) == (text if role == "assistant" else "")


def test_events_are_folded(spark):
    events = [
        (1, 0, 0, "user", "delta", "Hel"), (1, 0, 1, None, "delta", "lo"),
        (1, 1, 2, "assistant", "delta", "bad "), (1, 1, 3, "assistant", "delta", "answer"),
        (1, 1, 4, "assistant", "regenerate", "ignored"), (1, 1, 5, "assistant", "delta", "good"), (1, 1, 6, "assistant", "delta", None),
        (1, 2, 7, "user", "delta", "thanks"), (1, 3, 8, "assistant", "delta", "welcome"),
        (1, 2, 9, "user", "edit", "why?"), (1, 3, 10, "assistant", "noise", "x"),
        (2, 0, 0, "user", None, "x"), (2, 0, 0, "user", None, "x"), (None, 0, 0, None, "delta", "y"),
        (3, 0, 0, "user", "delta", "a"), (3, 1, 1, "assistant", "delta", "b"), (3, 0, 2, "user", "edit", "c"), (3, 1, 3, "assistant", "edit", "late"),
        (3, 2, 4, "assistant", "delta", "d"),
    ]
    shape = "conv_id long, message long, seq long, role string, kind string, text string"
    frame = spark.createDataFrame(events, shape).withColumn("parts", F.lit(1)).repartition(4)
    found = sorted((tuple(row) for row in chat.fold(frame).collect()), key=str)
    want = [(1, 0, "user", "Hello"), (1, 1, "assistant", "good"), (1, 2, "user", "why?"), (2, 0, "user", "xx"), (None, 0, "", "y")]
    want += [(3, 0, "user", "c"), (3, 2, "assistant", "d")]
    assert found == sorted(want, key=str)
    assert chat.fold(frame.limit(0)).count() == 0


def test_conversations_are_read_back(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(30):
        for turn in range(rng.randrange(1, 9)):
            text = "".join(rng.choice([*chat.CONTROLS, "word ", "\\", "é", "\n"]) for _ in range(rng.randrange(6)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool"]), text))
    rows += [(50, None, None, None), (50, 0, "user", None), (51, 0, "user", "tie"), (51, 0, "assistant", "tie"), (51, 0, "user", "tie"), (52, 0, "assistant", "x" * 300_000)]
    rows += [(60, n, "user" if n % 2 else "assistant", f"turn {n}") for n in range(3000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    found = chat.read_back(chat.formatted(chat.fold(chat.events_of_rows(frame)))).collect()
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn is not None, turn, role or "", text or ""))
    assert len(found) == len(groups)
    for row in found:
        turns = sorted(groups[row.conv_id], key=lambda t: (t[0], t[1] or 0, t[2], t[3]))
        whole = "".join(f"{role}\n{text}\n" for _, _, role, text in turns)
        learned = "".join(text for _, _, role, text in turns if role == "assistant")
        assert row.n_turns == len(turns) and row.turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
        assert row.loss_chars == len(learned) and row.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert row.formatted_chars == sum(len(chat.render(role, text)[0]) for _, _, role, text in turns)


@pytest.mark.parametrize("size", [1, 2, 3, 64, 65, 4097])
def test_slots_are_a_permutation(size):
    slots = shards.permuted(np.arange(size), size, 9)
    assert sorted(slots.tolist()) == list(range(size))
    if size > 60:
        assert (slots != shards.permuted(np.arange(size), size, 10)).any() and (slots != np.arange(size)).any()


def test_records_in_training_order(spark, tmp_path):
    rng = random.Random(4)
    texts = [" ".join(str(rng.randrange(10**6)) for _ in range(rng.randrange(0, 90))) for _ in range(60)]
    rows = [(n, text, "x") for n, text in enumerate(texts)] + [(60, None, "x"), (61, "", None), (None, "no number", None), (3, "again", "x"), (3, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot string").repartition(4)
    order = shards.training_order(docs, key=5, length=32, shard_records=50)
    found = order.collect()
    assert sorted(row.slot for row in found) == list(range(len(found)))
    assert all(row.shard * 50 + row.position == row.slot and len(row.record) == 64 for row in found)
    encoding = shards.encoder(shards.default_ranks())
    back = {}
    for row in found:
        back.setdefault((row.doc_id, row.part), []).append(np.frombuffer(row.record, "<u2")[:row.n_tokens].tolist())
    want = {}
    for number, text, _ in rows:
        if text:
            tokens = [*encoding.encode_ordinary(text), shards.END_MARK]
            for part in range(-(-len(tokens) // 32)):
                want.setdefault((number, part), []).append(tokens[32 * part:32 * part + 32])
    assert back == want
    facts = shards.write_shards(order, str(tmp_path)).collect()
    assert sum(fact.n_records for fact in facts) == len(found)
    shards.write_shards(order, f"file://{tmp_path}").collect()
    records = {row.slot: np.frombuffer(row.record, "<u2").tolist() for row in found}
    for first, number in ((0, len(found)), (45, 20), (len(found) - 1, 1)):
        read = shards.read_slots(str(tmp_path), first, number, 32, 50).tolist()
        assert read == [records[slot] for slot in range(first, first + number)]
    assert sorted(path.name for path in tmp_path.glob("*.bin")) == [shards.shard_name(n) for n in range(-(-len(found) // 50))]
    assert shards.training_order(docs.limit(0)).count() == 0


def test_extreme_and_differently_long_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [1.0, 1.0]), (3, [1e-200, 1e-200]), (4, [-5e-324, 0.0]), (5, [1.7e308, 1.7e308])]
    rows += [(50, [1.0, 2.0, 3.0]), (51, [3.0, 2.0, 1e-300]), (100, [7.0])]
    found = neighbours.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    made = {}
    for row in found.orderBy("query_id", "rank").collect():
        made.setdefault(row.query_id, []).append((row.vec_id, round(row.score, 9)))
    # Equal directions differ in the last bit of their cosines.
    made[0][:3] = sorted(made[0][:3])
    assert made == {
        0: [(2, 1.0), (3, 1.0), (5, 1.0), (1, 0.707106781), (4, -0.707106781)],
        50: [(51, round(7 / math.sqrt(14 * 13), 9))],
    }


def test_the_log_needs_edits_and_regenerations(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"text {c} of turn {t}") for c in range(6) for t in range(8)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    events = chat.events_of_rows(frame)
    assert {row.kind for row in events.select("kind").distinct().collect()} == {"delta", "edit", "regenerate"}

    def standing(log):
        return sorted((row.conv_id, row.message.turn, row.role, row.text) for row in chat.fold(log).collect())

    assert standing(events) == sorted(rows)
    for kind in ("edit", "regenerate"):
        assert standing(events.filter(F.col("kind") != kind)) != sorted(rows)
