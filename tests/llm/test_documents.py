"""Operators over documents against brute force, on odd and on ordinary input."""

import hashlib
import random
import re
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from auditspark.llm import decontaminate, lines, pieces, quality, queries, simhash, toxicity
from auditspark.llm.common import Texts
from auditspark.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, score string"
PLAIN = "the quick brown fox jumps over a lazy dog while seven wizards quietly mix potions near old harbour walls".split()


def sentence(rng, size):
    return " ".join(rng.choice(PLAIN) + str(rng.randrange(50)) for _ in range(size))


@pytest.fixture(scope="module")
def odd_docs(spark):
    """Null columns, empty, blank and very long texts, ties, repeated rows, clashing column names."""
    rng = random.Random(5)
    base = sentence(rng, 60)
    words = base.split()
    texts = [None, "", " \t\n", "one", "One", base, base, base.upper(), " ".join([*words[:30], "changed", *words[31:]])]
    texts += [sentence(rng, 40) for _ in range(20)] + [sentence(rng, 30_000), "é" * 4000, "日本語 テキスト 😀 ▁ x"]
    texts += ["\n".join([sentence(rng, 12), base, sentence(rng, 9), "", base])]
    rows = [(n, text, None, None, None, "own", "own") for n, text in enumerate(texts)]
    rows += [rows[5], (None, base, "en", "s", 1, None, None), (None, None, None, None, None, None, None), (3, "other", "en", "s", 5, "x", "y")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda found: found[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[at:at + 4]) for at in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(shingle.encode(), 42) for shingle in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(value >> bit & 1 for value in hashes) > len(hashes))


def joined(nodes, pairs):
    parent = {node: node for node in nodes}

    def find(node):
        while parent[node] != node:
            node = parent[node]
        return node

    for one, two in pairs:
        one, two = sorted((find(one), find(two)))
        parent[two] = one
    return {node: find(node) for node in nodes}


def expected_components(rows):
    prints = {row.text: fingerprint(row.text) for row in rows}
    values = sorted(set(prints.values()))
    pairs = [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4]
    root = joined(values, pairs)
    names = defaultdict(list)
    for row in rows:
        if row.doc_id is not None:
            names[root[prints[row.text]]].append(row.doc_id)
    return sorted(
        ((row.doc_id, f"{prints[row.text]:016x}", min(names[root[prints[row.text]]], default=None)) for row in rows), key=str
    )


@pytest.mark.parametrize("limit", [4096, 3])
def test_near_duplicates(odd_docs, limit):
    found = simhash.near_duplicates(odd_docs, limit=limit).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted((tuple(row) for row in found), key=str) == expected_components(odd_docs.collect())


def test_hamming_links_over_split_groups(spark):
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(15)]
    values = {centre ^ sum(1 << bit for bit in rng.sample(range(64), rng.randrange(7))) for centre in centres for _ in range(12)}
    signed = [value - (1 << 64) if value >> 63 else value for value in values]
    distinct = spark.createDataFrame([(value,) for value in signed], "fingerprint long")
    pairs = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    want = joined(signed, pairs)
    for limit in (4096, 4):
        links = [(row.a, row.b) for row in simhash.links(distinct, 4, limit).collect()]
        assert joined(signed, links) == want


def test_distinct_documents_keeps_one_row_of_each_group(odd_docs):
    kept = simhash.distinct_documents(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = odd_docs.collect()
    groups = {row.text: fingerprint(row.text) for row in rows}
    root = joined(set(groups.values()), [(a, b) for a in set(groups.values()) for b in set(groups.values()) if a < b and (a ^ b).bit_count() <= 4])
    assert sorted(root[groups[row.text]] for row in kept.collect()) == sorted(set(root.values()))


def test_components(spark):
    rng = random.Random(1)
    edges = [(n, n + 1) for n in range(0, 60)] + [(1000, n) for n in range(1001, 1080)] + [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)]
    edges += [(5, 5), (7, None)]
    nodes = {node for edge in edges if None not in edge and edge[0] != edge[1] for node in edge}
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {row.node: row.root for row in found} == joined(nodes, [edge for edge in edges if None not in edge])
    assert len(found) == len(nodes)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def similar_lines(one, two):
    def shingles(line):
        return {line[at:at + 8] for at in range(max(1, len(line) - 7))}

    return len(shingles(one) & shingles(two)) * 10 >= 8 * len(shingles(one) | shingles(two))


def line_docs(spark):
    rng = random.Random(11)
    base = [sentence(rng, 25) for _ in range(30)]
    rows = []
    for number in range(60):
        chosen = []
        for _ in range(4):
            line = rng.choice(base)
            kind = rng.randrange(4)
            if kind == 1:
                words = line.split()
                words[rng.randrange(len(words))] = "new"
                line = " ".join(words)
            elif kind == 2:
                line = sentence(rng, 20)
            elif kind == 3:
                line = rng.choice(["", "  ", "short", line])
            chosen.append(line)
        rows.append((number, "\n".join(chosen)))
    rows += [(100, None), (101, ""), (102, "short"), (103, "short\nshort\r"), (None, base[0]), (104, "\n\n")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1))


def test_line_classes_match_brute_force(spark):
    docs = line_docs(spark)
    at = {
        (row.doc_id, number): line
        for row in docs.collect()
        if row.doc_id is not None and row.text is not None
        for number, line in enumerate(row.text.split("\n"))
        if line.strip()
    }
    texts = sorted(set(at.values()))
    root = joined(texts, [(a, b) for n, a in enumerate(texts) for b in texts[:n] if similar_lines(a, b)])
    classes = defaultdict(list)
    for place, line in at.items():
        classes[root[line]].append(place)
    want = {place: min(members) for members in classes.values() if len(members) > 1 for place in members}
    for limit in (512, 2):
        found = lines.repeated_lines(docs, limit=limit, bands=40).collect()
        assert {(row.doc_id, row.line_no): (row.keeper_doc, row.keeper_line) for row in found} == want
    gone = defaultdict(list)
    for place, keeper in want.items():
        if place != keeper:
            gone[place[0]].append(place[1])
    report = {row.doc_id: (row.n_lines, row.n_dropped, row.dropped) for row in lines.line_report(docs, bands=40).collect()}
    assert report[100] == (0, 0, []) and report[101] == (1, 0, [])
    assert all(report[doc][2] == sorted(dropped) and report[doc][1] == len(dropped) for doc, dropped in gone.items())
    kept = {row.doc_id: row for row in lines.without_repeats(docs, bands=40).collect()}
    for row in docs.collect():
        if row.doc_id in gone:
            left = [line for number, line in enumerate(row.text.split("\n")) if number not in gone[row.doc_id]]
            if "".join(left).strip(" "):
                assert kept[row.doc_id].text == "\n".join(left)
            else:
                assert row.doc_id not in kept
        elif row.doc_id is not None:
            assert kept[row.doc_id].text == row.text


def registered_lines(docs, folder):
    """Rows of the registered query over ``docs``, with its own settings."""
    docs.write.parquet(f"{folder}/documents.parquet")
    return queries.op3_line_dedup(docs.sparkSession, str(folder)).collect()


def near_the_threshold(number):
    """Pairs of lines of a similarity from 0.8 to 0.82, each pair of words of its own."""
    rng, pairs = random.Random(21), []
    while len(pairs) < number:
        words = [f"{rng.choice(PLAIN)}{rng.randrange(10**6)}" for _ in range(rng.randrange(15, 40))]
        one, other = " ".join(words), list(words)
        for _ in range(rng.randrange(1, 4)):
            other[rng.randrange(len(other))] = f"new{rng.randrange(1000)}"
        two = " ".join(other)
        if similar_lines(one, two):
            left, right = lines.shingle_set(one), lines.shingle_set(two)
            if len(left & right) <= 0.82 * len(left | right):
                pairs.append((one, two))
    return pairs


def test_registered_line_query_matches_brute_force(spark, tmp_path):
    docs = line_docs(spark)
    rows = [row for row in docs.collect() if row.doc_id is not None and row.text is not None]
    at = {(row.doc_id, n): line for row in rows for n, line in enumerate(row.text.split("\n")) if line.strip(" ")}
    texts = sorted(set(at.values()))
    pairs = [(a, b) for n, a in enumerate(texts) for b in texts[:n] if similar_lines(a, b)]
    root = joined(texts, pairs)
    first, want = {}, defaultdict(list)
    for place in sorted(at):
        if first.setdefault(root[at[place]], place) != place:
            want[place[0]].append(place[1])
    found = {row.doc_id: row.dropped for row in registered_lines(docs, tmp_path) if row.n_dropped}
    assert len(pairs) > 50 and found == want
    classes = {(row.doc_id, row.line_no): (row.keeper_doc, row.keeper_line) for row in lines.repeated_lines(docs).collect()}
    several = {first[root[at[doc, n]]] for doc, gone in want.items() for n in gone}
    assert classes == {place: first[root[line]] for place, line in at.items() if first[root[line]] in several}


def test_registered_line_query_finds_pairs_near_the_threshold(spark, tmp_path):
    pairs = near_the_threshold(2000)
    rows = [(2 * n + place, line) for n, pair in enumerate(pairs) for place, line in enumerate(pair)]
    found = registered_lines(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)
    dropped = {row.doc_id for row in found if row.n_dropped}
    assert all(doc % 2 for doc in dropped)
    recall = len(dropped) / len(pairs)
    print(f"recall of pairs from 0.8 to 0.82: {recall}")
    assert recall >= 0.997


def test_shared_bands_are_packed_and_dealt_evenly(spark):
    rng = random.Random(17)
    rows = [(node, [-1 if node % 2 else rng.randrange(-2**63, 2**63), rng.randrange(300) << 40, 7 << 60 if node == 5 else rng.randrange(-2**63, 2**63)]) for node in range(3000)]
    rng.shuffle(rows)
    nodes = defaultdict(list)
    for node, bands in rows:
        for band in bands:
            nodes[band].append(node)
    want = {(band, min(found)) for band, found in nodes.items() if len(found) > 1}
    for tasks in (1, 7):
        distinct = spark.createDataFrame(rows, "node long, bands array<long>").repartition(5)
        shared = lines._shared(distinct, tasks)
        assert shared.rdd.getNumPartitions() == tasks
        assert {(row.band % 2**64, row.least) for row in shared.collect()} == {(band % 2**64, least) for band, least in want}
        assert lines._shared(distinct.limit(0), tasks).count() == 0
        # Bands travel many in a row: no row for every line and band is made.
        assert "Generate" not in shared._jdf.queryExecution().executedPlan().toString()


def test_places_keep_the_order_of_rows_and_lines(spark):
    for rows, short in (([0, 1, 7, (1 << 31) - 1], True), ([-5, 0, 3, 1 << 31, (1 << 62) + 1], False)):
        pairs = [(row, line) for row in rows for line in (0, 1, (1 << 31) - 1)]
        frame = spark.createDataFrame(pairs, "__row long, line_no int")
        places = lines.Places(frame)
        found = frame.withColumn("place", places.of()).withColumn("r", places.row("place")).withColumn("l", places.line("place"))
        assert places.short == short
        assert [(row.r, row.l) for row in found.orderBy("place").collect()] == pairs


def test_texts_of_lines_far_down(spark):
    rows = [(1, "a\n\nlast"), (2, None), (3, ""), (4, "\n" * 300000 + "deep é"), (None, "a")]
    docs = spark.createDataFrame([(n, *row) for n, row in enumerate(rows)], "__row long, doc_id long, text string")
    needed = spark.createDataFrame([(10, 0, 0), (11, 0, 2), (12, 3, 300000)], "node long, row long, line_no int")
    assert sorted(map(tuple, lines._texts_of(docs, needed).collect())) == [(10, "a"), (11, "last"), (12, "deep é")]


def test_shingle_hashes_tell_shingles_apart():
    rng = random.Random(23)
    kinds = ["ab c", "abé ", "é日x ", "日本語", "a\U0001f600b "]
    some = ["".join(rng.choices(rng.choice(kinds) + "abcdef" * rng.randrange(9), k=rng.randrange(40))) for _ in range(1500)]
    for texts in (some, [text for text in some if text.isascii()], [""], ["éééé", "abcdefgh", "a"]):
        for size in (8, 3, 11):
            values, made = lines._char_shingles(Texts(pa.array(texts)), size)
            shingles = [text[at:at + size] for text in texts if text for at in range(max(1, len(text) - size + 1))]
            assert made.tolist() == [max(1, len(text) - size + 1) if text else 0 for text in texts]
            assert len(set(shingles)) == len(set(zip(shingles, values.tolist())))
            # Of so many values of 32 bits a few may meet by chance.
            assert len(set(shingles)) - len(set(values.tolist())) <= 3


def test_lines_compare_alike_in_either_form():
    rng = random.Random(8)
    words = ["größe", "naïve", "plain", "“quoted”", "日本語", "ab", "x"]
    for _ in range(600):
        one = " ".join(rng.choices(words[:3] if rng.random() < 0.5 else words, k=rng.randrange(1, 25)))
        two = one if rng.random() < 0.1 else "".join(c if rng.random() < 0.97 else rng.choice("ab é“") for c in one)
        assert lines.Exact(8, 0.8).similar(one, two) == lines.similar(lines.shingle_set(one), lines.shingle_set(two))
        pictures, counts = lines._pictures(pa.array([one, two]), 8)
        if similar_lines(one, two):
            assert lines._may_be_similar(pictures[:1], counts[:1], pictures[1:], counts[1:], 0.8).all()


def test_white_lines_and_clashing_names(spark):
    rows = [(1, "first line of all\r\n\r\n\t\nx", 5, "r", "d", "o", "g"), (2, "another line here\r\n\r\n\t\ny\u3000\n\u3000", 5, "r", "d", "o", "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row long, __doc string, __dropped string, __group string, keepers string")
    assert [row.n_dropped for row in lines.line_report(docs).collect()] == [0, 0]
    for frame in (lines.without_repeats(docs), simhash.distinct_documents(docs), decontaminate.clean(docs, spark.createDataFrame([], "item_id long, text string"))):
        assert frame.columns == docs.columns and sorted(map(tuple, frame.collect())) == rows
    twice = docs.unionByName(docs.withColumn("doc_id", F.lit(3).cast("long"))).unionByName(docs)
    kept = lines.without_repeats(twice)
    assert kept.columns == docs.columns and {row["__row"] for row in kept.collect()} == {5}
    report = {(row.doc_id, row.n_dropped): row for row in lines.line_report(twice.filter("doc_id <> 2")).collect()}
    last = report[3, 2]
    assert [tuple(one) for one in last.keepers][:1] == [(0, 1, 0)] and last.dropped == [one.line_no for one in last.keepers]


def test_lines_of_rows_that_share_a_number(spark):
    rng = random.Random(4)
    same, one, two, three = (sentence(rng, 15) for _ in range(4))
    rows = [(1, f"{one}\n{same}"), (2, f"{same}\n{two}"), (2, f"{three}\n{same}"), (3, one), (3, one), (None, f"{two}\n{same} end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    report = sorted(((row.doc_id, row.n_lines, row.dropped) for row in lines.line_report(docs).collect()), key=str)
    assert report == sorted([(1, 2, []), (2, 2, [0]), (2, 2, [1]), (3, 1, [0]), (3, 1, [0]), (None, 2, [])], key=str)
    kept = sorted(((row.doc_id, row.text) for row in lines.without_repeats(docs).collect()), key=str)
    assert kept == sorted([(1, f"{one}\n{same}"), (2, two), (2, three), rows[-1]], key=str)


def test_line_banding_finds_nearly_all_similar_pairs():
    rng = random.Random(2)
    import pyarrow as pa

    pairs, hits = 0, 0
    for _ in range(400):
        words = sentence(rng, rng.randrange(8, 60)).split()
        other = list(words)
        for _ in range(rng.randrange(1, 4)):
            other[rng.randrange(len(other))] = "w" + str(rng.randrange(1000))
        one, two = " ".join(words), " ".join(other)
        if one != two and similar_lines(one, two):
            value = lines.signatures(pa.array([one, two]))
            pairs += 1
            hits += bool((value[0] == value[1]).any())
    assert pairs > 100 and hits >= 0.97 * pairs


def test_lines_and_near_duplicates_of_odd_tables(odd_docs, no_docs):
    assert lines.line_report(odd_docs).count() == odd_docs.filter("doc_id is not null").count() + 2
    assert lines.without_repeats(odd_docs).columns == odd_docs.columns
    for frame in (lines.line_report(no_docs), lines.without_repeats(no_docs), simhash.near_duplicates(no_docs), simhash.distinct_documents(no_docs)):
        assert frame.count() == 0


def expected_overlap(text, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def split(value):
        return re.findall(pattern, re.sub("[A-Z]", lambda found: found[0].lower(), value or ""))

    words, hit, found = split(text), set(), set()
    for item, value in items:
        own = split(value)
        if not own or item is None:
            continue
        size = min(13, len(own))
        windows = {tuple(own[at:at + size]) for at in range(len(own) - size + 1)}
        for at in range(len(words) - size + 1):
            if tuple(words[at:at + size]) in windows:
                hit.update(range(at, at + size))
                found.add(str(item))
    names = ",".join(sorted(found))
    return len(words), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("part_bytes", [4 << 20, 600])
def test_decontamination(spark, odd_docs, part_bytes):
    rng = random.Random(9)
    items = [(n, sentence(rng, rng.randrange(13, 40))) for n in range(12)]
    items += [(20, "One"), (21, "two words"), (22, ""), (23, None), (24, " ".join(sentence(rng, 13).split())), (None, "one"), (10, "repeated number here")]
    texts = []
    for number in range(60):
        source = rng.choice(items[:12])[1].split()
        low = rng.randrange(len(source))
        cut = source[low:low + rng.randrange(8, 30)]
        texts.append(sentence(rng, rng.randrange(0, 120)) + rng.choice([" ", "\n", "... "]) + " ".join(cut) + ", Two  WORDS " * rng.randrange(2) + sentence(rng, rng.randrange(0, 60)))
    more = spark.createDataFrame([(1000 + n, text, "en", "s", 0, "x", "y") for n, text in enumerate(texts)], SCHEMA)
    docs = odd_docs.unionByName(more)
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit(3))
    found = decontaminate.report(docs, benchmark, part_bytes=part_bytes).collect()
    want = sorted(((row.doc_id, *expected_overlap(row.text, items)) for row in docs.collect()), key=str)
    assert sorted((tuple(row) for row in found), key=str) == want
    kept = decontaminate.clean(docs, benchmark, part_bytes=part_bytes)
    assert kept.columns == docs.columns
    clean = [row for row in docs.collect() if not expected_overlap(row.text, items)[4]]
    assert sorted(map(str, kept.collect())) == sorted(map(str, clean))


def test_decontamination_of_empty_tables(spark, odd_docs, no_docs):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.report(odd_docs, nothing).filter("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.report(no_docs, nothing).count() == 0


def test_segmentations_are_lossless_and_reproducible(odd_docs, no_docs):
    encoded = pieces.encode(odd_docs, seed=4).persist()
    texts = sorted((str(row.doc_id), str(row.text)) for row in odd_docs.collect())
    assert sorted((str(row.doc_id), str(row.text)) for row in pieces.decode(encoded).collect()) == texts
    again = pieces.encode(odd_docs.repartition(1), seed=4)
    assert sorted(map(str, again.collect())) == sorted(map(str, encoded.collect()))
    trip = pieces.round_trip(odd_docs, seed=4)
    assert trip.filter("not lossless or lossless is null").count() == 0
    assert sorted(map(str, trip.drop("lossless").collect())) == sorted(map(str, encoded.collect()))
    other = pieces.encode(odd_docs, seed=5)
    assert sorted(map(str, other.collect())) != sorted(map(str, encoded.collect()))
    assert encoded.filter("n_tokens <> coalesce(size(ids), 0) and ids is not null").count() == 0
    assert encoded.filter("ids is null and n_tokens <> 0").count() == 0
    assert pieces.encode(no_docs).count() == 0


def test_segmentations_are_drawn_by_weight():
    import numpy as np
    import pyarrow as pa

    path, number = pieces.default_model(), 20_000
    words = pieces.vocabulary(path)
    known = {piece: n for n, piece in enumerate(words.pieces) if piece and not words.first_byte <= n < words.first_byte + 256}

    def paths(text):
        if not text:
            yield (), 0.0
        for size in range(1, len(text) + 1):
            if text[:size] in known:
                for rest, weight in paths(text[size:]):
                    yield (known[text[:size]], *rest), weight + words.weights[known[text[:size]]]

    weights = dict(paths(b" hello"))
    total = sum(np.exp(weight) for weight in weights.values())
    drawn = pieces.encode_batch(pa.array(["hello"] * number), np.arange(number, dtype=np.uint64), path)
    counts = defaultdict(int)
    for row in drawn.to_pylist():
        counts[tuple(row)] += 1
    assert set(counts) <= set(weights)
    for path_of, weight in weights.items():
        share = np.exp(weight) / total
        assert abs(counts[path_of] / number - share) < 5 * (share * (1 - share) / number) ** 0.5 + 1e-3


def labelled(spark, rng, number):
    """Clean prose, and shouted or symbol-ridden text; insults in some sentences."""
    docs, labels = [], []
    for n in range(number):
        good, toxic = n % 3 != 0, n % 4 == 1
        said = [sentence(rng, rng.randrange(4, 12)).capitalize() for _ in range(rng.randrange(2, 9))]
        if toxic:
            for _ in range(2):
                said.insert(rng.randrange(len(said)), sentence(rng, 3) + " " + rng.choice(["blockhead", "nitwit"]))
        text = ". ".join(said) + "."
        if not good:
            text = text.upper().replace(" ", "!! ") if n % 2 else text.replace(" ", "*** ")
        docs.append((n, text))
        labels.append((n, int(good), int(toxic)))
    labels += [(None, 1, 1), (number + 5, 1, 0), (1, 1 - labels[1][1], 1 - labels[1][2]), (2, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_documents(spark, odd_docs, no_docs):
    rng = random.Random(8)
    docs, labels = labelled(spark, rng, 900)
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1
    test = docs.filter(~learn)
    model = quality.learned(docs, labels, learn)
    scored = quality.scores(test, model).collect()
    assert sum((row.score >= 0.5) == (row.doc_id % 3 != 0) for row in scored) >= 0.97 * len(scored) > 200
    assert quality.accepted(test, model).count() == sum(row.score >= 0.5 for row in scored)
    odd = quality.scores(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= row.score <= 1 for row in odd)
    assert quality.scores(no_docs, model).count() == 0
    toxic = toxicity.learned(docs, labels, learn)
    rows = toxicity.scores(test, toxic).join(test, "doc_id").collect()
    assert sum((row.score >= 0.3) == (row.doc_id % 4 == 1) for row in rows) >= 0.97 * len(rows)
    found = [row.text[span.begin:span.end] for row in rows for span in row.offending if row.doc_id % 4 == 1]
    assert sum(bool(re.search("(?i)blockhead|nitwit", span)) for span in found) >= 0.9 * len(found) > 30
    odd = toxicity.scores(odd_docs, toxic).collect()
    assert len(odd) == odd_docs.count() and all(0 <= row.score <= 1 for row in odd)
    assert all(row.score == 0 for row in toxicity.scores(odd_docs.filter("text is null or trim(text) = ''"), toxic).collect())


def test_classifiers_without_labels(spark, odd_docs):
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.learned(odd_docs, nothing, F.lit(True))
    assert quality.scores(odd_docs, model).filter("score <> 0.5").count() == 0
    assert toxicity.scores(odd_docs, toxicity.learned(odd_docs, nothing, F.lit(True))).filter("score > 0.3").count() == 0
