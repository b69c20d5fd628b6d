"""Line frequency and word rules against plain Python."""

import random
import re
import time

from pyspark.sql import functions as F

from auditspark.llm import linefreq, queries
from auditspark.operators import joins

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = "doc_id long, text string, source string, n_chars long, row long, LINES string"


def plain(line):
    return " ".join(WORD.findall(re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), line))))


def model(rows, limit, left):
    """The same verdicts by loops over the rows."""
    seen = {}
    for at, row in enumerate(rows):
        for line in {plain(line) for line in (row[1] or "").split("\n")} - {""}:
            seen.setdefault((row[2], line), set()).add(at)
    out, texts = [], []
    for row in rows:
        text = row[1] or ""
        words = WORD.findall(text)
        windows = {}
        for at in range(len(words) - 2):
            windows.setdefault(tuple(words[at:at + 3]), []).append(at)
        repeated = {at + step for places in windows.values() if len(places) > 1 for at in places for step in range(3)}
        spoken = [line for line in text.split("\n") if WORD.search(line)]
        gone = [len(seen.get((row[2], plain(line)), ())) > limit for line in text.split("\n")]
        removed = sum(len(WORD.findall(line)) for line, out_ in zip(text.split("\n"), gone) if out_)
        failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
        kept = not failed and 100 * (len(words) - removed) >= left * len(words)
        out.append((
            row[0], len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
            len(spoken) - len(set(spoken)), len(repeated), removed, failed, kept,
        ))
        if kept:
            texts.append((row[0], "\n".join(line for line, out_ in zip(text.split("\n"), gone) if not out_), *row[2:3], *row[4:]))
    return out, texts


def cases():
    rng = random.Random(11)
    vocabulary = [f"w{n}" for n in range(400)] + ["Ünit", "#x", "a<b>", " ", "Zwölf12"]
    common = ["Read more at 12:30", "All rights reserved. 1999", "Über uns &c"]

    def line(size):
        return " ".join(rng.choices(vocabulary, k=size))

    rows = []
    for n in range(120):
        lines = [line(rng.randint(0, 14)) for _ in range(rng.randint(1, 14))]
        lines += rng.sample(common, rng.randint(0, 3))
        if n % 7 == 0:
            lines += [lines[0], "  ", "\t", lines[0] + " ", lines[-1].upper()]
        rng.shuffle(lines)
        rows.append((n, "\r\n".join(lines) if n % 10 == 0 else "\n".join(lines), f"h{n % 3}", 0, n, "own"))
    boiler = "\n".join(common[:2] * 12)
    rows += [(200 + n, boiler.replace("12", str(n)) + "\n" + line(30), "h0", 0, 0, None) for n in range(9)]
    rows += [(300, None, None, None, None, None), (None, "", "h1", 0, 1, ""), (None, "only\nthese", None, 0, 1, "x")]
    rows += [(301, "word " * 60, "h1", 0, 1, "x"), (301, line(70), "h1", 0, 1, "x"), (302, line(70) + "\n" + line(5), None, 0, 1, "x")]
    return rows * 2


def test_figures_verdicts_and_texts(spark):
    rows = cases()
    frame = spark.createDataFrame(rows, SHAPE).repartition(5)
    want, texts = model(rows, 6, 40)
    assert {row[-1] for row in want} == {True, False} and any(row[6] for row in want)
    found = [tuple(row) for row in linefreq.judged(frame, limit=6, left=40).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    cut = linefreq.cleaned(frame, limit=6, left=40)
    assert cut.columns == frame.columns
    got = [(r.doc_id, r.text, r.source, r.row, r.LINES) for r in cut.collect()]
    assert sorted(got, key=str) == sorted(texts, key=str)
    assert all(r.n_chars == len(r.text) for r in cut.collect())


def test_frequent_lines_beyond_the_broadcast(spark, monkeypatch):
    frame = spark.createDataFrame(cases(), SHAPE)
    want = sorted(linefreq.judged(frame, limit=6).collect(), key=str)
    monkeypatch.setattr(linefreq, "attach", lambda *args, **more: joins.attach(*args, max_rows=1, salts=3, **more))
    assert sorted(linefreq.judged(frame, limit=6).collect(), key=str) == want


def test_empty_table(spark):
    frame = spark.createDataFrame([], SHAPE)
    assert linefreq.judged(frame).count() == 0 and linefreq.cleaned(frame).count() == 0


def test_a_line_at_the_limit_stays(spark):
    rows = [(n, "the same line " + "\n" + " ".join(f"{chr(97 + n)}{k}x{n}" for k in range(60)), "h", 0, 0, "") for n in range(20)]
    frame = spark.createDataFrame(rows, SHAPE)
    assert linefreq.judged(frame, limit=20).agg(F.sum("n_removed_words")).first()[0] == 0
    assert linefreq.judged(frame, limit=19).agg(F.sum("n_removed_words")).first()[0] == 60


def test_very_long_texts(spark):
    rng = random.Random(3)
    equal = "same words here\n" * 100_000
    mixed = "\n".join(f"{rng.randrange(10 ** 6)} {rng.randrange(10 ** 6)}" for _ in range(100_000))
    frame = spark.createDataFrame([(1, equal, "a", 0, 0, ""), (2, mixed, "a", 0, 0, ""), (3, "x" * 3_000_000, "a", 0, 0, "")], SHAPE)
    start = time.time()
    rows = {row.doc_id: row for row in linefreq.judged(frame).collect()}
    assert time.time() - start < 60
    assert rows[1].n_words == rows[1].n_repeat_words == 300_000 and rows[1].n_dup_lines == 99_999
    assert rows[2].n_words == 200_000 and rows[2].kept and rows[3].word_chars == 3_000_000


def test_plan_has_no_python(spark):
    plan = queries.op11_line_frequency(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
