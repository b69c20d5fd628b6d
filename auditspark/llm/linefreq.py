"""Rules on the words of a text, and lines that too many documents of one host share.

Every line is normalised (A-Z in lower case, digits as ``0``, white space as one blank) and hashed
to 128 bits. The documents of a host that hold a line are counted, each document once; a line in
more than ``limit`` documents of a host is frequent there. Documents lose their frequent lines, and
one that has less than ``left`` percent of its words afterwards is rejected.

All of it is DataFrame functions. Texts are read once; what the counts and the verdicts need of them
is stored: a few numbers per document and two hashes per line. Counts are pre-aggregated in the task that
reads the lines, so a line of a third of all documents shuffles as one row per task. Frequent lines
are broadcast within the bounds of ``joins.attach`` and meet the others by salted keys beyond them.

Odd input: a null or empty text has no words, fails the base rules and is not kept. Rows are
documents of their own even if they share a number or have none. A null host is a host of its own.
Columns of ``docs`` that are not named here are never touched.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import free_name
from auditspark.operators.joins import attach
from auditspark.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A line in more documents of its host than this is frequent.
LIMIT = 20
# A document that keeps less than this percentage of its words is rejected.
LEFT = 30
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_LINE = "struct<h1: bigint, h2: bigint, words: int>"
_HASH = "struct<h1: bigint, h2: bigint>"


def normalised(line: Column) -> Column:
    """A line as it is compared; without words it is empty."""
    plain = F.regexp_replace(F.translate(line, UPPER, LOWER), "[0-9]", "0")
    return F.btrim(F.regexp_replace(plain, r"[\x20\x09-\x0D]+", " "))


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2")]


def _windows(words: Column) -> Column:
    """All windows of three words with their places, in order of the words.

    ``words`` has to be a column of its own, not an expression: it is looked up once per window.
    """
    windows = F.transform(
        F.when(F.size(words) > 2, F.sequence(F.lit(0), F.size(words) - 3)).otherwise(F.array().cast("array<int>")),
        lambda at: F.struct(
            F.concat_ws(" ", F.get(words, at), F.get(words, at + 1), F.get(words, at + 2)).alias("window"), at.alias("at")
        ),
    )
    return F.sort_array(windows)


def _covered(ordered: Column) -> Column:
    """The words that windows found twice cover, from all windows in order of their words."""

    def twice(one: Column, at: Column) -> Column:
        same = [F.get(ordered, place)["window"] == one["window"] for place in (at - 1, at + 1)]
        return F.coalesce(same[0], F.lit(False)) | F.coalesce(same[1], F.lit(False))

    places = F.sort_array(F.transform(F.filter(ordered, twice), lambda one: one["at"]))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    return F.aggregate(
        places,
        start,
        lambda done, at: F.struct(
            (done["n"] + (at + 3 - F.greatest(at, done["end"])).cast("bigint")).alias("n"), (at + 3).alias("end")
        ),
        lambda done: done["n"],
    )


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """One row per row of ``docs``, in a stored table: base figures and the hashes of its lines.

    ``row`` numbers the rows. ``lines`` has one entry per line of the text (null for one without
    words), ``distinct`` one per different line.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select(
        F.col("doc_id"),
        F.col(host).cast("string").alias("host"),
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        F.split(text, "\n", -1).alias("raw"),
    )
    cut = cut.select(
        "*",
        _windows(F.col("words")).alias("windows"),
        F.filter("raw", lambda line: line.rlike(WORD)).alias("spoken"),
        F.transform("raw", normalised).alias("normal"),
    )
    counted = cut.select(
        "doc_id",
        "host",
        F.size("words").cast("bigint").alias("n_words"),
        F.coalesce(F.char_length(F.array_join("words", "")), F.lit(0)).cast("bigint").alias("word_chars"),
        "n_symbols",
        (F.size("spoken") - F.size(F.array_distinct("spoken"))).cast("bigint").alias("n_dup_lines"),
        _covered(F.col("windows")).alias("n_repeat_words"),
        F.transform(
            F.col("normal"),
            lambda line: F.when(
                line != "", F.struct(*_hashes(line), F.size(F.split(line, " ", -1)).alias("words"))
            ),
        ).cast(f"array<{_LINE}>").alias("lines"),
        F.transform(
            F.array_distinct(F.filter("normal", lambda line: line != "")), lambda line: F.struct(*_hashes(line))
        ).cast(f"array<{_HASH}>").alias("distinct"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return materialize(
        counted.withColumn("base_failed", failed).withColumn("row", F.monotonically_increasing_id())
    )


def frequent_lines(table: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``host, h1, h2, n_docs`` of the lines in more than ``limit`` documents of a host; a stored table."""
    lines = table.select("host", F.explode("distinct").alias("line")).select("host", "line.h1", "line.h2")
    return materialize(lines.groupBy("host", "h1", "h2").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > limit))


def _lost(table: DataFrame, frequent: DataFrame, *wanted: Column) -> DataFrame:
    lines = table.select("row", "host", F.posexplode("lines").alias("at", "line")).filter("line is not null")
    lines = lines.select(
        "row", "at", F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), "line.h1", "line.h2", "line.words"
    )
    keys = frequent.select(
        F.coalesce("host", F.lit("")).alias("host"), F.col("host").isNull().alias("no_host"), "h1", "h2"
    )
    found = attach(lines, keys, ["host", "no_host", "h1", "h2"], ["row", "at"], how="inner")
    return found.groupBy("row").agg(F.sum("words").cast("bigint").alias("n_removed_words"), *wanted)


def _verdict(left: int) -> Column:
    remains = F.col("n_words") - F.col("n_removed_words")
    return ~F.col("base_failed") & (100 * remains >= left * F.col("n_words"))


def judged(docs: DataFrame, host: str = "source", limit: int = LIMIT, left: int = LEFT) -> DataFrame:
    """Figures and verdict of every row of ``docs``.

    ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_removed_words,
    base_failed, kept``.
    """
    table = measured(docs, host)
    lost = _lost(table, frequent_lines(table, limit))
    joined = table.drop("lines", "distinct").join(lost, "row", "left").withColumn(
        "n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("bigint"))
    )
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words",
        "base_failed", _verdict(left).alias("kept"),
    )


def cleaned(docs: DataFrame, host: str = "source", limit: int = LIMIT, left: int = LEFT) -> DataFrame:
    """The kept rows of ``docs`` with their frequent lines taken out of ``text``; all columns stay.

    ``n_chars`` is set anew where present. Rows are stored once, with a number each.
    """
    row, gone, keep = (free_name(docs, name) for name in ("row", "gone", "kept"))
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()))
    # The number of the row goes through the figures as if it were the document's.
    table = measured(numbered.select(F.col(row).alias("doc_id"), "text", F.col(host).alias("host")), "host")
    lost = _lost(table, frequent_lines(table, limit), F.collect_list("at").alias("gone"))
    verdicts = (
        table.drop("lines", "distinct")
        .join(lost, "row", "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("bigint")))
        .select(F.col("doc_id").alias(row), F.col("gone").alias(gone), _verdict(left).alias(keep))
    )
    joined = numbered.join(verdicts.filter(keep), row)
    lines = free_name(docs, "lines")
    cut = joined.withColumn(lines, F.split("text", "\n", -1))
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    text = F.array_join(F.transform(stay, lambda at: F.get(F.col(lines), at)), "\n")
    cut = cut.withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(text))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)
