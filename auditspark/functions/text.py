"""Text expressions used by several stages."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditspark import fixed_values as V


def strip(text: Column) -> Column:
    """``text`` without blanks (Unicode ones included) at its ends."""
    return F.btrim(text, F.lit(V.BLANKS))


def contains_any(text: Column, words) -> Column:
    """True when ``text`` holds one of ``words``."""
    test = F.lit(False)
    for word in words:
        test = test | F.contains(text, F.lit(word))
    return test


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(name: Column) -> Column:
    """Lower-cased suffix of a file name; dots that lead the name belong to its stem."""
    return F.lower(F.regexp_extract(name, r"(?s)^\.*[^.].*(\.[^.]*)\z", 1))


def decoded(content: Column) -> Column:
    """Strict UTF-8 text with ``\\n`` line ends; NULL for bytes that are not UTF-8."""
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), F.regexp_replace(text, "\r\n?", "\n"))


def location(file: Column, line: Column) -> Column:
    """``file:line``, or ``file`` alone when the line is absent or 0."""
    return F.when(F.coalesce(line, F.lit(0)) == 0, file).otherwise(
        F.concat(file, F.lit(":"), line.cast("string"))
    )


def severity_rank(severity: Column) -> Column:
    rank = F.lit(0)
    for name, value in V.SEVERITY_RANK.items():
        rank = F.when(severity == name, F.lit(value)).otherwise(rank)
    return rank


def package_key(name: Column) -> Column:
    """Package name in the form under which installers look it up."""
    return F.lower(F.regexp_replace(name, "[-_.]+", "-"))


def version_triple(version: Column) -> Column:
    """First three digit runs before any ``+`` without leading zeros, missing ones ``0``; of any length."""
    public = F.substring_index(version, "+", 1)
    runs = F.regexp_extract_all(public, F.lit(r"([0-9]+)"), 1)
    padded = F.slice(F.concat(runs, F.array(*[F.lit("0")] * 3)), 1, 3)
    return F.transform(padded, lambda run: F.coalesce(F.nullif(F.ltrim(run, F.lit("0")), F.lit("")), F.lit("0")))


def version_key(version: Column) -> Column:
    """Text that orders versions as their triples do: of each number its length, then its digits."""
    size = lambda run: F.lpad(F.length(run).cast("string"), 10, "0")
    parts = F.transform(version_triple(version), lambda run: F.concat(size(run), run))
    return F.when(version.isNotNull(), F.array_join(parts, "."))


def is_below(installed: Column, threshold: Column) -> Column:
    """Version comparison by the first three digit runs, of any length; no version is not below."""
    return F.coalesce(version_key(installed) < version_key(threshold), F.lit(False))
