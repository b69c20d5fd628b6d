"""Findings: validation, removal of duplicates, ranking."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark import fixed_values as V
from auditspark import schemas
from auditspark.functions.text import severity_rank
from auditspark.operators.numbering import blocks_of, running_sum
from auditspark.session import materialize

DEDUP_KEY = ("file", "owasp_id", "title")


def good_title():
    return (F.col("title") != "") & (F.col("title") != V.DEFAULTS["title"])


def known_vector():
    return F.col("owasp_id").isin(*V.VECTORS)


def long_description():
    return F.length("description") >= V.DESCRIPTION_MIN


def with_reject_reason(findings: DataFrame) -> DataFrame:
    """Add ``reject_reason``, the first check that fails; NULL for a valid finding."""
    reason = (
        F.when(~good_title(), F.lit("title"))
        .when(~known_vector(), F.lit("vector"))
        .when(~long_description(), F.lit("description"))
    )
    return findings.withColumn("reject_reason", reason)


def valid(findings: DataFrame) -> DataFrame:
    return with_reject_reason(findings).filter(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(findings: DataFrame) -> DataFrame:
    return with_reject_reason(findings).filter(F.col("reject_reason").isNotNull())


def deduplicate(findings: DataFrame) -> DataFrame:
    """One finding per scan, file, vector and title: the worst, and of equals the earliest.

    ``first_seq`` is the position of the group, which is that of its first member even when another
    one is kept. Copies are combined before the shuffle, so a group of any size stays cheap.
    """
    others = [c for c in findings.columns if c not in ("scan_id", *DEDUP_KEY)]
    return (
        findings.groupBy("scan_id", *DEDUP_KEY)
        .agg(
            F.max_by(F.struct(*others), F.struct(severity_rank(F.col("severity")), -F.col("seq")))
            .alias("kept"),
            F.min("seq").alias("first_seq"),
        )
        .select("scan_id", *DEDUP_KEY, "kept.*", "first_seq")
    )


def rank(unique: DataFrame) -> DataFrame:
    """Add ``report_pos``: worst severity first, equal ones in order of ``first_seq``, from 1."""
    blocks, levels = blocks_of("first_seq", lead=("-_rank",))
    keyed = unique.select("*", severity_rank(F.col("severity")).alias("_rank"), *blocks)
    summed = running_sum(
        materialize(keyed), ["scan_id"], levels, ["first_seq"], F.lit(1), "_before"
    )
    return summed.select(*unique.columns, (F.col("_before") + 1).alias("report_pos"))


def score(findings: DataFrame) -> DataFrame:
    """Valid, unique findings with their place in the report."""
    return rank(deduplicate(valid(findings)))


def in_report_order(ranked: DataFrame) -> DataFrame:
    return ranked.orderBy("scan_id", "report_pos")


def counters(findings: DataFrame) -> DataFrame:
    """Findings received, discarded, removed as duplicates and kept, per scan.

    Counting per key first lets copies collapse before anything moves.
    """
    is_valid = F.col("reject_reason").isNull()
    keys = [F.when(is_valid, F.col(name)).alias(name) for name in DEDUP_KEY]
    flagged = with_reject_reason(findings).select("scan_id", is_valid.alias("valid"), *keys)
    per_key = flagged.groupBy("scan_id", "valid", *DEDUP_KEY).agg(F.count("*").alias("n"))
    received, good = F.sum("n"), F.sum(F.when(F.col("valid"), F.col("n")).otherwise(0))
    return per_key.groupBy("scan_id").agg(
        received.alias("received"),
        (received - good).alias("discarded"),
        (good - F.count_if("valid")).alias("duplicates"),
        F.count_if("valid").alias("kept"),
    )


def findings_rows(ranked: DataFrame) -> DataFrame:
    """The eight fields of each finding with its place."""
    return ranked.select("scan_id", "report_pos", *schemas.FINDING_FIELDS)
