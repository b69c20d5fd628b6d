"""Summary, gate and report of each scan."""

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark import fixed_values as V
from auditspark import schemas
from auditspark.functions.text import location, strip
from auditspark.operators.joins import positions


def summary(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Findings per severity and in total, with zeros, for every scan."""
    counts = findings.groupBy("scan_id").agg(
        *[F.count_if(F.col("severity") == name).alias(name) for name in V.SEVERITY_RANK],
        F.count("*").alias("total_findings"),
    )
    names = [*V.SEVERITY_RANK, "total_findings"]
    return scans.select("scan_id").join(counts, "scan_id", "left").select(
        "scan_id", *[F.coalesce(name, F.lit(0)).alias(name) for name in names]
    )


def gate(summarised: DataFrame) -> DataFrame:
    """Does a scan fail a strict run?"""
    failed = (F.col("critical") > 0) | (F.col("high") > 0)
    return summarised.select("scan_id", failed.alias("gate_failed"))


def iso_time(moment: Column) -> Column:
    """UTC time in ISO form; the fraction is left out when it is zero."""
    fraction = F.date_format(moment, ".SSSSSS")
    return F.concat(
        F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(fraction == ".000000", F.lit("")).otherwise(fraction),
        F.lit("+00:00"),
    )


def header_time(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm 'UTC'")


def header(unique: DataFrame, scans: DataFrame, moment: datetime) -> DataFrame:
    """The head of each scan's report, counted from findings that need not be ranked yet."""
    return summary(unique, scans).select(
        "scan_id",
        F.lit(V.REPORT_VERSION).alias("tool_version"),
        iso_time(F.lit(moment)).alias("timestamp"),
        "total_findings",
        F.struct(*V.SEVERITY_RANK).alias("summary"),
    )


def report(unique: DataFrame, ranked: DataFrame, scans: DataFrame, moment: datetime) -> DataFrame:
    """``scan_id, report_pos, report``: the report of every scan as lines of JSON.

    One layout for scans of any size: line 0 is the head, line ``n`` the finding at place ``n``. No
    row holds more than one finding, and an absent line number stays as null.
    """
    keep_nulls = {"ignoreNullFields": "false"}
    head = F.struct("tool_version", "timestamp", "total_findings", "summary")
    heads = header(unique, scans, moment).select(
        "scan_id", F.lit(0).cast("bigint").alias("report_pos"), F.to_json(head, keep_nulls).alias("report")
    )
    body = F.struct(*schemas.FINDING_FIELDS)
    lines = ranked.select(
        "scan_id", F.col("report_pos").cast("bigint").alias("report_pos"), F.to_json(body, keep_nulls).alias("report")
    )
    return heads.unionByName(lines)


def findings_table(ranked: DataFrame) -> DataFrame:
    """The rows of the printed table."""
    return ranked.select(
        "scan_id", "report_pos", "id", F.upper("severity").alias("severity"), "owasp_id", "title",
        location(F.col("file"), F.col("line")).alias("location"),
    )


def remediation_steps(ranked: DataFrame) -> DataFrame:
    """Non-blank lines of each remediation, stripped, in order."""
    lines = F.filter(F.transform(F.split("remediation", "\n"), strip), lambda line: line != "")
    return positions(ranked, ["scan_id", "id"], lines, "step", "text")
