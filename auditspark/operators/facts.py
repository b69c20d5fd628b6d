"""Language dispatch, and the flat tables of facts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark import fixed_values as V
from auditspark import schemas
from auditspark.operators.extract_js import js_facts
from auditspark.operators.extract_py import python_facts
from auditspark.operators.joins import positions


def extract(files: DataFrame) -> DataFrame:
    """Facts of all files: the JavaScript family by its suffixes, everything else as Python."""
    # Stored files lie in a folder per language, which the other language's branch does not open.
    is_js = F.col("lang") == "js" if "lang" in files.columns else F.col("ext").isin(*V.JS_SUFFIXES)
    python = python_facts(files.filter(~is_js)).withColumn("values", F.lit(None).cast(schemas.VALUES))
    return python.unionByName(js_facts(files.filter(is_js)))


def fact_rows(facts: DataFrame, kind: str) -> DataFrame:
    """One row per fact of one kind, with its position in the file."""
    rows = positions(facts, ["scan_id", "path"], kind, item="fact")
    if kind == "imports":
        return rows.withColumnRenamed("fact", "import")
    return rows.select("scan_id", "path", "pos", "fact.*")


def parse_rejects(facts: DataFrame) -> DataFrame:
    """Files without facts, with the reason."""
    return facts.filter(F.col("error").isNotNull()).select(
        "scan_id", "path", F.lit("parse").alias("stage"), F.col("error").alias("reason")
    )


def with_skip_reason(facts: DataFrame) -> DataFrame:
    """Add ``skip_reason``: why a file is not worth a prompt, NULL when it is."""
    hollow = (F.size("functions") == 0) & (F.size("classes") == 0)
    reason = F.when(F.col("error").isNotNull(), F.lit("parse_error")).when(hollow, F.lit("empty"))
    return facts.withColumn("skip_reason", reason)


def eligible(facts: DataFrame) -> DataFrame:
    return with_skip_reason(facts).filter(F.col("skip_reason").isNull()).drop("skip_reason")


def skip_census(facts: DataFrame) -> DataFrame:
    """Files per scan and reason for being skipped."""
    skipped = with_skip_reason(facts).filter(F.col("skip_reason").isNotNull())
    return skipped.groupBy("scan_id", "skip_reason").agg(F.count("*").alias("n_files"))
