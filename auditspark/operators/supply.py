"""Package inventories against the advisory table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.functions.text import is_below, package_key, version_key, version_triple
from auditspark.operators.joins import BROADCAST_ROWS, attach, positions

# A name is taken whole or not at all, so a long run of name characters is read once.
# JavaScript names a version behind the package, which may have a scope.
JS_PIN = r"(?<![\w@/.-])((?:@[\w.-]++/)?[A-Za-z][\w.-]*+)@([0-9][^\"'`\s,;)]*)"
PIN = r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]++)==([0-9][^\"'\s,;]*)"


def with_triple(installed: DataFrame) -> DataFrame:
    """Add the three version numbers as text, and a key that orders versions by them."""
    parts = version_triple(F.col("version"))
    numbers = [F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(("major", "minor", "patch"))]
    return installed.select("*", *numbers, version_key(F.col("version")).alias("version_key"))


def vulnerable(
    installed: DataFrame, advisories: DataFrame, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Installed packages below the version that mends an advisory, with ``adv_pos`` for order."""
    keyed = installed.withColumn("_key", package_key(F.col("package"))).drop("package")
    known = advisories.withColumn("_key", package_key(F.col("package")))
    matched = attach(
        keyed, known, ["_key"], ["scan_id", "version"], how="inner", max_rows=max_rows
    )
    below = matched.filter(is_below(F.col("version"), F.col("affected_below")))
    return below.withColumnRenamed("version", "installed").drop("_key")


def vulnerability_rows(found: DataFrame) -> DataFrame:
    return found.select(
        "scan_id", "package", "installed", "affected_below", "cve", "severity", "description",
        "remediation",
    )


def display_rows(found: DataFrame) -> DataFrame:
    return found.select(
        "scan_id", "package", "installed", "cve", F.upper("severity").alias("severity"),
        "description", F.concat(F.lit("Fix: "), "remediation").alias("fix"),
    )


def status(found: DataFrame, scans: DataFrame) -> DataFrame:
    """Vulnerable packages per scan, and whether it is clean."""
    counts = found.groupBy("scan_id").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return scans.select("scan_id").join(counts, "scan_id", "left").select(
        "scan_id", n.alias("n_vulnerable"), (n == 0).alias("clean")
    )


def pinned(texts: DataFrame) -> DataFrame:
    """``scan_id, path, package, version`` for each ``name==version`` in a text."""
    pins = F.regexp_extract_all("text", F.lit(PIN), 0)
    return positions(texts, ["scan_id", "path"], pins, item="pin").select(
        "scan_id", "path",
        F.substring_index("pin", "==", 1).alias("package"),
        F.regexp_extract("pin", r"(?s)==(.*)\z", 1).alias("version"),
    )


def pinned_js(texts: DataFrame) -> DataFrame:
    """The same for each ``name@version``; packages of the scope of an advisory's family get its name."""
    pins = F.regexp_extract_all("text", F.lit(JS_PIN), 0)
    name = F.regexp_extract("pin", JS_PIN, 1)
    member = F.regexp_extract(name, r"^@langchain/(.*)$", 1)
    family = F.when(F.startswith(member, F.lit("langgraph")), member).otherwise(F.concat(F.lit("langchain-"), member))
    return positions(texts, ["scan_id", "path"], pins, item="pin").select(
        "scan_id", "path",
        F.when(member == "", name).otherwise(family).alias("package"),
        F.regexp_extract("pin", JS_PIN, 2).alias("version"),
    )
