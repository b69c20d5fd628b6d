"""From a listing of files to the files worth analysing."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark import fixed_values as V
from auditspark.functions.text import contains_any, decoded, last_segment, suffix
from auditspark.operators.joins import attach
from auditspark.operators.numbering import number_by_text
from auditspark.session import materialize


def _is_pruned(name: Column) -> Column:
    return F.startswith(name, F.lit(".")) | name.isin(*V.PRUNED_DIRECTORIES)


def with_suffix(files: DataFrame) -> DataFrame:
    return files.withColumn("ext", suffix(last_segment(F.col("path"))))


def supported(files: DataFrame) -> DataFrame:
    """Files with a supported suffix."""
    return with_suffix(files).filter(F.col("ext").isin(*V.SOURCE_SUFFIXES))


def outside_pruned(files: DataFrame) -> DataFrame:
    """Files that lie in no pruned directory below the target.

    A target that is itself a file has a ``rel_path`` without directories and is never pruned.
    """
    directories = F.split(F.regexp_replace("rel_path", r"(?s)[^/]*\z", ""), "/")
    return files.filter(~F.exists(directories, _is_pruned))


def collect_files(files: DataFrame) -> DataFrame:
    """The source files of each scan."""
    return outside_pruned(supported(files))


def number_files(files: DataFrame) -> DataFrame:
    """``scan_id, path, file_order``: position by path, in code-point order, from 1."""
    return number_by_text(files, "scan_id", "path", "file_order")


def with_text(files: DataFrame) -> DataFrame:
    """Add ``text``; NULL where the file could not be read or is not UTF-8."""
    return files.withColumn(
        "text", F.when(F.col("read_error").isNull(), decoded(F.col("content")))
    )


def unreadable(files: DataFrame) -> DataFrame:
    return with_text(files).filter(F.col("text").isNull())


def relevant_python(text: Column) -> Column:
    return F.coalesce(contains_any(text, V.PY_MARKERS), F.lit(False))


def relevant_js(text: Column) -> Column:
    return F.coalesce(contains_any(text, V.JS_MARKERS), F.lit(False))


def with_relevance(files: DataFrame) -> DataFrame:
    """Add ``relevant``: does the file look like agent code?

    Markers hold no line breaks, so the bytes can be searched before line ends are unified. Files that
    have the column keep it.
    """
    if "relevant" in files.columns:
        return files
    text = F.col("content").cast("string")
    readable = F.col("read_error").isNull() & F.is_valid_utf8(text)
    marked = F.when(F.col("ext").isin(*V.JS_SUFFIXES), relevant_js(text)).otherwise(
        relevant_python(text)
    )
    return files.withColumn("relevant", F.coalesce(readable & marked, F.lit(False)))


def relevance_counts(files: DataFrame) -> DataFrame:
    """``scan_id, found, relevant``: how many files a scan has, and how many look like agent code."""
    return with_relevance(files).groupBy("scan_id").agg(
        F.count("*").alias("found"), F.count_if("relevant").alias("n_relevant")
    )


def census(counts: DataFrame) -> DataFrame:
    """Files found, selected and excluded per scan, from ``relevance_counts``."""
    selected = F.when(F.col("n_relevant") > 0, F.col("n_relevant")).otherwise(F.col("found"))
    return counts.select(
        "scan_id", "found", selected.alias("selected"),
        (F.col("found") - selected).alias("excluded"),
    )


def stored_files(files: DataFrame, buckets: int | None = None) -> DataFrame:
    """Collected files with ``relevant``, ``lang`` and ``slot``, written once with a folder per language.

    ``slot`` is the task that wrote the file, and the buckets of the table are made of slots, so every
    task writes one file per language and contents stay where they were read, however the files of a
    scan are spread. Later steps read of the table what they need: counts the narrow columns,
    extraction one language. ``buckets`` (by default the number of shuffle partitions) says how many
    tasks read it in a join.
    """
    buckets = buckets or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lang = F.when(F.col("ext").isin(*V.JS_SUFFIXES), "js").otherwise("py")
    slot = F.spark_partition_id().alias("slot", metadata={"buckets": buckets})
    return materialize(with_relevance(files).withColumn("lang", lang).select("*", slot), by="lang", buckets=(buckets, "slot"))


def select_files(files: DataFrame, counts: DataFrame) -> DataFrame:
    """Relevant files of each scan, or all its files when none is relevant.

    ``files`` comes from ``stored_files`` and ``counts`` is the stored result of ``relevance_counts``,
    one row per scan. Only pairs of scan and slot travel. For each slot the scans without any relevant
    file are stored in the same buckets as the files and meet them there: contents are neither moved
    nor sorted, and nothing is broadcast.
    """
    unmarked = counts.filter(F.col("n_relevant") == 0).select("scan_id")
    places = files.filter(~F.col("relevant")).select("slot", "scan_id").distinct()
    whole = attach(places, unmarked, ["scan_id"], ["slot"], how="inner")
    slots = materialize(
        whole.groupBy("slot").agg(F.collect_list("scan_id").alias("_whole")),
        buckets=(files.schema["slot"].metadata["buckets"], "slot"),
    )
    # A row per slot, whose names are fewer than its files, so they make the table of a hash join.
    joined = files.join(slots.hint("shuffle_hash"), "slot", "left")
    return joined.filter(F.col("relevant") | F.array_contains("_whole", F.col("scan_id"))).select(*files.columns)


def pruned_directories(dirs: DataFrame) -> DataFrame:
    """Named pruned directories that a walk of each scan meets, with the first few sorted names.

    Nothing below a pruned directory is met, and pruned dot directories that have no fixed name are
    not recorded. At most twenty names exist, so the set stays small whatever the scan holds.
    """
    met = F.get(F.filter(F.split("rel_path", "/"), _is_pruned), F.lit(0))
    return (
        dirs.select("scan_id", met.alias("name"))
        .filter(F.col("name").isin(*V.PRUNED_DIRECTORIES))
        .groupBy("scan_id")
        .agg(F.sort_array(F.collect_set("name")).alias("names"))
        .select("scan_id", F.size("names").cast("bigint").alias("n_names"), "names")
    )


def directory_sample(named: DataFrame) -> DataFrame:
    """The first names of each scan as one text."""
    sample = F.array_join(F.slice("names", 1, V.DIRECTORY_SAMPLE), ", ")
    return named.select("scan_id", sample.alias("sample"))


def scan_status(scans: DataFrame, listed: DataFrame) -> DataFrame:
    """Each scan with an error when its target does not exist.

    ``listed`` has ``scan_id`` for every target that exists, one or more rows each.
    """
    present = listed.select("scan_id").distinct().withColumn("_present", F.lit(True))
    missing = F.concat(F.lit(V.MISSING_TARGET), F.col("target_path"))
    return scans.join(present, "scan_id", "left").select(
        "scan_id", "target_path", F.when(F.col("_present").isNull(), missing).alias("error")
    )
