"""Session settings and durable intermediate tables."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # A repeated key inside a model reply keeps its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rows handed to Python may carry whole files, so batches are bounded by bytes.
    "spark.sql.execution.arrow.maxBytesPerBatch": "16777216",
}


SHUFFLE_BYTES = 128 << 20


def tune(spark: SparkSession, input_bytes: int | None = None) -> SparkSession:
    """Set the SQL settings that the stages rely on.

    With ``input_bytes``, the size of the largest table to be shuffled, the number of shuffle
    partitions is raised so that each holds about ``SHUFFLE_BYTES``; adaptive execution joins small
    ones again.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    if input_bytes is not None:
        wanted = -(-input_bytes // SHUFFLE_BYTES)
        present = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spark.conf.set("spark.sql.shuffle.partitions", str(max(present, wanted)))
    return spark


def durable_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, as named by ``spark.checkpoint.dir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="auditspark-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


def folder_address(spark: SparkSession) -> str:
    """The shared folder as an address with a scheme."""
    folder = durable_folder(spark).rstrip("/")
    if "://" in folder:
        return folder
    return "file:///" + folder.removeprefix("file:").lstrip("/")


_run: ContextVar[str] = ContextVar("run", default="")
_tables: ContextVar[list[str] | None] = ContextVar("tables", default=None)


@contextmanager
def intermediate_tables(spark: SparkSession) -> Iterator[str]:
    """Keep the tables of one run in a folder of its own, and remove it when the block ends.

    Results that read such tables have to be written or collected inside the block. Without a block
    the tables are left to the clean-up of the shared folder.
    """
    name = f"run-{uuid.uuid4().hex}"
    token, names = _run.set(f"{name}/"), _tables.set([])
    folder = f"{durable_folder(spark).rstrip('/')}/auditspark/{name}"
    try:
        yield folder
    finally:
        for table in _tables.get():
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        _tables.reset(names)
        _run.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(frame: DataFrame, by: str | None = None, buckets: tuple[int, str] | None = None) -> DataFrame:
    """Write ``frame`` once to the shared folder and go on from the written table.

    ``by`` names a column with few values that gets a folder for each of them. ``buckets`` is a number
    and a column: tables with the same number of buckets join on it without an exchange; such a table
    gets a name in the session's catalogue, its files lie where those of the others do.

    Used where two branches of a plan must see the same rows, or where a costly narrow result
    feeds several joins. The table outlives the loss of executors.
    """
    spark = frame.sparkSession
    name = uuid.uuid4().hex
    path = f"{durable_folder(spark).rstrip('/')}/auditspark/{_run.get()}{name}"
    writer = frame.write.partitionBy(by) if by else frame.write
    if buckets is None:
        writer.parquet(path)
        return spark.read.schema(frame.schema).parquet(path)
    table = f"auditspark_{name}"
    writer.bucketBy(*buckets).option("path", path).format("parquet").saveAsTable(table)
    if _tables.get() is not None:
        _tables.get().append(table)
    return spark.table(table)
