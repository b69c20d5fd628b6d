"""Dimension tables, and tables that are read from or written to storage."""

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from auditspark import fixed_values as V
from auditspark import schemas
from auditspark.operators.numbering import blocks_of, running_sum
from auditspark.session import materialize


def endpoints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(V.ENDPOINTS), "model_key string, url string, model_name string"
    )


def advisories(spark: SparkSession) -> DataFrame:
    """The sample advisories; pass a table of the same layout to use real ones."""
    rows = [(pos, *row) for pos, row in enumerate(V.ADVISORIES)]
    return spark.createDataFrame(rows, schemas.ADVISORIES)


def responses(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    """Stored model responses."""
    return spark.read.schema(schemas.RESPONSES).format(form).load(path)


def write_reports(lines: DataFrame, path: str) -> None:
    """Report lines as JSON objects; the files in their order hold each scan's lines in order."""
    ordered = lines.repartitionByRange("scan_id", "report_pos").sortWithinPartitions("scan_id", "report_pos")
    ordered.write.json(path)


class ReportFilesWriter(DataSourceArrowWriter):
    """Writes lines into one file per scan, each at its own offset.

    Files grow in a folder beside the final one, which takes that name when all tasks are done. A
    task that runs again writes the same bytes to the same places; a run that fails leaves nothing.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.growing = f"{self.path}.part-{uuid.uuid4().hex}"
        if os.path.exists(self.path) and not overwrite:
            raise FileExistsError(self.path)
        os.makedirs(self.growing)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        name, file = None, None
        try:
            for batch in iterator:
                for scan, at, line in zip(*(batch.column(n).to_pylist() for n in ("scan_id", "at", "report"))):
                    if scan != name or file is None:
                        if file is not None:
                            os.close(file)
                        name, file = scan, os.open(f"{self.growing}/{report_file(scan)}", os.O_CREAT | os.O_WRONLY)
                    os.pwrite(file, f"{line}\n".encode(), at)
        finally:
            if file is not None:
                os.close(file)
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.overwrite and os.path.exists(self.path):
            old = f"{self.path}.old-{uuid.uuid4().hex}"
            os.rename(self.path, old)
            os.rename(self.growing, self.path)
            shutil.rmtree(old)
        else:
            os.rename(self.growing, self.path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.growing, ignore_errors=True)


class ReportFiles(DataSource):
    """``format("reportfiles")`` of ``scan_id, at, report`` with the option ``path``."""

    @classmethod
    def name(cls) -> str:
        return "reportfiles"

    def writer(self, schema: StructType, overwrite: bool) -> ReportFilesWriter:
        return ReportFilesWriter(self.options["path"], overwrite)


def report_file(scan_id: str | None) -> str:
    """The name of a scan's file; long names end with a digest."""
    name = quote(scan_id or "", safe=" ")
    return f"{name if len(name) < 200 else name[:150] + '-' + hashlib.sha256(name.encode()).hexdigest()}.jsonl"


def write_report_files(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    """Every scan's report as one file below ``path``, a folder that all machines mount.

    Running sums of the lines' lengths say where each line goes, so tasks write their parts of a
    long report side by side and hold one line at a time. ``lines`` comes from ``report.report``.
    """
    spark = lines.sparkSession
    spark.dataSource.register(ReportFiles)
    columns, levels = blocks_of("report_pos")
    stored = materialize(lines.select("scan_id", "report_pos", "report", *columns))
    placed = running_sum(stored, ["scan_id"], levels, ["report_pos"], F.octet_length("report") + 1, "at")
    rows = placed.select("scan_id", F.col("at").cast("long").alias("at"), "report")
    path = "/" + path.removeprefix("file:").lstrip("/")
    rows.write.format("reportfiles").option("path", path).mode("overwrite" if overwrite else "append").save()


def write_findings(rows: DataFrame, path: str) -> None:
    """Findings as parquet, each scan in report order."""
    rows.sortWithinPartitions("scan_id", "report_pos").write.parquet(path)
