import os
import subprocess
import sys
from urllib.parse import urlparse

from auditspark.session import intermediate_tables, materialize, tune


def test_tables_of_a_run_go_with_it(spark):
    with intermediate_tables(spark) as folder:
        kept = materialize(spark.range(10))
        assert kept.count() == 10 and len(os.listdir(urlparse(folder).path)) == 1
    assert not os.path.exists(urlparse(folder).path)
    assert materialize(spark.range(3)).count() == 3


def test_shuffles_are_sized_by_input(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        tune(spark, input_bytes=1 << 40)
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) == 8192
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_python_stages_run_from_another_folder(tmp_path):
    """The package is found by its place, not by the folder a session was started in."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = (
        "from pyspark.sql import SparkSession\n"
        "from auditspark.operators.extract_py import python_facts\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "rows = [('s', 'a.py', bytearray(b'def f(): pass'), None)]\n"
        "files = spark.createDataFrame(rows, 'scan_id string, path string, content binary, read_error string')\n"
        "assert python_facts(files).first()['functions'][0]['name'] == 'f'\n"
    )
    done = subprocess.run(
        [sys.executable, "-c", script], cwd=tmp_path, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
