"""Prompts for the files worth analysing, and the replies they got."""

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import batched
from json.encoder import encode_basestring_ascii

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditspark import fixed_values as V
from auditspark import schemas
from auditspark.operators.facts import eligible
from auditspark.operators.joins import BROADCAST_ROWS, attach
from auditspark.operators.select import number_files
from auditspark.session import materialize
from auditspark.sources.tables import endpoints


def route(scans: DataFrame) -> DataFrame:
    """Scans with the endpoint of their model key; an unknown or absent key takes the default."""
    table = endpoints(scans.sparkSession)
    known = table.select(F.col("model_key").alias("model"), "model_key", "url", "model_name")
    default = next(row for row in V.ENDPOINTS if row[0] == V.DEFAULT_MODEL_KEY)
    # The endpoint table is a constant of two rows.
    routed = scans.join(F.broadcast(known), "model", "left")
    filled = dict(zip(("model_key", "url", "model_name"), default))
    return routed.select(
        "scan_id", "model",
        *[F.coalesce(name, F.lit(value)).alias(name) for name, value in filled.items()],
    )


# Characters that JSON in ASCII holds as they are.
_PLAIN = r"\A[ !#-\[\]-~]*\z"
# Files whose prompts are made at once.
_FILES = 256


def _in_order(*parts: str | pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(*parts, "")


def _quoted(texts: pa.Array) -> pa.Array:
    """JSON strings in ASCII; what lies behind the limit is left out."""
    texts = pc.utf8_slice_codeunits(texts, 0, V.PROMPT_LIMIT)
    made, plain = _in_order('"', texts, '"'), pc.match_substring_regex(texts, _PLAIN)
    if pc.all(plain).as_py() is not False:
        return made
    odd = pc.invert(plain)
    escaped = [encode_basestring_ascii(text) for text in texts.filter(odd).to_pylist()]
    return pc.replace_with_mask(made, odd, pa.array(escaped, pa.string()))


def _json(values: pa.Array, depth: int = 0) -> pa.Array:
    """Indented JSON of every value as it stands at a depth, each string whole up to the limit at least."""
    kind, inner, end = values.type, "\n" + "  " * (depth + 1), "\n" + "  " * depth
    if pa.types.is_list(kind):
        sizes = pc.list_value_length(values)
        offsets = pa.array([0], pa.int32()), pc.cumulative_sum(pc.fill_null(sizes, 0))
        items = pa.ListArray.from_arrays(pa.concat_arrays(offsets), _json(values.flatten(), depth + 1))
        made = _in_order(f"[{inner}", pc.binary_join(items, f",{inner}"), f"{end}]")
        made = pc.if_else(pc.equal(sizes, 0), "[]", made)
    elif pa.types.is_struct(kind):
        fields = [
            part for one, column in zip(kind, values.flatten())
            for part in (f'{inner}"{one.name}": ', _json(column, depth + 1), ",")
        ]
        made = _in_order("{", *fields[:-1], f"{end}}}")
        made = pc.if_else(values.is_valid(), made, None)
    elif pa.types.is_string(kind):
        made = _quoted(values)
    else:
        made = values.cast(pa.string())
    return pc.fill_null(made, "null")


def _prompts(documents: pa.StructArray) -> pa.Array:
    """The prompts of some files, their facts cut at the limit."""
    key = pc.fill_null(_quoted(documents.field("filepath")), '"null"')
    body = _in_order("{\n  ", key, ": ", _json(documents, 1), "\n}")
    cut = _in_order(pc.utf8_slice_codeunits(body, 0, V.PROMPT_LIMIT), V.PROMPT_CUT_MARK)
    return _in_order(V.PROMPT_PREAMBLE, pc.if_else(pc.greater(pc.utf8_length(body), V.PROMPT_LIMIT), cut, body))


@F.arrow_udf(T.StringType())
def _prompt_text(documents: pa.Array) -> pa.Array:
    some = [_prompts(documents.slice(at, _FILES)) for at in range(0, len(documents), _FILES)]
    return pa.concat_arrays(some) if some else pa.array([], pa.string())


def _least(kind: T.DataType, depth: int) -> int:
    """Characters of indented JSON that a value takes at least, unless it is absent."""
    if not isinstance(kind, T.StructType):
        return len('""') if isinstance(kind, T.StringType | T.ArrayType) else len("0")
    fields = (len(f'\n{"  " * (depth + 1)}"{one.name}": ') + _least(one.dataType, depth + 1) for one in kind)
    return len("{") + sum(fields) + len(",") * (len(kind) - 1) + len(f'\n{"  " * depth}}}')


def _before_cut(facts: DataFrame, kind: str) -> Column:
    """The facts of a kind without those that certainly lie behind the cut of a prompt."""
    between, whole = len('\n      ,'), _least(facts.schema[kind].dataType.elementType, 3)
    first, more = (F.slice(kind, 1, V.PROMPT_LIMIT // (between + least) + 1) for least in (whole, min(whole, len("null"))))
    return F.when(F.exists(first, lambda one: one.isNull()), more).otherwise(first).alias(kind)


def prompts(facts: DataFrame) -> DataFrame:
    """``scan_id, path, prompt`` for every eligible file.

    The length cut counts characters of indented JSON with ASCII escapes, which Spark's own JSON
    writer does not produce; the text is made in Arrow batches from rows that stay where they are,
    column by column. Facts that would certainly lie behind the cut are not handed over.
    """
    document = F.struct(F.col("path").alias("filepath"), *[_before_cut(facts, kind) for kind in schemas.FACT_TYPES])
    return eligible(facts).select("scan_id", "path", _prompt_text(document).alias("prompt"))


def route_prompts(
    prompts: DataFrame, scans: DataFrame, max_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """Prompts with the endpoint each is meant for."""
    routed = route(scans).drop("model")
    return attach(prompts, routed, ["scan_id"], ["path"], max_rows=max_rows)


def asked_files(facts: DataFrame) -> DataFrame:
    """``scan_id, path, file_order`` of the files that get a prompt, in path order."""
    return number_files(eligible(facts))


def requests(prompts: DataFrame, instructions: str) -> DataFrame:
    """``scan_id, path, url, body, deadline_s``: what a model server is sent for each routed prompt.

    ``body`` is the JSON of a chat request: model, messages (``instructions``, then the prompt),
    temperature and token limit. ``deadline_s`` is how long a call may take.
    """
    system = F.struct(F.lit("system").alias("role"), F.lit(instructions).alias("content"))
    user = F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))
    body = F.struct(
        F.col("model_name").alias("model"),
        F.array(system, user).alias("messages"),
        F.lit(V.TEMPERATURE).alias("temperature"),
        F.lit(V.REPLY_TOKENS).alias("max_tokens"),
    )
    return prompts.select(
        "scan_id", "path", "url", F.to_json(body).alias("body"), F.lit(V.CALL_SECONDS).alias("deadline_s")
    )


JOURNAL = "scan_id string, path string, digest string, raw string"


class Journal:
    """Answers of one task, written as they come, a small file for every few of them.

    Files lie in ``folder`` under the number of the partition, whose requests are the same in every
    attempt. A file appears under its name only when it is whole.
    """

    def __init__(self, folder: str, partition: int):
        self.files, root = fs.FileSystem.from_uri(folder)
        self.folder = f"{root.rstrip('/')}/{partition:06}"
        self.files.create_dir(self.folder, recursive=True)

    def answered(self) -> dict[tuple, str]:
        """What earlier attempts of the task were answered."""
        found = {}
        for one in self.files.get_file_info(fs.FileSelector(self.folder)):
            if one.path.endswith(".json"):
                with self.files.open_input_stream(one.path) as stream:
                    for line in stream.read().splitlines():
                        row = json.loads(line)
                        found[row["scan_id"], row["path"], row["digest"]] = row["raw"]
        return found

    def add(self, rows: list[dict]) -> None:
        if not rows:
            return
        name = f"{self.folder}/{uuid.uuid4().hex}"
        with self.files.open_output_stream(f"{name}.part") as stream:
            stream.write("".join(f"{json.dumps(row)}\n" for row in rows).encode())
        self.files.move(f"{name}.part", f"{name}.json")


def journaled(spark: SparkSession, journal: str) -> DataFrame:
    """``scan_id, path, digest, raw``: all answers that a journal holds, each once."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(journal)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)
    reader = spark.read.schema(JOURNAL).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    return reader.json(journal).dropDuplicates(["scan_id", "path", "digest"])


def ask(
    asked: DataFrame,
    make_client: Callable[[], Callable[[str, str, int], str]],
    tasks: int,
    threads: int = 1,
    journal: str | None = None,
) -> DataFrame:
    """Responses from a model, one call per row of :func:`requests`.

    Calls take long and rows are small, so rows are spread by count over ``tasks`` tasks, each with
    ``threads`` calls at a time. ``make_client`` runs once per task and returns a function of url,
    body and deadline that threads may share. A ``ConnectionError`` is a lost connection, any other
    exception a failed call; both become rows, and what they mean for a scan is decided later, in
    file order. Store the result: a task that runs again asks again.

    With ``journal``, the address of a shared folder (``file:///...`` or any other that Spark and
    Arrow both reach), answers are written there as they come. A task that runs again, or a later
    run with the same journal, asks only what no answer is known to; a request is the same if scan,
    path, url and body are. Failed calls are not written, so they are tried again.
    """
    needed = asked.select(
        "scan_id", "path", "url", "body", "deadline_s", F.md5(F.concat_ws("\n", "url", "body")).alias("digest")
    )
    known = folder = None
    if journal is not None:
        keys = ["scan_id", "path", "digest"]
        # What is known when the run starts; what its tasks add they read themselves.
        known = materialize(journaled(asked.sparkSession, journal).join(needed.select(keys), keys, "left_semi"))
        needed = needed.join(known.select(keys), keys, "left_anti")
        folder = f"{journal.rstrip('/')}/run-{uuid.uuid4().hex}"

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client, written, earlier = make_client(), None, {}
        if folder is not None:
            written = Journal(folder, TaskContext.get().partitionId())
            earlier = written.answered()

        def call(row: dict) -> tuple:
            status, raw, detail = "ok", None, None
            try:
                raw = client(row["url"], row["body"], row["deadline_s"])
            except ConnectionError as problem:
                status, detail = "connect_error", str(problem)
            except Exception as problem:
                status, detail = "error", str(problem)
            return row["scan_id"], row["path"], status, raw, detail

        rows = (row for batch in source for row in batch.to_pylist())
        with ThreadPoolExecutor(threads) as pool:
            for some in batched(rows, 4 * threads):
                keys = [(row["scan_id"], row["path"], row["digest"]) for row in some]
                made = [(*key[:2], "ok", earlier[key], None) for key in keys if key in earlier]
                fresh = [(key, row) for key, row in zip(keys, some) if key not in earlier]
                answers = list(pool.map(call, [row for _, row in fresh]))
                if written is not None:
                    written.add([
                        {"scan_id": key[0], "path": key[1], "digest": key[2], "raw": answer[3]}
                        for (key, _), answer in zip(fresh, answers) if answer[2] == "ok"
                    ])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(values, pa.string()) for values in zip(*made, *answers)],
                    names=["scan_id", "path", "status", "raw", "detail"],
                )

    answered = needed.repartition(tasks, "scan_id", "path").mapInArrow(run, schemas.RESPONSES)
    if known is None:
        return answered
    none = F.lit(None).cast("string").alias("detail")
    return answered.unionByName(known.select("scan_id", "path", F.lit("ok").alias("status"), "raw", none))


def match_responses(asked: DataFrame, responses: DataFrame) -> DataFrame:
    """The response to each file of ``asked(scan_id, path, file_order)``.

    ``responses(scan_id, path, status, raw, detail)`` has one row per prompt; a file without one
    counts as a failed call. Both sides are unique by scan and path, so no key is hot, and the texts
    of the prompts take no part.
    """
    given = responses.select("scan_id", "path", "status", "raw", "detail")
    matched = asked.select("scan_id", "path", "file_order").join(given, ["scan_id", "path"], "left")
    return matched.withColumn("status", F.coalesce("status", F.lit("error"))).withColumn(
        "detail", F.when(F.col("status") != "ok", F.coalesce("detail", F.lit("no response")))
    )
