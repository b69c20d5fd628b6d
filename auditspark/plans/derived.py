"""Inputs of the stages, derived row by row from the given tables.

The given tables hold neither source code nor model replies. Each function below turns every row of
a table into one input row of a stage, by plain expressions that ``oracles`` states again in SQL.
One scan, ``hot``, receives a third of the rows.
"""

import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditspark.session import durable_folder, materialize


ROWS_PER_TASK = 10_000
# Files of many statements each: tasks of seconds, so that cores end together.
WORD_FILES_PER_TASK = 2_000


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = True) -> DataFrame:
    """A given table, spread over all cores where its rows lie in fewer partitions than there are cores.

    Partitions are counted by their rows: a file has as many as its bytes make, but all rows of a row
    group are in one of them. A table whose rows lie evenly is left as it is, and so is one that the
    next step shuffles anyway (``spread=False``).
    """
    frame = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if not spread:
        return frame
    cores = spark.sparkContext.defaultParallelism
    # Without columns only the footers are read.
    held = frame.groupBy(F.spark_partition_id()).count().agg(F.sum("count").alias("n"), F.max("count").alias("most")).first()
    if not held["n"] or held["most"] * cores <= 2 * held["n"]:
        return frame
    return frame.repartition(max(cores, -(-held["n"] // ROWS_PER_TASK)))


def _pick(key: Column, values: list[str]) -> Column:
    """The value at position ``key`` modulo the number of values."""
    return F.get(F.array(*[F.lit(value) for value in values]), F.pmod(key, F.lit(len(values))))


# --- findings, from lineitem --------------------------------------------------------------------

def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem", spread=False)
    # Lines of one order with one number are few; their order makes the number unique.
    twin = F.row_number().over(
        Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity")
    )
    seq = (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + twin
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    scan = F.when(supp % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (supp % 10).cast("string")))
    title = (
        F.when(line == 7, "").when(line == 6, "Untitled finding").when(line == 5, " ")
        .otherwise(F.concat(F.lit("Issue "), line.cast("string")))
    )
    severity = F.concat("l_returnflag", "l_linestatus")
    return items.select(
        scan.alias("scan_id"),
        seq.alias("seq"),
        F.format_string("GG-%03d", seq).alias("id"),
        F.concat(F.lit("ASI0"), (part % 9 + 1).cast("string")).alias("owasp_id"),
        title.alias("title"),
        F.repeat(F.lit("d"), (F.lit(5) + part % 36).cast("int")).alias("description"),
        F.when(severity == "AF", "critical").when(severity == "NO", "high")
        .when(F.col("l_linestatus") == "F", "medium").otherwise("low").alias("severity"),
        F.concat(F.lit("src/f"), (part % 200).cast("string"), F.lit(".py")).alias("file"),
        F.when(supp % 4 == 1, F.lit(0)).when(supp % 4 > 1, F.col("l_quantity").cast("bigint"))
        .cast("bigint").alias("line"),
        F.concat(
            F.lit("Step one\n\n  step "), line.cast("string"),
            F.lit("\t\n \u00a0\nlast\u3000"),
        ).alias("remediation"),
    )


def scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scans of ``findings``, and one that found nothing."""
    made = table(spark, sf_dir, "supplier").select(
        F.when(F.col("s_suppkey") % 3 == 0, "hot")
        .otherwise(F.concat(F.lit("s"), (F.col("s_suppkey") % 10).cast("string"))).alias("scan_id")
    )
    quiet = table(spark, sf_dir, "region").select(
        F.concat(F.lit("quiet"), F.col("r_regionkey").cast("string")).alias("scan_id")
    )
    return made.distinct().unionByName(quiet)


# --- replies, from events -----------------------------------------------------------------------

ONE = (
    '{"owasp_id":"ASI01","title":"T%k","description":"User text of %k reaches the prompt",'
    '"severity":"high","file":"f%u.py","line":%k,"remediation":"Check %k"}'
)
TWO = '{"owasp_id":"ASI06","title":"D","description":"short","severity":"low","line":"1_0.0"}'
REPLIES = [
    "[" + ONE + "," + TWO + "]",
    "Sure:\n```json\n[" + ONE + "]\n```\nDone.",
    "<think>Maybe [1] or {x}</think>\n  [" + TWO + "]  ",
    "Found these: [" + ONE + "] as asked.",
    "[]",
    "[" + ONE + ",{\"title\":",
    "[" + ONE + "] and [" + ONE + "]",
    "[{},{\"title\":\"Only %k\",\"title\":\"Last %k\"}]",
    "[{\"title\":null},{\"file\":7},{\"description\":[1]},{\"line\":null}]",
    "[{\"severity\":\"HIGH\"},{\"severity\":3},{\"severity\":null},{\"severity\":\"critical\"}]",
    "[\"x\",5,null,[1]," + ONE + "]",
    "{\"a\":1,\"b\":\"%k\"}",
    "```\n{\"findings\":[" + TWO + "," + ONE + "]}\n```",
    "\"done\"",
    "No problems in %k.",
    "17",
    "[{\"line\":42.0},{\"line\":42.5},{\"line\":\" 42 \"},{\"line\":\"42.0\"},{\"line\":\"4e1\"},{\"line\":true},"
    "{\"line\":\"+5\"},{\"line\":\"1_000\"},{\"line\":\"\"},{\"line\":\"0x10\"},{\"line\":[1]},{\"line\":1e2}]",
    "[" + ONE + ",]",
]


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    event, user = F.col("event_id"), F.col("user_id")
    number, owner = event.cast("string"), user.cast("string")
    template = _pick(event, REPLIES)
    lost = F.col("event_type").isin("error", "view") & (user % 50 == 14) & (event % 6 == 5)
    status = F.when(lost, "connect_error").when(event % 25 == 11, "error").otherwise("ok")
    return events.select(
        F.when(event % 3 == 0, "hot").otherwise(F.col("event_type")).alias("scan_id"),
        F.concat(F.lit("agents/e"), F.lpad(number, 12, "0"), F.lit(".py")).alias("path"),
        event.alias("file_order"),
        status.alias("status"),
        F.when(
            status == "ok",
            F.replace(F.replace(template, F.lit("%k"), number), F.lit("%u"), owner),
        ).alias("raw"),
        F.when(status != "ok", F.concat(F.lit("call failed for "), number)).alias("detail"),
    )


# --- files and directories, from documents -------------------------------------------------------

DIRECTORIES = [
    "src/", "src/agents/", "node_modules/lib/dist/", ".hidden/", "build/",
    "public/", "Build/", "", "app/.venv/x/", "lib/vendor/",
]
SUFFIXES = [".py", ".js", ".ts", ".mjs", ".PY", ".txt", ".tsx", ".py"]
MARKERS = [
    "from langgraph.graph import StateGraph\n",
    "@tool\n",
    "import { tool } from \"@langchain/core/tools\";\n",
    "", "", "",
]


def _document_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    doc = F.col("doc_id")
    number = doc.cast("string")
    slot = F.floor(doc / 20)
    stem = F.when(doc % 23 == 0, "").when(doc % 19 == 0, "__init__").when(doc % 17 == 0, ".f").otherwise(
        F.concat(F.lit("f"), number)
    )
    scan = F.when(doc % 3 == 0, "hot").otherwise(F.col("source"))
    rel = F.concat(
        _pick(slot, DIRECTORIES), F.lit("d"), number, F.lit("/"), stem,
        _pick(F.floor(doc / 7), SUFFIXES),
    )
    return documents.select("*", scan.alias("scan_id"), rel.alias("rel_path"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = F.col("doc_id")
    unmarked = F.col("source").isin("src4", "src5") & (F.col("scan_id") != "hot")
    marker = F.when(unmarked, "").otherwise(_pick(doc, MARKERS))
    pin = F.when(
        doc % 13 == 0,
        F.concat(
            F.lit('\nNEEDS = ["langchain-community==0.2.5", "langgraph==1.'),
            (doc % 5).cast("string"), F.lit('.9", \'LangChain_Core==1.1\', "@langchain/core@1.0.3"]\nuser_token: str\n'),
        ),
    ).otherwise("")
    content = F.concat(marker, "text", pin).cast("binary")
    return _document_columns(spark, sf_dir).select(
        "scan_id",
        F.concat(F.lit("/repos/"), "scan_id", F.lit("/"), "rel_path").alias("path"),
        "rel_path",
        F.when(doc % 29 == 0, F.concat(F.lit(b"\xff\xfe\x80"), content)).otherwise(content).alias("content"),
        F.when(doc % 31 == 0, "permission denied").alias("read_error"),
    )


def source_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``scans(scan_id, target_path)`` of real trees below the shared folder that hold ``files``.

    Tasks write the files. One that is to be unreadable becomes a link to nowhere. A task that runs
    again puts the same files into the same places.
    """
    root = f"{durable_folder(spark).rstrip('/').removeprefix('file:')}/auditspark/tree-{uuid.uuid4().hex}"
    if not root.startswith("/"):
        raise RuntimeError("source trees need a shared folder that all machines mount")
    root = "/" + root.lstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                path = os.path.join(root, row["scan_id"], row["rel_path"])
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{uuid.uuid4().hex}"
                if row["content"] is None or row["read_error"] is not None:
                    os.symlink("/nowhere/at/all", part)
                else:
                    with open(part, "wb") as stream:
                        stream.write(row["content"])
                os.replace(part, path)
            yield batch.select(["scan_id"])

    written = files(spark, sf_dir).select("scan_id", "rel_path", "content", "read_error").mapInArrow(write, "scan_id string")
    scans = written.groupBy("scan_id").agg(F.count("*").alias("n_files"))
    return materialize(scans.select("scan_id", F.concat(F.lit(f"{root}/"), "scan_id").alias("target_path")))


def dirs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directory of every file; directories above it carry no further names."""
    columns = _document_columns(spark, sf_dir)
    return columns.select("scan_id", F.regexp_replace("rel_path", r"/[^/]*$", "").alias("rel_path"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans of ``files`` with a target each, and some whose target does not exist."""
    made = _document_columns(spark, sf_dir).select("scan_id").distinct()
    gone = table(spark, sf_dir, "region").select(F.concat(F.lit("gone-"), "r_name").alias("scan_id"))
    return made.unionByName(gone).select(
        "scan_id", F.concat(F.lit("/repos/"), "scan_id").alias("target_path")
    )


# --- Python files, from part ---------------------------------------------------------------------

def python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    number = key.cast("string")

    def block(condition: Column, *lines) -> Column:
        pieces = [part for line in lines for part in (*line, "\n")]
        text = F.concat(*[F.lit(piece) if isinstance(piece, str) else piece for piece in pieces])
        return F.when(condition, text).otherwise("")

    content = F.concat(
        block(
            F.lit(True),
            ("import os",),
            ("from langgraph.graph import StateGraph, END",),
            ("LABEL = '", F.col("p_name"), " / ", F.col("p_brand"), " / ", F.col("p_type"), "'"),
            ("model = load_model(LABEL, ", size, ")",),
        ),
        block(
            key % 5 != 0,
            ("class State", number, "(TypedDict):"),
            ("    user_token: str",),
            ("@tool",),
            ("def run_sql_", number, "(query, /, limit, *rest, depth=", size, "):"),
            ("    prompt = 'Answer: ' + user_input",),
            ("    llm_output = model.invoke(prompt)",),
            ("    result = execute(clean(llm_output))",),
            ("    return eval(limit)",),
        ),
        block(
            key % 3 == 0,
            ("def delete_rows_", number, "(table):"),
            ("    ", F.when(key % 2 == 0, "require_admin").otherwise("pass_through"), "(table)"),
            ("    return drop(f'remove every row from {table}')",),
        ),
        block(
            key % 4 == 0,
            ("saver = MemorySaver()",),
            ("app = graph.compile(", F.when(key % 8 == 0, "checkpointer=saver").otherwise(""), ")"),
        ),
        block(key % 11 == 0, ("def broken(",)),
        # What flows on over several steps, and a function that the guard of another one does not cover.
        block(
            (key % 5 != 0) & (key % 7 == 0) & (key % 11 != 0),
            ("asked = user_message",),
            ("copied = asked",),
            ("system_prompt = copied",),
            ("copied = 'fixed'",),
            ("late_prompt = copied",),
            ("def purge_", number, "(row):"),
            ("    spare = row",),
            ("    reply = model_reply",),
            ("    passed = reply",),
            ("    return exec(spare, passed)",),
        ),
    )
    scan = F.when(key % 3 == 0, "hot").otherwise(F.col("p_brand"))
    return parts.select(
        scan.alias("scan_id"),
        F.concat(F.lit("/repos/"), scan, F.lit("/p"), number, F.lit(".py")).alias("path"),
        F.lit(".py").alias("ext"),
        content.cast("binary").alias("content"),
        F.lit(None).cast("string").alias("read_error"),
    )


def answers(asked: DataFrame) -> DataFrame:
    """A reply to every asked file but those whose number is divisible by 7: one finding about the file."""
    number = F.regexp_extract("path", r"(\d+)\.py$", 1).cast("bigint")
    finding = (
        '[{"owasp_id":"ASI01","title":"T","description":"User text reaches the prompt","severity":"high","file":"%p","line":1}]'
    )
    return asked.filter(number % 7 != 0).select(
        "scan_id", "path", F.lit("ok").alias("status"), F.replace(F.lit(finding), F.lit("%p"), F.col("path")).alias("raw"),
        F.lit(None).cast("string").alias("detail"),
    )


def word_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file per document, with one assignment per word of its text.

    Reading a file costs far more than counting words, so rows are dealt evenly over many tasks, and
    only their counts move.
    """
    documents = table(spark, sf_dir, "documents", spread=False)
    tasks = max(spark.sparkContext.defaultParallelism, -(-documents.count() // WORD_FILES_PER_TASK))
    counted = documents.select("source", "doc_id", F.size(F.split("text", " ")).alias("words")).repartition(tasks)
    content = F.concat(F.lit("def f(a):\n    pass\n"), F.repeat(F.lit("x = y\n"), F.col("words")))
    return counted.select(
        F.col("source").alias("scan_id"),
        F.concat(F.lit("/repos/d"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"),
        content.cast("binary").alias("content"),
        F.lit(None).cast("string").alias("read_error"),
    )


# --- JavaScript files, from supplier and customer -------------------------------------------------

# Code over several lines and several constructs on one, beside comments and literals that look like code.
JS_BLOCK = """// don't stop (here
/* block ( comment
   call(2) function ghost() {
*/
const odd = /[(]/.test(label);
const prompt = `first line of a system prompt
second ${label} line that is quite long`;
function spread(
  input,
  depth = 2,
) {
  return eval(input);
}
const first = 1, second = (x) => x;
function line(x) { const y = wrap(x); y.z = 2; return y; }
step(1).then(go)
  .catch(stop);
if (ok) /[(]/.test(label);
handle = async (x) => go(x);
const deep = [[[[[[[[[[[[[[[[[[[[inner(1)]]]]]]]]]]]]]]]]]]]];
const tail = `a ${first ? `b ${probe(label)} c` : "}"} and a tail longer than twenty`;
const spaced =                              /[)]/;
const reply = state.modelReply;
const passed = reply;
send({ body: passed });
"""
# What only one of the two languages has: type parameters, or text between tags.
TYPED_BLOCK = """const same = <T>(x: T): T => x;
function wide<T extends Array<Map<string, U>>>(x: T) { probe(x); }
"""
TAGGED_BLOCK = """const view = <p title="a title longer than twenty">don't ( {show(label)}</p>;
// no more
"""


def js_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(
        F.lit("js").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")
    )
    customers = table(spark, sf_dir, "customer").select(
        F.lit("ts").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name")
    )
    owners = suppliers.unionByName(customers)
    key, number, name = F.col("key"), F.col("key").cast("string"), F.col("name")
    typed = F.when(F.col("kind") == "ts", ": string").otherwise("")
    content = F.concat(
        F.lit('import { StateGraph } from "@langchain/langgraph";\nimport {\n  tool,\n} from \'@langchain/core\';\n'),
        F.lit("// comment with call(1) and ( open\n"),
        F.lit('const label = "owner of this file: '), name, F.lit('";\n'),
        F.lit("class Node"), number, F.lit(" extends base.Node {\n"),
        F.lit("  run(state) {\n    return step(state);\n  }\n}\n"),
        F.lit("async function runCommand"), number, F.lit("(input"), typed, F.lit(", { a, b }, limit = max(1, 2), ...rest) {\n"),
        F.lit("  const rawLlmOutput = state.llmOutput;\n"),
        F.lit("  total += 1;\n  total = add(total, "), number, F.lit(");\n"),
        F.lit("  return { content: rawLlmOutput, value: eval(input) };\n}\n"),
        F.lit("const pick = (a"), typed, F.lit(", b) => a + b;\nlet one = item => item;\nvar old = 1;\nlet later;\n"),
        F.when(key % 2 == 0, F.lit("const memory = new MemorySaver();\nconst app = graph.compile({ checkpointer: memory });\n")).otherwise(""),
        F.when(key % 5 == 0, F.lit("const text = `a template literal of ${label} that goes on and on`;\n")).otherwise(""),
        F.lit(JS_BLOCK),
        F.when(F.col("kind") == "ts", TYPED_BLOCK).otherwise(TAGGED_BLOCK),
        F.when(key % 13 == 0, F.lit("function broken(\n")).when(key % 17 == 0, F.lit("const bad = 1 +;\n"))
        .when(key % 19 == 0, F.lit("x = ([)];\n")).when(key % 23 == 0, F.lit("const = 3;\n"))
        .when(key % 29 == 0, F.lit("function () {}\n")).otherwise(""),
    )
    scan = F.when(key % 3 == 0, "hot").otherwise(F.concat(F.lit("js"), (key % 7).cast("string")))
    return owners.select(
        scan.alias("scan_id"),
        F.concat(F.lit("/repos/"), scan, F.lit("/n"), number, F.lit("."), "kind").alias("path"),
        F.concat(F.lit("."), "kind").alias("ext"),
        content.cast("binary").alias("content"),
        F.lit(None).cast("string").alias("read_error"),
        "key", "kind",
    )


# --- inventories, from part; model choices, from orders --------------------------------------------

PACKAGES = [
    "langgraph", "LangChain_Core", "langchain-community", "langgraph.checkpoint-sqlite", "requests", "langchain-core",
]
VERSIONS = [
    "1.2.6", "1.2", "1.2.6+local.9", "1.2rc1", "", "abc", "0.2.5", "1.1.9", "3.0.0", "v2", "1.%s.%k",
    "1.2.00%k" + "7" * 60, "0" * 50 + "1.1.9"]


def inventories(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    version = F.replace(
        F.replace(_pick(F.floor(key / 6), VERSIONS), F.lit("%s"), F.col("p_size").cast("string")),
        F.lit("%k"), key.cast("string"),
    )
    return table(spark, sf_dir, "part").select(
        F.when(key % 3 == 0, "hot").otherwise(F.col("p_brand")).alias("scan_id"),
        _pick(key, PACKAGES).alias("package"),
        F.when(key % 41 != 0, version).alias("version"),
    )


def inventory_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = inventories(spark, sf_dir).select("scan_id").distinct()
    quiet = table(spark, sf_dir, "nation").select(F.col("n_name").alias("scan_id"))
    return made.unionByName(quiet)


def model_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    choice = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "reasoning")
        .when(F.col("o_orderpriority") == "2-HIGH", "fast")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "turbo")
    )
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order"), F.col("o_orderkey").cast("string")).alias("scan_id"),
        choice.alias("model"),
    )
