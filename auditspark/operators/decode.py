"""Model replies: which of them count, and the findings inside.

Decoding turns responses into one table of items. Numbering, findings, rejects and counts all read
that table, so it is written once and the texts of the replies are parsed once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark import fixed_values as V
from auditspark import schemas
from auditspark.functions.reply import STEPS, beyond_numbers, items, strict_json, whole_number
from auditspark.operators.joins import BROADCAST_ROWS, attach
from auditspark.operators.numbering import blocks_of, running_sum
from auditspark.session import materialize

_TEXT_FIELDS = ("owasp_id", "title", "description", "file", "remediation")


def envelope_text(responses: DataFrame, body: str = "body") -> DataFrame:
    """Add ``raw``, the reply text inside a chat-completion envelope."""
    envelope = F.try_parse_json(body)
    return responses.withColumn("raw", F.try_variant_get(envelope, V.REPLY_PATH, "string"))


def before_connection_loss(responses: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Responses of each scan up to, and without, its first lost connection."""
    lost = responses.filter(F.col("status") == "connect_error")
    cut = materialize(lost.groupBy("scan_id").agg(F.min("file_order").alias("cut")))
    kept = attach(responses, cut, ["scan_id"], ["path"], max_rows=max_rows)
    return kept.filter(F.col("cut").isNull() | (F.col("file_order") < F.col("cut"))).drop("cut")


def answered(responses: DataFrame) -> DataFrame:
    return responses.filter(F.col("status") == "ok")


def call_rejects(responses: DataFrame) -> DataFrame:
    """Calls that failed for their own file only."""
    failed = responses.filter((F.col("status") != "ok") & (F.col("status") != "connect_error"))
    return failed.select(
        "scan_id", "path", F.lit(None).cast("bigint").alias("seq"), F.lit("call").alias("stage"),
        F.col("status").alias("reason"), F.col("detail").alias("payload"),
    )


def parse_replies(responses: DataFrame) -> DataFrame:
    """Add to each answered response its ``items``, or the reason why it has none."""
    read = answered(responses).withColumn("text", F.col("raw"))
    for step in STEPS:
        read = read.withColumn("text", step(F.col("text")))
    error = F.when(F.col("value").isNull(), F.lit("not_json")).when(
        F.col("items").isNull(), F.lit("not_iterable")
    )
    return (
        read.withColumn("value", strict_json(F.col("text")))
        .withColumn("items", items(F.col("value"), F.col("text")))
        .withColumn("reply_error", error)
        .drop("value")
    )


def explode_items(parsed: DataFrame) -> DataFrame:
    """One row per item with its position; a reply without items keeps one row without position."""
    return parsed.select(
        "scan_id", "path", "file_order", "reply_error",
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"),
        F.when(F.col("reply_error").isNotNull(), F.col("raw")).alias("reply"),
        F.posexplode_outer("items").alias("pos", "item"),
    )


def typed_items(exploded: DataFrame) -> DataFrame:
    """Items as finding columns, with ``item_error`` where an item is not a finding.

    A missing key takes its default; a key that is there must have the right type, and JSON null
    has the right type only for ``line``. A line number of more than 38 digits is left out, its finding stays.
    """
    keys = (*_TEXT_FIELDS, "severity", "line")
    members = exploded.select(
        "*", *[F.try_variant_get("item", f"$.{key}", "variant").alias(f"_{key}") for key in keys]
    )
    kinds = members.select(
        *exploded.columns,
        F.schema_of_variant("item").alias("_kind"),
        *[F.schema_of_variant(f"_{key}").alias(f"_{key}_kind") for key in keys],
        *[
            F.coalesce(F.try_variant_get(f"_{key}", "$", "string"), F.lit(default)).alias(key)
            for key, default in V.DEFAULTS.items()
        ],
        whole_number(F.col("_line")).alias("line"),
        beyond_numbers(F.col("_line")).alias("_beyond"),
    )

    def wrong(name: str) -> Column:
        return F.coalesce(F.col(f"_{name}_kind") != "STRING", F.lit(False))

    error = F.when(~F.startswith("_kind", F.lit("OBJECT")), F.lit("not_an_object"))
    unknown = ~F.col("severity").isin(*V.SEVERITY_RANK)
    error = error.when(wrong("severity") | unknown, F.lit("bad_severity"))
    for name in _TEXT_FIELDS:
        error = error.when(wrong(name), F.lit(f"bad_{name}"))
    no_number = (
        F.col("line").isNull() & (F.coalesce("_line_kind", F.lit("VOID")) != "VOID") & ~F.col("_beyond")
    )
    error = error.when(no_number, F.lit("bad_line"))
    payload = F.coalesce(F.col("item").cast("string"), F.col("reply"))

    return kinds.select(
        "scan_id", "path", "file_order", "reply_error", "n_items", "pos",
        F.when(F.col("pos").isNotNull(), error).alias("item_error"),
        *_TEXT_FIELDS, "severity", "line",
        F.when(F.col("reply_error").isNotNull() | error.isNotNull(), payload).alias("payload"),
    )


def decode_items(responses: DataFrame) -> DataFrame:
    """Items of all answered responses, typed and checked."""
    return typed_items(explode_items(parse_replies(responses)))


def is_finding():
    return F.col("pos").isNotNull() & F.col("item_error").isNull()


def item_offsets(items: DataFrame) -> DataFrame:
    """``scan_id, file_order, offset``: items in all earlier files of the scan."""
    once_per_reply = items.filter(F.coalesce("pos", F.lit(0)) == 0)
    blocks, levels = blocks_of("file_order")
    counts = once_per_reply.select("scan_id", "file_order", "n_items", *blocks)
    summed = running_sum(
        counts, ["scan_id"], levels, ["file_order"], F.col("n_items"), "offset"
    )
    return summed.select("scan_id", "file_order", "offset")


def number_items(items: DataFrame) -> DataFrame:
    """Add ``seq`` and ``id``; malformed items use up a number too. ``items`` is a stored table."""
    seq = F.col("offset") + F.col("pos") + 1
    numbered = items.filter(F.col("pos").isNotNull()).join(
        item_offsets(items), ["scan_id", "file_order"]
    )
    numbered = numbered.withColumn("seq", seq).drop("offset")
    return numbered.withColumn("id", F.format_string(V.FINDING_ID_FORMAT, "seq"))


def findings_of(numbered: DataFrame) -> DataFrame:
    return numbered.filter(is_finding()).select("scan_id", "path", "seq", *schemas.FINDING_FIELDS)


def item_rejects(numbered: DataFrame) -> DataFrame:
    return numbered.filter(F.col("item_error").isNotNull()).select(
        "scan_id", "path", "seq", F.lit("item").alias("stage"),
        F.col("item_error").alias("reason"), "payload",
    )


def reply_rejects(items: DataFrame) -> DataFrame:
    return items.filter(F.col("reply_error").isNotNull()).select(
        "scan_id", "path", F.lit(None).cast("bigint").alias("seq"), F.lit("reply").alias("stage"),
        F.col("reply_error").alias("reason"), "payload",
    )


def decode(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Findings and rejects of all responses; responses behind a lost connection give neither."""
    reached = before_connection_loss(responses)
    items = materialize(decode_items(reached))
    numbered = number_items(items)
    rejects = (
        call_rejects(reached)
        .unionByName(reply_rejects(items))
        .unionByName(item_rejects(numbered))
    )
    return findings_of(numbered), rejects


def findings_per_file(items: DataFrame) -> DataFrame:
    """Findings per answered file, and per scan in the rows whose ``path`` is NULL."""
    scan, path = F.col("scan_id"), F.col("path")
    per_file = items.groupBy(scan, path).agg(F.count_if(is_finding()).alias("n"))
    totals = per_file.groupingSets([[scan, path], [scan]], scan, path)
    return totals.agg(F.sum("n").alias("n_findings"))
