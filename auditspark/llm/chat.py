"""Conversations rebuilt from event logs, rendered with a loss mask, and read back.

A log has one row per event: ``conv_id``, ``message`` (any orderable value; messages of a
conversation stand in its order), ``seq`` (order of arrival), ``role``, ``kind``, ``text``.

- ``delta`` adds text to its message.
- ``edit`` replaces the message's text so far.
- ``regenerate`` discards the message's text so far; later deltas fill it again.

An edit and a regeneration also withdraw the later messages that had begun before it: they answered
something that is gone.

Messages are folded each on its own and rendered each on its own, so a conversation of any length
spreads over the cluster; only reading back needs its rows in order, and that streams.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<role>", "</role>")
CONTROLS = [mark for pair in [*MARKS.values(), OTHER] for mark in pair]
LEARNED_ROLE = "assistant"

_TO_ESCAPE = re.compile("|".join(re.escape(mark) for mark in CONTROLS) + r"|\\")
_ESCAPED = re.compile(r"\\(\\?)")
_TURN = re.compile(
    "|".join(f"{re.escape(first)}(?P<{role}>.*?){re.escape(last)}" for role, (first, last) in MARKS.items())
    + f"|{re.escape(OTHER[0])}(?P<name>.*?)\n(?P<other>.*?){re.escape(OTHER[1])}",
    re.DOTALL,
)


def escape(text: str) -> str:
    """A backslash goes behind the first character of every control string, and is doubled itself."""
    return _TO_ESCAPE.sub(lambda found: "\\\\" if found[0] == "\\" else found[0][0] + "\\" + found[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn as template text, and the bounds of what is learned from in it (equal if nothing is)."""
    if role in MARKS:
        first, last = MARKS[role]
    else:
        # A line end in a role would end it early; it is spelled by its escape.
        first, last = OTHER[0] + escape(role).replace("\n", "\\n"), OTHER[1]
        first += "\n"
    body = escape(text)
    learned = len(body) if role == LEARNED_ROLE else 0
    return first + body + last, len(first), len(first) + learned


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of rendered turns."""
    at = 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if found is None:
            raise ValueError(f"no turn at character {at}")
        if found["other"] is not None:
            yield unescape_role(found["name"]), unescape(found["other"])
        else:
            role = found.lastgroup
            yield role, unescape(found[role])
        at = found.end()


def unescape_role(name: str) -> str:
    return re.sub(r"\\(\\|n|)", lambda found: {"\\": "\\", "n": "\n", "": ""}[found[1]], name)


def fold(events: DataFrame) -> DataFrame:
    """``conv_id, message, role, text``: the messages that stand at the end of the log.

    Events of one ``seq`` count in order of kind and text; events that are equal in all columns
    count each. Null texts are empty, null kinds are deltas, unknown kinds are left out. The role is
    that of the message's first event that has one, else empty. Rows without ``conv_id`` make a
    conversation of their own name, null.
    """
    known = events.select(
        "conv_id",
        "message",
        "seq",
        "role",
        F.coalesce("kind", F.lit("delta")).alias("kind"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).filter(F.col("kind").isin("delta", "edit", "regenerate"))
    resets = F.col("kind") != "delta"
    parts = F.array_sort(F.collect_list(F.struct("seq", "kind", "text")))
    messages = known.groupBy("conv_id", "message").agg(
        parts.alias("parts"),
        F.min_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"),
        F.min("seq").alias("began"),
        F.max(F.when(resets, F.col("seq"))).alias("reset"),
    )
    changed = messages.filter("reset is not null").select(F.col("conv_id").alias("_conv")).distinct()
    narrow = messages.select("conv_id", "message", "began", "reset").join(
        changed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi"
    )
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    gone = (
        narrow.withColumn("_last", F.max("reset").over(before))
        .filter(F.col("_last") > F.col("began"))
        .select(F.col("conv_id").alias("_conv"), F.col("message").alias("_message"))
    )
    standing = messages.join(
        gone, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("message").eqNullSafe(F.col("_message")), "left_anti"
    )
    # The last reset is the last of its kind among the sorted parts; what stands before it is void.
    last = F.array_max(F.transform("parts", lambda part, at: F.when(part["kind"] != "delta", at)))
    valid = F.slice("parts", F.coalesce(last, F.lit(0)) + 1, F.size("parts") + 1)
    texts = F.transform(valid, lambda part: F.when(part["kind"] == "regenerate", "").otherwise(part["text"]))
    return standing.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.array_join(texts, "").alias("text"))


def formatted(messages: DataFrame) -> DataFrame:
    """``conv_id, message, formatted, learn_from, learn_to``: each message as a piece of its conversation.

    A conversation's text is its pieces in order of ``message``; the bounds of the loss mask are
    characters of the piece, equal where nothing is learned from it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            made = [render(role or "", text or "") for role, text in zip(roles, texts)]
            columns = [pa.array([turn[0] for turn in made], pa.string())]
            columns += [pa.array([turn[n] for turn in made], pa.int32()) for n in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("message"), *columns],
                ["conv_id", "message", "formatted", "learn_from", "learn_to"],
            )

    source = messages.select("conv_id", "message", "role", "text")
    kinds = {field.name: field.dataType.simpleString() for field in source.schema}
    shape = f"conv_id {kinds['conv_id']}, message {kinds['message']}, formatted string, learn_from int, learn_to int"
    return source.mapInArrow(run, shape)


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of every conversation, from its formatted pieces alone.

    ``n_turns``, ``turns_sha256`` over role, line end, text, line end of every turn, ``loss_chars``
    and ``loss_sha256`` over the unescaped text under the loss mask, ``formatted_chars``. A task
    reads its conversations in order and holds one piece at a time.
    """

    class Digest:
        def __init__(self, conv):
            self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, text: str, low: int, high: int) -> None:
            self.chars += len(text)
            for role, said in parse(text):
                self.turns += 1
                self.all.update(f"{role}\n{said}\n".encode())
            learned = unescape(text[low:high])
            self.loss_chars += len(learned)
            self.loss.update(learned.encode())

    def batch_of(done: list[Digest], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array([one.conv for one in done], kind),
                pa.array([one.turns for one in done], pa.int64()),
                pa.array([one.all.hexdigest() for one in done], pa.string()),
                pa.array([one.loss_chars for one in done], pa.int64()),
                pa.array([one.loss.hexdigest() for one in done], pa.string()),
                pa.array([one.chars for one in done], pa.int64()),
            ],
            ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kind = None, None
        for batch in batches:
            done, kind = [], batch.schema.field("conv_id").type
            columns = (batch.column(name).to_pylist() for name in ("conv_id", "formatted", "learn_from", "learn_to"))
            for conv, text, low, high in zip(*columns):
                if current is None or current.conv != conv:
                    done += [current] if current else []
                    current = Digest(conv)
                current.add(text, low, high)
            yield batch_of(done, kind)
        if current:
            yield batch_of([current], kind)

    laid = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "message")
    kind = dict(pieces.dtypes)["conv_id"]
    return laid.select("conv_id", "formatted", "learn_from", "learn_to").mapInArrow(
        run,
        f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def events_of_rows(rows: DataFrame) -> DataFrame:
    """A log that ends in the rows ``conv_id, turn, role, text``.

    Rows of one turn are messages of their own, in order of role and text; null turns come first. By
    a hash of its place a text is streamed in two deltas; or comes as a wrong draft that an edit puts
    right, after a reply to the draft had begun; or as a draft that is discarded and generated
    again in two deltas; or as a first half that is edited and then goes on.
    """
    tied = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    numbered = rows.select(
        "conv_id", "turn", F.row_number().over(tied).alias("copy"), "role", F.coalesce("text", F.lit("")).alias("text")
    )
    text = F.col("text")
    half = F.floor(F.char_length(text) / 2).cast("int")
    first, second = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.char_length(text))
    draft = F.concat(F.lit("draft: "), F.reverse(text))

    def event(step: int, kind: str, said: Column, reply: bool = False) -> Column:
        return F.struct(
            F.lit(step).alias("step"), F.lit(kind).alias("kind"), said.alias("text"), F.lit(int(reply)).alias("reply")
        )

    logs = [
        F.array(event(0, "delta", first), event(1, "delta", second)),
        F.array(event(0, "delta", draft), event(1, "delta", F.lit("a reply to a draft"), True), event(2, "edit", text)),
        F.array(
            event(0, "delta", draft), event(1, "regenerate", F.lit(None).cast("string")),
            event(2, "delta", first), event(3, "delta", second),
        ),
        F.array(event(0, "delta", draft), event(1, "edit", first), event(2, "delta", second)),
    ]
    which = F.pmod(F.xxhash64("conv_id", "turn", "copy"), F.lit(len(logs)))
    log = logs[0]
    for number, other in enumerate(logs[1:], 1):
        log = F.when(which == number, other).otherwise(log)
    return numbered.select("conv_id", "turn", "copy", "role", F.explode(log).alias("event")).select(
        "conv_id",
        F.struct("turn", "copy", F.col("event.reply").alias("reply")).alias("message"),
        F.struct("turn", "copy", F.col("event.step").alias("step")).alias("seq"),
        "role",
        F.col("event.kind").alias("kind"),
        F.col("event.text").alias("text"),
    )
