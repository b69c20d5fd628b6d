"""Evidence screens: one per vector, each a query over facts or lines.

A screen yields candidate findings, not proof. What it looks for is this module's own definition;
the vectors are the ones findings may name. Facts of one file sit in one row, so every condition is
one on the arrays of a row and moves no data. Only the screens for secrets and for pins read texts.
Screens read facts several times and expect them as a stored table.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark import fixed_values as V
from auditspark.operators import supply
from auditspark.operators.facts import fact_rows
from auditspark.operators.joins import positions

USER_INPUT = r"(?i)user_?(?:input|query|message|request)|raw_?input"
SINK_NAME = r"(?i)execute|command|sql|shell"
EVAL_CALL = r"^(?:eval|exec)\(\s*(\w+)"
SECRET_WORD = r"(?i)token|password|secret|api_?key"
SECRET_FIELD = r"(?i)^\s*[\"']?(\w*(?:token|password|secret|api_?key)\w*)[\"']?\s*:\s*[^\s:]"
DESTRUCTIVE_NAME = r"(?i)^(?:delete|drop|remove|purge|wipe|truncate|destroy)"
AUTHORISATION = (
    r"(?i)authori[sz]e|require_?(?:admin|role|permission|scope)|check_?(?:permission|access|role)"
    r"|has_?(?:permission|role|scope)"
)
MODEL_OUTPUT = r"(?i)(?:llm|model)_?(?:output|response|result|reply)"
SAVER = r"^(?:new )?(?:Memory|Sqlite|Postgres)Saver\b"
PERSISTING_COMPILE = r"(?s)compile\(.*checkpointer"

# vector -> title, severity, remediation
VERDICTS = {
    "ASI01": ("User input reaches a prompt", "high", "Separate instructions from user text."),
    "ASI02": ("Tool accepts unchecked input", "high", "Validate arguments against an allow list."),
    "ASI03": ("Secret field in shared state", "medium", "Keep secrets out of the state."),
    "ASI05": ("Dependency with a known advisory", "high", "Raise the pinned version."),
    "ASI06": ("Destructive operation without authorisation", "critical", "Check the caller first."),
    "ASI07": ("Model output passed on unchecked", "high", "Validate output before using it."),
    "ASI08": ("State persisted without validation", "medium", "Validate state before it is saved."),
}


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_like(text, F.lit(pattern))


def _candidates(rows: DataFrame, vector: str, line: Column, evidence: Column) -> DataFrame:
    title, severity, remediation = VERDICTS[vector]
    return rows.select(
        "scan_id", F.lit(vector).alias("owasp_id"), F.lit(title).alias("title"),
        F.concat(F.lit(f"{title}: "), evidence).alias("description"),
        F.lit(severity).alias("severity"), F.col("path").alias("file"),
        line.cast("bigint").alias("line"), F.lit(remediation).alias("remediation"),
    )


def lines_of(texts: DataFrame) -> DataFrame:
    """``scan_id, path, ext, lineno, line`` of ``texts(scan_id, path, ext, text)``."""
    rows = positions(texts, ["scan_id", "path", "ext"], F.split("text", "\n"), "at", "line")
    return rows.select("scan_id", "path", "ext", (F.col("at") + 1).alias("lineno"), "line")


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _names_in(code: Column) -> Column:
    """Names in a piece of code, with members and without; literals that hold no code do not count."""
    bare = F.regexp_replace(code, r"\"[^\"{}\\]*+\"|'[^'{}\\]*+'", "''")
    dotted = F.regexp_extract_all(bare, F.lit(r"([A-Za-z_$][\w$]*+(?:\.[A-Za-z_$][\w$]*+)*+)"), 1)
    return F.array_union(dotted, F.transform(dotted, lambda name: F.substring_index(name, ".", 1)))


# Steps of one line take effect in this order.
_BOUND, _USED, _ASSIGNED = 0, 1, 2


def _step(lineno: Column, order: int, at: Column, targets: Column, words: Column, soiled: Column, report: Column) -> Column:
    return F.struct(
        lineno.alias("lineno"), F.lit(order).alias("order"), at.alias("at"), targets.alias("targets"),
        words.alias("words"), soiled.alias("soiled"), report.alias("report"),
    )


def _assigned(soils, reports) -> Column:
    """A step for every assignment: does it soil its targets by itself, is it reported where they are soiled?"""
    return F.transform(
        "assignments",
        lambda one, at: _step(one["lineno"], _ASSIGNED, at, one["targets"], _names_in(one["value"]), soils(one), reports(one)),
    )


def _used(uses: Column) -> Column:
    """A step for every use ``name, lineno`` of a name, reported where the name is soiled."""
    return F.transform(
        uses,
        lambda use, at: _step(
            use["lineno"], _USED, at, F.array(use["name"]), F.array(use["name"]), F.lit(False), F.lit(True)
        ),
    )


def _flowing(steps: Column) -> Column:
    """``lineno, name`` of the reported steps that something soiled reaches, following the lines of a file.

    A fold over the steps carries the names that are soiled. An assignment from a soiled name soils
    its targets, any other one cleans them; a use changes nothing.
    """
    start = F.struct(_none("string").alias("names"), _none("struct<lineno: int, name: string>").alias("found"))

    def follow(done: Column, step: Column) -> Column:
        reached = step["soiled"] | F.arrays_overlap(step["words"], done["names"])
        names = F.when(step["order"] == _USED, done["names"]).when(
            reached, F.array_union(done["names"], step["targets"])
        ).otherwise(F.array_except(done["names"], step["targets"]))
        hit = F.array(F.struct(step["lineno"].alias("lineno"), F.get(step["targets"], F.lit(0)).alias("name")))
        found = F.when(reached & step["report"], F.concat(done["found"], hit)).otherwise(done["found"])
        return F.struct(names.alias("names"), found.alias("found"))

    return F.aggregate(F.sort_array(steps), start, follow, lambda done: done["found"])


def _hits(rows: DataFrame, steps: Column) -> DataFrame:
    found = positions(rows, ["scan_id", "path"], _flowing(steps), item="hit")
    return found.select("scan_id", "path", "hit.lineno", "hit.name")


def prompt_injection(facts: DataFrame) -> DataFrame:
    """A prompt variable is built from user input, directly or by way of other variables."""

    def soils(one: Column) -> Column:
        return _matches(one["value"], USER_INPUT)

    def prompts(one: Column) -> Column:
        return F.exists(one["targets"], lambda name: _matches(name, "(?i)prompt"))

    speaking = facts.filter(F.exists("assignments", soils) & F.exists("assignments", prompts))
    rows = _hits(speaking, _assigned(soils, prompts))
    return _candidates(rows, "ASI01", F.col("lineno"), F.col("name"))


def tool_misuse(facts: DataFrame) -> DataFrame:
    """Functions with a sink's name and a parameter, and evaluation of what a parameter reaches."""
    named = fact_rows(facts, "functions").filter(
        _matches(F.col("name"), SINK_NAME) & (F.size("args") > 0)
    )
    evaluations = F.filter("calls", lambda call: F.regexp_extract(call["call"], EVAL_CALL, 1) != "")
    uses = F.transform(
        evaluations,
        lambda call: F.struct(F.regexp_extract(call["call"], EVAL_CALL, 1).alias("name"), call["lineno"].alias("lineno")),
    )
    bound = F.transform(
        "functions",
        lambda one, at: _step(one["lineno"], _BOUND, at, one["args"], _none("string"), F.size(one["args"]) > 0, F.lit(False)),
    )
    never = lambda one: F.lit(False)
    evaluating = facts.filter(F.size(evaluations) > 0)
    evaluated = _hits(evaluating, F.concat(bound, _used(uses), _assigned(never, never)))
    columns = ["scan_id", "path", "lineno", "name"]
    rows = named.select(columns).unionByName(evaluated.select(columns))
    return _candidates(rows, "ASI02", F.col("lineno"), F.col("name"))


def state_leakage(texts: DataFrame) -> DataFrame:
    """Fields whose name speaks of a secret; read from lines, since facts leave them out."""
    speaking = texts.filter(_matches(F.col("text"), SECRET_WORD))
    rows = lines_of(speaking).withColumn("field", F.regexp_extract("line", SECRET_FIELD, 1))
    return _candidates(rows.filter(F.col("field") != ""), "ASI03", F.col("lineno"), F.col("field"))


def supply_chain(texts: DataFrame, advisories: DataFrame) -> DataFrame:
    """Pinned versions below an advisory's threshold, in the style of either language."""
    pins = supply.pinned(texts).unionByName(supply.pinned_js(texts.filter(F.col("ext").isin(*V.JS_SUFFIXES))))
    found = supply.vulnerable(pins, advisories)
    evidence = F.concat("package", F.lit(" "), "installed", F.lit(" "), "cve")
    return _candidates(found, "ASI05", F.lit(None), evidence)


def privilege_escalation(facts: DataFrame) -> DataFrame:
    """Functions with a destructive name that neither ask for authorisation nor are decorated with it.

    A function reaches from its first line to the line before the next function of the file.
    """
    lines = F.transform("functions", lambda one: one["lineno"])

    def unguarded(one: Column) -> Column:
        following = F.array_min(F.filter(lines, lambda line: line > one["lineno"]))
        inside = lambda call: (call["lineno"] >= one["lineno"]) & (following.isNull() | (call["lineno"] < following))
        asked = F.exists("calls", lambda call: inside(call) & _matches(call["call"], AUTHORISATION))
        return ~asked & ~F.exists(one["decorators"], lambda text: _matches(text, AUTHORISATION))

    found = F.filter("functions", lambda one: _matches(one["name"], DESTRUCTIVE_NAME) & unguarded(one))
    rows = positions(facts, ["scan_id", "path"], found, item="fact").select("scan_id", "path", "fact.*")
    return _candidates(rows, "ASI06", F.col("lineno"), F.col("name"))


def unchecked_output(facts: DataFrame) -> DataFrame:
    """Uses of a variable that holds model output, directly or by way of other variables.

    Uses are the words of a Python call and the values of properties in JavaScript; each comes out
    once however often the name was assigned before. A name that was assigned anew holds what it was given then.
    """

    def speaks(assigned: Column) -> Column:
        return _matches(assigned["value"], MODEL_OUTPUT) | F.exists(
            assigned["targets"], lambda name: _matches(name, MODEL_OUTPUT)
        )

    def words(call: Column) -> Column:
        found = F.array_distinct(F.regexp_extract_all(call["call"], F.lit(r"(\w+)"), 1))
        return F.transform(found, lambda name: F.struct(name.alias("name"), call["lineno"].alias("lineno")))

    python_uses = F.flatten(F.transform("calls", words))
    uses = F.array_distinct(F.when(F.col("lang") == "py", python_uses).otherwise(F.col("values")))
    never = lambda one: F.lit(False)
    speaking = facts.filter(F.exists("assignments", speaks))
    rows = _hits(speaking, F.concat(_used(uses), _assigned(speaks, never)))
    return _candidates(rows, "ASI07", F.col("lineno"), F.col("name"))


def memory_poisoning(facts: DataFrame) -> DataFrame:
    """Saver objects in files that compile with a checkpointer."""
    persists = F.exists("calls", lambda call: _matches(call["call"], PERSISTING_COMPILE))
    rows = fact_rows(facts.filter(persists), "calls")
    return _candidates(
        rows.filter(_matches(F.col("call"), SAVER)), "ASI08", F.col("lineno"), F.col("call")
    )


def all_screens(facts: DataFrame, texts: DataFrame, advisories: DataFrame) -> DataFrame:
    """Candidates of every vector."""
    found = prompt_injection(facts)
    for more in (
        tool_misuse(facts),
        state_leakage(texts),
        supply_chain(texts, advisories),
        privilege_escalation(facts),
        unchecked_output(facts),
        memory_poisoning(facts),
    ):
        found = found.unionByName(more)
    return found
