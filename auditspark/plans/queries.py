"""The registered queries: each runs one operator over whole given tables."""

import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditspark import schemas
from auditspark.functions import reply, text
from auditspark.operators import decode, facts, prompt, report, score, screens, select, supply
from auditspark.operators.extract_js import js_facts
from auditspark.operators.extract_py import python_facts
from auditspark.operators.joins import positions
from auditspark.plans import audit, derived
from auditspark.session import folder_address, materialize, tune
from auditspark.sources import srctree, tables

MOMENT = datetime(2026, 1, 2, 3, 4, 5, 678000, tzinfo=timezone.utc)
FINDING = ["scan_id", *schemas.FINDING_FIELDS]

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _wide_numbers(frame: DataFrame) -> DataFrame:
    """Whole numbers as BIGINT, so that results compare by value across engines."""
    small = (T.IntegerType, T.ShortType, T.ByteType, T.DecimalType)
    return frame.select(
        *[
            F.col(f.name).cast("bigint").alias(f.name) if isinstance(f.dataType, small) else f.name
            for f in frame.schema.fields
        ]
    )


def query(run: Callable[[SparkSession, str], DataFrame]):
    def tuned(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _wide_numbers(run(tune(spark), sf_dir))

    _QUERIES[run.__name__] = tuned
    return run


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def _joined(*names: str) -> list:
    return [F.array_join(name, ",").alias(name) for name in names]


# --- files -----------------------------------------------------------------------------------------

def _collected(spark, sf):
    return select.collect_files(derived.files(spark, sf))


@query
def s1_collect_source_files(spark, sf):
    return _collected(spark, sf).select("scan_id", "path", "ext")


@query
def s1_source_tree(spark, sf):
    """Real trees listed, collected, read and selected, with the digest of every text."""
    listed = srctree.entries_of(derived.source_tree(spark, sf))
    files = select.stored_files(select.collect_files(srctree.files_of(listed)))
    chosen = select.select_files(files, materialize(select.relevance_counts(files)))
    read = select.with_text(chosen)
    return read.select("scan_id", "rel_path", "relevant", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query
def s2_single_file_target(spark, sf):
    """Every file as its own target: directories above a target never count."""
    own = derived.files(spark, sf).withColumn("rel_path", text.last_segment(F.col("rel_path")))
    return select.collect_files(own).select("scan_id", "path")


@query
def s3_target_status(spark, sf):
    return select.scan_status(derived.targets(spark, sf), derived.files(spark, sf))


@query
def s4_read_text(spark, sf):
    read = select.with_text(derived.files(spark, sf))
    return read.select("scan_id", "path", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query
def s5_reply_envelope(spark, sf):
    documents = derived.table(spark, sf, "documents")
    message = F.struct(F.struct(F.col("text").alias("content")).alias("message"))
    body = F.to_json(F.struct(F.array(message).alias("choices")))
    read = decode.envelope_text(documents.select("doc_id", body.alias("body")))
    return read.select("doc_id", F.length("raw").alias("n_chars"), F.md5("raw").alias("digest"))


@query
def f1_supported_suffix(spark, sf):
    return select.supported(derived.files(spark, sf)).groupBy("scan_id", "ext").agg(
        F.count("*").alias("n_files")
    )


@query
def f2_outside_pruned_directories(spark, sf):
    return select.outside_pruned(derived.files(spark, sf)).select("scan_id", "path")


@query
def f3_relevant_python(spark, sf):
    marked = select.with_relevance(select.with_suffix(derived.files(spark, sf)))
    return marked.filter(F.col("ext") == ".py").select("scan_id", "path", "relevant")


@query
def f4_relevant_js(spark, sf):
    marked = select.with_relevance(select.with_suffix(derived.files(spark, sf)))
    return marked.filter(F.col("ext").isin(".js", ".ts", ".mjs")).select("scan_id", "path", "relevant")


def _selected(spark, sf):
    collected = select.stored_files(_collected(spark, sf))
    counts = materialize(select.relevance_counts(collected))
    return select.select_files(collected, counts)


@query
def f5_select_or_fall_back(spark, sf):
    return _selected(spark, sf).select("scan_id", "path", "relevant")


@query
def j4_selected_with_flag(spark, sf):
    """The same selection, without the flag."""
    return _selected(spark, sf).select("scan_id", "path")


@query
def a4_file_census(spark, sf):
    return select.census(select.relevance_counts(_collected(spark, sf)))


@query
def a5_pruned_directories(spark, sf):
    named = select.pruned_directories(derived.dirs(spark, sf))
    return named.select("scan_id", "n_names", F.array_join("names", ",").alias("names"))


@query
def o1_file_order(spark, sf):
    return select.number_files(_collected(spark, sf))


@query
def o4_directory_sample(spark, sf):
    return select.directory_sample(select.pruned_directories(derived.dirs(spark, sf)))


# --- facts -------------------------------------------------------------------------------------------

def _python(spark, sf):
    return python_facts(derived.python_files(spark, sf))


def _js(spark, sf):
    return js_facts(derived.js_files(spark, sf))


@query
def x1_python_functions(spark, sf):
    rows = facts.fact_rows(_python(spark, sf), "functions")
    return rows.select("scan_id", "path", "pos", "name", "lineno", *_joined("args", "decorators"))


@query
def x2_python_classes(spark, sf):
    rows = facts.fact_rows(_python(spark, sf), "classes")
    return rows.select("scan_id", "path", "pos", "name", "lineno", *_joined("bases"))


@query
def x3_python_imports(spark, sf):
    return facts.fact_rows(_python(spark, sf), "imports")


@query
def x4_python_calls(spark, sf):
    return facts.fact_rows(_python(spark, sf), "calls")


@query
def x5_python_assignments(spark, sf):
    rows = facts.fact_rows(_python(spark, sf), "assignments")
    return rows.select("scan_id", "path", "pos", *_joined("targets"), "value", "lineno")


@query
def x6_python_strings(spark, sf):
    return facts.fact_rows(_python(spark, sf), "strings")


@query
def x7_python_parse_errors(spark, sf):
    return facts.parse_rejects(_python(spark, sf))


@query
def x8_language_dispatch(spark, sf):
    found = facts.extract(_sources(spark, sf))
    return found.groupBy("scan_id", "lang").agg(
        F.count("*").alias("n_files"),
        F.count("error").alias("n_errors"),
        F.coalesce(F.sum(F.size("calls")), F.lit(0)).alias("n_calls"),
    )


@query
def x9_js_functions(spark, sf):
    rows = facts.fact_rows(_js(spark, sf), "functions")
    return rows.select("scan_id", "path", "pos", "name", "lineno", F.size("decorators").alias("n_decorators"))


@query
def x10_js_parameters(spark, sf):
    rows = facts.fact_rows(_js(spark, sf), "functions")
    return positions(rows, ["scan_id", "path", "name"], "args", "at", "arg")


@query
def x11_js_classes(spark, sf):
    rows = facts.fact_rows(_js(spark, sf), "classes")
    return rows.select("scan_id", "path", "pos", "name", "lineno", *_joined("bases"))


@query
def x12_js_imports(spark, sf):
    return facts.fact_rows(_js(spark, sf), "imports")


@query
def x13_js_calls(spark, sf):
    return facts.fact_rows(_js(spark, sf), "calls")


@query
def x14_js_assignments(spark, sf):
    rows = facts.fact_rows(_js(spark, sf), "assignments")
    return rows.select("scan_id", "path", "pos", *_joined("targets"), "value", "lineno")


@query
def x15_js_strings(spark, sf):
    return facts.fact_rows(_js(spark, sf), "strings")


@query
def x16_js_parse_errors(spark, sf):
    return facts.parse_rejects(_js(spark, sf))


@query
def f6_eligible_files(spark, sf):
    return facts.eligible(_python(spark, sf)).select("scan_id", "path")


@query
def f13_long_literals(spark, sf):
    """Whole documents as literals of a Python file each."""
    documents = derived.table(spark, sf, "documents")
    quoted = F.replace(F.replace("text", F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    files = documents.select(
        F.col("source").alias("scan_id"), F.col("doc_id").cast("string").alias("path"),
        F.concat(F.lit("note = '''"), quoted, F.lit("'''\n")).cast("binary").alias("content"),
        F.lit(None).cast("string").alias("read_error"),
    )
    rows = facts.fact_rows(python_facts(files), "strings")
    return rows.select("scan_id", "path", "value", "lineno")


@query
def a9_skip_census(spark, sf):
    return facts.skip_census(_python(spark, sf))


# --- prompts -----------------------------------------------------------------------------------------

@query
def t1_prompts(spark, sf):
    return prompt.prompts(_python(spark, sf))


@query
def o5_prompt_cut(spark, sf):
    made = prompt.prompts(python_facts(derived.word_files(spark, sf)))
    return made.select("scan_id", "path", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("digest"))


@query
def j1_endpoint_routing(spark, sf):
    routed = prompt.route(derived.model_choices(spark, sf))
    return routed.select("scan_id", "model", "model_key", "url", "model_name")


# --- replies -----------------------------------------------------------------------------------------

def _reached(spark, sf):
    return decode.before_connection_loss(derived.responses(spark, sf))


def _parsed(spark, sf):
    return decode.parse_replies(_reached(spark, sf))


def _typed(spark, sf):
    return decode.decode_items(_reached(spark, sf)).filter(F.col("pos").isNotNull())


@query
def j2_match_responses(spark, sf):
    """Prompts are asked for every event; some responses never came, failed calls stay visible."""
    responses = derived.responses(spark, sf)
    asked = responses.select("scan_id", "path", "file_order")
    given = responses.filter(F.col("file_order") % 17 != 3)
    return prompt.match_responses(asked, given).select("scan_id", "path", "status", "detail")


def _first_client():
    return lambda url, body, deadline: f"first {url} {body}"


def _second_client():
    return lambda url, body, deadline: f"second {url} {body}"


@query
def j2_resumed_calls(spark, sf):
    """Two runs with one journal: the second one asks only what the first one was not answered."""
    requests = derived.responses(spark, sf).select(
        "scan_id", "path", F.lit("u").alias("url"), F.col("file_order").cast("string").alias("body"), F.lit(1).alias("deadline_s"),
        "file_order",
    )
    journal = f"{folder_address(spark)}/auditspark/journal-{uuid.uuid4().hex}"
    first = requests.filter(F.col("file_order") % 3 == 1)
    materialize(prompt.ask(first, _first_client, tasks=8, threads=4, journal=journal))
    answered = materialize(prompt.ask(requests, _second_client, tasks=8, threads=4, journal=journal))
    return answered.select("scan_id", "path", "status", "raw")


@query
def s8_report_files(spark, sf):
    """Reports written as one file per scan, and read back line by line."""
    unique = materialize(score.deduplicate(score.valid(derived.findings(spark, sf))))
    lines = report.report(unique, score.rank(unique), derived.scans(spark, sf), MOMENT)
    path = f"{folder_address(spark)}/auditspark/reports-{uuid.uuid4().hex}"
    tables.write_report_files(lines, path)
    read = spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("report"))
    return read.select(F.url_decode(F.regexp_extract("file", r"([^/]+)\.jsonl$", 1)).alias("scan_id"), "report")


@query
def f11_before_connection_loss(spark, sf):
    return _reached(spark, sf).select("scan_id", "path", "status")


@query
def f12_failed_calls(spark, sf):
    return decode.call_rejects(_reached(spark, sf)).select("scan_id", "path", "stage", "reason", "payload")


@query
def t2_drop_thinking(spark, sf):
    answered = decode.answered(derived.responses(spark, sf))
    return answered.select(
        "scan_id", "path", reply.drop_thinking(text.strip(F.col("raw"))).alias("text")
    )


@query
def t3_unfence(spark, sf):
    answered = decode.answered(derived.responses(spark, sf))
    return answered.select("scan_id", "path", reply.unfence(text.strip(F.col("raw"))).alias("text"))


@query
def t4_bracket_slice(spark, sf):
    answered = decode.answered(derived.responses(spark, sf))
    return answered.select("scan_id", "path", reply.bracket_slice(F.col("raw")).alias("text"))


@query
def t5_json_decode(spark, sf):
    return _parsed(spark, sf).select(
        "scan_id", "path", "text", "reply_error", F.coalesce(F.size("items"), F.lit(0)).alias("n_items")
    )


@query
def t6_explode_items(spark, sf):
    typed = _typed(spark, sf)
    return typed.select("scan_id", "path", "pos", (F.col("item_error") == "not_an_object").alias("stray"))


@query
def t7_defaults(spark, sf):
    return _typed(spark, sf).filter(F.col("item_error").isNull()).select(
        "scan_id", "path", "pos", "owasp_id", "title", "description", "severity", "file", "line",
        "remediation",
    )


@query
def t8_type_checks(spark, sf):
    return _typed(spark, sf).select("scan_id", "path", "pos", "item_error")


@query
def t9_rejects(spark, sf):
    _, rejects = decode.decode(derived.responses(spark, sf))
    return rejects.groupBy("scan_id", "stage", "reason").agg(
        F.count("*").alias("n"), F.max("seq").alias("last_seq"), F.max("path").alias("last_path")
    )


@query
def o2_finding_ids(spark, sf):
    found, _ = decode.decode(derived.responses(spark, sf))
    return found.select("scan_id", "path", "seq", "id", "title")


@query
def a7_findings_per_file(spark, sf):
    return decode.findings_per_file(decode.decode_items(_reached(spark, sf)))


# --- findings ----------------------------------------------------------------------------------------

def _ranked(spark, sf):
    return score.score(derived.findings(spark, sf))


@query
def f7_title_check(spark, sf):
    return derived.findings(spark, sf).filter(score.good_title()).select("scan_id", "seq", "title")


@query
def f8_vector_check(spark, sf):
    return derived.findings(spark, sf).filter(score.known_vector()).select("scan_id", "seq", "owasp_id")


@query
def f9_description_check(spark, sf):
    return derived.findings(spark, sf).filter(score.long_description()).select(
        "scan_id", "seq", "description"
    )


@query
def f10_validate(spark, sf):
    return score.with_reject_reason(derived.findings(spark, sf)).select("scan_id", "seq", "reject_reason")


@query
def a3_keep_worst(spark, sf):
    return score.deduplicate(score.valid(derived.findings(spark, sf))).select(*FINDING, "first_seq")


@query
def o3_report_order(spark, sf):
    return score.in_report_order(_ranked(spark, sf)).select("scan_id", "report_pos", "id", "severity")


@query
def a6_stage_counters(spark, sf):
    return score.counters(derived.findings(spark, sf))


@query
def a1_severity_summary(spark, sf):
    unique = score.deduplicate(score.valid(derived.findings(spark, sf)))
    return report.summary(unique, derived.scans(spark, sf)).drop("total_findings")


@query
def a2_total_findings(spark, sf):
    unique = score.deduplicate(score.valid(derived.findings(spark, sf)))
    return report.summary(unique, derived.scans(spark, sf)).select("scan_id", "total_findings")


@query
def f15_strict_gate(spark, sf):
    unique = score.deduplicate(score.valid(derived.findings(spark, sf)))
    return report.gate(report.summary(unique, derived.scans(spark, sf)))


@query
def s9_findings_rows(spark, sf):
    return score.findings_rows(_ranked(spark, sf))


@query
def a8_report(spark, sf):
    """The head of every scan's report."""
    unique = score.deduplicate(score.valid(derived.findings(spark, sf)))
    head = report.header(unique, derived.scans(spark, sf), MOMENT)
    return head.select("scan_id", "tool_version", "timestamp", "total_findings", "summary.*")


@query
def s8_report_json(spark, sf):
    """All lines of all reports."""
    unique = materialize(score.deduplicate(score.valid(derived.findings(spark, sf))))
    return report.report(unique, score.rank(unique), derived.scans(spark, sf), MOMENT)


@query
def p1_location(spark, sf):
    return derived.findings(spark, sf).select(
        "scan_id", "seq", text.location(F.col("file"), F.col("line")).alias("location")
    )


@query
def p2_findings_table(spark, sf):
    return report.findings_table(_ranked(spark, sf))


@query
def p3_remediation_steps(spark, sf):
    return report.remediation_steps(derived.findings(spark, sf))


@query
def p4_report_time(spark, sf):
    moment = F.col("ts").cast("timestamp")
    return derived.table(spark, sf, "events").select(
        "event_id", report.iso_time(moment).alias("timestamp"), report.header_time(moment).alias("header")
    )


@query
def audit_findings(spark, sf):
    """Replies to ranked findings in one go."""
    found, _ = decode.decode(derived.responses(spark, sf))
    return score.findings_rows(score.score(found))


# --- packages ----------------------------------------------------------------------------------------

def _vulnerable(spark, sf):
    return supply.vulnerable(derived.inventories(spark, sf), tables.advisories(spark))


@query
def audit_run(spark, sf):
    """A whole run: files to facts and prompts, an answer for most prompts, findings, reports."""
    files = derived.python_files(spark, sf).withColumn("rel_path", text.last_segment(F.col("path")))
    scans = files.select("scan_id").distinct().select(
        "scan_id", F.concat(F.lit("/repos/"), "scan_id").alias("target_path"), F.lit("fast").alias("model")
    )
    ready = audit.prepare(scans, files.select("scan_id"), files.drop("ext"), files.select("scan_id", "rel_path"))
    done = audit.conclude(scans, ready.asked, derived.answers(ready.asked), MOMENT)
    lines = done.report.groupBy("scan_id").agg(F.count("*").alias("n_lines"))
    return done.summary.join(done.gate, "scan_id").join(lines, "scan_id")


@query
def s6_advisories(spark, sf):
    """Every advisory with the number of installed packages that it speaks of."""
    installed = derived.inventories(spark, sf).select(text.package_key(F.col("package")).alias("key"))
    counts = installed.groupBy("key").agg(F.count("*").alias("n_installed"))
    known = tables.advisories(spark).select("adv_pos", "package", "cve", "affected_below", "severity")
    joined = known.join(counts, text.package_key(F.col("package")) == F.col("key"), "left").drop("key")
    return joined.withColumn("n_installed", F.coalesce("n_installed", F.lit(0)))


@query
def s7_inventory(spark, sf):
    """Installed packages under the names by which advisories look them up."""
    return derived.inventories(spark, sf).select(
        "scan_id", text.package_key(F.col("package")).alias("package"), "version"
    )


@query
def c1_version_triples(spark, sf):
    return supply.with_triple(derived.inventories(spark, sf)).select(
        "scan_id", "package", "version", "major", "minor", "patch", "version_key"
    )


@query
def f14_below_threshold(spark, sf):
    return derived.inventories(spark, sf).select(
        "scan_id", "package", "version", text.is_below(F.col("version"), F.lit("1.2.0")).alias("below")
    )


@query
def j3_advisory_match(spark, sf):
    return _vulnerable(spark, sf).select("scan_id", "adv_pos", "package", "installed", "cve")


@query
def c2_vulnerability_rows(spark, sf):
    return supply.vulnerability_rows(_vulnerable(spark, sf))


@query
def c3_display_rows(spark, sf):
    return supply.display_rows(_vulnerable(spark, sf))


@query
def c4_scan_status(spark, sf):
    return supply.status(_vulnerable(spark, sf), derived.inventory_scans(spark, sf))


@query
def c5_pinned_requirements(spark, sf):
    texts = select.with_text(derived.files(spark, sf))
    return supply.pinned(texts)


# --- screens -----------------------------------------------------------------------------------------

def _stored_facts(sources, *kinds):
    """Facts for a screen, which may read them in several branches; of the kinds that it reads."""
    return materialize(facts.extract(sources).select("scan_id", "path", "lang", *kinds))


def _sources(spark, sf):
    columns = ["scan_id", "path", "ext", "content", "read_error"]
    return derived.python_files(spark, sf).select(columns).unionByName(
        derived.js_files(spark, sf).select(columns)
    )


SCREEN = ["scan_id", "owasp_id", "title", "description", "severity", "file", "line", "remediation"]


@query
def v1_prompt_injection(spark, sf):
    return screens.prompt_injection(_stored_facts(_sources(spark, sf), "assignments"))


@query
def v2_tool_misuse(spark, sf):
    return screens.tool_misuse(_stored_facts(_sources(spark, sf), "functions", "calls", "assignments"))


@query
def v3_state_leakage(spark, sf):
    return screens.state_leakage(select.with_text(select.with_suffix(derived.files(spark, sf))))


@query
def v5_supply_chain(spark, sf):
    texts = select.with_text(select.with_suffix(derived.files(spark, sf)))
    return screens.supply_chain(texts, tables.advisories(spark))


@query
def v6_privilege_escalation(spark, sf):
    return screens.privilege_escalation(_stored_facts(_sources(spark, sf), "functions", "calls"))


@query
def v7_unchecked_output(spark, sf):
    return screens.unchecked_output(_stored_facts(_sources(spark, sf), "calls", "assignments", "values"))


@query
def v8_memory_poisoning(spark, sf):
    return screens.memory_poisoning(_stored_facts(_sources(spark, sf), "calls"))
