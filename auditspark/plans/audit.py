"""Whole runs: an audit of many scans, and a check of package inventories."""

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame

from auditspark.operators import decode, facts, prompt, report, score, select, supply
from auditspark.session import materialize


@dataclass
class Prepared:
    """What an audit knows before any model has answered."""

    status: DataFrame
    census: DataFrame
    pruned: DataFrame
    files: DataFrame
    facts: DataFrame
    parse_errors: DataFrame
    skipped: DataFrame
    asked: DataFrame
    prompts: DataFrame


@dataclass
class Audited:
    """What an audit yields from the answers."""

    findings: DataFrame
    rejects: DataFrame
    counters: DataFrame
    summary: DataFrame
    gate: DataFrame
    report: DataFrame


def prepare(scans: DataFrame, listed: DataFrame, files: DataFrame, dirs: DataFrame) -> Prepared:
    """From listed files to routed prompts.

    ``scans(scan_id, target_path, model)``, ``listed(scan_id)`` for targets that exist,
    ``files(scan_id, path, rel_path, content, read_error)``, ``dirs(scan_id, rel_path)``. Contents
    are read once to mark relevant files; the marked files are stored per language, so extraction
    reads each file once more and counts read no contents. Facts feed prompts, counts and screens,
    so they are written once.
    """
    collected = select.stored_files(select.collect_files(files))
    counts = materialize(select.relevance_counts(collected))
    chosen = select.select_files(collected, counts)
    extracted = materialize(facts.extract(chosen))
    return Prepared(
        status=select.scan_status(scans, listed),
        census=select.census(counts),
        pruned=select.pruned_directories(dirs),
        files=chosen,
        facts=extracted,
        parse_errors=facts.parse_rejects(extracted),
        skipped=facts.skip_census(extracted),
        asked=prompt.asked_files(extracted),
        prompts=prompt.route_prompts(prompt.prompts(extracted), scans),
    )


def conclude(
    scans: DataFrame, asked: DataFrame, responses: DataFrame, moment: datetime
) -> Audited:
    """From stored responses to ranked findings, gate and report.

    ``asked`` comes from :class:`Prepared`. Responses should be a stored table, since a model that is
    asked again may answer differently.
    """
    found, rejects = decode.decode(prompt.match_responses(asked, responses))
    found = materialize(found)
    unique = materialize(score.deduplicate(score.valid(found)))
    ranked = materialize(score.rank(unique))
    summarised = report.summary(unique, scans)
    return Audited(
        findings=ranked,
        rejects=rejects,
        counters=score.counters(found),
        summary=summarised,
        gate=report.gate(summarised),
        report=report.report(unique, ranked, scans, moment),
    )


def check(
    scans: DataFrame, installed: DataFrame, advisories: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Vulnerable packages of every inventory, and the status of each scan."""
    found = supply.vulnerable(installed, advisories)
    return supply.display_rows(found), supply.status(found, scans)
