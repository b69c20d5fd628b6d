"""Column layouts shared by the stages, as DDL."""

FUNCTIONS = "array<struct<name:string,lineno:int,args:array<string>,decorators:array<string>>>"
CLASSES = "array<struct<name:string,lineno:int,bases:array<string>>>"
IMPORTS = "array<string>"
CALLS = "array<struct<call:string,lineno:int>>"
ASSIGNMENTS = "array<struct<targets:array<string>,value:string,lineno:int>>"
STRINGS = "array<struct<value:string,lineno:int>>"

# Names used as values of properties; for screens only, no part of a prompt.
VALUES = "array<struct<name:string,lineno:int>>"

FACT_TYPES = {
    "functions": FUNCTIONS,
    "classes": CLASSES,
    "imports": IMPORTS,
    "calls": CALLS,
    "assignments": ASSIGNMENTS,
    "strings": STRINGS,
}

FACTS = (
    "scan_id string, path string, lang string, error string, "
    + ", ".join(f"{name} {kind}" for name, kind in FACT_TYPES.items())
)

RESPONSES = "scan_id string, path string, status string, raw string, detail string"

FINDING_FIELDS = (
    "id", "owasp_id", "title", "description", "severity", "file", "line", "remediation",
)
ADVISORIES = (
    "adv_pos int, package string, cve string, affected_below string, severity string, "
    "description string, remediation string"
)
