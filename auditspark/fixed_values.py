"""Every word list, threshold, default and format that decides a result.

They are part of the audited behaviour, so a change here changes what an audit reports.
"""

# --- source files -------------------------------------------------------------------------------

PY_SUFFIX = ".py"
JS_SUFFIXES = (".js", ".ts", ".mjs")
# Read as TypeScript, where "<" never begins a tag.
TYPED_SUFFIX = ".ts"
SOURCE_SUFFIXES = (PY_SUFFIX, *JS_SUFFIXES)

# Directories left out of a scan at any depth (next to every directory that starts with a dot).
PRUNED_DIRECTORIES = (
    "node_modules", "dist", "build", ".next", ".nuxt", ".turbo",
    "coverage", ".coverage", "__pycache__", ".git", ".venv", "venv",
    "env", "vendor", ".cache", ".parcel-cache", "out", ".output",
    "storybook-static", ".docusaurus",
)
DIRECTORY_SAMPLE = 3

# A Python file with one of these texts is agent code.
PY_MARKERS = (
    "from langgraph", "import langgraph",
    "from langchain", "import langchain",
    "StateGraph",
    "@tool", "StructuredTool",
    "MemorySaver", "SqliteSaver", "PostgresSaver",
)

# A JavaScript or TypeScript file with one of these texts is agent code.
JS_MARKERS = (
    "@langchain/",
    "StateGraph", "Annotation", "MessagesAnnotation",
    "addNode", "addEdge", "setEntryPoint", "compile(",
    "MemorySaver", "SqliteSaver", "PostgresSaver",
    "tool(", "DynamicTool", "StructuredTool",
    "invoke(", "stream(",
    "createReactAgent", "createAgent",
)

# Text literals: kept when longer than the first, cut at the second.
LITERAL_MIN = 20
LITERAL_CUT = 200

MISSING_TARGET = "target path does not exist: "
JS_SYNTAX_ERROR = "syntax error: file contains unparseable tokens"

# --- prompts and model endpoints ----------------------------------------------------------------

PROMPT_PREAMBLE = "Analyze this LangGraph agent for security vulnerabilities:\n\n"
PROMPT_LIMIT = 12000
PROMPT_CUT_MARK = "\n... [truncated for context window]"

DEFAULT_MODEL_KEY = "fast"
# model key, url, model name
ENDPOINTS = (
    ("fast", "http://127.0.0.1:8080/v1/chat/completions", "qwen3.5-9b"),
    ("reasoning", "http://127.0.0.1:8081/v1/chat/completions", "qwen3.5-35b-a3b"),
)

# What a model is asked for: little randomness, a bounded reply, within a time.
TEMPERATURE = 0.1
REPLY_TOKENS = 2048
CALL_SECONDS = 120

# --- findings -----------------------------------------------------------------------------------

THINK_OPEN, THINK_CLOSE = "<think>", "</think>"
FENCE, FENCE_LANGUAGE = "```", "json"
REPLY_PATH = "$.choices[0].message.content"

FINDING_ID_FORMAT = "GG-%03d"

# Severity and its rank, worst first; anything else ranks 0.
SEVERITY_RANK = {"critical": 4, "high": 3, "medium": 2, "low": 1}

# Vectors a finding may name (there is no ASI04).
VECTORS = ("ASI01", "ASI02", "ASI03", "ASI05", "ASI06", "ASI07", "ASI08")

# What a finding gets for a key that its JSON object lacks.
DEFAULTS = {
    "owasp_id": "UNKNOWN",
    "title": "Untitled finding",
    "description": "No description provided",
    "severity": "medium",
    "file": "unknown",
    "remediation": "No remediation provided",
}
DESCRIPTION_MIN = 10

REPORT_VERSION = "0.1.0"

# --- advisories (illustrative sample data, not verified facts) ----------------------------------

# package, advisory id, affected below, severity, description, remediation
ADVISORIES = (
    ("langgraph-checkpoint-sqlite", "CVE-2025-67644", "3.0.1", "high",
     "SQL injection via metadata filter keys in checkpoint queries.",
     "Upgrade langgraph-checkpoint-sqlite to >= 3.0.1"),
    ("langchain-core", "CVE-2026-34070", "1.1.0", "high",
     "Path traversal in prompt-loading subsystem allows arbitrary file access.",
     "Upgrade langchain-core to >= 1.1.0"),
    ("langgraph", "CVE-2025-68664", "1.2.0", "critical",
     "Serialization injection allows prompt injection escalated to RCE.",
     "Upgrade langgraph to >= 1.2.0"),
    ("langchain-community", "CVE-2026-28277", "0.3.0", "high",
     "Unsafe msgpack deserialization enables Remote Code Execution.",
     "Upgrade langchain-community to >= 0.3.0"),
)

# --- character classes --------------------------------------------------------------------------

# What counts as a blank at the ends of a text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same without the four separators, for text that must read as a whole number.
NUMBER_BLANKS = "".join(c for c in BLANKS if c not in "\x1c\x1d\x1e\x1f")
