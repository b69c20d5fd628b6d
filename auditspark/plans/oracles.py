"""What each registered query must return, said again in DuckDB SQL over the given tables.

Only fixed values and the text templates of the derived inputs are shared with the Spark side.
"""

from auditspark import fixed_values as V
from auditspark.plans import derived
from auditspark.plans.queries import MOMENT


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(_q(value) for value in values) + "]"


def _in(values) -> str:
    return "(" + ", ".join(_q(value) for value in values) + ")"


def _pick(key: str, values) -> str:
    return f"({_list(values)})[CAST({key} AS BIGINT) % {len(values)} + 1]"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q(word)})" for word in words) + ")"


BLANKS = _q(V.BLANKS)
NUMBER_BLANKS = _q(V.NUMBER_BLANKS)
RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"

# --- findings, from lineitem -------------------------------------------------------------------------

FINDINGS = f"""
lines AS (
  SELECT *, (l_orderkey * 10 + l_linenumber) * 100 + row_number() OVER (
    PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS seq
  FROM lineitem),
findings AS (
  SELECT
    CASE WHEN l_suppkey % 3 = 0 THEN 'hot' ELSE 's' || (l_suppkey % 10) END AS scan_id,
    seq, 'GG-' || seq AS id, 'ASI0' || (l_partkey % 9 + 1) AS owasp_id,
    CASE l_linenumber WHEN 7 THEN '' WHEN 6 THEN 'Untitled finding' WHEN 5 THEN ' '
      ELSE 'Issue ' || l_linenumber END AS title,
    repeat('d', CAST(5 + l_partkey % 36 AS BIGINT)) AS description,
    CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'critical'
      WHEN l_returnflag = 'N' AND l_linestatus = 'O' THEN 'high'
      WHEN l_linestatus = 'F' THEN 'medium' ELSE 'low' END AS severity,
    'src/f' || (l_partkey % 200) || '.py' AS file,
    CASE l_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 ELSE CAST(l_quantity AS BIGINT) END AS line,
    'Step one' || chr(10) || chr(10) || '  step ' || l_linenumber || chr(9) || chr(10) || ' '
      || chr(160) || chr(10) || 'last' || chr(12288) AS remediation
  FROM lines),
scans AS (
  SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'hot' ELSE 's' || (s_suppkey % 10) END AS scan_id
  FROM supplier
  UNION ALL SELECT 'quiet' || r_regionkey FROM region),
checked AS (
  SELECT *, CASE WHEN title IN ('', 'Untitled finding') THEN 'title'
    WHEN owasp_id NOT IN {_in(V.VECTORS)} THEN 'vector'
    WHEN length(description) < 10 THEN 'description' END AS reject_reason
  FROM findings),
placed AS (
  SELECT *, min(seq) OVER (PARTITION BY scan_id, file, owasp_id, title) AS first_seq,
    row_number() OVER (PARTITION BY scan_id, file, owasp_id, title ORDER BY {RANK} DESC, seq) AS nth
  FROM checked WHERE reject_reason IS NULL),
kept AS (SELECT * FROM placed WHERE nth = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY {RANK} DESC, first_seq) AS report_pos
  FROM kept),
summary AS (
  SELECT s.scan_id, count(*) FILTER (severity = 'critical') AS critical,
    count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium,
    count(*) FILTER (severity = 'low') AS low, count(k.scan_id) AS total_findings
  FROM scans s LEFT JOIN kept k ON s.scan_id = k.scan_id GROUP BY s.scan_id)
"""

EIGHT = "id, owasp_id, title, description, severity, file, line, remediation"
LOCATION = "CASE WHEN line IS NULL OR line = 0 THEN file ELSE file || ':' || line END"
TIMESTAMP = MOMENT.isoformat()

# --- replies, from events ------------------------------------------------------------------------------

LOST = "(event_type IN ('error', 'view') AND user_id % 50 = 14 AND event_id % 6 = 5)"
# The last value of a key, however often the object repeats it.
VALUE = "list_extract(json_extract(item, '$.*'), length(json_keys(item)) + 1 - list_position(list_reverse(json_keys(item)), '{0}'))"

RESPONSES = f"""
calls AS (
  SELECT CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE event_type END AS scan_id,
    'agents/e' || lpad(CAST(event_id AS VARCHAR), 12, '0') || '.py' AS path,
    event_id AS file_order, user_id,
    CASE WHEN {LOST} THEN 'connect_error' WHEN event_id % 25 = 11 THEN 'error' ELSE 'ok' END AS status,
    {_pick("event_id", derived.REPLIES)} AS template
  FROM events),
responses AS (
  SELECT scan_id, path, file_order, status,
    CASE WHEN status = 'ok' THEN replace(replace(template, '%k', CAST(file_order AS VARCHAR)), '%u', CAST(user_id AS VARCHAR)) END AS raw,
    CASE WHEN status <> 'ok' THEN 'call failed for ' || file_order END AS detail
  FROM calls),
reached AS (
  SELECT * FROM (
    SELECT *, min(CASE WHEN status = 'connect_error' THEN file_order END) OVER (PARTITION BY scan_id) AS cut
    FROM responses)
  WHERE cut IS NULL OR file_order < cut),
thought AS (
  SELECT *, CASE WHEN contains(raw, '<think>') AND contains(raw, '</think>')
    THEN trim(list_last(string_split(raw, '</think>')), {BLANKS}) ELSE trim(raw, {BLANKS}) END AS text1
  FROM reached WHERE status = 'ok'),
fenced AS (
  SELECT *, CASE WHEN contains(text1, '```') THEN coalesce(list_filter(list_transform(
      list_transform(string_split(text1, '```'), lambda p: trim(p, {BLANKS})),
      lambda p: CASE WHEN starts_with(p, 'json') THEN trim(p[5:], {BLANKS}) ELSE p END),
      lambda p: p[1] IN ('[', '{{'))[1], text1) ELSE text1 END AS text2
  FROM thought),
sliced AS (
  SELECT *, trim(CASE WHEN contains(text2, '[') AND contains(text2, ']')
    THEN text2[strpos(text2, '['):length(text2) + 1 - strpos(reverse(text2), ']')] ELSE text2 END, {BLANKS}) AS text
  FROM fenced),
-- This parser lets a comma pass before a closing bracket, so that is ruled out separately.
judged AS (
  SELECT *, json_valid(text) AND NOT regexp_matches(text, ',\\s*[\\]}}]') AS is_json FROM sliced),
parsed AS (
  SELECT scan_id, path, file_order, text, CASE
      WHEN NOT is_json THEN 'not_json'
      WHEN json_type(text) NOT IN ('ARRAY', 'OBJECT', 'VARCHAR') THEN 'not_iterable' END AS reply_error,
    CASE WHEN NOT is_json THEN NULL
      WHEN json_type(text) = 'ARRAY' THEN json_extract(text, '$[*]')
      WHEN json_type(text) = 'OBJECT' THEN list_transform(json_keys(text), lambda k: to_json(k))
      WHEN json_type(text) = 'VARCHAR' THEN list_transform(
        string_split(json_extract_string(text, '$'), ''), lambda c: to_json(c)) END AS items
  FROM judged),
counted AS (
  SELECT *, CAST(coalesce(length(items), 0) AS BIGINT) AS n_items FROM parsed),
offsets AS (
  SELECT *, coalesce(sum(n_items) OVER (PARTITION BY scan_id ORDER BY file_order
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM counted),
exploded AS (
  SELECT scan_id, path, file_order, before, unnest(items) AS item,
    generate_subscripts(items, 1) - 1 AS pos
  FROM offsets WHERE n_items > 0),
members AS (
  SELECT *, json_type(item) = 'OBJECT' AS is_object,
    {", ".join(f"CASE WHEN json_type(item) = 'OBJECT' THEN {VALUE.format(k)} END AS j_{k}" for k in (*V.DEFAULTS, "line"))}
  FROM exploded),
numbers AS (
  SELECT *, trim(json_extract_string(j_line, '$'), {NUMBER_BLANKS}) AS line_text,
    json_type(j_line) AS line_type
  FROM members),
lined AS (
  SELECT *, CASE
    WHEN line_type IN ('BIGINT', 'UBIGINT') THEN CAST(line_text AS BIGINT)
    WHEN line_type = 'BOOLEAN' THEN CASE WHEN line_text = 'true' THEN 1 ELSE 0 END
    WHEN line_type = 'DOUBLE' THEN CASE WHEN CAST(line_text AS DOUBLE) = floor(CAST(line_text AS DOUBLE))
      THEN CAST(CAST(line_text AS DOUBLE) AS BIGINT) END
    WHEN line_type = 'VARCHAR' AND regexp_full_match(line_text, '[+-]?[0-9]+(_[0-9]+)*(\\.0+)?')
      THEN CAST(replace(ltrim(split_part(line_text, '.', 1), '+'), '_', '') AS BIGINT) END AS line
  FROM numbers),
typed AS (
  SELECT scan_id, path, file_order, before, pos, CASE
      WHEN NOT is_object THEN 'not_an_object'
      WHEN j_severity IS NOT NULL AND (json_type(j_severity) <> 'VARCHAR'
        OR json_extract_string(j_severity, '$') NOT IN {_in(V.SEVERITY_RANK)}) THEN 'bad_severity'
      {" ".join(f"WHEN json_type(j_{k}) <> 'VARCHAR' THEN 'bad_{k}'" for k in ("owasp_id", "title", "description", "file", "remediation"))}
      WHEN line IS NULL AND line_type <> 'NULL' THEN 'bad_line' END AS item_error,
    {", ".join(f"coalesce(json_extract_string(j_{k}, '$'), {_q(d)}) AS {k}" for k, d in V.DEFAULTS.items())},
    line
  FROM lined),
numbered AS (
  SELECT *, CAST(before + pos + 1 AS BIGINT) AS seq,
    'GG-' || CASE WHEN before + pos + 1 < 1000 THEN lpad(CAST(CAST(before + pos + 1 AS BIGINT) AS VARCHAR), 3, '0')
      ELSE CAST(CAST(before + pos + 1 AS BIGINT) AS VARCHAR) END AS id
  FROM typed)
"""

# --- files, from documents --------------------------------------------------------------------------

FILES = f"""
shaped AS (
  SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'hot' ELSE source END AS scan_id,
    {_pick("doc_id // 20", derived.DIRECTORIES)} || 'd' || doc_id AS directory,
    CASE WHEN doc_id % 23 = 0 THEN '' WHEN doc_id % 19 = 0 THEN '__init__'
      WHEN doc_id % 17 = 0 THEN '.f' ELSE 'f' || doc_id END
      || {_pick("doc_id // 7", derived.SUFFIXES)} AS name
  FROM documents),
files AS (
  SELECT scan_id, directory, name, directory || '/' || name AS rel_path,
    '/repos/' || scan_id || '/' || directory || '/' || name AS path,
    string_split(directory, '/') AS segments,
    CASE WHEN contains(ltrim(name, '.'), '.')
      THEN '.' || lower(list_last(string_split(ltrim(name, '.'), '.'))) ELSE '' END AS ext,
    CASE WHEN doc_id % 31 = 0 OR doc_id % 29 = 0 THEN NULL ELSE
      CASE WHEN source IN ('src4', 'src5') AND scan_id <> 'hot' THEN '' ELSE {_pick("doc_id", derived.MARKERS)} END
      || text || CASE WHEN doc_id % 13 = 0 THEN chr(10)
        || 'NEEDS = ["langchain-community==0.2.5", "langgraph==1.' || (doc_id % 5)
        || '.9", ''LangChain_Core==1.1'', "@langchain/core@1.0.3"]' || chr(10) || 'user_token: str' || chr(10) ELSE '' END END AS text
  FROM shaped),
walked AS (
  SELECT *, len(list_filter(segments, lambda s: starts_with(s, '.') OR s IN {_in(V.PRUNED_DIRECTORIES)})) = 0 AS open
  FROM files),
collected AS (
  SELECT *, coalesce(CASE WHEN ext = '.py' THEN {_any("text", V.PY_MARKERS)}
    ELSE {_any("text", V.JS_MARKERS)} END, false) AS relevant
  FROM walked WHERE open AND ext IN {_in(V.SOURCE_SUFFIXES)}),
met AS (
  SELECT scan_id, list_filter(segments, lambda s: starts_with(s, '.') OR s IN {_in(V.PRUNED_DIRECTORIES)})[1] AS met
  FROM files),
named AS (
  SELECT scan_id, list_sort(list(DISTINCT met)) AS names
  FROM met WHERE met IN {_in(V.PRUNED_DIRECTORIES)} GROUP BY scan_id),
pins AS (
  SELECT scan_id, path, unnest(regexp_extract_all(text, '[A-Za-z0-9_.-]+==[0-9][^"''\\s,;]*')) AS pin
  FROM files)
"""

# --- Python files, from part --------------------------------------------------------------------------

PARTS = """
py AS (
  SELECT p_partkey AS k, CAST(p_size AS VARCHAR) AS size, p_name || ' / ' || p_brand || ' / ' || p_type AS label,
    CASE WHEN p_partkey % 3 = 0 THEN 'hot' ELSE p_brand END AS scan_id,
    p_partkey % 5 <> 0 AS b, p_partkey % 3 = 0 AS c, p_partkey % 4 = 0 AS d, p_partkey % 11 = 0 AS bad,
    5 + CASE WHEN p_partkey % 5 <> 0 THEN 8 ELSE 0 END AS c0
  FROM part),
pyfiles AS (
  SELECT *, '/repos/' || scan_id || '/p' || k || '.py' AS path, c0 + CASE WHEN c THEN 3 ELSE 0 END AS d0,
    c0 + CASE WHEN c THEN 3 ELSE 0 END + CASE WHEN d THEN 2 ELSE 0 END AS e0, b AND k % 7 = 0 AND NOT bad AS e
  FROM py),
good AS (SELECT * FROM pyfiles WHERE NOT bad),
functions AS (
  SELECT scan_id, path, 8 AS lineno, 'run_sql_' || k AS name, 'limit' AS args, 'tool' AS decorators FROM good WHERE b
  UNION ALL SELECT scan_id, path, c0, 'delete_rows_' || k, 'table', '' FROM good WHERE c
  UNION ALL SELECT scan_id, path, e0 + 5, 'purge_' || k, 'row', '' FROM good WHERE e),
calls_at AS (
  SELECT scan_id, path, 1 AS depth, 4 AS lineno, 'load_model(LABEL, ' || size || ')' AS call FROM good
  UNION ALL SELECT scan_id, path, 1, d0, 'MemorySaver()' FROM good WHERE d
  UNION ALL SELECT scan_id, path, 1, d0 + 1, 'graph.compile(' || CASE WHEN k % 8 = 0 THEN 'checkpointer=saver' ELSE '' END || ')' FROM good WHERE d
  UNION ALL SELECT scan_id, path, 2, 10, 'model.invoke(prompt)' FROM good WHERE b
  UNION ALL SELECT scan_id, path, 2, 11, 'execute(clean(llm_output))' FROM good WHERE b
  UNION ALL SELECT scan_id, path, 2, 12, 'eval(limit)' FROM good WHERE b
  UNION ALL SELECT scan_id, path, 2, c0 + 1, CASE WHEN k % 2 = 0 THEN 'require_admin(table)' ELSE 'pass_through(table)' END FROM good WHERE c
  UNION ALL SELECT scan_id, path, 2, c0 + 2, 'drop(f''remove every row from {table}'')' FROM good WHERE c
  UNION ALL SELECT scan_id, path, 3, 11, 'clean(llm_output)' FROM good WHERE b
  UNION ALL SELECT scan_id, path, 2, e0 + 9, 'exec(spare, passed)' FROM good WHERE e),
assigned AS (
  SELECT scan_id, path, 1 AS depth, 3 AS lineno, 'LABEL' AS targets, '''' || label || '''' AS value FROM good
  UNION ALL SELECT scan_id, path, 1, 4, 'model', 'load_model(LABEL, ' || size || ')' FROM good
  UNION ALL SELECT scan_id, path, 1, d0, 'saver', 'MemorySaver()' FROM good WHERE d
  UNION ALL SELECT scan_id, path, 1, d0 + 1, 'app', 'graph.compile(' || CASE WHEN k % 8 = 0 THEN 'checkpointer=saver' ELSE '' END || ')' FROM good WHERE d
  UNION ALL SELECT scan_id, path, 2, 9, 'prompt', '''Answer: '' + user_input' FROM good WHERE b
  UNION ALL SELECT scan_id, path, 2, 10, 'llm_output', 'model.invoke(prompt)' FROM good WHERE b
  UNION ALL SELECT scan_id, path, 2, 11, 'result', 'execute(clean(llm_output))' FROM good WHERE b
  UNION ALL SELECT scan_id, path, depth, e0 + step, targets, value FROM good, (
    VALUES (1, 0, 'asked', 'user_message'), (1, 1, 'copied', 'asked'), (1, 2, 'system_prompt', 'copied'), (1, 3, 'copied', '''fixed'''),
      (1, 4, 'late_prompt', 'copied'), (2, 6, 'spare', 'row'), (2, 7, 'reply', 'model_reply'), (2, 8, 'passed', 'reply')
  ) AS flow(depth, step, targets, value) WHERE e),
literals AS (
  SELECT scan_id, path, 1 AS depth, 3 AS lineno, label AS value FROM good WHERE length(label) > 20
  UNION ALL SELECT scan_id, path, 2, c0 + 2, 'remove every row from ' FROM good WHERE c)
"""


def _ordered(source: str, columns: str, order: str = "depth, lineno") -> str:
    return (
        f"SELECT scan_id, path, row_number() OVER (PARTITION BY path ORDER BY {order}) - 1 AS pos, "
        f"{columns}, CAST(lineno AS BIGINT) AS lineno FROM {source}"
    )


# The indented JSON of one file's facts, put together from its parts.
def _objects(source: str, fields: str, order: str) -> str:
    """Text of a list of objects, one per row of ``source`` for the file ``g``."""
    return (
        f"coalesce((SELECT '[' || chr(10) || string_agg('      {{' || chr(10) || {fields} || chr(10) || '      }}', "
        f"',' || chr(10) ORDER BY {order}) || chr(10) || '    ]' FROM {source} s WHERE s.path = g.path), '[]')"
    )


def _field(name: str, value: str, last: bool = False) -> str:
    return f"'        \"{name}\": ' || {value}" + ("" if last else " || ',' || chr(10)")


def _single(value: str) -> str:
    return f"'[' || chr(10) || '          \"' || {value} || '\"' || chr(10) || '        ]'"


def _text(value: str) -> str:
    return f"'\"' || {value} || '\"'"


_FUNCTIONS = " || ".join([
    _field("name", _text("name")), _field("lineno", "lineno"), _field("args", _single("args")),
    _field("decorators", f"CASE WHEN decorators = '' THEN '[]' ELSE {_single('decorators')} END", True),
])
_CALLS = " || ".join([_field("call", _text("call")), _field("lineno", "lineno", True)])
_ASSIGNED = " || ".join([
    _field("targets", _single("targets")), _field("value", _text("value")), _field("lineno", "lineno", True),
])
_LITERALS = " || ".join([_field("value", _text("value")), _field("lineno", "lineno", True)])
_CLASS = " || ".join([
    _field("name", _text("'State' || k")), _field("lineno", "5"), _field("bases", _single("'TypedDict'"), True),
])

PROMPTS = f"""
SELECT scan_id, path, {_q(V.PROMPT_PREAMBLE)} || '{{' || chr(10) || '  "' || path || '": {{' || chr(10)
  || '    "filepath": "' || path || '",' || chr(10)
  || '    "functions": ' || {_objects("functions", _FUNCTIONS, "lineno")} || ',' || chr(10)
  || '    "classes": ' || CASE WHEN b THEN '[' || chr(10) || '      {{' || chr(10) || {_CLASS} || chr(10) || '      }}' || chr(10) || '    ]' ELSE '[]' END || ',' || chr(10)
  || '    "imports": [' || chr(10) || '      "import os",' || chr(10)
  || '      "from langgraph.graph import StateGraph, END"' || chr(10) || '    ],' || chr(10)
  || '    "calls": ' || {_objects("calls_at", _CALLS, "depth, lineno")} || ',' || chr(10)
  || '    "assignments": ' || {_objects("assigned", _ASSIGNED, "depth, lineno")} || ',' || chr(10)
  || '    "strings": ' || {_objects("literals", _LITERALS, "depth, lineno")} || chr(10)
  || '  }}' || chr(10) || '}}' AS prompt
FROM good g WHERE b OR c
"""

LONG_PROMPTS = f"""
WITH counted AS (
  SELECT source AS scan_id, '/repos/d' || doc_id || '.py' AS path, length(string_split(text, ' ')) AS n
  FROM documents),
facts AS (
  SELECT *, '{{' || chr(10) || '  "' || path || '": {{' || chr(10) || '    "filepath": "' || path || '",' || chr(10)
    || '    "functions": [' || chr(10) || '      {{' || chr(10) || '        "name": "f",' || chr(10)
    || '        "lineno": 1,' || chr(10) || '        "args": [' || chr(10) || '          "a"' || chr(10)
    || '        ],' || chr(10) || '        "decorators": []' || chr(10) || '      }}' || chr(10) || '    ],' || chr(10)
    || '    "classes": [],' || chr(10) || '    "imports": [],' || chr(10) || '    "calls": [],' || chr(10)
    || '    "assignments": [' || chr(10)
    || array_to_string(list_transform(range(3, CAST(n + 3 AS BIGINT)), lambda i:
      '      {{' || chr(10) || '        "targets": [' || chr(10) || '          "x"' || chr(10) || '        ],' || chr(10)
      || '        "value": "y",' || chr(10) || '        "lineno": ' || i || chr(10) || '      }}'), ',' || chr(10))
    || chr(10) || '    ],' || chr(10) || '    "strings": []' || chr(10) || '  }}' || chr(10) || '}}' AS body
  FROM counted),
made AS (
  SELECT scan_id, path, {_q(V.PROMPT_PREAMBLE)} || CASE WHEN length(body) > {V.PROMPT_LIMIT}
    THEN body[:{V.PROMPT_LIMIT}] || {_q(V.PROMPT_CUT_MARK)} ELSE body END AS prompt
  FROM facts)
SELECT scan_id, path, length(prompt) AS n_chars, md5(prompt) AS digest FROM made
"""

# --- JavaScript files, from supplier and customer -----------------------------------------------------

SCRIPTS = """
owners AS (
  SELECT 'js' AS kind, s_suppkey AS k, s_name AS owner FROM supplier
  UNION ALL SELECT 'ts', c_custkey, c_name FROM customer),
jsfiles AS (
  SELECT *, CASE WHEN k % 3 = 0 THEN 'hot' ELSE 'js' || (k % 7) END AS scan_id,
    CASE WHEN k % 3 = 0 THEN 'hot' ELSE 'js' || (k % 7) END AS s, k % 2 = 0 AS saves, k % 5 = 0 AS templated, k % 13 = 0 OR k % 17 = 0 OR k % 19 = 0 OR k % 23 = 0 OR k % 29 = 0 AS broken,
    CASE kind WHEN 'ts' THEN ': string' ELSE '' END AS mark
  FROM owners),
js AS (
  SELECT *, '/repos/' || s || '/n' || k || '.' || kind AS path, CASE WHEN saves THEN 24 ELSE 22 END AS t0,
    22 + CASE WHEN saves THEN 2 ELSE 0 END + CASE WHEN templated THEN 1 ELSE 0 END AS n0
  FROM jsfiles),
whole AS (SELECT * FROM js WHERE NOT broken),
js_functions AS (
  SELECT scan_id, path, 0 AS pos, 'runCommand' || k AS name, 12 AS lineno, ['input', 'limit', 'rest'] AS args FROM whole
  UNION ALL SELECT scan_id, path, 1, 'pick', 18, ['a', 'b'] FROM whole
  UNION ALL SELECT scan_id, path, 2, 'one', 19, ['item'] FROM whole
  UNION ALL SELECT scan_id, path, 3, 'spread', n0 + 7, ['input', 'depth'] FROM whole
  UNION ALL SELECT scan_id, path, 4, 'second', n0 + 13, ['x'] FROM whole
  UNION ALL SELECT scan_id, path, 5, 'line', n0 + 14, ['x'] FROM whole
  UNION ALL SELECT scan_id, path, 6, 'same', n0 + 25, ['x'] FROM whole WHERE kind = 'ts'
  UNION ALL SELECT scan_id, path, 7, 'wide', n0 + 26, ['x'] FROM whole WHERE kind = 'ts'),
js_calls AS (
  SELECT scan_id, path, 9 AS lineno, 0 AS depth, 'step(state)' AS call FROM whole
  UNION ALL SELECT scan_id, path, 12, 0, 'max(1, 2)' FROM whole
  UNION ALL SELECT scan_id, path, 15, 0, 'add(total, ' || k || ')' FROM whole
  UNION ALL SELECT scan_id, path, 16, 0, 'eval(input)' FROM whole
  UNION ALL SELECT scan_id, path, 22, 0, 'new MemorySaver()' FROM whole WHERE saves
  UNION ALL SELECT scan_id, path, 23, 0, 'graph.compile({ checkpointer: memory })' FROM whole WHERE saves
  UNION ALL SELECT scan_id, path, n0 + 4, 0, 'test(label)' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 11, 0, 'eval(input)' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 14, 0, 'wrap(x)' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 15, 0, 'step(1)' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 15, 1, 'then(go)' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 16, 0, 'catch(stop)' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 17, 0, 'test(label)' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 18, 0, 'go(x)' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 19, 0, 'inner(1)' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 20, 0, 'probe(label)' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 24, 0, 'send({ body: passed })' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 25, 0, 'show(label)' FROM whole WHERE kind = 'js'
  UNION ALL SELECT scan_id, path, n0 + 26, 0, 'probe(x)' FROM whole WHERE kind = 'ts'),
js_assigned AS (
  SELECT scan_id, path, 6 AS lineno, 0 AS depth, 'label' AS targets, '"owner of this file: ' || owner || '"' AS value FROM whole
  UNION ALL SELECT scan_id, path, 13, 0, 'rawLlmOutput', 'state.llmOutput' FROM whole
  UNION ALL SELECT scan_id, path, 15, 0, 'total', 'add(total, ' || k || ')' FROM whole
  UNION ALL SELECT scan_id, path, 18, 0, 'pick', '(a' || mark || ', b) => a + b' FROM whole
  UNION ALL SELECT scan_id, path, 19, 0, 'one', 'item => item' FROM whole
  UNION ALL SELECT scan_id, path, 21, 0, 'later', '' FROM whole
  UNION ALL SELECT scan_id, path, 22, 0, 'memory', 'new MemorySaver()' FROM whole WHERE saves
  UNION ALL SELECT scan_id, path, 23, 0, 'app', 'graph.compile({ checkpointer: memory })' FROM whole WHERE saves
  UNION ALL SELECT scan_id, path, t0, 0, 'text', '`a template literal of ${label} that goes on and on`' FROM whole WHERE templated
  UNION ALL SELECT scan_id, path, n0 + 4, 0, 'odd', '/[(]/.test(label)' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 5, 0, 'prompt',
    '`first line of a system prompt' || chr(10) || 'second ${label} line that is quite long`' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 13, 0, 'first', '1' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 13, 1, 'second', '(x) => x' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 14, 0, 'y', 'wrap(x)' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 14, 1, 'y.z', '2' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 18, 0, 'handle', 'async (x) => go(x)' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 19, 0, 'deep', repeat('[', 20) || 'inner(1)' || repeat(']', 20) FROM whole
  UNION ALL SELECT scan_id, path, n0 + 20, 0, 'tail',
    '`a ${first ? `b ${probe(label)} c` : "}"} and a tail longer than twenty`' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 21, 0, 'spaced', '/[)]/' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 22, 0, 'reply', 'state.modelReply' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 23, 0, 'passed', 'reply' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 25, 0, 'same', '<T>(x: T): T => x' FROM whole WHERE kind = 'ts'
  UNION ALL SELECT scan_id, path, n0 + 25, 0, 'view', '<p title="a title longer than twenty">don''t ( {show(label)}</p>' FROM whole WHERE kind = 'js'),
js_literals AS (
  SELECT scan_id, path, 6 AS lineno, 0 AS depth, 'owner of this file: ' || owner AS value FROM whole
  UNION ALL SELECT scan_id, path, t0, 0, 'a template literal of ' FROM whole WHERE templated
  UNION ALL SELECT scan_id, path, n0 + 5, 0, 'first line of a system prompt' || chr(10) || 'second ' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 5, 1, ' line that is quite long' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 20, 0, ' and a tail longer than twenty' FROM whole
  UNION ALL SELECT scan_id, path, n0 + 25, 0, 'a title longer than twenty' FROM whole WHERE kind = 'js')
"""

# --- inventories, from part ---------------------------------------------------------------------------

INVENTORIES = f"""
installed AS (
  SELECT CASE WHEN p_partkey % 3 = 0 THEN 'hot' ELSE p_brand END AS scan_id,
    {_pick("p_partkey", derived.PACKAGES)} AS package,
    CASE WHEN p_partkey % 41 <> 0 THEN replace(replace({_pick("p_partkey // 6", derived.VERSIONS)},
      '%s', CAST(p_size AS VARCHAR)), '%k', CAST(p_partkey AS VARCHAR)) END AS version
  FROM part),
runs AS (
  SELECT *, list_transform(regexp_extract_all(split_part(version, '+', 1), '[0-9]+'),
    lambda r: CASE WHEN ltrim(r, '0') = '' THEN '0' ELSE ltrim(r, '0') END) AS r
  FROM installed),
triples AS (
  SELECT *, list_transform(t, lambda r: lpad(CAST(length(r) AS VARCHAR), 10, '0') || r) AS sized
  FROM (SELECT *, CASE WHEN version IS NOT NULL THEN [coalesce(r[1], '0'), coalesce(r[2], '0'), coalesce(r[3], '0')] END AS t FROM runs)),
advisories(adv_pos, package, cve, affected_below, severity, description, remediation) AS (
  VALUES {", ".join("(" + ", ".join([str(i), *map(_q, row)]) + ")" for i, row in enumerate(V.ADVISORIES))}),
thresholds AS (
  SELECT *, list_transform(string_split(affected_below, '.'), lambda r: lpad(CAST(length(r) AS VARCHAR), 10, '0') || r) AS below
  FROM advisories),
vulnerable AS (
  SELECT i.scan_id, a.*, i.version AS installed
  FROM triples i JOIN thresholds a ON lower(regexp_replace(i.package, '[-_.]+', '-', 'g')) = a.package
  WHERE i.sized < a.below)
"""

# --- screens ------------------------------------------------------------------------------------------

_VERDICTS = {
    "ASI01": ("User input reaches a prompt", "high", "Separate instructions from user text."),
    "ASI02": ("Tool accepts unchecked input", "high", "Validate arguments against an allow list."),
    "ASI03": ("Secret field in shared state", "medium", "Keep secrets out of the state."),
    "ASI05": ("Dependency with a known advisory", "high", "Raise the pinned version."),
    "ASI06": ("Destructive operation without authorisation", "critical", "Check the caller first."),
    "ASI07": ("Model output passed on unchecked", "high", "Validate output before using it."),
    "ASI08": ("State persisted without validation", "medium", "Validate state before it is saved."),
}


def _screen(vector: str, hits: str) -> str:
    """Candidate rows for ``hits(scan_id, path, line, evidence)``."""
    title, severity, remediation = _VERDICTS[vector]
    return (
        f"SELECT scan_id, '{vector}' AS owasp_id, '{title}' AS title, '{title}: ' || evidence AS description, "
        f"'{severity}' AS severity, path AS file, CAST(line AS BIGINT) AS line, '{remediation}' AS remediation FROM ({hits})"
    )


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(part.strip() for part in parts) + "\n"


REPORT_LINES = f"""
            SELECT scan_id, CAST(0 AS BIGINT) AS report_pos,
              '{{"tool_version":"{V.REPORT_VERSION}","timestamp":"{TIMESTAMP}","total_findings":' || total_findings
              || ',"summary":{{"critical":' || critical || ',"high":' || high || ',"medium":' || medium || ',"low":' || low
              || '}}}}' AS report FROM summary
            UNION ALL SELECT scan_id, CAST(report_pos AS BIGINT), CAST(json_object('id', id, 'owasp_id', owasp_id, 'title', title,
              'description', description, 'severity', severity, 'file', file, 'line', line, 'remediation', remediation) AS VARCHAR)
            FROM ranked"""


def all_oracles() -> dict[str, str]:
    findings, replies, files = _with(FINDINGS), _with(RESPONSES), _with(FILES)
    py, js, packages = _with(PARTS), _with(SCRIPTS), _with(INVENTORIES)
    both = _with(PARTS, SCRIPTS)
    return {
        # files
        "s1_collect_source_files": files + "SELECT scan_id, path, ext FROM collected",
        "s1_source_tree": files + """
            SELECT scan_id, rel_path, relevant, length(text) AS n_chars, md5(text) AS digest
            FROM (SELECT *, bool_or(relevant) OVER (PARTITION BY scan_id) AS any_one FROM collected)
            WHERE relevant OR NOT any_one""",
        "s2_single_file_target": files + f"SELECT scan_id, path FROM files WHERE ext IN {_in(V.SOURCE_SUFFIXES)}",
        "s3_target_status": files + f"""
            SELECT DISTINCT scan_id, '/repos/' || scan_id AS target_path, CAST(NULL AS VARCHAR) AS error FROM files
            UNION ALL SELECT 'gone-' || r_name, '/repos/gone-' || r_name,
              {_q(V.MISSING_TARGET)} || '/repos/gone-' || r_name FROM region""",
        "s4_read_text": files + "SELECT scan_id, path, length(text) AS n_chars, md5(text) AS digest FROM files",
        "s5_reply_envelope": "SELECT doc_id, length(text) AS n_chars, md5(text) AS digest FROM documents",
        "f1_supported_suffix": files + f"""
            SELECT scan_id, ext, count(*) AS n_files FROM files WHERE ext IN {_in(V.SOURCE_SUFFIXES)} GROUP BY ALL""",
        "f2_outside_pruned_directories": files + "SELECT scan_id, path FROM walked WHERE open",
        "f3_relevant_python": files + f"""
            SELECT scan_id, path, coalesce({_any("text", V.PY_MARKERS)}, false) AS relevant FROM files WHERE ext = '.py'""",
        "f4_relevant_js": files + f"""
            SELECT scan_id, path, coalesce({_any("text", V.JS_MARKERS)}, false) AS relevant
            FROM files WHERE ext IN ('.js', '.ts', '.mjs')""",
        "f5_select_or_fall_back": files + """
            SELECT scan_id, path, relevant FROM collected c WHERE relevant
              OR scan_id NOT IN (SELECT scan_id FROM collected WHERE relevant)""",
        "j4_selected_with_flag": files + """
            SELECT scan_id, path FROM (SELECT *, bool_or(relevant) OVER (PARTITION BY scan_id) AS any_one FROM collected)
            WHERE relevant OR NOT any_one""",
        "a4_file_census": files + """
            SELECT scan_id, found, CASE WHEN n > 0 THEN n ELSE found END AS selected,
              CASE WHEN n > 0 THEN found - n ELSE 0 END AS excluded
            FROM (SELECT scan_id, count(*) AS found, count(*) FILTER (relevant) AS n FROM collected GROUP BY scan_id)""",
        "a5_pruned_directories": files + """
            SELECT scan_id, CAST(len(names) AS BIGINT) AS n_names, array_to_string(names, ',') AS names FROM named""",
        "o1_file_order": files + """
            SELECT scan_id, path, row_number() OVER (PARTITION BY scan_id ORDER BY path) AS file_order FROM collected""",
        "o4_directory_sample": files + "SELECT scan_id, array_to_string(names[1:3], ', ') AS sample FROM named",
        # facts
        "x1_python_functions": py + """
            SELECT scan_id, path, row_number() OVER (PARTITION BY path ORDER BY lineno) - 1 AS pos, name,
              CAST(lineno AS BIGINT) AS lineno, args, decorators FROM functions""",
        "x2_python_classes": py + """
            SELECT scan_id, path, CAST(0 AS BIGINT) AS pos, 'State' || k AS name, CAST(5 AS BIGINT) AS lineno,
              'TypedDict' AS bases FROM good WHERE b""",
        "x3_python_imports": py + """
            SELECT scan_id, path, CAST(0 AS BIGINT) AS pos, 'import os' AS "import" FROM good
            UNION ALL SELECT scan_id, path, 1, 'from langgraph.graph import StateGraph, END' FROM good""",
        "x4_python_calls": py + _ordered("calls_at", "call"),
        "x5_python_assignments": py + _ordered("assigned", "targets, value"),
        "x6_python_strings": py + _ordered("literals", "value"),
        "x7_python_parse_errors": py + """
            SELECT scan_id, path, 'parse' AS stage, '''('' was never closed (p' || k || '.py, line '
              || (d0 + CASE WHEN d THEN 2 ELSE 0 END) || ')' AS reason FROM pyfiles WHERE bad""",
        "x8_language_dispatch": both + """
            , per_file AS (
              SELECT f.scan_id, 'py' AS lang, bad AS failed,
                CASE WHEN bad THEN 0 ELSE 1 + CASE WHEN d THEN 2 ELSE 0 END + CASE WHEN b THEN 4 ELSE 0 END
                  + CASE WHEN c THEN 2 ELSE 0 END + CASE WHEN e THEN 1 ELSE 0 END END AS n FROM pyfiles f
              UNION ALL SELECT scan_id, 'js', broken,
                CASE WHEN broken THEN 0 ELSE 16 + CASE WHEN saves THEN 2 ELSE 0 END END FROM js)
            SELECT scan_id, lang, count(*) AS n_files, count(*) FILTER (failed) AS n_errors,
              CAST(sum(n) AS BIGINT) AS n_calls FROM per_file GROUP BY ALL""",
        "x9_js_functions": js + """
            SELECT scan_id, path, CAST(pos AS BIGINT) AS pos, name, CAST(lineno AS BIGINT) AS lineno,
              CAST(0 AS BIGINT) AS n_decorators FROM js_functions""",
        "x10_js_parameters": js + """
            SELECT scan_id, path, name, generate_subscripts(args, 1) - 1 AS at, unnest(args) AS arg FROM js_functions""",
        "x11_js_classes": js + """
            SELECT scan_id, path, CAST(0 AS BIGINT) AS pos, 'Node' || k AS name, CAST(7 AS BIGINT) AS lineno,
              'base.Node' AS bases FROM whole""",
        "x12_js_imports": js + """
            SELECT scan_id, path, CAST(0 AS BIGINT) AS pos,
              'import { StateGraph } from "@langchain/langgraph";' AS "import" FROM whole
            UNION ALL SELECT scan_id, path, 1, 'import {' || chr(10) || '  tool,' || chr(10) || '} from ''@langchain/core'';' FROM whole""",
        "x13_js_calls": js + _ordered("js_calls", "call", "lineno, depth"),
        "x14_js_assignments": js + _ordered("js_assigned", "targets, value", "lineno, depth"),
        "x15_js_strings": js + _ordered("js_literals", "value", "lineno, depth"),
        "x16_js_parse_errors": js + f"""
            SELECT scan_id, path, 'parse' AS stage, {_q(V.JS_SYNTAX_ERROR)} AS reason FROM js WHERE broken""",
        "f6_eligible_files": py + "SELECT scan_id, path FROM good WHERE b OR c",
        "f13_long_literals": """
            SELECT source AS scan_id, CAST(doc_id AS VARCHAR) AS path, text[:200] AS value, CAST(1 AS BIGINT) AS lineno
            FROM documents WHERE length(text) > 20""",
        "a9_skip_census": py + """
            SELECT scan_id, CASE WHEN bad THEN 'parse_error' ELSE 'empty' END AS skip_reason, count(*) AS n_files
            FROM pyfiles WHERE bad OR NOT (b OR c) GROUP BY ALL""",
        # prompts
        "t1_prompts": py + PROMPTS,
        "o5_prompt_cut": LONG_PROMPTS,
        "j1_endpoint_routing": f"""
            WITH chosen AS (SELECT 'order' || o_orderkey AS scan_id, CASE o_orderpriority
              WHEN '1-URGENT' THEN 'reasoning' WHEN '2-HIGH' THEN 'fast' WHEN '3-MEDIUM' THEN 'turbo' END AS model FROM orders)
            SELECT scan_id, model, CASE WHEN model = 'reasoning' THEN 'reasoning' ELSE 'fast' END AS model_key,
              CASE WHEN model = 'reasoning' THEN {_q(V.ENDPOINTS[1][1])} ELSE {_q(V.ENDPOINTS[0][1])} END AS url,
              CASE WHEN model = 'reasoning' THEN {_q(V.ENDPOINTS[1][2])} ELSE {_q(V.ENDPOINTS[0][2])} END AS model_name
            FROM chosen""",
        # replies
        "j2_match_responses": replies + """
            SELECT scan_id, path, CASE WHEN file_order % 17 = 3 THEN 'error' ELSE status END AS status,
              CASE WHEN file_order % 17 = 3 THEN 'no response' ELSE detail END AS detail FROM responses""",
        "j2_resumed_calls": replies + """
            SELECT scan_id, path, 'ok' AS status,
              CASE WHEN file_order % 3 = 1 THEN 'first u ' ELSE 'second u ' END || file_order AS raw FROM responses""",
        "f11_before_connection_loss": replies + "SELECT scan_id, path, status FROM reached",
        "f12_failed_calls": replies + """
            SELECT scan_id, path, 'call' AS stage, status AS reason, detail AS payload FROM reached WHERE status = 'error'""",
        "t2_drop_thinking": replies + f"""
            SELECT scan_id, path, CASE WHEN contains(raw, '<think>') AND contains(raw, '</think>')
              THEN trim(list_last(string_split(raw, '</think>')), {BLANKS}) ELSE trim(raw, {BLANKS}) END AS text
            FROM responses WHERE status = 'ok'""",
        "t3_unfence": replies + f"""
            , parts AS (SELECT scan_id, path, raw, unnest(string_split(raw, '```')) AS part,
                generate_subscripts(string_split(raw, '```'), 1) AS nth FROM responses WHERE status = 'ok'),
            bodies AS (SELECT scan_id, path, raw, nth, trim(regexp_replace(trim(part, {BLANKS}), '^json', ''), {BLANKS}) AS body FROM parts)
            SELECT scan_id, path, CASE WHEN contains(raw, '```') THEN coalesce(
                arg_min(body, nth) FILTER (starts_with(body, '[') OR starts_with(body, '{{')), trim(raw, {BLANKS}))
              ELSE trim(raw, {BLANKS}) END AS text
            FROM bodies GROUP BY scan_id, path, raw""",
        "t4_bracket_slice": replies + """
            SELECT scan_id, path, CASE WHEN contains(raw, '[') AND contains(raw, ']')
              THEN regexp_extract(raw, '(?s)\\[.*\\]') ELSE raw END AS text
            FROM responses WHERE status = 'ok'""",
        "t5_json_decode": replies + "SELECT scan_id, path, text, reply_error, n_items FROM counted",
        "t6_explode_items": replies + """
            SELECT scan_id, path, CAST(pos AS BIGINT) AS pos, CASE WHEN item_error IS NOT NULL THEN item_error = 'not_an_object' END AS stray FROM typed""",
        "t7_defaults": replies + """
            SELECT scan_id, path, CAST(pos AS BIGINT) AS pos, owasp_id, title, description, severity, file, line, remediation
            FROM typed WHERE item_error IS NULL""",
        "t8_type_checks": replies + "SELECT scan_id, path, CAST(pos AS BIGINT) AS pos, item_error FROM typed",
        "t9_rejects": replies + """
            , rejects AS (
              SELECT scan_id, path, NULL AS seq, 'call' AS stage, status AS reason FROM reached WHERE status = 'error'
              UNION ALL SELECT scan_id, path, NULL, 'reply', reply_error FROM parsed WHERE reply_error IS NOT NULL
              UNION ALL SELECT scan_id, path, seq, 'item', item_error FROM numbered WHERE item_error IS NOT NULL)
            SELECT scan_id, stage, reason, count(*) AS n, max(seq) AS last_seq, max(path) AS last_path FROM rejects GROUP BY ALL""",
        "o2_finding_ids": replies + "SELECT scan_id, path, seq, id, title FROM numbered WHERE item_error IS NULL",
        "a7_findings_per_file": replies + """
            , per_file AS (
              SELECT p.scan_id, p.path, count(t.path) AS n_findings
              FROM parsed p LEFT JOIN (SELECT * FROM typed WHERE item_error IS NULL) t
                ON p.scan_id = t.scan_id AND p.path = t.path GROUP BY p.scan_id, p.path)
            SELECT * FROM per_file
            UNION ALL SELECT scan_id, NULL, CAST(sum(n_findings) AS BIGINT) FROM per_file GROUP BY scan_id""",
        # findings
        "f7_title_check": findings + "SELECT scan_id, seq, title FROM findings WHERE title NOT IN ('', 'Untitled finding')",
        "f8_vector_check": findings + f"SELECT scan_id, seq, owasp_id FROM findings WHERE owasp_id IN {_in(V.VECTORS)}",
        "f9_description_check": findings + "SELECT scan_id, seq, description FROM findings WHERE length(description) > 9",
        "f10_validate": findings + "SELECT scan_id, seq, reject_reason FROM checked",
        "a3_keep_worst": findings + f"SELECT scan_id, {EIGHT}, first_seq FROM kept",
        "o3_report_order": findings + "SELECT scan_id, report_pos, id, severity FROM ranked",
        "a6_stage_counters": findings + """
            SELECT scan_id, count(*) AS received, count(reject_reason) AS discarded,
              count(*) - count(reject_reason) - count(DISTINCT CASE WHEN reject_reason IS NULL THEN (file, owasp_id, title) END) AS duplicates,
              count(DISTINCT CASE WHEN reject_reason IS NULL THEN (file, owasp_id, title) END) AS kept
            FROM checked GROUP BY scan_id""",
        "a1_severity_summary": findings + """
            SELECT scan_id, CASE WHEN total_findings = 0 THEN 0 ELSE critical END AS critical, high, medium, low FROM summary""",
        "a2_total_findings": findings + "SELECT scan_id, total_findings FROM summary",
        "f15_strict_gate": findings + "SELECT scan_id, critical > 0 OR high > 0 AS gate_failed FROM summary",
        "s9_findings_rows": findings + f"SELECT scan_id, report_pos, {EIGHT} FROM ranked",
        "a8_report": findings + f"""
            SELECT scan_id, '{V.REPORT_VERSION}' AS tool_version, '{TIMESTAMP}' AS "timestamp", total_findings,
              critical, high, medium, low FROM summary""",
        "s8_report_json": findings + REPORT_LINES,
        "s8_report_files": findings + f"SELECT scan_id, report FROM ({REPORT_LINES})",
        "p1_location": findings + f"SELECT scan_id, seq, {LOCATION} AS location FROM findings",
        "p2_findings_table": findings + f"""
            SELECT scan_id, report_pos, id, upper(severity) AS severity, owasp_id, title, {LOCATION} AS location FROM ranked""",
        "p3_remediation_steps": findings + f"""
            , steps AS (SELECT scan_id, id, list_filter(list_transform(string_split(remediation, chr(10)),
              lambda l: trim(l, {BLANKS})), lambda l: l <> '') AS lines FROM findings)
            SELECT scan_id, id, generate_subscripts(lines, 1) - 1 AS step, unnest(lines) AS text FROM steps""",
        "p4_report_time": """
            SELECT event_id, CASE WHEN microsecond(ts) % 1000000 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
              ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END || '+00:00' AS "timestamp",
              strftime(ts, '%Y-%m-%d %H:%M UTC') AS header FROM events""",
        "audit_findings": replies + f"""
            , valid AS (SELECT * FROM numbered WHERE item_error IS NULL AND title NOT IN ('', 'Untitled finding')
              AND owasp_id IN {_in(V.VECTORS)} AND length(description) >= 10),
            placed AS (SELECT *, min(seq) OVER (PARTITION BY scan_id, file, owasp_id, title) AS first_seq,
              row_number() OVER (PARTITION BY scan_id, file, owasp_id, title ORDER BY {RANK} DESC, seq) AS nth FROM valid)
            SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY {RANK} DESC, first_seq) AS report_pos, {EIGHT}
            FROM placed WHERE nth = 1""",
        # packages
        "audit_run": py + """
            , answered AS (SELECT scan_id, count(*) AS n FROM good WHERE (b OR c) AND k % 7 <> 0 GROUP BY scan_id),
            everyone AS (SELECT DISTINCT scan_id FROM pyfiles)
            SELECT e.scan_id, CAST(0 AS BIGINT) AS critical, CAST(coalesce(n, 0) AS BIGINT) AS high, CAST(0 AS BIGINT) AS medium,
              CAST(0 AS BIGINT) AS low, CAST(coalesce(n, 0) AS BIGINT) AS total_findings, coalesce(n, 0) > 0 AS gate_failed,
              CAST(coalesce(n, 0) + 1 AS BIGINT) AS n_lines
            FROM everyone e LEFT JOIN answered a ON e.scan_id = a.scan_id""",
        "s6_advisories": packages + """
            SELECT CAST(adv_pos AS BIGINT) AS adv_pos, a.package, cve, affected_below, severity, count(i.scan_id) AS n_installed
            FROM advisories a LEFT JOIN installed i ON lower(regexp_replace(i.package, '[-_.]+', '-', 'g')) = a.package
            GROUP BY ALL""",
        "s7_inventory": packages + """
            SELECT scan_id, lower(regexp_replace(package, '[-_.]+', '-', 'g')) AS package, version FROM installed""",
        "c1_version_triples": packages + """
            SELECT scan_id, package, version, t[1] AS major, t[2] AS minor, t[3] AS patch,
              array_to_string(sized, '.') AS version_key FROM triples""",
        "f14_below_threshold": packages + """
            SELECT scan_id, package, version, coalesce(sized < ['00000000011', '00000000012', '00000000010'], false) AS below FROM triples""",
        "j3_advisory_match": packages + "SELECT scan_id, CAST(adv_pos AS BIGINT) AS adv_pos, package, installed, cve FROM vulnerable",
        "c2_vulnerability_rows": packages + """
            SELECT scan_id, package, installed, affected_below, cve, severity, description, remediation FROM vulnerable""",
        "c3_display_rows": packages + """
            SELECT scan_id, package, installed, cve, upper(severity) AS severity, description, 'Fix: ' || remediation AS fix FROM vulnerable""",
        "c4_scan_status": packages + """
            , everyone AS (SELECT DISTINCT scan_id FROM installed UNION ALL SELECT n_name FROM nation)
            SELECT e.scan_id, count(v.scan_id) AS n_vulnerable, count(v.scan_id) = 0 AS clean
            FROM everyone e LEFT JOIN vulnerable v ON e.scan_id = v.scan_id GROUP BY e.scan_id""",
        "c5_pinned_requirements": files + """
            SELECT scan_id, path, split_part(pin, '==', 1) AS package, pin[strpos(pin, '==') + 2:] AS version FROM pins""",
        # screens
        "v1_prompt_injection": py + _screen(
            "ASI01", """SELECT scan_id, path, 9 AS line, 'prompt' AS evidence FROM good WHERE b
            UNION ALL SELECT scan_id, path, e0 + 2, 'system_prompt' FROM good WHERE e"""),
        "v2_tool_misuse": both + _screen("ASI02", """
            SELECT scan_id, path, 8 AS line, 'run_sql_' || k AS evidence FROM good WHERE b
            UNION ALL SELECT scan_id, path, 12, 'limit' FROM good WHERE b
            UNION ALL SELECT scan_id, path, e0 + 9, 'spare' FROM good WHERE e
            UNION ALL SELECT scan_id, path, 12, 'runCommand' || k FROM whole
            UNION ALL SELECT scan_id, path, 16, 'input' FROM whole
            UNION ALL SELECT scan_id, path, n0 + 11, 'input' FROM whole"""),
        "v3_state_leakage": files + ", " + """
            rows AS (SELECT scan_id, path, unnest(string_split(text, chr(10))) AS l,
              generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files),
            hits AS (SELECT scan_id, path, line, regexp_extract(l,
              '(?i)^\\s*["'']?(\\w*(?:token|password|secret|api_?key)\\w*)["'']?\\s*:\\s*[^\\s:]', 1) AS evidence FROM rows)
            """ + _screen("ASI03", "SELECT * FROM hits WHERE evidence <> ''"),
        "v5_supply_chain": files + ", " + f"""
            thresholds(package, cve, affected_below) AS (
              VALUES {", ".join(f"({_q(r[0])}, {_q(r[1])}, {_q(r[2])})" for r in V.ADVISORIES)}),
            parts AS (SELECT scan_id, path, split_part(pin, '==', 1) AS p, pin[strpos(pin, '==') + 2:] AS v FROM pins
              UNION ALL SELECT scan_id, path, 'langchain-core', '1.0.3' FROM files
              WHERE contains(text, '"@langchain/core@1.0.3"') AND ext IN {_in(V.JS_SUFFIXES)}),
            runs AS (SELECT *, list_transform(regexp_extract_all(split_part(v, '+', 1), '[0-9]+'), lambda x: CAST(x AS HUGEINT)) AS r FROM parts)
            """ + _screen("ASI05", """
            SELECT scan_id, path, NULL AS line, t.package || ' ' || v || ' ' || cve AS evidence
            FROM runs JOIN thresholds t ON lower(regexp_replace(p, '[-_.]+', '-', 'g')) = t.package
            WHERE [coalesce(r[1], 0), coalesce(r[2], 0), coalesce(r[3], 0)]
              < list_transform(string_split(affected_below, '.'), lambda x: CAST(x AS HUGEINT))"""),
        "v6_privilege_escalation": py + _screen("ASI06", """
            SELECT scan_id, path, c0 AS line, 'delete_rows_' || k AS evidence FROM good WHERE c AND k % 2 <> 0
            UNION ALL SELECT scan_id, path, e0 + 5, 'purge_' || k FROM good WHERE e"""),
        "v7_unchecked_output": both + _screen("ASI07", """
            SELECT scan_id, path, 11 AS line, 'llm_output' AS evidence FROM good WHERE b
            UNION ALL SELECT scan_id, path, e0 + 9, 'passed' FROM good WHERE e
            UNION ALL SELECT scan_id, path, 16, 'rawLlmOutput' FROM whole
            UNION ALL SELECT scan_id, path, n0 + 24, 'passed' FROM whole"""),
        "v8_memory_poisoning": both + _screen("ASI08", """
            SELECT scan_id, path, d0 AS line, 'MemorySaver()' AS evidence FROM good WHERE d AND k % 8 = 0
            UNION ALL SELECT scan_id, path, 22, 'new MemorySaver()' FROM whole WHERE saves"""),
    }
