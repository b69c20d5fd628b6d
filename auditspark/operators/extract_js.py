"""Facts of JavaScript and TypeScript files, found with Spark's own functions in a masked text.

``js_scan`` passes over a file once: in what it returns comments are blank, literals are marks, and
brackets that belong together carry the same number. Where a construct may start, a mark with the
line's number is put in; from there a pattern reads on, over several lines if need be, up to the
partner of a bracket or the line end that closes the construct. Marks of literals turn back into the
literals at the end. Every list is built inside the row of its file, so nothing moves.

All repetition is possessive, but for the way from a bracket to its partner, which is one step at a
time: a pattern never goes back over what it has read.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark import fixed_values as V
from auditspark import schemas
from auditspark.functions.text import contains_any, decoded
from auditspark.operators.js_scan import FRESH, LITERAL, LITERAL_END, PAIR, PAIR_END, PLACE, PLACE_END, SOFT, scanned

NAME = r"[A-Za-z_$][\w$]*+"
MASK = rf"{LITERAL}[^{LITERAL_END}]*+{LITERAL_END}"
MARK = rf"{PLACE}\d++{PLACE_END}"
HIDDEN = rf"(?:{MARK}|{PAIR}\d++{PAIR_END}|[{SOFT}{FRESH}])"
# What frames the findings in a text: marks without a number, which no masked text has.
FIND, FIELD, FIND_END = PAIR + PAIR_END, PLACE + PLACE_END, LITERAL + LITERAL_END
_numbers = iter(range(10_000))


def _between(opening: str, closing: str, inner: str = "") -> str:
    """A span from a bracket to its partner; ``inner`` names the group of what lies between."""
    pair = f"p{next(_numbers)}"
    body = r"(?s:.*?)"
    body = f"(?<{inner}>{body})" if inner else body
    return rf"{opening}{PAIR}(?<{pair}>\d++){PAIR_END}{body}{PAIR}\k<{pair}>{PAIR_END}{closing}"


def _bracketed() -> str:
    return _between(r"[(\[{]", r"[)\]}]")


def _typed(inner: str = "") -> str:
    return _between("<", ">", inner)


def _groups(pattern: str) -> dict[str, int]:
    """Numbers of the named groups; all groups that count have names."""
    return {name: at for at, name in enumerate(re.findall(r"\(\?<([A-Za-z]\w*)>", pattern), 1)}


# A line end inside a statement, as something on either side shows that it goes on.
GOES_ON_AFTER = (r"([=+\-*/%&|?:<>,.][ \t]*+)\n", f"$1{SOFT}\n")
GOES_ON_BEFORE = (r"\n(?=\s*+(?:[.?:&|+*/%=<>,-]|instanceof\b|in\b))", f"{SOFT}\n")
# A name behind ``new`` is no call of its own.
AFTER_NEW = (r"(?<![\w$.])new([ \t]++)", f"new$1{FRESH}")
CODE = rf"()\[\]{{}};\n{LITERAL}{PLACE}{PAIR}{SOFT}"


def _statement(stop: str = "") -> str:
    """Code up to the end of a statement, or to the next construct of its kind, so that no text is read again and again."""
    return rf"(?:{MASK}|[^{CODE}<{stop}]++|{_typed()}|<|{_bracketed()}|{SOFT}++\n)*+"


OPENED = rf"{PAIR}\d++{PAIR_END}"
BEGINS = rf"(?:^|[;}}]|\{{{OPENED}|\bexport\b|\bdefault\b)[ \t]*+"
# What a construct starts with: text that stays before the mark, and the start itself.
STARTS = {
    "function": rf"({BEGINS})(?=(?:async[ \t]++)?function[ \t]++{NAME})",
    "class": rf"({BEGINS})(?=class[ \t]++{NAME})",
    "declaration": rf"((?:^|[;}}:]|[{{(]{OPENED}|\bexport\b)[ \t]*+)(?=(?:const|let)\b)",
    "assignment": (
        rf"((?:^|[;}}]|(?:\)|\belse|\bdo)[ \t]*+(?:\{{{PAIR}\d++{PAIR_END})?+|(?:=>|\btry|\bfinally)[ \t]*+\{{{PAIR}\d++{PAIR_END})[ \t]*+)"
        rf"(?={NAME}(?:\.{NAME}|\[[^\[\]]*+\])*+\s*+=(?![=>]))"
    ),
    "call": (
        rf"(^[ \t]*+(?=\??\.)|(?<![\w$.#{FRESH}])|(?<=[)\]])(?=\??\.))"
        rf"(?=(?:new[ \t]++{FRESH})?\??\.?{NAME}(?:[ \t]*+\??\.[ \t]*+#?{NAME})*+[ \t]*+(?:{_typed()})?(?:\?\.)?\()"
    ),
}
# A cheap test that spares most lines the patterns.
HINTS = {
    "function": ("function",), "class": ("class",), "declaration": ("const", "let"), "assignment": ("=",), "call": ("(",),
}

FUNCTION = rf"(?:async[ \t]++)?function[ \t]++(?<name>{NAME})\s*+(?:{_typed()}\s*+)?(?:{_between('[(]', '[)]', 'inside')})?"
CLASS = rf"class[ \t]++(?<name>{NAME})(?:\s*+{_typed()})?(?:\s++extends\s++(?<base>[\w$.]++))?"
DECLARATION = rf"(?:const|let)\b(?<rest>{_statement()})"
ASSIGNMENT = rf"(?<target>{NAME}(?:\.{NAME}|\[[^\[\]]*+\])*+)\s*+=[\s{SOFT}]*+(?<value>{_statement(',')})"
CALL = (
    rf"(?<name>(?:new[ \t]++{FRESH})?\??\.?{NAME}(?:[ \t]*+\??\.[ \t]*+#?{NAME})*+)[ \t]*+(?<types>(?:{_typed()})?(?:\?\.)?)"
    rf"(?<arguments>{_between('[(]', '[)]')})(?<body>\s*+(?::\s*+[\w$<>\[\]|., {PAIR}{PAIR_END}]++)?\{{)?"
)
DECLARATOR = rf"(?:{MASK}|{_typed()}|[^,()\[\]{{}}<{LITERAL}]++|<|{_bracketed()})++"
DECLARED = (
    rf"(?s)^\s*+(?<name>{NAME}|{_between('[{]', '[}]')}|{_between(chr(92) + '[', chr(92) + ']')})\s*+!?+\s*+"
    rf"(?::(?:{MASK}|[^=()\[\]{{}}{LITERAL}]++|=>|{_bracketed()})*+)?(?:=(?!=)\s*+(?<value>.*+))?$"
)
ARROW = (
    rf"^(?:async\b\s*+)?(?:{_typed()}\s*+)?"
    rf"(?:{_between('[(]', '[)]', 'inside')}(?:\s*+:(?:[^=;()\[\]{{}}]++|{_bracketed()}|=>(?=\s*+[\w$.<>| ]++\s*+=>))*+)?|(?<bare>{NAME})\s*+)\s*+=>"
)
IMPORT = (
    rf"(?m)(?:^|;)[ \t]*+(import(?=[\s{{*{LITERAL}{SOFT}])[\w$*{{}},\s{PAIR}{PAIR_END}{SOFT}]*+{MASK}"
    r"(?:[ \t]*+(?:with|assert)\s*+\{[^}]*+\})?;?+)"
)
PARAMETER = rf"^\s*+(?:(?:public|private|protected|readonly)\s++)*+(?:\.\.\.\s*+)?({NAME})"
# An operator that lacks what should follow it, a declaration or a function without its name.
DANGLING = (
    rf"(?:(?<!\+)\+|(?<!-)-|[*/%&|^=<~])\s*+(?:;|{PAIR}\d++{PAIR_END}[)\]])"
    r"|\b(?:const|let)\s*+=(?!=)|(?:\A|[;}])\s*+(?:async\s++)?function\s*+\*?\s*+\("
)
NOT_CALLS = (
    "if", "for", "while", "switch", "catch", "function", "return", "await", "typeof", "with", "super", "async", "case", "in", "of",
    "new", "delete", "void", "throw", "yield", "else", "do",
)


def _no_names() -> Column:
    return F.array().cast("array<string>")


def _restored(text: Column, tokens: Column) -> Column:
    """Code with its literals, without marks."""
    place = lambda piece: F.regexp_extract(piece, r"(\d++)", 1).cast("int")

    def put_back(code: Column) -> Column:
        pieces = F.regexp_extract_all(code, F.lit(rf"({LITERAL}[^{LITERAL_END}]*+{LITERAL_END}?+|[^{LITERAL}]++)"), 1)
        found = F.transform(
            pieces,
            lambda piece: F.when(F.startswith(piece, F.lit(LITERAL)), F.get(tokens, place(piece))).otherwise(piece),
        )
        return F.when(F.contains(code, F.lit(LITERAL)), F.array_join(found, "")).otherwise(code)

    # The only element of an array is computed once, whatever reads it.
    bare = F.array(F.regexp_replace(text, rf"{HIDDEN}|[{PLACE}{PAIR}]", ""))
    return F.get(F.transform(bare, put_back), F.lit(0))


def _unmarked(text: Column) -> Column:
    return F.regexp_replace(text, f"{MARK}|{SOFT}", "")


def _marked(lines: Column, kind: str) -> Column:
    """The masked text with a mark of the line's number wherever a construct of a kind may start."""

    def of_line(row: Column, index: Column) -> Column:
        line = row["text"]
        mark = F.concat(F.lit("$1" + PLACE), row["lineno"].cast("string"), F.lit(PLACE_END))
        fits = contains_any(line, HINTS[kind])
        if kind == "assignment":
            # A name after an open list is a default of it.
            before = F.get(lines, F.when(index > 0, index - 1))["text"]
            fits &= ~F.coalesce(F.regexp_like(before, F.lit(rf"(?:,|\({PAIR}\d++{PAIR_END})[ \t{SOFT}]*+$")), F.lit(False))
        return F.when(fits, F.regexp_replace(line, F.lit(STARTS[kind]), mark)).otherwise(line)

    return F.array_join(F.transform(lines, of_line), "\n")


def _found(marked: Column, pattern: str) -> Column:
    """For every mark that ``pattern`` follows: the line number and the pattern's named groups.

    The groups of a match are put into its place with marks around them, so the text is read once for all groups.
    """
    whole = rf"{PLACE}(?<lineno>\d++){PLACE_END}(?={pattern})"
    names = {name: at for name, at in _groups(whole).items() if not re.fullmatch(r"p\d+", name)}
    put = FIND + FIELD.join(f"${at}" for at in names.values()) + FIND_END
    pieces = F.split(F.regexp_replace(marked, F.lit(whole), F.lit(put)), FIND, -1)
    # A length that no array has; the array's own would compute it a second time.
    rows = F.transform(F.slice(pieces, 2, 1 << 30), lambda piece: F.substring_index(piece, FIND_END, 1))
    return F.transform(
        rows,
        lambda row: F.struct(
            _field(row, 0).cast("int").alias("lineno"),
            *[_field(row, at).alias(name) for at, name in enumerate(names) if name != "lineno"],
        ),
    )


def _field(row: Column, at: int) -> Column:
    return F.substring_index(F.substring_index(row, FIELD, at + 1), FIELD, -1)


def _group(text: Column, pattern: str, name: str) -> Column:
    return F.regexp_extract(text, pattern, _groups(pattern)[name])


def _names(parameters: Column) -> Column:
    """Names in a parameter list; defaults, types and rest marks go, destructured ones drop out."""
    parts = F.regexp_extract_all(_unmarked(parameters), F.lit(f"({DECLARATOR})"), 1)
    return F.filter(F.transform(parts, lambda part: F.regexp_extract(part, PARAMETER, 1)), lambda name: name != "")


def _in_order(facts: Column) -> Column:
    """By line; facts of one line stay in their order."""
    return F.array_sort(facts, lambda a, b: a["lineno"] - b["lineno"])


def _functions(marked: dict[str, Column], declared: Column, tokens: Column) -> Column:
    def function(name: Column, lineno: Column, arguments: Column) -> Column:
        return F.struct(name.alias("name"), lineno.alias("lineno"), arguments.alias("args"), _no_names().alias("decorators"))

    plain = F.transform(
        _found(marked["function"], FUNCTION), lambda row: function(row["name"], row["lineno"], _names(row["inside"]))
    )

    def bound(row: Column) -> Column:
        bare = _group(row["raw"], ARROW, "bare")
        return function(row["name"], row["lineno"], F.when(bare != "", F.array(bare)).otherwise(_names(_group(row["raw"], ARROW, "inside"))))

    arrows = F.transform(F.filter(declared, lambda row: F.contains(row["raw"], F.lit("=>")) & F.regexp_like(row["raw"], F.lit(ARROW))), bound)
    return _in_order(F.concat(plain, arrows))


def _classes(marked: dict[str, Column], declared: Column, tokens: Column) -> Column:
    return F.transform(
        _found(marked["class"], CLASS),
        lambda row: F.struct(
            row["name"].alias("name"), row["lineno"].alias("lineno"),
            F.filter(F.array(row["base"]), lambda name: name != "").alias("bases"),
        ),
    )


def _calls(marked: dict[str, Column], declared: Column, tokens: Column) -> Column:
    """Calls with their arguments; a call on the result of another one is named by its own member."""
    rows = _found(marked["call"], CALL)
    word = lambda row: F.regexp_extract(row["name"], rf"^(?:new[ \t]++{FRESH})?(.*+)$", 1)
    # A name with brackets and a body behind it is a method, not a call.
    real = F.filter(
        rows,
        lambda row: ~word(row).isin(*NOT_CALLS)
        & ((row["body"] == "") | F.contains(row["name"], F.lit(".")) | F.startswith(row["name"], F.lit("new"))),
    )
    return _in_order(F.transform(
        real,
        lambda row: F.struct(
            _restored(F.concat(F.regexp_replace(row["name"], r"^\??\.", ""), row["types"], row["arguments"]), tokens).alias("call"),
            row["lineno"].alias("lineno"),
        ),
    ))


def _declared(marked: Column) -> Column:
    """``name, raw, lineno`` of every declarator of ``const`` and ``let``; ``raw`` is its masked value."""

    def of_statement(row: Column) -> Column:
        parts = F.regexp_extract_all(_unmarked(row["rest"]), F.lit(f"({DECLARATOR})"), 1)
        # One pass for both groups; what is no declarator gets no field.
        groups = _groups(DECLARED)
        put = FIELD.join((f"${groups['name']}", f"${groups['value']}", ""))
        split = F.filter(
            F.transform(parts, lambda part: F.regexp_replace(part, F.lit(DECLARED), F.lit(put))),
            lambda part: F.contains(part, F.lit(FIELD)),
        )
        made = F.transform(
            split,
            lambda part: F.struct(
                _field(part, 0).alias("name"), F.rtrim(_field(part, 1)).alias("raw"), row["lineno"].alias("lineno"),
            ),
        )
        return F.filter(made, lambda one: one["name"] != "")

    return F.flatten(F.transform(_found(marked, DECLARATION), of_statement))


def _assignments(marked: dict[str, Column], declared: Column, tokens: Column) -> Column:
    def assigned(target: Column, value: Column, lineno: Column) -> Column:
        return F.struct(
            F.array(_restored(target, tokens)).alias("targets"),
            F.btrim(_restored(value, tokens), F.lit(" \t\n")).alias("value"),
            lineno.alias("lineno"),
        )

    fresh = F.transform(declared, lambda row: assigned(row["name"], row["raw"], row["lineno"]))
    later = F.transform(
        _found(marked["assignment"], ASSIGNMENT), lambda row: assigned(row["target"], row["value"], row["lineno"])
    )
    return _in_order(F.concat(fresh, later))


def _values(lines: Column) -> Column:
    """Names that stand as the value of a property, with their lines."""

    def of_line(row: Column) -> Column:
        line = row["text"]
        names = F.when(
            F.contains(line, F.lit(":")), F.array_distinct(F.regexp_extract_all(line, F.lit(rf":\s*+({NAME})"), 1))
        ).otherwise(_no_names())
        return F.transform(names, lambda name: F.struct(name.alias("name"), row["lineno"].alias("lineno")))

    return F.flatten(F.transform(lines, of_line))


def _numbered(text: Column, first: Column) -> Column:
    for pattern, put in (AFTER_NEW, GOES_ON_AFTER, GOES_ON_BEFORE):
        text = F.regexp_replace(text, pattern, put)
    return F.transform(
        F.split(text, "\n", -1), lambda line, index: F.struct(line.alias("text"), (first + index).alias("lineno"))
    )


def _lines(scan: Column) -> Column:
    """``text, lineno`` of all masked lines; code out of templates and tags comes after the rest, as statements of its own."""
    stop = lambda piece: F.struct(F.lit(";").alias("text"), piece["lineno"].alias("lineno"))
    inner = F.transform(
        scan["extra"], lambda piece: F.concat(F.array(stop(piece)), _numbered(piece["text"], piece["lineno"]))
    )
    return F.concat(_numbered(scan["masked"], F.lit(1)), F.flatten(inner))


_BUILDERS = {"functions": _functions, "classes": _classes, "calls": _calls, "assignments": _assignments}


def js_facts(files: DataFrame) -> DataFrame:
    """One row of facts per file of ``files(scan_id, path, content, read_error)``."""
    tags = ~F.endswith(F.lower("path"), F.lit(V.TYPED_SUFFIX))
    read = scanned(
        files.select("scan_id", "path", "read_error", decoded(F.col("content")).alias("_text"), tags.alias("_tags"))
    ).withColumn("_masked", F.col("_scan.masked"))
    error = (
        F.when(F.col("read_error").isNotNull(), F.col("read_error"))
        .when(~F.col("_read"), F.lit("not valid UTF-8"))
        .when(F.col("_scan.broken") | F.regexp_like("_masked", F.lit(DANGLING)), F.lit(V.JS_SYNTAX_ERROR))
    )
    checked = read.withColumn("error", error)
    checked = checked.withColumn("_lines", F.when(F.col("error").isNull(), _lines(F.col("_scan"))))
    checked = checked.withColumns({f"_{kind}": _marked(F.col("_lines"), kind) for kind in STARTS})
    checked = checked.withColumn("_declared", _declared(F.col("_declaration")))
    marked = {kind: F.col(f"_{kind}") for kind in STARTS}

    def fact(kind: str) -> Column:
        tokens = F.col("_scan.literals")
        if kind == "imports":
            found = F.transform(
                F.regexp_extract_all("_masked", F.lit(IMPORT), 1), lambda text: _restored(text, tokens)
            )
        elif kind == "strings":
            found = F.col("_scan.strings")
        else:
            found = _BUILDERS[kind](marked, F.col("_declared"), tokens)
        return F.when(F.col("error").isNull(), found).cast(schemas.FACT_TYPES[kind]).alias(kind)

    return checked.select(
        "scan_id", "path", F.lit("js").alias("lang"), "error", *[fact(kind) for kind in schemas.FACT_TYPES],
        _values(F.col("_lines")).cast(schemas.VALUES).alias("values"),
    )
