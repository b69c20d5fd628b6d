"""From the raw text of a model reply to its JSON value."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditspark import fixed_values as V
from auditspark.functions.text import strip


def drop_thinking(text: Column) -> Column:
    """What follows the last closing tag, when an opening tag occurs too."""
    tagged = F.contains(text, F.lit(V.THINK_OPEN)) & F.contains(text, F.lit(V.THINK_CLOSE))
    return F.when(tagged, strip(F.substring_index(text, V.THINK_CLOSE, -1))).otherwise(text)


def unfence(text: Column) -> Column:
    """First fenced part that opens an array or an object, without its language word."""
    parts = F.transform(F.split(text, V.FENCE), strip)
    bodies = F.transform(
        parts,
        lambda part: F.when(
            F.startswith(part, F.lit(V.FENCE_LANGUAGE)),
            strip(F.substr(part, F.lit(len(V.FENCE_LANGUAGE) + 1))),
        ).otherwise(part),
    )
    openers = F.filter(
        bodies, lambda body: F.startswith(body, F.lit("[")) | F.startswith(body, F.lit("{"))
    )
    fenced = F.contains(text, F.lit(V.FENCE))
    return F.when(fenced, F.coalesce(F.get(openers, F.lit(0)), text)).otherwise(text)


def bracket_slice(text: Column) -> Column:
    """From the first ``[`` to the last ``]``; empty when the last closes before the first opens."""
    first = F.instr(text, "[")
    last = F.length(text) - F.instr(F.reverse(text), "]") + 1
    both = F.contains(text, F.lit("[")) & F.contains(text, F.lit("]"))
    return F.when(both, F.substr(text, first, F.greatest(last - first + 1, F.lit(0)))).otherwise(text)


# The steps from a reply to the part that is read as JSON. Every step reads its input several times,
# so they are applied one column after the other; as one expression they would multiply.
STEPS = (strip, drop_thinking, unfence, bracket_slice, strip)


def _finite(text: Column) -> Column:
    """Bare ``NaN``, ``Infinity`` and ``-Infinity`` outside strings as a number that is not whole.

    Like them it is a number, and like them it fits no field of a finding.
    """
    pieces = F.regexp_extract_all(
        text, F.lit(r'("[^"\\]*+(?:\\(?s:.)[^"\\]*+)*+"|-?+(?:NaN|Infinity)\b|[^"NI-]++|(?s:.))'), 1
    )
    plain = F.transform(pieces, lambda piece: F.when(piece.isin("NaN", "Infinity", "-Infinity"), F.lit("0.5")).otherwise(piece))
    return F.when(F.regexp_like(text, F.lit("NaN|Infinity")), F.array_join(plain, "")).otherwise(text)


def strict_json(text: Column) -> Column:
    """``{"x": value}`` as VARIANT when ``text`` is exactly one JSON value, else NULL.

    The parser forgives text after a value. No trailing text survives both an object and an array
    around it, so asking for both makes the parse strict.
    """
    text = _finite(text)
    as_member = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}")))
    as_element = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(as_element.isNotNull(), as_member)


def items(value: Column, text: Column) -> Column:
    """Elements of an array, keys of an object, characters of a string; NULL for other values."""
    opener = F.substr(text, F.lit(1), F.lit(1))
    keys = F.map_keys(F.try_variant_get(value, "$.x", "map<string,variant>"))
    letters = F.filter(
        F.split(F.try_variant_get(value, "$.x", "string"), ""), lambda letter: letter != ""
    )
    return (
        F.when(opener == "[", F.try_variant_get(value, "$.x", "array<variant>"))
        .when(opener == "{", F.transform(keys, lambda key: key.cast("variant")))
        .when(opener == '"', F.transform(letters, lambda letter: letter.cast("variant")))
    )


def whole_number(value: Column) -> Column:
    """A JSON value as a whole number of up to 38 digits where it denotes one, else NULL.

    Whole numbers, floats without a fraction, booleans, and text such as ``" 42 "``, ``"+5"``,
    ``"1_000"`` or ``"42.0"`` all count.
    """
    kind = F.schema_of_variant(value)
    plain = F.try_variant_get(value, "$", "string")
    trimmed = F.btrim(plain, F.lit(V.NUMBER_BLANKS))
    digits = F.regexp_replace(F.substring_index(trimmed, ".", 1), "_", "")
    written = F.when(
        F.regexp_like(trimmed, F.lit(r"\A[+-]?[0-9]+(_[0-9]+)*(\.0+)?\z")), digits.try_cast("decimal(38,0)")
    )
    real = F.try_variant_get(value, "$", "double")
    floated = F.when(
        (real == F.floor(real)) & (F.abs(real) < F.lit(1e38)), real.try_cast("decimal(38,0)")
    )
    whole = F.try_variant_get(value, "$", "bigint").cast("decimal(38,0)")
    wide = F.try_variant_get(value, "$", "decimal(38,0)")
    return (
        F.when(kind.isin("BIGINT", "BOOLEAN"), whole)
        .when(F.regexp_like(kind, F.lit(r"^DECIMAL\(\d+,0\)$")), wide)
        .when(kind == "STRING", written)
        .when((kind == "DOUBLE") | F.startswith(kind, F.lit("DECIMAL")), floated)
    )


def beyond_numbers(value: Column) -> Column:
    """True for a whole number of more digits than :func:`whole_number` holds."""
    plain = F.btrim(F.try_variant_get(value, "$", "string"), F.lit(V.NUMBER_BLANKS))
    written = (F.schema_of_variant(value) == "STRING") & F.regexp_like(plain, F.lit(r"\A[+-]?[0-9]+(_[0-9]+)*(\.0+)?\z"))
    huge = (F.schema_of_variant(value) == "DOUBLE") & (F.abs(F.try_variant_get(value, "$", "double")) >= F.lit(1e38))
    return F.coalesce((written | huge) & whole_number(value).isNull(), F.lit(False))
