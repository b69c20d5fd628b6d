from pyspark.sql import functions as F

from auditspark.functions import reply, text


def _values(table, expression, inputs, kind="string"):
    rows = table([(i, value) for i, value in enumerate(inputs)], f"i int, x {kind}")
    made = rows.select("i", expression(F.col("x")).alias("y")).collect()
    return [row["y"] for row in sorted(made, key=lambda row: row["i"])]


def test_suffix_belongs_to_the_stem_when_dots_lead(table):
    names = ["a.py", "A.PY", ".f.py", "__init__.py", ".py", "..py", "x.tsx", "noext", "a.b.JS", "a.", "a.py\n"]
    assert _values(table, text.suffix, names) == [
        ".py", ".py", ".py", ".py", "", "", ".tsx", "", ".js", ".", ".py\n",
    ]


def test_strip_takes_every_unicode_blank(table):
    inputs = ["  x 　", "\x1c\x1fx ", "﻿x", "a b", "\n\t", ""]
    assert _values(table, text.strip, inputs) == [value.strip() for value in inputs]


def test_decoded_is_strict_and_unifies_line_ends(table):
    inputs = [b"a\r\nb\rc\n", b"\xff\xfe\x80", b"\xed\xa0\x80", "é".encode(), b""]
    assert _values(table, text.decoded, inputs, "binary") == ["a\nb\nc\n", None, None, "é", ""]


def test_location_leaves_out_absent_and_zero_lines(table):
    rows = table([("f", 7), ("f", 0), ("f", None)], "file string, line bigint")
    made = rows.select(text.location(F.col("file"), F.col("line"))).collect()
    assert [row[0] for row in made] == ["f:7", "f", "f"]


def test_version_triples(table):
    inputs = ["1.2.6", "1.2", "1.2.6+local", "", "abc", "1.2rc1", "1.2.3.4", "v2", None, "1.2+9"]
    made = _values(table, text.version_triple, inputs)
    assert [None if v is None else tuple(map(int, v)) for v in made] == [
        (1, 2, 6), (1, 2, 0), (1, 2, 6), (0, 0, 0), (0, 0, 0), (1, 2, 1), (1, 2, 3), (2, 0, 0), None, (1, 2, 0),
    ]


def test_is_below(table):
    inputs = ["1.0.0", "1.2.0", "2.0.0", "1.2", "1.2rc1", "", None, "9" * 50, "1.10.0"]
    made = _values(table, lambda v: text.is_below(v, F.lit("1.2.0")), inputs)
    assert made == [True, False, False, False, False, True, False, False, False]


def test_package_key(table):
    assert _values(table, text.package_key, ["LangChain_Core", "a.-_b"]) == ["langchain-core", "a-b"]


def test_whole_number(table):
    accepted = {
        '42': 42, '"42"': 42, '" 42 "': 42, '"42.0"': 42, '42.0': 42, 'true': 1, 'false': 0, '"+5"': 5, '"-7"': -7,
        '"1_000"': 1000, '"042"': 42, '"1_0.0"': 10, '"\\u00a042\\u3000"': 42, '1e2': 100, '-3': -3,
        '9223372036854775807': 9223372036854775807,
    }
    refused = [
        '42.5', '"42.5"', '""', '"0x10"', '"4e1"', '[1]', '{}', 'null', '"1__0"', '"_1"', '"1_"', '"42."', '".0"',
        '"\\u0661"', '"+-5"', '"- 5"', '"\\u001f5"', '"1.0_0"', '1e30',
    ]
    made = _values(
        table, lambda x: reply.whole_number(F.parse_json(x)), [*accepted, *refused]
    )
    assert made == [*accepted.values(), *[None] * len(refused)]


def test_strict_json_takes_exactly_one_value(table):
    good = ["[1]", '{"a":1}', '"x"', "3", "null", " [1] ", '{"a":1,"a":2}']
    bad = ["", "[1] x", "[1],[2]", "1,2", '1,"y":2', "[1", "{", "[1,]", "01", '"a\nb"', "1}", "]", "[1]]", "// c\n1", "'a'"]
    made = _values(table, lambda x: reply.strict_json(x).isNotNull(), good + bad)
    assert made == [True] * len(good) + [False] * len(bad)


def test_versions_of_any_length_keep_their_order(table):
    long = "7" * 60
    inputs = ["0." + long, "1.2", "1.2.00000", "1." + long[1:], "1." + long, "1.0" + long + "8", "10"]
    made = _values(table, text.version_key, inputs)
    assert made == sorted(made) and made[1] == made[2] and len(set(made)) == len(made) - 1
    assert _values(table, text.version_triple, ["00" + long + ".000"]) == [[long, "0", "0"]]
