"""The token pass over JavaScript and TypeScript files: masks, partners of brackets, literals.

One pass with a stack tells what a character means: whether a slash divides or begins a pattern
follows from the token before it (and for a closing bracket from what stands before its partner),
whether ``<`` compares, opens type arguments or a tag follows in the same way. Extraction itself
reads the masked text with Spark's functions.

In the masked text comments are blank and literals are marks with their number, both with their own
line ends. Behind each opening bracket and before its partner stands a mark with the number of the
pair, so a pattern finds the end of a span at any depth. Code inside templates and tags is masked by
itself and comes as extra pieces with the line it starts in.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from auditspark import fixed_values as V
from auditspark.operators.extract_py import pieces

# Private characters that frame the marks; a file's own ones become "?" where they stand in code.
LITERAL, LITERAL_END, PLACE, PLACE_END, PAIR, PAIR_END, SOFT, FRESH = (chr(0xE000 + n) for n in range(8))
OWN = str.maketrans({chr(0xE000 + n): "?" for n in range(8)})
# Deeper nesting than any program has: its spans would be longer than the file many times over.
MAX_DEPTH = 500
# Templates and tags inside one another.
MAX_PIECES = 100

RESULT = (
    "struct<masked: string, literals: array<string>, strings: array<struct<value: string, lineno: int>>, "
    "extra: array<struct<lineno: int, text: string>>, broken: boolean>"
)
CODE = re.compile(r"[^\"'`/()\[\]{}<>;]++|//[^\n]*+|/\*|[\"'`/()\[\]{}<>;]")
STRING = {quote: re.compile(rf"[^{quote}\\\n]*+(?:\\[\s\S][^{quote}\\\n]*+)*+{quote}") for quote in "\"'"}
PATTERN = re.compile(r"/(?:[^/\\\[\n]++|\\[^\n]|\[(?:[^\]\\\n]++|\\[^\n])*+\])++/[A-Za-z]*+")
ESCAPE = re.compile(r"\\(?:u\{[0-9A-Fa-f]++\}|u[0-9A-Fa-f]{4}|x[0-9A-Fa-f]{2}|\r\n|[\s\S])")
TEMPLATE = re.compile(r"[^`\\$]++|\\[\s\S]|\$\{|\$|`")
TAG = re.compile(r"<(?:[A-Za-z_$][\w$.:-]*+)?")
IN_TAG = re.compile(r"[^\"'{}<>/]++|\"[^\"]*+\"|'[^']*+'|/>|[/<>{}]")
IN_TEXT = re.compile(r"[^<{]++|<(?=/)|<|\{")
CLOSING_TAG = re.compile(r"</[^<>]*+>")
LAST_WORD = re.compile(r"[A-Za-z_$][\w$]*+\Z")
OPERAND_FOLLOWS = frozenset(
    "return typeof case in of do else void delete throw new await yield instanceof default extends".split()
)
CONDITIONS = frozenset(("if", "while", "for", "with"))
BLOCK_FOLLOWS = frozenset(("else", "do", "try", "finally"))
DECLARES_TYPES = re.compile(r"\b(?:function\s*+\*?|class|interface|type)\s++[\w$]++\s*+\Z")
NO_TYPE = re.compile(r"&&|\|\||[-+*/%!^~]|[^=<>!]=(?![>=])|==|^\s*+\d")
AFTER_TYPE = re.compile(r"\s*+(?:[(){}\[\],;=>|&.?:]|extends\b|implements\b|$)")
CLOSES = {")": "(", "]": "[", "}": "{"}


def _tail(text: str, end: int) -> tuple[str, str]:
    """The last character before ``end`` that is not white space, and the word it ends, if any."""
    while end and text[end - 1].isspace():
        end -= 1
    if not end:
        return "", ""
    last = text[end - 1]
    word = ""
    if last.isalnum() or last in "_$":
        begin = end
        while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_$"):
            begin -= 1
        word = "" if begin and text[begin - 1] == "." else text[begin:end]
    return last, word


class Scan:
    """The pass over one file. ``tags`` says whether ``<`` may begin a tag where an operand stands."""

    def __init__(self, text: str, tags: bool):
        self.text, self.tags = text, tags
        self.literals, self.strings, self.extra = [], [], []
        self.pairs, self.broken = 0, False
        # What the code so far ends with: "" nothing, "x" an operand, ")" and "}" with what stood before their partners.
        self.before = ("", "")
        self.out: list[str] = []
        self.at = 0
        self.depth = self.pieces = 0

    def line(self, place: int) -> int:
        return self.text.count("\n", 0, place) + 1

    def literal(self, begin: int, end: int) -> None:
        self.out.append(f"{LITERAL}{len(self.literals)}" + "\n" * self.text.count("\n", begin, end) + LITERAL_END)
        self.literals.append(self.text[begin:end])
        self.before = ("x", "")

    def fragments(self, begin: int, parts: list[str]) -> list[tuple[int, str]]:
        return [(begin, part) for part in parts if len(part) > V.LITERAL_MIN]

    def operand_expected(self) -> bool:
        last, word = self.before
        if word:
            return word in OPERAND_FOLLOWS
        return last in ("", "condition", "block") or (last not in ("x", ")", "]", "}") and last not in ("++", "--"))

    def note(self, chunk: str) -> None:
        """Remember how a piece of code without brackets ends."""
        chunk = chunk.rstrip()
        last, word = _tail(chunk, len(chunk))
        if not last:
            return
        if chunk[-2:] in ("++", "--", "=>"):
            last = chunk[-2:]
        self.before = ("x" if last.isalnum() or last in "_$" else last, word)

    def code(self, closer: str) -> bool:
        """Mask code up to the bracket ``closer`` of the piece, or to the end of the file; False if it is broken."""
        text, stack, angles = self.text, [], []
        while self.at < len(text):
            found = CODE.match(text, self.at)
            token, begin = found.group(), self.at
            self.at = found.end()
            first = token[0]
            if token.startswith("//"):
                self.out.append(" ")
            elif token == "/*":
                end = text.find("*/", self.at)
                if end < 0:
                    return False
                self.out.append(" " + "\n" * text.count("\n", begin, end))
                self.at = end + 2
            elif len(token) > 1 or first not in "\"'`/()[]{}<>;":
                self.out.append(token if token.isascii() else token.translate(OWN))
                self.note(token)
            elif first in "\"'":
                end = STRING[first].match(text, self.at)
                if not end:
                    return False
                self.strings += self.fragments(begin, ESCAPE.split(text[self.at:end.end() - 1]))
                self.at = end.end()
                self.literal(begin, self.at)
            elif first == "`":
                if not self.template(begin):
                    return False
            elif first == "/":
                pattern = PATTERN.match(text, begin) if self.operand_expected() else None
                if pattern:
                    self.at = pattern.end()
                    self.literal(begin, self.at)
                else:
                    self.out.append("/")
                    self.before = ("/", "")
            elif first == "<" and self.tags and self.operand_expected() and self.tag_begins(begin):
                if not self.element(begin):
                    return False
            elif first in "<>":
                self.angle(first, begin, stack, angles)
            elif first == ";":
                while angles and angles[-1][0] == len(stack):
                    angles.pop()
                self.out.append(";")
                self.before = (";", "")
            elif first in "([{":
                self.pairs += 1
                self.depth += 1
                if self.depth > MAX_DEPTH:
                    return False
                stack.append((first, self.pairs, self.opened(first)))
                self.out.append(f"{first}{PAIR}{self.pairs}{PAIR_END}")
                self.before = (first, "")
            else:
                while angles and angles[-1][0] >= len(stack) and stack:
                    angles.pop()
                if not stack:
                    self.at -= first != closer
                    return first == closer
                opening, number, before = stack.pop()
                if opening != CLOSES[first]:
                    return False
                self.depth -= 1
                self.out.append(f"{PAIR}{number}{PAIR_END}{first}")
                self.before = (before or first, "")
        return not stack and not closer

    def opened(self, bracket: str) -> str:
        """What the partner of a bracket will stand for: the end of a condition, of a block, or nothing special."""
        last, word = self.before
        if bracket == "(":
            return "condition" if word in CONDITIONS else ""
        if bracket == "{":
            return "block" if last in ("", ";", "{", ")", "=>", "condition", "block") or word in BLOCK_FOLLOWS else ""
        return ""

    def angle(self, sign: str, begin: int, stack: list, angles: list) -> None:
        """Pair ``<`` and ``>`` that can be type parameters or arguments."""
        text = self.text
        if sign == "<":
            tight = begin > 0 and (text[begin - 1].isalnum() or text[begin - 1] in "_$")
            wide = self.operand_expected() or self.before[1] == "async" or bool(DECLARES_TYPES.search(text, max(0, begin - 200), begin))
            if tight or wide:
                angles.append((len(stack), begin, len(self.out), wide))
        elif not (begin and text[begin - 1] == "=") and angles and angles[-1][0] == len(stack):
            _, start, place, wide = angles.pop()
            inner = text[start + 1:begin]
            if (wide or not NO_TYPE.search(inner)) and not re.search(r"&&|\|\|", inner) and AFTER_TYPE.match(text, begin + 1):
                self.pairs += 1
                self.out[place] = f"<{PAIR}{self.pairs}{PAIR_END}"
                self.out.append(f"{PAIR}{self.pairs}{PAIR_END}>")
                self.before = ("x", "")
                return
        self.out.append(sign)
        self.before = (sign, "")

    def inner(self, begin: int) -> bool:
        """Mask the code of a piece that starts at ``begin`` and ends with a brace, apart from what surrounds it."""
        self.pieces += 1
        if self.pieces > MAX_PIECES:
            return False
        kept, self.out, self.before = self.out, [], ("", "")
        fine = self.code("}")
        self.extra.append((self.line(begin), "".join(self.out)))
        self.out = kept
        self.pieces -= 1
        return fine

    def template(self, begin: int) -> bool:
        text, parts, kept = self.text, [[]], len(self.strings)
        while True:
            found = TEMPLATE.match(text, self.at)
            if not found:
                return False
            token = found.group()
            self.at = found.end()
            if token == "`":
                break
            if token == "${":
                if not self.inner(self.at):
                    return False
                parts.append([])
            elif token[0] == "\\":
                self.at = ESCAPE.match(text, found.start()).end()
                parts.append([])
            else:
                parts[-1].append(token)
        # The template comes before the literals inside it.
        self.strings[kept:kept] = self.fragments(begin, ["".join(part) for part in parts])
        self.literal(begin, self.at)
        return True

    def tag_begins(self, begin: int) -> bool:
        found = TAG.match(self.text, begin)
        follows = self.text[found.end():found.end() + 1]
        if len(found.group()) == 1 and follows != ">":
            return False
        return (follows in (">", "/") or follows.isspace()) and (
            self.text.find("</", begin) >= 0 or self.text.find("/>", begin) >= 0
        )

    def element(self, begin: int) -> bool:
        """Pass over a tag with all that is inside it, as one literal."""
        text, open_tags, self.at = self.text, 0, begin
        while True:
            opening = TAG.match(text, self.at)
            self.at = opening.end()
            while True:
                found = IN_TAG.match(text, self.at)
                if not found:
                    return False
                token, place = found.group(), self.at
                self.at = found.end()
                if token[0] in "\"'":
                    self.strings += self.fragments(place, [token[1:-1]])
                elif token == "{":
                    if not self.inner(self.at):
                        return False
                elif token in (">", "/>"):
                    open_tags += token == ">"
                    break
                elif token in ("<", "}"):
                    return False
            while open_tags:
                found = IN_TEXT.match(text, self.at)
                if not found:
                    return False
                token = found.group()
                if token == "{":
                    self.at = found.end()
                    if not self.inner(self.at):
                        return False
                elif token == "<":
                    closing = CLOSING_TAG.match(text, self.at)
                    if not closing:
                        break
                    self.at = closing.end()
                    open_tags -= 1
                else:
                    self.at = found.end()
            if not open_tags:
                break
        self.literal(begin, self.at)
        return True

    def result(self) -> dict:
        self.broken = not self.code("")
        if self.broken:
            return {"masked": "", "literals": [], "strings": [], "extra": [], "broken": True}
        lines, done, line = [], 0, 1
        for begin, value in sorted(self.strings, key=lambda one: one[0]):
            line += self.text.count("\n", done, begin)
            done = begin
            lines.append({"value": value[:V.LITERAL_CUT], "lineno": line})
        extra = [{"lineno": line, "text": text} for line, text in sorted(self.extra, key=lambda one: one[0])]
        return {"masked": "".join(self.out), "literals": self.literals, "strings": lines, "extra": extra, "broken": False}


_FIELDS = pa.struct([
    ("masked", pa.string()), ("literals", pa.list_(pa.string())),
    ("strings", pa.list_(pa.struct([("value", pa.string()), ("lineno", pa.int32())]))),
    ("extra", pa.list_(pa.struct([("lineno", pa.int32()), ("text", pa.string())]))), ("broken", pa.bool_()),
])


_RESULT = pa.schema([
    ("scan_id", pa.string()), ("path", pa.string()), ("read_error", pa.string()), ("_read", pa.bool_()), ("_scan", _FIELDS),
])


def _scan_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch, "_text"):
            text, tags = piece.column("_text"), piece.column("_tags")
            rows = [
                None if one is None else Scan(one, bool(some)).result() for one, some in zip(text.to_pylist(), tags.to_pylist())
            ]
            kept = [piece.column(name) for name in ("scan_id", "path", "read_error")]
            yield pa.RecordBatch.from_arrays([*kept, text.is_valid(), pa.array(rows, _FIELDS)], schema=_RESULT)


def scanned(files: DataFrame) -> DataFrame:
    """``scan_id, path, read_error, _read, _scan`` of ``files(scan_id, path, read_error, _text, _tags)``.

    ``_scan`` is the pass over every text, null where the text is; ``_read`` says whether there is a text.
    No filter on what the pass finds can move below it, which would run it twice and before files are spread.
    """
    return files.mapInArrow(_scan_all, f"scan_id string, path string, read_error string, _read boolean, _scan {RESULT}")
