r"""JSON5 read token by token and written as strict JSON.

Strings keep every character: nothing is ever replaced inside one. A token says what
it is by its first character; a name is a string before a colon, else one of the
literals; comments, blanks and a comma before a closing bracket go. What comes out is
read by a strict parser, so wrong nesting or a missing comma is an error there. Plain
JSON numbers keep their digits; hexadecimal ones become decimal, signs and bare points
are completed, and infinite or missing numbers become strings.
"""

from __future__ import annotations

import json
import re

# What stands for a character behind a backslash, and blanks beside those of re.
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0"}
BLANK = r"[\s\ufeff]"

TOKEN = re.compile(
    rf"""(?P<skip>{BLANK}+|//[^\n\r\u2028\u2029]*|/\*.*?\*/)
    |(?P<string>"(?:[^"\\\n\r]|\\(?:\r\n|.))*"|'(?:[^'\\\n\r]|\\(?:\r\n|.))*')
    |(?P<number>[+-]?(?:0[xX][0-9a-fA-F]+|(?:0|[1-9][0-9]*)(?:\.[0-9]*)?(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|Infinity|NaN)(?![\w$.]))
    |(?P<name>(?:[^\W\d]|\$|\\u[0-9a-fA-F]{{4}})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{{4}})*)
    |(?P<sign>[{{}}\[\]:,])""",
    re.S | re.X,
)
ESCAPE = re.compile(r"\\(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|(\r\n|.))", re.S)
LITERALS = {"true": "true", "false": "false", "null": "null", "Infinity": '"Infinity"', "NaN": '"NaN"'}


class Damaged(ValueError):
    pass


def _character(m: re.Match) -> str:
    if code := m.group(1) or m.group(2):
        return chr(int(code, 16))
    c = m.group(3)
    if c in ("\r\n", "\n", "\r", "\u2028", "\u2029"):  # the line goes on
        return ""
    if c in "xu" or c in "123456789":
        raise Damaged("a wrong escape")
    return ESCAPES.get(c, c)


def _string(text: str) -> str:
    told = ESCAPE.sub(_character, text)
    # halves of a pair were written one by one; a half alone can't be kept in UTF-8
    return json.dumps(told.encode("utf-16", "surrogatepass").decode("utf-16", "replace"), ensure_ascii=False)


def _number(text: str) -> str:
    sign, digits = ("-" if text[0] == "-" else ""), text.lstrip("+-")
    if digits in ("Infinity", "NaN"):
        return f'"{sign if digits == "Infinity" else ""}{digits}"'
    if digits[:2] in ("0x", "0X"):
        return f"{sign}{int(digits, 16)}"
    whole, point, rest = digits.partition(".")
    if point:
        digits = f"{whole or 0}.{rest if rest[:1].isdigit() else '0' + rest}"
    return sign + digits


def strict(text: str) -> str:
    """JSON of the same value; Damaged where the text isn't JSON5."""
    out: list[str] = []
    name = None  # a name whose next token says what it is
    at = 0

    def named(key: bool) -> None:
        nonlocal name
        if name is not None:
            if not key and name not in LITERALS:
                raise Damaged("a bare name")
            out.append(_string(name) if key else LITERALS[name])
            name = None

    while at < len(text):
        m = TOKEN.match(text, at)
        if m is None:
            raise Damaged(f"no token at {at}")
        at, kind, token = m.end(), m.lastgroup, m.group()
        if kind == "skip":
            continue
        if kind == "number" and token in ("Infinity", "NaN"):
            kind = "name"
        named(token == ":")
        if kind == "sign":
            if token in "]}" and len(out) > 1 and out[-1] == "," and out[-2] not in ("{", "[", ","):
                out.pop()
            out.append(token)
        elif kind == "name":
            name = token
        else:
            out.append(_string(token[1:-1]) if kind == "string" else _number(token))
    named(False)
    return " ".join(out)


def object_in(reply: str | None) -> str | None:
    """The object from a reply's first { to its last }, closed by one } more if fewer close than open, as JSON; null if it can't be read."""
    if reply is None or (begin := reply.find("{")) < 0:
        return None
    scope = reply[begin : reply.rfind("}") + 1]
    if scope.count("}") < scope.count("{"):
        scope += "\n}"
    try:
        value = json.loads(strict(scope), parse_float=_Kept, parse_int=_Kept)
    except (ValueError, RecursionError):
        return None
    return _written(value) if isinstance(value, dict) else None


class _Kept(str):
    """A number by its digits."""


def _written(value) -> str:
    if isinstance(value, _Kept):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_written(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_written, value)) + "]"
    return json.dumps(value, ensure_ascii=False)
