"""Tokens of the table query language."""

from __future__ import annotations

import re
from dataclasses import dataclass


class QueryError(ValueError):
    """A query that cannot be parsed or compiled."""


@dataclass(frozen=True)
class Token:
    kind: str  # name, int, float, complex, string, regex, op, end
    text: str
    value: object = None
    at: int = 0
    glued: bool = False  # no white space before it


# Operators, longest first.
OPERATORS = ("!~=", "**", "//", "<=", ">=", "==", "!=", "<>", "~=", "&&", "||", "::", "!~", "+", "-", "*", "/", "%", "=", "<", ">", "&", "|", "^", "~", "!", "(", ")", "[", "]", "{", "}", ",", ":", ".", ";")
_NUMBER = re.compile(r"0[xX][0-9a-fA-F]+|(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_REGEX = re.compile(r"([pmf])(?:/((?:[^/\\]|\\.)*)/|%((?:[^%\\]|\\.)*)%|@((?:[^@\\]|\\.)*)@)(i?)")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\"}


def _string(text: str, at: int) -> tuple[str, int]:
    quote, out, i = text[at], [], at + 1
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text):
            out.append(_ESCAPES.get(text[i + 1], text[i + 1]))
            i += 2
        elif c == quote:
            return "".join(out), i + 1
        else:
            out.append(c)
            i += 1
    raise QueryError(f"string at {at} has no end")


def tokens(text: str) -> list[Token]:
    """All tokens of a query. ``--`` begins a comment to the end of the line."""
    out: list[Token] = []
    at = 0
    while at < len(text):
        c = text[at]
        if c.isspace():
            at += 1
            continue
        if text.startswith("--", at):
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
            continue
        glued = bool(out) and at > 0 and not text[at - 1].isspace()
        if c in "'\"":
            value, end = _string(text, at)
            out.append(Token("string", text[at:end], value, at, glued))
        elif c == "`":
            end = text.find("`", at + 1)
            if end < 0:
                raise QueryError(f"quoted name at {at} has no end")
            out.append(Token("name", text[at + 1 : end], "quoted", at, glued))
            at = end + 1
            continue
        elif (m := _REGEX.match(text, at)) and out and out[-1].text in ("~", "!~"):
            body = next(x for x in m.groups()[1:4] if x is not None)
            out.append(Token("regex", m[0], (m[1], body, m[5] == "i"), at, glued))
            end = m.end()
        elif m := _NUMBER.match(text, at):
            end, word = m.end(), m[0]
            if text[end : end + 1] in ("i", "j") and not _NAME.match(text[end + 1 : end + 2] or " "):
                out.append(Token("complex", word, float(word), at, glued))
                end += 1
            elif word[:2] in ("0x", "0X"):
                out.append(Token("int", word, int(word, 16), at, glued))
            elif re.fullmatch(r"\d+", word):
                out.append(Token("int", word, int(word), at, glued))
            else:
                out.append(Token("float", word, float(word), at, glued))
        elif m := _NAME.match(text, at):
            end = m.end()
            out.append(Token("name", m[0], None, at, glued))
        else:
            op = next((o for o in OPERATORS if text.startswith(o, at)), None)
            if op is None:
                raise QueryError(f"unexpected {c!r} at {at}")
            end = at + len(op)
            out.append(Token("op", op, None, at, glued))
        at = end
    out.append(Token("end", "", None, len(text)))
    return out
