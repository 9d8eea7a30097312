"""Tokens of the SQL dialect."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .. import errors

TOKEN = re.compile(
    r"""(?P<space>\s+|--[^\n]*|/\*.*?\*/)
  | (?P<number>\d+\.\d+|\d+)
  | (?P<text>'(?:[^'\\]|\\.)*')
  | (?P<name>[A-Za-z_][A-Za-z0-9_]*)
  | (?P<sign><=|>=|<>|!=|[=<>+\-*/%^(),;.:\[\]])""",
    re.X | re.S,
)
# fixed values: what may follow a backslash in a text
ESCAPES = {"\\": "\\", "'": "'", "n": "\n", "r": "\r", "t": "\t"}


@dataclass(frozen=True)
class Token:
    """kind: number, text, name, sign or end; names keep their case in `text`, `low` is in lower case."""

    kind: str
    text: str
    at: int

    @property
    def low(self) -> str:
        return self.text.lower()


def unescape(body: str) -> str:
    def one(m: re.Match) -> str:
        if m[1] not in ESCAPES:
            raise errors.InvalidEscapeError(f"\\{m[1]}")
        return ESCAPES[m[1]]

    return re.sub(r"\\(.)", one, body, flags=re.S)


def tokens(sql: str) -> list[Token]:
    out, at = [], 0
    while at < len(sql):
        m = TOKEN.match(sql, at)
        if not m:
            raise errors.ParserError(f"unexpected {sql[at : at + 20]!r} at {at}")
        if m.lastgroup == "number" and (len(m[0]) > 1 and m[0][0] == "0" and m[0][1] != "."):
            raise errors.ParserError(f"number with a leading zero at {at}: {m[0]}")
        if m.lastgroup == "text":
            out.append(Token("text", unescape(m[0][1:-1]), at))
        elif m.lastgroup != "space":
            out.append(Token(m.lastgroup, m[0], at))
        at = m.end()
    return [*out, Token("end", "", at)]
