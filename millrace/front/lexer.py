"""Tokens with spans.  One compiled pattern for each dialect; nothing is lost: gaps between tokens are white space."""

from __future__ import annotations

import re
from functools import lru_cache

from .dialects import Dialect, dialect


class Token:
    """kind: word, quoted, string, number, op, param, comment, end or error; value: of strings and quoted identifiers,
    decoded; word: upper case, of words only; sym: what grammar rules compare, the word or operator."""

    __slots__ = ("kind", "text", "start", "end", "value", "word", "sym")

    def __init__(self, kind: str, text: str, start: int, end: int, value: str = "") -> None:
        self.kind, self.text, self.start, self.end, self.value = kind, text, start, end, value
        self.word = text.upper() if kind == "word" else ""
        self.sym = self.word or (text if kind == "op" else "")

    def __repr__(self) -> str:
        return f"Token({self.kind}, {self.text!r}, {self.start}, {self.end})"


class SQLSyntaxError(ValueError):
    def __init__(self, message: str, sql: str, at: int) -> None:
        line = sql.count("\n", 0, at) + 1
        column = at - (sql.rfind("\n", 0, at) + 1) + 1
        super().__init__(f"{message} at line {line}, column {column}")
        self.message, self.line, self.column, self.at = message, line, column, at


#: Longest first.
OPERATORS = "<<->> ?:: :> <=> ->> #>> |> || && :: := => -> #> #- <> != ^= <= >= == << >> ** // @> <@ @@ ?| ?& !~* ~* !~ <-> .. ( ) [ ] { } , ; . + - * / % < > = & | ^ ~ ? : # @ ! $ \\".split()


@lru_cache
def pattern(d: Dialect) -> re.Pattern[str]:
    escaped = r"\\." if d.backslash else "(?!)"
    strings = "|".join(rf"(?:{p})?{q}(?:{escaped}|{q}{q}|[^{q}{'\\\\' if d.backslash else ''}])*{q}" for q in d.string_quotes for p in ["[nNbBxX]|[uU]&"])
    triple = r"[rRbB]{0,2}'''(?:[^\\]|\\.)*?'''|[rRbB]{0,2}\"\"\"(?:[^\\]|\\.)*?\"\"\"|[rR]'[^']*'|[rR]\"[^\"]*\"|" if d.name == "bigquery" else r"[rR]'[^']*'|" if d.name in ("spark", "databricks") else ""
    e_string = r"[eE]'(?:\\.|''|[^'\\])*'|" if d.name in ("postgresql", "duckdb", "redshift", "materialize", "risingwave", "cockroachdb", "generic") else ""
    quoted = "|".join({'"': r'"(?:""|[^"])*"', "`": r"`(?:``|[^`])*`", "[": r"\[(?:\]\]|[^\]])*\]"}[q] for q in d.ident_quotes)
    comment = r"--[^\n]*|/\*(?:[^*]|\*(?!/))*\*/" + (r"|\#[^\n]*" if d.hash_comment else "")
    ops = "|".join(map(re.escape, OPERATORS))
    return re.compile(
        rf"(?P<space>\s+)|(?P<comment>{comment})|(?P<string>{triple}{e_string}\$(?P<tag>\w*)\$(?:.*?)\$(?P=tag)\$|{strings})|(?P<quoted>{quoted})"
        rf"|(?P<number>0[xX][0-9a-fA-F]+|(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<word>[^\W\d][\w$]*)"
        rf"|(?P<param>\{{\{{.*?\}}\}}|%\(\w+\)s|@@?\w+|\$\w+|\?(?![:|&])|(?<![:\w\])])(?::[A-Za-z_]\w*))|(?P<op>{ops})|(?P<error>.)",
        re.S,
    )


_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}


def decode_string(text: str, d: Dialect) -> str:
    """The value of a string token."""
    if text[0] == "$":
        mark = text[: text.index("$", 1) + 1]
        return text[len(mark) : -len(mark)]
    raw, i = False, 0
    while text[i] not in "'\"":
        raw |= text[i] in "rR"
        i += 1
    escaped = d.backslash or text[0] in "eE" and i == 1
    quote = text[i]
    n = 3 if text[i : i + 3] == quote * 3 and len(text) - i >= 6 and d.name == "bigquery" else 1
    body = text[i + n : len(text) - n]
    if raw:
        return body
    if n == 1:
        body = body.replace(quote * 2, quote) if not escaped else re.sub(rf"{quote}{quote}", quote, body)
    if escaped:
        body = re.sub(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|.)", lambda m: _ESCAPES.get(m[1], chr(int(m[1][1:], 16)) if len(m[1]) > 1 else m[1]), body, flags=re.S)
    return body


def tokenize(sql: str, source: str | Dialect = "generic", comments: bool = False, strict: bool = True) -> list[Token]:
    """Tokens of a text, closed by an `end` token."""
    d, out = dialect(source), []
    for m in pattern(d).finditer(sql):
        kind, text = m.lastgroup, m[0]
        if kind == "tag":
            kind = "string"
        if kind == "space" or kind == "comment" and not comments:
            continue
        if kind == "error" and strict:
            raise SQLSyntaxError(f"unexpected character {text!r}", sql, m.start())
        value = ""
        if kind == "string":
            value = decode_string(text, d)
        elif kind == "quoted":
            close = {"[": "]"}.get(text[0], text[0])
            value = text[1:-1].replace(close * 2, close)
        out.append(Token(kind, text, m.start(), m.end(), value))
    out.append(Token("end", "", len(sql), len(sql)))
    return out
