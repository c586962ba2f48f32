"""Tokens of C source text.  Text is bytes read as Latin-1, so that an index is a byte offset."""

from __future__ import annotations

import re
from typing import NamedTuple


class Token(NamedTuple):
    kind: str  # id num str chr op, eol (end of a condition line), and directive kinds: define include call if ifdef elif else endif
    text: str
    start: int
    end: int
    extra: tuple = ()


_TOKEN = re.compile(
    r"""(?P<space>(?:[ \t\r\f\v]|\\\r?\n)+)
    |(?P<line>\n)
    |(?P<comment>//(?:\\(?:\r?\n|.)|[^\\\n])*|/\*[\s\S]*?\*/)
    |(?P<str>(?:L|u8|u|U)?"(?:\\[\s\S]|[^"\\\n])*")
    |(?P<chr>(?:L|u8|u|U)?'(?:\\[0-7]{1,3}|\\x[0-9a-fA-F]+|\\[\s\S]|[^'\\\n])+')
    |(?P<num>\.?[0-9](?:[eEpP][+-]|'[0-9a-fA-F]|[0-9A-Za-z_.])*)
    |(?P<id>[A-Za-z_][A-Za-z0-9_]*)
    |(?P<directive>\#[ \t]*[A-Za-z][A-Za-z0-9_]*)
    |(?P<op>\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|::|[-+*/%&|^!~<>=?:;,.(){}\[\]#])""",
    re.X,
)
_ARGUMENT = re.compile(r"(?:\\\r?\n|[^\n])*")
_PARAMETERS = re.compile(r"\(((?:\\\r?\n|[^()\n])*)\)")
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|\.\.\.")
_GAP = re.compile(r"(?:[ \t]|\\\r?\n)*")
CONDITIONS = {"if": "if", "elif": "elif", "ifdef": "ifdef", "ifndef": "ifdef", "else": "else", "endif": "endif"}


def lex(text: str) -> tuple[list[Token], list[tuple[int, int]]]:
    """Tokens and the spans of comments.  Characters that start no token are skipped."""
    out: list[Token] = []
    comments: list[tuple[int, int]] = []
    at, condition, n, match, token_of = 0, False, len(text), _TOKEN.match, tuple.__new__
    while at < n:
        m = match(text, at)
        if m is None:
            at += 1
            continue
        kind, end = m.lastgroup, m.end()
        if kind == "space":
            pass
        elif kind in ("id", "op", "num"):
            out.append(token_of(Token, (kind, m.group(), at, end, ())))
        elif kind == "comment":
            comments.append((at, end))
        elif kind == "line":
            if condition:
                out.append(Token("eol", "\n", at, end))
                condition = False
        elif kind == "directive":
            word = m.group()[1:].strip()
            if word in CONDITIONS:
                out.append(Token(CONDITIONS[word], word, at, end))
                condition = word in ("if", "elif")
            else:
                token = _directive(text, at, end, word)
                out.append(token)
                end = token.end
        else:
            out.append(Token(kind, m.group(), at, end))
        at = end
    return out, comments


def _directive(text: str, start: int, at: int, word: str) -> Token:
    """A whole line: extra holds (part, start, end) of what it names."""
    parts: list[tuple[str, int, int]] = []
    if word == "define":
        at = _GAP.match(text, at).end()
        if m := _NAME.match(text, at):
            parts.append(("name", *m.span()))
            at = m.end()
            if p := _PARAMETERS.match(text, at):
                parts.append(("parameters", *p.span()))
                parts += [("parameter", p.start(1) + x.start(), p.start(1) + x.end()) for x in _NAME.finditer(p[1]) if x[0] != "..."]
                at = p.end()
    elif word == "include":
        at = _GAP.match(text, at).end()
        end = _ARGUMENT.match(text, at).end()
        path = text[at:end].split("//")[0].split("/*")[0].rstrip()
        return Token("include", word, start, at + len(path), (("path", at, at + len(path)),))
    else:
        parts.append(("directive", start, at))
    begin = _GAP.match(text, at).end()
    end = _ARGUMENT.match(text, begin).end()
    if end > begin and text[begin:end].strip():
        trimmed = begin + len(text[begin:end].rstrip("\r"))
        parts.append(("value" if word == "define" else "argument", begin, trimmed))
        at = trimmed
    return Token("define" if word == "define" else "call", word, start, max(at, parts[-1][2] if parts else at), tuple(parts))
