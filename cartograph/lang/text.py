"""Words of the pipe language: pipes, quotes and parentheses."""

from __future__ import annotations

import re


class QueryError(ValueError):
    """A query that can't be parsed, or whose steps don't fit together."""


def segments(text: str) -> list[str]:
    """The parts between pipes outside of quotes, and of the parentheses of a set operation."""
    out, part, quoted, depth, i = [], "", False, 0, 0
    while i < len(text):
        c = text[i]
        if quoted and c == "\\" and i + 1 < len(text):
            part += text[i : i + 2]
            i += 2
            continue
        quoted ^= c == '"'
        if not quoted and c == "(" and (depth or re.match(r"\s*(union|intersect|minus)\b", part)):
            depth += 1
        depth -= bool(depth and not quoted and c == ")")
        if c == "|" and not quoted and not depth:
            out.append(part.strip())
            part = ""
        else:
            part += c
        i += 1
    if quoted:
        raise QueryError("query expression contains an unterminated quoted string")
    if depth:
        raise QueryError("query expression contains an unclosed parenthesis")
    out.append(part.strip())
    if "" in out:
        raise QueryError("query expression contains an empty pipeline segment")
    return out


def unquote(s: str) -> str:
    m = re.fullmatch(r'"((?:[^"\\]|\\["\\])*)"', s)
    if not m:
        raise QueryError(f"malformed quoted value {s}")
    return re.sub(r"\\(.)", r"\1", m.group(1))
