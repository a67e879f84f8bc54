"""Path patterns as regular expressions that Catalyst evaluates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """A whole-string regex; ``*`` and ``?`` match any character, slashes included, and ``**/`` any folders or none."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + ".*", i + 1
        elif pattern[i] == "?":
            out, i = out + ".", i + 1
        elif pattern[i] == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end]
            body = "^" + body[1:] if body[0] == "!" else body
            out, i = out + "[" + body.replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def matches(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def matches_any(path: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | matches(path, p)
    return out


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two sets; two empty sets are alike."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)
