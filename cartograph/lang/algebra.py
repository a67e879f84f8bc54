"""Filters, orders, set operations and modifiers of the pipe language, and the rewriting that moves them into searches.

    filter certainty | distance | kind | visibility | risk, then = != < <= > >= and a value; filter file matches "glob"
    sort-by risk | distance
    union | intersect | minus, then a source or a pipeline in parentheses
    .transitive, .depth n: change the next traversal

Filters are conditions or semi-joins, set operations are semi-joins, anti-joins and one grouping by identity: path for files, (path, qualname) else.
An order is one more number before those that give a row its place, so nothing is sorted. risk compares the normalized score, 0 to 100, and sorts by the score, highest first;
files without a score fail each comparison and come last. A higher certainty is a better one. visibility = public means exported.

A filter that bounds the distance bounds the search: levels beyond it are never computed. Files carry their distance only where a later step reads it.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartograph.functions.glob import matches
from cartograph.lang.text import QueryError, unquote
from cartograph.schema import CERTAINTY, SYMBOL_KINDS, rank

SETS = ("union", "intersect", "minus")
MODIFIERS = ("transitive", "depth")
TRAVERSALS = ("deps", "reverse", "callers", "callees")
STEPS = ("filter", "sort-by", *SETS, ".transitive", ".depth")
COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
FIELDS = {
    "certainty": ("traversals",), "distance": ("files", "traversals"), "kind": ("symbols", "traversals"), "visibility": ("symbols", "traversals"),
    "file": ("files", "symbols", "traversals"), "risk": ("files",),
}
LAST = 2**63 - 1


@dataclass
class Test:
    field: str
    op: str
    value: str | int | float


def parse_filter(s: str) -> Test:
    if m := re.fullmatch(r'file\s+matches\s+(".*")', s, re.S):
        return Test("file", "matches", unquote(m.group(1)))
    m = re.fullmatch(r"([a-z]+)\s*(<=|>=|!=|=|<|>)\s*(\S+)", s)
    if not m or m.group(1) not in FIELDS or m.group(1) == "file":
        raise QueryError(f"malformed filter `{s}`; expected a field, a comparison and a value, or `file matches \"...\"`")
    field, op, value = m.groups()
    if field in ("kind", "visibility") and op not in ("=", "!="):
        raise QueryError(f"filter `{field}` compares with = or != only")
    if field == "certainty" and value not in CERTAINTY or field == "kind" and value not in SYMBOL_KINDS:
        raise QueryError(f"filter `{field}` does not know `{value}`")
    if field == "distance":
        if not re.fullmatch(r"\d{1,9}", value):
            raise QueryError("filter `distance` expects a non-negative integer")
        return Test(field, op, int(value))
    if field == "risk":
        if not re.fullmatch(r"\d+(\.\d+)?", value):
            raise QueryError("filter `risk` expects a non-negative number")
        return Test(field, op, float(value))
    return Test(field, op, value)


def parse_key(s: str) -> str:
    if s not in ("risk", "distance"):
        raise QueryError(f"query step `sort-by` does not know `{s}`; expected `risk` or `distance`")
    return s


def check_field(field: str, step: str, kind: str, far: bool) -> None:
    if kind not in FIELDS[field]:
        raise QueryError(f"query step `{step} {field}` cannot be applied to {kind}")
    if field == "distance" and not far:
        raise QueryError(f"query step `{step} distance` needs a traversal before it")


def check_set(step: str, kind: str, other: str) -> None:
    """Symbols and traversals share an identity, so one can be cut by the other, but not united with it."""
    alike = kind == other or step != "union" and "files" not in (kind, other)
    if "number" in (kind, other) or not alike:
        raise QueryError(f"query step `{step}` cannot combine {kind} with {other}")


def about_distance(s) -> bool:
    return s.name == "filter" and s.test.field == "distance" or s.name == "sort-by" and s.key == "distance"


def reads_distance(steps: list, after: bool) -> bool:
    """If a step before the next traversal (or what comes after all steps) reads the distance of the rows that enter."""
    for s in steps:
        if about_distance(s):
            return True
        if s.name in (*TRAVERSALS, "symbols", "count"):
            return False
    return after


def least(a: int | None, b: int | None) -> int | None:
    return min((x for x in (a, b) if x is not None), default=None)


def rewrite(steps: list, distance: bool = False) -> list:
    """Steps with the same result: modifiers put into their traversals, distances kept where read, and distance filters made search depths.

    A filter passes filters, orders, intersect and minus on its way back to the traversal, as these choose or place rows one by one. It stops at unique
    and union, which choose among rows.
    """
    out, far, depth = [], False, None
    for s in steps:
        if s.name in MODIFIERS:
            far, depth = True, least(depth, s.depth)
            continue
        if far and s.name in TRAVERSALS:
            s = replace(s, transitive=True, depth=least(s.depth, depth))
            far, depth = False, None
        out.append(s)
    out = [replace(s, keep=reads_distance(out[i + 1 :], distance)) if s.name in ("deps", "reverse", "union") else s for i, s in enumerate(out)]
    for i in range(len(out)):
        s = out[i]
        if s.name != "filter" or s.test.field != "distance" or s.test.op not in ("<", "<=", "="):
            continue
        at = i - 1
        while at >= 0 and out[at].name in ("filter", "sort-by", "intersect", "minus"):
            at -= 1
        if at >= 0 and out[at].name in TRAVERSALS and out[at].transitive:
            out[at] = replace(out[at], depth=least(out[at].depth, s.test.value - (s.test.op == "<")))
    return out


def first_of(df: DataFrame, key: list[str]) -> DataFrame:
    """The first row by ord of each key."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min(F.struct("ord", *[c for c in rest if c != "ord"])).alias("x"))
    return best.select(*key, *[F.col(f"x.{c}").alias(c) for c in rest])


def condition(t: Test) -> Column:
    """The test on a row's own columns; for kind and visibility, on a symbol's; for risk, on a file's scores."""
    holds = COMPARE.get(t.op)
    if t.field == "file":
        return matches(F.col("path"), t.value)
    if t.field == "certainty":
        return holds(-rank(F.col("certainty")), F.lit(-CERTAINTY.index(t.value)))
    if t.field == "visibility":
        is_ = F.col("exported") if t.value == "public" else F.col("visibility") == t.value
        return holds(F.coalesce(is_, F.lit(False)), F.lit(True))
    return holds(F.col("normalized_score" if t.field == "risk" else t.field), F.lit(t.value))


def kept(df: DataFrame, t: Test, symbols: DataFrame, risk: Callable[[], DataFrame]) -> DataFrame:
    if t.field == "risk":
        return df.join(risk().where(condition(t)).select("path"), "path", "left_semi")
    if t.field in ("kind", "visibility"):
        return df.join(symbols.where(condition(t)).select("path", "qualname"), ["path", "qualname"], "left_semi")
    return df.where(condition(t))


def placed(df: DataFrame, key: str, risk: Callable[[], DataFrame]) -> DataFrame:
    """Rows in the order of the key, then in that which they had; scores are told apart to a millionth."""
    if key == "distance":
        return df.withColumn("ord", F.concat(F.array(F.col("distance").cast("long")), "ord"))
    scores = risk().select("path", (-F.round(F.col("score") * 1_000_000)).cast("long").alias("place"))
    found = df.join(scores, "path", "left")
    return found.withColumn("ord", F.concat(F.array(F.coalesce("place", F.lit(LAST))), "ord")).drop("place")


def combined(how: str, kind: str, left: DataFrame, right: DataFrame) -> DataFrame:
    """union: left rows, then right ones, the first of each identity; intersect and minus: left rows with or without their identity on the right."""
    key = ["path"] if kind == "files" else ["path", "qualname"]
    if how != "union":
        return left.join(right.select(*key), key, "left_semi" if how == "intersect" else "left_anti")
    columns = [c for c in left.columns if c in right.columns]
    sides = [df.select(*columns).withColumn("ord", F.concat(F.array(F.lit(i).cast("long")), "ord")) for i, df in enumerate((left, right))]
    return first_of(sides[0].unionByName(sides[1]), key)
