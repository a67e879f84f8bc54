"""The pipe query language: parsed, checked for kinds, then folded into one lazy plan.

    let name = source | step | step
    source: file "p" | symbol "q" | all-files | all-symbols | $name
    step: .deps .reverse .deps_transitive[(n)] .reverse_transitive[(n)] .symbols[(public_only=b, kind="k")]
          .callers .callees (+ _transitive) unique count
          and the filters, orders, set operations and modifiers of algebra.py

A value is an ordered bag: rows carry ``ord``, the path of positions that gives their order. Kinds are checked before anything runs.
Steps are joins keyed by the rows they come from, so a pipeline over many rows is one plan, not a loop.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartograph.lang import algebra
from cartograph.lang.text import QueryError, segments, unquote
from cartograph.operators import metrics
from cartograph.operators.direct import find_symbol
from cartograph.plans.kernels import bfs, emit_edges
from cartograph.runtime import spool
from cartograph.schema import SYMBOL_KINDS
from cartograph.sources.dataset import Graph

STEPS = (".deps", ".reverse", ".deps_transitive", ".reverse_transitive", ".symbols", ".callers", ".callers_transitive", ".callees", ".callees_transitive", "unique", "count")
PUBLIC_KINDS = ("function", "struct", "enum", "trait", "class", "interface", "type_alias", "module", "constant", "static", "variable")
SOURCE_KINDS = {"file": "files", "all-files": "files", "symbol": "symbols", "all-symbols": "symbols"}
INPUTS = {"deps": ("files", "traversals"), "reverse": ("files", "traversals"), "symbols": ("files",), "callers": ("symbols", "traversals"), "callees": ("symbols", "traversals")}


@dataclass
class Step:
    name: str
    transitive: bool = False
    depth: int | None = None
    public_only: bool = False
    kind: str | None = None
    test: algebra.Test | None = None
    key: str | None = None
    other: Query | None = None
    keep: bool = False  # files carry the distance of their traversal


@dataclass
class Query:
    source: tuple[str, str | None]
    steps: list[Step]
    binding: str | None = None


@dataclass
class Value:
    """kind is files, symbols, traversals or number; query is set for what a name stands for."""

    kind: str
    df: DataFrame
    query: Query | None = None


def parse_source(s: str) -> tuple[str, str | None]:
    if s in ("all-files", "all-symbols"):
        return s, None
    if m := re.fullmatch(r"\$([A-Za-z0-9_]+)", s):
        return "binding", m.group(1)
    if m := re.fullmatch(r'(file|symbol)\s*(".*")', s, re.S):
        return m.group(1), unquote(m.group(2))
    raise QueryError(f'unsupported query source `{s}`; expected `file "..."`, `symbol "..."`, `all-files`, `all-symbols`, or `$name`')


def parse_operand(s: str) -> Query:
    """A source, or a pipeline in parentheses."""
    if not (s.startswith("(") and s.endswith(")")):
        return Query(parse_source(s), [])
    q = parse(s[1:-1])
    if q.binding:
        raise QueryError("let bindings cannot stand in parentheses")
    return q


def parse_step(s: str) -> Step:
    if s == ".transitive":
        return Step("transitive")
    if m := re.fullmatch(r"(filter|sort-by|union|intersect|minus|\.depth)\s+(.*)", s, re.S):
        word, rest = m.group(1), m.group(2)
        if word == "filter":
            return Step("filter", test=algebra.parse_filter(rest))
        if word == "sort-by":
            return Step("sort-by", key=algebra.parse_key(rest))
        if word == ".depth":
            if not rest.isdecimal():
                raise QueryError("query step `.depth` expects a non-negative integer")
            return Step("depth", depth=int(rest))
        return Step(word, other=parse_operand(rest))
    m = re.fullmatch(r"(\.?[a-z_]+)(?:\((.*)\))?", s, re.S)
    name = m.group(1) if m else s
    name = name.removeprefix(".") if name in (".unique", ".count") else name
    if name not in STEPS:
        raise QueryError(f"unsupported query step `{s}`; supported steps are {', '.join(STEPS + algebra.STEPS)}")
    args = m.group(2)
    base = name.lstrip(".").removesuffix("_transitive")
    step = Step(base, transitive=name.endswith("_transitive"))
    if args is None:
        return step
    if name in (".deps_transitive", ".reverse_transitive"):
        if not re.fullmatch(r"\s*\d*\s*", args):
            raise QueryError(f"query step `{name}` expects an optional non-negative integer depth")
        step.depth = int(args) if args.strip() else None
        return step
    if name != ".symbols":
        raise QueryError(f"query step `{name}` has malformed arguments")
    seen = set()
    for arg in filter(None, (x.strip() for x in args.split(","))):
        key, eq, value = (x.strip() for x in arg.partition("="))
        if not eq:
            raise QueryError("query step `.symbols` arguments must use `name=value` syntax")
        if key in seen:
            raise QueryError(f"query step `.symbols` received duplicate `{key}` arguments")
        seen.add(key)
        if key == "public_only":
            if value not in ("true", "false"):
                raise QueryError("query step `.symbols` expects `public_only` to be true or false")
            step.public_only = value == "true"
        elif key == "kind":
            step.kind = unquote(value)
            if step.kind not in SYMBOL_KINDS or step.kind not in PUBLIC_KINDS:
                raise QueryError(f"query step `.symbols` does not know the kind `{step.kind}`")
        else:
            raise QueryError(f"unsupported query step `.symbols` argument `{key}`; supported arguments are `public_only` and `kind`")
    return step


def parse(text: str) -> Query:
    text = text.strip()
    if not text:
        raise QueryError("query expression cannot be empty")
    name = None
    if text.startswith("let "):
        m = re.fullmatch(r"let\s+([A-Za-z0-9_]+)\s*=\s*(.*)", text, re.S)
        if not m:
            raise QueryError("let bindings must use `let <name> = <expr>`")
        name, text = m.group(1), m.group(2)
    first, *rest = segments(text)
    return Query(parse_source(first), [parse_step(s) for s in rest], name)


def check(kind: str, steps: list[Step]) -> str:
    """The kind of the result, or an error at the first step that doesn't fit."""
    return check_distance(kind, steps)[0]


def check_distance(kind: str, steps: list[Step]) -> tuple[str, bool]:
    """The kind of the result, and if its rows can have a distance."""
    far, waiting = kind == "traversals", None
    for s in steps:
        if s.name == "unique":
            continue
        if s.name in algebra.MODIFIERS:
            waiting = s.name
        elif s.name in ("filter", "sort-by"):
            algebra.check_field(s.test.field if s.test else s.key, s.name, kind, far)
        elif s.name in algebra.SETS:
            other, other_far = check_distance(SOURCE_KINDS[s.other.source[0]], s.other.steps)
            algebra.check_set(s.name, kind, other)
            far = far and (other_far or s.name != "union")
        elif s.name == "count":
            kind = "number"
        else:
            if kind not in INPUTS[s.name]:
                raise QueryError(f"query step `.{s.name}` cannot be applied to {kind}")
            kind, far = {"deps": "files", "reverse": "files", "symbols": "symbols"}.get(s.name, "traversals"), s.name != "symbols"
            waiting = waiting if s.name == "symbols" else None
    if waiting:
        raise QueryError(f"query step `.{waiting}` needs a traversal after it")
    return kind, far


class Session:
    """Holds bindings; a failed statement leaves them as they were. now is the time from which risk counts commits."""

    def __init__(self, graph: Graph, now: int | None = None) -> None:
        self.graph, self.names, self.now, self.scores = graph, {}, now, None

    def run(self, text: str) -> Value:
        q = parse(text)
        value = self.value(q)
        if q.binding:
            self.names[q.binding] = replace(value, query=self.resolved(q))
        return value

    def resolved(self, q: Query) -> Query:
        """The query with the queries of its names in their places."""
        steps = [replace(s, other=self.resolved(s.other)) if s.other else s for s in q.steps]
        if q.source[0] != "binding":
            return Query(q.source, steps)
        known = self.bound(q.source[1]).query
        return Query(known.source, known.steps + steps)

    def value(self, q: Query, distance: bool = False) -> Value:
        """distance: what follows reads the distance of the result's rows."""
        full = self.resolved(q)
        first = self.source(*q.source)
        check(SOURCE_KINDS[full.source[0]], full.steps)
        steps = q.steps
        if q.source[0] == "binding" and first.kind == "files" and "distance" not in first.df.columns and algebra.reads_distance(steps, distance):
            # The name's rows were computed without their distance: its steps run again, with the filters that follow.
            first, steps = self.source(*full.source), full.steps
        for s in algebra.rewrite(steps, distance):
            first = self.apply(first, s)
        return first

    def bound(self, name: str) -> Value:
        if name not in self.names:
            raise QueryError(f"unknown binding `${name}`")
        return self.names[name]

    def risk(self) -> DataFrame:
        """path, score, normalized_score of all files, computed once a session."""
        if self.scores is None:
            g = self.graph
            found = metrics.risk(g.file_edges, g.files, g.churn, int(time.time()) if self.now is None else self.now)
            self.scores = spool(found.select("path", "score", "normalized_score"))
        return self.scores

    def source(self, what: str, arg: str | None) -> Value:
        g, spark = self.graph, self.graph.files.sparkSession
        place = F.array(F.lit(0).cast("long"))
        if what == "binding":
            return self.bound(arg)
        if what == "file":
            if g.files.where(F.col("path") == arg).isEmpty() and g.file_edges.where((F.col("src") == arg) | (F.col("dst") == arg)).isEmpty():
                raise QueryError(f"file `{arg}` is not indexed")
            return Value("files", spark.createDataFrame([(arg,)], "path string").withColumn("ord", place))
        if what == "symbol":
            found = find_symbol(g.symbols, arg)
            if found is None:
                raise QueryError(f"symbol `{arg}` was not found")
            return Value("symbols", spark.createDataFrame([found], "path string, qualname string").withColumn("ord", place))
        key = ["path"] if what == "all-files" else ["qualname", "path"]
        df = (g.files if what == "all-files" else g.symbols).select(*sorted(key))
        # Ids of sorted partitions rise with the order; no task has to number all rows.
        return Value("files" if what == "all-files" else "symbols", df.orderBy(*key).withColumn("ord", F.array(F.monotonically_increasing_id())))

    @staticmethod
    def numbered(df: DataFrame, *by: str) -> DataFrame:
        """Appends each row's place among those of the same input row to ord."""
        place = F.row_number().over(Window.partitionBy("ord").orderBy(*by)).cast("long")
        return df.withColumn("ord", F.concat("ord", F.array(place)))

    def apply(self, value: Value, s: Step) -> Value:
        g, df = self.graph, value.df
        if s.name == "count":
            one = df.agg(F.count("*").alias("number")) if value.kind != "number" else df.agg(F.lit(1).cast("long").alias("number"))
            return Value("number", one)
        if s.name == "unique":
            if value.kind == "number":
                return value
            key = {"files": ["path"], "symbols": ["qualname"], "traversals": ["path", "qualname", "distance"]}[value.kind]
            return Value(value.kind, algebra.first_of(df, key))
        if s.name == "filter":
            return Value(value.kind, algebra.kept(df, s.test, g.symbols, self.risk))
        if s.name == "sort-by":
            return Value(value.kind, algebra.placed(df, s.key, self.risk))
        if s.name in algebra.SETS:
            return Value(value.kind, algebra.combined(s.name, value.kind, df, self.value(s.other, s.keep).df))
        if s.name in ("deps", "reverse"):
            e = g.file_edges.select("src", "dst") if s.name == "deps" else g.file_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
            if s.transitive:
                seeds = df.select(F.col("path").alias("seed"), F.col("path").alias("node")).distinct()
                far = bfs(e, seeds, s.depth).where("distance > 0").select("seed", F.col("node").alias("dst"), "distance")
                rows = df.join(far, F.col("path") == F.col("seed")).select("ord", F.col("dst").alias("path"), "distance")
            else:
                rows = df.join(e, F.col("path") == F.col("src")).select("ord", F.col("dst").alias("path"), F.lit(1).alias("distance"))
            found = self.numbered(rows, "distance", "path")
            return Value("files", found if s.keep else found.drop("distance"))
        if s.name == "symbols":
            x = g.symbols.where("exported") if s.public_only else g.symbols
            x = x.where(F.col("kind") == s.kind) if s.kind else x
            rows = df.join(x.select("path", "qualname", "name", "start_line"), "path")
            return Value("symbols", self.numbered(rows, "start_line", "name", "qualname").select("path", "qualname", "ord"))
        from cartograph.operators.direct import call_ends

        e = call_ends(g.symbol_edges, s.name == "callers")
        node = F.struct("path", "qualname")
        seeds = df.select(node.alias("seed"), node.alias("node")).distinct()
        hops = (100 if s.depth is None else s.depth) if s.transitive else 1
        found = emit_edges(e, seeds, hops).select("seed", "dst", "certainty", "call_line", "distance")
        rows = df.select("ord", node.alias("n")).join(found, F.col("n") == F.col("seed"))
        rows = rows.select("ord", F.col("dst.path").alias("path"), F.col("dst.qualname").alias("qualname"), "certainty", "call_line", "distance")
        return Value("traversals", self.numbered(rows, "distance", "qualname", "path", "call_line").drop("call_line"))
