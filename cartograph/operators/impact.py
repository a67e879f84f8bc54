"""Traversal analytics: transitive calls, change impact, explanations and shortest paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.operators.direct import call_ends, find_symbol
from cartograph.plans.kernels import bfs, bfs_tree, trails
from cartograph.runtime import spool
from cartograph.schema import rank

CALL_DEPTH = 100
CHANGES = ("body", "signature", "rename", "delete", "visibility", "side-effect")
COLUMNS = ["kind", "path", "qualname", "edge_kind", "certainty", "reason", "distance"]

# What each kind of change traverses (edge kinds, importers, callers, bound on hops); facts for the reader, which traversals don't consult.
RULES = [
    ("body", "Reverse call graph only", ["call"], False, True, False, 1),
    ("signature", "Reverse call graph plus importer/re-export expansion", ["call", "import", "export"], True, True, False, None),
    ("rename", "Traverse all reference-bearing edges", ["call", "import", "export"], True, True, False, None),
    ("delete", "Traverse all reverse dependencies and reference edges", ["call", "import", "export"], True, True, False, None),
    ("visibility", "Inspect external import/call edges across the narrowed boundary", ["call", "import", "export"], True, True, True, None),
    ("side-effect", "Reverse file-import graph only", ["import"], True, False, False, None),
]


def impact_rules(spark: SparkSession) -> DataFrame:
    """The rule table of change types."""
    return spark.createDataFrame(RULES, "change_type string, traversal_strategy string, allowed_edge_kinds array<string>, include_importers boolean, include_callers boolean, include_visibility_boundary boolean, default_max_distance int")


def label(x: str) -> Column:
    """A symbol as one string that sorts by qualname, then path."""
    return F.concat(F.col(f"{x}.qualname"), F.lit("\x01"), F.col(f"{x}.path"))


def emitted(edges: DataFrame, start: str, max_depth: int) -> DataFrame:
    """src, dst, distance, order and the edge's other columns: every edge out of a node nearer than max_depth.

    Edges to nodes seen before count too, so a start in a cycle is reached again. order is the visiting order of src among those as far.
    """
    if max_depth < 1:
        return edges.limit(0).withColumn("distance", F.lit(0)).withColumn("order", F.lit(0).cast("long"))
    near = edges.sparkSession.createDataFrame([(start, 0, 0)], "src string, hops int, order long")
    if max_depth > 1:
        far = bfs_tree(edges, start, max_depth - 1)
        near = near.unionByName(far.select(F.col("node").alias("src"), F.col("distance").alias("hops"), F.col("place").alias("order")))
    return edges.join(near, "src").withColumn("distance", F.col("hops") + 1).drop("hops")


def call_traversal(symbol_edges: DataFrame, path: str, qualname: str, reverse: bool = True, max_depth: int = CALL_DEPTH, name: str | None = None) -> DataFrame:
    """Every call edge met within max_depth hops, from the symbol to its callers (or callees); name: how reasons call it."""
    tie = F.array(F.coalesce("call_line", F.lit(0)), rank(F.col("certainty")))
    e = call_ends(symbol_edges, reverse).select(label("src").alias("src"), label("dst").alias("dst"), "certainty", tie.alias("tie"))
    found = emitted(e, f"{qualname}\x01{path}", max_depth)
    near, far = ("calls {} directly", "calls a symbol that reaches {}") if reverse else ("is called by {}", "is downstream of {} in the call graph")
    reason = F.when(F.col("distance") == 1, near.format(name or qualname)).otherwise(far.format(name or qualname))
    ends = F.split("dst", "\x01")
    return found.select(F.lit("symbol").alias("kind"), ends[1].alias("path"), ends[0].alias("qualname"), F.lit("call").alias("edge_kind"), "certainty", reason.alias("reason"), "distance", "order", "tie")


def importer_traversal(file_edges: DataFrame, path: str, max_depth: int, change: str = "signature", name: str | None = None) -> DataFrame:
    """Every import edge met within max_depth hops from the file to its importers."""
    e = file_edges.where("kind = 'import'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "certainty")
    found = emitted(e, path, max_depth)
    near = F.col("distance") == 1 if change != "side-effect" else F.lit(True)
    reason = F.when(near, f"imports {name or path}").otherwise(f"imports a file that reaches {name or path}")
    tie = F.array(F.lit(0), rank(F.col("certainty")))
    return found.select(F.lit("file").alias("kind"), F.col("dst").alias("path"), F.lit(None).cast("string").alias("qualname"), F.lit("import").alias("edge_kind"), "certainty", reason.alias("reason"), "distance", "order", tie.alias("tie"))


def once(rows: DataFrame) -> DataFrame:
    """One row per (kind, path, qualname, edge_kind, distance): the first visited stands for the rest."""
    key = ["kind", "path", "qualname", "edge_kind", "distance"]
    first = rows.groupBy(*key).agg(F.min_by(F.struct("certainty", "reason"), F.struct("order", "tie")).alias("x"))
    return first.select("kind", "path", "qualname", "edge_kind", "x.certainty", "x.reason", "distance")


def impact(symbols: DataFrame, symbol_edges: DataFrame, file_edges: DataFrame, target: str, change: str = "signature", depth: int | None = None) -> DataFrame:
    """What a change of a symbol (or a file, by path) reaches."""
    if change not in CHANGES:
        raise ValueError(f"unknown change type: {change}")
    depth = depth if depth is not None else (1 if change == "body" else 8)
    found = find_symbol(symbols, target)
    if found is None:
        return importer_traversal(file_edges, target, depth, change).select(*COLUMNS)
    parts = []
    if change != "side-effect":
        parts.append(call_traversal(symbol_edges, *found, reverse=True, max_depth=depth, name=target))
    if change != "body":
        parts.append(importer_traversal(file_edges, found[0], depth, change, target))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return once(rows).select(*COLUMNS)


def impact_summary(rows: DataFrame) -> DataFrame:
    """total, one count per certainty, and the risk label."""
    n = lambda c: F.count_if(F.col("certainty") == c)
    risk = F.when(F.count("*") == 0, "low").when(n("dynamic") > 0, "high").when(n("heuristic") > 0, "medium").otherwise("low")
    return rows.agg(F.count("*").alias("total"), *[n(c).alias(c) for c in ("exact", "resolved", "heuristic", "dynamic")], risk.alias("risk"))


def explain(symbols: DataFrame, symbol_edges: DataFrame, file_edges: DataFrame, target: str, to: str | None = None, depth: int = 8) -> DataFrame:
    """Callers, callees and importers of a symbol, or direct dependencies and importers of a file."""
    found = find_symbol(symbols, target)
    if found:
        back, forth = (call_traversal(symbol_edges, *found, x, depth, target) for x in (True, False))
        rows = back.unionByName(forth).unionByName(importer_traversal(file_edges, found[0], depth, name=target))
    else:
        own = file_edges.where(F.col("src") == target).select(F.lit("file").alias("kind"), F.col("dst").alias("path"), F.lit(None).cast("string").alias("qualname"), F.col("kind").alias("edge_kind"), "certainty", F.lit(f"depends on {target}").alias("reason"), F.lit(1).alias("distance"), F.lit(-1).cast("long").alias("order"), F.array(F.lit(0), rank(F.col("certainty"))).alias("tie"))
        rows = own.unionByName(importer_traversal(file_edges, target, depth))
    rows = once(rows)
    return (rows if to is None else rows.where((F.col("qualname") == to) | (F.col("path") == to))).select(*COLUMNS)


def why(symbols: DataFrame, symbol_edges: DataFrame, file_edges: DataFrame, start: str, end: str, depth: int = 8) -> DataFrame:
    """kind, path, qualname, edge_kind, certainty, reason, distance: the steps of one shortest path, ties by visiting order; no row if there is none or the ends are one.

    The start itself is left out. A step's certainty is that of its first call line, or of its import.
    """
    a, b = find_symbol(symbols, start), find_symbol(symbols, end)
    if (a is None) != (b is None):
        raise ValueError("both ends must be symbols, or both files")
    if a is None:
        e, source, goal = file_edges.where("kind = 'import'").select("src", "dst", "certainty", F.lit(0).alias("line")), start, end
    else:
        e = call_ends(symbol_edges, False).select(label("src").alias("src"), label("dst").alias("dst"), "certainty", F.coalesce("call_line", F.lit(0)).alias("line"))
        source, goal = "\x01".join(a[::-1]), "\x01".join(b[::-1])
    tree = bfs_tree(e.select("src", "dst"), source, depth, goal)
    ends = tree.sparkSession.createDataFrame([(goal,)], "target string").where(F.lit(source != goal)).join(tree.select(F.col("node").alias("target")), "target", "left_semi")
    steps = spool(trails(tree, ends).select(F.explode(F.arrays_zip(F.slice("trail", F.lit(1), F.size("trail") - 1).alias("src"), F.slice("trail", F.lit(2), F.size("trail")).alias("dst"), F.sequence(F.lit(1), F.size("trail") - 1).alias("distance"))).alias("s")).select("s.*"))
    sure = e.join(F.broadcast(steps.select("src", "dst")), ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.min_by("certainty", F.struct("line", rank(F.col("certainty")))).alias("certainty"))
    name = lambda c, part: F.when(F.instr(c, "\x01") > 0, F.substring_index(c, "\x01", part))
    by = F.coalesce(name("src", 1), "src")
    return steps.join(sure, ["src", "dst"]).select(
        F.lit("file" if a is None else "symbol").alias("kind"), F.substring_index("dst", "\x01", -1).alias("path"), name("dst", 1).alias("qualname"), F.lit("import" if a is None else "call").alias("edge_kind"),
        "certainty", F.concat(F.lit("imported by " if a is None else "called by "), by).alias("reason"), "distance",
    )


def changed_closure(file_edges: DataFrame, changed: DataFrame) -> DataFrame:
    """path (changed), affected: files that depend on each changed file, through imports and modules."""
    back = file_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = bfs(back, changed.select(F.col("path").alias("seed"), F.col("path").alias("node")))
    return found.where("distance > 0").select(F.col("seed").alias("path"), F.col("node").alias("affected"))


def diff(file_edges: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, dependents) of the changed files, and (path, changed_roots) of what they affect."""
    pairs = changed_closure(file_edges, changed)
    size = changed.select("path").distinct().join(pairs.groupBy("path").agg(F.count("*").alias("dependents")), "path", "left").na.fill(0)
    return size, pairs.groupBy(F.col("affected").alias("path")).agg(F.array_sort(F.collect_set("path")).alias("changed_roots"))
