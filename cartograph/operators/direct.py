"""Direct graph queries: dependencies, symbols, calls, surface and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.plans.kernels import bfs_tree, trails


def deps(file_edges: DataFrame, imports: DataFrame, path: str, reverse: bool = False) -> DataFrame:
    """path, edge_kind, certainty, import_text, line: one row for each import line of an edge, or one without."""
    near, far = ("dst", "src") if reverse else ("src", "dst")
    e = file_edges.where(F.col(near) == path)
    i = imports.where(F.col("resolved_path").isNotNull()).select(F.col("path").alias("src"), F.col("resolved_path").alias("dst"), F.col("raw_text").alias("import_text"), F.col("start_line").alias("line"))
    i = i.where(F.col(near) == path)
    return e.join(i, ["src", "dst"], "left").select(F.col(far).alias("path"), F.col("kind").alias("edge_kind"), "certainty", "import_text", "line")


def deps_transitive(file_edges: DataFrame, path: str, depth: int | None = None, reverse: bool = False) -> DataFrame:
    """path, parent, distance, place: each reached file once; (distance, place) is the breadth-first order."""
    e = file_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else file_edges.select("src", "dst")
    return bfs_tree(e, path, depth).select(F.col("node").alias("path"), "parent", "distance", "place")


def with_trails(reached: DataFrame) -> DataFrame:
    """Adds trail, the files on the way from the start, to the rows of deps_transitive()."""
    ways = trails(reached.select(F.col("path").alias("node"), "parent"), reached.select(F.col("path").alias("target")))
    return reached.join(ways.withColumnRenamed("target", "path"), "path")


def symbols_of(symbols: DataFrame, path: str | None = None, public_only: bool = False, kind: str | None = None) -> DataFrame:
    out = symbols if path is None else symbols.where(F.col("path") == path)
    if public_only:
        out = out.where("exported")
    return out if kind is None else out.where(F.col("kind") == kind)


def find_symbol(symbols: DataFrame, query: str) -> tuple[str, str] | None:
    """(path, qualname) of the best match: by qualname first, then by name, the least of equals."""
    row = symbols.where((F.col("qualname") == query) | (F.col("name") == query)).orderBy(F.col("qualname") != query, "qualname", "path").select("path", "qualname").first()
    return tuple(row) if row else None


def find_symbols(symbols: DataFrame, queries: DataFrame) -> DataFrame:
    """query, path, qualname: find_symbol() for every row of ``queries``; queries without a match are left out."""
    asked = queries.select("query").distinct()
    keyed = symbols.select("path", "qualname", F.explode(F.array_distinct(F.array("qualname", "name"))).alias("query"))
    best = keyed.join(asked, "query").groupBy("query").agg(F.min(F.struct(F.col("qualname") != F.col("query"), "qualname", "path")).alias("x"))
    return best.select("query", "x.path", "x.qualname")


def call_ends(symbol_edges: DataFrame, reverse: bool) -> DataFrame:
    """src, dst node structs (path, qualname), certainty, call_line; from callee to caller if reversed."""
    a, b = F.struct(F.col("src_path").alias("path"), F.col("src").alias("qualname")), F.struct(F.col("dst_path").alias("path"), F.col("dst").alias("qualname"))
    return symbol_edges.select((b if reverse else a).alias("src"), (a if reverse else b).alias("dst"), "certainty", "call_line")


def calls(symbol_edges: DataFrame, path: str, qualname: str, reverse: bool = False) -> DataFrame:
    """path, qualname, certainty, call_line, reason, distance: one row for each call line."""
    e = call_ends(symbol_edges, reverse).where((F.col("src.path") == path) & (F.col("src.qualname") == qualname))
    reason = F.lit(f"called directly by {qualname}" if not reverse else f"calls {qualname}")
    return e.select(F.col("dst.path").alias("path"), F.col("dst.qualname").alias("qualname"), "certainty", "call_line", reason.alias("reason"), F.lit(1).alias("distance"))


def surface(symbols: DataFrame, target: str | None = None) -> DataFrame:
    """Exported symbols: path, name, qualname, kind, visibility, line; of all files, of a file, or of the file that has a symbol."""
    if target is not None and "/" not in target and (found := find_symbol(symbols, target)):
        target = found[0]
    return symbols_of(symbols, target, public_only=True).select("path", "name", "qualname", "kind", "visibility", F.col("start_line").alias("line"))


def doctor(files: DataFrame, imports: DataFrame, symbols: DataFrame, symbol_edges: DataFrame) -> DataFrame:
    """metric, value, status of the index's counts."""
    f = files.agg(F.count("*").alias("files"), F.count_if(F.col("parse_status") == "ok").alias("parse_ok"), F.count_if(F.col("parse_status") == "partial").alias("parse_partial"), F.count_if(F.col("parse_status") == "error").alias("parse_error"))
    i = imports.agg(F.count("*").alias("imports"), F.count_if(F.col("resolved_path").isNull() & (F.col("import_path_kind") != "external")).alias("unresolved"))
    row = f.crossJoin(i).crossJoin(symbols.agg(F.count("*").alias("symbols"))).crossJoin(symbol_edges.agg(F.count("*").alias("call_edges")))  # one row each
    names = ["files", "imports", "unresolved", "symbols", "call_edges", "parse_ok", "parse_partial", "parse_error"]
    out = row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias("value")) for n in names])).alias("m")).select("m.*")
    bad = (F.col("metric") == "files") & (F.col("value") == 0) | (F.col("metric") == "parse_error") & (F.col("value") > 0)
    warn = F.col("metric").isin("unresolved", "parse_partial") & (F.col("value") > 0)
    return out.withColumn("status", F.when(bad, "fail").when(warn, "warn").otherwise("ok"))


def tree(file_edges: DataFrame, path: str, depth: int | None = None, reverse: bool = False) -> DataFrame:
    """node_id, parent_id, path, depth, truncated, cycle: the expansion of a file's dependencies.

    A file that is already on the way from the root is a leaf with cycle set; at the depth bound a file is
    a leaf with truncated set.
    """
    from cartograph.runtime import spool

    e = file_edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if reverse else file_edges.select("src", "dst")
    e = spool(e.distinct())
    first = file_edges.sparkSession.createDataFrame([([path],)], "trail array<string>")
    level = first.select("trail", F.lit(0).alias("depth"), F.lit(depth == 0).alias("truncated"), F.lit(False).alias("cycle"))
    out, d = level, 0
    while depth is None or d < depth:
        d += 1
        open_ends = level.where(~F.col("cycle")).withColumn("at", F.element_at("trail", -1))
        level = spool(open_ends.join(e, F.col("at") == F.col("src")).select(F.concat("trail", F.array("dst")).alias("trail"), F.lit(d).alias("depth"), F.lit(depth == d).alias("truncated"), F.array_contains("trail", F.col("dst")).alias("cycle")))
        if level.isEmpty():
            break
        out = out.unionByName(level)
    name = lambda t: F.array_join(t, " > ")
    parent = F.when(F.size("trail") > 1, name(F.slice("trail", 1, F.size("trail") - 1)))
    return out.select(name(F.col("trail")).alias("node_id"), parent.alias("parent_id"), F.element_at("trail", -1).alias("path"), "depth", F.col("truncated") & ~F.col("cycle"), "cycle").toDF("node_id", "parent_id", "path", "depth", "truncated", "cycle")
