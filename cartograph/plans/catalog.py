"""Registry of the engine's queries over the driver's tables, and the same questions in DuckDB SQL; catalog_sources and catalog_lang add to it.

Each query runs one operator on the code-graph view of the tables (sources/dataset.py). The SQL shares only the projection of
the tables; the operator itself is written anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.config import Capability, parse_config
from cartograph.operators import arch, compare, cycles, direct, entry, impact, metrics, report, similar
from cartograph.plans import kernels
from cartograph.sources.dataset import NOW, Graph, edge_keys, load, oracle_prefix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CONFIG = parse_config("""
[[layer]]
name = "urgent"
pattern = "src/urgent/**"
[[layer]]
name = "high"
pattern = "src/high/**"
[[layer]]
name = "low"
pattern = "src/low/**"
[[layer]]
name = "rest"
pattern = "src/**"
[[layer]]
name = "lib"
pattern = "lib/**"
[[rule]]
from = "low"
may_not_import = ["urgent", "high"]
[[rule]]
from = "urgent"
may_not_import = ["low"]
message = "urgent stays apart from low"
[[rule]]
from = "lib"
may_not_import = ["rest"]
[tests]
patterns = ["src/low/**"]
exclude_patterns = ["**/*.ts"]
""")
LAYER_CASE = "CASE WHEN {p} LIKE 'src/urgent/%' THEN 'urgent' WHEN {p} LIKE 'src/high/%' THEN 'high' WHEN {p} LIKE 'src/low/%' THEN 'low' WHEN {p} LIKE 'src/%' THEN 'rest' WHEN {p} LIKE 'lib/%' THEN 'lib' END"
TEST_SQL = "path LIKE 'src/low/%' AND path NOT LIKE '%.ts'"
CAPABILITY = Capability("net", pattern="lib/brand_2?/part_*0.rs", expected_callers=["src/urgent/**"])


def query(name: str, sql: str | None = None):
    """Registers a function of a Graph as a query, and its SQL after the shared WITH clause."""

    def add(f: Callable[[Graph], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(load(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = oracle_prefix() + sql
        return f

    return add


def hub(g: Graph, column: str = "src") -> str:
    """The file with most edges at one end, the least of equals."""
    row = g.file_edges.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).first()
    return row[0] if row else ""


def busy_symbol(g: Graph, column: str = "dst") -> tuple[str, str]:
    p = f"{column}_path"
    row = g.symbol_edges.groupBy(p, column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column, p).first()
    return (row[0], row[1]) if row else ("", "")


HUB = ", hub AS (SELECT {c} AS p FROM edges GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
BUSY = ", busy AS (SELECT {c}_path AS p, {c} AS q FROM calls GROUP BY {c}_path, {c} ORDER BY count(*) DESC, {c}, {c}_path LIMIT 1)"
SRC_HUB, DST_HUB, CALLEE, CALLER = HUB.format(c="src"), HUB.format(c="dst"), BUSY.format(c="dst"), BUSY.format(c="src")
IMPORTS_OF = "imports i ON i.path = e.src AND i.resolved_path = e.dst"
RANK = "CASE certainty WHEN 'exact' THEN 0 WHEN 'resolved' THEN 1 WHEN 'heuristic' THEN 2 ELSE 3 END"
NAME_OF_RANK = "CASE {r} WHEN 0 THEN 'exact' WHEN 1 THEN 'resolved' WHEN 2 THEN 'heuristic' ELSE 'dynamic' END"
ENTRY = ", imp AS (SELECT * FROM edges WHERE kind = 'import'), entries AS (SELECT path FROM files SEMI JOIN imp a ON a.src = path ANTI JOIN imp b ON b.dst = path)"
# Least distance from each seed, by levels up to a bound that no shortest path of the graphs exceeds.
CONE = ", cone(seed, node, d, r) AS (SELECT path, path, 0, 0 FROM {seeds} UNION SELECT c.seed, e.dst, c.d + 1, greatest(c.r, {rank}) FROM cone c JOIN {edges} e ON e.src = c.node WHERE c.d < {depth}), best AS (SELECT seed, node, min(d) AS d FROM cone GROUP BY 1, 2), label AS (SELECT c.seed, c.node, c.d, min(c.r) AS r FROM cone c JOIN best b ON b.seed = c.seed AND b.node = c.node AND b.d = c.d GROUP BY 1, 2, 3)"


@query("deps", SRC_HUB + f" SELECT e.dst AS path, e.kind AS edge_kind, e.certainty, i.raw_text AS import_text, i.start_line AS line FROM edges e LEFT JOIN {IMPORTS_OF} WHERE e.src = (SELECT p FROM hub)")
def _deps(g: Graph) -> DataFrame:
    return direct.deps(g.file_edges, g.imports, hub(g))


@query("deps_reverse", DST_HUB + f" SELECT e.src AS path, e.kind AS edge_kind, e.certainty, i.raw_text AS import_text, i.start_line AS line FROM edges e LEFT JOIN {IMPORTS_OF} WHERE e.dst = (SELECT p FROM hub)")
def _deps_reverse(g: Graph) -> DataFrame:
    return direct.deps(g.file_edges, g.imports, hub(g, "dst"), reverse=True)


def _walk(start: str, a: str, b: str, depth: int, edges: str = "edges", tag: str = "") -> str:
    """SQL: lv{tag} (node, d), least hops from a start up to a depth, and tr{tag} (node, d, trail), its first trail in breadth-first order."""
    w, lv, all_, tr = (f"{x}{tag}" for x in ("w", "lv", "alltr", "tr"))
    return (
        f", {w}(node, d) AS (SELECT p, 0 FROM {start} UNION SELECT e.{b}, {w}.d + 1 FROM {w} JOIN {edges} e ON e.{a} = {w}.node WHERE {w}.d < {depth}), {lv} AS (SELECT node, min(d) AS d FROM {w} GROUP BY 1)"
        f", {all_}(node, d, trail) AS (SELECT p, 0, [p] FROM {start} UNION ALL SELECT e.{b}, {all_}.d + 1, list_append({all_}.trail, e.{b}) FROM {all_} JOIN (SELECT DISTINCT {a}, {b} FROM {edges}) e ON e.{a} = {all_}.node"
        f" JOIN {lv} ON {lv}.node = e.{b} AND {lv}.d = {all_}.d + 1), {tr} AS (SELECT node, d, min(trail) AS trail FROM {all_} GROUP BY 1, 2)"
    )


TRAIL = " SELECT node AS path, trail[len(trail) - 1] AS parent, d AS distance, array_to_string(trail, ' > ') AS trail FROM tr WHERE d > 0"


@query("deps_transitive", SRC_HUB + _walk("hub", "src", "dst", 6) + TRAIL)
def _deps_transitive(g: Graph) -> DataFrame:
    return direct.with_trails(direct.deps_transitive(g.file_edges, hub(g), 6)).drop("place").withColumn("trail", F.array_join("trail", " > "))


@query("deps_reverse_transitive", DST_HUB + _walk("hub", "dst", "src", 5) + TRAIL)
def _deps_reverse_transitive(g: Graph) -> DataFrame:
    return direct.with_trails(direct.deps_transitive(g.file_edges, hub(g, "dst"), 5, reverse=True)).drop("place").withColumn("trail", F.array_join("trail", " > "))


@query("file_edges", " SELECT src, dst, kind, certainty FROM edges")
def _file_edges(g: Graph) -> DataFrame:
    return g.file_edges


@query("symbols", " SELECT path, name, qualname, kind, visibility, exported, start_line FROM symbols WHERE exported AND kind = 'function'")
def _symbols(g: Graph) -> DataFrame:
    return direct.symbols_of(g.symbols, None, True, "function")


@query("surface", " SELECT path, name, qualname, kind, visibility, start_line AS line FROM symbols WHERE exported")
def _surface(g: Graph) -> DataFrame:
    return direct.surface(g.symbols)


@query("callers", CALLEE + " SELECT src_path AS path, src AS qualname, certainty, call_line, 1 AS distance FROM calls JOIN busy ON dst_path = p AND dst = q")
def _callers(g: Graph) -> DataFrame:
    return direct.calls(g.symbol_edges, *busy_symbol(g), reverse=True).drop("reason")


@query("calls", CALLER + " SELECT dst_path AS path, dst AS qualname, certainty, call_line, 1 AS distance FROM calls JOIN busy ON src_path = p AND src = q")
def _calls(g: Graph) -> DataFrame:
    return direct.calls(g.symbol_edges, *busy_symbol(g, "src")).drop("reason")


# Symbols as one label each, so that trails of labels give the visiting order.
LABELS = ", lab AS (SELECT src || chr(1) || src_path AS src, dst || chr(1) || dst_path AS dst, certainty, call_line FROM calls), start AS (SELECT q || chr(1) || p AS p FROM busy)"
EMIT = " SELECT split_part(c.{b}, chr(1), 2) AS path, split_part(c.{b}, chr(1), 1) AS qualname, c.certainty, {tr}.d + 1 AS distance, {tr}.trail, c.call_line FROM {tr} JOIN lab c ON c.{a} = {tr}.node"
IMP = ", imps AS (SELECT src, dst, certainty FROM edges WHERE kind = 'import')"
EMIT_FILES = " SELECT c.src AS path, c.certainty, {tr}.d + 1 AS distance, {tr}.trail FROM {tr} JOIN imps c ON c.dst = {tr}.node"
FIRST = "first(certainty ORDER BY trail, {line}{rank}) AS certainty"


@query("callers_transitive", CALLEE + LABELS + _walk("start", "dst", "src", 7, "lab") + f" SELECT path, qualname, certainty, distance FROM ({EMIT.format(a='dst', b='src', tr='tr')})")
def _callers_transitive(g: Graph) -> DataFrame:
    return impact.call_traversal(g.symbol_edges, *busy_symbol(g), True, 8).select("path", "qualname", "certainty", "distance")


@query("calls_transitive", CALLER + LABELS + _walk("start", "src", "dst", 7, "lab") + f" SELECT path, qualname, certainty, distance FROM ({EMIT.format(a='src', b='dst', tr='tr')})")
def _calls_transitive(g: Graph) -> DataFrame:
    return impact.call_traversal(g.symbol_edges, *busy_symbol(g, "src"), False, 8).select("path", "qualname", "certainty", "distance")


def _once(emit: str, key: str, line: str) -> str:
    return f"SELECT {key}, distance, {FIRST.format(line=line, rank=RANK)} FROM ({emit}) GROUP BY {key}, distance"


@query("impact", CALLEE + LABELS + IMP + _walk("start", "dst", "src", 7, "lab", "c") + ", own AS (SELECT p FROM busy)" + _walk("own", "dst", "src", 7, "imps", "f")
       + ", cc AS (" + _once(EMIT.format(a="dst", b="src", tr="trc"), "path, qualname", "call_line, ") + "), ff AS (" + _once(EMIT_FILES.format(tr="trf"), "path", "") + ")"
       + " SELECT 'symbol' AS kind, path, qualname, certainty, distance, CASE distance WHEN 1 THEN 'calls ' || q || ' directly' ELSE 'calls a symbol that reaches ' || q END AS reason FROM cc, busy"
       + " UNION ALL SELECT 'file', path, NULL, certainty, distance, CASE distance WHEN 1 THEN 'imports ' || q ELSE 'imports a file that reaches ' || q END FROM ff, busy")
def _impact(g: Graph) -> DataFrame:
    return impact.impact(g.symbols, g.symbol_edges, g.file_edges, busy_symbol(g)[1]).select("kind", "path", "qualname", "certainty", "distance", "reason")


@query("impact_file", DST_HUB + IMP + _walk("hub", "dst", "src", 7, "imps") + f" SELECT path, certainty, distance, 'imports ' || p AS reason FROM ({EMIT_FILES.format(tr='tr')}), hub")
def _impact_file(g: Graph) -> DataFrame:
    return impact.impact(g.symbols, g.symbol_edges, g.file_edges, hub(g, "dst"), "side-effect").select("path", "certainty", "distance", "reason")


@query("impact_body", CALLEE + f" SELECT 'symbol' AS kind, src_path AS path, src AS qualname, first(certainty ORDER BY call_line, {RANK}) AS certainty, 1 AS distance FROM calls JOIN busy ON dst_path = p AND dst = q GROUP BY 2, 3")
def _impact_body(g: Graph) -> DataFrame:
    return impact.impact(g.symbols, g.symbol_edges, g.file_edges, busy_symbol(g)[1], "body").select("kind", "path", "qualname", "certainty", "distance")


@query("impact_summary", DST_HUB + IMP + _walk("hub", "dst", "src", 7, "imps") + f", inc AS ({EMIT_FILES.format(tr='tr')})" + ", n AS (SELECT count(*) AS total, count(*) FILTER (certainty = 'exact') AS exact, count(*) FILTER (certainty = 'resolved') AS resolved, count(*) FILTER (certainty = 'heuristic') AS heuristic, count(*) FILTER (certainty = 'dynamic') AS dynamic FROM inc) SELECT *, CASE WHEN total = 0 THEN 'low' WHEN dynamic > 0 THEN 'high' WHEN heuristic > 0 THEN 'medium' ELSE 'low' END AS risk FROM n")
def _impact_summary(g: Graph) -> DataFrame:
    return impact.impact_summary(impact.impact(g.symbols, g.symbol_edges, g.file_edges, hub(g, "dst")))


@query("explain", SRC_HUB + IMP + _walk("hub", "dst", "src", 7, "imps")
       + f", own AS (SELECT dst AS path, kind AS edge_kind, certainty, 1 AS distance, [''] AS trail FROM edges WHERE src = (SELECT p FROM hub)), every AS (SELECT * FROM own UNION ALL SELECT path, 'import', certainty, distance, trail FROM ({EMIT_FILES.format(tr='tr')}))"
       + f" SELECT path, edge_kind, distance, {FIRST.format(line='', rank=RANK)} FROM every GROUP BY path, edge_kind, distance")
def _explain(g: Graph) -> DataFrame:
    return impact.explain(g.symbols, g.symbol_edges, g.file_edges, hub(g)).select("path", "edge_kind", "certainty", "distance")


WHY = IMP + _walk("hub", "src", "dst", 8, "imps") + ", far AS (SELECT trail FROM tr ORDER BY d DESC, node LIMIT 1)"


STEPS = ", steps AS (SELECT trail[i] AS src, trail[i + 1] AS dst, CAST(i AS INT) AS distance FROM far, unnest(range(1, len(trail))) t(i))"


@query("why", SRC_HUB + WHY + STEPS + " SELECT 'file' AS kind, s.dst AS path, CAST(NULL AS VARCHAR) AS qualname, 'import' AS edge_kind, certainty, 'imported by ' || s.src AS reason, distance FROM steps s JOIN imps i ON i.src = s.src AND i.dst = s.dst")
def _why(g: Graph) -> DataFrame:
    start = hub(g)
    far = kernels.bfs_tree(g.file_edges.where("kind = 'import'"), start, 8).orderBy(F.desc("distance"), "node").first()
    return impact.why(g.symbols, g.symbol_edges, g.file_edges, start, far["node"] if far else start)


@query("why_symbols", CALLER + LABELS + _walk("start", "src", "dst", 8, "lab") + ", far AS (SELECT trail FROM tr ORDER BY d DESC, node LIMIT 1)" + STEPS
       + f", sure AS (SELECT src, dst, first(certainty ORDER BY call_line, {RANK}) AS certainty FROM lab GROUP BY src, dst)"
       + " SELECT 'symbol' AS kind, split_part(s.dst, chr(1), 2) AS path, split_part(s.dst, chr(1), 1) AS qualname, 'call' AS edge_kind, certainty, 'called by ' || split_part(s.src, chr(1), 1) AS reason, distance FROM steps s JOIN sure c ON c.src = s.src AND c.dst = s.dst")
def _why_symbols(g: Graph) -> DataFrame:
    start = busy_symbol(g, "src")
    e = direct.call_ends(g.symbol_edges, False).select(impact.label("src").alias("src"), impact.label("dst").alias("dst"))
    far = kernels.bfs_tree(e, "\x01".join(start[::-1]), 8).orderBy(F.desc("distance"), "node").first()
    return impact.why(g.symbols, g.symbol_edges, g.file_edges, start[1], far["node"].split("\x01")[0])


CHANGED = "path LIKE 'lib/brand_1%' AND path LIKE '%7.rs'"
BACK = ", changed AS (SELECT path FROM files WHERE " + CHANGED + "), r(c, n) AS (SELECT c.path, e.src FROM changed c JOIN edges e ON e.dst = c.path UNION SELECT r.c, e.src FROM r JOIN edges e ON e.dst = r.n)"


@query("reverse_closure", BACK + " SELECT DISTINCT n AS path FROM r WHERE n NOT IN (SELECT path FROM changed)")
def _reverse_closure(g: Graph) -> DataFrame:
    seeds = g.files.where(CHANGED).select(F.col("path").alias("node"))
    return kernels.reverse_closure(g.file_edges, seeds).select(F.col("node").alias("path"))


@query("diff_dependents", BACK + " SELECT path, count(DISTINCT n) FILTER (n <> path) AS dependents FROM changed LEFT JOIN r ON c = path GROUP BY path")
def _diff_dependents(g: Graph) -> DataFrame:
    return impact.diff(g.file_edges, g.files.where(CHANGED).select("path"))[0]


@query("diff", BACK + " SELECT n AS path, array_to_string(list_sort(list(c)), ',') AS changed_roots FROM r WHERE n <> c GROUP BY n")
def _diff(g: Graph) -> DataFrame:
    return impact.diff(g.file_edges, g.files.where(CHANGED).select("path"))[1].select("path", F.array_join("changed_roots", ",").alias("changed_roots"))


@query("doctor", " SELECT 'files' AS metric, count(*) AS value, CASE WHEN count(*) = 0 THEN 'fail' ELSE 'ok' END AS status FROM files UNION ALL SELECT 'imports', count(*), 'ok' FROM imports UNION ALL SELECT 'unresolved', count(*), CASE WHEN count(*) > 0 THEN 'warn' ELSE 'ok' END FROM imports WHERE resolved_path IS NULL AND import_path_kind <> 'external' UNION ALL SELECT 'symbols', count(*), 'ok' FROM symbols UNION ALL SELECT 'call_edges', count(*), 'ok' FROM calls UNION ALL SELECT 'parse_ok', count(*), 'ok' FROM files WHERE parse_status = 'ok' UNION ALL SELECT 'parse_partial', count(*), CASE WHEN count(*) > 0 THEN 'warn' ELSE 'ok' END FROM files WHERE parse_status = 'partial' UNION ALL SELECT 'parse_error', count(*), CASE WHEN count(*) > 0 THEN 'fail' ELSE 'ok' END FROM files WHERE parse_status = 'error'")
def _doctor(g: Graph) -> DataFrame:
    return direct.doctor(g.files, g.imports, g.symbols, g.symbol_edges)


@query("tree", SRC_HUB + ", pairs AS (SELECT DISTINCT src, dst FROM edges), t(trail, node, depth, cyc) AS (SELECT [p], p, 0, false FROM hub UNION ALL SELECT list_append(t.trail, e.dst), e.dst, t.depth + 1, list_contains(t.trail, e.dst) FROM t JOIN pairs e ON e.src = t.node WHERE NOT t.cyc AND t.depth < 4) SELECT array_to_string(trail, ' > ') AS node_id, node AS path, depth, depth = 4 AND NOT cyc AS truncated, cyc AS cycle FROM t")
def _tree(g: Graph) -> DataFrame:
    return direct.tree(g.file_edges, hub(g), 4).drop("parent_id")


LAYERED = ", lay AS (SELECT src AS from_file, dst AS to_file, " + LAYER_CASE.format(p="src") + " AS from_layer, " + LAYER_CASE.format(p="dst") + " AS to_layer FROM edges)"
VIOLATION = LAYERED + ", rule(f, t, m) AS (VALUES ('low', 'urgent', 'low may not import urgent'), ('low', 'high', 'low may not import high'), ('urgent', 'low', 'urgent stays apart from low'), ('lib', 'rest', 'lib may not import rest'))"


@query("arch_check", VIOLATION + " SELECT from_file, to_file, from_layer, to_layer, m AS message FROM lay JOIN rule ON f = from_layer AND t = to_layer")
def _arch_check(g: Graph) -> DataFrame:
    return arch.arch_check(g.file_edges, CONFIG)


@query("arch_layers", LAYERED + " SELECT from_layer, to_layer, count(*) AS edges FROM lay WHERE from_layer IS NOT NULL AND to_layer IS NOT NULL GROUP BY ALL")
def _arch_layers(g: Graph) -> DataFrame:
    return arch.layered(g.file_edges, CONFIG).groupBy("from_layer", "to_layer").agg(F.count("*").alias("edges"))


@query("entry_list", ENTRY + " SELECT path AS file, 'zero_in_degree' AS detection FROM entries")
def _entry_list(g: Graph) -> DataFrame:
    return entry.entry_list(g.files, g.file_edges)


@query("entry_cone", ENTRY + ", seeds AS (SELECT src AS path FROM imp WHERE src IN (SELECT path FROM entries) GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)" + CONE.format(seeds="seeds", edges="imp", rank=RANK, depth=40) + f" SELECT node AS file, d AS distance, {NAME_OF_RANK.format(r='r')} AS certainty FROM label")
def _entry_cone(g: Graph) -> DataFrame:
    e = entry.import_edges(g.file_edges).join(entry.entry_list(g.files, g.file_edges).select(F.col("file").alias("src")), "src", "left_semi")
    row = e.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "src").first()
    return entry.entry_cone(g.file_edges, row[0] if row else "")


@query("entry_reaches", ENTRY + ", hub AS (SELECT dst AS p FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1), seeds AS (SELECT p AS path FROM hub), back AS (SELECT dst AS src, src AS dst, certainty FROM imp)" + CONE.format(seeds="seeds", edges="back", rank=RANK, depth=40) + f" SELECT node AS file, d AS distance, {NAME_OF_RANK.format(r='r')} AS certainty FROM label WHERE node IN (SELECT path FROM entries)")
def _entry_reaches(g: Graph) -> DataFrame:
    return entry.entry_reaches(g.files, g.file_edges, hub(g, "dst"))


@query("entry_unreachable", ENTRY + f", s(n) AS (SELECT path FROM entries UNION SELECT e.dst FROM s JOIN imp e ON e.src = s.n), x AS (SELECT path, count(*) AS n FROM symbols WHERE exported GROUP BY path) SELECT f.path AS file, CASE WHEN mtime <= {NOW} THEN CAST(floor(({NOW} - mtime) / 86400.0) AS BIGINT) END AS last_modified_days_ago, coalesce(x.n, 0) AS exported_symbols, CASE WHEN language = 'rust' THEN 'exact' ELSE 'heuristic' END AS certainty FROM files f LEFT JOIN x ON x.path = f.path WHERE f.path NOT IN (SELECT n FROM s)")
def _entry_unreachable(g: Graph) -> DataFrame:
    return entry.unreachable(g.files, g.file_edges, g.symbols, NOW)


@query("audit", ENTRY + f""", seeds AS (SELECT path FROM files WHERE path LIKE 'lib/brand#_2_/part#_%0.rs' ESCAPE '#'),
 back(node, d) AS (SELECT path, 0 FROM seeds UNION SELECT e.src, back.d + 1 FROM back JOIN imp e ON e.dst = back.node WHERE back.d < 40), near AS (SELECT node, min(d) AS d FROM back GROUP BY node),
 step AS (SELECT e.src, min(e.dst) AS nxt FROM imp e JOIN near a ON a.node = e.src JOIN near b ON b.node = e.dst AND b.d = a.d - 1 GROUP BY e.src),
 way(entry, place, trail, r) AS (SELECT path, path, [path], 0 FROM entries JOIN near ON node = path UNION ALL SELECT way.entry, nxt, list_append(trail, nxt), greatest(r, (SELECT min({RANK}) FROM imp WHERE imp.src = way.place AND imp.dst = nxt)) FROM way JOIN step ON step.src = way.place)
 SELECT entry AS entry_point, CAST(len(trail) - 1 AS INT) AS distance, {NAME_OF_RANK.format(r="r")} AS certainty, entry LIKE 'src/urgent/%' AS expected, array_to_string(trail, ' > ') AS path FROM way JOIN near ON node = place AND near.d = 0""")
def _audit(g: Graph) -> DataFrame:
    return entry.audit(g.files, g.file_edges, g.symbols, CAPABILITY).withColumn("path", F.array_join("path", " > "))


COVER = f", tests AS (SELECT path FROM files WHERE {TEST_SQL})" + CONE.format(seeds="tests", edges="edges", rank="0", depth=40)


@query("test_map", COVER + " SELECT seed AS test, node AS path, d AS distance FROM best WHERE node NOT IN (SELECT path FROM tests)")
def _test_map(g: Graph) -> DataFrame:
    return entry.coverage(g.files, g.file_edges, CONFIG.test_patterns, CONFIG.test_excludes)


@query("test_uncovered", COVER + " SELECT path, mtime FROM files WHERE path NOT IN (SELECT node FROM best) AND path NOT IN (SELECT path FROM tests)")
def _test_uncovered(g: Graph) -> DataFrame:
    covered = entry.coverage(g.files, g.file_edges, CONFIG.test_patterns, CONFIG.test_excludes)
    return entry.uncovered(g.files, covered, CONFIG.test_patterns, CONFIG.test_excludes)


SCC = ", imp AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'import'), r(a, b) AS (SELECT src, dst FROM imp UNION SELECT r.a, e.dst FROM r JOIN imp e ON e.src = r.b), m AS (SELECT x.a AS node, min(y.b) AS comp FROM r x JOIN r y ON y.a = x.a JOIN r z ON z.a = y.b AND z.b = x.a WHERE x.a = x.b GROUP BY x.a)"


@query("cycles", SCC + ", c AS (SELECT comp, count(*) AS size FROM m GROUP BY comp), i AS (SELECT x.comp, count(*) AS n FROM imp JOIN m x ON x.node = src JOIN m y ON y.node = dst AND y.comp = x.comp GROUP BY 1), o AS (SELECT y.comp, count(DISTINCT src) AS n FROM imp JOIN m y ON y.node = dst LEFT JOIN m x ON x.node = src WHERE x.comp IS NULL OR x.comp <> y.comp GROUP BY 1) SELECT c.comp AS first_file, c.size, i.n AS edge_count, coalesce(o.n, 0) AS external_dependents, CASE WHEN size >= 4 OR coalesce(o.n, 0) >= 3 THEN 'high' WHEN size >= 3 OR coalesce(o.n, 0) >= 1 THEN 'medium' ELSE 'low' END AS severity FROM c JOIN i ON i.comp = c.comp LEFT JOIN o ON o.comp = c.comp")
def _cycles(g: Graph) -> DataFrame:
    return cycles.cycles(g.file_edges).drop("files")


FANS = ", imp AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'import'), fan AS (SELECT f.path, f.language, (SELECT count(*) FROM imp WHERE dst = f.path) AS fan_in, (SELECT count(*) FROM imp WHERE src = f.path) AS fan_out FROM files f)"


@query("stability", FANS + ", x AS (SELECT path, fan_in, fan_out, CASE WHEN fan_in + fan_out = 0 THEN 0.0 ELSE CAST(fan_out AS DOUBLE) / (fan_in + fan_out) END AS instability FROM fan) SELECT path, fan_in, fan_out, round(CAST(instability AS DOUBLE), 6) AS instability, CASE WHEN fan_in = 0 AND fan_out = 0 THEN 'isolated' WHEN instability > 0.5 AND fan_in > 10 THEN 'unstable_and_central' WHEN instability < 0.2 AND fan_in > 5 THEN 'stable_abstraction' WHEN fan_in = 0 AND instability >= 0.95 THEN 'healthy_leaf' WHEN instability BETWEEN 0.35 AND 0.65 THEN 'balanced' ELSE 'stable' END AS category, fan_in > 10 AND instability > 0.5 AS flagged FROM x")
def _stability(g: Graph) -> DataFrame:
    return metrics.stability(g.file_edges, g.files).withColumn("instability", F.round("instability", 6))


RISK = f", pairs AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'import'), r(a, b) AS (SELECT src, dst FROM pairs UNION SELECT r.a, e.dst FROM r JOIN pairs e ON e.src = r.b), t AS (SELECT b AS path, count(*) AS n FROM r GROUP BY b), i AS (SELECT dst AS path, count(*) AS n FROM pairs GROUP BY dst), c AS (SELECT path, count(DISTINCT commit_sha) AS n FROM churn WHERE committed_at >= {NOW} - 90 * 86400 GROUP BY path), x AS (SELECT f.path, coalesce(i.n, 0) AS direct_dependents, coalesce(t.n, 0) AS transitive_dependents, coalesce(c.n, 0) AS churn_commits FROM files f LEFT JOIN i ON i.path = f.path LEFT JOIN t ON t.path = f.path LEFT JOIN c ON c.path = f.path), y AS (SELECT *, CASE WHEN (SELECT max(churn_commits) FROM x) > 0 THEN log2(transitive_dependents + 1) * log2(churn_commits + 1) ELSE log2(direct_dependents + 1) END AS s FROM x)"


@query("risk", RISK + " SELECT path, direct_dependents, transitive_dependents, churn_commits, round(s, 6) AS score, CAST(CASE WHEN (SELECT max(s) FROM y) > 0 THEN round(100 * s / (SELECT max(s) FROM y)) ELSE 0 END AS BIGINT) AS normalized_score, CASE WHEN (SELECT max(churn_commits) FROM x) > 0 THEN direct_dependents || ' direct dependents, ' || transitive_dependents || ' transitive dependents, ' || churn_commits || ' churn commits in last 90 days' ELSE 'git churn unavailable; score falls back to dependency-only blast radius (' || direct_dependents || ' direct dependents, ' || transitive_dependents || ' transitive dependents)' END AS reason FROM y")
def _risk(g: Graph) -> DataFrame:
    return metrics.risk(g.file_edges, g.files, g.churn, NOW).withColumn("score", F.round("score", 6))


@query("risk_summary", RISK + " SELECT (SELECT max(churn_commits) FROM x) > 0 AS git_available, count(*) AS scored_files, round(avg(s), 6) AS avg_score, round(max(s), 6) AS max_score FROM y")
def _risk_summary(g: Graph) -> DataFrame:
    return metrics.risk_summary(metrics.risk(g.file_edges, g.files, g.churn, NOW)).withColumns({c: F.round(c, 6) for c in ("avg_score", "max_score")})


def most_changed(g: Graph) -> str:
    row = metrics.in_window(g.churn, 365, NOW).groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").first()
    return row[0] if row else ""


@query("cochange", f", c AS (SELECT DISTINCT path, commit_sha FROM churn WHERE committed_at >= {NOW} - 365 * 86400), t AS (SELECT path AS p FROM c GROUP BY path ORDER BY count(*) DESC, path LIMIT 1), own AS (SELECT commit_sha FROM c WHERE path = (SELECT p FROM t)), s AS (SELECT path, count(*) AS n FROM c WHERE commit_sha IN (SELECT commit_sha FROM own) AND path <> (SELECT p FROM t) GROUP BY path), a AS (SELECT path, count(*) AS n FROM c GROUP BY path) SELECT s.path, s.n AS shared_commits, (SELECT count(*) FROM own) AS target_commits, a.n AS candidate_commits, round(s.n / (SELECT count(*) FROM own)::DOUBLE, 6) AS score, CAST(round(100 * s.n / (SELECT max(n) FROM s)::DOUBLE) AS BIGINT) AS normalized_score FROM s JOIN a ON a.path = s.path")
def _cochange(g: Graph) -> DataFrame:
    return metrics.cochange(g.churn, most_changed(g), NOW, 365).withColumn("score", F.round("score", 6))


@query("cochange_pairs", f", c AS (SELECT DISTINCT path, commit_sha FROM churn WHERE committed_at >= {NOW} - 1500 * 86400), n AS (SELECT path, count(*) AS n FROM c GROUP BY path) SELECT a.path, b.path AS other, count(*) AS shared_commits, round(count(*) / least(min(x.n), min(y.n))::DOUBLE, 6) AS score FROM c a JOIN c b ON b.commit_sha = a.commit_sha AND a.path < b.path JOIN n x ON x.path = a.path JOIN n y ON y.path = b.path GROUP BY a.path, b.path HAVING count(*) >= 2")
def _cochange_pairs(g: Graph) -> DataFrame:
    return metrics.frequent_pairs(g.churn, NOW, 1500).withColumn("score", F.round("score", 6))


@query("unused", " SELECT path, name, qualname, kind, visibility, start_line AS line, CAST(0 AS BIGINT) AS inbound_references FROM symbols s WHERE exported AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.dst_path = s.path AND c.dst = s.qualname)")
def _unused(g: Graph) -> DataFrame:
    return metrics.unused(g.symbols, g.symbol_edges)


@query("mirror", FANS + SRC_HUB + ", si AS (SELECT path, list(DISTINCT coalesce(resolved_path, raw_text)) AS v FROM (SELECT path, CASE WHEN import_path_kind = 'external' THEN coalesce(resolved_path, 'std') ELSE resolved_path END AS resolved_path, raw_text FROM imports) GROUP BY path), sk AS (SELECT path, list(DISTINCT replace(kind, '_', '')) AS k, count(*) AS n FROM symbols WHERE exported GROUP BY path), sig AS (SELECT f.*, coalesce(v, []) AS v, coalesce(k, []) AS k, coalesce(n, 0) AS n FROM fan f LEFT JOIN si ON si.path = f.path LEFT JOIN sk ON sk.path = f.path), t AS (SELECT * FROM sig WHERE path = (SELECT p FROM hub)), s AS (SELECT c.path, 0.45 * CASE WHEN len(c.v) + len(t.v) = 0 THEN 1.0 ELSE len(list_intersect(c.v, t.v))::DOUBLE / len(list_distinct(list_concat(c.v, t.v))) END + 0.25 * CASE WHEN len(c.k) + len(t.k) = 0 THEN 1.0 ELSE len(list_intersect(c.k, t.k))::DOUBLE / len(list_distinct(list_concat(c.k, t.k))) END + 0.15 * (1 - least(abs(c.fan_in - t.fan_in) + abs(c.fan_out - t.fan_out), 10) / 10.0::DOUBLE) + 0.15 * (1 - least(abs(c.n - t.n), 6) / 6.0::DOUBLE) AS score FROM sig c, t WHERE c.path <> t.path AND c.language = t.language) SELECT path, round(score, 6) AS score FROM s")
def _mirror(g: Graph) -> DataFrame:
    i = g.imports.withColumn("external_pkg", F.when(F.col("import_path_kind") == "external", "std"))
    return similar.mirror(g.files, i, g.symbols, g.file_edges, hub(g)).select("path", F.round("score", 6).alias("score"))


@query("caller_profiles", ", busyfile AS (SELECT dst_path AS p FROM calls GROUP BY dst_path ORDER BY count(DISTINCT dst) DESC, dst_path LIMIT 1) SELECT s.qualname, s.kind, s.start_line AS line, coalesce((SELECT array_to_string(list_sort(list(DISTINCT src_path)), ',') FROM calls c WHERE c.dst_path = s.path AND c.dst = s.qualname), '') AS callers FROM symbols s WHERE s.path = (SELECT p FROM busyfile)")
def _caller_profiles(g: Graph) -> DataFrame:
    row = g.symbol_edges.groupBy("dst_path").agg(F.count_distinct("dst").alias("n")).orderBy(F.desc("n"), "dst_path").first()
    return similar.caller_profiles(g.symbols, g.symbol_edges, row[0] if row else "").select("qualname", "kind", "line", F.array_join("callers", ",").alias("callers"))


@query("caller_sets", """, own AS (SELECT path, qualname FROM (SELECT s.*, count(*) FILTER (exported) OVER (PARTITION BY path) AS e FROM symbols s) WHERE (exported OR e < 2) AND kind <> 'module'),
 sets AS (SELECT dst_path AS path, src_path, list_sort(list(DISTINCT dst)) AS used FROM calls SEMI JOIN own ON own.path = dst_path AND own.qualname = dst GROUP BY dst_path, src_path)
 SELECT path, array_to_string(used, ',') AS used, count(*) AS files, min(src_path) AS first, list_sort(list(src_path))[2] AS second FROM sets GROUP BY path, used""")
def _caller_sets(g: Graph) -> DataFrame:
    return similar.usage(similar.split_rows(g.symbols), g.symbol_edges).withColumn("used", F.array_join("used", ","))


@query("split")
def _split(g: Graph) -> DataFrame:
    return similar.split(g.symbols, g.symbol_edges)


# Two states to compare: the dense graph without some edges and symbols, and with all of them.
BEFORE = ", before AS (SELECT src, dst, kind, CASE WHEN (s + d) % 13 = 0 THEN 'dynamic' ELSE certainty END AS certainty FROM edges WHERE (s * 3 + d) % 7 <> 0), after AS (SELECT src, dst, kind, certainty FROM edges WHERE (s + d * 5) % 11 <> 0)"


def two_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    g = load(spark, sf_dir)
    e = g.file_edges.withColumn("s", edge_keys("src")).withColumn("d", edge_keys("dst"))
    before = e.where("(s * 3 + d) % 7 <> 0").withColumn("certainty", F.when((F.col("s") + F.col("d")) % 13 == 0, "dynamic").otherwise(F.col("certainty")))
    return before.drop("s", "d"), e.where("(s + d * 5) % 11 <> 0").drop("s", "d")


QUERIES["edge_diff"] = lambda spark, d: compare.edge_diff(*two_states(spark, d))
ORACLES["edge_diff"] = oracle_prefix() + BEFORE + " (SELECT *, 'added' AS change FROM (SELECT * FROM after EXCEPT SELECT * FROM before)) UNION ALL (SELECT *, 'removed' AS change FROM (SELECT * FROM before EXCEPT SELECT * FROM after))"
QUERIES["centrality_delta"] = lambda spark, d: compare.centrality_delta(*two_states(spark, d))
ORACLES["centrality_delta"] = oracle_prefix() + BEFORE + ", b AS (SELECT dst, count(*) AS n FROM before WHERE kind = 'import' GROUP BY dst), a AS (SELECT dst, count(*) AS n FROM after WHERE kind = 'import' GROUP BY dst) SELECT a.dst AS path, coalesce(b.n, 0) AS before_fan_in, a.n AS after_fan_in, a.n - coalesce(b.n, 0) AS delta FROM a LEFT JOIN b ON b.dst = a.dst WHERE a.n > coalesce(b.n, 0)"
QUERIES["violation_diff"] = lambda spark, d: compare.added(*[arch.arch_check(x, CONFIG) for x in two_states(spark, d)], ["from_file", "to_file", "message"])
ORACLES["violation_diff"] = oracle_prefix() + BEFORE + VIOLATION.replace("FROM edges)", "FROM before)") + ", lay2 AS (SELECT src AS from_file, dst AS to_file, " + LAYER_CASE.format(p="src") + " AS from_layer, " + LAYER_CASE.format(p="dst") + " AS to_layer FROM after) SELECT from_file, to_file, m AS message FROM lay2 JOIN rule ON f = from_layer AND t = to_layer EXCEPT SELECT from_file, to_file, m FROM lay JOIN rule ON f = from_layer AND t = to_layer"


@query("surface_diff", ", b AS (SELECT kind || ':' || name AS identity, max((path, qualname, visibility, start_line)) AS x FROM symbols WHERE exported AND start_line % 7 <> 0 GROUP BY 1), a AS (SELECT kind || ':' || name AS identity, max((path, qualname, visibility, CASE WHEN start_line % 5 = 0 THEN start_line + 1 ELSE start_line END)) AS x FROM symbols WHERE exported AND start_line % 9 <> 0 GROUP BY 1) SELECT coalesce(a.identity, b.identity) AS identity, CASE WHEN b.identity IS NULL THEN 'added' WHEN a.identity IS NULL THEN 'removed' ELSE 'modified' END AS change FROM b FULL JOIN a ON a.identity = b.identity WHERE b.identity IS NULL OR a.identity IS NULL OR a.x <> b.x")
def _surface_diff(g: Graph) -> DataFrame:
    after = g.symbols.where("start_line % 9 <> 0").withColumn("start_line", F.when(F.col("start_line") % 5 == 0, F.col("start_line") + 1).otherwise(F.col("start_line")))
    return compare.surface_diff(g.symbols.where("start_line % 7 <> 0"), after).select("identity", "change")


@query("report_hotspots", RISK + ", z AS (SELECT path, direct_dependents, transitive_dependents, churn_commits, s FROM y ORDER BY s DESC, transitive_dependents DESC, churn_commits DESC, path LIMIT 5) SELECT path, direct_dependents, transitive_dependents, churn_commits, round(s, 6) AS score FROM z")
def _hotspots(g: Graph) -> DataFrame:
    found = report.details(g, CONFIG, NOW)["risk_hotspots"]
    return found.select("path", "direct_dependents", "transitive_dependents", "churn_commits", F.round("score", 6).alias("score"))


@query("closure", ", r(a, b) AS (SELECT src, dst FROM edges UNION SELECT r.a, e.dst FROM r JOIN edges e ON e.src = r.b) SELECT a AS src, b AS dst FROM r")
def _closure(g: Graph) -> DataFrame:
    return kernels.closure(g.file_edges)


@query("report", VIOLATION + ENTRY.replace(", imp AS (SELECT *", ", imp0 AS (SELECT *").replace("FROM imp)", "FROM imp0)") + SCC + ", s(n) AS (SELECT path FROM entries UNION SELECT e.dst FROM s JOIN imp e ON e.src = s.n), k AS (SELECT (SELECT count(*) FROM files) AS total_files, (SELECT count(*) FROM symbols) AS total_symbols, (SELECT count(*) FROM imports) AS total_imports, (SELECT count(*) FROM imports WHERE resolved_path IS NULL) AS unresolved_imports, (SELECT count(*) FROM files WHERE parse_status = 'error') AS parse_errors, (SELECT count(*) FROM lay JOIN rule ON f = from_layer AND t = to_layer) AS layer_violations, (SELECT count(DISTINCT comp) FROM m) AS cycles, (SELECT count(*) FROM files WHERE path NOT IN (SELECT n FROM s)) AS unreachable_files, (SELECT count(*) FROM symbols s WHERE exported AND NOT EXISTS (SELECT 1 FROM calls c WHERE c.dst_path = s.path AND c.dst = s.qualname)) AS unused_exports) SELECT *, round(100.0 * unresolved_imports / total_imports, 6)::DOUBLE AS imports_unresolved_pct, greatest(0.0, least(100.0, 100 - 12 * parse_errors - 8 * layer_violations - 8 * cycles - 2 * unreachable_files - unused_exports - 0.5 * (100.0 * unresolved_imports / total_imports)))::DOUBLE AS health_score FROM k")
def _report(g: Graph) -> DataFrame:
    row = report.report(g, CONFIG, NOW)
    names = ["total_files", "total_symbols", "total_imports", "unresolved_imports", "parse_errors", "layer_violations", "cycles", "unreachable_files", "unused_exports"]
    return row.select(*names, F.round("imports_unresolved_pct", 6).alias("imports_unresolved_pct"), "health_score")
