"""Queries of the pipe language, configuration, gates, snapshots and simulated changes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.config import Gate
from cartograph.lang.dsl import Session
from cartograph.operators import arch, compare, context, direct, report
from cartograph.plans.catalog import BEFORE, CALLEE, CALLER, CONFIG, DST_HUB, LABELS, LAYER_CASE, NOW, ORACLES, QUERIES, RISK, SRC_HUB, VIOLATION, _walk, busy_symbol, hub, query, two_states
from cartograph.runtime import shared_dir
from cartograph.sources import snapshots
from cartograph.sources.dataset import Graph, load, oracle_prefix


def dsl(g: Graph, *texts: str) -> DataFrame:
    s, value = Session(g, NOW), None
    for text in texts:
        value = s.run(text)
    return value.df.drop("ord")


@query("dsl_deps", SRC_HUB + " SELECT dst AS path FROM edges WHERE src = (SELECT p FROM hub)")
def _deps(g: Graph) -> DataFrame:
    return dsl(g, f'file "{hub(g)}" | .deps')


@query("dsl_reverse", DST_HUB + " SELECT src AS path FROM edges WHERE dst = (SELECT p FROM hub)")
def _reverse(g: Graph) -> DataFrame:
    return dsl(g, f'file "{hub(g, "dst")}" | .reverse')


@query("dsl_deps_transitive", SRC_HUB + _walk("hub", "src", "dst", 3) + " SELECT node AS path FROM lv WHERE d > 0")
def _deps_transitive(g: Graph) -> DataFrame:
    return dsl(g, f'file "{hub(g)}" | .deps_transitive(3)')


@query("dsl_reverse_transitive", DST_HUB + _walk("hub", "dst", "src", 30) + " SELECT count(*) AS number FROM lv WHERE d > 0")
def _reverse_transitive(g: Graph) -> DataFrame:
    return dsl(g, f'file "{hub(g, "dst")}" | .reverse_transitive | count')


@query("dsl_all_files", " SELECT count(*) AS number FROM files")
def _all_files(g: Graph) -> DataFrame:
    return dsl(g, "all-files | count")


@query("dsl_all_symbols", " SELECT path, qualname FROM symbols")
def _all_symbols(g: Graph) -> DataFrame:
    return dsl(g, "all-symbols")


@query("dsl_all_deps", " SELECT dst AS path FROM edges")
def _all_deps(g: Graph) -> DataFrame:
    return dsl(g, "all-files | .deps")


@query("dsl_binding", SRC_HUB + " SELECT s.path, s.qualname FROM edges e JOIN symbols s ON s.path = e.dst WHERE e.src = (SELECT p FROM hub) AND exported")
def _binding(g: Graph) -> DataFrame:
    return dsl(g, f'let near = file "{hub(g)}" | .deps', "$near | .symbols(public_only=true)")


@query("dsl_symbols", SRC_HUB + " SELECT path, qualname FROM symbols WHERE path = (SELECT p FROM hub) AND kind = 'function'")
def _symbols(g: Graph) -> DataFrame:
    return dsl(g, f'file "{hub(g)}" | .symbols(kind="function")')


@query("dsl_callers", CALLEE + " SELECT src_path AS path, src AS qualname, certainty, 1 AS distance FROM calls JOIN busy ON dst_path = p AND dst = q")
def _callers(g: Graph) -> DataFrame:
    return dsl(g, f'symbol "{busy_symbol(g)[1]}" | .callers')


@query("dsl_callees", CALLER + " SELECT dst_path AS path, dst AS qualname, certainty, 1 AS distance FROM calls JOIN busy ON src_path = p AND src = q")
def _callees(g: Graph) -> DataFrame:
    return dsl(g, f'symbol "{busy_symbol(g, "src")[1]}" | .callees')


@query("dsl_callees_transitive", CALLER + ", lab AS (SELECT src || chr(1) || src_path AS src, dst || chr(1) || dst_path AS dst FROM calls), start AS (SELECT q || chr(1) || p AS p FROM busy)" + _walk("start", "src", "dst", 40, "lab")
       + " SELECT DISTINCT split_part(c.dst, chr(1), 2) AS path, split_part(c.dst, chr(1), 1) AS qualname, lv.d + 1 AS distance FROM lv JOIN lab c ON c.src = lv.node")
def _callees_transitive(g: Graph) -> DataFrame:
    return dsl(g, f'symbol "{busy_symbol(g, "src")[1]}" | .callees_transitive | unique').select("path", "qualname", "distance")


@query("dsl_unique", SRC_HUB + " SELECT DISTINCT b.src AS path FROM edges a JOIN edges b ON b.dst = a.dst WHERE a.src = (SELECT p FROM hub)")
def _unique(g: Graph) -> DataFrame:
    return dsl(g, f'file "{hub(g)}" | .deps | .reverse | unique')


@query("dsl_count", SRC_HUB + " SELECT count(*) AS number FROM edges a JOIN edges b ON b.dst = a.dst WHERE a.src = (SELECT p FROM hub)")
def _count(g: Graph) -> DataFrame:
    return dsl(g, f'file "{hub(g)}" | .deps | .reverse | count')


@query("dsl_minus", SRC_HUB + _walk("hub", "src", "dst", 3) + " SELECT node AS path FROM lv WHERE d > 0 AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.src = (SELECT p FROM hub) AND e.dst = node)")
def _minus(g: Graph) -> DataFrame:
    return dsl(g, f'let near = file "{hub(g)}" | .deps', f'file "{hub(g)}" | .deps_transitive(3) | minus $near')


@query("dsl_union", SRC_HUB + DST_HUB.replace("hub AS", "far AS") + _walk("hub", "src", "dst", 2) + " SELECT node AS path FROM lv WHERE d > 0 UNION SELECT src FROM edges WHERE dst = (SELECT p FROM far) AND src LIKE '%7.%'")
def _union(g: Graph) -> DataFrame:
    return dsl(g, f'file "{hub(g)}" | .deps_transitive(2) | union (file "{hub(g, "dst")}" | .reverse | filter file matches "*7.*")')


@query("dsl_intersect", SRC_HUB + RISK + _walk("hub", "src", "dst", 4) + " SELECT node AS path FROM lv JOIN y ON y.path = node WHERE d > 0 AND round(100 * s / (SELECT max(s) FROM y)) >= 40")
def _intersect(g: Graph) -> DataFrame:
    return dsl(g, f'file "{hub(g)}" | .deps_transitive(4) | intersect (all-files | filter risk >= 40) | sort-by risk')


@query("dsl_depth", SRC_HUB + _walk("hub", "src", "dst", 3) + " SELECT node AS path, d AS distance FROM lv WHERE d BETWEEN 2 AND 3")
def _depth(g: Graph) -> DataFrame:
    return dsl(g, f'let wide = file "{hub(g)}" | .depth 5 | .deps', "$wide | sort-by distance | filter distance < 4 | filter distance >= 2")


@query("dsl_filter", CALLEE + LABELS + _walk("start", "dst", "src", 2, "lab") + """ SELECT DISTINCT split_part(c.src, chr(1), 2) AS path, split_part(c.src, chr(1), 1) AS qualname, lv.d + 1 AS distance FROM lv JOIN lab c ON c.dst = lv.node
 JOIN symbols s ON s.path = split_part(c.src, chr(1), 2) AND s.qualname = split_part(c.src, chr(1), 1) WHERE c.certainty IN ('exact', 'resolved') AND s.kind = 'function'""")
def _filter(g: Graph) -> DataFrame:
    text = f'symbol "{busy_symbol(g)[1]}" | .callers_transitive | filter certainty >= resolved | filter kind = function | filter distance <= 3 | unique'
    return dsl(g, text).select("path", "qualname", "distance")


@query("dsl_visibility", " SELECT path, qualname FROM symbols WHERE path LIKE 'src/%' AND exported AND kind <> 'function'")
def _visibility(g: Graph) -> DataFrame:
    return dsl(g, 'all-files | filter file matches "src/**" | .symbols | filter visibility = public | filter kind != function')


@query("symbol_lookup", ", asked AS (SELECT name AS query FROM symbols UNION SELECT qualname FROM symbols WHERE start_line < 20), hit AS (SELECT query, path, qualname, row_number() OVER (PARTITION BY query ORDER BY qualname <> query, qualname, path) AS n FROM asked JOIN symbols ON qualname = query OR name = query) SELECT query, path, qualname FROM hit WHERE n = 1")
def _lookup(g: Graph) -> DataFrame:
    asked = g.symbols.select(F.col("name").alias("query")).unionByName(g.symbols.where("start_line < 20").select(F.col("qualname").alias("query")))
    return direct.find_symbols(g.symbols, asked)


@query("list_files", " SELECT path, language, parse_status, size_bytes, mtime FROM files")
def _list_files(g: Graph) -> DataFrame:
    return g.files.orderBy("path")


@query("list_symbols", " SELECT path, name, qualname, kind, visibility, exported, start_line FROM symbols")
def _list_symbols(g: Graph) -> DataFrame:
    return g.symbols.orderBy("qualname")


@query("surface_of_symbol", ", one AS (SELECT path FROM symbols WHERE kind = 'function' AND exported ORDER BY qualname, path LIMIT 1) SELECT path, name, qualname, kind, visibility, start_line AS line FROM symbols WHERE exported AND path = (SELECT path FROM one)")
def _surface_of(g: Graph) -> DataFrame:
    row = g.symbols.where("kind = 'function' and exported").orderBy("qualname", "path").first()
    return direct.surface(g.symbols, row["qualname"] if row else "")


@query("arch_explain", SRC_HUB + VIOLATION + ", v AS (SELECT DISTINCT to_file, m AS message FROM lay JOIN rule ON f = from_layer AND t = to_layer WHERE from_file = (SELECT p FROM hub)) SELECT DISTINCT p AS path, " + LAYER_CASE.format(p="p") + " AS layer, dst AS to_file, " + LAYER_CASE.format(p="dst") + " AS to_layer, message FROM edges JOIN hub ON src = p LEFT JOIN v ON v.to_file = dst")
def _arch_explain(g: Graph) -> DataFrame:
    return arch.arch_explain(g.file_edges, CONFIG, hub(g)).distinct()


# Measures of each top folder as an area of its own, with those of another time as baseline.
AREA = "split_part(path, '/', 2)"
BY_AREA = f", m AS (SELECT {AREA} AS area, CAST(count(*) FILTER (parse_status = 'partial') AS DOUBLE) AS parse_errors, CAST(count(*) AS DOUBLE) AS cycles, 100.0 - count(*) % 60 AS health_score FROM files GROUP BY 1), long AS (SELECT area, 'parse_errors' AS metric, parse_errors AS current, parse_errors + 1 AS baseline FROM m UNION ALL SELECT area, 'cycles', cycles, NULL FROM m UNION ALL SELECT area, 'health_score', CAST(health_score AS DOUBLE), CAST(80.0 AS DOUBLE) FROM m)"
GATES = [Gate("parse_errors", max=0.0), Gate("parse_errors", max_delta=-2.0, severity="warning"), Gate("cycles", max=90.0, max_delta=3.0), Gate("health_score", min=75.0), Gate("health_score_delta", min=-5.0), Gate("cycles", max=0.0, skip=True)]


@query("gate", BY_AREA + """ SELECT area, metric, CASE WHEN parse_errors_max THEN 'fail' ELSE 'pass' END AS status, delta, CASE WHEN parse_errors_max THEN 'max' ELSE '' END AS reasons FROM (SELECT area, metric, current > 0 AS parse_errors_max, current - baseline AS delta FROM long WHERE metric = 'parse_errors')
 UNION ALL SELECT area, metric, CASE WHEN current - baseline > -2 THEN 'warning' ELSE 'pass' END, current - baseline, CASE WHEN current - baseline > -2 THEN 'max_delta' ELSE '' END FROM long WHERE metric = 'parse_errors'
 UNION ALL SELECT area, metric, 'fail', NULL, CASE WHEN current > 90 THEN 'max,max_delta' ELSE 'max_delta' END FROM long WHERE metric = 'cycles'
 UNION ALL SELECT area, metric, CASE WHEN current < 75 THEN 'fail' ELSE 'pass' END, current - baseline, CASE WHEN current < 75 THEN 'min' ELSE '' END FROM long WHERE metric = 'health_score'
 UNION ALL SELECT area, 'health_score_delta', CASE WHEN current - baseline < -5 THEN 'fail' ELSE 'pass' END, current - baseline, CASE WHEN current - baseline < -5 THEN 'min' ELSE '' END FROM long WHERE metric = 'health_score'""")
def _gate(g: Graph) -> DataFrame:
    m = g.files.groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("area")).agg(F.count_if(F.col("parse_status") == "partial").cast("double").alias("parse_errors"), F.count("*").cast("double").alias("cycles"))
    m = m.withColumn("health_score", 100 - F.col("cycles") % 60)
    none = F.lit(None).cast("double")
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("current"), b.alias("baseline")) for n, b in (("parse_errors", F.col("parse_errors") + 1), ("cycles", none), ("health_score", F.lit(80.0)))])
    return report.gate_table(m.select("area", F.explode(rows).alias("x")).select("area", "x.*"), GATES, strict=True)


@query("health_score", f""", m AS (SELECT {AREA} AS area, count(*) FILTER (parse_status = 'partial') % 4 AS parse_errors, count(*) % 3 AS layer_violations, count(*) % 2 AS cycles, count(*) % 7 AS unreachable_files, count(*) % 11 AS unused_exports, count(*) % 5 * 10.0 AS pct, count(*) % 2 AS removed FROM files GROUP BY 1)
 SELECT area, CAST(greatest(0.0, least(100.0, 100 - 12 * parse_errors - 8 * layer_violations - 8 * cycles - 2 * unreachable_files - unused_exports - 0.5 * pct - 5 * removed)) AS DOUBLE) AS health_score FROM m""")
def _health(g: Graph) -> DataFrame:
    n = F.count("*")
    m = g.files.groupBy(F.split_part("path", F.lit("/"), F.lit(2)).alias("area")).agg(
        (F.count_if(F.col("parse_status") == "partial") % 4).alias("parse_errors"), (n % 3).alias("layer_violations"), (n % 2).alias("cycles"), (n % 7).alias("unreachable_files"), (n % 11).alias("unused_exports"),
        (n % 5 * 10.0).alias("imports_unresolved_pct"), (n % 2).alias("public_surface_removed"),
    )
    return m.select("area", report.health_score().alias("health_score"))


@query("context_candidates", CALLEE + """, own AS (SELECT p AS path, 200 AS score, 0 AS distance, 0 AS r FROM busy UNION ALL SELECT p, 180, 0, 0 FROM busy),
 c1 AS (SELECT src_path AS path, src AS q, certainty, 1 AS d FROM calls JOIN busy ON dst_path = p AND dst = q), c2 AS (SELECT c.src_path AS path, c.src AS q, c.certainty, 2 AS d FROM (SELECT DISTINCT path, q FROM c1) a JOIN calls c ON c.dst_path = a.path AND c.dst = a.q),
 i1 AS (SELECT src AS path, certainty, 1 AS d FROM edges JOIN busy ON dst = p WHERE kind = 'import'), i2 AS (SELECT e.src AS path, e.certainty, 2 AS d FROM (SELECT DISTINCT path FROM i1) a JOIN edges e ON e.dst = a.path AND e.kind = 'import'),
 far AS (SELECT path, certainty, d, 120 AS base FROM c1 UNION ALL SELECT path, certainty, d, 120 FROM c2 UNION ALL SELECT path, certainty, d, 120 FROM i1 UNION ALL SELECT path, certainty, d, 120 FROM i2 UNION ALL SELECT dst_path, certainty, 1, 100 FROM calls JOIN busy ON src_path = p AND src = q),
 scored AS (SELECT path, (base * CASE certainty WHEN 'exact' THEN 100 WHEN 'resolved' THEN 85 WHEN 'heuristic' THEN 50 ELSE 25 END // 100) // d AS score, d AS distance, CASE certainty WHEN 'exact' THEN 0 WHEN 'resolved' THEN 1 WHEN 'heuristic' THEN 2 ELSE 3 END AS r FROM far UNION ALL SELECT * FROM own)
 SELECT s.path, CAST(max(score) AS INT) AS score, min(distance) AS distance, CASE min(r) WHEN 0 THEN 'exact' WHEN 1 THEN 'resolved' WHEN 2 THEN 'heuristic' ELSE 'dynamic' END AS certainty, CAST(greatest(1, max(size_bytes) // 4) AS INT) AS estimated_tokens FROM scored s JOIN files f ON f.path = s.path GROUP BY s.path""")
def _context(g: Graph) -> DataFrame:
    return context.candidates(g, busy_symbol(g)[1]).select("path", "score", "distance", "certainty", "estimated_tokens")


BUDGET = 20_000
AROUND = """, t AS (SELECT qualname AS target, path AS p, qualname AS q FROM symbols WHERE path LIKE 'lib/brand_1%'),
 c1 AS (SELECT target, src_path AS path, src AS qualname, certainty FROM t JOIN calls ON dst_path = p AND dst = q), i1 AS (SELECT target, src AS path, certainty FROM t JOIN edges ON dst = p WHERE kind = 'import'),
 far AS (SELECT target, path, certainty, 1 AS d, 120 AS base FROM c1 UNION ALL SELECT target, src_path, c.certainty, 2, 120 FROM (SELECT DISTINCT target, path, qualname FROM c1) a JOIN calls c ON c.dst_path = a.path AND c.dst = a.qualname
  UNION ALL SELECT target, path, certainty, 1, 120 FROM i1 UNION ALL SELECT target, e.src, e.certainty, 2, 120 FROM (SELECT DISTINCT target, path FROM i1) a JOIN edges e ON e.dst = a.path AND e.kind = 'import' UNION ALL SELECT target, dst_path, certainty, 1, 100 FROM t JOIN calls ON src_path = p AND src = q),
 scored AS (SELECT target, path, (base * CASE certainty WHEN 'exact' THEN 100 WHEN 'resolved' THEN 85 WHEN 'heuristic' THEN 50 ELSE 25 END // 100) // d AS score, d, false AS pinned FROM far UNION ALL SELECT target, p, 200, 0, true FROM t),
 cand AS (SELECT target, s.path, max(score) AS score, min(d) AS d, bool_or(pinned) AS pinned, greatest(1, max(size_bytes) // 4) AS n FROM scored s JOIN files f ON f.path = s.path GROUP BY target, s.path),
 placed AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY NOT pinned, -score, d, path) AS place FROM cand)"""


@query("context", AROUND + f""", fold(target, place, must, should, verdict) AS (SELECT target, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), '' FROM t UNION ALL
  SELECT target, place, must + CASE WHEN v = 'must' THEN n ELSE 0 END, should + CASE WHEN v IN ('demoted', 'should') THEN n ELSE 0 END, v FROM (
   SELECT x.target, x.place, x.n, f.must, f.should, CASE WHEN x.d <= 1 AND (x.pinned OR f.must + x.n <= {BUDGET}) THEN 'must' WHEN x.d <= 1 THEN 'demoted' WHEN f.must + f.should + x.n <= {BUDGET} THEN 'should' ELSE 'skipped' END AS v
   FROM fold f JOIN placed x ON x.target = f.target AND x.place = f.place + 1))
 SELECT p.target, p.path, CAST(p.place AS INT) AS place, verdict, CAST(p.score AS INT) AS score, p.d AS distance, CAST(p.n AS INT) AS estimated_tokens FROM placed p JOIN fold f ON f.target = p.target AND f.place = p.place""")
def _contexts(g: Graph) -> DataFrame:
    targets = g.symbols.where("path like 'lib/brand_1%'").select(F.col("qualname").alias("target"), "path", "qualname")
    found = context.chosen(context.candidates_of(g, targets), BUDGET)
    return found.select("target", "path", "place", "verdict", "score", "distance", "estimated_tokens")


@query("simulate_extract", CALLEE + ", users AS (SELECT src_path AS src FROM calls JOIN busy ON dst_path = p AND dst = q UNION SELECT src FROM edges JOIN busy ON dst = p WHERE kind = 'import') SELECT 'added' AS change, src, 'lib/new.rs' AS dst, 'import' AS kind, 'heuristic' AS certainty FROM users WHERE src <> (SELECT p FROM busy) UNION ALL SELECT 'added', p, 'lib/new.rs', 'import', 'exact' FROM busy")
def _simulate(g: Graph) -> DataFrame:
    path, name = busy_symbol(g)
    return compare.edge_diff(g.file_edges, compare.extract(g.file_edges, g.symbols, g.symbol_edges, [name], path, "lib/new.rs")[0])


@query("baseline", VIOLATION + """, imp AS (SELECT DISTINCT src, dst FROM edges WHERE kind = 'import'), seen(n) AS (SELECT path FROM files WHERE path NOT IN (SELECT dst FROM imp) UNION SELECT e.dst FROM seen JOIN imp e ON e.src = seen.n)
 SELECT (SELECT count(*) FROM files) AS total_files, (SELECT count(*) FROM symbols) AS total_symbols, (SELECT count(*) FROM edges WHERE kind = 'import') AS total_imports, (SELECT count(*) FROM edges WHERE kind = 'import' AND certainty <> 'exact') AS unresolved_imports,
 (SELECT count(*) FROM lay JOIN rule ON f = from_layer AND t = to_layer) AS layer_violations, (SELECT count(*) FROM files WHERE path NOT IN (SELECT n FROM seen)) AS unreachable_files,
 (SELECT round(avg(CASE WHEN i + o = 0 THEN 0.0 ELSE o / CAST(i + o AS DOUBLE) END), 6) FROM (SELECT path, (SELECT count(*) FROM edges e WHERE e.dst = path) AS i, (SELECT count(*) FROM edges e WHERE e.src = path) AS o FROM files) x) AS avg_instability""")
def _baseline(g: Graph) -> DataFrame:
    names = ["total_files", "total_symbols", "total_imports", "unresolved_imports", "layer_violations", "unreachable_files"]
    return report.baseline(g, CONFIG).select(*names, F.round("avg_instability", 6).alias("avg_instability"))


def stored(spark: SparkSession) -> snapshots.Snapshots:
    return snapshots.Snapshots(spark, f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}")


def snapshot_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, s = load(spark, sf_dir), stored(spark)
    for name, at in (("first", 10), ("second", 30), ("third", 20), ("first", 40)):
        s.save(g, name, at, f"c{at}")
    s.delete("third")
    found = s.list()
    n = s.load("first").files.agg(F.count("*").alias("files"))
    return found.crossJoin(n)  # one row


QUERIES["snapshots"] = snapshot_list
ORACLES["snapshots"] = oracle_prefix() + " SELECT name, CAST(stamp AS BIGINT) AS created_at, 'c' || stamp AS commit_sha, 6 AS schema_version, 1 AS snapshot_version, (SELECT count(*) FROM files) AS files FROM (VALUES ('first', 40), ('second', 30)) t(name, stamp)"

SURFACE = "SELECT kind || ':' || name AS identity, max_by({{'p': path, 'q': qualname, 'v': visibility, 'n': n}}, n) AS x FROM (SELECT *, row_number() OVER (ORDER BY qualname, path) AS n FROM symbols WHERE exported AND {keep}) GROUP BY 1"


@query("snapshot_surface_diff", ", b AS (" + SURFACE.format(keep="start_line % 31 <> 5") + "), a AS (" + SURFACE.format(keep="start_line % 29 <> 3") + ") SELECT coalesce(a.identity, b.identity) AS identity, CASE WHEN b.identity IS NULL THEN 'added' WHEN a.identity IS NULL THEN 'removed' ELSE 'modified' END AS change, b.x.n AS before_line, a.x.n AS after_line FROM b FULL JOIN a ON a.identity = b.identity WHERE b.identity IS NULL OR a.identity IS NULL OR a.x <> b.x")
def _snapshot_surface(g: Graph) -> DataFrame:
    return compare.snapshot_surface_diff(g.symbols.where("start_line % 31 <> 5"), g.symbols.where("start_line % 29 <> 3"))


def _stability_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = load(spark, sf_dir).files
    before, after = two_states(spark, sf_dir)
    return compare.stability_delta(before, files, after, files).select(*[F.round(c, 6).alias(c) for c in ("before_avg_instability", "after_avg_instability", "delta")])


MEAN = "(SELECT avg(CASE WHEN i + o = 0 THEN 0.0 ELSE o / CAST(i + o AS DOUBLE) END) FROM (SELECT f.path, coalesce(a.n, 0) AS i, coalesce(b.n, 0) AS o FROM files f LEFT JOIN (SELECT dst, count(*) AS n FROM (SELECT DISTINCT src, dst FROM {t} WHERE kind = 'import') GROUP BY dst) a ON a.dst = f.path LEFT JOIN (SELECT src, count(*) AS n FROM (SELECT DISTINCT src, dst FROM {t} WHERE kind = 'import') GROUP BY src) b ON b.src = f.path))"
QUERIES["stability_delta"] = _stability_delta
ORACLES["stability_delta"] = oracle_prefix() + BEFORE + f", x AS (SELECT {MEAN.format(t='before')} AS m, {MEAN.format(t='after')} AS n) SELECT round(m, 6) AS before_avg_instability, round(n, 6) AS after_avg_instability, round(n - m, 6) AS delta FROM x"
