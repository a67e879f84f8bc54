"""Scores on hand-made graphs, and some catalogue queries against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from cartograph.config import Config, Layer, Rule
from cartograph.operators import arch, compare, cycles, entry, impact, metrics, report, similar
from cartograph.plans import catalog, catalog_lang, catalog_sources  # noqa: F401 - the last two add to the first
from cartograph.plans.kernels import reach_counts
from cartograph.sources.dataset import Graph

SF = "/root/testdata/sf0.001"


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, k, c) for a, b, k, c in pairs], "src string, dst string, kind string, certainty string")


def files(spark, *paths):
    return spark.createDataFrame([(p, "rust", "ok", 100, 0) for p in paths], "path string, language string, parse_status string, size_bytes long, mtime long")


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_four_cycle_counts_itself_and_breaks_rules(spark):
    ring = ["src/models/a", "src/services/b", "src/routes/c", "src/utils/d"]
    e = edges(spark, [(ring[i], ring[(i + 1) % 4], "import", "exact") for i in range(4)])
    assert rows(reach_counts(e.select("src", "dst")), "node", "reached") == [(p, 4) for p in sorted(ring)]
    assert rows(cycles.cycles(e), "first_file", "size", "edge_count", "external_dependents", "severity") == [("src/models/a", 4, 4, 0, "high")]
    config = Config(layers=[Layer(n, f"src/{n}/**") for n in ("models", "services", "routes", "utils")], rules=[Rule("services", ["routes"]), Rule("utils", ["models"], "m")])
    assert rows(arch.arch_check(e, config), "from_layer", "message") == [("services", "services may not import routes"), ("utils", "m")]


def test_risk_and_cochange(spark):
    e = edges(spark, [("r", "p", "import", "exact"), ("u", "p", "module", "exact")])
    churn = spark.createDataFrame([("p", "c1", 100), ("p", "c2", 200), ("u", "c2", 200), ("u", "c3", None)], "path string, commit_sha string, committed_at long")
    got = {r["path"]: r for r in metrics.risk(e, files(spark, "p", "r", "u"), churn, now=300).collect()}
    assert got["p"]["score"] == pytest.approx(math.log2(2) * math.log2(3)) and got["p"]["direct_dependents"] == 1 and got["p"]["normalized_score"] == 100 and got["u"]["score"] == 0
    assert rows(metrics.cochange(churn, "p", now=300), "path", "shared_commits", "target_commits", "score") == [("u", 1, 2, 0.5)]


def test_entries_cones_and_coverage(spark):
    e = edges(spark, [("t/x", "a", "import", "exact"), ("a", "b", "import", "heuristic"), ("a", "c", "import", "resolved"), ("b", "d", "import", "exact"), ("c", "d", "import", "resolved")])
    f = files(spark, "t/x", "a", "b", "c", "d", "lone")
    assert rows(entry.entry_list(f, e), "file") == [("t/x",)]
    assert rows(entry.entry_cone(e, "a"), "file", "distance", "certainty") == [("a", 0, "exact"), ("b", 1, "heuristic"), ("c", 1, "resolved"), ("d", 2, "resolved")]
    assert rows(entry.coverage(f, e, ["t/**"]), "path", "distance") == [("a", 1), ("b", 2), ("c", 2), ("d", 3)]


def test_differences_and_extraction(spark):
    a = edges(spark, [("a", "b", "import", "exact"), ("a", "c", "import", "exact")])
    b = edges(spark, [("a", "b", "import", "exact"), ("d", "b", "import", "exact")])
    assert rows(compare.edge_diff(a, b), "change", "src", "dst") == [("added", "d", "b"), ("removed", "a", "c")]
    assert rows(compare.centrality_delta(a, b), "path", "delta") == [("b", 1)]
    symbols = spark.createDataFrame([("b", "f", "b::f", "function", "public", True, 1), ("b", "g", "b::g", "function", "public", True, 2)], "path string, name string, qualname string, kind string, visibility string, exported boolean, start_line int")
    calls = spark.createDataFrame([("a", "a::x", "b", "b::f", "exact", 3)], "src_path string, src string, dst_path string, dst string, certainty string, call_line int")
    new_edges, moved = compare.extract(a, symbols, calls, ["f"], "b", "n")
    assert rows(new_edges, "src", "dst") == [("a", "b"), ("a", "c"), ("a", "n"), ("b", "n")]
    assert rows(moved, "path", "qualname") == [("b", "b::g"), ("n", "b::f")]
    assert rows(compare.surface_diff(symbols, moved), "identity", "change") == [("function:f", "modified")]


def test_simulation_and_baseline(spark):
    e = edges(spark, [("a", "b", "import", "exact"), ("b", "a", "import", "exact")])
    symbols = spark.createDataFrame([("b", "f", "b::f", "function", "public", True, 1)], "path string, name string, qualname string, kind string, visibility string, exported boolean, start_line int")
    calls = spark.createDataFrame([("a", "a::x", "b", "b::f", "exact", 3)], "src_path string, src string, dst_path string, dst string, certainty string, call_line int")
    imports = spark.createDataFrame([("a", "use b", "b")], "path string, raw_text string, resolved_path string")
    g = Graph(files(spark, "a", "b"), imports, e, symbols, calls, None)
    got = compare.simulate_extract(g, Config(), ["f"], "b", "n")
    assert got["cycles"] == (1, 1) and got["recommendation"] == "low_confidence"
    assert rows(got["edges"], "change", "src", "dst") == [("added", "a", "n"), ("added", "b", "n")]
    assert [compare.recommend(*x) for x in ((True, 1, 1, 0, 0, False), (False, 1, 2, 0, 0, False), (False, 1, 1, 0, 0, False))] == ["high_value", "risky", "neutral"]
    row = report.baseline(g, Config()).first().asDict()
    assert (row["cycles"], row["unreachable_files"], row["health_score"]) == (1, 2, 88.0)
    assert report.comparison({**row, "health_score": 80.0}, row)["health_score_delta"] == -8.0
    assert report.recommendations(row)[0].startswith("break 1 dependency cycles")


def test_first_visited_edge_stands_for_the_rest(spark):
    """Of two calls at one distance the one met first counts, whatever its certainty is called."""
    e = spark.createDataFrame([("b", "b::x", "a", "a::f", "exact", 1), ("c", "c::y", "a", "a::f", "exact", 2), ("d", "d::z", "b", "b::x", "resolved", 3), ("d", "d::z", "c", "c::y", "dynamic", 4)], "src_path string, src string, dst_path string, dst string, certainty string, call_line int")
    symbols = spark.createDataFrame([("a", "f", "a::f")], "path string, name string, qualname string")
    got = impact.impact(symbols, e, edges(spark, [("d", "a", "import", "exact")]), "f")
    assert rows(got, "distance", "path", "certainty", "reason") == [(1, "b", "exact", "calls f directly"), (1, "c", "exact", "calls f directly"), (1, "d", "exact", "imports f"), (2, "d", "resolved", "calls a symbol that reaches f")]
    assert impact.impact(symbols, e, edges(spark, [("d", "a", "import", "exact")]), "f", "body").count() == 2
    assert rows(impact.why(symbols, e, edges(spark, [("q", "p", "import", "exact"), ("p", "o", "import", "exact"), ("q", "n", "import", "exact"), ("n", "o", "import", "exact")]), "q", "o"), "distance", "path", "reason") == [(1, "n", "imported by q"), (2, "o", "imported by n")]


def test_ordinals_count_from_one(spark):
    from cartograph.plans.kernels import ordinals

    got = ordinals(spark.range(100, 0, -1).repartition(5), "id").collect()
    assert all(r["id"] == r["ordinal"] for r in got) and len(got) == 100


@pytest.mark.parametrize("name", ["deps", "impact", "deps_transitive", "why", "extract_symbols", "resolve_calls", "dsl_binding", "gate", "scan_rules", "delete_cascade", "arch_check", "stability", "risk", "cochange", "surface_diff", "tree"])
def test_catalogue_against_duckdb(spark, name):
    db = duckdb.connect()
    for t in ("part", "orders", "lineitem"):
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), db.execute(catalog.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    flat = lambda d: sorted(map(tuple, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()), key=str)
    assert flat(got) == flat(want)


def test_edge_diff_groups_both_states_once(spark):
    before = edges(spark, [("a", "b", "import", "exact"), ("a", "b", "import", "exact"), ("a", "c", "import", None), ("b", "c", "module", "exact")])
    after = edges(spark, [("a", "c", "import", None), ("b", "c", "import", "exact"), ("b", "c", "import", "exact")])
    found = compare.edge_diff(before, after)
    assert rows(found, "src", "dst", "kind", "change") == [("a", "b", "import", "removed"), ("b", "c", "import", "added"), ("b", "c", "module", "removed")]
    assert rows(compare.added(after, before, ["src", "kind"]), "src", "kind") == [("b", "module")]
    plan = compare.edge_diff(before, after)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
