"""Published results of a small Rust tree and of a capability audit: the graphs are given, the values are fixed."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from cartograph.config import Capability, Config, parse_config
from cartograph import cli
from cartograph.operators import compare, entry, impact, metrics, report, similar
from cartograph.sources.dataset import Graph
from cartograph.schema import CHURN, FILE_EDGES, FILES, IMPORTS, SYMBOL_EDGES, SYMBOLS

NAMES = ["lib", "main", "parser", "resolver", "utils"]


def small_rust(spark):
    files = spark.createDataFrame([(f"src/{n}.rs", "rust", "ok", False, 0, "", 1000, 100) for n in NAMES], FILES)
    imports = spark.createDataFrame([("src/resolver.rs", "use crate::parser;", "relative", "src/parser.rs", None, 0, 18, 1, "exact")], IMPORTS)
    contained = [("src/lib.rs", f"src/{n}.rs", "module", "exact") for n in ("parser", "resolver", "utils")]
    edges = spark.createDataFrame([*contained, ("src/resolver.rs", "src/parser.rs", "import", "exact")], FILE_EDGES)
    names = [("lib", "parser", "module", 1), ("lib", "resolver", "module", 2), ("lib", "utils", "module", 3), ("lib", "greet", "function", 5), ("lib", "farewell", "function", 10), ("main", "main", "function", 1),
             ("parser", "parse", "function", 1), ("parser", "tokenize", "function", 5), ("resolver", "resolve", "function", 3), ("utils", "format_output", "function", 1)]
    symbols = spark.createDataFrame([(f"src/{f}.rs", n, f"{f}::{n}", k, "public" if n not in ("main", "tokenize") else "local", n not in ("main", "tokenize"), 0, 0, line, line) for f, n, k, line in names], SYMBOLS)
    calls = [("lib", "greet", "parser", "parse", 6), ("lib", "greet", "utils", "format_output", 7), ("resolver", "resolve", "parser", "parse", 4), ("parser", "parse", "parser", "tokenize", 2)]
    symbol_edges = spark.createDataFrame([(f"src/{a}.rs", f"{a}::{b}", f"src/{c}.rs", f"{c}::{d}", "resolved", line) for a, b, c, d, line in calls], SYMBOL_EDGES)
    return Graph(files, imports, edges, symbols, symbol_edges, spark.createDataFrame([], CHURN))


def test_risk_without_churn_counts_imports_only(spark):
    g = small_rust(spark)
    rows = metrics.risk(g.file_edges, g.files, g.churn, 2000, 30, top=9).collect()
    text = "git churn unavailable; score falls back to dependency-only blast radius ({0} direct dependents, {0} transitive dependents)"
    assert [(r["path"], r["direct_dependents"], r["transitive_dependents"], r["churn_commits"], r["score"], r["normalized_score"]) for r in rows] == [("src/parser.rs", 1, 1, 0, 1.0, 100)] + [(f"src/{n}.rs", 0, 0, 0, 0.0, 0) for n in ("lib", "main", "resolver", "utils")]
    assert [r["reason"] for r in rows] == [text.format(1)] + [text.format(0)] * 4
    s = metrics.risk_summary(metrics.risk(g.file_edges, g.files, g.churn, 2000)).first()
    assert (s["git_available"], s["scored_files"], round(s["avg_score"], 9), s["max_score"]) == (False, 5, 0.2, 1.0)
    one = metrics.risk(g.file_edges, g.files, g.churn, 2000, file="src/utils.rs").collect()
    assert [(r["path"], r["normalized_score"]) for r in one] == [("src/utils.rs", 0)]


def test_split_of_a_file_without_callers(spark):
    g = small_rust(spark)
    out = sorted(similar.split(g.symbols, g.symbol_edges, "src/lib.rs", 2).collect(), key=lambda r: (r["id"], r["member"]))
    alone = "symbols share little external call evidence and are grouped by local structure"
    assert [(r["id"], r["qualname"], r["line"], r["inbound_files"], r["cohesion_score"], r["suggested_name"], r["rationale"], r["warnings"]) for r in out] == [
        (1, "lib::greet", 5, 0, 1.0, "cluster_1_functions", alone, ""), (2, "lib::farewell", 10, 0, 1.0, "cluster_2_functions", alone, ""),
    ]
    s = similar.split_summary(similar.split(g.symbols, g.symbol_edges, "src/lib.rs", 2)).first()
    assert tuple(s)[1:] == (2, 2, 2, 2)
    small = similar.split(g.symbols, g.symbol_edges, "src/parser.rs").collect()
    assert {r["warnings"] for r in small} == {similar.TOO_SMALL} and len(small) == 2
    assert similar.split(g.symbols, g.symbol_edges, "none.rs").count() == 0


def test_report_and_baseline(spark):
    g = small_rust(spark)
    base = report.baseline(g, Config()).first().asDict()
    names = ("total_files", "total_symbols", "total_imports", "unresolved_imports", "cycles", "max_file_fan_in", "unused_exports", "parse_errors", "public_surface_removed")
    assert [base[n] for n in names] == [5, 10, 1, 0, 0, 1, 6, 0, 0] and round(base["avg_instability"], 9) == 0.3 and base["unreachable_files"] == 0 and base["health_score"] == 94.0
    now = report.report(g, Config(), 2000).first().asDict()
    assert (now["avg_instability"], now["unreachable_files"], now["health_score"], now["imports_resolved_pct"]) == (0.2, 3, 88.0, 100.0)
    rooted = report.baseline(g, parse_config('[[entry_point]]\npattern = "src/resolver.rs"')).first()
    assert rooted["unreachable_files"] == 3
    none = Graph(g.files, g.imports.limit(0), g.file_edges.limit(0), g.symbols, g.symbol_edges, g.churn)
    assert report.report(none, Config(), 2000).first()["imports_resolved_pct"] == 100.0 == report.baseline(none, Config()).first()["imports_resolved_pct"]


def test_audit_paths_and_certainty(spark):
    paths = ["src/cli/main.ts", "src/workers/job.ts", "src/shared/api.ts", "src/http/client.ts", "src/other.ts"]
    files = spark.createDataFrame([(p, "typescript", "ok", False, 0, "", 0, 1) for p in paths], FILES)
    edges = spark.createDataFrame([(paths[0], paths[2], "import", "exact"), (paths[1], paths[2], "import", "heuristic"), (paths[2], paths[3], "import", "resolved"), (paths[4], paths[3], "module", "exact")], FILE_EDGES)
    symbols = spark.createDataFrame([(paths[3], "fetch", "http::client::fetch", "function", "public", True, 0, 0, 1, 1)], SYMBOLS)
    network = Capability("network", pattern=paths[3], symbols=["fetch"], expected_callers=["src/workers/**"])
    got = entry.audit(files, edges, symbols, network, [paths[0], paths[1], paths[4]]).orderBy("entry_point").collect()
    assert [tuple(r) for r in got] == [(paths[0], 2, "resolved", False, [paths[0], paths[2], paths[3]]), (paths[1], 2, "heuristic", True, [paths[1], paths[2], paths[3]])]
    itself = entry.audit(files, edges, symbols, network, [paths[3]]).collect()
    assert [tuple(r) for r in itself] == [(paths[3], 0, "exact", False, [paths[3]])]


def plain_split(names, callers, wanted):
    """Greedy merging of whole groups by the likeness of their united callers, straight from the rule."""
    groups = [[n] for n in names]
    united = lambda g: set().union(*(callers[n] for n in g))
    alike = lambda a, b: 1.0 if not (a or b) else len(a & b) / len(a | b)
    while len(groups) > wanted:
        best, pair = -1.0, None
        for i, j in combinations(range(len(groups)), 2):
            score = alike(united(groups[i]), united(groups[j]))
            if score > best:
                best, pair = score, (i, j)
        groups[pair[0]] = sorted(groups[pair[0]] + groups.pop(pair[1]))
    return sorted(groups)


def test_split_of_many_files_against_the_rule(spark):
    rng = random.Random(9)
    symbols, calls, want = [], [], {}
    for f in range(120):
        path, n = f"f{f:03d}.rs", rng.randrange(1, 9)
        names = [f"f{f:03d}::s{i}" for i in range(n)]
        callers = {q: {f"c{rng.randrange(6)}" for _ in range(rng.randrange(4))} for q in names}
        kinds = {q: rng.choice(["function", "function", "struct", "module", "enum"]) for q in names}
        shown = {q: rng.random() < 0.8 for q in names}
        symbols += [(path, q[-2:], q, kinds[q], "public", shown[q], 0, 0, i + 1, i + 1) for i, q in enumerate(names)]
        calls += [(c, f"{c}::x", path, q, "exact", k) for q in names for c in callers[q] for k in range(2)]
        kept = [q for q in names if shown[q] or sum(shown.values()) < 2]
        kept = [q for q in kept if kinds[q] != "module"]
        if kept:
            want[path] = (plain_split(kept, callers, min(3, len(kept))), callers, kinds)
    out = similar.split(spark.createDataFrame(symbols, SYMBOLS), spark.createDataFrame(calls, SYMBOL_EDGES)).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["path"], r["id"], r["member"])):
        got.setdefault(r["path"], {}).setdefault(r["id"], []).append(r)
    assert {p: [[r["qualname"] for r in c] for c in x.values()] for p, x in got.items()} == {p: w[0] for p, w in want.items()}
    for p, x in got.items():
        _, callers, kinds = want[p]
        for c in x.values():
            names = [r["qualname"] for r in c]
            pairs = [1.0 if not callers[a] | callers[b] else len(callers[a] & callers[b]) / len(callers[a] | callers[b]) for a, b in combinations(names, 2)]
            assert abs(c[0]["cohesion_score"] - (sum(pairs) / len(pairs) if pairs else 1.0)) < 1e-12
            assert [r["inbound_files"] for r in c] == [len(callers[q]) for q in names]
            led = sorted(set().union(*(callers[q] for q in names)))[:2]
            assert c[0]["rationale"] == (similar.SHARED.format(len(led), ", ".join(led)) if led else similar.ALONE)
            plural = [similar.PLURAL[kinds[q]] for q in names]
            assert c[0]["suggested_name"].endswith(max(plural, key=lambda k: (plural.count(k), k)))


def test_steps_of_a_path_leave_the_start_out(spark):
    g = small_rust(spark)
    exact = g.symbol_edges.withColumn("certainty", F.when(F.col("dst") == "parser::tokenize", "exact").otherwise(F.col("certainty")))
    rows = impact.why(g.symbols, exact, g.file_edges, "lib::greet", "parser::tokenize").orderBy("distance").collect()
    assert [tuple(r) for r in rows] == [("symbol", "src/parser.rs", "parser::parse", "call", "resolved", "called by lib::greet", 1), ("symbol", "src/parser.rs", "parser::tokenize", "call", "exact", "called by parser::parse", 2)]
    assert [tuple(r) for r in impact.why(g.symbols, g.symbol_edges, g.file_edges, "src/resolver.rs", "src/parser.rs").collect()] == [("file", "src/parser.rs", None, "import", "exact", "imported by src/resolver.rs", 1)]
    assert impact.why(g.symbols, g.symbol_edges, g.file_edges, "src/parser.rs", "src/resolver.rs").count() == 0
    assert impact.why(g.symbols, g.symbol_edges, g.file_edges, "src/parser.rs", "src/parser.rs").count() == 0


def test_comparison_advice_and_details(spark):
    g = small_rust(spark)
    base = report.baseline(g, Config()).first().asDict()
    now = report.report(g, Config(), 1000 + 3 * 86400).first().asDict() | {"health_score": 82.0, "unused_exports": 7, "public_surface_removed": 1}
    c = report.comparison(now, base)
    deltas = {"health_score": -12.0, "layer_violations": 0, "cycles": 0, "unreachable_files": 3, "public_surface_removed": 1, "max_file_fan_in": 0, "parse_errors": 0, "unresolved_imports": 0, "unused_exports": 1}
    assert {k: c[f"{k}_delta"] for k in deltas} == deltas and abs(c["avg_instability_delta"] + 0.1) < 1e-9
    assert report.recommendations(now, c) == [
        "review 3 unreachable files for dead code or missing entry-point declarations",
        "review 1 removed public surface entries against the comparison snapshot before landing changes", "health score regressed by 12.0 points versus baseline",
    ]
    assert report.recommendations(base) == [report.ALL_WELL]
    parts = {k: [r.asDict() for r in df.collect()] for k, df in report.details(g, Config(), 1000 + 3 * 86400).items()}
    assert [r["path"] for r in parts["risk_hotspots"]] == ["src/parser.rs", "src/lib.rs", "src/main.rs", "src/resolver.rs", "src/utils.rs"] and not parts["arch_violations"] and not parts["cycles_detail"]
    assert [(r["file"], r["last_modified_days_ago"], r["exported_symbols"], r["certainty_note"][:6]) for r in parts["unreachable_detail"]] == [("src/lib.rs", 3, 5, "Higher"), ("src/main.rs", 3, 0, "Higher"), ("src/utils.rs", 3, 1, "Higher")]
    assert parts["unused_export_detail"][0]["reason"] == "exported symbol `lib::parser` has no indexed inbound call edges" and len(parts["unused_export_detail"]) == 6
    text = cli.markdown(now, report.gate(now), c, parts)
    assert "Score: 82.0 (-12.0 since baseline)" in text and "| unreachable_files | 3 | +3 |" in text and "## risk hotspots" in text and text.endswith("versus baseline\n")


def test_what_a_simulated_extraction_refuses(spark):
    g = small_rust(spark)
    assert compare.source_of(g, [" parse ", "parser::tokenize"], "src/new.rs") == "src/parser.rs"
    for names, into, text in (([], "n.rs", "needs symbols"), (["parse", " "], "n.rs", "blank"), (["parse", "parse "], "n.rs", "twice: parse"), (["parse", "nobody"], "n.rs", "unknown symbols: nobody"),
                              (["parse", "greet"], "n.rs", "several files"), (["parse"], "src/parser.rs", "exists"), (["parse"], "src/lib.rs", "exists")):
        with pytest.raises(ValueError, match=text):
            compare.source_of(g, names, into)
    with pytest.raises(ValueError, match="are in src/parser.rs"):
        compare.simulate_extract(g, Config(), ["parse"], "src/lib.rs", "src/new.rs")
    assert compare.simulate_extract(g, Config(), ["parse"], None, "src/new.rs")["cycles"] == (0, 0)
