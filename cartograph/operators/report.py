"""Health report and quality gates, composed of the other operators."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.config import Config, Gate
from cartograph.functions.glob import matches_any
from cartograph.operators.arch import arch_check
from cartograph.operators.compare import surface_diff
from cartograph.operators.cycles import cycles
from cartograph.operators.entry import unreachable
from cartograph.operators.metrics import risk, stability, unused
from cartograph.plans.kernels import reach
from cartograph.sources.dataset import Graph

# Fixed values below: the weights of the health score, and the wording of gates and their outcomes.
METRICS = (
    "total_files", "total_symbols", "total_imports", "unresolved_imports", "parse_errors", "layer_violations", "cycles", "max_file_fan_in",
    "unreachable_files", "unused_exports", "public_surface_removed",
)


def report(graph: Graph, config: Config, now: int, baseline_symbols: DataFrame | None = None) -> DataFrame:
    """One row: counts, shares, avg_instability and health_score.

    Each part is one aggregate row; the parts are joined as single rows.
    """
    g = graph
    removed = surface_diff(baseline_symbols, g.symbols).agg(F.count_if(F.col("change") == "removed").alias("public_surface_removed")) if baseline_symbols is not None else None
    parts = [
        g.files.agg(F.count("*").alias("total_files"), F.count_if(F.col("parse_status") == "error").alias("parse_errors")),
        g.symbols.agg(F.count("*").alias("total_symbols")),
        g.imports.agg(F.count("*").alias("total_imports"), F.count_if(F.col("resolved_path").isNull()).alias("unresolved_imports")),
        arch_check(g.file_edges, config).agg(F.count("*").alias("layer_violations")),
        cycles(g.file_edges).agg(F.count("*").alias("cycles")),
        stability(g.file_edges, g.files).agg(F.avg("instability").alias("avg_instability"), F.max("fan_in").alias("max_file_fan_in")),
        unreachable(g.files, g.file_edges, g.symbols, now, config.entry_points).agg(F.count("*").alias("unreachable_files")),
        unused(g.symbols, g.symbol_edges).agg(F.count("*").alias("unused_exports")),
    ]
    row = parts[0]
    for p in [*parts[1:], *([removed] if removed is not None else [])]:
        row = row.crossJoin(p)
    if removed is None:
        row = row.withColumn("public_surface_removed", F.lit(0).cast("long"))
    share = F.when(F.col("total_imports") == 0, 0.0).otherwise(100 * F.col("unresolved_imports") / F.col("total_imports"))
    row = row.withColumn("imports_unresolved_pct", share).withColumn("imports_resolved_pct", 100 - share)
    return row.withColumn("health_score", health_score())


def baseline(graph: Graph, config: Config) -> DataFrame:
    """The report row of a stored state, from its graph alone.

    It differs from a live report on purpose: instability counts every edge of any kind, roots without configured entry points need no outgoing edge, unresolved means import
    edges that are not exact, and parse errors and removed surface are zero.
    """
    g = graph
    imports = g.file_edges.where("kind = 'import'")
    if config.entry_points:
        roots = g.files.where(matches_any(F.col("path"), config.entry_points))
    else:
        roots = g.files.join(imports.select(F.col("dst").alias("path")), "path", "left_anti")
    seen = reach(imports.select("src", "dst"), roots.select(F.col("path").alias("node"))).select(F.col("node").alias("path"))
    ends = g.file_edges.select(F.col("dst").alias("path"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionByName(g.file_edges.select(F.col("src").alias("path"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    fan = g.files.select("path").join(ends.groupBy("path").agg(F.sum("i").alias("i"), F.sum("o").alias("o")), "path", "left").na.fill(0)
    instability = F.when(F.col("i") + F.col("o") == 0, 0.0).otherwise(F.col("o") / (F.col("i") + F.col("o")))
    parts = [
        g.files.agg(F.count("*").alias("total_files")), g.symbols.agg(F.count("*").alias("total_symbols")),
        imports.agg(F.count("*").alias("total_imports"), F.count_if(F.col("certainty") != "exact").alias("unresolved_imports")),
        arch_check(g.file_edges, config).agg(F.count("*").alias("layer_violations")), cycles(g.file_edges).agg(F.count("*").alias("cycles")),
        fan.agg(F.avg(instability).alias("avg_instability")), stability(g.file_edges, g.files).agg(F.max("fan_in").alias("max_file_fan_in")),
        g.files.join(seen, "path", "left_anti").agg(F.count("*").alias("unreachable_files")), unused(g.symbols, g.symbol_edges).agg(F.count("*").alias("unused_exports")),
    ]
    row = parts[0]
    for p in parts[1:]:
        row = row.crossJoin(p)
    zero = F.lit(0).cast("long")
    share = F.when(F.col("total_imports") == 0, 0.0).otherwise(100 * F.col("unresolved_imports") / F.col("total_imports"))
    row = row.withColumns({"parse_errors": zero, "public_surface_removed": zero, "imports_unresolved_pct": share})
    return row.withColumn("imports_resolved_pct", 100 - F.col("imports_unresolved_pct")).withColumn("health_score", health_score())


# The metrics that a comparison lists, the notes on certainty, and the wording of advice.
COMPARED = (
    "health_score", "layer_violations", "cycles", "unreachable_files", "public_surface_removed", "avg_instability", "max_file_fan_in", "parse_errors", "unresolved_imports", "unused_exports",
)
NOTES = {"exact": "Higher confidence — static imports are exhaustively detected.", "heuristic": "Dynamic imports may create edges not captured by static analysis."}
ADVICE = {
    "parse_errors": "reduce parse errors across {} indexed files before relying on deeper analysis",
    "layer_violations": "resolve {} architecture layer violations to restore intended boundaries",
    "cycles": "break {} dependency cycles to improve traversal clarity and change isolation",
    "unreachable_files": "review {} unreachable files for dead code or missing entry-point declarations",
    "public_surface_removed": "review {} removed public surface entries against the comparison snapshot before landing changes",
}
REGRESSED = "health score regressed by {:.1f} points versus {}"
ALL_WELL = "health metrics are within expected bounds for the current indexed snapshot"
UNUSED = "exported symbol `{}` has no indexed inbound call edges"


def comparison(current: dict, base: dict, target: str = "baseline") -> dict:
    """What has changed since a baseline row, metric by metric."""
    return {"target": target} | {f"baseline_{n}": base[n] for n in COMPARED} | {f"{n}_delta": current[n] - base[n] for n in COMPARED}


def recommendations(metrics: dict, compared: dict | None = None) -> list[str]:
    """Advice for the metrics that are off."""
    out = [text.format(metrics[k]) for k, text in ADVICE.items() if metrics[k] > 0]
    if compared and compared["health_score_delta"] < 0:
        out.append(REGRESSED.format(-compared["health_score_delta"], compared["target"]))
    return out or [ALL_WELL]


def details(graph: Graph, config: Config, now: int, hotspots: int = 5) -> dict[str, DataFrame]:
    """What stands behind a report's numbers: risk_hotspots, arch_violations, cycles_detail, unreachable_detail, unused_export_detail, each in its own order."""
    g = graph
    note = F.coalesce(*[F.when(F.col("certainty") == k, v) for k, v in NOTES.items()])
    before, after = UNUSED.split("{}")
    return {
        "risk_hotspots": risk(g.file_edges, g.files, g.churn, now, top=hotspots),
        "arch_violations": arch_check(g.file_edges, config).orderBy("from_file", "to_file", "message"),
        "cycles_detail": cycles(g.file_edges).orderBy("first_file"),
        "unreachable_detail": unreachable(g.files, g.file_edges, g.symbols, now, config.entry_points).withColumn("certainty_note", note).orderBy("file"),
        "unused_export_detail": unused(g.symbols, g.symbol_edges).withColumn("reason", F.concat(F.lit(before), "qualname", F.lit(after))).orderBy("path", "line", "qualname"),
    }


def health_score():
    c = F.col
    score = (
        100 - 12 * c("parse_errors") - 8 * c("layer_violations") - 8 * c("cycles") - 2 * c("unreachable_files") - c("unused_exports")
        - 0.5 * c("imports_unresolved_pct") - 5 * c("public_surface_removed")
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))


def default_gates(strict: bool) -> list[Gate]:
    level = "error" if strict else "warning"
    return [
        Gate("parse_errors", max=0.0, severity="error", message="parse errors must remain at zero"),
        Gate("layer_violations", max=0.0, severity=level, message="layer violations should be eliminated"),
        Gate("cycles", max=0.0, severity=level, message="dependency cycles should remain at zero"),
        Gate("health_score", min=90.0 if strict else 75.0, severity=level, message="overall health score should remain healthy"),
    ]


def evaluate(gate: Gate, current: float, baseline: float | None, strict: bool) -> dict:
    """A gate's outcome for one metric value."""
    delta = None if baseline is None else current - baseline
    if gate.metric == "health_score_delta":
        current, baseline, delta = delta or 0.0, 0.0, delta
    why = []
    if gate.min is not None and current < gate.min:
        why.append(f"current value {current:.2f} is below min {gate.min:.2f}")
    if gate.max is not None and current > gate.max:
        why.append(f"current value {current:.2f} exceeds max {gate.max:.2f}")
    for name, bound, broken in (("min_delta", gate.min_delta, lambda d, b: d < b), ("max_delta", gate.max_delta, lambda d, b: d > b)):
        if bound is None:
            continue
        if delta is None:
            why.append(f"comparison snapshot required for {name}")
        elif broken(delta, bound):
            why.append(f"delta {delta:.2f} {'is below' if name == 'min_delta' else 'exceeds'} {name} {bound:.2f}")
    status = "pass" if not why else "fail" if strict and gate.severity == "error" else "warning"
    return asdict(gate) | {"status": status, "current_value": current, "baseline_value": baseline, "delta": delta, "detail": "; ".join(why) or "metric satisfied configured thresholds"}


def gate_table(values: DataFrame, gates: list[Gate] | None = None, strict: bool = False) -> DataFrame:
    """The gates over many areas at once: area, metric, current, baseline (or null) in; area, metric, status, delta, reasons (broken bounds) out."""
    gates = [g for g in gates or default_gates(strict) if not g.skip]
    out = None
    for g in gates:
        v = values.where(F.col("metric") == ("health_score" if g.metric == "health_score_delta" else g.metric))
        delta = F.col("current") - F.col("baseline")
        now = F.coalesce(delta, F.lit(0.0)) if g.metric == "health_score_delta" else F.col("current")
        broken = [F.when(now < g.min, "min") if g.min is not None else None, F.when(now > g.max, "max") if g.max is not None else None]
        broken += [F.when(delta.isNull() | (delta < g.min_delta), "min_delta") if g.min_delta is not None else None, F.when(delta.isNull() | (delta > g.max_delta), "max_delta") if g.max_delta is not None else None]
        why = F.filter(F.array(*[b for b in broken if b is not None], F.lit(None).cast("string")), lambda x: x.isNotNull())
        worst = "fail" if strict and g.severity == "error" else "warning"
        rows = v.select("area", F.lit(g.metric).alias("metric"), F.when(F.size(why) == 0, "pass").otherwise(worst).alias("status"), delta.alias("delta"), F.array_join(why, ",").alias("reasons"))
        out = rows if out is None else out.unionByName(rows)
    return out


def gate(metrics: dict, gates: list[Gate] | None = None, baseline: dict | None = None, strict: bool = False) -> list[dict]:
    """Outcomes of all gates for one report row (a dict); skipped gates are listed as such."""
    out = []
    for g in gates or default_gates(strict):
        if g.skip:
            out.append(asdict(g) | {"status": "skipped"})
            continue
        name = "health_score" if g.metric == "health_score_delta" else g.metric
        out.append(evaluate(g, float(metrics[name]), float(baseline[name]) if baseline and name in baseline else None, strict))
    return out
