"""Command line: ``python -m cartograph.cli ROOT COMMAND ...`` over a source tree."""

from __future__ import annotations

import argparse
import sys
import time

from cartograph import envelope
from cartograph.config import Config, load_config
from cartograph.lang.dsl import QueryError, Session
from cartograph.operators import arch, context, cycles, direct, entry, impact, metrics, report, similar
from cartograph.runtime import local_session
from cartograph.sources import git, snapshots, tree
from cartograph.sources.dataset import Graph


def markdown(row: dict, gates: list[dict], compared: dict | None = None, parts: dict[str, list[dict]] | None = None) -> str:
    """A health report for people: numbers with what changed, gates, what stands behind the numbers, and advice."""
    cell = lambda v: str(v).replace("|", "\\|")
    score = f"Score: {row['health_score']:.1f}"
    if compared:
        score += f" ({compared['health_score_delta']:+.1f} since {compared['target']})"
    out = ["# Health report", "", score, "", "| metric | value | change |", "| --- | --- | --- |"]
    for k, v in sorted(row.items()):
        if k != "health_score":
            change = f"{compared[f'{k}_delta']:+g}" if compared and f"{k}_delta" in compared else ""
            out.append(f"| {k} | {round(v, 3) if isinstance(v, float) else v} | {change} |")
    out += ["", "| gate | status | detail |", "| --- | --- | --- |"] + [f"| {g['metric']} | {g['status']} | {cell(g.get('detail', ''))} |" for g in gates]
    for title, rows in (parts or {}).items():
        if rows:
            out += ["", f"## {title.replace('_', ' ')}", "", "| " + " | ".join(rows[0]) + " |", "|" + " --- |" * len(rows[0])]
            out += ["| " + " | ".join(cell(v) for v in r.values()) + " |" for r in rows]
    out += ["", "## advice", ""] + [f"- {x}" for x in report.recommendations(row, compared)]
    return "\n".join(out) + "\n"


def run(g: Graph, config: Config, args: argparse.Namespace, now: int) -> tuple[object, int]:
    """(result, exit code) of one command."""
    c, t = args.command, args.target
    frames = {
        "deps": lambda: direct.deps_transitive(g.file_edges, t, args.depth, args.reverse).orderBy("distance", "place").drop("place") if args.transitive else direct.deps(g.file_edges, g.imports, t, args.reverse).orderBy("path"),
        "symbols": lambda: direct.symbols_of(g.symbols, t).orderBy("start_line", "name"),
        "surface": lambda: direct.surface(g.symbols, t).orderBy("line", "qualname"),
        "impact": lambda: impact.impact(g.symbols, g.symbol_edges, g.file_edges, t, args.change_type, args.depth).orderBy("distance", "path", "qualname"),
        "explain": lambda: impact.explain(g.symbols, g.symbol_edges, g.file_edges, t, args.to).orderBy("distance", "path", "qualname"),
        "why": lambda: impact.why(g.symbols, g.symbol_edges, g.file_edges, t, args.to, args.depth or 8).orderBy("distance"),
        "tree": lambda: direct.tree(g.file_edges, t, args.depth, args.reverse).orderBy("node_id"),
        "doctor": lambda: direct.doctor(g.files, g.imports, g.symbols, g.symbol_edges),
        "cycles": lambda: cycles.cycles(g.file_edges).orderBy("first_file"),
        "unused": lambda: metrics.unused(g.symbols, g.symbol_edges).orderBy("path", "line", "qualname"),
        "stability": lambda: metrics.stability(g.file_edges, g.files, sort=args.sort or "instability"),
        "risk": lambda: metrics.risk(g.file_edges, g.files, g.churn, now, top=args.top or 1 << 30, sort=args.sort or "score", file=t),
        "cochange": lambda: metrics.cochange(g.churn, t, now, top=args.top or 1 << 30, sort=args.sort or "score"),
        "entry": lambda: entry.entry_list(g.files, g.file_edges, config.entry_points).orderBy("file"),
        "cone": lambda: entry.entry_cone(g.file_edges, t).orderBy("distance", "file"),
        "unreachable": lambda: entry.unreachable(g.files, g.file_edges, g.symbols, now, config.entry_points).orderBy("file"),
        "coverage": lambda: entry.coverage(g.files, g.file_edges, config.test_patterns, config.test_excludes).orderBy("test", "distance", "path"),
        "mirror": lambda: similar.mirror(g.files, g.imports, g.symbols, g.file_edges, t, args.to, top=args.top or 1 << 30),
        "split": lambda: similar.split(g.symbols, g.symbol_edges, t).orderBy("id", "member"),
        "arch": lambda: arch.arch_check(g.file_edges, config).orderBy("from_file", "to_file", "message"),
    }
    if c in frames:
        found = envelope.rows(frames[c]())
        return found, int(c == "arch" and bool(found))
    if c in ("callers", "calls"):
        found = direct.find_symbol(g.symbols, t)
        if found is None:
            raise ValueError(f"unknown symbol: {t}")
        back = c == "callers"
        df = impact.call_traversal(g.symbol_edges, *found, back) if args.transitive else direct.calls(g.symbol_edges, *found, reverse=back)
        return envelope.rows(df.orderBy("distance", "qualname", "path")), 0
    if c == "query":
        session, value = Session(g), None
        for text in args.expr or [t]:
            value = session.run(text)
        return envelope.rows(value.df.orderBy("ord").drop("ord") if "ord" in value.df.columns else value.df), 0
    if c == "context":
        return context.as_rows(context.context(g, t, args.change_type, args.budget)), 0
    if c == "pack":
        return context.pack(g, t, args.change_type, args.budget or 2000), 0
    if c == "audit":
        found = {cap.name: envelope.rows(entry.audit(g.files, g.file_edges, g.symbols, cap, config.entry_points)) for cap in config.capabilities}
        return found, int(any(not r["expected"] for x in found.values() for r in x))
    row = report.report(g, config, now).first().asDict()
    compared = base = None
    if args.compare:
        base = report.baseline(snapshots.Snapshots(g.files.sparkSession, args.snapshots).load(args.compare), config).first().asDict()
        compared = report.comparison(row, base, args.compare)
    gates = report.gate(row, config.gates or None, base, strict=args.strict)
    failed = int(c == "gate" and any(x["status"] == "fail" for x in gates))
    if c == "gate":
        return {"metrics": row, "gates": gates, "compare": compared}, failed
    parts = {k: envelope.rows(df) for k, df in report.details(g, config, now).items()}
    if args.markdown:
        return markdown(row, gates, compared, parts), 0
    return {"metrics": row, "gates": gates, "compare": compared, **parts, "recommendations": report.recommendations(row, compared)}, 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cartograph")
    p.add_argument("root")
    p.add_argument("command")
    p.add_argument("target", nargs="?")
    p.add_argument("--to")
    p.add_argument("--sort")
    p.add_argument("--depth", type=int)
    p.add_argument("--top", type=int)
    p.add_argument("--budget", type=int)
    p.add_argument("--change-type", default="signature")
    p.add_argument("--expr", action="append")
    p.add_argument("--compare")
    p.add_argument("--snapshots", default=".graph/snapshots")
    p.add_argument("--config", default=".graph/arch.toml")
    for flag in ("--transitive", "--reverse", "--compact", "--strict", "--markdown"):
        p.add_argument(flag, action="store_true")
    args = p.parse_args(argv)
    spark = local_session(partitions=4)
    try:
        files = tree.scan(spark, args.root)
        g = tree.build(files, tree.load_tsconfig(args.root), int(time.time()))
        g.churn = git.churn(spark, args.root, g.files)
        data, code = run(g, load_config(f"{args.root}/{args.config}"), args, int(time.time()))
    except (QueryError, ValueError, OSError) as e:
        print(envelope.render(envelope.failure(args.command, type(e).__name__, str(e)), args.compact), file=sys.stderr)
        return 2
    print(data if isinstance(data, str) else envelope.render(envelope.envelope(args.command, data), args.compact))
    return code


if __name__ == "__main__":
    sys.exit(main())
