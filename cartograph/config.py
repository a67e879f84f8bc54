"""Architecture configuration: layers, rules, entry points, capabilities, gates and test patterns."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field

GATE_METRICS = (
    "layer_violations", "cycles", "max_file_fan_in", "parse_errors", "unreachable_files", "unused_exports", "health_score",
    "health_score_delta", "imports_unresolved_pct", "imports_resolved_pct", "public_surface_removed",
)

# Usual test file patterns, and folder names that stand for a layer.
TEST_PATTERNS = ["**/*.test.*", "**/*.spec.*", "tests/**", "**/test_*.rs", "**/__tests__/**"]
TEST_EXCLUDES = ["**/__mocks__/**"]
LAYER_NAMES = {
    "routes": ["routes", "controllers", "views"], "middleware": ["middleware"], "services": ["services", "use-cases"],
    "models": ["models", "entities", "domain"], "utils": ["utils", "helpers", "lib"], "config": ["config"],
}


@dataclass
class Layer:
    name: str
    pattern: str
    description: str | None = None


@dataclass
class Rule:
    source: str
    may_not_import: list[str]
    message: str | None = None

    def text(self, target: str) -> str:
        return self.message or f"{self.source} may not import {target}"


@dataclass
class Capability:
    name: str
    pattern: str | None = None
    symbols: list[str] = field(default_factory=list)
    expected_callers: list[str] = field(default_factory=list)


@dataclass
class Gate:
    metric: str
    max: float | None = None
    min: float | None = None
    max_delta: float | None = None
    min_delta: float | None = None
    severity: str = "error"
    message: str | None = None
    skip: bool = False


@dataclass
class Config:
    layers: list[Layer] = field(default_factory=list)
    rules: list[Rule] = field(default_factory=list)
    entry_points: list[str] = field(default_factory=list)
    capabilities: list[Capability] = field(default_factory=list)
    gates: list[Gate] = field(default_factory=list)
    test_patterns: list[str] = field(default_factory=lambda: list(TEST_PATTERNS))
    test_excludes: list[str] = field(default_factory=lambda: list(TEST_EXCLUDES))

    def validate(self) -> Config:
        names = [x.name for x in self.layers]
        for what, found in (("layer", names), ("capability", [c.name for c in self.capabilities])):
            if twice := sorted({x for x in found if found.count(x) > 1}):
                raise ValueError(f"duplicate {what} name: {twice[0]}")
        for pattern in [*(x.pattern for x in self.layers), *self.entry_points, *self.test_patterns, *self.test_excludes, *(c.pattern for c in self.capabilities if c.pattern)]:
            if not pattern or pattern.count("[") != pattern.count("]") or "***" in pattern:
                raise ValueError(f"not a path pattern: {pattern!r}")
        for rule in self.rules:
            if unknown := [x for x in [rule.source, *rule.may_not_import] if x not in names]:
                raise ValueError(f"rule names an unknown layer: {unknown[0]}")
        for cap in self.capabilities:
            if not cap.pattern and not cap.symbols:
                raise ValueError(f"capability {cap.name} needs a pattern or symbols")
        for gate in self.gates:
            if gate.metric not in GATE_METRICS:
                raise ValueError(f"unknown gate metric: {gate.metric}")
            if not gate.skip and all(x is None for x in (gate.max, gate.min, gate.max_delta, gate.min_delta)):
                raise ValueError(f"gate {gate.metric} has no bound")
            if gate.min is not None and gate.max is not None and gate.min > gate.max:
                raise ValueError(f"gate {gate.metric} has min above max")
        return self


def parse_config(text: str) -> Config:
    d = tomllib.loads(text)
    tests = d.get("tests", {})
    return Config(
        layers=[Layer(x["name"], x["pattern"], x.get("description")) for x in d.get("layer", [])],
        rules=[Rule(x["from"], list(x["may_not_import"]), x.get("message")) for x in d.get("rule", [])],
        entry_points=[x["pattern"] for x in d.get("entry_point", [])],
        capabilities=[Capability(x["name"], x.get("pattern"), x.get("symbols", []), x.get("expected_callers", [])) for x in d.get("capability", [])],
        gates=[Gate(**x) for x in d.get("gate", [])],
        test_patterns=tests.get("patterns", list(TEST_PATTERNS)), test_excludes=tests.get("exclude_patterns", list(TEST_EXCLUDES)),
    ).validate()


def load_config(path: str) -> Config:
    """The configuration in a TOML file; all defaults where there is none."""
    if not os.path.exists(path):
        return Config()
    with open(path, encoding="utf-8") as f:
        return parse_config(f.read())


# The messages of the usual rules.
def usual_rules(layers: list[Layer]) -> list[Rule]:
    """Rules for the layers that are there, from outer to inner ones."""
    names = {x.name for x in layers}
    out = []
    for source, targets, message in (
        ("services", ["routes"], "services must not import routes"),
        ("models", ["services", "routes"], "models must not import services or routes"),
        ("utils", ["models", "services", "routes"], "utils must stay infrastructure-only"),
    ):
        there = [t for t in targets if t in names]
        if source in names and there:
            out.append(Rule(source, there, message))
    return out


def detect_layers(folders: list[str]) -> Config:
    """Layers and usual rules from the relative folder paths of a tree, at most two levels deep."""
    found: dict[str, Layer] = {}
    for folder in sorted(folders):
        if folder.count("/") > 1:
            continue
        last = folder.rsplit("/", 1)[-1].lower()
        for layer, names in LAYER_NAMES.items():
            if last in names and layer not in found:
                found[layer] = Layer(layer, f"{folder}/**")
    layers = [found[k] for k in sorted(found)]
    return Config(layers=layers, rules=usual_rules(layers))


def write_config(config: Config, path: str) -> None:
    """Writes layers and rules as TOML; an existing file is never overwritten."""
    if os.path.exists(path):
        raise FileExistsError(path)
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    out = [f"[[layer]]\nname = {quote(x.name)}\npattern = {quote(x.pattern)}\n" for x in config.layers]
    out += [f"[[rule]]\nfrom = {quote(r.source)}\nmay_not_import = [{', '.join(map(quote, r.may_not_import))}]\nmessage = {quote(r.text(r.may_not_import[0]))}\n" for r in config.rules]
    with open(path, "w", encoding="utf-8") as f:
        f.write("\n".join(out))
