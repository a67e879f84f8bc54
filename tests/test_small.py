"""Parts that need no cluster: patterns, configuration, gates, budgets, envelopes, parsing."""

import re

import pytest

from cartograph import envelope
from cartograph.config import Config, Gate, Layer, Rule, detect_layers, load_config, parse_config, write_config
from cartograph.functions.glob import glob_regex
from cartograph.lang import dsl
from cartograph.operators.context import choose
from cartograph.operators.report import gate
from cartograph.sources import tree


@pytest.mark.parametrize(
    ("pattern", "path", "hit"),
    [("src/*", "src/a/b.rs", True), ("**/x.rs", "x.rs", True), ("**/x.rs", "a/b/x.rs", True), ("a/**/c", "a/c", True), ("?.rs", "ab.rs", False), ("[!a].rs", "b.rs", True), ("a.rs", "abrs", False)],
)
def test_globs(pattern, path, hit):
    assert bool(re.search(glob_regex(pattern), path)) == hit


def test_config_round_trip_and_errors(tmp_path):
    found = detect_layers(["src/services", "src/routes", "src/models", "src/utils", "src/deep/er/utils"])
    assert [x.name for x in found.layers] == ["models", "routes", "services", "utils"]
    assert found.rules[0].message == "services must not import routes"
    path = str(tmp_path / "arch.toml")
    write_config(found, path)
    assert [r.source for r in load_config(path).rules] == ["services", "models", "utils"]
    with pytest.raises(FileExistsError):
        write_config(found, path)
    assert load_config(str(tmp_path / "none.toml")) == Config()
    with pytest.raises(ValueError, match="unknown layer"):
        Config(layers=[Layer("a", "a/**")], rules=[Rule("a", ["b"])]).validate()
    with pytest.raises(ValueError, match="duplicate"):
        parse_config('[[layer]]\nname="a"\npattern="x"\n[[layer]]\nname="a"\npattern="y"')
    with pytest.raises(ValueError, match="no bound"):
        parse_config('[[gate]]\nmetric="cycles"')


def test_gates():
    row = {"parse_errors": 0, "layer_violations": 3, "cycles": 1, "health_score": 60.0}
    assert [g["status"] for g in gate(row, strict=True)] == ["pass", "fail", "fail", "fail"]
    assert [g["status"] for g in gate(row)] == ["pass", "warning", "warning", "warning"]
    delta = gate(row, [Gate("health_score_delta", min_delta=-5)], {"health_score": 70.0}, strict=True)[0]
    assert (delta["status"], delta["current_value"], delta["baseline_value"]) == ("fail", -10.0, 0.0)
    assert gate(row, [Gate("cycles", max_delta=0)])[0]["detail"] == "comparison snapshot required for max_delta"
    assert gate(row, [Gate("cycles", skip=True)])[0]["status"] == "skipped"


def test_budget_demotes_near_files_and_skips_far_ones():
    row = lambda path, score, tokens, distance, pinned=False: {"path": path, "score": score, "estimated_tokens": tokens, "distance": distance, "pinned": pinned}
    c = choose([row("t", 200, 60, 0, True), row("a", 100, 20, 1), row("b", 90, 30, 1), row("c", 50, 5, 2)], 90)
    assert [r["path"] for r in c.must_read] == ["t", "a"]
    assert [r["path"] for r in c.should_read] == ["b"]
    assert (c.skipped, c.truncated, c.tokens) == (1, True, 110)


def test_compact_drops_from_objects_only():
    assert envelope.compact({"a": None, "b": [None, {}], "c": {}, "d": 0}) == {"b": [None, {}], "d": 0}


@pytest.mark.parametrize(
    ("text", "part"),
    [
        ("", "cannot be empty"), ('file "a" | ', "empty pipeline segment"), ('file "a', "unterminated"), ("folder", "unsupported query source"), ('file "a" | .nope', "unsupported query step"),
        ('file "a" | .symbols(kind="x")', "does not know"), ('file "a" | .symbols(public_only=true, public_only=false)', "duplicate"), ('file "a" | .deps_transitive(x)', "non-negative integer"), ("let = file", "let bindings"),
    ],
)
def test_query_errors(text, part):
    with pytest.raises(dsl.QueryError, match=part):
        dsl.parse(text)


def test_query_parse_and_kinds():
    q = dsl.parse('let x = file "a|\\"b" | .deps_transitive(2) | unique | .symbols(public_only=true, kind="function") | count')
    assert q.binding == "x" and q.source == ("file", 'a|"b') and q.steps[0].depth == 2
    assert dsl.check("files", q.steps) == "number"
    with pytest.raises(dsl.QueryError, match="cannot be applied"):
        dsl.check("symbols", dsl.parse('symbol "a" | .deps').steps)


def test_names_and_candidates():
    assert tree.qualname("src/a/mod.rs", "f") == "a::f"
    assert tree.qualname("src/b.test.ts", "g") == "b::g"
    assert tree.rust_candidates("src/a.rs", "crate::b::{c, d}")[1][:2] == ["src/b.rs", "src/b/mod.rs"]
    assert tree.rust_candidates("src/a.rs", "serde::Serialize") == ("external", [], "serde")
    assert "src/x/index.ts" in tree.alias_targets("@/x", {"baseUrl": ".", "paths": {"@/*": ["src/*"]}})
    assert tree.commonjs_names("module.exports = {a, b: c}") == ["a", "b"]


# Expected messages of the pipe language and of the configuration.
QUERIES = {
    "": "query expression cannot be empty", 'file "a" | ': "query expression contains an empty pipeline segment", 'file "a': "query expression contains an unterminated quoted string",
    'file "a" | .deps_transitive(x)': "query step `.deps_transitive` expects an optional non-negative integer depth", "let = all-files": "let bindings must use `let <name> = <expr>`",
    'file "a" | .symbols(public_only=true, public_only=true)': "query step `.symbols` received duplicate `public_only` arguments", 'file "a|b" | .deps | unique | count': "ok",
    'symbol "a" | .deps': "query step `.deps` cannot be applied to symbols", 'file "a" | .callers': "query step `.callers` cannot be applied to files", "all-files | count | .deps": "query step `.deps` cannot be applied to number",
    "all-files | count | unique | count": "ok", 'symbol "a" | .callers | .deps': "ok", "all-symbols | .symbols": "query step `.symbols` cannot be applied to symbols",
}
CONFIGS = {
    '[[layer]]\nname = "a"\npattern = "x"\n[[layer]]\nname = "a"\npattern = "y"': "duplicate layer name: a", '[[layer]]\nname = "a"\npattern = "x"\n[[rule]]\nfrom = "a"\nmay_not_import = ["b"]': "rule names an unknown layer: b",
    '[[gate]]\nmetric = "cycles"': "gate cycles has no bound", '[[gate]]\nmetric = "speed"\nmax = 1.0': "unknown gate metric: speed", '[[gate]]\nmetric = "cycles"\nmin = 2.0\nmax = 1.0': "gate cycles has min above max",
    '[[capability]]\nname = "c"': "capability c needs a pattern or symbols", '[[layer]]\nname = "a"\npattern = "x[y"': "not a path pattern: 'x[y'", '[[entry_point]]\npattern = "src/**"': "ok",
}


@pytest.mark.parametrize(("text", "outcome"), QUERIES.items())
def test_messages_of_the_pipe_language(text, outcome):
    kinds = {"file": "files", "all-files": "files", "symbol": "symbols", "all-symbols": "symbols"}
    try:
        q = dsl.parse(text)
        dsl.check(kinds[q.source[0]], q.steps)
        assert outcome == "ok"
    except dsl.QueryError as e:
        assert str(e) == outcome


@pytest.mark.parametrize(("text", "outcome"), CONFIGS.items())
def test_messages_of_the_configuration(text, outcome):
    try:
        parse_config(text)
        assert outcome == "ok"
    except ValueError as e:
        assert str(e) == outcome
