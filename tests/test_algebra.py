"""Filters, orders, set operations and modifiers of the pipe language, against a search in plain Python on a random graph."""

import random
from collections import defaultdict

import pytest

from cartograph.lang import algebra, dsl
from cartograph.lang.dsl import QueryError, Session
from cartograph.lang.text import segments
from cartograph.schema import CHURN, FILE_EDGES, FILES, IMPORTS, SYMBOL_EDGES, SYMBOLS
from cartograph.sources.dataset import Graph

N = 24
NAMES = [f"{'src' if i % 3 else 'lib'}/f{i:02d}.rs" for i in range(N)]


def random_edges():
    r = random.Random(7)
    return sorted({(r.choice(NAMES), r.choice(NAMES)) for _ in range(38)})


EDGES = random_edges()


@pytest.fixture(scope="module")
def s(spark):
    r = random.Random(8)
    files = spark.createDataFrame([(p, "rust", "ok", False, 0, "", 1000, 100) for p in NAMES], FILES)
    edges = spark.createDataFrame([(a, b, "import", "exact") for a, b in EDGES], FILE_EDGES)
    symbols = spark.createDataFrame([(p, "f", f"{p}::f", "function" if i % 4 else "struct", "public" if i % 2 else "local", i % 2 == 1, 0, 0, 1, 1) for i, p in enumerate(NAMES)], SYMBOLS)
    calls = [(a, f"{a}::f", b, f"{b}::f", r.choice(("exact", "resolved", "heuristic", "dynamic")), i) for i, (a, b) in enumerate(EDGES)]
    session = Session(Graph(files, spark.createDataFrame([], IMPORTS), edges, symbols, spark.createDataFrame(calls, SYMBOL_EDGES), spark.createDataFrame([], CHURN)), now=2000)
    session.calls = calls
    return session


def hops(start, pairs=EDGES):
    """Least hops from a start to all that it reaches."""
    after, found, level, d = defaultdict(list), {start: 0}, [start], 0
    for a, b in pairs:
        after[a].append(b)
    while level:
        d += 1
        level = [b for b in dict.fromkeys(b for a in level for b in after[a]) if b not in found]
        found |= dict.fromkeys(level, d)
    return {n: d for n, d in found.items() if d}


START = max(NAMES, key=lambda n: (len(hops(n)), n))


def paths(s, text, *more):
    value = s.run(text)
    for m in more:
        value = s.run(m)
    return [r["path"] for r in value.df.orderBy("ord").collect()]


def test_distance_filters_bound_the_search(s):
    far = hops(START)
    assert max(far.values()) > 3
    for op in ("=", "<=", ">"):  # bounded and kept, bounded, not bounded
        holds = algebra.COMPARE[op]
        got = s.run(f'file "{START}" | .deps_transitive | filter distance {op} 2').df
        assert {(r["path"], r["distance"]) for r in got.collect()} == {(n, d) for n, d in far.items() if holds(d, 2)}
    assert paths(s, f'file "{START}" | .deps_transitive | filter distance < 0') == []
    assert s.run(f'file "{START}" | .deps | filter distance = 1 | count').df.first()[0] == sum(d == 1 or n == START for n, d in far.items() if (START, n) in EDGES)


def test_rewriting_moves_bounds_over_filters_only():
    def steps(text):
        return algebra.rewrite(dsl.parse('file "a" | ' + text).steps)

    assert [(x.name, x.depth) for x in steps('.deps_transitive | filter file matches "x" | sort-by distance | filter distance <= 3')][0] == ("deps", 3)
    assert steps(".deps_transitive(2) | filter distance <= 3")[0].depth == 2
    assert steps(".deps_transitive | minus (all-files) | filter distance < 3")[0].depth == 2
    assert steps(".deps_transitive | unique | filter distance <= 3")[0].depth is None
    assert steps(".deps_transitive | union (all-files) | filter distance <= 3")[0].depth is None
    assert steps(".deps_transitive | filter distance >= 3")[0].depth is None
    one = steps(".transitive | .depth 3 | .depth 2 | .reverse | count")
    assert [(x.name, x.transitive, x.depth, x.keep) for x in one] == [("reverse", True, 2, False), ("count", False, None, False)]
    first, second = steps(".deps | .reverse_transitive | filter distance > 1")[:2]
    assert (first.keep, second.keep) == (False, True)


def test_a_filter_after_unique_sees_what_unique_kept(s):
    """The first of equal files may be a far one, so the bound must not go into the search."""
    text = f'file "{START}" | .deps | .deps_transitive'
    kept = s.run(text + " | unique | filter distance <= 1").df
    want = {}
    for near in sorted(b for a, b in EDGES if a == START):
        for n, d in sorted(hops(near).items(), key=lambda x: (x[1], x[0])):
            want.setdefault(n, d)
    assert {r["path"] for r in kept.collect()} == {n for n, d in want.items() if d <= 1}


def test_set_operations(s):
    far, near = hops(START), {b for a, b in EDGES if a == START}
    back = hops(START, [(b, a) for a, b in EDGES])
    s.run(f'let near = file "{START}" | .deps')
    assert sorted(paths(s, f'file "{START}" | .deps_transitive | minus $near')) == sorted(set(far) - near)
    assert sorted(paths(s, f'file "{START}" | .deps_transitive | intersect (file "{START}" | .reverse_transitive)')) == sorted(set(far) & set(back))
    left = [n for n, _ in sorted(far.items(), key=lambda x: (x[1], x[0]))]
    right = [n for n, _ in sorted(back.items(), key=lambda x: (x[1], x[0]))]
    assert paths(s, f'file "{START}" | .deps_transitive | union (file "{START}" | .reverse_transitive)') == list(dict.fromkeys(left + right))
    assert paths(s, "$near | minus $near") == [] and paths(s, "$near | union $near") == sorted(near)
    nested = f'all-files | minus (file "{START}" | .deps_transitive | union (file "{START}" | .reverse_transitive | minus $near))'
    assert sorted(paths(s, nested)) == sorted(set(NAMES) - set(far) - (set(back) - near))


def test_names_give_their_distance_when_a_later_step_reads_it(s):
    far, near = hops(START), sorted(b for a, b in EDGES if a == START)
    s.run(f'let wide = file "{START}" | .depth 9 | .deps')
    assert "distance" not in s.names["wide"].df.columns
    assert sorted(paths(s, "$wide | filter distance = 2")) == sorted(n for n, d in far.items() if d == 2)
    s.run("let narrow = $wide | filter distance <= 2")
    s.run("let wide = all-files")  # what was defined by the old one stays
    assert sorted(paths(s, "$narrow | filter distance > 1")) == sorted(n for n, d in far.items() if d == 2)
    got = s.run(f'file "{START}" | .deps | union $narrow | sort-by distance').df.orderBy("ord").collect()
    assert [(r["path"], r["distance"]) for r in got] == [(n, 1) for n in near] + [(n, 2) for n in sorted(n for n, d in far.items() if d == 2 and n not in near)]


def test_filters_of_symbols_and_calls(s):
    target = max(NAMES, key=lambda n: sum(c[2] == n for c in s.calls))
    order = ("exact", "resolved", "heuristic", "dynamic")
    for op, worst in ((">=", 1), ("=", 2), ("<", 1), ("!=", 0)):
        got = s.run(f'symbol "{target}::f" | .callers | filter certainty {op} {order[worst]}').df
        want = [c[0] for c in s.calls if c[2] == target and algebra.COMPARE[op](-order.index(c[4]), -worst)]
        assert sorted(r["path"] for r in got.collect()) == sorted(want)
    publics = {p for i, p in enumerate(NAMES) if i % 2}
    assert set(paths(s, "all-symbols | filter visibility = public")) == publics
    assert set(paths(s, "all-symbols | filter visibility != public")) == set(NAMES) - publics
    assert set(paths(s, "all-symbols | filter visibility = local | filter kind != struct")) == {p for i, p in enumerate(NAMES) if i % 2 == 0 and i % 4}
    assert set(paths(s, 'all-symbols | filter file matches "lib/**"')) == {p for p in NAMES if p.startswith("lib/")}
    callers = {c[0] for c in s.calls if c[2] == target}
    assert set(paths(s, f'all-symbols | intersect (symbol "{target}::f" | .callers)')) == callers
    depth = s.run(f'symbol "{target}::f" | .depth 2 | .callers | unique').df.agg({"distance": "max"}).first()[0]
    assert depth == (2 if any(c[2] in callers for c in s.calls) else 1)


def test_order_by_risk(s):
    scores = {r["path"]: (r["score"], r["normalized_score"]) for r in s.risk().collect()}
    assert paths(s, "all-files | sort-by risk") == sorted(NAMES, key=lambda n: (-round(scores[n][0], 6), n))
    assert paths(s, "all-files | filter risk > 40") == [n for n in sorted(NAMES) if scores[n][1] > 40]
    assert 0 < len(paths(s, "all-files | filter risk > 40")) < N


@pytest.mark.parametrize(
    ("text", "part"),
    [
        ("all-files | filter", "unsupported query step"), ("all-files | filter size > 3", "malformed filter"), ("all-files | filter file = x", "malformed filter"), ("all-files | filter risk > x", "non-negative number"),
        ("all-symbols | filter kind > enum", "= or != only"), ("all-symbols | filter kind = thing", "does not know"), ("all-files | sort-by size", "does not know"), ("all-files | .depth x", "non-negative integer"),
        ("all-files | filter distance < 2", "needs a traversal before it"), ("all-files | .depth 2 | .symbols", "needs a traversal after it"), ("all-files | .transitive", "needs a traversal after it"),
        ("all-files | union all-symbols", "cannot combine files with symbols"), ("all-files | minus (all-files | count)", "cannot combine files with number"), ("all-files | union (let x = all-files)", "cannot stand in parentheses"),
        ("all-files | union (all-files | unique", "unclosed parenthesis"), ("all-files | minus $unknown", "unknown binding"), ("all-symbols | filter risk > 1", "cannot be applied to symbols"), ("all-files | .deps | union (all-files) | filter distance < 2", "needs a traversal"),
    ],
)
def test_errors(s, text, part):
    names = dict(s.names)
    with pytest.raises(QueryError, match=part):
        s.run("let broken = " + text)
    assert s.names == names


def test_pipes_inside_parentheses_and_quotes():
    assert segments('file "a|(b" | union (file ")|" | .deps | minus ($x | unique)) | count') == ['file "a|(b"', 'union (file ")|" | .deps | minus ($x | unique))', "count"]
