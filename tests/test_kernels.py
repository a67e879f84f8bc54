import random

import pytest

from pyspark.sql import functions as F

from cartograph.plans import kernels


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def seeds(spark, *names):
    return spark.createDataFrame([(n, n) for n in names], "seed string, node string")


def plain_bfs(pairs, start):
    out, level = {start: 0}, [start]
    while level:
        nxt = sorted({b for a, b in pairs for x in level if a == x} - set(out))
        out |= {n: out[level[0]] + 1 for n in nxt}
        level = nxt
    return out


def random_pairs(n, m, seed):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(n):02d}", f"n{rng.randrange(n):02d}") for _ in range(m)})


def test_bfs_against_plain_search(spark):
    pairs = random_pairs(25, 45, 1)
    got = kernels.bfs(graph(spark, pairs), seeds(spark, "n00", "n05")).collect()
    for s in ("n00", "n05"):
        assert {r["node"]: r["distance"] for r in got if r["seed"] == s} == plain_bfs(pairs, s)


def test_bfs_depth_and_rank(spark):
    e = spark.createDataFrame([("a", "b", 0), ("b", "d", 2), ("a", "c", 1), ("c", "d", 1)], "src string, dst string, rank int")
    got = {r["node"]: (r["distance"], r["rank"]) for r in kernels.bfs(e, seeds(spark, "a")).collect()}
    assert got == {"a": (0, 0), "b": (1, 0), "c": (1, 1), "d": (2, 1)}
    assert {r["node"] for r in kernels.bfs(e, seeds(spark, "a"), 1).collect()} == {"a", "b", "c"}
    assert {r["node"] for r in kernels.bfs(e, seeds(spark, "a"), 0).collect()} == {"a"}


def test_emit_edges_repeats_the_start_of_a_cycle(spark):
    e = graph(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    got = sorted((r["dst"], r["distance"]) for r in kernels.emit_edges(e, seeds(spark, "a"), 8).collect())
    assert got == [("a", 3), ("b", 1), ("c", 2)]
    assert kernels.emit_edges(e, seeds(spark, "a"), 0).count() == 0


def test_closure_and_scc_against_plain_search(spark):
    pairs = random_pairs(18, 26, 3)
    names = sorted({x for p in pairs for x in p})
    after = {n: {m for b in {b for a, b in pairs if a == n} for m in plain_bfs(pairs, b)} for n in names}
    got = {(r["src"], r["dst"]) for r in kernels.closure(graph(spark, pairs)).collect()}
    assert got == {(a, b) for a in names for b in after[a]}
    groups = {frozenset(m for m in names if m in after[n] and n in after[m]) for n in names}
    found = {}
    for r in kernels.scc(graph(spark, pairs)).collect():
        found.setdefault(r["component"], set()).add(r["node"])
    assert {frozenset(v) for v in found.values()} == {g for g in groups if len(g) > 1}
    assert all(k == min(v) for k, v in found.items())


def test_tree_parents_follow_visiting_order(spark):
    e = graph(spark, [("a", "c"), ("a", "b"), ("b", "d"), ("c", "d"), ("d", "a")])
    tree = kernels.bfs_tree(e, "a")
    got = {r["node"]: (r["parent"], r["distance"]) for r in tree.collect()}
    assert got == {"b": ("a", 1), "c": ("a", 1), "d": ("b", 2)}
    ways = {r["target"]: r["trail"] for r in kernels.trails(tree, tree.select(F.col("node").alias("target"))).collect()}
    assert ways == {"b": ["a", "b"], "c": ["a", "c"], "d": ["a", "b", "d"]}


def plain_tree(pairs, start):
    """First trails in the order of a queue with children by name."""
    trail, queue = {start: [start]}, [start]
    for x in queue:
        for b in sorted({b for a, b in pairs if a == x}):
            if b not in trail:
                trail[b] = [*trail[x], b]
                queue.append(b)
    return trail, queue


@pytest.mark.parametrize("seed", [4, 5])
def test_trails_and_visiting_order_of_a_long_graph(spark, seed):
    pairs = random_pairs(60, 75, seed) + [(f"n{i:02d}", f"n{i + 1:02d}") for i in range(0, 50, 2)]
    want, queue = plain_tree(pairs, "n00")
    tree = kernels.bfs_tree(graph(spark, pairs), "n00")
    rows = tree.collect()
    assert [r["node"] for r in sorted(rows, key=lambda r: (r["distance"], r["place"]))] == queue[1:]
    ways = {r["target"]: r["trail"] for r in kernels.trails(tree, tree.select(F.col("node").alias("target"))).collect()}
    assert ways == {k: v for k, v in want.items() if k != "n00"} and max(map(len, ways.values())) > 5


def test_next_steps_to_the_nearest_goal(spark):
    pairs = random_pairs(40, 70, 6)
    rank = {p: i % 4 for i, p in enumerate(pairs)}
    e = spark.createDataFrame([(a, b, rank[a, b]) for a, b in pairs], "src string, dst string, rank int")
    goals = ["n03", "n17"]
    found = kernels.nearest(e, spark.createDataFrame([(x,) for x in goals], "node string"))
    got = {r["node"]: r for r in found.collect()}
    ways = {r["target"]: [x["node"] for x in sorted(r["s"])] for r in kernels.paths(found.where("next is not null").select("node", F.col("next").alias("parent")), found.select(F.col("node").alias("target"))).groupBy("target").agg(F.collect_list(F.struct("up", "node")).alias("s")).collect()}
    for start in sorted({x for p in pairs for x in p}):
        trail, _ = plain_tree(pairs, start)
        first = next(([*trail[g]] for g in plain_tree(pairs, start)[1] if g in goals), None)
        if first is None:
            assert start not in got
            continue
        assert (ways[start], got[start]["distance"]) == (first, len(first) - 1)
        assert got[start]["rank"] == max([rank[p] for p in zip(first, first[1:])], default=0)


@pytest.mark.parametrize("words", [1, 1 << 16])
def test_reach_counts_by_masks(spark, words):
    pairs = random_pairs(99, 130, 7) + [(f"chain{i:03d}", f"chain{i + 1:03d}") for i in range(80)]
    names = {x for p in pairs for x in p}
    after = {a: {m for b in {y for x, y in pairs if x == a} for m in plain_bfs(pairs, b)} for a in names}
    got = {r["node"]: r["reached"] for r in kernels.reach_counts(graph(spark, pairs), words).collect()}
    assert got == {a: len(s) for a, s in after.items() if s}
    assert kernels.reach_counts(graph(spark, pairs).limit(0)).count() == 0


@pytest.mark.parametrize("part", [3, 20, 100_000])
def test_components_of_small_and_large_parts(spark, part):
    pairs = [(f"{tag}{a}", f"{tag}{b}") for tag, n, m in (("x", 18, 26), ("y", 14, 22), ("z", 4, 5)) for a, b in random_pairs(n, m, 8)]
    after = {a: {m for b in {y for x, y in pairs if x == a} for m in plain_bfs(pairs, b)} for a, _ in pairs}
    want = {n: min(same) for n in after if len(same := {m for m in after[n] if n in after.get(m, ())}) > 1}
    assert want and {r["node"]: r["component"] for r in kernels.scc(graph(spark, pairs), part).collect()} == want
    assert dict(kernels.strong(pairs)) == want


def test_small_parts_are_searched_without_colouring(spark, monkeypatch):
    calls, plain = [], kernels.spread
    monkeypatch.setattr(kernels, "spread", lambda *a, **k: calls.append(1) or plain(*a, **k))
    chain = [(f"c{i:02d}{end}", f"c{i + j:02d}{far}") for i in range(6) for end, far, j in (("a", "b", 0), ("b", "a", 0), ("b", "a", 1))]
    assert kernels.scc(graph(spark, chain)).count() == 12  # six pairs in a row: six rounds of colours before
    assert len(calls) == 1


def test_ends_without_edges_stay_out_of_the_hops(spark, monkeypatch):
    passed, plain = set(), kernels.spool

    def noted(df, *by):
        out = plain(df, *by)
        if out.columns == ["node", "word", "mask"]:
            passed.update(r["node"] for r in out.collect())
        return out

    monkeypatch.setattr(kernels, "spool", noted)
    pairs = [(f"p{i}", f"o{i % 3}") for i in range(40)] + [("o0", "o1"), ("o1", "o2"), ("o2", "q")]
    got = {r["node"]: r["reached"] for r in kernels.reach_counts(graph(spark, pairs)).collect()}
    assert got == {"o0": 3, "o1": 2, "o2": 1} | {f"p{i}": 4 - i % 3 for i in range(40)}
    assert passed == {"o0", "o1", "o2"}


@pytest.mark.parametrize("part", [2, 100])
def test_closure_with_ends_without_edges(spark, monkeypatch, part):
    doubled, plain = [], kernels._doubled
    monkeypatch.setattr(kernels, "_doubled", lambda e: doubled.append(1) or plain(e))
    pairs = [(f"o{i % 3}", f"p{i}") for i in range(9)] + [("o0", "o1"), ("o1", "o2"), ("o2", "o1")]
    want = {(a, m) for a, _ in pairs for b in {y for x, y in pairs if x == a} for m in plain_bfs(pairs, b)}
    found = kernels.closure(graph(spark, pairs), part).collect()
    assert {(r["src"], r["dst"]) for r in found} == want and len(found) == len(want)
    assert len(doubled) == (part == 2)  # small parts were doubled before


def test_searches_write_edges_without_a_shuffle(spark, monkeypatch):
    plans, plain = [], kernels.by_source
    monkeypatch.setattr(kernels, "by_source", lambda e: plans.append(e._jdf.queryExecution().executedPlan().toString()) or plain(e))
    pairs = [("a", "b"), ("a", "b"), ("b", "c"), ("b", "c"), ("a", "d")]
    assert {r["node"]: r["parent"] for r in kernels.bfs_tree(graph(spark, pairs), "a").collect()} == {"b": "a", "c": "b", "d": "a"}
    assert sorted((r["node"], r["distance"]) for r in kernels.bfs(graph(spark, pairs), seeds(spark, "a")).collect()) == [("a", 0), ("b", 1), ("c", 2), ("d", 1)]
    assert len(plans) == 2 and not any("Exchange" in p for p in plans)


def test_shallow_searches_write_no_edges(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2, 1), (2, 3, 0), (1, 3, 2), (3, 4, 0), (4, 1, 0), (1, 2, 0)], "src int, dst int, rank int")
    seeds = spark.createDataFrame([(1, 1), (3, 3)], "seed int, node int")
    found = lambda: sorted(tuple(r) for r in kernels.bfs(edges, seeds, 2).select("seed", "node", "distance", "rank").collect())
    want = [(1, 1, 0, 0), (1, 2, 1, 0), (1, 3, 1, 2), (1, 4, 2, 2), (3, 1, 2, 0), (3, 3, 0, 0), (3, 4, 1, 0)]
    monkeypatch.setattr(kernels, "FEW", 1)
    assert found() == want
    monkeypatch.setattr(kernels, "FEW", 100)
    monkeypatch.setattr(kernels, "by_source", None)
    assert found() == want
