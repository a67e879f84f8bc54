"""Operators over many targets, files or batches at once: budgets, co-change pairs, file renames, a watched index."""

import random
from collections import defaultdict
from itertools import combinations

import pytest
from test_published import small_rust

from cartograph.operators import context, metrics, rename
from cartograph.sources import index, tree
from cartograph.streaming import watch


@pytest.mark.parametrize("budget", [None, 0, 60, 150])
def test_budgets_of_many_targets_fold_like_one(spark, budget):
    rng = random.Random(4)
    rows = []
    for t in range(25):
        rows += [(f"t{t}", f"f{i:02d}", rng.choice([200, 120, 60, 60, 30]), rng.randrange(3), i == 0, rng.randrange(1, 40)) for i in range(rng.randrange(1, 20))]
    df = spark.createDataFrame(rows, "target string, path string, score int, distance int, pinned boolean, estimated_tokens int").repartition(3)
    got = defaultdict(list)
    for r in sorted(context.chosen(df, budget).collect(), key=lambda r: (r["target"], r["place"])):
        got[r["target"]].append(r)
    for t in {r[0] for r in rows}:
        own = [dict(zip(("path", "score", "distance", "pinned", "estimated_tokens"), r[1:], strict=True)) for r in rows if r[0] == t]
        c = context.choose(own, budget)
        assert [r["path"] for r in got[t] if r["verdict"] == "must"] == [r["path"] for r in c.must_read]
        assert [r["path"] for r in got[t] if r["verdict"] in ("should", "demoted")] == [r["path"] for r in c.should_read]
        assert sum(r["verdict"] == "skipped" for r in got[t]) == c.skipped and {r["tokens"] for r in got[t]} == {c.tokens}


@pytest.mark.parametrize("change", ["signature", "body", "side-effect"])
def test_candidates_of_many_targets_are_those_of_each(spark, change):
    g = small_rust(spark)
    names = ["parser::parse", "parser::tokenize", "utils::format_output"]
    targets = g.symbols.where(g.symbols["qualname"].isin(names)).selectExpr("qualname as target", "path", "qualname")
    got = defaultdict(set)
    columns = ["path", "score", "distance", "certainty", "pinned", "roles", "reasons", "estimated_tokens"]
    for r in context.candidates_of(g, targets, change).collect():
        got[r["target"]].add(str([r[c] for c in columns]))
    for n in names:
        assert got[n] == {str([r[c] for c in columns]) for r in context.candidates(g, n, change).collect()}


@pytest.mark.parametrize(("large", "least"), [(3, 2), (3, 3), (100, 2)])
def test_frequent_pairs_with_large_commits(spark, large, least):
    rng = random.Random(large + least)
    commits = {f"c{i}": rng.sample(range(25), rng.choice([1, 2, 3, 3, 8, 20])) for i in range(30)}
    rows = [(f"f{x:02d}", c, "a", 100) for c, xs in commits.items() for x in xs] + [("f00", "old", "a", 1), ("f01", "old", "a", 1)]
    times, pairs = defaultdict(int), defaultdict(int)
    for xs in commits.values():
        for x in xs:
            times[x] += 1
        for a, b in combinations(sorted(xs), 2):
            pairs[a, b] += 1
    want = {(f"f{a:02d}", f"f{b:02d}", n, round(n / min(times[a], times[b]), 9)) for (a, b), n in pairs.items() if n >= least}
    churn = spark.createDataFrame(rows + rows[:5], "path string, commit_sha string, author_email string, committed_at long")
    got = metrics.frequent_pairs(churn, 86400 * 90 + 50, 90, least, large).collect()
    assert {(r["path"], r["other"], r["shared_commits"], round(r["score"], 9)) for r in got} == want and len(got) == len(want)


def test_renaming_a_file_edits_its_importers(spark):
    g = small_rust(spark)
    plan = rename.rename_files(g.imports, spark.createDataFrame([("src/parser.rs", "parser2"), ("src/utils.rs", "helpers")], "target string, new_name string"))
    assert [tuple(r) for r in plan.collect()] == [("src/parser.rs", "src/resolver.rs", "importer", "import path resolves to target file src/parser.rs", "exact", 1, 11, 17, "parser", "parser2", True)]
    text = "use crate::parser;\n\npub fn résolve() {}\n"
    out = rename.apply_edits(spark.createDataFrame([("src/resolver.rs", text), ("src/lib.rs", "x")], "path string, text string"), plan).collect()
    assert [tuple(r) for r in out] == [("src/resolver.rs", text.replace("parser", "parser2"))]
    with pytest.raises(Exception, match="has changed"):
        rename.apply_edits(spark.createDataFrame([("src/resolver.rs", "use crate::other!;")], "path string, text string"), plan).collect()
    with pytest.raises(Exception, match="not an identifier"):
        rename.rename_files(g.imports, spark.createDataFrame([("src/parser.rs", "a-b")], "target string, new_name string")).collect()


def test_many_edits_a_line_in_many_files(spark):
    rng = random.Random(2)
    texts, edits, want = [], [], {}
    for f in range(30):
        words = [rng.choice(["été", "naïve", "x", "日本", "plain"]) for _ in range(30)]
        new, at = list(words), 0
        for i, w in enumerate(words):
            size = len(w.encode())
            if rng.random() < 0.4:
                new[i] = rng.choice(["", "ß", "longer name"])
                edits += [(f"f{f}", at, at + size, w, new[i], True)] * rng.randrange(1, 3)
            at += size + 1
        edits.append((f"f{f}", 0, 1, "nothing", "like it", False))  # deferred
        texts.append((f"f{f}", " ".join(words)))
        if new != words:
            want[f"f{f}"] = " ".join(new)
    got = rename.apply_edits(spark.createDataFrame(texts, "path string, text string"), spark.createDataFrame(edits, "path string, start_byte int, end_byte int, before_text string, after_text string, apply_safe boolean"))
    assert {r["path"]: r["text"] for r in got.collect()} == want
    both = spark.createDataFrame([("f0", 0, 2, "ab", "", True), ("f0", 1, 3, "bc", "", True)], "path string, start_byte int, end_byte int, before_text string, after_text string, apply_safe boolean")
    with pytest.raises(Exception, match="overlap"):
        rename.apply_edits(spark.createDataFrame([("f0", "abcd")], "path string, text string"), both).collect()


def test_a_watched_index_equals_a_full_one(spark, tmp_path):
    texts = {f"src/m{i}.rs": f"use crate::m{i + 1}::run;\npub fn run() {{\n    m{i + 1}::run();\n}}\n" for i in range(12)}

    def write(n, changed, deleted=()):
        rows = [(p, "rust", texts[p], n, len(texts[p]), str(hash(texts[p])), False, n) for p in changed] + [(p, None, None, None, None, None, True, n) for p in deleted]
        spark.createDataFrame(rows, watch.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")

    one = index.Index(spark, f"{tmp_path}/one")
    follow = lambda: watch.watch(watch.events(spark, f"{tmp_path}/events"), one, f"{tmp_path}/state").awaitTermination()
    write(1, texts)
    follow()
    for p in ("src/m3.rs", "src/m7.rs"):
        texts[p] += "pub fn more() {}\n"
    texts["src/m12.rs"] = "pub fn run() {}\n"  # until now m11 asked for it in vain
    write(2, ["src/m3.rs", "src/m12.rs"])
    del texts["src/m5.rs"]
    write(3, ["src/m7.rs"], ["src/m5.rs"])
    follow()  # a new query over the same state
    assert one.pointer()["batch"] == 2 and one.version() == 3
    batch = spark.createDataFrame([("src/m7.rs", "rust", "// other\n", 9, 9, "z", False, 9)], watch.EVENTS)
    assert one.update(watch.latest(batch), 2) == {"changed_files": 0, "deleted_files": 0} and one.version() == 3  # run again after a failure
    two = index.Index(spark, f"{tmp_path}/two")
    two.run(spark.createDataFrame([(p, "rust", t, 0, len(t), str(hash(t))) for p, t in texts.items()], "path string, language string, text string, mtime long, size_bytes long, content_hash string"))
    a, b = one.load(), two.load()
    for t in ("files", "imports", "file_edges", "symbols", "symbol_edges"):
        x, y = (sorted((tuple(r) for r in getattr(g, t).drop("mtime").select(*sorted(set(getattr(b, t).columns) - {"mtime"})).collect()), key=str) for g in (a, b))
        assert x == y, t
    assert a.symbol_edges.where("src = 'm11::run' and dst = 'm12::run'").count() == 1 and tree.EXTENSIONS["rs"] == "rust"
