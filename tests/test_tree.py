"""A small Rust and a small script tree, written here, through scan, extraction, resolution and queries."""

import random

import pytest

from cartograph.lang.dsl import QueryError, Session
from cartograph.operators import context, direct, rename
from cartograph.sources import git, index, snapshots, tree

RUST = {
    "src/lib.rs": "pub mod parse;\npub mod fmt;\nuse crate::parse::run;\n\npub fn greet(x: &str) -> String {\n    let t = run(x);\n    fmt::show(t) // calls nothing(here)\n}\n",
    "src/parse.rs": "pub fn run(x: &str) -> u32 {\n    split(x);\n    println!(\"{}\", x);\n    x.len()\n}\n\nfn split(x: &str) -> u32 {\n    0\n}\n",
    "src/fmt.rs": "pub struct Opts;\npub fn show(x: u32) -> String {\n    String::new()\n}\n",
    "web/index.ts": "import { a } from './util';\nexport const main = () => {\n  a(1);\n};\nconst x = require(name);\n",
    "web/util.ts": "export function a(n) {\n  return n;\n}\nexport { b as c } from './other';\n",
    "web/other.ts": "export function b() {}\n",
    "web/.hidden.ts": "export function no() {}\n",
    "skipped/gone.ts": "export function no() {}\n",
    ".gitignore": "skipped/\n",
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("tree")
    for name, text in RUST.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_text(text)
    return top


@pytest.fixture(scope="module")
def g(spark, root):
    return tree.build(tree.scan(spark, str(root)), {})


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_graph(g):
    assert rows(g.files, "path") == [("src/fmt.rs",), ("src/lib.rs",), ("src/parse.rs",), ("web/index.ts",), ("web/other.ts",), ("web/util.ts",)]
    assert rows(g.files.where("parse_status = 'partial'"), "path") == [("web/index.ts",)]
    assert rows(g.file_edges, "src", "dst", "kind") == [
        ("src/lib.rs", "src/fmt.rs", "module"), ("src/lib.rs", "src/parse.rs", "import"), ("src/lib.rs", "src/parse.rs", "module"), ("web/index.ts", "web/util.ts", "import"), ("web/util.ts", "web/other.ts", "import"),
    ]
    assert rows(g.symbol_edges, "src", "dst", "certainty", "call_line") == [
        ("lib::greet", "fmt::show", "resolved", 7), ("lib::greet", "parse::run", "resolved", 6), ("parse::run", "parse::split", "exact", 2), ("web::main", "web::util::a", "resolved", 3),
    ]
    assert ("web::util::c", True) in rows(g.symbols.where("path = 'web/util.ts'"), "qualname", "exported")


def test_queries_over_the_tree(g):
    s = Session(g)
    assert s.run('file "src/lib.rs" | .deps | unique | count').df.first()[0] == 2
    s.run('let l = file "src/lib.rs" | .deps | unique')
    assert rows(s.run('$l | .symbols(public_only=true, kind="function")').df, "qualname") == [("fmt::show",), ("parse::run",)]
    assert rows(s.run('symbol "parse::split" | .callers_transitive').df, "qualname", "distance") == [("lib::greet", 2), ("parse::run", 1)]
    assert s.run('file "src/lib.rs" | .deps | count | count').df.first()[0] == 1
    for bad in ('file "nope.rs"', 'symbol "nope"', "$nope"):
        with pytest.raises(QueryError):
            s.run(bad)
    got = direct.deps(g.file_edges, g.imports, "src/lib.rs").collect()
    assert {(r["path"], r["edge_kind"], r["line"]) for r in got} == {("src/fmt.rs", "module", None), ("src/parse.rs", "import", 3), ("src/parse.rs", "module", 3)}


def test_context_pack_and_rename(g, spark, root):
    c = context.context(g, "parse::run")
    assert c.must_read[0]["path"] == "src/parse.rs" and c.must_read[0]["roles"][:2] == ["target", "defines_target_symbol"]
    assert "lib::greet (src/lib.rs)" in context.pack(g, "parse::run")
    texts = tree.scan(spark, str(root)).select("path", "text")
    plan = [r.asDict() for r in rename.rename_plan(g, texts, "parse::run", "parse_all").collect()]
    assert sorted((r["path"], r["line"], r["apply_safe"]) for r in plan) == [("src/lib.rs", 3, True), ("src/lib.rs", 6, False), ("src/parse.rs", 1, True)]
    with pytest.raises(ValueError, match="deferred"):
        rename.apply_plan(str(root), plan)
    assert rename.apply_plan(str(root), plan, force=True) == 2
    assert (root / "src/parse.rs").read_text().startswith("pub fn parse_all(x")


def test_snapshots(g, spark, tmp_path):
    s = snapshots.Snapshots(spark, str(tmp_path / "snaps"))
    assert s.list().count() == 0
    s.save(g, "one", 10)
    s.save(g, "two", 20)
    assert [r["name"] for r in s.list().collect()] == ["two", "one"]
    assert s.load("one").files.count() == 6
    assert s.delete("one") and [r["name"] for r in s.list().collect()] == ["two"]
    with pytest.raises(ValueError):
        s.save(g, "", 1)


def test_git_log(spark, g):
    log = ["", "a" * 40 + "|x@y|100\n\nsrc/lib.rs\nsrc/fmt.rs\n", "b" * 40 + "|z@y|200\n\nsrc/lib.rs\nother.md\n"]
    got = git.parse_log(spark.createDataFrame([(x,) for x in log], "record string"), g.files)
    assert rows(got, "path", "committed_at") == [("src/fmt.rs", 100), ("src/lib.rs", 100), ("src/lib.rs", 200)]


def test_ignore_rules(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / ".gitignore").write_text("*.log.ts\n/top.ts\nbuild/\n# a comment\n!keep.log.ts\n")
    (tmp_path / "a/.ignore").write_text("inner.ts\nb/**/deep.ts\n!/b/x.log.ts\n")
    paths = ["x.log.ts", "keep.log.ts", "top.ts", "a/top.ts", "build/keep.log.ts", "a/build/y.ts", "a/inner.ts", "a/b/inner.ts", "inner.ts", "a/b/c/deep.ts", "a/b/deep.ts", "a/b/x.log.ts", "a/z.ts"]
    rules = [r for r in tree.ignore_rules(str(tmp_path))]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = {r["path"] for r in df.where(~tree.ignored(df["path"], rules)).collect()}
    assert kept == {"keep.log.ts", "a/top.ts", "inner.ts", "a/b/x.log.ts", "a/z.ts"}


def symbols(text):
    return {r["name"]: (r["kind"], r["exported"], r["line"]) for r in tree.parse_file("web/x.js", "typescript_javascript", text, {}) if r["record"] == "symbol"}


def test_barrels_and_commonjs_exports():
    barrel = lambda t: tree.parse_file("web/x.ts", "typescript_javascript", t, {})[-1]["exported"]
    assert barrel("// about\nexport { a } from './a';\n\nexport * from './b';\n") and not barrel("export { a } from './a';\nconst x = 1;\n")
    assert symbols("class Foo {\n}\nmodule.exports = { Foo, bar: baz };\n") == {"Foo": ("class", True, 1), "bar": ("function", True, 3)}
    assert symbols("exports.one = 1;\nmodule.exports.two = 2;\nmodule.exports = { ...rest };\n") == {"one": ("function", True, 1)}


def test_incremental_index_equals_a_full_one(spark, root, tmp_path):
    files = tree.scan(spark, str(root)).cache()
    edited = {"src/fmt.rs": "pub fn show(x: u32) -> String {\n    helper(x)\n}\nfn helper(x: u32) -> String {\n    String::new()\n}\n", "web/new.ts": "import { b } from './other';\nexport const n = () => {\n  b();\n};\n"}
    kept = files.where("path not in ('web/util.ts', 'src/fmt.rs')")
    fresh = spark.createDataFrame([(p, tree.EXTENSIONS[p.rsplit(".", 1)[-1]], t, 5, len(t), t) for p, t in edited.items()], kept.schema)
    second = kept.unionByName(fresh)
    one, two = index.Index(spark, str(tmp_path / "one")), index.Index(spark, str(tmp_path / "two"))
    assert one.run(files) == {"changed_files": 6, "deleted_files": 0, "affected_files": 6}
    assert one.run(files) == {"changed_files": 0, "deleted_files": 0, "affected_files": 0}
    # lib.rs depends on fmt.rs, index.ts on the deleted util.ts.
    assert one.run(second) == {"changed_files": 2, "deleted_files": 1, "affected_files": 4} and one.version() == 3
    two.run(second)
    for t in snapshots.TABLES:
        a, b = getattr(one.load(), t), getattr(two.load(), t)
        assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty(), t
    left = index.without(two.load(), spark.createDataFrame([("web/other.ts",)], "path string"))
    assert left.imports.where("path = 'web/new.ts' and resolved_path is null").count() == 1 and left.file_edges.where("dst = 'web/other.ts'").count() == 0


SYLLABLES = ["one", "two", "six", "ten"]


def random_tree(rng, n):
    """Rust and script files that import, re-export and call one another; some of what they name doesn't exist."""
    out = {}
    for i in range(n):
        if rng.random() < 0.5:
            lines = [f"pub mod m{rng.randrange(n)};" for _ in range(rng.randrange(2))]
            lines += [f"use crate::m{rng.randrange(n)}::{rng.choice(SYLLABLES)};" for _ in range(rng.randrange(3))]
            lines += [f"pub fn {x}(v: u32) -> u32 {{\n    {rng.choice(SYLLABLES)}(v);\n    m{rng.randrange(n)}::{rng.choice(SYLLABLES)}(v)\n}}" for x in rng.sample(SYLLABLES, rng.randrange(1, 4))]
            out[f"src/m{i}.rs"] = "\n".join(lines) + "\n"
        else:
            lines = [f"import {{ {rng.choice(SYLLABLES)} }} from './w{rng.randrange(n)}';" for _ in range(rng.randrange(3))]
            lines += [f"export {{ {rng.choice(SYLLABLES)} }} from './w{rng.randrange(n)}';" for _ in range(rng.randrange(2))]
            lines += [f"export function {x}(v) {{\n  {rng.choice(SYLLABLES)}(v);\n}}" for x in rng.sample(SYLLABLES, rng.randrange(1, 3))]
            out[f"web/w{i}.ts"] = "\n".join(lines) + "\n"
    return out


def test_chains_of_changes_equal_full_indexes(spark, tmp_path, monkeypatch):
    """Random changes, one version each, with a compaction among them; after each the tables are those of a new index, and few rows were written."""
    rng = random.Random(12)
    monkeypatch.setattr(index, "CHAIN", 3)
    schema = "path string, language string, text string, mtime long, size_bytes long, content_hash string"
    table = lambda texts, at: spark.createDataFrame([(p, tree.EXTENSIONS[p.rsplit(".", 1)[-1]], t, at, len(t), str(hash(t))) for p, t in sorted(texts.items())], schema)
    texts = random_tree(rng, 30)
    one = index.Index(spark, str(tmp_path / "one"))
    one.run(table(texts, 1))
    lengths = []
    for step in range(3):
        fresh = random_tree(rng, 30)
        for path in rng.sample(sorted(texts), 2):
            del texts[path]
        for path in rng.sample(sorted(set(fresh) | set(texts)), 3):
            texts[path] = fresh.get(path, texts.get(path, "") + "// more\n")
        stats = one.run(table(texts, 2 + step))
        lengths.append(len(one.pointer()["chain"]))
        assert stats["deleted_files"] >= 1 and stats["affected_files"] >= stats["changed_files"]
        two = index.Index(spark, str(tmp_path / f"full{step}"))
        two.run(table(texts, 2 + step))
        a, b = one.load(), two.load()
        for t in ("files", "imports", "file_edges", "symbols", "symbol_edges"):
            x, y = ([tuple(r) for r in getattr(g, t).select(*sorted(getattr(b, t).columns)).collect()] for g in (a, b))
            assert sorted(x, key=str) == sorted(y, key=str), (step, t)
    assert lengths == [2, 3, 1] and b.symbol_edges.count() > 10
    assert one.run(table(texts, 5), batch=4)["changed_files"] == 0 and one.run(table({}, 6), batch=4)["deleted_files"] == 0
    assert one.load().files.count() == len(texts)


def test_an_index_writes_what_changed(spark, tmp_path):
    texts = {f"src/m{i}.rs": f"use crate::m{i + 1}::run;\npub fn run(v: u32) -> u32 {{\n    m{i + 1}::run(v)\n}}\n" for i in range(60)}
    schema = "path string, language string, text string, mtime long, size_bytes long, content_hash string"
    table = lambda: spark.createDataFrame([(p, "rust", t, 1, len(t), t) for p, t in texts.items()], schema)
    one = index.Index(spark, str(tmp_path / "one"))
    one.run(table())
    texts["src/m30.rs"] += "pub fn more() {}\n"
    assert one.run(table())["affected_files"] == 31  # all before it depend on it, by steps
    last = one.pointer()["chain"][-1]
    n = {t: spark.read.parquet(f"{tmp_path}/one/v{last}/{t}").count() for t in ("files", "records", "imports", "symbols")}
    assert n["files"] == 1 and n["imports"] <= 5 and n["symbols"] == 2 and n["records"] <= 8


def test_a_run_of_the_index_leaves_no_scratch_tables(spark, tmp_path, monkeypatch):
    """Records and tables are written once, in the version; only texts, keys and paths are stored besides, and dropped."""
    made, dropped = {}, set()
    for module in (index, tree):
        monkeypatch.setattr(module, "spool", lambda df, f=module.spool: made.setdefault((out := f(df))._spool_path, out))
        monkeypatch.setattr(module, "drop_spool", lambda df, f=module.drop_spool: (dropped.add(getattr(df, "_spool_path", None)), f(df)))
    monkeypatch.setattr(index, "FILES_A_BUCKET", 3)
    schema = "path string, language string, text string, mtime long, size_bytes long, content_hash string"
    texts = {f"src/m{i}.rs": f"use crate::m{i + 1}::run;\npub fn run() {{\n    help();\n    run{i}();\n}}\nfn help() {{\n}}\n" for i in range(9)}
    one = index.Index(spark, str(tmp_path / "one"))
    assert one.run(spark.createDataFrame([(p, "rust", t, 1, len(t), t) for p, t in texts.items()], schema))["changed_files"] == 9
    assert set(made) <= dropped and not any("record" in df.columns for df in made.values())
    assert one.pointer()["buckets"]["records"] == 3 and one.load().symbol_edges.count() == 9
    texts["src/m4.rs"] += "fn more() {\n}\n"
    two = spark.createDataFrame([(p, "rust", t, 1, len(t), t) for p, t in texts.items()], schema)
    assert one.run(two)["affected_files"] == 5 and set(made) <= dropped
    assert one.load().symbols.count() == 19 and one.load().symbol_edges.count() == 9


def test_calls_meet_the_symbols_of_their_file_in_one_shuffle(spark):
    symbols = spark.createDataFrame([("a", "f", "a::f", "function"), ("a", "g", "a::g", "struct"), ("b", "f", "b::f", "function"), ("b", "f", "b::x::f", "function")], "path string, name string, qualname string, kind string")
    calls = [("a", "a::f", "f", None, False, 1), ("a", "a::f", "g", None, False, 2), ("a", "a::f", "f", "x::f", False, 3), ("a", "gone", "f", None, False, 4), ("a", None, "f", None, False, 5), ("a", "a::f", "f", None, True, 6), ("b", "b::f", "f", None, False, 7), ("a", "a::f", "f", None, False, 1)]
    found = tree.call_sites(spark.createDataFrame(calls, "path string, caller string, name string, callee string, is_method boolean, line int"), symbols)
    assert sorted(map(tuple, found.collect()), key=lambda r: r[4]) == [("a", "a::f", None, None, 1, "a::f"), ("a", "a::f", "g", None, 2, None), ("a", "a::f", "f", "x::f", 3, None), ("b", "b::f", "f", None, 7, None)]
    assert found._jdf.queryExecution().executedPlan().toString().split("Final Plan")[0].count("Exchange hashpartitioning") <= 1
