"""The code graph of the tables equals its SQL, also with repeated and missing keys; what is stored of it is numbers."""

import pytest
from pyspark.sql import functions as F

from cartograph.operators import similar
from cartograph.sources import dataset, tree


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    home = str(tmp_path_factory.mktemp("tables"))
    orders = [(k, 1 + k % 3, "OF"[k % 2], 100.5 + k, f"1995-01-{1 + k % 28:02d}", ["1-URGENT", "4-NOT SPECIFIED"][k % 2]) for k in range(1, 31)]
    orders += [orders[0], (2, None, "O", 1.0, "1995-02-01", "1-URGENT"), (3, 1, "O", 1.0, "1995-02-01", None), (4, 1, "O", 1.0, "1995-02-01", None), (None, 1, "O", 1.0, "1995-02-01", "1-URGENT"), (5, 3, "F", 2.0, "1995-02-01", "1-URGENT")]
    lines = [(k, p, s, n) for k in range(1, 31) for n, (p, s) in enumerate([(k % 7, 1), (k % 5, 2), (k % 7, 1), (k % 3, k % 4)], 1)]
    lines += [(k, None, 3, 5) for k in (3, 4, 6)] + [(k, p, None, 0) for k in (3, 4, 6, 7) for p in (1, 2)] + [(None, 1, 1, 1), lines[0], (8, 99, 1, 9)] + [(9, 1, 1, 1)] * 120
    parts = [(p, f"Brand#{p}", p) for p in range(7)] + [(1, "Brand#1", 1), (2, None, 1), (3, "Brand#3", 1), (None, "Brand#9", 1)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, d string, o_orderpriority string").withColumn("d", F.to_timestamp("d")).withColumnRenamed("d", "o_orderdate").write.parquet(f"{home}/orders.parquet")
    rows = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    rows.selectExpr("*", "1.0D AS l_quantity", "l_linenumber * 2.0D AS l_extendedprice", "TIMESTAMP '1995-03-01' AS l_shipdate").write.parquet(f"{home}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_size int").write.parquet(f"{home}/part.parquet")
    return home


def test_tables_equal_their_sql(spark, tables):
    g = dataset.build(spark, tables)
    raw = {x: spark.read.parquet(f"{tables}/{x}.parquet") for x in ("orders", "lineitem", "part")}

    def run(sql):
        return spark.sql(sql, **{k: v for k, v in raw.items() if "{" + k + "}" in sql})

    for name, sql in (("files", dataset.FILE_SQL), ("following", dataset.NEXT_SQL), ("ranked", dataset.RANKED_SQL), ("edges", dataset.EDGE_SQL), ("imports", dataset.IMPORT_SQL), ("symbols", dataset.SYMBOL_SQL), ("symbol_edges", dataset.CALL_SQL)):
        raw[name] = run(sql.replace("{day}", dataset.DAY["spark"]))
        if name in ("edges", "imports", "symbols", "symbol_edges"):
            found = getattr(g, name)
            assert found.dtypes == raw[name].dtypes
            assert sorted(map(repr, found.collect())) == sorted(map(repr, raw[name].collect())), name


def test_no_path_is_written_or_shuffled_to_make_symbols_and_calls(spark, tables):
    g = dataset.build(spark, tables)
    for name in ("symbols", "symbol_edges", "edges", "imports"):
        assert not hasattr(getattr(g, name), "_spool_path")
    for stored in (g.lines, g.steps, g.leads):
        assert {"path", "src", "dst", "qualname"}.isdisjoint(stored.columns)


def test_caller_sets_move_each_call_once(spark):
    symbols = spark.createDataFrame([("a", f"q{i}", f"q{i}", "function", i < 3, i) for i in range(4)] + [("b", "q0", "q0", "function", False, 1), (None, "q0", "q0", "function", True, 1)], "path string, qualname string, name string, kind string, exported boolean, start_line int")
    calls = [("x", "a", "q0"), ("x", "a", "q1"), ("x", "a", "q0"), ("y", "a", "q1"), ("y", "a", "q0"), ("z", "a", "q0"), ("z", "a", "q3"), ("z", "a", "gone"), ("z", "b", "q0"), (None, "b", "q0"), ("w", None, "q0"), ("w", "a", None)]
    edges = spark.createDataFrame(calls, "src_path string, dst_path string, dst string")
    found = similar.usage(similar.split_rows(symbols), edges)
    assert sorted(tuple(r) for r in found.collect()) == [("a", ["q0"], 1, "z", None), ("a", ["q0", "q1"], 2, "x", "y"), ("b", ["q0"], 2, "z", None)]
    assert found._jdf.queryExecution().executedPlan().toString().split("Final Plan")[0].count("Exchange hashpartitioning") <= 2


def test_extraction_looks_for_the_asked_records_only(spark):
    text = "use crate::b::g;\npub mod m;\npub fn f() {\n    g();\n    é(1);\n}\n"
    every = tree.parse_file("src/a.rs", "rust", text, {})
    assert {r["record"] for r in every} == set(tree.RECORDS)
    for kinds in [(x,) for x in tree.RECORDS] + [("import", "module"), ("symbol", "call")]:
        assert tree.parse_file("src/a.rs", "rust", text, {}, kinds) == [r for r in every if r["record"] in kinds]


def test_edges_need_no_calls_and_calls_no_texts(spark, monkeypatch):
    files = spark.createDataFrame([("src/a.rs", "rust", "use crate::b::g;\npub fn f() {\n    g();\n}\n"), ("src/b.rs", "rust", "pub fn g() {\n}\n")], "path string, language string, text string")
    found = tree.build(files)
    calls = tree.resolve_calls
    monkeypatch.setattr(tree, "resolve_calls", None)
    assert [tuple(r) for r in found.file_edges.collect()] == [("src/a.rs", "src/b.rs", "import", "exact")]
    monkeypatch.setattr(tree, "resolve_calls", calls)
    assert [tuple(r) for r in found.symbol_edges.collect()] == [("src/a.rs", "a::f", "src/b.rs", "b::g", "resolved", 3)]


def test_leads_are_not_shuffled_to_be_distinct(spark, tables, tmp_path):
    """Only repeated order keys need it: pairs of orders are distinct where they meet the next order's first line."""
    lines = dataset.build(spark, tables).lines
    following = spark.createDataFrame([(1, 4), (1, 4), (4, 7), (7, None), (None, 1)], "k long, k1 long")
    shuffles = lambda df: df._jdf.queryExecution().executedPlan().toString().split("Final Plan")[0].count("Exchange hashpartitioning")
    once, again = dataset.leads_of(following, lines), dataset.leads_of(following.union(spark.sql("SELECT 9L, 9L")), lines)
    assert shuffles(once) < shuffles(again)
    for found in (once, again):
        assert sorted(map(repr, found.collect())) == sorted(map(repr, found.distinct().collect())) and found.count() > 1
