"""Queries of scanning, extraction, resolution and indexing.

The sources are texts made of the tables: every order is a Rust or script file that imports the next order of its customer, declares a function for
each of its (part, supplier) pairs and calls along them. The SQL says what extraction and resolution must find without looking at any text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartograph.operators import rename
from cartograph.plans.catalog import ORACLES, QUERIES, query
from cartograph.runtime import drop_spool, shared_dir, spool
from cartograph.sources import git, index, tree
from cartograph.sources.dataset import Graph, load, oracle_prefix
from cartograph.streaming import watch

# One row an order: its file, the next order of its customer, and the functions of its lines in order.
UNIT_SQL = """
SELECT o_orderkey AS k, f.path, f.language, f.mtime, k1, n.path AS next_path, n.path IS NOT NULL AND n.language = f.language AS linked
FROM {orders} JOIN {files} f ON f.file_key = o_orderkey * 2 JOIN {following} ON k = o_orderkey LEFT JOIN {files} n ON n.file_key = k1 * 2
"""
ITEM_SQL = """
SELECT k, path, language, part, supp, j, lead(part) OVER w AS part1, lead(supp) OVER w AS supp1 FROM (
  SELECT k, path, language, part, supp, row_number() OVER (PARTITION BY k ORDER BY part, supp) - 1 AS j
  FROM (SELECT DISTINCT l_orderkey AS k, l_partkey AS part, l_suppkey AS supp FROM {lineitem}) l JOIN (SELECT k AS uk, path, language FROM {units}) u ON uk = k) i
WINDOW w AS (PARTITION BY k ORDER BY part, supp)
"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, text, mtime, size_bytes, content_hash of every order's file, and its key k."""
    from cartograph.sources.dataset import DAY, FILE_SQL, NEXT_SQL

    orders, lineitem, part = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("orders", "lineitem", "part"))
    files = spark.sql(FILE_SQL.replace("{day}", DAY["spark"]), orders=orders, part=part)
    units = spark.sql(UNIT_SQL, orders=orders, files=files, following=spark.sql(NEXT_SQL, orders=orders))
    items = spark.sql(ITEM_SQL, lineitem=lineitem, units=units)
    rust = F.col("language") == "rust"
    name = F.concat(F.lit("fn_"), F.col("part"), F.lit("_"), F.col("supp"))
    public = F.when(F.col("supp") % 3 == 0, F.when(rust, "pub ").otherwise("export ")).when((F.col("supp") % 3 == 1) & rust, "pub(crate) ").otherwise("")
    call = F.when(F.col("part1").isNotNull(), F.concat(F.lit("    fn_"), F.col("part1"), F.lit("_"), F.col("supp1"), F.lit("();"))).otherwise("    // the last one")
    lines = F.array(F.concat(public, F.when(rust, "fn ").otherwise("function "), name, F.lit("() {")), call, F.lit("}"))
    of_order = items.groupBy("k").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("j", lines.alias("x")))), lambda s: s["x"])).alias("body"), F.min_by(name, "j").alias("first"),
        F.array_sort(F.collect_list(F.when((F.col("supp") % 3 == 1) & ~rust, name))).alias("shown"),
    )
    u = units.join(of_order, "k", "left")
    key, rust = F.col("k").cast("string"), F.col("language") == "rust"
    stem = F.regexp_replace(F.regexp_replace("next_path", r"^src/", ""), r"\.\w+$", "")
    use = F.concat(F.lit("use crate::"), F.replace(stem, F.lit("/"), F.lit("::")), F.lit("::begin_"), F.col("k1"), F.lit(";"))
    imp = F.concat(F.lit("import { begin_"), F.col("k1"), F.lit(" } from '../../"), stem, F.lit("';"))
    head = F.array(
        F.when(F.col("linked") & rust, use).when(F.col("linked"), imp).when(rust, "use serde::Serialize;").otherwise("import x from 'react';"),
        F.concat(F.when(rust, F.lit("pub mod inner_")).otherwise("class Inner_"), key, F.lit(" {")), F.lit("}"),
        F.concat(F.when(rust, F.lit("pub fn begin_")).otherwise("export function begin_"), key, F.lit("() {")),
        F.when(F.col("first").isNotNull(), F.concat(F.lit("    "), F.col("first"), F.lit("();"))).otherwise("    // no lines"),
        F.when(F.col("linked"), F.concat(F.lit("    begin_"), F.col("k1"), F.lit("();"))).otherwise("    // the last order"), F.lit("}"),
    )
    shown = F.when(F.size("shown") > 0, F.concat(F.lit("module.exports = { "), F.array_join("shown", ", "), F.lit(" };"))).otherwise("// end")
    tail = F.array(shown, F.when(~rust & (F.col("k") % 19 == 0), "const lazy = require(name);").otherwise("// done"))
    text = F.concat(F.array_join(F.concat(head, F.coalesce("body", F.array().cast("array<string>")), tail), "\n"), F.lit("\n"))
    out = u.select("k", "path", "language", text.alias("text"), "mtime")
    return out.withColumn("size_bytes", F.octet_length("text").cast("long")).withColumn("content_hash", F.sha2("text", 256))


def texts_prefix(*also: str) -> str:
    names = {x: x for x in ("orders", "files", "following", "lineitem", "units")}
    qual = "replace(regexp_replace(regexp_replace(path, '^src/', ''), '[.][a-z]+$', ''), '/', '::')"
    return oracle_prefix(
        f"units AS ({UNIT_SQL.format(**names)})", f"items AS ({ITEM_SQL.format(**names)})",
        f"names AS (SELECT k, path, language, {qual} || '::' AS q FROM units)",
        """sym AS (SELECT path, CASE WHEN language = 'rust' THEN 'inner_' ELSE 'Inner_' END || k AS name, CASE WHEN language = 'rust' THEN 'module' ELSE 'class' END AS kind,
          CASE WHEN language = 'rust' THEN 'public' ELSE 'local' END AS visibility, language = 'rust' AS exported, 2 AS start_line FROM units
          UNION ALL SELECT path, 'begin_' || k, 'function', 'public', true, 4 FROM units
          UNION ALL SELECT path, 'fn_' || part || '_' || supp, 'function', CASE supp % 3 WHEN 0 THEN 'public' WHEN 1 THEN CASE WHEN language = 'rust' THEN 'package' ELSE 'public' END ELSE 'local' END, supp % 3 < 2, CAST(8 + 3 * j AS INT) FROM items)""",
        """edge AS (SELECT path AS src, next_path AS dst FROM units WHERE linked)""",
        *also,
    )


def text_query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(sources(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = texts_prefix() + sql
        return f

    return add


@text_query("extract_symbols", " SELECT s.path, name, q || name AS qualname, kind, visibility, exported, start_line FROM sym s JOIN names n ON n.path = s.path")
def _symbols(files: DataFrame) -> DataFrame:
    return tree.symbols_of(tree.extract(files, kinds=("symbol",))).select("path", "name", "qualname", "kind", "visibility", "exported", "start_line")


# The first line and its feed come before a file's second line: spans count bytes.
@text_query("extract_spans", """ SELECT u.path, 'begin_' || k AS name, len_1 + len_2 + 4 AS span_start, len_1 + len_2 + 4 + CASE WHEN language = 'rust' THEN length('pub fn begin_() {') ELSE length('export function begin_() {') END + length(CAST(k AS STRING)) AS span_end
 FROM (SELECT *, CASE WHEN linked AND language = 'rust' THEN length('use crate::::begin_;') + length(regexp_replace(replace(next_path, 'src/', ''), '[.][a-z]+$', '')) + 2 + length(CAST(k1 AS STRING)) WHEN linked THEN length('import { begin_ } from ''../../'';') + length(regexp_replace(replace(next_path, 'src/', ''), '[.][a-z]+$', '')) + length(CAST(k1 AS STRING))
   WHEN language = 'rust' THEN length('use serde::Serialize;') ELSE length('import x from ''react'';') END AS len_1, CASE WHEN language = 'rust' THEN length('pub mod inner_ {') ELSE length('class Inner_ {') END + length(CAST(k AS STRING)) AS len_2 FROM units) u""")
def _spans(files: DataFrame) -> DataFrame:
    return tree.symbols_of(tree.extract(files, kinds=("symbol",))).where("name like 'begin%'").select("path", "name", F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"))


@text_query("extract_imports", " SELECT path, CASE WHEN linked THEN 'relative' ELSE 'external' END AS import_path_kind, CASE WHEN linked THEN next_path END AS resolved_path, CASE WHEN linked THEN NULL WHEN language = 'rust' THEN 'serde' ELSE 'react' END AS external_pkg, 1 AS start_line, CASE WHEN linked THEN 'exact' ELSE 'heuristic' END AS certainty FROM units")
def _imports(files: DataFrame) -> DataFrame:
    return tree.imports_of(tree.extract(files, kinds=("import",)), files).select("path", "import_path_kind", "resolved_path", "external_pkg", "start_line", "certainty")


@text_query("extract_files", " SELECT path, language, CASE WHEN language <> 'rust' AND k % 19 = 0 THEN 'partial' ELSE 'ok' END AS parse_status, false AS is_barrel FROM units")
def _files(files: DataFrame) -> DataFrame:
    return tree.file_states(tree.extract(files, kinds=("file",)), files.drop("text")).select("path", "language", "parse_status", "is_barrel")


@text_query("extract_calls", " SELECT path, 'begin_' || k AS caller, 'fn_' || part || '_' || supp AS callee, 5 AS line FROM items WHERE j = 0 UNION ALL SELECT path, 'begin_' || k, 'begin_' || k1, 6 FROM units WHERE linked UNION ALL SELECT path, 'fn_' || part || '_' || supp, 'fn_' || part1 || '_' || supp1, CAST(9 + 3 * j AS INT) FROM items WHERE part1 IS NOT NULL")
def _call_sites(files: DataFrame) -> DataFrame:
    found = tree.extract(files, kinds=("call",)).where("record = 'call' and caller is not null and not is_method")
    return found.select("path", F.element_at(F.split("caller", "::"), -1).alias("caller"), F.col("name").alias("callee"), "line")


@text_query("resolve_edges", " SELECT DISTINCT src, dst, 'import' AS kind, 'exact' AS certainty FROM edge")
def _edges(files: DataFrame) -> DataFrame:
    return tree.build(files.drop("k")).file_edges


@text_query("resolve_calls", """, called AS (SELECT path AS src_path, 'begin_' || k AS a, path AS dst_path, 'fn_' || part || '_' || supp AS b, 'exact' AS certainty, 5 AS call_line FROM items WHERE j = 0
 UNION ALL SELECT path, 'begin_' || k, next_path, 'begin_' || k1, 'resolved', 6 FROM units WHERE linked UNION ALL SELECT path, 'fn_' || part || '_' || supp, path, 'fn_' || part1 || '_' || supp1, 'exact', CAST(9 + 3 * j AS INT) FROM items WHERE part1 IS NOT NULL)
 SELECT src_path, x.q || a AS src, dst_path, y.q || b AS dst, certainty, call_line FROM called JOIN names x ON x.path = src_path JOIN names y ON y.path = dst_path""")
def _calls(files: DataFrame) -> DataFrame:
    return tree.build(files.drop("k")).symbol_edges


QUERIES["fingerprint"] = lambda spark, d: spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.sha2("html", 256).alias("content_hash"))
ORACLES["fingerprint"] = "SELECT page_id, sha256(html) AS content_hash FROM pages"

RULES = [("", "c_1*/"), ("", "!c_12/"), ("src/low", "*.ts"), ("", "/lib/brand_1*/part_*7.rs"), ("src/low", "!o_1*.ts"), ("", "brand_33/**/part_?.rs")]


@query("scan_rules", """ SELECT path FROM files WHERE NOT (regexp_matches(path, '(^|/)c_1[^/]*/') AND NOT regexp_matches(path, '(^|/)c_12/'))
 AND NOT (path LIKE 'src/low/%.ts' AND NOT regexp_matches(path, '/o_1[^/]*[.]ts$')) AND NOT regexp_matches(path, '^lib/brand_1[^/]*/part_[^/]*7[.]rs$')""")
def _scan_rules(g: Graph) -> DataFrame:
    return g.files.select("path").where(~tree.ignored(F.col("path"), RULES))


QUERIES["languages"] = lambda spark, d: load(spark, d).files.select("path", tree.language_of(F.col("path")).alias("language"))
ORACLES["languages"] = oracle_prefix() + " SELECT path, language FROM files"


def git_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records of the orders: a header and the paths of each commit, some of them not indexed."""
    c = load(spark, sf_dir).churn
    header = F.concat(F.lpad("commit_sha", 40, "0"), F.lit("|"), F.col("author_email"), F.lit("@x|"), F.col("committed_at").cast("string"))
    each = c.groupBy(header.alias("h")).agg(F.array_sort(F.collect_list("path")).alias("p"))
    return each.select(F.concat(F.col("h"), F.lit("\n\n"), F.array_join("p", "\n"), F.lit("\nREADME.md\n")).alias("record"))


QUERIES["git_churn"] = lambda spark, d: git.parse_log(git_log(spark, d), load(spark, d).files)
ORACLES["git_churn"] = oracle_prefix() + " SELECT path, lpad(commit_sha, 40, '0') AS commit_sha, author_email || '@x' AS author_email, committed_at FROM churn"

# Two scans of the sources: the second has new, changed and deleted files.
BEFORE, AFTER = "k % 89 <> 0", "k % 97 <> 0"


def second_scan(files: DataFrame) -> DataFrame:
    text = F.when(F.col("k") % 50 == 0, F.concat("text", F.lit("// touched\n"))).otherwise(F.col("text"))
    out = files.where(AFTER).withColumn("text", text)
    return out.withColumn("size_bytes", F.octet_length("text").cast("long")).withColumn("content_hash", F.sha2("text", 256))


@text_query("index_classify", f" SELECT path, CASE WHEN NOT {BEFORE} THEN 'new' WHEN NOT {AFTER} THEN 'deleted' ELSE 'changed' END AS change FROM units WHERE (NOT {BEFORE} AND {AFTER}) OR ({BEFORE} AND NOT {AFTER}) OR ({BEFORE} AND {AFTER} AND k % 50 = 0)")
def _classify(files: DataFrame) -> DataFrame:
    return index.classified(files.where(BEFORE), second_scan(files))


def two_runs(files: DataFrame) -> tuple[index.Index, dict]:
    spark, files = files.sparkSession, spool(files)
    found = index.Index(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
    found.run(files.where(BEFORE).drop("k"))
    stats = found.run(second_scan(files).drop("k"))
    drop_spool(files)
    return found, stats


INDEXED = f""", new_(path) AS (SELECT path FROM units WHERE {AFTER} AND (NOT {BEFORE} OR k % 50 = 0)), gone(path) AS (SELECT path FROM units WHERE {BEFORE} AND NOT {AFTER}),
 old_edge AS (SELECT src, dst FROM edge JOIN units a ON a.path = src JOIN units b ON b.path = dst WHERE a.k % 89 <> 0 AND b.k % 89 <> 0),
 back(n) AS (SELECT path FROM new_ UNION SELECT path FROM gone UNION SELECT e.src FROM back JOIN old_edge e ON e.dst = back.n)
 SELECT (SELECT count(*) FROM new_) AS changed_files, (SELECT count(*) FROM gone) AS deleted_files, (SELECT count(*) FROM back JOIN units ON path = n WHERE {AFTER}) AS affected_files"""


@text_query("index_incremental", INDEXED)
def _incremental(files: DataFrame) -> DataFrame:
    _, stats = two_runs(files)
    return files.sparkSession.createDataFrame([tuple(stats.values())], ", ".join(f"{k} long" for k in stats))


@text_query("index_edges", f" SELECT DISTINCT src, dst, 'import' AS kind, 'exact' AS certainty FROM edge JOIN units a ON a.path = src JOIN units b ON b.path = dst WHERE a.{AFTER} AND b.{AFTER}")
def _index_edges(files: DataFrame) -> DataFrame:
    return two_runs(files)[0].load().file_edges


GONE = "path LIKE 'src/high/%' OR path LIKE 'lib/brand_2%'"


@query("delete_cascade", f""", gone AS (SELECT path FROM files WHERE {GONE}) SELECT 'files' AS name, count(*) AS n FROM files WHERE path NOT IN (SELECT path FROM gone)
 UNION ALL SELECT 'imports', count(*) FROM imports WHERE path NOT IN (SELECT path FROM gone) UNION ALL SELECT 'resolved', count(resolved_path) FROM imports WHERE path NOT IN (SELECT path FROM gone) AND coalesce(resolved_path, '') NOT IN (SELECT path FROM gone)
 UNION ALL SELECT 'file_edges', count(*) FROM edges WHERE src NOT IN (SELECT path FROM gone) AND dst NOT IN (SELECT path FROM gone) UNION ALL SELECT 'symbols', count(*) FROM symbols WHERE path NOT IN (SELECT path FROM gone)
 UNION ALL SELECT 'symbol_edges', count(*) FROM calls WHERE src_path NOT IN (SELECT path FROM gone) AND dst_path NOT IN (SELECT path FROM gone) UNION ALL SELECT 'churn', count(*) FROM churn WHERE path NOT IN (SELECT path FROM gone)""")
def _delete(g: Graph) -> DataFrame:
    left = index.without(g, g.files.where(GONE).select("path"))
    parts = [getattr(left, t).agg(F.lit(t).alias("name"), F.count("*").alias("n")) for t in ("files", "imports", "file_edges", "symbols", "symbol_edges", "churn")]
    out = left.imports.agg(F.lit("resolved").alias("name"), F.count("resolved_path").alias("n"))
    for p in parts:
        out = out.unionByName(p)
    return out


@text_query("rename_files", """, raw AS (SELECT path, next_path AS target, k1, CASE WHEN language = 'rust' THEN 'use crate::' || replace(regexp_replace(replace(next_path, 'src/', ''), '[.][a-z]+$', ''), '/', '::') || '::begin_' || k1 ELSE 'import { begin_' || k1 || ' } from ''../../' || regexp_replace(replace(next_path, 'src/', ''), '[.][a-z]+$', '') || '''' END AS t FROM units WHERE linked AND k1 % 3 = 0)
 SELECT target, path, 'importer' AS role, 'import path resolves to target file ' || target AS reason, 'exact' AS certainty, 1 AS line, CAST(strpos(t, 'o_' || k1) - 1 AS INT) AS start_byte, CAST(strpos(t, 'o_' || k1) - 1 + length('o_' || k1) AS INT) AS end_byte, 'o_' || k1 AS before_text, 'moved_' || k1 AS after_text, true AS apply_safe FROM raw""")
def _rename_files(files: DataFrame) -> DataFrame:
    renames = files.where("k % 3 = 0").select(F.col("path").alias("target"), F.concat(F.lit("moved_"), F.col("k").cast("string")).alias("new_name"))
    return rename.rename_files(tree.imports_of(tree.extract(files, kinds=("import",)), files), renames)


@text_query("rename_apply")
def _rename_apply(files: DataFrame) -> DataFrame:
    return rename.apply_edits(files, _rename_files(files)).select("path", F.sha2("text", 256).alias("content_hash"))


@text_query("index_stream", f" SELECT DISTINCT src, dst, 'import' AS kind, 'exact' AS certainty FROM edge JOIN units a ON a.path = src JOIN units b ON b.path = dst WHERE a.{AFTER} AND b.{AFTER}")
def _stream(files: DataFrame) -> DataFrame:
    """The same files as events of two batches, by two runs of the stream: what is there first, then what changes."""
    spark, files = files.sparkSession, spool(files)
    home = f"{shared_dir(spark)}/watch-{uuid.uuid4().hex}"
    gone = files.where(f"{BEFORE} AND NOT ({AFTER})").withColumns({"text": F.lit(None).cast("string"), "deleted": F.lit(True)})
    changed = second_scan(files).where(f"NOT ({BEFORE}) OR k % 50 = 0").withColumn("deleted", F.lit(False))
    found = index.Index(spark, f"{home}/index")
    for n, part in enumerate((files.where(BEFORE).withColumn("deleted", F.lit(False)), changed.unionByName(gone))):
        rows = part.withColumn("seq", F.lit(n).cast("long")).select(*[x.split(" ")[0] for x in watch.EVENTS.split(", ")])
        rows.write.mode("append").parquet(f"{home}/events")
        watch.watch(watch.events(spark, f"{home}/events", 1000), found, f"{home}/state").awaitTermination()
    drop_spool(files)
    return found.load().file_edges
