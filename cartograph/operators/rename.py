"""Rename plans: where a symbol is defined and imported, as edits, and where it is called, as work left to do."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.operators.direct import find_symbol
from cartograph.sources.dataset import Graph


def rename_plan(g: Graph, texts: DataFrame, target: str, new_name: str) -> DataFrame:
    """path, role, line, start_byte, end_byte, before_text, after_text, apply_safe.

    texts: path, text. Edits name the identifier's bytes; call sites are deferred (no bytes, not safe).
    """
    if not re.fullmatch(r"[A-Za-z_]\w*", new_name, re.ASCII):
        raise ValueError(f"not an identifier: {new_name}")
    found = find_symbol(g.symbols, target)
    if found is None:
        raise ValueError(f"unknown symbol: {target}")
    path, qual = found
    own = g.symbols.where((F.col("path") == path) & (F.col("qualname") == qual)).select("path", "name", F.col("start_line").alias("line"))
    old = own.first()["name"]
    if old == new_name:
        raise ValueError("the target already has that name")
    word = rf"(?<![A-Za-z0-9_]){re.escape(old)}(?![A-Za-z0-9_])"
    used = g.imports.where((F.col("resolved_path") == path) & F.col("raw_text").rlike(word)).select("path", F.col("start_line").alias("line"), F.lit("importer").alias("role"))
    places = own.select("path", "line", F.lit("defines_target_symbol").alias("role")).unionByName(used).distinct()
    lines = F.split("text", "\n", -1)
    at = texts.join(places, "path").withColumn("t", F.get(lines, F.col("line") - 1))
    before = F.array_join(F.slice(lines, 1, F.col("line") - 1), "\n")
    skip = F.octet_length(before) + F.when(F.col("line") > 1, 1).otherwise(0)
    lead = F.regexp_extract("t", rf"^(.*?){word}", 1)
    edits = at.where(F.col("t").rlike(word)).withColumn("start_byte", skip + F.octet_length(lead)).select(
        "path", "role", "line", "start_byte", (F.col("start_byte") + len(old.encode())).alias("end_byte"), F.lit(old).alias("before_text"), F.lit(new_name).alias("after_text"), F.lit(True).alias("apply_safe")
    )
    none = F.lit(None).cast("int")
    deferred = g.symbol_edges.where((F.col("dst_path") == path) & (F.col("dst") == qual)).select(
        F.col("src_path").alias("path"), F.lit("caller").alias("role"), F.col("call_line").alias("line"), none.alias("start_byte"), none.alias("end_byte"), F.lit(old).alias("before_text"), F.lit(new_name).alias("after_text"), F.lit(False).alias("apply_safe")
    ).distinct()
    return edits.unionByName(deferred)


def rename_files(imports: DataFrame, renames: DataFrame) -> DataFrame:
    """target, path, role, reason, certainty, line, start_byte, end_byte, before_text, after_text, apply_safe: what importers of renamed files must change.

    renames: target (a file), new_name (its new stem). Files themselves aren't moved. An import that names the file changes where its text first has the old stem; all targets are planned at once.
    """
    stem = F.regexp_extract("target", r"([^/]+?)(?:\.[^./]*)?$", 1)
    bad = ~F.col("new_name").rlike(r"^[A-Za-z_]\w*$")
    wanted = renames.select("target", F.when(bad, F.raise_error(F.concat(F.lit("not an identifier: "), "new_name"))).otherwise(F.col("new_name")).alias("new_name"), stem.alias("old"))
    used = imports.join(wanted, F.col("resolved_path") == F.col("target")).withColumn("at", F.expr("locate(old, raw_text)")).where("at > 0")
    start = F.col("span_start") + F.octet_length(F.substring("raw_text", F.lit(1), F.col("at") - 1))
    return used.select(
        "target", "path", F.lit("importer").alias("role"), F.concat(F.lit("import path resolves to target file "), "target").alias("reason"), "certainty", F.col("start_line").alias("line"),
        start.alias("start_byte"), (start + F.octet_length("old")).alias("end_byte"), F.col("old").alias("before_text"), F.col("new_name").alias("after_text"), F.lit(True).alias("apply_safe"),
    )


def apply_edits(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """path, text of the edited files: the bytes between a file's edits, in order, with their new texts; any number of files and edits at once.

    An edit that doesn't find its before_text raises an error, as do two that overlap. Equal edits are one.
    """
    e = edits.where("apply_safe").select("path", "start_byte", "end_byte", "before_text", "after_text").distinct()
    each = e.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("start_byte", "end_byte", "before_text", "after_text"))).alias("e"))
    held = texts.select("path", F.col("text").cast("binary").alias("b")).join(each, "path")
    cut = lambda a, z: F.hex(F.substring(F.col("b"), a + 1, z - a))
    start, end = (lambda x: x["start_byte"].cast("int")), (lambda x: x["end_byte"].cast("int"))
    # What stands before each edit begins where the last one ended; segments are joined as hexadecimal text.
    ends = F.concat(F.array(F.lit(0)), F.transform("e", end))
    parts = F.transform("e", lambda x, i: F.concat(cut(F.get(ends, i), start(x)), F.hex(x["after_text"])))
    right = F.forall("e", lambda x: cut(start(x), end(x)) == F.hex(x["before_text"]))
    apart = F.forall(F.sequence(F.lit(0), F.size("e") - 1), lambda i: F.get(ends, i) <= start(F.get("e", i)))
    rest = cut(F.element_at(ends, -1), F.octet_length("b"))
    whole = F.decode(F.unhex(F.concat(F.array_join(parts, ""), rest)), "UTF-8")
    stale = F.raise_error(F.concat("path", F.lit(" has changed since the plan was made, or its edits overlap"))).cast("string")
    return held.select("path", F.when(right & apart, whole).otherwise(stale).alias("text"))


def apply_plan(root: str, rows: list[dict], force: bool = False) -> int:
    """Applies the safe edits, last bytes first, each file swapped in whole; refuses if some work is deferred."""
    if not force and any(not r["apply_safe"] for r in rows):
        raise ValueError("the plan has deferred edits; use force to apply the rest")
    done = 0
    for path in sorted({r["path"] for r in rows if r["apply_safe"]}):
        full = os.path.join(root, path)
        with open(full, "rb") as f:
            data = f.read()
        for r in sorted((r for r in rows if r["path"] == path and r["apply_safe"]), key=lambda r: -r["start_byte"]):
            if data[r["start_byte"] : r["end_byte"]] != r["before_text"].encode():
                raise ValueError(f"{path} has changed since the plan was made")
            data = data[: r["start_byte"]] + r["after_text"].encode() + data[r["end_byte"] :]
            done += 1
        fd, temp = tempfile.mkstemp(dir=os.path.dirname(full))
        with os.fdopen(fd, "wb") as f:
            f.write(data)
        os.replace(temp, full)
    return done
