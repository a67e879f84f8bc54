"""Canonical tables of a code graph, as Spark DDL, and the vocabularies that their columns use.

Paths and qualified names are the keys; there are no surrogate ids. A symbol is named by
(path, qualname), as qualnames need not be unique across files.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FILES = "path string, language string, parse_status string, is_barrel boolean, indexed_at long, content_hash string, mtime long, size_bytes long"
IMPORTS = "path string, raw_text string, import_path_kind string, resolved_path string, external_pkg string, span_start int, span_end int, start_line int, certainty string"
FILE_EDGES = "src string, dst string, kind string, certainty string"
SYMBOLS = "path string, name string, qualname string, kind string, visibility string, exported boolean, span_start int, span_end int, start_line int, end_line int"
SYMBOL_EDGES = "src_path string, src string, dst_path string, dst string, certainty string, call_line int"
CHURN = "path string, commit_sha string, author_email string, committed_at long"
CALLS = "path string, caller_qualname string, callee_name string, callee_qualname string, is_method boolean, start_byte int, end_byte int, start_line int, certainty string"

# Vocabularies in rank order.
CERTAINTY = ("exact", "resolved", "heuristic", "dynamic")
SYMBOL_KINDS = ("function", "method", "struct", "class", "enum", "type_alias", "module", "namespace", "constant", "static", "interface", "trait", "variable")


def rank(certainty: Column) -> Column:
    """0 for exact to 3 for dynamic; unknown text counts as heuristic."""
    out = F.lit(2)
    for i, name in enumerate(CERTAINTY):
        out = F.when(certainty == name, i).otherwise(out)
    return out


def certainty(rank_: Column) -> Column:
    return F.get(F.array(*[F.lit(c) for c in CERTAINTY]), rank_)
