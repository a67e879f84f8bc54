"""Column expressions shared by the native operators."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, the only characters that part words.
SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds ``value`` once for use in several places of ``body``.

    Catalyst may inline a projected column into each of its uses, inside lambdas too, where
    it would then run once per array element. A lambda variable is computed once per row.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def lines(text: Column) -> Column:
    """The parts between line feeds; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only; translate() is slow and needed for texts with other letters only."""
    exact = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(exact)


def solid(text: Column) -> Column:
    """The text without ASCII white space; replace() works on bytes and is far faster than translate()."""
    for blank in BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(""))
    return text


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of the text are among ``chars``."""
    return (F.char_length(text) - F.char_length(F.regexp_replace(text, f"[{re.escape(chars)}]+", ""))).cast("long")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Identifies a row by its id and text; rows that share both get the same results.

    The second column, a 64-bit hash, tells apart repeated or null ids with unlike texts.
    """
    return [F.col(doc_id).alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_tx")]


def attach(rows: DataFrame, found: DataFrame, how: str = "left", hint: str | None = None) -> DataFrame:
    """Joins what was found for row keys to the rows, null ids included; the found side may be hinted."""
    right = found.withColumnsRenamed({"_id": "_rid", "_tx": "_rtx"})
    right = right.hint(hint) if hint else right
    return rows.join(right, F.col("_id").eqNullSafe(F.col("_rid")) & (F.col("_tx") == F.col("_rtx")), how).drop("_rid", "_rtx")


def carried(docs: DataFrame, new: list[str]) -> list[Column]:
    """The input's columns out of the struct ``__row``, without those that a result column of the same name replaces.

    Operators keep the input row in one struct, so that no column of the input can clash with one of their own
    (names that begin with two underscores are theirs).
    """
    taken = {c.lower() for c in new}
    return [F.col(f"__row.`{c}`").alias(c) for c in docs.columns if c.lower() not in taken]


def with_text(docs: DataFrame, text: str, changed: Column, value: Column) -> list[Column]:
    """The input's columns out of ``__row`` with a new text, and n_chars, where there is such a column, following it."""
    out = []
    for c in docs.columns:
        old = F.col(f"__row.`{c}`")
        if c == text:
            old = value
        elif c.lower() == "n_chars":
            old = F.when(changed, F.char_length(value).cast(docs.schema[c].dataType)).otherwise(old)
        out.append(old.alias(c))
    return out
