"""Line deduplication with levelled sorted runs of line hashes.

Documents are taken in batches of falling doc_id. Each batch reduces its lines to one entry a
key (owner = largest doc_id, number of documents) and merge-joins the runs so far: a key that some run has in ``min_docs`` documents
already is settled, as its owner lies in an earlier batch, and drops out; any other takes over the owner and the count so far. What is left becomes a
level-0 run, and two runs of a level are compacted into one of the next. At the end the settled entries are the frequent keys, with the document
that keeps them. Runs are tables in buckets of the key, sorted by it, and batches are grouped by it: neither joins nor compactions shuffle a run again.

A key is the line without ASCII white space at both ends, A-Z lower-cased, known by 128 bits
(two 64-bit hashes with unlike seeds) and its length. Shorter keys than ``min_chars`` are never dropped. A null
or empty text has one empty line. Rows that share a doc_id count as one document, null being an id of
its own that ranks below all others; ids may be numbers, strings, binary, dates or timestamps. Repeated rows lose the same lines; there are no ties, as owners are
largest ids. Very long texts cost time in proportion to their length. An empty table gives an empty table. Other columns pass through; an input column with the name of a result column
is replaced by it.

Only line hashes, ids and positions are shuffled to find the lines; texts move once, in the join that applies the decisions. Frequent lines are counted with partial
aggregation. Keys that hold a thousandth of all lines or more, of which there can be at most a thousand, meet their lines by broadcast instead of a shuffle, with the same result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartograph.llm.expr import BLANKS, ascii_lower, attach, carried, let, lines, row_key, with_text
from cartograph.runtime import drop_spool, spool, spool_sorted

KEY = ["h1", "h2"]
LEAST_BATCHES, BATCH_DOCS, MOST_BATCHES = 5, 200_000_000, 64
HEAVY = 1000  # at most so many keys are broadcast
NEW = ["n_lines", "n_dropped", "kept_text"]


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_table(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """A row for each line whose key is long enough: _id, _tx, pos, h1, h2."""
    listed = F.transform(lines(F.col(text)), lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("k")))
    long_enough = F.filter(listed, lambda x: F.char_length(x["k"]) >= min_chars)
    hashed = F.transform(long_enough, lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["k"]).alias("h1"), F.xxhash64(F.lit("2nd"), x["k"], F.length(x["k"])).alias("h2")))
    return docs.select(*row_key(text=text), F.explode(hashed).alias("_l")).select("_id", "_tx", "_l.*")


def rising(doc_id: Column, kind: T.DataType) -> Column:
    """A number that never falls as the id rises; it may stay for ids that differ late."""
    if isinstance(kind, T.NumericType):
        return doc_id.cast("double")
    if isinstance(kind, (T.DateType, T.TimestampNTZType)):
        doc_id, kind = doc_id.cast("timestamp"), T.TimestampType()
    if isinstance(kind, (T.TimestampType, T.BooleanType)):
        return doc_id.cast("double")
    head = F.rpad(F.hex(F.substring(doc_id.cast("binary"), 1, 6)), 12, "0")
    return F.conv(head, 16, 10).cast("double")


def batch_bounds(docs: DataFrame, batches: int | None) -> list[float]:
    """Where rising() parts the batches, rising: at least LEAST_BATCHES, and more as documents need."""
    order = rising(F.col("doc_id"), docs.schema["doc_id"].dataType)
    n, at = docs.agg(F.count("*"), F.percentile_approx(order, [i / 320 for i in range(1, 320)], 10000)).first()
    batches = batches or max(LEAST_BATCHES, min(MOST_BATCHES, -(-n // BATCH_DOCS)))
    return sorted({at[i * 320 // batches - 1] for i in range(1, batches)}) if at else []


def reduce_lines(batch: DataFrame) -> DataFrame:
    """One entry a key: owner and number of documents."""
    once = batch.groupBy(*KEY, "_id").agg(F.lit(1).alias("one"))
    return once.groupBy(*KEY).agg(F.max("_id").alias("owner"), F.count("*").alias("n"))


class Runs:
    """Levelled runs of h1, h2, owner, n; a level holds one table at most, of twice as many batches as the level below.

    An entry counts all documents up to its batch, so of several entries for a key the one with the largest count holds.
    """

    def __init__(self, min_docs: int) -> None:
        self.levels: list[DataFrame | None] = []
        self.min_docs = min_docs

    def tables(self) -> list[DataFrame]:
        return [run for run in self.levels if run is not None]

    def add(self, batch: DataFrame) -> None:
        """Merge-joins a batch's entries with the runs, drops what is settled there and adds the rest as a run."""
        known = self.tables()
        for i, run in enumerate(known):
            batch = batch.join(run.select(*KEY, F.col("owner").alias(f"owner{i}"), F.col("n").alias(f"n{i}")), KEY, "left")
        before, owners = [F.col(f"n{i}") for i in range(len(known))], [F.col(f"owner{i}") for i in range(len(known))]
        seen = F.coalesce(F.greatest(*before, F.lit(0)), F.lit(0)) if known else F.lit(0)
        batch = batch.where(seen < self.min_docs).select(*KEY, F.greatest(*owners, "owner").alias("owner") if known else F.col("owner"), (F.col("n") + seen).alias("n"))
        self._put(0, spool_sorted(batch, *KEY))

    def _put(self, level: int, run: DataFrame) -> None:
        if len(self.levels) <= level:
            self.levels.append(None)
        old, self.levels[level] = self.levels[level], None
        if old is None:
            self.levels[level] = run
            return
        other = old.select(*KEY, F.col("owner").alias("owner0"), F.col("n").alias("n0"))
        merged = spool_sorted(run.join(other, KEY, "full_outer").select(*KEY, F.greatest("owner", "owner0").alias("owner"), F.greatest("n", "n0").alias("n")), *KEY)
        drop_spool(old)
        drop_spool(run)
        self._put(level + 1, merged)

    def frequent(self) -> DataFrame:
        """The settled keys; each is settled in one run, as later batches drop it."""
        return reduce(DataFrame.unionByName, [run.where(F.col("n") >= self.min_docs) for run in self.tables()])


def frequent_lines(docs: DataFrame, text: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(line table, keys found in at least min_docs documents with their owner)."""
    bounds = batch_bounds(docs, batches)
    order = rising(F.col("_id"), docs.schema["doc_id"].dataType)
    number = F.lit(0)
    for bound in bounds:
        number = number + F.coalesce(order > bound, F.lit(False)).cast("int")
    table = spool(line_table(docs, text, min_chars).withColumn("batch", number), "batch")
    runs = Runs(min_docs)
    for i in range(len(bounds), -1, -1):
        runs.add(reduce_lines(table.where(F.col("batch") == i)))
    keys = spool(runs.frequent())
    for run in runs.tables():
        drop_spool(run)
    return table, keys


def dropped_lines(table: DataFrame, keys: DataFrame) -> DataFrame:
    """_id, _tx and the sorted positions of the lines that a row loses."""
    total = table.count()
    least = max(1, total // HEAVY)
    loses = ~F.col("_id").eqNullSafe(F.col("owner"))
    entry = table.select("_id", "_tx", "pos", *KEY)
    # A document may hold a line often, but n counts documents: the bound holds, as n <= lines.
    heavy = F.broadcast(keys.where(F.col("n") > least).select(*KEY, "owner"))
    light = keys.where(F.col("n") <= least).select(*KEY, "owner")
    hits = entry.join(heavy, KEY).where(loses).unionByName(entry.join(light, KEY).where(loses))
    return hits.groupBy("_id", "_tx").agg(F.array_sort(F.collect_set("pos")).alias("__gone"))


def without(text: Column, gone: Column) -> Column:
    """The text without the lines at the given rising positions, in time linear in the lines."""

    def cut(all_lines: Column) -> Column:
        edges = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(all_lines)))
        part = lambda b: F.transform(F.sequence(F.lit(0), F.size(b) - 2), lambda j: F.slice(all_lines, F.get(b, j) + 2, F.get(b, j + 1) - F.get(b, j) - 1))
        return F.array_join(F.flatten(let(edges, part)), "\n")

    return let(lines(text), cut)


def dedup_lines(docs: DataFrame, text: str = "text", min_chars: int = 20, min_docs: int = 3, batches: int | None = None) -> DataFrame:
    """Adds n_lines, n_dropped and kept_text, the text without its dropped lines.

    A text that loses nothing is returned as it is, null included.
    """
    table, keys = frequent_lines(docs, text, min_chars, min_docs, batches)
    joined = attach(docs.select(F.struct("*").alias("__row"), *row_key(text=text)), dropped_lines(table, keys), hint="shuffle_hash")
    own, gone = F.col(f"__row.`{text}`"), F.col("__gone")
    return joined.select(
        *carried(docs, NEW),
        F.size(lines(own)).cast("long").alias("n_lines"),
        F.when(gone.isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
        F.when(gone.isNull(), own).otherwise(without(own, gone)).alias("kept_text"),
    )


def clean(docs: DataFrame, text: str = "text", **options: int) -> DataFrame:
    """The documents without their repeated lines, with their own columns only.

    A document that loses all its lines stays with an empty text. n_chars, where there is
    such a column, follows the new text.
    """
    out = dedup_lines(docs.select(F.struct("*").alias("__row"), "doc_id", text), text, **options)
    return out.select(*with_text(docs, text, F.col("n_dropped") > 0, F.col("kept_text")))
