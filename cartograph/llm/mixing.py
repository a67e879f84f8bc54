"""Mixing sources to target weights by entropy balancing.

The mix takes each document at a rate r in [0, limit]. Among all rates that give each source its target words, the ones nearest to
taking every document once (least relative entropy of what is taken and what is left of the limit) are
r = limit * e / (limit - 1 + e) with e = exp(b * size / mean size) and one number b for each source, the multiplier of its token constraint:
document rates tilted exponentially. The multipliers solve the smooth convex dual. Newton steps find them, kept within brackets that
halve where a step leaves them; each step is one distributed aggregation over the table of (source, size) counts, as documents of one source and size share
a rate. That table is far smaller than the documents and evens out hot sources and groups of copies.

Rates become whole copies on the same table. Cells are visited from large sizes to small ones and get the difference of the rounded running sums of
copies, which leaves a source at most half its largest document from its target. What is left is taken from, or given to, the largest
cells that fit it, pass by pass, until no single copy brings the source nearer, and at last one copy is swapped for another. Sums are integers, so reruns agree.
The copies of a (source, size) cell are dealt to its documents by hash order within salts of at most SALT_ROWS documents on average,
so no task ranks a hot cell.

Null and blank texts have no words; documents of no words are taken once and add nothing. A null source is a source of its own, the last.
Repeated rows are documents of their own, and ties in size or id are broken by nothing but the hash of the id: rows that tie in all of it are alike.
Very long texts are large sizes. An empty table gives an empty mix. Extra columns, whatever their names, are not read. At most ``max_sources`` sources are ranked
(one row a source, in one task; more are an error), and the distinct sizes of a source are summed in order in one task (one row a size, however many documents).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartograph.llm.expr import n_words
from cartograph.runtime import drop_spool, spool

WEIGHTS = (3.0, 1.0, 2.0)
SALT_ROWS = 256
BITS = 20  # fraction bits of a rate; sums of rates are longs, good for 2 ** 42 documents a source


def cell_table(docs: DataFrame, text: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(documents as doc_id, src, size; cells as src, size, n)."""
    sized = spool(docs.select("doc_id", F.col(source).alias("src"), n_words(F.col(text)).alias("size")))
    return sized, spool(sized.groupBy("src", "size").agg(F.count("*").alias("n")))


def targets(cells: DataFrame, total_share: float = 1.5, limit: float = 2.0, weights: tuple[float, ...] = WEIGHTS, max_sources: int = 1_000_000) -> DataFrame:
    """src, source_size, target. What a source can't take is shared by weight among the others.

    The level t with sum of min(limit * size, weight * t) = total is found in closed form: sources in the
    order in which they fill up, each compared with the level that the rest would reach.
    """
    every = spool(cells.groupBy("src").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")))
    if (found := every.count()) > max_sources:
        raise ValueError(f"{found} sources are more than the {max_sources} that may be ranked")
    rank = F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last()))
    weight = F.get(F.array(*[F.lit(w) for w in weights]), (rank - 1) % len(weights))
    t = every.withColumn("weight", weight).withColumn("cap", limit * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("src").asc_nulls_last())
    all_rows = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    t = t.withColumn("level", (total_share * F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    open_at = F.min(F.when(F.col("cap") >= F.col("weight") * F.col("level"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("level")))).over(all_rows)
    t = t.withColumn("reached", open_at["level"])
    target = F.when(F.col("reached").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("reached")))
    return t.select("src", "source_size", target.alias("target"))


def tilted(eta: Column, limit: float) -> Column:
    """The rate in (0, limit) at the exponent eta; 1 at 0."""
    e = F.exp(F.greatest(F.least(eta, F.lit(50.0)), F.lit(-50.0)))
    return limit * e / (limit - 1 + e)


def newton(cells: DataFrame, wanted: DataFrame, limit: float = 2.0, steps: int = 100, tolerance: float = 1e-6, stride: float = 4.0) -> DataFrame:
    """src, target, mean, share, free, b: the dual solution of each source; b is 0 for sources taken whole or not at all.

    Stops when no source misses its target by over ``tolerance`` of its words, and raises if ``steps`` steps don't get there.
    """
    stats = cells.groupBy("src").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("words"))
    none = F.lit(None).cast("double")
    share = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)
    dual = stats.join(wanted.select(F.col("src").alias("s2"), "target"), F.col("src").eqNullSafe(F.col("s2"))).drop("s2").select(
        "src", "words", "target", (F.col("words") / F.col("docs")).alias("mean"), share.alias("share"), F.lit(0.0).alias("b"), none.alias("low"), none.alias("high")
    )
    dual = spool(dual.withColumn("free", (F.col("share") > 0) & (F.col("share") < limit * (1 - 1e-12))))
    for _ in range(steps):
        at = cells.join(dual.where("free").select(F.col("src").alias("s2"), "mean", "b"), F.col("src").eqNullSafe(F.col("s2")))
        x = F.col("size") / F.col("mean")
        rate = tilted(F.col("b") * x, limit)
        sums = at.groupBy("s2").agg(F.sum(F.col("n") * F.col("size") * rate).alias("g"), F.sum(F.col("n") * F.col("size") * rate * (1 - rate / limit) * x).alias("h"))
        moved = dual.join(sums, F.col("src").eqNullSafe(F.col("s2")), "left")
        off = (F.col("g") - F.col("target")) / F.col("words")
        low, high = F.when(off < 0, F.col("b")).otherwise(F.col("low")), F.when(off < 0, F.col("high")).otherwise(F.col("b"))
        step = F.greatest(F.lit(-stride), F.least(F.lit(stride), F.when(F.col("h") > 0, -off * F.col("words") / F.col("h")).otherwise(-stride * F.signum(off))))
        tried = F.col("b") + step
        inside = (low.isNull() | (tried > low)) & (high.isNull() | (tried < high))
        b = F.when(F.abs(off) <= tolerance, F.col("b")).when(inside, tried).otherwise((low + high) / 2)
        new = spool(moved.select("src", "words", "target", "mean", "share", "free", F.when(F.col("g").isNull(), F.col("b")).otherwise(b).alias("b"), low.alias("low"), high.alias("high"), off.alias("off")))
        drop_spool(dual)
        dual, worst = new, new.agg(F.max(F.abs("off"))).first()[0]
        if worst is None or worst <= tolerance:
            # Rounded, so that sums added up in another order give the same rates.
            return dual.withColumn("b", F.round("b", 7))
    raise RuntimeError(f"Newton steps end {worst:.3g} off the targets after {steps} steps")


def rounded(cells: DataFrame, dual: DataFrame, limit: float = 2.0) -> DataFrame:
    """src, size, n, most, k: whole copies of each cell from the running sums of its source, large sizes first."""
    at = cells.join(dual.select(F.col("src").alias("s2"), "mean", "b", "free", "share"), F.col("src").eqNullSafe(F.col("s2"))).drop("s2")
    free = tilted(F.col("b") * F.col("size") / F.col("mean"), limit)
    rate = F.when(F.col("free"), free).when(F.col("share") > 0, F.lit(limit)).otherwise(0.0)
    units = F.when(F.col("size") == 0, 0).otherwise(F.round(rate * (1 << BITS)).cast("long") * F.col("n"))
    order = Window.partitionBy("src").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = at.withColumn("units", units).withColumn("upto", F.sum("units").over(order))
    whole = lambda u: F.shiftright(u + (1 << (BITS - 1)), BITS)
    most = F.floor(limit * F.col("n")).cast("long")
    k = F.when(F.col("size") == 0, F.col("n")).otherwise(F.least(whole(F.col("upto")) - whole(F.col("upto") - F.col("units")), most))
    return at.select("src", "size", "n", most.alias("most"), k.cast("long").alias("k"))


def settled(cells: DataFrame, wanted: DataFrame, passes: int = 64) -> DataFrame:
    """The copies of rounded(), moved until no single copy more or less brings a source nearer its target."""
    cells = spool(cells)
    goal = wanted.select(F.col("src").alias("s2"), F.round("target").cast("long").alias("goal"))
    for _ in range(passes):
        taken = cells.groupBy("src").agg(F.sum(F.col("k") * F.col("size")).alias("taken"))
        gap = taken.join(goal, F.col("src").eqNullSafe(F.col("s2"))).select("s2", (F.col("goal") - F.col("taken")).alias("gap"))
        at = cells.join(gap, F.col("src").eqNullSafe(F.col("s2"))).drop("s2")
        need = F.abs("gap")
        room = F.when(F.col("size") == 0, 0).when(F.col("gap") > 0, F.col("most") - F.col("k")).otherwise(F.col("k"))
        at = at.withColumn("room", room)
        # What fits, largest sizes first: as many copies as the words left by the cells before.
        fits = (F.col("room") > 0) & (F.col("size") <= need)
        before = F.sum(F.when(fits, F.col("room") * F.col("size")).otherwise(0)).over(Window.partitionBy("src").orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1))
        left = need - F.coalesce(before, F.lit(0))
        count = F.when(fits & (left > 0), F.least("room", F.floor(left / F.col("size")))).otherwise(0)
        # Where nothing fits, the one copy that overshoots least, if that is nearer.
        near = (F.col("room") > 0) & (F.col("size") < 2 * need)
        best = F.min(F.when(near, F.struct(F.abs(F.col("size") - need).alias("miss"), F.col("size").alias("size")))).over(Window.partitionBy("src"))["size"]
        any_fits = F.max(fits).over(Window.partitionBy("src"))
        count = F.when(any_fits, count).when(near & (F.col("size") == best), 1).otherwise(0)
        new = spool(at.select("src", "size", "n", "most", (F.col("k") + F.signum(F.col("gap").cast("double")).cast("long") * count).cast("long").alias("k"), count.alias("changed")))
        drop_spool(cells)
        cells = new
        if not cells.agg(F.sum("changed")).first()[0]:
            return cells
    raise RuntimeError(f"copies still change after {passes} passes")


def swapped(cells: DataFrame, wanted: DataFrame, reach: int = 8) -> DataFrame:
    """One copy more of one size and one less of another, ``reach`` words or less from what the source is short of, where that is nearer."""
    taken = cells.groupBy("src").agg(F.sum(F.col("k") * F.col("size")).alias("taken"))
    goal = wanted.select(F.col("src").alias("s2"), F.round("target").cast("long").alias("goal"))
    gap = taken.join(goal, F.col("src").eqNullSafe(F.col("s2"))).select("s2", (F.col("goal") - F.col("taken")).alias("gap")).where("gap <> 0")
    at = spool(cells.where("size > 0").join(gap, F.col("src").eqNullSafe(F.col("s2"))).select("src", "size", "most", "k", "gap"))
    less = at.where("k > 0").select(F.col("src").alias("s3"), F.col("size").alias("gone"), F.explode(F.sequence(F.lit(-reach), F.lit(reach))).alias("miss"), (F.col("gap") + F.col("size")).alias("z"))
    pairs = at.where("k < most").join(less, F.col("src").eqNullSafe(F.col("s3")) & (F.col("size") == F.col("z") + F.col("miss"))).where("abs(miss) < abs(gap)")
    best = pairs.groupBy("src").agg(F.min(F.struct(F.abs("miss"), "size", "gone")).alias("p")).select(F.col("src").alias("s2"), F.col("p.size").alias("up"), F.col("p.gone").alias("down"))
    change = F.when(F.col("size") == F.col("up"), 1).otherwise(0) - F.when(F.col("size") == F.col("down"), 1).otherwise(0)
    return cells.join(best, F.col("src").eqNullSafe(F.col("s2")), "left").select("src", "size", "n", (F.col("k") + F.coalesce(change, F.lit(0))).cast("long").alias("k"))


def deal(sized: DataFrame, dealt: DataFrame) -> DataFrame:
    """doc_id, src, size, copies: the k copies of each cell go to its documents as evenly as whole copies can."""
    cell = dealt.select(F.col("src").alias("s2"), F.col("size").alias("z2"), "n", "k")
    rows = sized.join(cell, F.col("src").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2"))).drop("s2", "z2")
    salt = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.ceil(F.col("n") / SALT_ROWS)))
    rows = rows.withColumn("salt", salt)
    part = rows.groupBy("src", "size", "salt").agg(F.count("*").alias("m"), F.first("n").alias("n"), F.first("k").alias("k"))
    upto = F.sum("m").over(Window.partitionBy("src", "size").orderBy("salt"))
    share = lambda c: F.floor(F.col("k") * c / F.col("n"))
    part = part.withColumn("upto", upto).select(F.col("src").alias("s2"), F.col("size").alias("z2"), F.col("salt").alias("t2"), "m", (share(F.col("upto")) - share(F.col("upto") - F.col("m"))).alias("km"))
    rank = F.row_number().over(Window.partitionBy("src", "size", "salt").orderBy(F.xxhash64("doc_id", F.lit("mix")), F.col("doc_id")))
    ranked = rows.select("doc_id", "src", "size", "salt", rank.alias("rank"))
    even = F.floor(F.col("km") / F.col("m"))
    one = F.when(F.col("rank") <= F.col("km") - even * F.col("m"), 1).otherwise(0)
    at = F.col("src").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")) & (F.col("salt") == F.col("t2"))
    return ranked.join(part, at).select("doc_id", "src", "size", (even + one).cast("int").alias("copies"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", total_share: float = 1.5, limit: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row a document: doc_id, source, size, copies, source_size, target, taken."""
    sized, cells = cell_table(docs, text, source)
    wanted = spool(targets(cells, total_share, limit, weights))
    dealt = spool(swapped(settled(rounded(cells, newton(cells, wanted, limit), limit), wanted), wanted))
    w = wanted.withColumnRenamed("src", "s2")
    out = deal(sized, dealt).join(w, F.col("src").eqNullSafe(F.col("s2")))
    return out.select("doc_id", F.col("src").alias("source"), "size", "copies", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
