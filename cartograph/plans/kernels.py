"""Graph kernels: breadth-first search, closure, shortest paths and components as DataFrame loops.

A level is one join of the frontier with the edges and one anti-join with what has been seen; nothing is collected but an
emptiness test. Each level is a table in the shared folder, so plans stay short and a lost executor
costs its running tasks. Edges are read once into such a table, pruned to the columns that the loop uses.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from cartograph.runtime import drop_spool, spool, spool_sorted

MERGE = 8  # levels kept apart before they are written as one table
SHALLOW, FEW = 3, 100_000  # depth up to which frontiers of so many rows go to the edges as they lie, which are then not written


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def by_source(edges: DataFrame) -> DataFrame:
    """Edges in buckets by src, so that a level's join moves the frontier only."""
    return spool_sorted(edges, "src")


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """seed, node, distance, rank: least hops from each seed, seeds themselves at 0.

    edges: src, dst, optionally rank; seeds: seed, node. rank is the worst edge on a path, the least among the
    shortest paths (0 for seeds). What has been seen lies in buckets by (seed, node), as a level's own rows do after they were grouped, so the anti-joins move nothing.
    """
    if "rank" not in edges.columns:
        edges = edges.withColumn("rank", F.lit(0))
    edges = edges.select("src", "dst", F.col("rank").alias("erank"))  # repeated edges meet in a level's groups
    stored = None
    level = spool_sorted(seeds.select("seed", "node", F.lit(0).alias("distance"), F.lit(0).alias("rank")).distinct(), "seed", "node")
    done, depth = [level], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        if stored is None and (max_depth is None or max_depth > SHALLOW or level.count() > FEW):
            edges = stored = by_source(edges)
        near = F.broadcast(level) if stored is None else level
        fresh = near.join(edges, near["node"] == edges["src"]).groupBy("seed", F.col("dst").alias("node")).agg(F.min(F.greatest("rank", "erank")).alias("rank"))
        for seen in done:
            fresh = fresh.join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        level = spool_sorted(fresh.select("seed", "node", F.lit(depth).alias("distance"), "rank"), "seed", "node")
        if level.isEmpty():
            drop_spool(level)
            break
        done.append(level)
        if len(done) > MERGE:
            merged = spool_sorted(_union(done[:-1]), "seed", "node")
            for old in done[:-1]:  # the last level is still the frontier
                drop_spool(old)
            done = [merged, level]
    if stored is not None:
        drop_spool(stored)
    return _union(done)


def reverse_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: everything from which some seed can be reached, the seeds themselves left out."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return reach(back, seeds).join(seeds.select("node"), "node", "left_anti")


def reach(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: everything reachable from any seed, seeds included (one search, not one per seed)."""
    found = bfs(edges, seeds.select(F.lit(0).alias("seed"), F.col("node")))
    return found.select("node")


def onward(pairs: list[tuple]) -> Iterator[tuple]:
    """(start, node) for all that each start leads to, by plain searches over a few edges."""
    after: dict = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    for start, level in after.items():
        seen = set(level)
        queue = list(seen)
        for x in queue:
            for far in after.get(x, ()):
                if far not in seen:
                    seen.add(far)
                    queue.append(far)
        yield from ((start, x) for x in queue)


PART_PAIRS = 2_000  # edges up to which all pairs of a weakly connected part are listed in one task


def closure(edges: DataFrame, part: int = PART_PAIRS) -> DataFrame:
    """src, dst pairs joined by a path of one edge or more.

    Ends that no edge leaves are joined once, to what leads to them. Of the other edges, weakly connected parts of up to ``part`` edges are searched one by one; larger ones
    grow by doubling, whose rounds are logarithmic in the longest path.
    """
    edges = spool(edges.select("src", "dst").distinct())
    starts = edges.select("src").distinct().withColumnRenamed("src", "dst")
    last = edges.join(starts, "dst", "left_anti").select("src", "dst")
    parted = weak_parts(edges.join(starts, "dst", "left_semi").select("src", "dst"))
    size = spool(parted.groupBy("part").agg(F.count("*").alias("size")))
    large = size.where(F.col("size") > part)
    some = not large.isEmpty()

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in zip(b["part"], b["src"], b["dst"], strict=True))
        for _, own in groupby(rows, key=lambda r: r[0]):
            found = onward([r[1:] for r in own])
            while chunk := list(islice(found, 50_000)):
                yield pd.DataFrame(chunk, columns=["src", "dst"])

    small = parted.join(large, "part", "left_anti") if some else parted
    pairs = spool(small.repartition("part").sortWithinPartitions("part").select("part", "src", "dst").mapInPandas(search, edges.schema))
    if some:
        pairs = pairs.unionByName(_doubled(parted.join(large, "part", "left_semi").select("src", "dst")))
    ends = pairs.withColumnRenamed("dst", "via").join(last.withColumnRenamed("src", "via"), "via").select("src", "dst")
    return pairs.unionByName(ends.unionByName(last).distinct())


def _doubled(edges: DataFrame) -> DataFrame:
    """The closure of distinct edges by doubling."""
    pairs = spool(edges)
    n = pairs.count()
    while True:
        step = pairs.join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        new = spool(pairs.unionByName(step).distinct())
        drop_spool(pairs)
        pairs, now = new, new.count()
        if now == n:
            return pairs
        n = now


def emit_edges(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """seed, src, dst, distance and the edge's other columns: every edge out of a node nearer than max_depth.

    Edges to nodes seen before count too, so a start in a cycle is reached again.
    """
    if max_depth < 1:
        found = seeds.select("seed", "node", F.lit(0).alias("distance")).limit(0)
    else:
        found = bfs(edges.select("src", "dst"), seeds, max_depth - 1).select("seed", "node", "distance")
    near = found.withColumnRenamed("distance", "hops")
    return near.join(edges, near["node"] == edges["src"]).withColumn("distance", F.col("hops") + 1).drop("node", "hops")


def bfs_tree(edges: DataFrame, start: str, max_depth: int | None = None, goal: str | None = None) -> DataFrame:
    """node, parent, distance, place: breadth-first order with ties by name; the start is left out.

    place rises in visiting order within a distance. A queue visits children in the order of their parents, then by name, so each level is sorted by (its parent's place,
    name) and numbered by the sort. A node's parent is the first visited of those that reach it. No row holds a path;
    paths() puts them together. The search ends with the level that reaches the goal.
    """
    spark = edges.sparkSession
    edges = by_source(edges.select("src", "dst"))  # repeated edges meet in a level's groups
    level = spool(spark.createDataFrame([(start, None, 0, 0)], "node string, parent string, distance int, place long"))
    done, depth = [level], 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = level.join(edges, level["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.struct("place", F.col("src").alias("parent"))).alias("via"))
        for seen in done:
            step = step.join(seen.select("node"), "node", "left_anti")
        # Numbers given after a global sort rise with it: the partition is their leading part.
        placed = step.orderBy("via.place", "node").select("node", "via.parent", F.lit(depth).alias("distance"), F.monotonically_increasing_id().alias("place"))
        level = spool(placed)
        if level.isEmpty():
            drop_spool(level)
            break
        done.append(level)
        if goal is not None and not level.where(F.col("node") == goal).isEmpty():
            break
        if len(done) > MERGE:
            merged = spool(_union(done[:-1]))
            for old in done[:-1]:
                drop_spool(old)
            done = [merged, level]
    drop_spool(edges)
    return _union(done).where("distance > 0")


def paths(parents: DataFrame, targets: DataFrame) -> DataFrame:
    """target, up, node: the way from each target to its root, up hops above it (0 for the target itself).

    parents: node, parent, without cycles; targets: target. Ways grow by doubling: the part known is followed by itself, seen from its upper end,
    over jumps of twice the length, so rounds are logarithmic in the longest way.
    """
    jump = spool_sorted(parents.select("node", "parent"), "node")
    known = spool(targets.select("target", F.lit(0).alias("up"), F.col("target").alias("node")))
    hops = 1
    while True:
        more = spool(known.join(jump, "node").select("target", (F.col("up") + hops).alias("up"), F.col("parent").alias("node")))
        if more.isEmpty():
            drop_spool(more)
            drop_spool(jump)
            return known
        grown = spool(known.unionByName(more))
        drop_spool(known)
        drop_spool(more)
        upper = jump.select(F.col("node").alias("parent"), F.col("parent").alias("far"))
        longer = spool_sorted(jump.join(upper, "parent").select("node", F.col("far").alias("parent")), "node")
        drop_spool(jump)
        known, jump, hops = grown, longer, 2 * hops


def trails(parents: DataFrame, targets: DataFrame) -> DataFrame:
    """target, trail: the nodes from the root down to each target."""
    steps = paths(parents, targets).groupBy("target").agg(F.sort_array(F.collect_list(F.struct("up", "node")), asc=False).alias("s"))
    return steps.select("target", F.col("s.node").alias("trail"))


def nearest(edges: DataFrame, goals: DataFrame) -> DataFrame:
    """node, distance, rank, next: hops from each node to the nearest goal, and the least by name of the neighbours from which it is one hop less.

    edges: src, dst, rank; goals: node. rank is the worst edge on the way by next. Following next gives the first of the shortest ways, in the order in which a search from the node
    would visit them; goals have distance 0 and no next.
    """
    back = spool_sorted(edges.groupBy("src", "dst").agg(F.min("rank").alias("erank")), "dst")
    kind = edges.schema["src"].dataType.simpleString()
    level = spool_sorted(goals.select("node").distinct().select("node", F.lit(0).alias("distance"), F.lit(0).alias("rank"), F.lit(None).cast(kind).alias("next")), "node")
    done, depth = [level], 0
    while True:
        depth += 1
        met = level.select(F.col("node").alias("dst"), "rank").join(back, "dst")
        step = met.groupBy(F.col("src").alias("node")).agg(F.min(F.struct("dst", F.greatest("rank", "erank").alias("r"))).alias("x"))
        for seen in done:
            step = step.join(seen.select("node"), "node", "left_anti")
        level = spool_sorted(step.select("node", F.lit(depth).alias("distance"), F.col("x.r").alias("rank"), F.col("x.dst").alias("next")), "node")
        if level.isEmpty():
            drop_spool(level)
            drop_spool(back)
            return _union(done)
        done.append(level)
        if len(done) > MERGE:
            merged = spool_sorted(_union(done[:-1]), "node")
            for old in done[:-1]:
                drop_spool(old)
            done = [merged, level]


WORD = 64  # nodes a mask counts


def reach_counts(edges: DataFrame, words_at_once: int = 1 << 16, hops: int = 6) -> DataFrame:
    """node, reached: how many nodes a path of one edge or more leads to from each node that has an edge; a node in a cycle counts itself.

    All nodes are reached at once, 64 in a mask: a row (node, word, mask) says which of the word's nodes can be reached. A hop passes masks from
    the ends of edges to their starts and joins them by OR; ``hops`` of them are planned at once until no bit is new. Numbers follow what nodes have in
    common (the least node that reaches them in a few hops), so a node's reach falls into few words. Starts that no edge leads to stay out of the hops: their
    masks are put together once, from the final masks of what they lead to. Words are taken in batches of
    ``words_at_once``, whose bits are counted and dropped before the next batch. No row is a pair of nodes.
    """
    pairs = spool(edges.select("src", "dst").distinct())
    ends = spool(pairs.select(F.col("dst").alias("node")).distinct())
    kin = spread(ends.withColumn("value", F.col("node")), pairs.join(ends.withColumnRenamed("node", "src"), "src", "left_semi"), hops, rounds=1)
    numbered = spool(ordinals(kin, "value", "node").select(F.col("node").alias("dst"), (F.col("ordinal") - 1).alias("at")))
    words = -(-numbered.count() // WORD)
    bit = F.expr(f"shiftleft(1L, CAST(at % {WORD} AS INT))")
    word = F.floor(F.col("at") / WORD).alias("word")
    between = pairs.join(ends.withColumnRenamed("node", "src"), "src", "left_semi")  # starts that nothing leads to pass nothing on
    outer = spool(pairs.join(ends.withColumnRenamed("node", "src"), "src", "left_anti"))
    first = spool(between.join(numbered, "dst").groupBy(F.col("src").alias("node"), word).agg(F.bit_or(bit).alias("mask")))
    inner = between.join(pairs.select("src").distinct().withColumnRenamed("src", "dst"), "dst", "left_semi")  # the other ends have nothing to pass on
    starts = between.select("src").distinct()
    back = spool_sorted(inner.unionByName(starts.select(F.col("src").alias("dst"), "src")).distinct(), "dst")
    parts = []
    for low in range(0, words, words_at_once):
        state = first.where(F.col("word").between(low, low + words_at_once - 1))
        bits = -1
        while True:
            for _ in range(hops):
                state = state.join(back, state["node"] == back["dst"]).groupBy(F.col("src").alias("node"), "word").agg(F.bit_or("mask").alias("mask"))
            new = spool(state)
            now = new.agg(F.sum(F.bit_count("mask"))).first()[0] or 0
            if bits >= 0:
                drop_spool(old)
            old = state = new
            if now == bits:
                break
            bits = now
        own = numbered.select(F.col("dst").alias("node"), word, bit.alias("mask")).where(F.col("word").between(low, low + words_at_once - 1))
        whole = own.unionByName(state).groupBy("node", "word").agg(F.bit_or("mask").alias("mask"))
        once = outer.join(whole, outer["dst"] == whole["node"]).groupBy(F.col("src").alias("node"), "word").agg(F.bit_or("mask").alias("mask"))
        parts.append(spool(state.unionByName(once).groupBy("node").agg(F.sum(F.bit_count("mask")).alias("reached"))))
        drop_spool(state)
    for table in (pairs, ends, outer, numbered, first, back):
        drop_spool(table)
    if not parts:
        return edges.sparkSession.createDataFrame([], StructType([StructField("node", edges.schema["src"].dataType), StructField("reached", LongType())]))
    return _union(parts).groupBy("node").agg(F.sum("reached").alias("reached")) if len(parts) > 1 else parts[0]


def ordinals(df: DataFrame, *order: str) -> DataFrame:
    """Adds ordinal, 1 for the first row in order: a distributed sort, and the row counts of its partitions."""
    placed = spool(df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id")))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("_id").alias("first")).orderBy("_part").collect()  # one row a partition
    before, offsets = 0, []
    for r in sizes:
        offsets.append((r["_part"], before - r["first"] + 1))
        before += r["n"]
    table = df.sparkSession.createDataFrame(offsets, "_part int, offset long")
    return placed.join(F.broadcast(table), "_part").withColumn("ordinal", F.col("_id") + F.col("offset")).drop("_part", "_id", "offset")


def spread(values: DataFrame, edges: DataFrame, hops: int = 6, rounds: int | None = None) -> DataFrame:
    """node, value: the least value among the nodes that reach each node, its own included.

    ``hops`` joins are planned at once, so a fixed point takes a sixth of the tables that single levels would. Every node
    has an edge to itself for the time, so that a hop uses the last one's result only once. ``rounds`` ends it before the fixed point.
    """
    values = spool(values)
    edges = by_source(edges.select("src", "dst").unionByName(values.select(F.col("node").alias("src"), F.col("node").alias("dst"))))
    done = 0
    while True:
        new = values
        for _ in range(hops):
            new = new.join(edges, new["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("value").alias("value"))
        new = spool(new)
        done += 1
        same = done == rounds or new.withColumnRenamed("value", "v2").join(values, "node").where("v2 < value").isEmpty()
        drop_spool(values)
        values = new
        if same:
            drop_spool(edges)
            return values


def walked(edges: DataFrame, start: str, end: str, hops: int = 4) -> DataFrame:
    """The ends of walks of ``hops`` edges from column ``start`` to column ``end``: one plan for what single rounds of trimming would write each."""
    found = edges.select(end).distinct()
    for _ in range(hops - 1):
        found = edges.join(found.withColumnRenamed(end, start), start, "left_semi").select(end).distinct()
    return found


def strong(pairs: Iterable[tuple]) -> list[tuple]:
    """(node, least node of its strongly connected component), for components of two nodes or more: Tarjan's search without recursion."""
    after: dict = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
    order, low, stack, out = {}, {}, [], []
    open_ = set()
    for root in after:
        work = [] if root in order else [root]
        ways = {}
        while work:
            node = work[-1]
            if node not in order:
                order[node] = low[node] = len(order)
                stack.append(node)
                open_.add(node)
                ways[node] = iter(after.get(node, ()))
            for far in ways[node]:
                if far not in order:
                    work.append(far)
                    break
                if far in open_:
                    low[node] = min(low[node], low[far])
            else:
                work.pop()
                del ways[node]
                if work:
                    low[work[-1]] = min(low[work[-1]], low[node])
                if low[node] == order[node]:
                    found = [stack.pop()]
                    while found[-1] != node:
                        found.append(stack.pop())
                    open_.difference_update(found)
                    if len(found) > 1:
                        out += [(x, min(found)) for x in found]
    return out


def weak_parts(edges: DataFrame) -> DataFrame:
    """src, dst, part: the edges and a number of the weakly connected part that they lie in. Labels are hashes of names: parts whose hashes meet count as one."""
    a, b = F.xxhash64("src"), F.xxhash64("dst")
    both = edges.select(a.alias("src"), b.alias("dst")).unionByName(edges.select(b.alias("src"), a.alias("dst")))
    labels = spread(both.select(F.col("src").alias("node")).distinct().withColumn("value", F.col("node")), both)
    parted = spool(edges.withColumn("node", a).join(labels, "node").select("src", "dst", F.col("value").alias("part")))
    drop_spool(labels)
    return parted


PART = 100_000  # edges up to which a weakly connected part is searched in one task


def scc(edges: DataFrame, part: int = PART) -> DataFrame:
    """node, component: strongly connected components; components of one node are left out.

    Nodes without predecessors or successors are trimmed first. Weakly connected parts of up to ``part`` edges are then searched one by one, as many to a
    task as make up that many edges. In larger ones every node takes the least name that reaches it; the nodes of a colour that reach its root backwards
    are a component and leave the graph, which may fall into smaller parts.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType
    names = StructType([StructField("node", kind), StructField("component", kind)])
    out: list[DataFrame] = [spark.createDataFrame([], names)]

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(strong(zip(pdf["src"], pdf["dst"], strict=True)), columns=["node", "component"])

    rest = spool(edges.select("src", "dst").where("src <> dst").distinct())
    n = rest.count()
    while n:
        while True:  # trim
            heads, tails = walked(rest, "src", "dst").withColumnRenamed("dst", "src"), walked(rest, "dst", "src").withColumnRenamed("src", "dst")
            left = spool(rest.join(heads, "src", "left_semi").join(tails, "dst", "left_semi").select("src", "dst"))
            drop_spool(rest)
            rest, now = left, left.count()
            if now > 0.9 * n:
                n = now
                break
            n = now
        if not n:
            break
        parted = weak_parts(rest)
        drop_spool(rest)
        size = spool(parted.groupBy("part").agg(F.count("*").alias("size")))
        large = size.where(F.col("size") > part)
        some = not large.isEmpty()
        small = parted.join(large, "part", "left_anti") if some else parted
        tasks = -(-n // part)
        out.append(spool(small.withColumn("task", F.pmod("part", F.lit(tasks))).groupBy("task").applyInPandas(search, names)))
        if not some:
            drop_spool(parted)
            drop_spool(size)
            break
        rest = spool(parted.join(large, "part", "left_semi").select("src", "dst"))
        drop_spool(parted)
        drop_spool(size)
        nodes = rest.select(F.col("src").alias("node")).unionByName(rest.select(F.col("dst").alias("node"))).distinct()
        coloured = spread(nodes.withColumn("value", F.col("node")), rest)
        colour = coloured.withColumnRenamed("value", "colour")
        a, b = colour.select(F.col("node").alias("src"), F.col("colour").alias("ca")), colour.select(F.col("node").alias("dst"), F.col("colour").alias("cb"))
        inner = rest.join(a, "src").join(b, "dst").where("ca = cb")
        back = spool(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        marked = spread(colour.select("node", (F.col("node") != F.col("colour")).cast("int").alias("value")), back)
        found = spool(marked.where("value = 0").join(colour, "node").select("node", F.col("colour").alias("component")))
        big = found.join(found.groupBy("component").agg(F.count("*").alias("size")).where("size > 1"), "component").select("node", "component")
        out.append(big)
        gone = found.select(F.col("node").alias("src"))
        left = spool(rest.join(gone, "src", "left_anti").join(gone.withColumnRenamed("src", "dst"), "dst", "left_anti").select("src", "dst"))
        for done in (rest, coloured, back, marked):
            drop_spool(done)
        rest, n = left, left.count()
    return _union(out)
