"""SimHash near-duplicates with vantage-point trees.

A document's 64-bit fingerprint has a bit set where over half of its word shingles' hashes have it. Equal
fingerprints are one point; the distinct points are searched for pairs within a Hamming radius:

- A vantage-point tree over a bounded sample of points (SAMPLE, chosen by hash order) is the top of the index.
  A point goes left if its distance to the vantage point is at most mu, else right. By the triangle inequality a right
  point can only link to left points farther than mu - radius, so just that boundary band is sent both ways: any two
  points within the radius meet in at least one leaf, and every pair found is exact.
- Leaves are shards. Each is searched by the same tree in memory, and small leaves by exhaustion. A shard returns
  a spanning forest of its links instead of all pairs, so dense groups give no more edges than members.
- Shard forests are joined by distributed connected components.

Every fingerprint is indexed; the sample only places the boundaries. A text of no words, null included, has fingerprint
zero, which links like any other. Repeated rows share a fingerprint. Extra columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.llm.components import components
from cartograph.runtime import spool

SAMPLE = 65536
SHARD = 4096  # points a shard should have
LEAF = 512
SEED = 42
PIECE = 200_000  # shingles counted at once


def fingerprint(text: bytes, width: int = 3) -> int:
    """The fingerprint of a UTF-8 text as an unsigned integer."""
    w = text.lower().split()  # on bytes: A-Z and ASCII white space only
    if not w:
        return 0
    joined = b" ".join(w)
    size = np.fromiter(map(len, w), np.int64, len(w))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    h = xxhash.xxh64_intdigest
    n = max(1, len(w) - width + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, PIECE):
        a, b = starts[i : i + PIECE][: n - i].tolist(), ends[min(width, len(w)) - 1 :][i : i + PIECE].tolist()
        hashes = np.array([h(joined[x:y], SEED) for x, y in zip(a, b, strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", width: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(x or b"", width) for x in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).cast("binary")).mapInArrow(run, f"doc_id {kind}, fp long")


def split(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """The vantage point and mu that leave the smallest larger side, or None if none is worth it."""
    best, found = 0.9 * len(points), None
    for v in points[np.linspace(0, len(points) - 1, 8).astype(int)]:
        upto = np.cumsum(np.bincount(np.bitwise_count(points ^ v), minlength=65))
        # left: d <= mu; right: d > mu - radius
        left = upto[radius:]
        right = len(points) - upto[: len(upto) - radius]
        cost = np.maximum(left, right) + 0.25 * (left + right - len(points))
        i = int(cost.argmin())
        if cost[i] < best:
            best, found = cost[i], (v, i + radius)
    return found


def grow(sample: np.ndarray, leaf: int, radius: int) -> list[tuple[int, int, int, int]]:
    """Nodes (vantage, mu, left, right); a leaf has mu -1 and its shard as left."""
    nodes: list[tuple[int, int, int, int]] = [(0, -1, 0, 0)]
    shards, todo = 0, [(0, sample)]
    while todo:
        at, points = todo.pop()
        found = split(points, radius) if len(points) > leaf else None
        if found is None:
            nodes[at] = (0, -1, shards, 0)
            shards += 1
            continue
        v, mu = found
        d = np.bitwise_count(points ^ v)
        nodes[at] = (int(v), mu, len(nodes), len(nodes) + 1)
        nodes += [(0, -1, 0, 0)] * 2
        # The boundary band belongs to the left here: only the placement of boundaries is wanted.
        todo += [(len(nodes) - 2, points[d <= mu]), (len(nodes) - 1, points[d > mu])]
    return nodes


def route(points: np.ndarray, nodes: list[tuple[int, int, int, int]], radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard, point) for every leaf that a point belongs to."""
    shard, found, todo = [], [], [(0, points)]
    while todo:
        at, p = todo.pop()
        v, mu, left, right = nodes[at]
        if not len(p):
            continue
        if mu < 0:
            shard.append(np.full(len(p), left, np.int32))
            found.append(p)
            continue
        d = np.bitwise_count(p ^ np.uint64(v)).astype(np.int16)
        todo += [(left, p[d <= mu]), (right, p[d > mu - radius])]
    if not shard:
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    return np.concatenate(shard), np.concatenate(found)


def exhaust(points: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct points, each looked at once."""
    out, rest = [], points
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            u = front.pop()
            hit = np.bitwise_count(rest ^ u) <= radius
            if hit.any():
                new = rest[hit]
                rest = rest[~hit]
                out += [(int(u), int(x)) for x in new]
                front += list(new)
    return out


def forest(points: np.ndarray, radius: int, leaf: int = LEAF) -> np.ndarray:
    """Links (a, b) that connect what the links among distinct points connect."""
    out, todo = [], [points]
    while todo:
        p = todo.pop()
        found = split(p, radius) if len(p) > leaf else None
        if found is None:
            out += exhaust(p, radius)
            continue
        v, mu = found
        d = np.bitwise_count(p ^ v).astype(np.int16)
        todo += [p[d <= mu], p[d > mu - radius]]
    return np.array(out, np.uint64).reshape(-1, 2)


def links(points: DataFrame, radius: int = 2, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """a, b: links that span the components of distinct points ``fp`` within the radius."""
    spark = points.sparkSession
    n = points.count()
    drawn = points.orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = grow(drawn, max(16, shard * len(drawn) // max(n, 1)), radius)
    leaves = sum(mu < 0 for _, mu, _, _ in tree)
    nodes = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, p = route(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), nodes.value, radius)
            yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(p.view(np.int64))], ["shard", "fp"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        p = np.unique(pdf["fp"].to_numpy(np.int64).view(np.uint64))
        return pd.DataFrame(forest(p, radius).view(np.int64), columns=["a", "b"])

    # A shard is few bytes and much work: one task each, which adaptive execution would merge by size otherwise.
    placed = points.select("fp").mapInArrow(place, "shard int, fp long").repartition(leaves, "shard")
    return placed.groupBy("shard").applyInPandas(search, "a long, b long").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, text: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach, its own included."""
    marked = spool(fingerprints(docs, text, width))
    points = spool(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    root = components(links(points, radius))
    joined = points.join(root, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    joined = spool(joined)
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = spool(joined.join(least, "root").select(F.col("fp").alias("f2"), "component_id"))
    return marked.join(classes, F.col("fp") == F.col("f2")).select("doc_id", "fp", "component_id")
