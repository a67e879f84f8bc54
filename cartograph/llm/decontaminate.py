"""Benchmark decontamination with SimHash windows and multi-index Hamming blocks.

Documents and benchmark items are compared by word 5-shingles, each weighted by its rarity among all items (log(1 + items / items that have it)). A window of a
document as long as an item is a copy of it if the weighted similarity of their shingles, the sum of the smaller over the sum of the larger counts, is at least
``threshold``. Windows get there in three steps, item size by item size:

1. Bound: a window that similar shares at least ``threshold`` of the item's weight, so windows whose shingles of items of that size weigh less are passed over. Running sums
   give the weight of every window; nothing is lost.
2. SimHash: the others get a weighted 64-bit SimHash of the shingles that they share with the benchmark, from running sums as well. The items' fingerprints are indexed by
   BLOCKS disjoint blocks of 16 bits. Two fingerprints within RADIUS bits differ by RADIUS // BLOCKS bits or fewer in some block, so looking up every value that near in each block finds all
   items in the radius.
3. Exact similarity of each window and candidate.

RADIUS leaves room for the spread of the estimate: at a similarity of 0.8 the fingerprints of shared shingles lie about 7 bits apart.

The benchmark is read to the driver in blocks of at most BLOCK_WORDS words (or one item), whatever its size; a block is arrays of about 60 bytes a word. Each block is
broadcast and searched against all rows in one pass without a shuffle. Rarity is counted by Spark over the whole benchmark. Words are runs of letters, digits and non-ASCII
characters, A-Z lower-cased. Items of fewer than five words are one shingle of all their words and must be found word for word; in shorter texts than an item the whole text is its window.
Null and empty items and texts match nothing. Of windows that tie the first counts. Repeated rows give repeated hits, and repeated items hits of their own. Texts are read in stretches, so very long ones cost 8 bytes
a word of memory. Empty tables give empty results; filtering keeps all columns as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cartograph.llm.licenses import split_words, word_hashes
from cartograph.runtime import spool

WIDTH = 5
BLOCKS, RADIUS = 4, 15
BLOCK_WORDS = 1_000_000
REGION = 4096  # windows fingerprinted at once
STRETCH = 1 << 20  # bytes of a text split at once
GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
HITS = 1 << 16  # shared shingles summed at once
#: All 16-bit values with up to RADIUS // BLOCKS bits.
NEAR = np.array(sorted(sum(1 << b for b in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(range(16), n)), np.uint16)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finish: spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_keys(ids: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit key of each ``width`` neighbouring word hashes."""
    n = len(ids) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    x = ids.view(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(width):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + x[j : j + n] + np.uint64(2))
    return key


def text_hashes(text: bytes) -> np.ndarray:
    """The word hashes of a text, split STRETCH bytes at a time."""
    parts, at = [np.zeros(0, np.uint64)], 0
    while at < len(text):
        m = GAP.search(text, at + STRETCH)
        end = m.start() if m else len(text)
        parts.append(word_hashes(split_words(text[at:end])))
        at = end
    return np.concatenate(parts)


def signed_bits(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """[key, 64]: the weight, negative where the bit is 0; in whole units, so that sums are exact in any order."""
    bits = np.unpackbits(keys.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int64)
    return (2 * bits - 1) * np.rint(weights * 1024).astype(np.int64)[:, None]


def packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64).ravel()


class Block:
    """Fingerprints of the items of one size, found by 16-bit blocks."""

    def __init__(self, items: np.ndarray, prints: np.ndarray) -> None:
        self.items, self.prints = items, prints
        parts = [self.part(prints, b) for b in range(BLOCKS)]
        self.order = [np.argsort(x, kind="stable").astype(np.int32) for x in parts]
        self.sorted = [x[o] for x, o in zip(parts, self.order, strict=True)]

    @staticmethod
    def part(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)

    def near(self, value: np.uint64) -> np.ndarray:
        """Numbers of the fingerprints within RADIUS bits of one, out of those that are near it in some block."""
        found = []
        for b, (order, values) in enumerate(zip(self.order, self.sorted, strict=True)):
            own = np.uint16((int(value) >> (16 * b)) & 0xFFFF)
            if len(values) <= 4 * len(NEAR):  # looking at each value is quicker than looking up each that is near
                found.append(order[np.bitwise_count(values ^ own) <= RADIUS // BLOCKS])
                continue
            a, z = np.searchsorted(values, NEAR ^ own, "left"), np.searchsorted(values, NEAR ^ own, "right")
            found += [order[x:y] for x, y in zip(a[z > a].tolist(), z[z > a].tolist(), strict=True)]
        k = np.unique(np.concatenate(found))
        return k[np.bitwise_count(self.prints[k] ^ value) <= RADIUS]


class Index:
    """One block of items: ids and word hashes of each; and its shingle keys, rising, with the number of items of the whole benchmark that have each."""

    def __init__(self, items: list[tuple[object, np.ndarray]], n_items: int, keys: np.ndarray, found_in: np.ndarray, threshold: float = 0.8) -> None:
        self.threshold = threshold
        self.ids = [i for i, _ in items]
        self.size = [len(h) for _, h in items]
        self.keys, self.weights = keys, np.log1p(n_items / found_in)
        self.rare = float(np.log1p(n_items))  # shingles that no item has
        self.short: dict[int, list[tuple[int, int]]] = defaultdict(list)
        places = [np.zeros(0, np.int64)] * len(items)
        by_size = defaultdict(list)
        for k, (_, h) in enumerate(items):
            x = shingle_keys(h, min(WIDTH, len(h)))
            if len(h) < WIDTH:
                self.short[len(h)].append((int(x[0]), k))
            else:
                places[k] = np.searchsorted(keys, x)
                by_size[len(x)].append(k)
        self.total = np.array([self.weights[p].sum() for p in places])
        self.sizes, of_key = {}, []
        for n, (size, some) in enumerate(sorted(by_size.items())):
            prints = packed(np.stack([signed_bits(keys[places[k]], self.weights[places[k]]).sum(axis=0) for k in some]))
            self.sizes[n] = (size, Block(np.array(some), prints), float(self.total[some].min()))
            own = np.unique(np.concatenate([places[k] for k in some]))
            of_key.append(np.stack([own, np.full(len(own), n)], axis=1))
        # Which sizes have a key: rows sorted by key.
        pairs = np.concatenate([np.zeros((0, 2), np.int64), *of_key])
        pairs = pairs[np.argsort(pairs[:, 0], kind="stable")].astype(np.int32)
        self.key_sizes, self.key_starts = pairs[:, 1].copy(), np.searchsorted(pairs[:, 0], np.arange(len(keys) + 1)).astype(np.int32)
        # Each item's distinct keys and their counts.
        each = [np.unique(p, return_counts=True) for p in places]
        self.item_starts = np.cumsum([0, *[len(q) for q, _ in each]])
        self.item_keys = np.concatenate([np.zeros(0, np.int64), *[q for q, _ in each]]).astype(np.int32)
        self.item_counts = np.concatenate([np.zeros(0, np.int64), *[n for _, n in each]]).astype(np.int32)

    def similarity(self, window: np.ndarray, counts: np.ndarray, weight: float, item: int) -> float:
        """window: distinct known keys of a window, rising, with their counts; weight: of all its shingles."""
        at = slice(self.item_starts[item], self.item_starts[item + 1])
        q, mine, theirs = np.intersect1d(window, self.item_keys[at], assume_unique=True, return_indices=True)
        low = float((self.weights[q] * np.minimum(counts[mine], self.item_counts[at][theirs])).sum())
        high = float(self.total[item]) + weight - low
        return low / high if high else 0.0

    def search(self, text: bytes) -> dict[int, tuple[float, int, int]]:
        """Item number to (similarity, first word, distance) of its best window."""
        h = text_hashes(text)
        best: dict[int, tuple[float, int, int]] = {}
        for n, short in self.short.items():
            keys = shingle_keys(h, n)
            for q, k in short:
                at = np.flatnonzero(keys == np.uint64(q))
                if len(at):
                    best[k] = (1.0, int(at[0]), 0)
        keys = shingle_keys(h, WIDTH)
        if not len(keys) or not len(self.keys):
            return best
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hits = np.flatnonzero(self.keys[place] == keys)
        if not len(hits):
            return best
        known = place[hits]
        weight = np.full(len(keys), self.rare)
        weight[hits] = self.weights[known]
        sums = np.concatenate([[0.0], np.cumsum(weight)])
        # Each hit once for every size that has its key.
        first = self.key_starts[known]
        n = self.key_starts[known + 1] - first
        hit = np.repeat(np.arange(len(hits)), n)
        size = self.key_sizes[np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        for x in np.unique(size).tolist():
            self.search_size(keys, hits, known, sums, hit[size == x], *self.sizes[x], best)
        return best

    def search_size(self, keys: np.ndarray, hits: np.ndarray, known: np.ndarray, sums: np.ndarray, mine: np.ndarray, size: int, block: Block, least: float, best: dict) -> None:
        """Windows of one size, in rising order of their starts; mine: the hits of this size."""
        width = min(size, len(keys))
        p = hits[mine]
        # Windows that hold a hit of this size. One cut short by the end of the text starts earlier.
        first = np.maximum(np.maximum(p - size + 1, 0), np.concatenate([[0], p[:-1] + 1]))
        n = p + 1 - first
        starts = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        starts = np.unique(np.minimum(starts, len(keys) - width))
        shared = np.concatenate([[0.0], np.cumsum(self.weights[known[mine]])])
        held = shared[np.searchsorted(p, starts + width)] - shared[np.searchsorted(p, starts)]
        starts = starts[held >= self.threshold * least - 1e-6]
        a, z = np.searchsorted(hits, starts), np.searchsorted(hits, starts + width)
        i = 0
        while i < len(starts):
            # As many windows as hold HITS hits in all, or one.
            j = min(i + REGION, max(i + 1, int(np.searchsorted(z, a[i] + HITS, "right"))), len(starts))
            lo, hi = int(a[i]), int(z[j - 1])
            part = known[lo:hi]
            total = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(signed_bits(self.keys[part], self.weights[part]), axis=0)])
            prints = packed(total[z[i:j] - lo] - total[a[i:j] - lo])
            for n, value in zip(range(i, j), prints, strict=True):
                near = block.near(value)
                if not len(near):
                    continue
                window, counts = np.unique(known[a[n] : z[n]], return_counts=True)
                s = int(starts[n])
                for k, distance in zip(block.items[near].tolist(), np.bitwise_count(block.prints[near] ^ value).tolist(), strict=True):
                    x = self.similarity(window, counts, float(sums[s + width] - sums[s]), k)
                    if x >= self.threshold - 1e-9 and (k not in best or x > best[k][0] + 1e-9):
                        best[k] = (min(x, 1.0), s, distance)
            i = j


def item_table(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    """item, hashes: word hashes of the items that have words."""
    kind = benchmark.schema[item].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [text_hashes(t or b"").view(np.int64) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["item", "hashes"])

    return benchmark.select(F.col(item).alias("item"), F.col(text).cast("binary").alias("t")).mapInArrow(run, f"item {kind}, hashes array<long>").where("size(hashes) > 0")


def rarity(items: DataFrame) -> DataFrame:
    """key, found_in: in how many items each shingle of five words is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_keys(np.array(h, np.int64), WIDTH)).view(np.int64))], ["key"])

    return items.select("hashes").mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("found_in"))


def blocks(benchmark: DataFrame, item: str, text: str, threshold: float, limit: int = BLOCK_WORDS) -> Iterator[Index]:
    """The benchmark as indexes of at most ``limit`` words (or one item)."""
    spark = benchmark.sparkSession
    items = spool(item_table(benchmark, item, text))
    n_items, n_words = items.agg(F.count("*"), F.sum(F.size("hashes"))).first()
    if not n_items:
        return
    counts = spool(rarity(items))

    def index(part: list[tuple[object, np.ndarray]]) -> Index:
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *[shingle_keys(h, WIDTH) for _, h in part]]))
        asked = counts
        if n_words > limit:  # this block's keys only
            asked = counts.join(spark.createDataFrame(pa.table({"key": keys.view(np.int64)})), "key", "left_semi")
        found = asked.toArrow()
        k, c = found["key"].to_numpy().view(np.uint64), found["found_in"].to_numpy()
        order = np.argsort(k)
        return Index(part, n_items, k[order], c[order], threshold)

    part, n = [], 0
    for row in items.orderBy("item", F.xxhash64("hashes")).toLocalIterator():
        if part and n + len(row[1]) > limit:
            yield index(part)
            part, n = [], 0
        part.append((row[0], np.array(row[1], np.int64)))
        n += len(row[1])
    yield index(part)


def leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = 0.8, limit: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, similarity, first_word, n_words, distance: an item's best window in each document that has one."""
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"doc_id {kind}, item_id {item_kind}, similarity double, first_word long, n_words long, distance int"
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    out = docs.sparkSession.createDataFrame([], schema)
    for index in blocks(benchmark, item, item_text, threshold, limit):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            x = shared.value
            for b in batches:
                found = [(i, k, hit) for i, t in enumerate(b.column(1).to_pylist()) if t for k, hit in sorted(x.search(t).items())]
                ids = pa.array([x.ids[k] for _, k, _ in found], item_type)
                rows = pa.array([i for i, _, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), ids, pa.array([h[0] for *_, h in found], pa.float64()), pa.array([h[1] for *_, h in found], pa.int64()), pa.array([x.size[k] for _, k, _ in found], pa.int64()), pa.array([h[2] for *_, h in found], pa.int32())],
                    ["doc_id", "item_id", "similarity", "first_word", "n_words", "distance"],
                )

        out = out.unionByName(docs.select("doc_id", F.col(text).cast("binary")).mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", threshold: float = 0.8, limit: int = BLOCK_WORDS) -> DataFrame:
    """The documents in which no item is found; one pass a block of the benchmark, no shuffle."""
    at = docs.columns.index(text)
    for index in blocks(benchmark, item, item_text, threshold, limit):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield b.filter(pa.array([not t or not shared.value.search(t.encode()) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
