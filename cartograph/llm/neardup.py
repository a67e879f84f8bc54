"""Near-duplicate removal at a stated shingle similarity, on SimHash links and an exact search for the rest.

A single 64-bit fingerprint of a document can't promise a similarity of 0.8: such pairs lie about ten bits apart, where distance says
little. So documents whose fingerprints lie within RADIUS bits are linked first, with the vantage-point trees of simhash.py, and all other pairs are found by their shingles. Every link
is verified by the exact Jaccard similarity of the word 5-shingle sets. Texts that agree word for word are one node from the start, so groups of copies cost nothing.

1. Most documents have no partner. Each document shows a sample of its shingles, those with a hash below SHOWN / m of the range, m being their number, to the others; any partner has so similar an m
   that it shows them too. Of a document with a partner 80 percent of its shingles are shared, so documents of whose sample less than 35 percent is found anywhere else are left out. With 32 shingles the
   sample of a document with a partner falls that low less than once in 10 million; shorter documents show all.
2. Of the others, all shingles are counted. Sets of a and b shingles at similarity t share t / (1 + t) * (a + b), so they meet in their prefixes: the first m - ceil(t * m) + 1 shingles, rarest first. Shingles
   that no other document has come first and meet nobody; documents that hold too many have no prefix left. What remains are short lists of rare shingles, with the number of shingles behind each.
3. Rounds of stars: each document is compared with the centre of the group of its rarest shingle, and what is verified is merged. The first round's centres are the documents with the fewest
   shingles of their own, which in a group of edited copies is the text they stem from; later rounds draw them by hash.
4. All pairs of unlike components that share a prefix shingle and pass the bounds on sizes, places and parities, without a cap: per shingle, documents outside its largest component against all.
   A parity bitmap has a bit for how many shingles fall on it, modulo two; two bitmaps differ in at most as many bits as the sets differ in shingles, so a count of differing bits refutes a pair exactly. 512 bits are compared
   inside the join, where refuted pairs cost no row; wider ones, of at least 1.25 bits a shingle, before any text is fetched. What is left is verified on texts.

Rows of the table stay in the order of their group: the least (doc_id, then text hash) document of each component stays, null ids first. Null and blank texts are copies of one another. Repeated rows are copies:
one stays. Very long texts cost time and memory in proportion to their length; an empty table gives an empty table; all columns pass through, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.llm.components import components
from cartograph.llm.decontaminate import shingle_keys
from cartograph.llm.expr import attach, row_key
from cartograph.llm.simhash import links
from cartograph.runtime import drop_spool, spool

WIDTH, RADIUS = 5, 2
SHOWN, SHARED = 32, 0.35
ROUNDS = 4
PIECE = 1 << 16  # shingles whose bits are summed at once


def word_hashes(text: bytes) -> tuple[np.ndarray, bytes]:
    """(64-bit hash of each word, digest of the word sequence); words part at ASCII white space, A-Z lower-cased."""
    w = text.lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w)), hashlib.blake2b(b" ".join(w), digest_size=16).digest()


def shingles(words: np.ndarray) -> np.ndarray:
    """Shingle hashes in order; a shorter text is one shingle."""
    return shingle_keys(words.view(np.int64), min(WIDTH, len(words))) if len(words) else np.zeros(0, np.uint64)


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingles(word_hashes(text)[0]))


def fingerprint(keys: np.ndarray) -> int:
    """SimHash of shingle hashes, as a signed long."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(keys), PIECE):
        total += np.unpackbits(keys[i : i + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(keys), bitorder="little").view(np.int64)[0])


def mark(docs: DataFrame, text: str, threshold: float) -> DataFrame:
    """_id, _tx, d1, d2 (digest), fp, m (distinct shingles), own and more: the sample of its shingles that a document asks for, and what else it shows."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, fps, sizes, own, more = [], [], [], [], []
            for t in b.column(2).to_pylist():
                w, d = word_hashes(t or b"")
                keys = shingles(w)
                digests.append(d)
                fps.append(fingerprint(keys))
                keys = np.unique(keys)
                sizes.append(len(keys))
                share = SHOWN / max(len(keys), 1)
                a, z = (np.searchsorted(keys, np.uint64(min(x, 1.0) * (2**64 - 2048)), "right") if x < 1 else len(keys) for x in (share, share / threshold))
                own.append(keys[:a].view(np.int64))
                more.append(keys[a:z].view(np.int64))
            d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32()), pa.array(own, pa.list_(pa.int64())), pa.array(more, pa.list_(pa.int64()))],
                ["_id", "_tx", "d1", "d2", "fp", "m", "own", "more"],
            )

    return docs.select(*row_key(text=text), F.col(text).cast("binary")).mapInArrow(run, f"_id {kind}, _tx long, d1 long, d2 long, fp long, m int, own array<long>, more array<long>")


def seen_elsewhere(classes: DataFrame) -> DataFrame:
    """node: the nodes of whose sample at least the share SHARED is shown by some other node, too."""
    own = classes.select("node", "m", F.size("own").alias("asked"), F.explode("own").alias("h"))
    shown = own.select("h").unionByName(classes.select(F.explode("more").alias("h")))
    twice = spool(shown.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    found = own.join(twice, "h", "left_semi").groupBy("node").agg(F.count("*").alias("n"), F.first("asked").alias("asked"))
    return found.where(F.col("n") >= SHARED * F.col("asked")).select("node")


def packed(docs: DataFrame, text: str) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack(t or b"") for t in b.column(2).to_pylist()], pa.binary())], ["_id", "_tx", "t"])

    return docs.select(*row_key(text=text), F.col(text).cast("binary")).mapInArrow(run, f"_id {kind}, _tx long, t binary")


def unpack(texts: pa.Array) -> list[bytes]:
    return list(map(zstandard.ZstdDecompressor().decompress, texts.to_pylist()))


def prefixes(texts: DataFrame, threshold: float) -> DataFrame:
    """key, node, m, u, rest: the prefix of each node without the u shingles that no other node has; rest: shingles of the set from this one on."""
    kind = texts.schema["node"].dataType.simpleString()

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t).view(np.int64) for t in unpack(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array(sets, pa.list_(pa.int64()))], ["node", "m", "s"])

    each = texts.select("node", "t").mapInArrow(listed, f"node {kind}, m int, s array<long>").select("node", "m", F.explode("s").alias("h"))
    counts = spool(each.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"))
    shared = each.join(counts, "h").groupBy("node", "m").agg(F.array_sort(F.collect_list(F.struct(F.col("c").cast("int").alias("c"), "h"))).alias("s"))
    u = F.col("m") - F.size("s")
    length = F.col("m") - F.ceil(threshold * F.col("m") - 1e-9) + 1 - u
    some = shared.where(length > 0).select("node", "m", u.alias("u"), F.posexplode(F.slice("s", F.lit(1), length.cast("int"))).alias("i", "x"))
    return some.select(F.col("x.h").alias("key"), "node", "m", "u", (F.col("m") - F.col("u") - F.col("i")).alias("rest"))


def verified(texts: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b whose shingle sets are at least as similar as the threshold."""
    kind = texts.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once = functools.lru_cache(64)(shingle_set)
        for b in batches:
            keep = []
            for x, y in zip(unpack(b.column(2)), unpack(b.column(3)), strict=True):
                s, t = once(x), once(y)
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(common >= threshold * (len(s) + len(t) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}")


def relabelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """node, root after merging the components of the links found."""
    ra, rb = (nodes.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    moved = components(found.join(ra, "a").join(rb, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")))
    new = nodes.join(moved.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    out = spool(new)
    drop_spool(nodes)
    return out


NARROW, WIDEST = 512, 1 << 16  # bits of the parity bitmaps
PARITY = [f"p{i}" for i in range(NARROW // 64)]


def fold(bitmap: np.ndarray, size: int) -> np.ndarray:
    """A parity bitmap (bytes) of fewer bits, both powers of two."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, size // 8), axis=0)


def parity(keys: np.ndarray) -> np.ndarray:
    """Bytes of the parity bitmap of distinct shingle hashes; its size follows their number."""
    bits = NARROW
    while bits < min(1.25 * len(keys), WIDEST):
        bits *= 2
    return np.packbits((np.bincount((keys & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def parities(texts: DataFrame) -> DataFrame:
    """node, size (shingles), p0 to p7 (512 bits), wide."""
    kind = texts.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(t) for t in unpack(b.column(1))]
            wide = [parity(s) for s in sets]
            narrow = np.array([fold(w, NARROW).view(np.int64) for w in wide]).reshape(-1, len(PARITY))
            columns = [pa.array(narrow[:, i].copy()) for i in range(len(PARITY))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int32()), *columns, pa.array([w.tobytes() for w in wide], pa.binary())], ["node", "size", *PARITY, "wide"])

    return texts.select("node", "t").mapInArrow(run, f"node {kind}, size int, " + ", ".join(f"{c} long" for c in PARITY) + ", wide binary")


def unrefuted(pairs: DataFrame, bitmaps: DataFrame, threshold: float) -> DataFrame:
    """The pairs a, b whose wide bitmaps don't show them to be less similar than the threshold."""
    kind = bitmaps.schema["node"].dataType.simpleString()
    share = threshold / (1 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for m, n, x, y in zip(*(b.column(c).to_pylist() for c in ("ma", "mb", "wa", "wb")), strict=True):
                size = 8 * min(len(x), len(y))
                differ = fold(np.frombuffer(x, np.uint8), size) ^ fold(np.frombuffer(y, np.uint8), size)
                keep.append(int(np.bitwise_count(differ).sum()) <= (m + n) * (1 - 2 * share) + 1e-6)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    ends = [bitmaps.select(F.col("node").alias(x), F.col("size").alias(f"m{x}"), F.col("wide").alias(f"w{x}")) for x in "ab"]
    return pairs.join(ends[0], "a").join(ends[1], "b").select("a", "b", "ma", "mb", "wa", "wb").mapInArrow(run, f"a {kind}, b {kind}")


def alike(x: str, y: str, threshold: float):
    """Whether sets of x and y shingles can be as similar as the threshold."""
    return F.least(x, y) >= threshold * F.greatest(x, y) - 1e-9


def stars(rows: DataFrame, nodes: DataFrame, number: int, threshold: float) -> DataFrame:
    """a, b: each node of a component beside the centre's with the centre of its rarest shared group, at most one pair a node."""
    live = rows.join(nodes, "node")
    first = F.col("u") / F.col("m") if number == 0 else F.xxhash64("node", F.lit(number)).cast("double")
    centre = live.groupBy("key").agg(F.min(F.struct(first.alias("f"), "node", "root", "m")).alias("z"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    met = live.join(centre.select("key", "z"), "key").where(F.col("root") != F.col("z.root")).withColumn("zm", F.col("z.m")).where(alike("m", "zm", threshold))
    best = met.groupBy("node").agg(F.max(F.struct("rest", F.col("z.node").alias("centre"))).alias("best"))
    return best.select(F.col("node").alias("a"), F.col("best.centre").alias("b"))


def remaining(rows: DataFrame, nodes: DataFrame, bitmaps: DataFrame, threshold: float) -> DataFrame:
    """a, b: all pairs of nodes of unlike components that may be as similar as the threshold."""
    live = spool(rows.join(nodes, "node"))
    size = live.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("largest"), F.count("*").alias("roots")).where("roots > 1")
    open_rows = spool(live.join(size.select("key", "largest"), "key").join(bitmaps.select("node", *PARITY), "node"))
    drop_spool(live)
    share = threshold / (1 + threshold)
    a, b = (open_rows.select("key", "largest", F.col("node").alias(x), F.col("root").alias(f"r{x}"), F.col("m").alias(f"m{x}"), F.col("rest").alias(f"s{x}"), *[F.col(c).alias(c + x) for c in PARITY]) for x in "ab")
    both = F.col("ma") + F.col("mb")
    differ = functools.reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{c}a").bitwiseXOR(F.col(f"{c}b"))) for c in PARITY])
    may = alike("ma", "mb", threshold) & (F.least("sa", "sb") >= share * both - 1e-6) & (F.col("ra") != F.col("rb")) & (differ <= both * (1 - 2 * share) + 1e-6)
    met = a.where("ra <> largest").drop("largest").join(b.drop("largest"), "key").where(may)
    found = spool(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    drop_spool(open_rows)
    return found


def near_groups(docs: DataFrame, text: str = "text", threshold: float = 0.8, sample: bool = True) -> DataFrame:
    """_id, _tx, keep, copies: the row key of each document's group's least document, and how many rows share its key.

    Without ``sample`` no document is left out by the sample of step 1: the exact way, for several times the cost.
    """
    marks = spool(mark(docs, text, threshold))
    classes = spool(marks.groupBy("d1", "d2").agg(F.min(F.struct("_id", "_tx")).alias("node"), F.first("fp").alias("fp"), F.first("m").alias("m"), F.first("own").alias("own"), F.first("more").alias("more")))
    full = classes.where("m > 0")
    live = spool(seen_elsewhere(full) if sample else full.select("node"))
    texts = spool(attach(packed(docs, text), live.select("node._id", "node._tx"), "left_semi", "shuffle_hash").select(F.struct("_id", "_tx").alias("node"), "t").dropDuplicates(["node"]))

    # Nodes of one fingerprint, and of fingerprints within the radius.
    points = spool(full.groupBy("fp").agg(F.min("node").alias("lead")))
    same = full.join(points, "fp").where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b"))
    lead_a, lead_b = (points.select(F.col("fp").alias(x), F.col("lead").alias(f"l{x}")) for x in "ab")
    near = links(points.select("fp"), RADIUS).join(lead_a, "a").join(lead_b, "b").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
    found = spool(verified(texts, same.unionByName(near), threshold))
    nodes = relabelled(spool(live.select("node", F.col("node").alias("root"))), found)

    rows = spool(prefixes(texts, threshold))
    for number in range(ROUNDS):
        new = spool(verified(texts, stars(rows, nodes, number, threshold), threshold))
        if new.isEmpty():
            break
        nodes = relabelled(nodes, new)
        drop_spool(new)
    bitmaps = spool(parities(texts))
    pairs = remaining(rows, nodes, bitmaps, threshold)
    left = spool(unrefuted(pairs, bitmaps, threshold))
    new = spool(verified(texts, left, threshold))
    if not new.isEmpty():
        nodes = relabelled(nodes, new)
    group = classes.join(nodes.withColumnRenamed("node", "r"), F.col("node") == F.col("r"), "left").select("d1", "d2", F.coalesce("root", "node").alias("keep"))
    out = spool(marks.select("_id", "_tx", "d1", "d2").join(group, ["d1", "d2"]).groupBy("_id", "_tx").agg(F.min("keep").alias("keep"), F.count("*").alias("copies")))
    for table in (marks, classes, texts, rows, live, points, found, bitmaps, pairs, left, new, nodes):
        drop_spool(table)
    return out


def clean(docs: DataFrame, text: str = "text", threshold: float = 0.8) -> DataFrame:
    """One document of each group, all columns as they are."""
    groups = near_groups(docs, text, threshold)
    gone = groups.where(F.struct("_id", "_tx") != F.col("keep")).select("_id", "_tx")
    rows = docs.select(F.struct("*").alias("__row"), *row_key(text=text))
    out = attach(rows, gone, "left_anti", "shuffle_hash")
    if groups.where("copies > 1").limit(1).count():
        out = out.dropDuplicates(["_id", "_tx"])
    return out.select("__row.*")
