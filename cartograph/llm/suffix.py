"""Suffix sorting for exact repeats of at least LENGTH bytes, across and within documents.

A byte is removed if some LENGTH-byte string that covers it starts anywhere else too. Sorting all suffixes of the corpus in
one place is out of reach, so suffixes are first dealt to shards by content: every LENGTH-byte window has an anchor, the
leftmost of its GRAM-byte grams with the least hash. Equal windows have equal anchors at equal offsets, so repeats meet
where their anchor's hash does, and anchors (one in about 85 bytes) whose hash is unique are dropped at once. The context of an anchor, all
windows that hold it, is at most 2 * LENGTH - GRAM bytes. Copies of a context, known by a 128-bit BLAKE2 digest, are repeated as a whole and take part once. Where
an anchor has several contexts, those are sorted with the others of its shard:

- prefix polynomial hashes of the contexts make any substring's hash a subtraction;
- the common extension of two suffixes is found by binary search on those hashes, so a comparison takes a logarithmic
  number of steps;
- a mergesort with that comparison sorts the suffixes at the anchors; the suffixes one byte to the left follow by a stable
  pass over that byte, and so on to the left end of the contexts;
- neighbours in an order with equal window hashes are repeats, and their bytes are compared before they count.

No shard has over MOST contexts: a larger one is parted by more content. Its windows begin 0 to REACH bytes before the anchor; those that begin in one half of this range
all hold certain bytes around the anchor, and so do those of the other half. Each context goes to a shard of either half by these bytes, and so on for what is still too
large. Where the range is one offset, the windows are the bytes themselves, and Spark groups them.

Texts are bytes of UTF-8; null counts as empty. Repeated rows are repeats of one another, ties don't arise, and an empty table gives an empty table. Very long texts are hashed in
pieces and cost time and memory in proportion to their length. Only doc_id and the text are read, so extra columns can't clash. Documents with no repeat are
never moved after the first join; intermediate tables are in the shared folder.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.llm.decontaminate import mix
from cartograph.llm.expr import attach, row_key
from cartograph.runtime import spool

LENGTH, GRAM = 200, 32
REACH = LENGTH - GRAM  # bytes that a window may begin before its anchor
PIECE = 1 << 19
SHARD = 4096  # contexts of small shards sorted at once
MOST = 20_000  # contexts in one shard, about 80 MB of a worker's memory
ROOT = 0x9E3779B97F4A7C15 | 1


@functools.lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ROOT ** -i and ROOT ** i modulo 2 ** 64 for i < n."""
    down, up = np.full(n, pow(ROOT, -1, 1 << 64), np.uint64), np.full(n, ROOT, np.uint64)
    down[0] = up[0] = 1
    return np.multiply.accumulate(down), np.multiply.accumulate(up)


#: A pseudo-random value for each byte.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position, from prefix polynomial hashes."""
    down, up = powers(PIECE + 2 * LENGTH + 1)
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTES[data] * down[: len(data)])])
    n = len(data) - GRAM + 1
    return mix((prefix[GRAM:] - prefix[:n]) * up[:n])


def anchors(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all windows of a text."""
    n_all = len(text) - LENGTH + 1
    if n_all <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pos, hashes = [], []
    for at in range(0, n_all, PIECE):
        n = min(PIECE, n_all - at)  # windows of this piece
        h = gram_hashes(np.frombuffer(text, np.uint8, n + LENGTH - 1, at))
        # The low bits give way to the position: of equal hashes the leftmost is least.
        key = (h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64)
        w = REACH + 1
        rows = -(-len(key) // w)
        grid = np.full(rows * w, ~np.uint64(0), np.uint64)
        grid[: len(key)] = key
        grid = grid.reshape(rows, w)
        before = np.minimum.accumulate(grid, axis=1).ravel()
        after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(after[:n], before[w - 1 : w - 1 + n]) & np.uint64((1 << 20) - 1)
        a = least[np.concatenate([[True], np.diff(least.astype(np.int64)) != 0])].astype(np.int64)
        pos.append(a + at)
        hashes.append(h[a].view(np.int64))
    p, h = np.concatenate(pos), np.concatenate(hashes)
    new = np.concatenate([[True], np.diff(p) != 0])
    return p[new], h[new]


def anchor_table(docs: DataFrame, text: str) -> DataFrame:
    """_id, _tx, n_bytes, sha, pos, h: one row a document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(2).to_pylist()]
            found = [anchors(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array([p.astype(np.int32) for p, _ in found], pa.list_(pa.int32())), pa.array([h for _, h in found], pa.list_(pa.int64()))],
                ["_id", "_tx", "n_bytes", "sha", "pos", "h"],
            )

    rows = docs.select(*row_key(text=text), F.col(text).cast("binary"))
    return rows.mapInArrow(run, f"_id {kind}, _tx long, n_bytes long, sha binary, pos array<int>, h array<long>")


def packed(docs: DataFrame, text: str) -> DataFrame:
    """_id, _tx, t: the texts compressed, as they are shuffled up to three times."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([pack(t or b"") for t in b.column(2).to_pylist()], pa.binary())], ["_id", "_tx", "t"])

    return docs.select(*row_key(text=text), F.col(text).cast("binary")).mapInArrow(run, f"_id {kind}, _tx long, t binary")


def unpack(texts: pa.Array) -> list[bytes]:
    return list(map(zstandard.ZstdDecompressor().decompress, texts.to_pylist()))


def context(text: bytes, at: int) -> tuple[int, bytes]:
    """(bytes before the anchor, context)."""
    left = min(REACH, at)
    return left, text[at - left : at + LENGTH]


def digest(left: int, body: bytes) -> bytes:
    return hashlib.blake2b(body, digest_size=16, salt=left.to_bytes(2, "big")).digest()


def context_table(work: DataFrame, kind: str) -> DataFrame:
    """_id, _tx, pos, left, size, h, c1, c2 of the repeated anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, pos, left, size, grams, digests = [], [], [], [], [], []
            for i, (t, at) in enumerate(zip(unpack(b.column(2)), b.column(3).to_pylist(), strict=True)):
                for a in at:
                    before, body = context(t, a)
                    row.append(i)
                    pos.append(a)
                    left.append(before)
                    size.append(len(body))
                    digests.append(digest(before, body))
                grams.append(gram_hashes_at(t, np.array(at, np.int64)))
            if not row:
                continue
            d, rows = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2), pa.array(row, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(rows), b.column(1).take(rows), pa.array(pos, pa.int32()), pa.array(left, pa.int32()), pa.array(size, pa.int32()), pa.array(np.concatenate(grams)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy())],
                ["_id", "_tx", "pos", "left", "size", "h", "c1", "c2"],
            )

    return work.mapInArrow(run, f"_id {kind}, _tx long, pos int, left int, size int, h long, c1 long, c2 long")


def gram_hashes_at(text: bytes, at: np.ndarray) -> np.ndarray:
    """The hashes of the grams at some positions, each as anchors() has it."""
    data = np.frombuffer(text, np.uint8)
    grams = data[at[:, None] + np.arange(GRAM)]
    down, _ = powers(PIECE + 2 * LENGTH + 1)
    return mix((BYTES[grams] * down[:GRAM]).sum(axis=1, dtype=np.uint64)).view(np.int64)


class Contexts:
    """Contexts in a grid with the anchors in column REACH, and their suffix orders."""

    def __init__(self, left: np.ndarray, bodies: list[bytes]) -> None:
        self.n, self.left = len(bodies), left
        size = np.fromiter(map(len, bodies), np.int64, self.n)
        self.right = size - left
        self.grid = np.zeros((self.n, REACH + LENGTH), np.uint8)
        for row, (before, body) in enumerate(zip(left.tolist(), bodies, strict=True)):
            self.grid[row, REACH - before : REACH - before + len(body)] = np.frombuffer(body, np.uint8)
        down, _ = powers(PIECE + 2 * LENGTH + 1)
        self.prefix = np.zeros((self.n, REACH + LENGTH + 1), np.uint64)
        np.cumsum(BYTES[self.grid] * down[: REACH + LENGTH], axis=1, out=self.prefix[:, 1:])
        self.tail = self.prefix[:, REACH:] - self.prefix[:, REACH : REACH + 1]  # hash of the first i bytes from the anchor

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common length of the suffixes at two anchors, by binary search on prefix hashes."""
        low, high = np.zeros(len(i), np.int64), np.minimum(self.right[i], self.right[j])
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.tail[i, mid] == self.tail[j, mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether suffix i comes before suffix j; the shorter first, equal ones by number."""
        k = self.extension(i, j)
        end = np.minimum(self.right[i], self.right[j])
        column = REACH + np.minimum(k, LENGTH - 1)
        by_byte = self.grid[i, column] < self.grid[j, column]
        return np.where(k < end, by_byte, (self.right[i] < self.right[j]) | ((self.right[i] == self.right[j]) & (i < j)))

    def mergesort(self) -> np.ndarray:
        """The order of the suffixes at the anchors; all merges of a level run side by side."""
        order, width = np.arange(self.n), 1
        while width < self.n:
            at = np.arange(self.n)
            base = at // (2 * width) * (2 * width)
            first = at - base < width
            other = np.where(first, np.minimum(base + width, self.n), base)  # the run to rank against
            stop = np.where(first, np.minimum(base + 2 * width, self.n), np.minimum(base + width, self.n))
            low, high = other.copy(), stop.copy()
            while (todo := np.flatnonzero(low < high)).size:
                mid = (low[todo] + high[todo]) >> 1
                less = self.before(order[mid], order[todo])
                low[todo] = np.where(less, mid + 1, low[todo])
                high[todo] = np.where(less, high[todo], mid)
            own = at - np.where(first, base, base + width)
            merged = np.empty_like(order)
            merged[base + own + (low - other)] = order
            order, width = merged, 2 * width
        return order

    def repeated(self, low: int = 0, high: int = REACH) -> np.ndarray:
        """[context, l]: whether the window that begins l bytes before the anchor, low <= l <= high, is another context's too."""
        order = self.mergesort()
        found = np.zeros((self.n, REACH + 1), bool)
        for before in range(high + 1):
            column = REACH - before
            if before:
                order = order[self.left[order] >= before]
                order = order[np.argsort(self.grid[order, column], kind="stable")]
            if before < low:
                continue
            fits = order[self.right[order] >= LENGTH - before]
            if len(fits) < 2:
                continue
            h = self.prefix[fits, column + LENGTH] - self.prefix[fits, column]
            twin = np.flatnonzero(h[1:] == h[:-1])
            if len(twin):
                a, b = fits[twin], fits[twin + 1]
                real = (self.grid[a, column : column + LENGTH] == self.grid[b, column : column + LENGTH]).all(axis=1)
                found[a[real], before] = found[b[real], before] = True
        return found


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """Covered byte ranges relative to the anchor, given the flags of one context."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    part = np.flatnonzero(np.diff(at) > 1)
    first, last = at[np.concatenate([[0], part + 1])], at[np.concatenate([part, [len(at) - 1]])]
    return [(-int(b), LENGTH - int(a)) for a, b in zip(first, last, strict=True)]


SPANS = "h long, c1 long, c2 long, lo int, hi int"
SHARD_KEY = ["low", "high", "s1", "s2"]


def sort_shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts sorted by shard in, covered ranges of each out; a shard's contexts stay together, and whole shards of one range are sorted side by side."""
    held: list[pd.DataFrame] = []

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.reset_index(drop=True)
        flags = Contexts(part["left"].to_numpy(np.int64), part["body"].tolist()).repeated(int(part["low"].iloc[0]), int(part["high"].iloc[0]))
        out = [(i, lo, hi) for i in np.flatnonzero(flags.any(axis=1)).tolist() for lo, hi in runs(flags[i])]
        i = [x[0] for x in out]
        return part.loc[i, ["h", "c1", "c2"]].assign(lo=np.array([x[1] for x in out], np.int32), hi=np.array([x[2] for x in out], np.int32))

    def pieces(part: pd.DataFrame, end: bool) -> Iterator[pd.DataFrame]:
        """Solves all shards but the last, which may go on, and the last one too at the end; holds back the rest."""
        key = part[SHARD_KEY].to_numpy()
        new = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        other = set((np.flatnonzero((key[1:, :2] != key[:-1, :2]).any(axis=1)) + 1).tolist())
        edges = [*new.tolist(), *([len(part)] if end else [])]
        done = 0
        for i, e in enumerate(edges):
            if e in other or i + 1 == len(edges) or edges[i + 1] - done > SHARD:
                yield solve(part.iloc[done:e])
                done = e
        held[:] = [part.iloc[done:]] if done < len(part) else []

    for b in batches:
        if len(b):
            held.append(b)
        if sum(map(len, held)) >= SHARD:
            yield from pieces(pd.concat(held, ignore_index=True), False)
    if held:
        yield from pieces(pd.concat(held, ignore_index=True), True)


def parted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each context in the shards of both halves of its range, as far as it has windows there."""
    for b in batches:
        rows = []
        for h, c1, c2, left, body, low, high in zip(*(b[c] for c in ("h", "c1", "c2", "left", "body", "low", "high")), strict=True):
            mid = (low + high) // 2
            for a, z in ((low, mid), (mid + 1, high)):
                if max(a, LENGTH - (len(body) - left)) <= min(z, left):
                    core = body[left - a : left + LENGTH - z]  # in every window that begins a to z bytes before the anchor
                    d = hashlib.blake2b(core, digest_size=16, salt=a.to_bytes(2, "big") + z.to_bytes(2, "big")).digest()
                    rows.append((h, c1, c2, left, body, a, z, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)))
        yield pd.DataFrame(rows, columns=["h", "c1", "c2", "left", "body", *SHARD_KEY])


def alike(contexts: DataFrame) -> DataFrame:
    """Covered ranges of contexts with a range of one offset: their windows are grouped as bytes."""
    window = F.substring(F.col("body"), F.col("left") - F.col("low") + 1, F.lit(LENGTH))
    rows = contexts.select("h", "c1", "c2", "low", window.alias("w"))
    twice = rows.groupBy("low", "w").agg(F.count("*").alias("n")).where("n > 1").select("low", "w")
    return rows.join(twice, ["low", "w"]).select("h", "c1", "c2", (-F.col("low")).alias("lo"), (LENGTH - F.col("low")).alias("hi"))


def sorted_spans(shown: DataFrame) -> DataFrame:
    """Covered ranges of the distinct contexts h, c1, c2, left, body; m: contexts of the same anchor hash."""
    whole = [F.lit(0).alias("low"), F.lit(REACH).alias("high"), F.col("h").alias("s1"), F.lit(0).cast("long").alias("s2")]
    todo = shown.select("h", "c1", "c2", "left", "body", "m", *whole)
    parts = []

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.drop("m").repartition(*SHARD_KEY).sortWithinPartitions(*SHARD_KEY).mapInPandas(sort_shards, SPANS)

    while True:
        parts.append(dealt(todo.where(F.col("m") <= MOST)))
        big = todo.where(F.col("m") > MOST).drop("m")
        if big.isEmpty():
            break
        parts.append(alike(big.where("low = high")))
        halves = spool(big.where("low < high").mapInPandas(parted, "h long, c1 long, c2 long, left int, body binary, low int, high int, s1 long, s2 long"))
        size = spool(halves.groupBy(*SHARD_KEY).agg(F.count("*").alias("m")).where("m > 1"))  # alone in its shard: no repeat
        todo = halves.join(size, SHARD_KEY)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return spool(out)


def cut(text: bytes, spans: list) -> tuple[bytes, int]:
    """(what is left, maximal removed runs) for rising spans (start, end) that may overlap or touch."""
    kept, at, n = [], 0, 0
    last = -1
    for start, end in spans:
        if start > last:
            n += 1
            kept.append(text[at:start])
        at = last = max(at, end)
    kept.append(text[at:])
    return b"".join(kept), n


def repeated_spans(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(anchor table, documents that have repeated anchors with their text, spans as _id, _tx, start, end)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    table = spool(anchor_table(docs, text))
    each = table.select("_id", "_tx", F.explode(F.arrays_zip("pos", "h")).alias("a")).select("_id", "_tx", F.col("a.pos").alias("pos"), F.col("a.h").alias("h"))
    # Written first, so that the join below has a plain exchange on either side and its hot keys can be split.
    twice = spool(each.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    listed = each.join(twice, "h", "left_semi").groupBy("_id", "_tx").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    work = spool(attach(packed(docs, text), listed, "inner", "shuffle_hash").select("_id", "_tx", "t", "at"))
    contexts = spool(context_table(work, kind))

    group = contexts.groupBy("h", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct("_id", "_tx", "pos")).alias("r"))
    group = spool(group)
    several = spool(group.groupBy("h").agg(F.count("*").alias("m")).where("m > 1"))
    chosen = group.join(several, "h").select(F.col("r._id").alias("_id"), F.col("r._tx").alias("_tx"), F.col("r.pos").alias("pos"), "m")
    wanted = chosen.groupBy("_id", "_tx").agg(F.array_sort(F.collect_set(F.struct("pos", "m"))).alias("want"))
    # Rows that share a key share their text: either of them shows the contexts.
    source = attach(work, wanted, "inner", "shuffle_hash").select("_id", "_tx", "t", F.col("want.pos").alias("p"), F.col("want.m").alias("m"))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, body, ms, grams = [], [], [], []
            for t, at, m in zip(unpack(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                for a in at:
                    x, y = context(t, a)
                    left.append(x)
                    body.append(y)
                ms += m
                grams.append(gram_hashes_at(t, np.array(at, np.int64)))
            if not left:
                continue
            d = np.frombuffer(b"".join(digest(x, y) for x, y in zip(left, body, strict=True)), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams)), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(left, pa.int32()), pa.array(ms, pa.int64()), pa.array(body, pa.binary())], ["h", "c1", "c2", "left", "m", "body"])

    shown = spool(source.mapInArrow(bodies, "h long, c1 long, c2 long, left int, m long, body binary"))
    shown = shown.dropDuplicates(["h", "c1", "c2"]) if docs_repeat(work) else shown
    partial = sorted_spans(shown)
    part = contexts.join(partial, ["h", "c1", "c2"]).select("_id", "_tx", (F.col("pos") + F.col("lo")).alias("start"), (F.col("pos") + F.col("hi")).alias("end"))
    whole = contexts.where(F.col("size") >= LENGTH).join(group.where("n > 1").select("h", "c1", "c2"), ["h", "c1", "c2"], "left_semi")
    whole = whole.select("_id", "_tx", (F.col("pos") - F.col("left")).alias("start"), (F.col("pos") - F.col("left") + F.col("size")).alias("end"))
    return table, work, part.unionByName(whole)


def docs_repeat(work: DataFrame) -> bool:
    """Whether some row key is not unique, so that a context may be shown twice."""
    return work.groupBy("_id", "_tx").count().where("count > 1").limit(1).count() > 0


def dedup_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary, null where nothing is removed), kept_sha256, spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    table, work, spans = repeated_spans(docs, text)
    listed = spans.groupBy("_id", "_tx").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("s"))
    joined = attach(work.select("_id", "_tx", "t"), listed, "inner", "shuffle_hash").select("_id", "_tx", "t", F.col("s.start").alias("a"), F.col("s.end").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, x, y = unpack(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist()
            out = [(len(d), *cut(d, list(zip(p, q, strict=True)))) for d, p, q in zip(t, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([n - len(k) for n, k, _ in out], pa.int64()), pa.array([r for *_, r in out], pa.int64()), pa.array([k for _, k, _ in out], pa.binary()), pa.array([hashlib.sha256(k).digest() for _, k, _ in out], pa.binary())],
                ["_id", "_tx", "n_removed", "n_spans", "kept", "new_sha"],
            )

    cut_rows = joined.mapInArrow(run, f"_id {kind}, _tx long, n_removed long, n_spans long, kept binary, new_sha binary")
    cut_rows = cut_rows.groupBy("_id", "_tx").agg(*[F.first(c).alias(c) for c in ("n_removed", "n_spans", "kept", "new_sha")]) if docs_repeat(work) else cut_rows
    out = attach(table.select("_id", "_tx", "n_bytes", "sha"), cut_rows)
    return out.select(
        F.col("_id").alias("doc_id"), "n_bytes", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"),
        "kept", F.lower(F.hex(F.coalesce("new_sha", "sha"))).alias("kept_sha256"),
    )
