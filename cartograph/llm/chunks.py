"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 16 bytes names cut candidates wherever its upper bits are zero; a candidate
counts if the one before is at least MIN bytes away and a character begins there. Cuts depend on the bytes just before them
and on nothing else, so an insertion moves the cuts around it only, and a passage is cut alike
wherever it stands. A first or last chunk under MIN bytes is part of its neighbour. Chunks over MAX bytes are parted at
multiples of MAX from their start, the last part taking up to MIN bytes of the one before. Every chunk of at least
``least`` bytes, by default all, is known by a 128-bit digest, so that a copy of a text loses all its bytes. Chunks found twice or more count where they stand in an unbroken stretch of such chunks of ``run`` bytes, or one that is the
whole text, so that phrases of a line or two stay; of those, all but the first occurrence (smallest doc_id, then position) are removed. Counting and choosing the first use partial aggregation, so frequent chunks meet as one row per task,
and adaptive execution splits their side of the join that marks occurrences. Chunks are cut once, into a table; texts move once.

A null text counts as empty and has no chunks. Rows that share doc_id and text are one document and lose the same chunks; a null doc_id ranks first, and of
equal ids the lesser text hash. Ties end there. Very long texts are hashed in pieces. An empty table gives an empty table. Only doc_id and the text are
read, so extra columns can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.llm.expr import attach, row_key
from cartograph.runtime import spool

MIN, MAX, BITS = 16, 256, 5
RUN = 128  # bytes that a stretch of repeated chunks has at least
PIECE = 1 << 22  # bytes hashed at once


def gear_table(seed: int = 1) -> np.ndarray:
    """256 16-bit values from the splitmix64 generator."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, 257, dtype=np.uint64) + np.uint64(256 * seed)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (z >> np.uint64(48)).astype(np.uint16)


GEAR = gear_table()


def gear(data: np.ndarray) -> np.ndarray:
    """The 16-bit gear hash after each byte: h = (h << 1) + GEAR[byte], by doubling the window."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        nxt = h.copy()
        nxt[k:] += h[:-k] << np.uint16(k) if len(h) > k else h[:0]
        h = nxt
    return h


def cuts(text: bytes) -> np.ndarray:
    """Chunk bounds of a text, 0 and its length included; an empty text has none."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    data = np.frombuffer(text, np.uint8)
    found = []
    for at in range(0, n, PIECE):
        low = max(0, at - 15)
        hit = (gear(data[low : at + PIECE])[at - low :] >> np.uint16(16 - BITS)) == 0
        found.append(np.flatnonzero(hit) + at + 1)
    begins = (data & 0xC0) != 0x80
    c = np.concatenate(found)
    c = c[(c < n)]
    c = c[begins[c]]
    if len(c):
        c = c[np.diff(c, prepend=-MIN) >= MIN]
        c = c[(c >= MIN) & (n - c >= MIN)]  # a short first or last chunk is part of its neighbour
    bounds = np.concatenate([[0], c, [n]])
    long = np.flatnonzero(np.diff(bounds) > MAX)
    if len(long):
        more = []
        for i in long:
            for p in range(int(bounds[i]) + MAX, int(bounds[i + 1]), MAX):
                p = min(p, int(bounds[i + 1]) - MIN)
                while p < bounds[i + 1] and not begins[p]:
                    p += 1
                more.append(p)
        bounds = np.unique(np.concatenate([bounds, np.array(more, np.int64)]))
    return bounds


def chunk_arrays(docs: DataFrame, text: str = "text", least: int = 1) -> DataFrame:
    """_id, _tx, chunks (start, size, d1, d2): one row a document with its chunks of at least ``least`` bytes in order."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = [("start", pa.int32()), ("size", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts, digest, ends = [np.zeros((0, 2), np.int64)], [], [0]
            for t in b.column(2).to_pylist():
                bounds = cuts(t or b"")
                span = np.diff(bounds)
                keep = span >= least
                s, z = bounds[:-1][keep], span[keep]
                parts.append(np.stack([s, z], axis=1))
                digest += [hashlib.blake2b(t[x:y], digest_size=16).digest() for x, y in zip(s.tolist(), (s + z).tolist(), strict=True)]
                ends.append(len(digest))
            places, d = np.concatenate(parts).astype(np.int32), np.frombuffer(b"".join(digest), "<i8").reshape(-1, 2)
            columns = [places[:, 0], places[:, 1], d[:, 0], d[:, 1]]
            each = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x), k) for x, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], ["_id", "_tx", "chunks"])

    rows = docs.select(*row_key(text=text), F.col(text).cast("binary"))
    return rows.mapInArrow(run, f"_id {kind}, _tx long, chunks array<struct<start:int,size:int,d1:long,d2:long>>")


def chunk_table(arrays: DataFrame) -> DataFrame:
    """_id, _tx, start, size, d1, d2 of every chunk; repeated rows count once."""
    twice = arrays.groupBy("_id", "_tx").count().where("count > 1")
    arrays = arrays if twice.isEmpty() else arrays.dropDuplicates(["_id", "_tx"])
    return arrays.select("_id", "_tx", F.explode("chunks").alias("c")).select("_id", "_tx", "c.*")


def repeated_chunks(chunks: DataFrame) -> DataFrame:
    """The occurrences of chunks found twice or more, with ``first`` for the one that stays."""
    groups = chunks.groupBy("d1", "d2").agg(F.count("*").alias("copies"), F.min(F.struct("_id", "_tx", "start")).alias("f")).where("copies > 1")
    hits = chunks.select("_id", "_tx", "start", "size", "d1", "d2").join(spool(groups), ["d1", "d2"])
    here = F.struct("_id", "_tx", "start")
    return hits.select("_id", "_tx", "start", "size", here.eqNullSafe(F.col("f")).alias("first"), F.col("f._id").alias("holder"))


def passages(marks: list[dict], n: int, run: int) -> list[dict]:
    """The marked chunks, rising, whose unbroken stretch has ``run`` bytes or is the whole text of n bytes."""
    out, stretch = [], []
    for m in [*marks, None]:
        if stretch and (m is None or m["start"] != stretch[-1]["start"] + stretch[-1]["size"]):
            size = stretch[-1]["start"] + stretch[-1]["size"] - stretch[0]["start"]
            out += stretch if size >= run or size == n else []
            stretch = []
        stretch.append(m)
    return out


def remove(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(text without the rising spans, bytes removed, maximal runs)."""
    kept, at, runs, last = [], 0, 0, -1
    for start, size in spans:
        kept.append(text[at:start])
        runs += start != last
        at = last = start + size
    kept.append(text[at:])
    left = b"".join(kept)
    return left, len(text) - len(left), runs


def dedup_substrings(docs: DataFrame, text: str = "text", least: int = 1, run: int = RUN) -> DataFrame:
    """doc_id, n_bytes, n_shared, shared_bytes, n_removed, n_spans, kept (binary), with_doc.

    n_shared and shared_bytes: chunks that occur elsewhere and stand in a stretch of such chunks of ``run`` bytes or more, the first occurrences included.
    with_doc: the smallest doc_id that holds the first occurrence of one of them.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    marks = repeated_chunks(chunk_table(spool(chunk_arrays(docs, text, least))))
    per_row = marks.groupBy("_id", "_tx").agg(F.array_sort(F.collect_list(F.struct("start", "size", "first", "holder"))).alias("marks"))
    keyed = docs.select(*row_key(text=text), F.col(text).cast("binary").alias("t"))
    joined = attach(keyed, per_row, hint="shuffle_hash").select("_id", "t", "marks")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, m in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                t = t or b""
                found = passages(m or [], len(t), run)
                left, n_removed, n_spans = remove(t, [(x["start"], x["size"]) for x in found if not x["first"]])
                held = [x["holder"] for x in found]
                out.append((len(t), len(found), sum(x["size"] for x in found), n_removed, n_spans, left, None if not held or None in held else min(held)))
            n = list(zip(*out, strict=True)) or [()] * 7
            holder = pa.array(n[6], b.column(0).type)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array(x, pa.int64()) for x in n[:5]], pa.array(n[5], pa.binary()), holder], ["doc_id", "n_bytes", "n_shared", "shared_bytes", "n_removed", "n_spans", "kept", "with_doc"]
            )

    return joined.mapInArrow(work, f"doc_id {kind}, n_bytes long, n_shared long, shared_bytes long, n_removed long, n_spans long, kept binary, with_doc {kind}")
