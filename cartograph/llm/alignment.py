"""Alignment of two tokenizers over a corpus: which tokens of one stand where tokens of the other do.

Each text is tokenized by both. A string with one label a byte says what ends there: nothing, a token of A, one of B, or both. A
regular expression cuts that string after each both-label (runs of these are runs of groups with one token each); the labels of a span count the tokens of its group, and as groups are in order, the counts alone
tell which tokens they are. All pairs of an A and a B token of one group are linked.

A document's distinct linked id pairs, with how many links each has, are written once. Counting them gives the number of documents that hold a
pair; the highest count of each A id and the counts themselves then go back to the documents by a join.

Defined results: a null or empty text, and one whose token bytes differ from a space and the text, has no tokens: zeros and an empty groups_sha256. Every row is a document
of its own, so repeated rows count twice and null ids are kept. Long texts are tokenized in pieces cut where neither tokenizer joins anything
(before a space between two printable ASCII characters), so the library never holds more than one piece; a text without such a
place is one piece. A group's links are counted by distinct ids, so that a long group without common ends costs its
distinct pairs, not its token pairs. Other columns of the input are carried along, without those named like a result column.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from cartograph.llm.expr import carried
from cartograph.llm.tokens import PIECES, byte_names
from cartograph.runtime import spool

PIECE = 1 << 16  # characters of a text from which it is cut
SAFE = re.compile(r"(?<=[!-~]) (?=[!-~])")
BROADCAST = 2_000_000  # pairs up to which their counts are broadcast: 20 bytes each
WIDE = 1 << 14  # token pairs in a group from which they are made of distinct ids
NONE, A_END, B_END, BOTH = b"nabx"
GROUP = re.compile(rb"x+|[^x]+x")  # over the labels of token ends: a run of groups of one token each, or one larger group
#: Where the fast encoder isn't trusted to cut texts as the library does: scripts that still gain letters, and very long blanks.
LATE = re.compile("[\u0530-\U0010ffff]|\\s{1000}")
RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


class Pair:
    """Both tokenizers, with the bytes of every id."""

    def __init__(self, a_file: str, b_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has a task on each core already
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.fast = ranked(a_file)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        alphabet = byte_names()
        size = self.a.get_vocab_size(with_added_tokens=True)
        self.a_bytes = []
        for i in range(size):
            entry = self.a.id_to_token(i) or ""
            self.a_bytes.append(bytes(alphabet[c] for c in entry) if all(c in alphabet for c in entry) else entry.encode())
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode())
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        #: The ids in decimal, each followed by what may follow it: first all A ids in a group, then its last A id, then the same for B.
        ids = [range(size), range(size), range(len(self.b_bytes)), range(len(self.b_bytes))]
        self.text = [f"{i}{mark}" for part, mark in zip(ids, ",|,;", strict=True) for i in part]
        #: Pieces may be cut before a space only if no entry of B runs across one.
        self.cuts = not any(b" " in x.lstrip(b" ") for x in self.b_bytes)

    def pieces(self, text: str) -> list[str]:
        """The text in parts, each without the space that it is cut before; both tokenizers put one before each part."""
        if len(text) <= PIECE or not self.cuts:
            return [text]
        out, at = [], 0
        while len(text) - at > PIECE:
            found = SAFE.search(text, at + PIECE)
            if not found:
                break
            out.append(text[at : found.start()])
            at = found.end()
        return [*out, text[at:]]

    def encode(self, parts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a: list = [None if self.fast is None or LATE.search(p) else self.fast.encode_ordinary(" " + p) for p in parts]
        late = [i for i, ids in enumerate(a) if ids is None]
        for i, e in zip(late, self.a.encode_batch_fast([" " + parts[i] for i in late], add_special_tokens=False), strict=True):
            a[i] = e.ids
        b = self.b.encode(parts, num_threads=1)
        return [np.array(ids, np.int64) for ids in a], [np.array(ids, np.int64) for ids in b]


def ranked(a_file: str):
    """A faster encoder of the same vocabulary, or null where the file says more than ids in order of merging."""
    import tiktoken

    with open(a_file, encoding="utf-8") as f:
        spec = json.load(f)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
    whole = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex") and spec["normalizer"] is None
    merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if not whole or any(model.get(k, v) != v for k, v in plain.items()) or merged != list(range(256, 256 + len(merged))) or len(model["vocab"]) != 256 + len(merged):
        return None
    alphabet = byte_names()
    return tiktoken.Encoding("ranked", pat_str=PIECES, mergeable_ranks={bytes(alphabet[c] for c in entry): i for entry, i in model["vocab"].items()}, special_tokens={})


@lru_cache(maxsize=2)
def pair(a_file: str, b_file: str) -> Pair:
    return Pair(a_file, b_file)


def groups(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of A and B tokens of each group, from the lengths in bytes of a text's tokens."""
    labels = np.full(int(a_len.sum()), NONE, np.uint8)
    labels[np.cumsum(a_len) - 1] = A_END
    ends = np.cumsum(b_len) - 1
    labels[ends] = np.where(labels[ends] == A_END, BOTH, B_END)
    spans = GROUP.findall(labels.tobytes().translate(None, b"n"))
    counts = np.array([(len(s), 1, 1) if s[0] == BOTH else (1, s.count(b"a") + 1, s.count(b"b") + 1) for s in spans], np.int64)
    return np.repeat(counts[:, 1], counts[:, 0]), np.repeat(counts[:, 2], counts[:, 0])


def links(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct id pairs of a text's groups, each as a << 32 | b in rising order, and how many links each has."""
    a0, b0, n = np.cumsum(na) - na, np.cumsum(nb) - nb, na * nb
    wide = np.flatnonzero(n > WIDE)
    keys, times = [], []
    for g in wide:
        x, cx = np.unique(a[a0[g] : a0[g] + na[g]], return_counts=True)
        y, cy = np.unique(b[b0[g] : b0[g] + nb[g]], return_counts=True)
        keys.append((x[:, None] << 32 | y[None, :]).ravel())
        times.append((cx[:, None] * cy[None, :]).ravel())
    if len(wide):
        keep = n <= WIDE
        a0, b0, n, nb = a0[keep], b0[keep], n[keep], nb[keep]
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    width = np.repeat(nb, n)
    flat = a[np.repeat(a0, n) + within // width] << 32 | b[np.repeat(b0, n) + within % width]
    if not len(wide):
        found, count = np.unique(flat, return_counts=True)
        return found, count
    keys.append(flat)
    times.append(np.ones(len(flat), np.int64))
    found, back = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.zeros(len(found), np.int64)
    np.add.at(count, back, np.concatenate(times))
    return found, count


def digest(ia: np.ndarray, ib: np.ndarray, na: np.ndarray, nb: np.ndarray, p: Pair) -> str:
    """SHA-256 of the groups' ids, A before B, in order."""
    ends_a, ends_b = np.cumsum(na), np.cumsum(nb)
    last_a, last_b = np.zeros(len(ia), np.int64), np.zeros(len(ib), np.int64)
    last_a[ends_a - 1] = len(p.a_bytes)
    last_b[ends_b - 1] = len(p.b_bytes)
    order = np.empty(len(ia) + len(ib), np.int64)
    order[np.arange(len(ia)) + np.repeat(ends_b - nb, na)] = ia + last_a
    order[np.arange(len(ib)) + np.repeat(ends_a, nb)] = ib + last_b + 2 * len(p.a_bytes)
    text = p.text
    return hashlib.sha256("".join([text[i] for i in order.tolist()])[:-1].encode()).hexdigest()


def align(texts: list[str | None], p: Pair) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, pairs, times, sha256) of each text."""
    parts = [p.pieces(t) if t else [] for t in texts]
    a, b = p.encode([x for ps in parts for x in ps]) if any(parts) else ([], [])
    out, at = [], 0
    none = np.zeros(0, np.int64)
    for text, ps in zip(texts, parts, strict=True):
        own_a, own_b = a[at : at + len(ps)], b[at : at + len(ps)]
        at += len(ps)
        if text:
            ia, ib, whole = np.concatenate(own_a), np.concatenate(own_b), (" " + text).encode()
            if b"".join([p.a_bytes[i] for i in ia.tolist()]) == whole == b"".join([p.b_bytes[i] for i in ib.tolist()]):
                na, nb = groups(p.a_len[ia], p.b_len[ib])
                keys, times = links(ia, ib, na, nb)
                sha = digest(ia, ib, na, nb, p)
                out.append((len(ia), len(ib), len(na), int((na * nb).sum()), keys, times, sha))
                continue
        out.append((0, 0, 0, 0, none, none, ""))
    return out


def aligned(docs: DataFrame, text: str, a_file: str, b_file: str) -> DataFrame:
    """__row, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times: one row a document; the pairs are distinct."""
    rows = docs.select(F.struct(*[f"`{c}`" for c in docs.columns if c != text] or [F.lit(1).alias("__")]).alias("__row"), F.col(text).cast("string").alias("__text"))
    schema = StructType([
        *rows.select("__row").schema.fields, *[StructField(c, LongType()) for c in RESULT[:4]], StructField("groups_sha256", StringType()),
        StructField("pairs", ArrayType(LongType())), StructField("times", ArrayType(LongType())),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(a_file, b_file)
        for batch in batches:
            for at, length in slices(batch.column("__text")):
                part = batch.slice(at, length)
                found = align(part.column("__text").to_pylist(), p)
                offsets = np.zeros(len(found) + 1, np.int32)
                np.cumsum([len(x[4]) for x in found], out=offsets[1:])
                lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([x[i] for x in found]))) for i in (4, 5)]
                plain = [pa.array([x[i] for x in found], pa.int64()) for i in range(4)]
                yield pa.RecordBatch.from_arrays([part.column("__row"), *plain, pa.array([x[6] for x in found], pa.string()), *lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes of text, so that long texts don't meet in one batch."""
    sizes = np.array([0 if not t.is_valid else t.as_buffer().size for t in texts], np.int64)
    at, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if total and total + n > most:
            yield at, i - at
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes) - at


def pair_counts(table: DataFrame) -> DataFrame:
    """pair, count, best: how many documents hold each pair, and whether no other pair of its A id is in more."""
    counts = spool(table.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count")))
    a = F.shiftrightunsigned("pair", 32)
    top = counts.groupBy(a.alias("a")).agg(F.max("count").alias("most"))
    return counts.join(top, a == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, a_file: str, b_file: str, text: str = "text") -> DataFrame:
    """The input's other columns and n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, one row a document."""
    rest = docs.select(*[f"`{c}`" for c in docs.columns if c != text])
    table = spool(aligned(docs, text, a_file, b_file).withColumn("__n", F.monotonically_increasing_id()))
    counts = spool(pair_counts(table))
    small = counts.count() <= BROADCAST
    each = table.select("__n", F.explode(F.arrays_zip("pairs", "times")).alias("p")).select("__n", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))
    joined = each.join(F.broadcast(counts) if small else counts, "pair")
    sums = joined.groupBy("__n").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("count")).alias("count_sum"))
    out = table.drop("pairs", "times").join(sums, "__n", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select(*carried(rest, RESULT), *RESULT[:4], zero("n_best"), zero("count_sum"), "groups_sha256")
