"""Token counts by dynamic programming over prefixes, stored for every prefix.

A byte-pair encoding has this property: a sequence of tokens is the encoding of a string if and only if each
neighbouring pair is what its own concatenation encodes to. So the encoding of every prefix of a word follows from
those of shorter prefixes: its last token t is the one for which (last token before t, t) is such a pair, and the count
is the earlier prefix's count plus one. One pass over a word gives the exact token count of each of its prefixes.

Texts are cut into units: white space with the word, number or marks behind it. No unit's tokens depend on what stands before or behind it, so the counts of a
text's prefixes are running sums over its units, in which the end of a prefix may fall. Units repeat: each Python worker keeps the counts of up to CACHE units.

prefix_table() stores, for each text, what every byte adds to the count (one signed byte each, so the table compresses well); HOLE marks the bytes after which no
character ends. budget() and counts_at() answer questions about totals, truncation and budgets from that table alone; nothing is encoded again.

Work is local to a row, without shuffle; a row costs time and memory linear in its text. Null texts count as empty and have no tokens. Repeated rows have equal counts, and ties
don't arise. An empty table gives an empty table. Only doc_id and the text are read, so extra columns can't clash.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.runtime import spool

CACHE = 400_000
HOLE = -128
HOLES = [bytes([HOLE & 255]) * max(0, n - 1) for n in range(5)]
# The Unicode white space characters and the pre-tokenizer's published pattern.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

LATE = regex.compile("[\u0530-\U0010ffff]")  # the earlier scripts have long been complete


def byte_names() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file, by its published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Counter:
    """Exact token counts of a byte-level BPE read from a tokenizers file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        names = byte_names()
        raw = lambda s: bytes(names[c] for c in s)
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[raw(a), raw(b)] = i
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.vocab = {raw(t) for t in spec["model"]["vocab"] if t not in special}
        self.longest = max(map(len, self.vocab))
        self.pieces = regex.compile(PIECES)
        # A contraction stands only where no space is before it; other white space is a piece of its own there.
        self.units = regex.compile(rf"(?:[{SPACE}]*[{SPACE.replace(' ', '')}])?'(?:s|t|re|ve|m|ll|d)|[{SPACE}]*(?:\p{{L}}+|\p{{N}}+|[^{SPACE}\p{{L}}\p{{N}}]+)|[{SPACE}]+")
        self.blank, self.words, self.short = regex.compile(f"[{SPACE}]*"), regex.compile(f"[^{SPACE}]"), regex.compile("'(?:s|t|re|ve|m|ll|d)")
        self.pair: dict[tuple[bytes, bytes], bool] = {}
        self.spines: dict[tuple[bytes, int], list[tuple[bytes, int]]] = {}
        self.made = {a + b: (a, b) for a, b in self.rank}
        order = self.rank
        # Spines decide pairs if each token is made by one merge, of parts made before it.
        self.simple = len(self.made) == len(order) and all(order[self.made[x]] < r for (a, b), r in order.items() for x in (a, b) if x in self.made)
        self.total, self.known = _Totals(self), _Units(self)

    @functools.cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def merge(self, word: bytes) -> list[bytes]:
        """The encoding by merges in rank order; used for pairs of tokens only."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:])]  # noqa: B905
            i = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[i] == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def spine(self, t: bytes, side: int) -> list[tuple[bytes, int]]:
        """The tokens at the right (1) or left (0) edge of t as it is put together, and the rank that ends each."""
        known = self.spines.get((t, side))
        if known is None:
            known, end, x = [], 1 << 60, t
            while True:
                known.append((x, end))
                if x not in self.made:
                    break
                end = self.rank[self.made[x]]
                x = self.made[x][side]
            self.spines[t, side] = known
        return known

    def fits(self, a: bytes, b: bytes) -> bool:
        """Whether a and b are what their concatenation encodes to; an empty a asks about b alone.

        Merges run in rank order, so a merge across the seam happens if its rank comes before the
        ranks that use up its two sides; of equal ranks the left one is first.
        """
        known = self.pair.get((a, b))
        if known is None:
            if len(self.pair) > CACHE:
                self.pair.clear()
            if not a or not self.simple:
                known = self.merge(a + b) == ([a, b] if a else [b])
            else:
                rank, known = self.rank, self.fits(b"", b)
                for x, used_x in self.spine(a, 1):
                    for y, used_y in self.spine(b, 0):
                        r = rank.get((x, y))
                        if r is not None and r < used_x and r <= used_y:
                            known = False
            self.pair[a, b] = known
        return known

    def prefixes(self, word: bytes) -> list[int]:
        """Token counts of word[:0], word[:1], ... word."""
        count, last = [0], [b""]
        vocab, fits, longest = self.vocab, self.fits, self.longest
        for i in range(1, len(word) + 1):
            for j in range(max(0, i - longest), i):
                t = word[j:i]
                if t in vocab and fits(last[j], t):
                    count.append(count[j] + 1)
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return count

    def split(self, part: str) -> list[str]:
        """The pieces of a text without special strings.

        Characters that this Python's Unicode tables don't know may be letters to the library and not to the
        pattern here, or the reverse; texts with any are cut by the library's own pre-tokenizer.
        """
        if LATE.search(part) and any(unicodedata.category(c) == "Cn" for c in set(part)):
            return [part[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(part)]
        return self.pieces.findall(part)

    def plain(self, text: str) -> int:
        """Tokens of a text without special strings."""
        return sum(map(self.total.__getitem__, self.split(text)))

    def unit(self, text: str) -> bytes:
        """What each byte of a unit adds to the count, as STEP."""
        k = self.blank.match(text).end()
        joined = not k or text[k - 1] == " "
        short = self.short.match(text, k) and (not k or not joined)
        data, prefixes = text.encode(), self.prefixes
        if k <= 1 and joined and not short:
            c = prefixes(data)
            if len(data) == len(text):
                return bytes([(y - x) & 255 for x, y in zip(c, c[1:], strict=False)])
        else:
            lead = len(text[:k].encode())
            c = prefixes(data[:lead])  # a prefix that ends in the white space has it as one piece
            if k < len(text):
                # Behind the white space its last character is a piece of its own, or a space before the word.
                at = len(text[: k - 1].encode()) if k else 0
                base = c[at]
                if not joined:
                    base += prefixes(data[at:lead])[-1]
                    at = lead
                if short:  # a part of a contraction is none
                    c += [base + self.plain(text[k : i + 1]) for i in range(k, len(text))]
                else:
                    c += [base + n for n in prefixes(data[at:])[lead - at + 1 :]]
        out, end, before = bytearray(), 0, 0
        for ch in text:
            size = 1 if ch < "\x80" else len(ch.encode())
            end += size
            out += HOLES[size]
            out.append((c[end] - before) & 255)
            before = c[end]
        return bytes(out)

    @staticmethod
    def steps_of(counts: np.ndarray, ends: np.ndarray) -> bytes:
        """Counts after each character, and where it ends in bytes, as a step for each byte."""
        out = np.full(int(ends[-1]) if len(ends) else 0, HOLE, np.int8)
        steps = np.diff(counts, prepend=0)
        if len(steps) and (steps.min() <= HOLE or steps.max() > 127):
            raise ValueError("a character changes the count by more than a step can hold")
        out[ends - 1] = steps
        return out.tobytes()

    def cut(self, part: str) -> list[str]:
        """The units of a text without special strings."""
        if LATE.search(part) and any(unicodedata.category(c) == "Cn" for c in set(part)):
            out, lead = [], ""
            for piece in self.split(part):  # rare: units from the library's pieces
                if piece.isspace() and not self.words.search(piece):
                    lead += piece
                else:
                    out.append(lead + piece)
                    lead = ""
            return [*out, lead] if lead else out
        return self.units.findall(part)

    def steps(self, text: str) -> bytes:
        """What each byte of a text adds to the token count of the prefix that ends there."""
        if not self.special or not self.special.search(text):
            return b"".join(map(self.known.__getitem__, self.cut(text)))
        out, last, at = [], "", 0
        for m in [*self.special.finditer(text), None]:
            units = self.cut(text[at : m.start() if m else len(text)])
            out += map(self.known.__getitem__, units)
            if m is None:
                break
            last = units[-1] if units else ""
            # Prefixes that end inside a special string don't have it: its first characters join the unit before them.
            before = self.plain(last)
            counts = np.array([*(self.plain(last + m.group()[:i]) - before for i in range(1, len(m.group()))), 1])
            out.append(self.steps_of(counts, np.cumsum([len(c.encode()) for c in m.group()])))
            at = m.end()
        return b"".join(out)

    def count(self, text: str) -> int:
        s = np.frombuffer(self.steps(text), np.int8)
        return int(s[s != HOLE].sum())


class _Totals(dict):
    """Piece to token count, filled on demand and bounded."""

    def __init__(self, counter: Counter) -> None:
        super().__init__()
        self.counter = counter

    def __missing__(self, piece: str) -> int:
        if len(self) > CACHE:
            self.clear()
        n = self[piece] = self.counter.prefixes(piece.encode())[-1]
        return n


class _Units(dict):
    """Unit to steps, filled on demand and bounded; long units are not kept."""

    def __init__(self, counter: Counter) -> None:
        super().__init__()
        self.counter = counter

    def __missing__(self, unit: str) -> bytes:
        steps = self.counter.unit(unit)
        if len(unit) <= 64:
            if len(self) > CACHE:
                self.clear()
            self[unit] = steps
        return steps


@functools.lru_cache(2)
def counter(vocab: str) -> Counter:
    """One counter per worker; ``vocab`` names a file of the installed public tokenizers, or is a path."""
    import public_tokenizers

    return Counter(vocab if "/" in vocab else public_tokenizers.path(vocab))


def prefix_table(docs: DataFrame, text: str = "text", vocab: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, n_bytes, steps: for each byte of a text what it adds to the token count, HOLE inside of characters."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = counter(vocab).steps
        for b in batches:
            found = [steps(t) if t else b"" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array(found, pa.binary())], ["doc_id", "n_bytes", "steps"])

    return docs.select("doc_id", F.col(text)).mapInArrow(run, f"doc_id {kind}, n_bytes long, steps binary")


def prefix_counts(steps: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of each prefix that ends a character, its tokens), the empty prefix first."""
    s = np.frombuffer(steps, np.int8)
    ends = np.flatnonzero(s != HOLE)
    return np.concatenate([[0], ends + 1]), np.concatenate([[0], np.cumsum(s[ends], dtype=np.int64)])


def counts_at(steps: bytes, sizes: list[int]) -> list[int]:
    """Tokens of the prefixes of some numbers of bytes; inside of a character, those of the characters before it."""
    ends, counts = prefix_counts(steps)
    return counts[np.searchsorted(ends, sizes, "right") - 1].tolist()


def budget(table: DataFrame, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cut_bytes, cut_tokens from a prefix table: the longest prefix of at most ``limit`` tokens, and its tokens."""
    kind = table.schema["doc_id"].dataType.simpleString()

    def one(steps: bytes) -> tuple[int, int, int]:
        s = np.frombuffer(steps, np.int8)
        total = int(s.sum(dtype=np.int64)) - HOLE * int(np.count_nonzero(s == HOLE))
        if total <= limit:
            return total, len(s), total
        ends, counts = prefix_counts(steps)
        at = int(np.flatnonzero(counts <= limit)[-1])
        return total, int(ends[at]), int(counts[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([one(x) for x in b.column(2).to_pylist()], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(np.ascontiguousarray(found[:, i])) for i in range(3)]], ["doc_id", "n_bytes", "n_tokens", "cut_bytes", "cut_tokens"])

    rows = table.select("doc_id", "n_bytes", "steps").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, cut_bytes long, cut_tokens long")
    return rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cut_bytes", "cut_tokens")


def count_tokens(docs: DataFrame, text: str = "text", vocab: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """The answers of budget() for every text; the prefix table is stored in the shared folder first."""
    return budget(spool(prefix_table(docs, text, vocab)), limit)
