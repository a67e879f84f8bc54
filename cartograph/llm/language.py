"""Language identification by n-gram filters that answer for all languages at once.

A table has one bitmask a position with a bit for each language: the Bloom filters of all languages, sliced by bit. An n-gram's
positions are looked up once and their masks are joined by AND, which leaves the languages that contain it. A text's n-grams that are found in each
language are counted; a filter with a share f of false positives finds f of the strange n-grams too, so (hits - f n) / (1 - f)
estimates the true ones. The language with the most of them is the answer, its share of the n-grams the score.

An n-gram belongs to a language if enough of the documents learned hold it (SHARE), and if it is not much rarer there than in the language where it is
most frequent (RELATIVE): foreign passages and wrong labels don't fill a filter as the corpus grows. The filters are learned from at most about SAMPLE documents of each
language, chosen by a hash of the id; copies of one text count once. All rows are predicted, from whole texts.

n-grams are taken inside words: the text is lower-cased, letters with their marks are kept, and whatever stands between words becomes n - 2
blanks, so one-letter words have n-grams too.

Defined results: a null text, or one without a letter, is ``und`` with score 0, and so is every text if nothing could be learned. Rows with a null id are predicted,
not learned from, and not held out. A text none of whose n-grams is known, and ties, go to the language with most documents to learn from, then to the least name. Repeated rows have
equal results. Long texts are read in blocks cut at white space. Other columns of the input are carried along, without those named like a result column.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from cartograph.llm.expr import carried
from cartograph.runtime import drop_spool, spool

N = 4
SAMPLE = 5_000  # documents learned from a language, about
SHARE = 0.001  # of a language's documents must hold an n-gram
RELATIVE = 0.125  # of its highest share in any language
HASHES = 4
SPARSE = 16  # positions a key, before rounding up to a power of two
POSITIONS = 1 << 22  # at most; fuller filters have more false positives, which the counts allow for
BLOCK = 1 << 17  # characters looked up at once
UNKNOWN = "und"
BLANK = re.compile(r"\s")
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


@lru_cache(maxsize=1)
def word_characters() -> np.ndarray:
    """For each code point: 2 for a letter, 1 for a mark, else 0."""
    kinds = {"L": 2, "M": 1}
    return np.array([kinds.get(unicodedata.category(chr(i))[0], 0) for i in range(0x110000)], np.uint8)


def blocks(text: str) -> Iterator[str]:
    """The text in parts of BLOCK characters or more, cut at white space, across which no n-gram runs."""
    at = 0
    while len(text) - at > 2 * BLOCK and (found := BLANK.search(text, at + BLOCK)):
        yield text[at : found.start()]
        at = found.end()
    yield text[at:]


def ngrams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all windows of the texts put after one another; which are n-grams; the bounds of each text's windows; which have a letter."""
    low = [" " + t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = word_characters()[codes]
    solid = kind > 0
    times = solid.astype(np.int64)
    times[:-1][~solid[:-1] & solid[1:]] = n - 2
    ends = np.cumsum(times)
    stream = np.concatenate([np.repeat(np.where(solid, codes, 32).astype(np.uint64), times), np.full(n - 1, 32, np.uint64)])
    total = len(stream) - n + 1
    key = np.zeros(total, np.uint64)
    for i in range(n):
        key += stream[i : i + total] * MULTIPLIERS[i % len(MULTIPLIERS)] + np.uint64(i)
        key ^= key >> np.uint64(29)
    key *= MULTIPLIERS[3]
    key ^= key >> np.uint64(32)
    valid = np.zeros(total, bool)
    for i in range(1, n - 1):
        valid |= stream[i : i + total] != 32
    sizes = np.cumsum([0] + [len(t) for t in low])
    bounds = np.concatenate([[0], ends])[sizes]
    letters = np.concatenate([[0], np.cumsum(kind == 2)])[sizes]
    return key, valid, bounds, np.diff(letters) > 0


def positions(key: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The HASHES places of each key in a table of a power of two."""
    step = (key >> np.uint64(40)) | np.uint64(1)
    for i in range(HASHES):
        yield ((key + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)


@dataclass
class Filters:
    """languages, most frequent first; table[position, word of 64 languages]; each filter's share of false positives."""

    languages: list[str]
    n: int
    table: np.ndarray
    false: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.false = np.array([self.column(self.table, i).mean() for i in range(len(self.languages))]) ** HASHES

    @staticmethod
    def column(masks: np.ndarray, i: int) -> np.ndarray:
        return (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)

    def counts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, language) hits, the number of n-grams of each text, and whether it has a letter."""
        key, valid, bounds, letters = ngrams(texts, self.n)
        masks = None
        for place in positions(key, len(self.table)):
            found = self.table[place]
            masks = found if masks is None else masks & found
        total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[bounds])
        hits = [total(self.column(masks, i) * valid) for i in range(len(self.languages))]
        return np.stack(hits, axis=1), total(valid), letters

    def judge(self, hits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best language of each text, its share of the n-grams, and its lead over the next."""
        n = np.maximum(n, 1)[:, None]
        share = np.clip((hits / n - self.false) / np.maximum(1 - self.false, 1e-9), 0.0, 1.0)
        best = share.argmax(axis=1)
        ranked = np.sort(np.concatenate([share, np.zeros((len(share), 1))], axis=1), axis=1)
        return best, ranked[:, -1], ranked[:, -1] - ranked[:, -2]


def packed(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    """(index, part) of all texts in lots of about BLOCK characters."""
    lot, size = [], 0
    for i, text in enumerate(texts):
        for part in blocks(text) if text else ():
            if lot and size + len(part) > BLOCK:
                yield lot
                lot, size = [], 0
            lot.append((i, part))
            size += len(part)
    if lot:
        yield lot


def document_counts(docs: DataFrame, n: int) -> DataFrame:
    """gram, at, docs: how many texts of language number ``at`` hold each n-gram; docs: at, __text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column("__text").to_pylist(), batch.column("at").to_numpy(zero_copy_only=False)
            own: dict[int, list[np.ndarray]] = {}
            for i, text in enumerate(texts):
                keys = [np.zeros(0, np.uint64)]
                for part in blocks(text):
                    key, valid, _, _ = ngrams([part], n)
                    keys.append(np.unique(key[valid]))
                own.setdefault(int(at[i]), []).append(np.unique(np.concatenate(keys)))
            for lang, found in own.items():
                gram, count = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(np.full(len(gram), lang, np.int32)), pa.array(count)], names=["gram", "at", "docs"])

    return docs.select("at", "__text").mapInArrow(run, "gram long, at int, docs long").groupBy("gram", "at").agg(F.sum("docs").alias("docs"))


def remainder(doc_id: str) -> Column:
    """The CRC-32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", n: int = N, sample: int = SAMPLE) -> Filters | None:
    """Filters of all languages of the labelled documents given; null if there are none."""
    spark = docs.sparkSession
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = usable.groupBy(F.col(lang).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()  # one row a language
    order = sorted(sizes, key=lambda r: (-r["n"], r["lang"]))
    if not order:
        return None
    table = spark.createDataFrame([(r["lang"], i, min(1.0, sample / r["n"])) for i, r in enumerate(order)], "__lang string, at int, part double")
    drawn = F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit(7)), F.lit(1 << 30)) < F.col("part") * (1 << 30)
    keyed = usable.select(F.col(lang).cast("string").alias("__lang"), F.col(doc_id).alias(doc_id), F.col(text).cast("string").alias("__text"))
    chosen = spool(keyed.join(F.broadcast(table), "__lang").where(drawn).select("at", "__text").dropDuplicates(["at", "__text"]))
    sums = chosen.groupBy("at").agg(F.count("*").alias("all"))
    counts = spool(document_counts(chosen, n).join(F.broadcast(sums), "at").select("gram", "at", "docs", (F.col("docs") / F.col("all")).alias("share")))
    top = counts.groupBy("gram").agg(F.max("share").alias("top"))
    kept = spool(counts.where(F.col("share") >= SHARE).join(top, "gram").where(F.col("share") >= RELATIVE * F.col("top")).select("gram", "at"))
    most = kept.groupBy("at").count().agg(F.max("count")).first()[0] or 1
    size = min(POSITIONS, 1 << max(10, int(SPARSE * most - 1).bit_length()))
    width = -(-len(order) // 64)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False).astype(np.int64)
            bit = (np.uint64(1) << (at % 64).astype(np.uint64)).view(np.int64)
            for where in positions(batch.column("gram").to_numpy(zero_copy_only=False).view(np.uint64), size):
                yield pa.RecordBatch.from_arrays([pa.array(where * width + at // 64), pa.array(bit)], names=["place", "bit"])

    bits = kept.mapInArrow(place, "place long, bit long").groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most POSITIONS rows a word of languages
    masks = np.zeros(size * width, np.int64)
    masks[bits.column("place").to_numpy()] = bits.column("bits").to_numpy()
    for done in (chosen, counts, kept):
        drop_spool(done)
    return Filters([r["lang"] for r in order], n, masks.view(np.uint64).reshape(size, width))


RESULT = ["held_out", "lang_pred", "score", "lead"]


def predict(docs: DataFrame, filters: Filters | None, text: str = "text") -> DataFrame:
    """__row and lang_pred, score, lead for every row; only the text is looked at."""
    rest = [f"`{c}`" for c in docs.columns if c != text]
    rows = docs.select(F.struct(*rest or [F.lit(1).alias("__")]).alias("__row"), F.col(text).cast("string").alias("__text"))
    schema = StructType([*rows.select("__row").schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("lead", DoubleType())])
    if filters is None:
        return rows.select("__row", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("lead"))
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shared.value
        names = np.array([*f.languages, UNKNOWN], object)
        for batch in batches:
            texts = batch.column("__text").to_pylist()
            hits, n, letters = np.zeros((len(texts), len(f.languages)), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
            for lot in packed(texts):
                at = np.array([i for i, _ in lot])
                h, c, has = f.counts([part for _, part in lot])
                np.add.at(hits, at, h)
                np.add.at(n, at, c)
                np.logical_or.at(letters, at, has)
            best, share, lead = f.judge(hits, n)
            best[~letters] = len(f.languages)
            yield pa.RecordBatch.from_arrays([batch.column("__row"), pa.array(names[best], pa.string()), pa.array(np.where(letters, share, 0.0)), pa.array(np.where(letters, lead, 0.0))], names=schema.names)

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", n: int = N, sample: int = SAMPLE) -> DataFrame:
    """The input's other columns and held_out, lang_pred, score, lead; learned from rows whose id's remainder is 0 or 2."""
    rest = docs.select(*[f"`{c}`" for c in docs.columns if c != text])
    filters = learn(docs.where(remainder(doc_id) != 1), text, lang, doc_id, n, sample)
    found = predict(docs, filters, text)
    held = F.coalesce(F.crc32(F.col(f"__row.`{doc_id}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return found.select(*carried(rest, RESULT), held.alias("held_out"), "lang_pred", "score", "lead")
