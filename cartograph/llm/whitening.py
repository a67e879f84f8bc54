"""Whitening of embeddings by their leading principal components, found without forming the covariance.

Entries become integers x = floor(64 c) + 1000000, so counts, sums and deviations are exact. The fit list holds each distinct vector
once. Its covariance V is only ever multiplied: a pass over the rows computes X'(XQ) for a block Q, on rows centred by exact sums. The driver
keeps d-by-block matrices: it makes each new block orthogonal to the ones kept (QR), and solves the small eigenproblem
on their span (Rayleigh-Ritz). Keeping a few blocks instead of the last one only is what lets close eigenvalues part in few passes; with
``blocks=1`` it is the plain iteration. Passes end when the residuals |Vu - eu| of all k components are certified to be below
``TOLERANCE`` times the largest eigenvalue.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped, as are rows of another length than the one that most
distinct vectors have (the longer of equals) and empty vectors. Repeated rows, and rows with null or repeated ids, all stay, each with its
components; a vector counts once in the fit. Components with an eigenvalue of (numerically) zero can't be scaled to one and are left out, so a table with
fewer than two distinct vectors, or an empty one, gives no rows. Equal eigenvalues give any orthonormal basis of their space. An entry of 2^46 or more raises an error.
Other columns of the input are carried along, without those named like a result column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DecimalType, DoubleType, StructField, StructType

from cartograph.llm.expr import carried
from cartograph.runtime import drop_spool, spool

SCALE, SHIFT = 64, 1_000_000
LARGEST = 2.0**46  # entries below it have exact sums
TOLERANCE = 1e-12  # residuals, relative to the largest eigenvalue
RANK = 1e-9  # eigenvalues below this share of the largest count as zero
PASSES = 500
DEVIATION = DecimalType(38, 0)


def integer_rows(vectors: DataFrame, vector: str) -> DataFrame:
    """__row (the input row without its vector), x: rows with a whole, finite vector."""
    v = F.col(vector)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = lambda c: F.floor(SCALE * c.cast("double")) + SHIFT
    x = F.transform(v, lambda c: F.when(F.abs(c) < LARGEST, whole(c)).otherwise(F.raise_error(F.lit("an embedding's entry is too large for exact sums")).cast("long")))
    rest = [F.col(f"`{c}`") for c in vectors.columns if c != vector]
    return vectors.where(v.isNotNull() & ~bad & (F.size(v) > 0)).select(F.struct(*rest).alias("__row") if rest else F.struct(F.lit(1).alias("__")).alias("__row"), x.alias("x"))


@dataclass
class Fit:
    """n vectors of d entries with sums s; eigenvalues falling, unit eigenvectors as columns; what was measured."""

    n: int
    sums: list[int]
    largest: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int
    residual: float


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column, all of one length, as rows of int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def deviations(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    """n*x - S, exact: int64 where it fits, else Python integers."""
    if n * largest < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int], largest: int) -> np.ndarray:
    return (deviations(x, n, sums, largest) / n).astype(np.float64)


def sum_blocks(rows: DataFrame, block: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over batches of the matrix that ``block`` makes of a batch's vectors: summed in each task, then by entry."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += block(matrix(batch.column(0)))
        i, j = np.divmod(np.arange(total.size, dtype=np.int64), shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], names=["i", "j", "v"])

    out = np.zeros(shape)
    for r in rows.mapInArrow(partial, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # d times block entries
        out[r["i"], r["j"]] = r["v"]
    return out


def orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``block`` has outside of ``basis``, without directions that are mere rounding."""
    scale = np.linalg.norm(block, axis=0).max(initial=0.0)
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    q, r = np.linalg.qr(block)
    left, size, _ = np.linalg.svd(r)
    q = (q @ left)[:, size > 1e-10 * max(scale, 1e-300)]
    q = q - basis @ (basis.T @ q)
    return np.linalg.qr(q)[0] if q.shape[1] else q


def leading(multiply: Callable[[np.ndarray], np.ndarray], d: int, k: int, width: int, blocks: int = 8) -> tuple[np.ndarray, np.ndarray, int, float]:
    """The k largest eigenvalues and their vectors of a symmetric matrix known by its products; passes taken, worst residual.

    The basis holds at most ``blocks`` blocks of ``width`` vectors and starts anew from its leading Ritz vectors when full.
    """
    width = min(d, max(width, k))
    block = np.linalg.qr(np.random.default_rng(11).standard_normal((d, width)))[0]
    basis, image = np.zeros((d, 0)), np.zeros((d, 0))
    for passes in range(1, PASSES + 1):
        basis, image = np.hstack([basis, block]), np.hstack([image, multiply(block)])
        small = basis.T @ image
        theta, y = np.linalg.eigh((small + small.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        ritz, moved = basis @ y[:, :width], image @ y[:, :width]
        left = moved - ritz * theta[:width]
        worst = float(np.linalg.norm(left[:, :k], axis=0).max())
        if worst <= TOLERANCE * max(float(theta[0]), 1e-300) or theta[0] <= 0:
            return np.maximum(theta[:k], 0.0), ritz[:, :k], passes, worst
        if blocks == 1:
            block, basis, image = np.linalg.qr(moved)[0], np.zeros((d, 0)), np.zeros((d, 0))
            continue
        if basis.shape[1] + width > max(blocks, 2) * width:
            lead = y[:, : width * max(1, blocks // 4)]
            basis, image = basis @ lead, image @ lead
        block = orthonormal(left, basis)
        if not block.shape[1]:  # the span is closed under the matrix, up to rounding
            if worst > 1e-9 * theta[0]:
                raise RuntimeError(f"the components can't be certified: residual {worst}")
            return np.maximum(theta[:k], 0.0), ritz[:, :k], passes, worst
    raise RuntimeError(f"no {k} components after {PASSES} passes: residual {worst}")


def fit(distinct: DataFrame, k: int = 16, width: int | None = None, blocks: int = 8) -> Fit | None:
    """Components of a table of distinct integer vectors x of one length; null if it is empty."""
    spark = distinct.sparkSession
    e = distinct.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.max(F.abs("c")).alias("m"))
    stats = sorted(e.collect())  # d rows
    if not stats:
        return None
    n, sums, largest, d = stats[0]["n"], [int(r["s"]) for r in stats], max(r["m"] for r in stats), len(stats)
    k = min(k, d)

    def multiply(q: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(q)

        def block(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums, largest)
            return c.T @ (c @ shared.value) if len(c) else np.zeros((d, q.shape[1]))

        out = sum_blocks(distinct, block, q.shape) / n
        shared.destroy()
        return out

    values, vectors, passes, worst = leading(multiply, d, k, width or 2 * k, blocks)
    square = lambda x: np.array([[np.sum(centred(x, n, sums, largest) ** 2)]]) if len(x) else np.zeros((1, 1))
    trace = float(sum_blocks(distinct, square, (1, 1))[0, 0]) / n
    good = values > RANK * max(float(values[0]), 1e-300)
    return Fit(n, sums, largest, values[good], vectors[:, good], trace, passes, worst)


def identity_error(distinct: DataFrame, found: Fit) -> float:
    """The largest absolute entry of the whitened fit list's covariance minus the identity, from one more pass."""
    k = len(found.values)
    to = found.vectors / np.sqrt(found.values)

    def block(x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros((k + 1, k))
        z = centred(x, found.n, found.sums, found.largest) @ to
        return np.vstack([z.T @ z, z.sum(axis=0)])

    s = sum_blocks(distinct, block, (k + 1, k)) / found.n
    return float(np.abs(s[:k] - np.outer(s[k], s[k]) - np.eye(k)).max())


RESULT = ["component", "n", "deviation", "whitened", "explained", "identity_error", "x"]


def whiten(vectors: DataFrame, vector: str = "embedding", k: int = 16, width: int | None = None, blocks: int = 8) -> DataFrame:
    """The input's other columns and component, n, deviation, whitened, explained, identity_error: one row a vector and component.

    deviation is decimal(38,0), exact for any count.
    """
    spark = vectors.sparkSession
    rest = vectors.select(*[f"`{c}`" for c in vectors.columns if c != vector])
    out_columns = carried(rest, RESULT)
    rows = integer_rows(vectors, vector)
    distinct = spool(rows.select("x").distinct())
    length = distinct.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    one = distinct.where(F.size("x") == length["d"]) if length else distinct
    found = fit(one, k, width, blocks)
    schema = StructType([*rows.select("__row").schema.fields, StructField("deviation", DEVIATION)])
    if found is None or not len(found.values):
        drop_spool(distinct)
        empty = spark.createDataFrame([], schema)
        return empty.select(*out_columns, F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), "deviation", *[F.lit(0.0).alias(c) for c in RESULT[3:6]])
    error = identity_error(one, found)
    drop_spool(distinct)
    to = spark.sparkContext.broadcast(found.vectors / np.sqrt(found.values))
    n, sums, largest, d = found.n, found.sums, found.largest, length["d"]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"))
            if not len(x):
                continue
            c = deviations(x, n, sums, largest)
            if c.dtype != object and d * (float(np.abs(c).max()) + 1) ** 2 < 2**62:
                total = pc.cast(pa.array((c * c).sum(axis=1)), pa.decimal128(38, 0))
            else:
                wide = c.astype(object)
                total = pa.array([Decimal(int(v)) for v in (wide * wide).sum(axis=1)], pa.decimal128(38, 0))
            z = np.ascontiguousarray((c / n).astype(np.float64) @ to.value)
            offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * z.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("__row"), total, pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], names=["__row", "deviation", "z"])

    schema = StructType([*schema.fields, StructField("z", ArrayType(DoubleType()))])
    made = rows.where(F.size("x") == d).mapInArrow(project, schema).select("__row", "deviation", F.posexplode("z").alias("at", "whitened"))
    share = F.get(F.array(*[F.lit(float(e / found.trace)) for e in found.values]), F.col("at"))
    return made.select(*out_columns, (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))
