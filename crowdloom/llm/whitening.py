"""Whitening of embeddings by shifted Cholesky QR.

The fit list is every distinct vector once, written to the shared folder. Its centred rows X
are made orthonormal in passes over it: each pass sums the Gram matrix of the rows as they
are so far, takes its Cholesky factor (of the first pass with a small multiple of the
identity added, so that it exists whatever the condition of X), and the next pass solves
every row by one triangle more. No pass keeps rows; a row is solved anew by all triangles. The
factors composed are R in X = QR, and R's singular values and vectors give the components
and their deviations to double precision, which the eigenvectors of X'X would lose. A
last pass over the fit list measures the whitened covariance, and all rows are projected.

Sums of rows are exact whole numbers, so (n*x - S) / n is the centred row to one rounding.
A task sends one matrix as dimensions rows, summed by Spark by row number; what comes to the
driver is dimensions squared, at most `most` dimensions (more raise an error).

Defined results: rows whose vector is null, empty or holds null or non-finite entries are
dropped, and so are rows of another length than the commonest (of equal counts: the longer);
equal vectors count once in the fit and each get rows; components whose deviation is below
RANK times the largest are noise (constant or dependent dimensions) and left out, so fewer
distinct vectors give fewer components and a single one none; an empty table gives an empty
result; ids may be null or repeat; other columns do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle

COMPONENTS, PASSES, MOST, RANK = 16, 3, 4096, 1e-10
#: Whole numbers instead of entries: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
BATCH = 4096


@dataclass
class Whitening:
    """n, exact sums S, components (rows, unit), their eigenvalues, the covariance's trace
    and the largest departure of the whitened covariance from the identity."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def whole_numbers(vectors: DataFrame, scale: int = SCALE, offset: int = OFFSET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x, the usable rows' vectors in whole numbers."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(F.forall("v", lambda c: F.coalesce(fine(c), F.lit(False))))
    rows = rows.select("vec_id", F.transform("v", lambda c: (F.floor(c * scale) + offset).cast("long")).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    return rows.where(F.size("x") == (lengths[0]["length"] if lengths else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """(n*x - S) / n, whole until the division; x - S/n where n*x would not fit 64 bits."""
    if sums.dtype == np.int64 and len(x) and int(np.abs(x).max()) < (1 << 62) // n:
        return (n * x - sums) / n
    return np.array((n * x.astype(object) - sums.astype(object)) / n, np.float64)


def _solved(rows: np.ndarray, triangles: list[np.ndarray]) -> np.ndarray:
    """rows times the inverses of upper triangles, by substitution."""
    for r in triangles:
        out = np.empty_like(rows)
        for j in range(len(r)):
            out[:, j] = (rows[:, j] - out[:, :j] @ r[:j, j]) / r[j, j]
        rows = out
    return rows


def _summed(fit: DataFrame, matrix, width: int, rows: int) -> np.ndarray:
    """The sum over the fit list of matrix(x), a rows by width matrix of a block x."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                part = matrix(_matrix(batch.column(0).slice(a, BATCH)))
                total = part if total is None else total + part
        if total is not None:
            flat = pa.array(total.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(rows, dtype=np.int32), width)), pa.array(np.tile(np.arange(width, dtype=np.int32), rows)), flat], ["i", "j", "value"])

    out = np.zeros((rows, width))
    for r in fit.mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        out[r.i, r.j] = r.value  # dimensions squared
    return out


def _factor(gram: np.ndarray, shift: float) -> np.ndarray | None:
    try:
        return np.linalg.cholesky(gram + shift * np.eye(len(gram))).T
    except np.linalg.LinAlgError:
        return None


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, passes: int = PASSES, most: int = MOST) -> Whitening | None:
    """The whitening of the distinct vectors in column x of vectors; None if there are none."""
    fit = settle(vectors.select("x").distinct(), "whitening-fit")
    sums_of = fit.select(F.posexplode("x").alias("j", "c")).groupBy("j").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    found = sums_of.orderBy("j").limit(most + 1).collect()
    if not found:
        return None
    if len(found) > most:
        raise ValueError(f"more than {most} dimensions")
    n, exact, d = found[0]["n"], [int(r["s"]) for r in found], len(found)
    sums = np.array(exact, np.int64 if max(map(abs, exact)) < 1 << 62 else object)
    unit = np.finfo(float).eps / 2
    triangles: list[np.ndarray] = []
    for k in range(passes):
        gram = _summed(fit, lambda x, t=tuple(triangles): (q := _solved(_centred(x, n, sums), list(t))).T @ q, d, d)
        if k == 0:
            trace = float(np.trace(gram)) / n
            if trace == 0:
                return Whitening(n, exact, np.zeros((0, d)), np.zeros(0), 0.0, 0.0)
        shift = 11 * (n * d + d * (d + 1)) * unit * float(np.linalg.norm(gram, 2))
        last = k == passes - 1
        r = _factor(gram, shift if k == 0 else 0.0)
        if r is None and not last:  # dependent dimensions: their directions stay short
            r = _factor(gram, shift)
        if r is None:  # the root of the last Gram matrix, in which such directions are zero
            values, ways = np.linalg.eigh(gram)
            r = np.sqrt(np.maximum(values, 0.0))[:, None] * ways.T
        triangles.append(r)
    composed = triangles[0]
    for r in triangles[1:]:
        composed = r @ composed
    _, deviations, ways = np.linalg.svd(composed)
    k = int(((deviations > RANK * deviations[0]) & (np.arange(d) < components)).sum())
    ways, eigenvalues = ways[:k], deviations[:k] ** 2 / n
    scaled = ways / np.sqrt(eigenvalues)[:, None]

    def moments(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, sums) @ scaled.T
        return np.vstack([w.T @ w, w.sum(axis=0)])

    m = _summed(fit, moments, k, k + 1)
    covariance = m[:k] / n - np.outer(m[k] / n, m[k] / n)
    return Whitening(n, exact, ways, eigenvalues, trace, float(np.abs(covariance - np.eye(k)).max()))


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """For each row of rows (vec_id, x) and component: n, deviation (decimal: the exact sum of
    (n*x - S)^2), whitened, explained and identity_error."""
    n, k = model.n, len(model.eigenvalues)
    sums = np.array(model.sums, np.int64 if max(map(abs, model.sums)) < 1 << 62 else object)
    scaled = (model.components / np.sqrt(model.eigenvalues)[:, None]).T if k else np.zeros((len(model.sums), 0))
    explained, error, d = model.eigenvalues / (model.trace or 1.0), model.identity_error, len(model.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BATCH):
                x = _matrix(batch.column(1).slice(a, BATCH))
                w = _centred(x, n, sums) @ scaled
                if sums.dtype == np.int64 and int(np.abs(x).max()) < (1 << 62) // n and int((away := n * x - sums).max()) ** 2 < (1 << 62) // d and int(away.min()) ** 2 < (1 << 62) // d:
                    far = (away**2).sum(axis=1).tolist()
                else:
                    far = ((n * x.astype(object) - sums.astype(object)) ** 2).sum(axis=1).tolist()
                ids = batch.column(0).slice(a, BATCH).take(pa.array(np.repeat(np.arange(len(x)), k)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array([str(v) for v in far]).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(w.reshape(-1)), pa.array(np.tile(explained, len(x)))],
                    ["vec_id", "component", "deviation", "whitened", "explained"],
                )

    out = rows.select("vec_id", "x").mapInArrow(run, "vec_id long, component int, deviation string, whitened double, explained double")
    return out.select("vec_id", "component", F.lit(n).cast("long").alias("n"), F.expr("try_cast(deviation as decimal(38,0))").alias("deviation"), "whitened", "explained", F.lit(error).alias("identity_error"))


NOTHING = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whitened_embeddings(vectors: DataFrame, **options) -> DataFrame:
    rows = whole_numbers(vectors)
    model = fit_whitening(rows, **options)
    return vectors.sparkSession.createDataFrame([], NOTHING) if model is None else whiten(rows, model)


def op11_cholesky_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is a long by contract: null where it is beyond one (n above some 10^7)."""
    out = whitened_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.expr("try_cast(deviation as long)"))


QUERIES = {"op11_cholesky_whitening": op11_cholesky_whitening}
ORACLES: dict[str, str] = {}
