"""Whitening of embeddings by MLlib's singular value decomposition of the centred rows.

Entries become integers on a fixed grid, so sums and squared deviations are exact. The rows, centred,
go to `RowMatrix.computeSVD`; a singular value s of n centred rows is the eigenvalue s^2 / n of their covariance.
The total variance, of which each component explains a share, is added up from the rows' exact
deviations and not from the decomposition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SCALE, SHIFT = 1024, 100_000
#: Scaled entries beyond this size are taken for it, so that doubles hold every integer.
LARGEST = float(1 << 51)
COMPONENTS = 8
#: Singular values of under so much of the greatest are taken for zero: MLlib decomposes the rows' product with
#: themselves, whose rounding leaves no smaller ones.
LEAST_SHARE = 1e-6
#: Dimensions up to which MLlib decomposes that product by LAPACK; beyond, by iteration.
MOST_DIRECT = 15_000


@dataclass
class Fit:
    """Number of rows, sum of each dimension, components by falling eigenvalue (a column each), eigenvalues of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray


def on_grid(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and x, a list of integers; rows whose vector is null, or holds a null or an entry that is not finite, are left out."""
    c = F.transform(vector_col, lambda e: e.cast("double"))
    finite = F.forall("c", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    x = F.transform("c", lambda e: F.floor(F.greatest(F.least(e * SCALE, F.lit(LARGEST)), F.lit(-LARGEST))) + SHIFT)
    return rows.select(F.col(id_col).alias("vec_id"), c.alias("c")).filter(F.col("c").isNotNull() & finite).select("vec_id", x.alias("x"))


def of_one_length(grid: DataFrame) -> DataFrame:
    """Vectors of the commonest length, of equally common ones the greatest; empty vectors are left out."""
    lengths = grid.groupBy(F.size("x").alias("d")).count().filter("d > 0").orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return grid.filter(F.size("x") == (lengths[0].d if lengths else -1))


def fit(grid: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Components of vectors of one length; None without any vector. The driver holds a d x d matrix."""
    # An entry has under 17 digits, so their sum is exact in a decimal for any number of rows.
    sums = grid.select(F.posexplode("x").alias("dim", "x")).groupBy("dim").agg(F.sum(F.col("x").cast("decimal(18,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("dim").collect()
    if not sums:
        return None
    n, totals = sums[0].n, [int(r.s) for r in sums]
    # Whole part and rest of the mean are taken off one after the other: the first difference is exact.
    means = F.array(*[F.struct(F.lit(float(s // n)).alias("whole"), F.lit(s % n / n).alias("rest")) for s in totals])
    centred = grid.select(array_to_vector(F.zip_with("x", means, lambda x, m: x.cast("double") - m.whole - m.rest)).alias("v"))
    # All components: MLlib then takes LAPACK's decomposition, to double precision, not an iteration to a tolerance.
    wanted = len(totals) if len(totals) <= MOST_DIRECT else components
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "v"), n, len(totals)).computeSVD(wanted, False, LEAST_SHARE) if _varies(grid) else None
    if svd is None:
        return Fit(n, totals, np.zeros((len(totals), 0)), np.zeros(0))
    s = svd.s.toArray()[:components]
    return Fit(n, totals, svd.V.toArray()[:, :components], s**2 / n)


def _varies(grid: DataFrame) -> bool:
    """Whether there are two different vectors; without, there is nothing to decompose."""
    first = grid.select("x").limit(1).collect()[0].x
    return not grid.filter(F.col("x") != F.array(*[F.lit(e).cast("long") for e in first])).isEmpty()


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Sum over the dimensions of (n x - sum)^2 for each row, exactly."""
    most = max([n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0), 1])
    if most < (1 << 31) and most * most * max(1, len(sums)) < (1 << 63):
        d = x * n - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    # n x - sum, around the whole part of the mean: small numbers again, if the vectors lie close together.
    whole = [s // n for s in sums]
    rest = [s - n * w for s, w in zip(sums, whole)]
    near = x - np.array(whole, np.int64)
    most = n * (int(np.abs(near).max(initial=0)) + 1)
    if most < (1 << 62) and most * most * max(1, len(sums)) < (1 << 63):
        d = near * n - np.array(rest, np.int64)
        return (d * d).sum(axis=1).tolist()
    d = near.astype(object) * n - np.array(rest, object)
    return [int(v) for v in (d * d).sum(axis=1)]


def project(grid: DataFrame, model: Fit) -> DataFrame:
    """vec_id, deviation (exact; null beyond a long), deviation_beyond (then, as a double), whitened (a list, a value a component)."""
    kind = grid.schema["vec_id"].dataType.simpleString()
    n, sums = model.n, model.sums
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    scaled = grid.sparkSession.sparkContext.broadcast(model.components / np.sqrt(model.eigenvalues))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for at in range(0, len(whole_batch), step := max(1, (1 << 20) // len(sums))):
                b = whole_batch.slice(at, step)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(b), len(sums))
                exact = deviations(x, n, sums)
                white = ((x - whole).astype(np.float64) - rest) @ scaled.value
                lists = pa.ListArray.from_arrays(np.arange(len(b) + 1, dtype=np.int32) * white.shape[1], white.ravel())
                fits = [v < 1 << 63 for v in exact]
                long_ = pa.array([v if f else None for v, f in zip(exact, fits)], pa.int64())
                beyond = pa.array([None if f else float(v) for v, f in zip(exact, fits)], pa.float64())
                yield pa.RecordBatch.from_arrays([b.column(0), long_, beyond, lists], ["vec_id", "deviation", "deviation_beyond", "whitened"])

    return grid.select("vec_id", "x").mapInArrow(rows, f"vec_id {kind}, deviation long, deviation_beyond double, whitened array<double>")


def whiten(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component, numbered from 1 by falling eigenvalue: vec_id, component, n, deviation,
    whitened, explained, identity_error.

    Rows whose vector is null or holds a null or an entry that is not finite are left out, as are vectors not of the
    commonest length (of equally common ones the greatest). Repeated rows and ids count each time. deviation is null
    where it exceeds a long. Components of no variance can't be scaled and are left out: vectors that are all
    equal, or a single one, give an empty result, as does an empty table. Equal eigenvalues: any
    orthonormal components of theirs, the same for all rows. identity_error is the greatest entry of the whitened
    columns' covariance, less the identity. Other columns are ignored.
    """
    grid = of_one_length(on_grid(rows, id_col, vector_col))
    kind = grid.schema["vec_id"].dataType.simpleString()
    model = fit(grid, components)
    if model is None or not len(model.eigenvalues):
        return grid.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    white = stored(project(grid, model))
    k = len(model.eigenvalues)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    told = white.agg(
        F.sum(F.col("deviation").cast("decimal(38,0)")).alias("exact"),
        F.sum("deviation_beyond").alias("beyond"),
        # Spark's covariance takes means off before it multiplies; its divisor is n.
        *[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs],
    ).first()
    trace = (int(told.exact or 0) + (told.beyond or 0.0)) / model.n / model.n / model.n
    error = max(abs(told[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    shares = F.array(*[F.lit(float(e / trace)) for e in model.eigenvalues])
    each = white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error")
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def embedding_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can say of the whitening: each row's exact deviation and the rows that count."""
    return whiten(table(spark, sf_dir, "embeddings")).filter("component = 1").select("vec_id", "n", "deviation")


DEVIATIONS_SQL = f"""
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::DOUBLE)::BIGINT + {SHIFT}) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), entries AS (
  SELECT vec_id, unnest(x) AS x, unnest(range(len(x))) AS dim FROM good
), sums AS (
  SELECT dim, sum(x) AS s, count(*) AS n FROM entries GROUP BY dim
)
SELECT vec_id, max(n)::BIGINT AS n, sum((n * x - s) * (n * x - s))::BIGINT AS deviation
FROM entries JOIN sums USING (dim) GROUP BY vec_id
"""
