"""Embedding whitening: Spark MLlib's ``computeSVD`` on the centred rows.

Components become integers ``x = floor(256 * c)``; the fit list is each distinct integer vector once. Its
``n`` rows and exact sums ``S`` centre it as ``(n * x - S) / n``, one rounding a component, and
``RowMatrix.computeSVD`` sums the Gramian over the partitions, so that only a matrix of d x d comes to the
driver. A singular value s gives the eigenvalue s^2 / n of the covariance. The total variance does not
come from the singular values: it is the sum of the rows' exact integer deviations over n^3.

All singular values are asked for, as MLlib decomposes the Gramian in full precision then (its iterative
solver, for a few of them, stops at 1e-10).

Defined results: rows whose vector is null or holds null or non-finite components are left out; repeated rows
count once in the fit and are returned each; vectors of different lengths are fitted apart; directions of no variance
(an eigenvalue of at most 1e-12 of the first) cannot be whitened and are not returned, so that one distinct vector
or an empty table gives an empty result; a null ``vec_id`` is returned as such; extra columns are ignored. A
deviation beyond a long is null in the query, and one of more than 38 digits in :func:`whiten` too.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, vectors

SCALE, KEEP = 256, 4
#: singular values below this share of the first count as none
LEAST = 1e-6


@dataclass(frozen=True)
class Model:
    """``axes`` holds a component a column; ``variances`` their eigenvalues, falling."""

    n: int
    sums: list[int]
    axes: np.ndarray
    variances: np.ndarray
    total: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, exactly: as Python integers where a long could not hold it."""
        wide = self.n * vectors.largest(x) + max(map(abs, self.sums), default=0) >= 2**63
        return x.astype(object if wide else np.int64) * self.n - np.array(self.sums, dtype=object if wide else np.int64)

    def deviations(self, x: np.ndarray) -> list[int]:
        y = self.centred(x)
        if y.dtype == object or vectors.largest(y) ** 2 * max(1, y.shape[1]) >= 2**63:
            y = y.astype(object)
        return [int(v) for v in (y * y).sum(axis=1)] if y.shape[1] else [0] * len(y)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) / self.n).astype(np.float64) @ self.axes / np.sqrt(self.variances)


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Rows, and sums by dimension."""
    sums = fit.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.sum(F.col("v").cast("decimal(20,0)")).alias("s"))
    at = {r["pos"]: int(r["s"]) for r in sums.collect()}  # one row a dimension
    return fit.count(), [at.get(i, 0) for i in range(d)]


def with_deviation(rows: DataFrame, model: Model, d: int) -> DataFrame:
    """The rows with ``deviation decimal(38,0)``, the exact sum over dimensions of (n * x - S)^2 (null
    from 10^38 on), as a double ``spread``, and with ``w``, the whitened components the model has so far."""
    has = model.axes.shape[1] > 0

    def run(batches):
        for b in batches:
            x = vectors.matrix(b.column("x"), d)
            w = model.whitened(x) if has else np.zeros((len(x), 0))
            cols = [b.column(c) for c in names]
            exact = model.deviations(x)
            cols.append(pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0)))
            cols.append(pa.array([float(v) for v in exact]))
            cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel())))
            yield pa.RecordBatch.from_arrays(cols, [*names, "deviation", "spread", "w"])

    names = rows.columns
    return rows.mapInArrow(common.lean(run), ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", deviation decimal(38,0), spread double, w array<double>")


def fit_model(fit: DataFrame, d: int, keep: int = KEEP) -> Model | None:
    """The model of a stored list of distinct vectors; None where nothing varies."""
    n, sums = exact_sums(fit, d)
    blank = Model(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    if n < 2 or d == 0:
        return None
    spread = with_deviation(fit, blank, d).agg(F.sum("spread")).first()[0]
    if not spread:
        return None
    mean = F.lit(np.array([float(s) for s in sums]))
    whole = vectors_within(fit, n, sums)
    y = F.zip_with("x", mean, lambda v, s: (v.cast("double") * n - s) / n) if whole else F.zip_with("x", mean, lambda v, s: v.cast("double") - s / n)
    rows = MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(y).alias("v")), "v")
    svd = RowMatrix(rows, n, d).computeSVD(min(d, n), computeU=False, rCond=LEAST)
    s, v = svd.s.toArray(), svd.V.toArray()
    k = min(keep, len(s))
    return Model(n, sums, v[:, :k] / np.linalg.norm(v[:, :k], axis=0), s[:k] ** 2 / n, float(spread) / float(n) ** 3)


def vectors_within(fit: DataFrame, n: int, sums: list[int]) -> bool:
    """Whether n * x and S are whole numbers that a double holds."""
    most = fit.agg(F.max(F.greatest(F.abs(F.array_max("x").cast("double")), F.abs(F.array_min("x").cast("double"))))).first()[0]
    return n * most < 2**53 and all(abs(s) < 2**53 for s in sums)


def whiten(table: DataFrame, keep: int = KEEP, scale: int = SCALE) -> DataFrame:
    """``vec_id, component, n, deviation decimal(38,0), whitened, explained, identity_error`` of ``table(vec_id,
    embedding)``: a row for each usable vector and component."""
    rows = common.store(vectors.integer_vectors(table, scale, "vec_id"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    out = rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    for d, part in vectors.by_length(rows):
        fit = common.store(part.select("x").distinct())
        model = fit_model(fit, d, keep)
        if model is None:
            continue
        k = model.axes.shape[1]
        w = with_deviation(fit, model, d)
        cov = w.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        error = max(abs(cov[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i, k))
        explained = F.lit(model.variances / model.total)
        out = out.unionByName(
            with_deviation(part, model, d).select("vec_id", "deviation", F.posexplode("w").alias("_c", "whitened"))
            .select("vec_id", (F.col("_c") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("_c")].alias("explained"), F.lit(float(error)).alias("identity_error")))
    return out


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(common.load(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
