"""Embedding whitening by upper-triangle column aggregates.

Vectors are quantised to integers and each distinct one is fitted once. Two aggregations make the model: the
sums of all dimensions, which are exact, and then, by generated SQL expressions, the sums of the centred
products of every pair of dimensions at once. The covariance is put together from these few numbers and
decomposed by LAPACK. Rows are projected where they lie.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import staged

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: A component's 64-fold beyond this counts as this, so that integers stay exact as doubles.
LARGEST = 1 << 52
#: Products of one aggregation: all pairs of up to 70 dimensions; vectors with more take several.
PAIRS = 2500
_RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def quantised(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """(vec_id, x): floor(scale * c) + shift of each component as longs; rows whose vector is null, empty or holds null
    or non-finite components are left out."""
    c = F.transform("embedding", lambda v: v.cast("double"))
    sound = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    small = lambda v: F.greatest(F.least(v * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0) & sound).select("vec_id", F.transform(c, lambda v: F.floor(small(v)).cast("long") + shift).alias("x"))


def covariance(rows: DataFrame, vector: str, means: list[float], n: int) -> np.ndarray:
    """Covariance, with divisor n, of the components of ``vector``: sums of centred products of every pair i <= j."""
    d = len(means)
    centred = rows.select(*[(F.get(vector, F.lit(i)).cast("double") - F.lit(float(means[i]))).alias(f"c{i}") for i in range(d)])
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    out = np.empty((d, d))
    for a in range(0, len(pairs), PAIRS):
        some = pairs[a : a + PAIRS]
        sums = centred.agg(*[F.expr(f"sum(c{i} * c{j})").alias(f"p{i}_{j}") for i, j in some]).first()  # one row
        for (i, j), s in zip(some, sums):
            out[i, j] = out[j, i] = s / n
    return out


@dataclass
class Whitening:
    """A fitted whitening: number of fitted vectors, exact sums, and the components by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    longs: bool
    identity_error: float = 0.0

    def projected(self, x: np.ndarray) -> np.ndarray:
        """Rows of integers as whitened components."""
        means = np.array([(s - self.n * SHIFT) / self.n for s in self.sums])
        return ((x - SHIFT).astype(np.float64) - means) @ (self.vectors / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> np.ndarray:
        """Sum over the dimensions of (n * x - S) squared, exact; what a long cannot hold is its largest value."""
        if self.longs:
            return ((self.n * x - np.array(self.sums)) ** 2).sum(axis=1)
        exact = ((self.n * x.astype(object) - np.array(self.sums, object)) ** 2).sum(axis=1)
        return np.array([min(int(v), (1 << 63) - 1) for v in exact], np.int64)

    def apply(self, rows: DataFrame) -> DataFrame:
        """Of (vec_id, x) a line for each row and component."""
        k, key = len(self.values), rows.schema["vec_id"].dataType.simpleString()
        names = ["vec_id", *[f.split()[0] for f in _RESULT.split(", ")]]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in (whole.slice(a, 1000) for a in range(0, whole.num_rows, 1000)):
                    m = batch.num_rows
                    x = batch.column("x").flatten().to_numpy().reshape(m, -1)
                    at = pa.array(np.repeat(np.arange(m), k))
                    columns = [np.tile(np.arange(1, k + 1, dtype=np.int32), m), np.full(m * k, self.n), np.repeat(self.deviation(x), k), self.projected(x).ravel(), np.tile(self.values / self.trace, m), np.full(m * k, self.identity_error)]
                    yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), *map(pa.array, columns)], names=names)

        return rows.mapInArrow(run, f"vec_id {key}, {_RESULT}")

    def arrays(self, rows: DataFrame) -> DataFrame:
        """Of (x) the whitened components as one array ``w``."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    w = self.projected(batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1))
                    offsets = np.arange(0, w.size + 1, w.shape[1], dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(w.ravel()))], names=["w"])

        return rows.select("x").mapInArrow(run, "w array<double>")


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of the distinct x of ``rows``, all of one length; None without rows or without any variance.

    Components of no variance (below the rounding of the largest) are left out.
    """
    distinct = staged(rows.select("x").distinct(), "distinct-vectors")
    first = distinct.first()
    if first is None:
        return None
    d = len(first["x"])
    at = [F.get("x", F.lit(i)) for i in range(d)]
    exact = [F.sum(c.cast("decimal(20,0)")).alias(f"s{i}") for i, c in enumerate(at)]
    row = distinct.agg(F.count("*").alias("n"), *exact, *[F.min(c) for c in at], *[F.max(c) for c in at]).first()
    n, sums, low, high = row[0], [int(s) for s in row[1 : d + 1]], row[d + 1 : 2 * d + 1], row[2 * d + 1 :]
    furthest = sum(max(abs(n * v - s) for v in (a, b)) ** 2 for a, b, s in zip(low, high, sums))
    shifted = distinct.select(F.transform("x", lambda v: v - SHIFT).alias("x"))  # small numbers keep their digits as doubles
    v = covariance(shifted, "x", [(s - n * SHIFT) / n for s in sums], n)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values)[:components]
    order = order[values[order] > d * np.finfo(float).eps * max(values.max(), 0.0)]
    if not len(order):
        return None
    longs = furthest < 1 << 63 and n * max(map(abs, (*low, *high))) < 1 << 62 and max(map(abs, sums)) < 1 << 62
    model = Whitening(n, sums, values[order], vectors[:, order], float(np.trace(v)), longs)
    white = staged(model.arrays(distinct), "whitened")
    k = len(order)
    means = list(white.agg(*[F.avg(F.get("w", F.lit(i))) for i in range(k)]).first())
    model.identity_error = float(np.abs(covariance(white, "w", means, n) - np.eye(k)).max())
    return model


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and component.

    Needs vec_id and embedding; other columns are left aside. Rows whose vector is null, empty or holds null or
    non-finite components are left out, and so are those of another length than most rows have (of equally
    frequent lengths the larger counts). Repeated rows and null vec_ids stay. Tables without variance (empty, or
    of one distinct vector) give no rows.
    """
    rows = staged(quantised(vectors), "quantised")
    sizes = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    own = rows.filter(F.size("x") == (sizes[0]["d"] if sizes else 0))
    model = fit(own, components)
    if model is None:
        key = rows.schema["vec_id"].dataType.simpleString()
        return vectors.sparkSession.createDataFrame([], f"vec_id {key}, {_RESULT}")
    return model.apply(own)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the whitened components of every vector."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
