"""Approximate nearest neighbours: an inverted file of vectors with product-quantised residuals, ranked exactly at the end.

Vectors are brought to unit length, so that cosine is an inner product. Each lies in the list of its closest centre, and what
is left of it is written as one byte for each part of its dimensions. A search looks at the lists closest to its query alone,
scores bytes by tables, and computes the cosine of the best by their whole vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine, dot
from .semantic import matching, nearest_batch

#: Vectors that centres and codes are fitted on, those with the smallest hashes of their key.
SAMPLE = 20_000
#: Codes of a part of the dimensions: what a byte holds.
CODES = 256
#: Queries that travel to the tasks at once.
BLOCK = 1000
#: Rows that are scored at once against a block.
SLICE = 2048


@dataclass(frozen=True)
class Model:
    """Centres of lists, and for each part of the dimensions its codes. Its size follows from parameters, never from the rows."""

    centres: np.ndarray
    books: np.ndarray

    @property
    def lists(self) -> int:
        return len(self.centres)

    def parts(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors cut into parts: (parts, vectors, dimensions of a part)."""
        return vectors.reshape(len(vectors), len(self.books), -1).transpose(1, 0, 2)

    def listed(self, vectors: np.ndarray, n: int) -> np.ndarray:
        """The n closest lists of each vector, closest first."""
        far = (self.centres**2).sum(1) - 2 * vectors @ self.centres.T
        return np.argsort(far, axis=1, kind="stable")[:, :n]

    def coded(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, codes of the residual) of each vector."""
        lists = self.listed(vectors, 1)[:, 0]
        return lists, np.stack([_closest(p, b) for p, b in zip(self.parts(vectors - self.centres[lists]), self.books)], axis=1).astype(np.uint8)


def _closest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)


def _lloyd(points: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """At most k centres of a bounded sample; it starts from evenly spaced points, and a centre without points stays."""
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(rounds):
        near = _closest(points, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, points[:, d], len(centres)) for d in range(points.shape[1])], axis=1)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def _units(vectors: pd.Series) -> np.ndarray:
    v = np.array(vectors.tolist(), dtype=float)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def usable(vectors: DataFrame, dims: int, vector: str = "embedding") -> DataFrame:
    """Vectors of a length that can be compared: dims finite components, not all zero. Others take no part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter((F.size(v) == dims) & finite).filter(dot(v, v) > 0)


def fit(vectors: DataFrame, dims: int, lists: int = 32, parts: int = 16, sample: int = SAMPLE, key: str = "vec_id", vector: str = "embedding") -> Model:
    """Centres by k-means and codes of their residuals, over at most ``sample`` vectors; one group for each part, of the sample's size."""
    if dims % parts:
        raise ValueError("parts must divide the dimensions")
    rows = usable(vectors, dims, vector).select(key, vector).orderBy(F.xxhash64(key), key).limit(sample)
    unit = rows.select(F.transform(vector, lambda x: x.cast("double") / F.sqrt(dot(F.col(vector), F.col(vector)))).alias("v")).cache()
    try:
        if not unit.head(1):
            return Model(np.zeros((0, dims)), np.zeros((parts, 0, dims // parts)))
        points = unit.select(array_to_vector("v").alias("features"))
        centres = np.array(KMeans(k=lists, seed=7, maxIter=15).fit(points).clusterCenters()) if lists > 1 else np.zeros((1, dims))
        model = Model(centres, np.zeros((parts, 1, dims // parts)))

        def left(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                v = np.array(b["v"].tolist(), dtype=float)
                for no, p in enumerate(model.parts(v - centres[model.listed(v, 1)[:, 0]])):
                    yield pd.DataFrame({"part": no, "p": list(p)})

        def book(b: pd.DataFrame) -> pd.DataFrame:
            points = np.array(b["p"].tolist(), dtype=float)
            c = _lloyd(points[np.lexsort(points.T)], CODES)
            return pd.DataFrame({"part": b["part"].iloc[0], "no": range(len(c)), "c": list(c)})

        found = unit.mapInPandas(left, "part int, p array<double>").groupBy("part").applyInPandas(book, "part int, no int, c array<double>").collect()
        by_part = [[r["c"] for r in sorted(found, key=lambda r: r["no"]) if r["part"] == p] for p in range(parts)]
        return Model(centres, np.array(by_part))
    finally:
        unit.unpersist()


def index(vectors: DataFrame, model: Model, vector: str = "embedding") -> DataFrame:
    """Every usable row of ``vectors`` with its columns, its list and its code. No row moves."""

    @F.pandas_udf("list int, code binary")
    def placed(v: pd.Series) -> pd.DataFrame:
        if not len(v):
            return pd.DataFrame({"list": pd.Series(dtype="int32"), "code": pd.Series(dtype=object)})
        lists, codes = model.coded(_units(v))
        return pd.DataFrame({"list": lists.astype("int32"), "code": [c.tobytes() for c in codes]})

    dims = model.centres.shape[1]
    rows = usable(vectors, dims, vector) if model.lists else vectors.limit(0)
    return rows.withColumn("_placed", placed(vector)).select(*vectors.columns, "_placed.list", "_placed.code")


def save(rows: DataFrame, model: Model, folder: str) -> None:
    """An index in folders by list, so that a search opens those of its lists alone, and its model beside it."""
    rows.repartition("list", F.pmod(F.xxhash64("code"), F.lit(8))).write.partitionBy("list").parquet(f"{folder}/rows")
    spark = rows.sparkSession
    kept = [("centre", 0, n, [float(x) for x in c]) for n, c in enumerate(model.centres)]
    kept += [("code", p, n, [float(x) for x in c]) for p, book in enumerate(model.books) for n, c in enumerate(book)]
    spark.createDataFrame(kept, "kind string, part int, no int, v array<double>").coalesce(1).write.parquet(f"{folder}/model")


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, Model]:
    held = sorted(spark.read.parquet(f"{folder}/model").collect(), key=lambda r: (r["part"], r["no"]))
    parts = 1 + max(r["part"] for r in held)
    books = [[r["v"] for r in held if r["kind"] == "code" and r["part"] == p] for p in range(parts)]
    return spark.read.parquet(f"{folder}/rows"), Model(np.array([r["v"] for r in held if r["kind"] == "centre"]), np.array(books))


def _blocks(queries: DataFrame, dims: int, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    """Queries in blocks by the hash of their id, about BLOCK each: ids and unit vectors."""
    asked = usable(queries, dims, vector).select("query_id", vector)
    n = -(-asked.count() // BLOCK)
    for b in range(n):
        rows = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b).collect()
        if rows:
            yield [r[0] for r in rows], _units(pd.Series([r[1] for r in rows]))


def _probed(rows: DataFrame, model: Model, probes: np.ndarray) -> DataFrame:
    seen = [int(x) for x in np.unique(probes)]
    return rows if len(seen) == model.lists else rows.filter(F.col("list").isin(seen))


def _candidates(rows: DataFrame, model: Model, asked: np.ndarray, probes: np.ndarray, keep: int, key: str) -> DataFrame:
    """(q, key, approx): of each task, the ``keep`` best rows for each query among the lists that it probes."""
    asking = {int(n): np.flatnonzero((probes == n).any(1)) for n in np.unique(probes)}

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables = np.einsum("pqd,pcd->pqc", model.parts(asked), model.books)
        base = asked @ model.centres.T
        floor = np.full(len(asked), -np.inf)
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for n, group in b.groupby("list"):
                q = asking[int(n)]
                for at in range(0, len(group), SLICE):
                    part = group.iloc[at : at + SLICE]
                    codes = np.frombuffer(b"".join(part["code"]), np.uint8).reshape(len(part), -1)
                    s = base[q, int(n)][:, None] + sum(tables[p][q][:, codes[:, p]] for p in range(codes.shape[1]))
                    keys = part[key].to_numpy()
                    for i in np.flatnonzero((s >= floor[q][:, None]).any(1)):
                        new = s[i] >= floor[q[i]]
                        old = best.get(q[i])
                        sc, ks = (s[i][new], keys[new]) if old is None else (np.append(old[0], s[i][new]), np.append(old[1], keys[new]))
                        top = np.lexsort((ks, -sc))[:keep]
                        best[q[i]] = sc[top], ks[top]
                        if len(top) == keep:
                            floor[q[i]] = sc[top[-1]]
        for q, (sc, ks) in best.items():
            yield pd.DataFrame({"q": q, key: ks, "approx": sc})

    kind = rows.schema[key].dataType.simpleString()
    return _probed(rows, model, probes).select(key, "list", "code").mapInPandas(score, f"q int, {key} {kind}, approx double")


def search(rows: DataFrame, model: Model, queries: DataFrame, k: int, probes: int, keep: int | None = None, must: dict | None = None, must_not: dict | None = None, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score) of about the k closest rows for each of ``queries`` (query_id, vector); score is the exact cosine.

    Keys and query ids are distinct and not null. ``must`` and ``must_not`` give, by column, the values that a row has, or has not; they hold before anything is ranked.
    Each query probes ``probes`` lists, and its ``keep`` best by code (ten times k unless given) are scored by their vectors.
    A block of queries and its candidates (BLOCK times keep rows) go to every task; the index is not shuffled. Ties go to the smaller key.
    Without usable rows or queries the result is empty.
    """
    spark, keep = rows.sparkSession, keep or 10 * k
    q_type, k_type = queries.schema["query_id"].dataType.simpleString(), rows.schema[key].dataType.simpleString()
    out = spark.createDataFrame([], f"query_id {q_type}, rank int, {key} {k_type}, score double")
    allowed = matching(rows, must, must_not)
    for ids, asked in _blocks(queries, model.centres.shape[1], vector) if model.lists else ():
        lists = model.listed(asked, probes)
        order = Window.partitionBy("q").orderBy(F.desc("approx"), key)
        best = _candidates(allowed, model, asked, lists, keep, key).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= keep).select("q", key)
        block = spark.createDataFrame([(n, i, [float(x) for x in v]) for n, (i, v) in enumerate(zip(ids, asked))], f"q int, query_id {q_type}, asked array<double>")
        found = F.broadcast(best).join(_probed(allowed, model, lists).select(key, vector), key).join(F.broadcast(block), "q")
        scored = found.select("query_id", key, cosine(F.col(vector), F.col("asked")).alias("score"))
        ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))
        out = out.unionByName(ranked.filter(F.col("rank") <= k).select("query_id", "rank", key, "score"))
    return out


def scored_rows(rows: DataFrame, model: Model, queries: DataFrame, probes: int, vector: str = "embedding") -> int:
    """How many rows the queries score by code, all together."""
    sizes = {r["list"]: r["count"] for r in rows.groupBy("list").count().collect()}
    return sum(sizes.get(int(n), 0) for _, asked in _blocks(queries, model.centres.shape[1], vector) for n in model.listed(asked, probes).ravel())


def probes_for(rows: DataFrame, model: Model, k: int, target: float = 0.97, queries: int = 64, key: str = "vec_id", vector: str = "embedding") -> int:
    """Few probes that find ``target`` of the k exact neighbours of a bounded sample of rows as queries: doubled from one, at last less a quarter where that is enough; all lists if none do."""
    taken = rows.select(F.col(key).alias("query_id"), vector).orderBy(F.xxhash64(F.col("query_id"), F.lit("asked")), "query_id").limit(queries).collect()
    if not taken:
        return 1
    asked = rows.sparkSession.createDataFrame(taken, rows.select(F.col(key).alias("query_id"), vector).schema)
    exact = {(r["query_id"], r[key]) for r in nearest_batch(rows, {r["query_id"]: r[vector] for r in taken}, k, vector, key).collect()}

    def enough(n: int) -> bool:
        found = {(r["query_id"], r[key]) for r in search(rows, model, asked, k, n, key=key, vector=vector).select("query_id", key).collect()}
        return len(found & exact) >= target * len(exact)

    n = 1
    while n < model.lists and not enough(n):
        n *= 2
    less = min(n, model.lists) * 3 // 4
    return less if less > n // 2 and enough(less) else min(n, model.lists)
