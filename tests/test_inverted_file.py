"""The inverted file against exact search by numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import inverted_file as ivf
from quarry.plans import catalog


def exact(ids, vectors, asked, k, allowed=None):
    """By query, the ids of the k closest vectors."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for q in asked:
        s = unit @ unit[ids.index(q)]
        order = sorted((i for i in range(len(ids)) if allowed is None or allowed[i]), key=lambda i: (-s[i], ids[i]))
        out[q] = [ids[i] for i in order[:k]]
    return out


def recall(rows, want):
    return len({(r["query_id"], r["vec_id"]) for r in rows} & {(q, v) for q, vs in want.items() for v in vs}) / sum(map(len, want.values()))


@pytest.fixture(scope="module")
def clustered(spark):
    """Twenty clusters, the first of which holds a third of the rows, with a label each."""
    rng = np.random.default_rng(3)
    means = rng.normal(size=(20, 16))
    of = np.where(np.arange(1500) % 3 == 0, 0, rng.integers(0, 20, 1500))
    v = means[of] + 0.4 * rng.normal(size=(1500, 16))
    df = spark.createDataFrame([(i, [float(x) for x in v[i]], int(of[i] % 3)) for i in range(1500)], "vec_id long, embedding array<float>, label int").repartition(4).cache()
    model = ivf.fit(df, 16, lists=20, parts=8)
    return df, model, v, of


def test_recall_and_rows_scored(spark, clustered, tmp_path):
    df, model, v, _ = clustered
    ivf.save(ivf.index(df, model), model, str(tmp_path / "index"))
    rows, kept = ivf.load(spark, str(tmp_path / "index"))
    assert np.array_equal(kept.centres, model.centres) and np.array_equal(kept.books, model.books) and rows.count() == 1500
    asked = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    want = exact(list(range(1500)), v, range(0, 1500, 20), 10)
    n = ivf.probes_for(rows, kept, 10, queries=32)
    found = ivf.search(rows, kept, asked, 10, n).collect()
    assert recall(found, want) >= 0.95
    assert n <= 8 and ivf.scored_rows(rows, kept, asked, 1) < ivf.scored_rows(rows, kept, asked, n) < ivf.scored_rows(rows, kept, asked, 20) == 75 * 1500
    for r in found:
        a, b = v[r["query_id"]].astype("float32").astype(float), v[r["vec_id"]].astype("float32").astype(float)
        assert r["score"] == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-9)
    assert sorted((r["query_id"], r["rank"]) for r in found) == [(q, k) for q in range(0, 1500, 20) for k in range(1, 11)]


def test_filters_hold_before_ranking(clustered):
    df, model, v, of = clustered
    asked = df.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), "embedding")
    found = ivf.search(ivf.index(df, model), model, asked, 5, 20, must={"label": [0, 1]}, must_not={"label": [0]}).collect()
    want = exact(list(range(1500)), v, range(20), 5, [x % 3 == 1 for x in of])
    assert {of[r["vec_id"]] % 3 for r in found} == {1} and recall(found, want) >= 0.95


def test_blocks_of_queries_give_the_same_rows(clustered, monkeypatch):
    df, model, _, _ = clustered
    rows = ivf.index(df, model)
    asked = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    once = sorted(map(tuple, ivf.search(rows, model, asked, 5, 4).collect()))
    monkeypatch.setattr(ivf, "BLOCK", 9)
    assert sorted(map(tuple, ivf.search(rows, model, asked, 5, 4).collect())) == once


def test_vectors_that_cannot_be_compared(spark):
    bad = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [float("inf"), 1.0])]
    df = spark.createDataFrame([*bad, (7, [1.0, 0.0]), (8, [1.0, 0.0]), (9, [0.0, 1.0])], "vec_id long, embedding array<float>")
    asked = df.select(F.col("vec_id").alias("query_id"), "embedding")
    model = ivf.fit(df, 2, lists=2, parts=1)
    found = sorted(tuple(r) for r in ivf.search(ivf.index(df, model), model, asked, 2, 2).collect())
    assert found == [(7, 1, 7, 1.0), (7, 2, 8, 1.0), (8, 1, 7, 1.0), (8, 2, 8, 1.0), (9, 1, 9, 1.0), (9, 2, 7, 0.0)]
    none = df.filter("vec_id < 7")
    model = ivf.fit(none, 2, lists=2, parts=1)
    assert ivf.search(ivf.index(none, model), model, asked, 2, 2).collect() == [] and ivf.probes_for(ivf.index(none, model), model, 2) == 1


def test_query_recall(spark, sf_dir):
    rows = catalog.vector_topk_probed(spark, sf_dir).collect()
    held = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("embedding IS NOT NULL").collect()
    ids, v = [r["vec_id"] for r in held], np.array([r["embedding"] for r in held], dtype=float)
    assert recall(rows, exact(ids, v, [i for i in ids if i % 20 == 0], 10)) >= 0.95
