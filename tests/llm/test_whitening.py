"""Whitening against numpy over all rows."""

import math
import random

import numpy as np
import pytest

from quarry.llm import whitening


def brute(rows, most=16):
    """(n, S, V, eigenvalues, components) of the distinct quantised vectors, and x of each row."""
    xs = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows]
    u = np.unique(np.array([x for _, x in xs]), axis=0)
    n, s = len(u), u.sum(axis=0)
    y = (n * u - s) / n
    v = y.T @ y / n
    e, c = np.linalg.eigh(v)
    order = np.argsort(-e)[:most]
    return xs, n, s, v, e[order], c[:, order]


def check(vectors, rows):
    got = {}
    for r in whitening.whitened(vectors).collect():
        got.setdefault(r.vec_id, []).append(r)
    xs, n, s, v, e, c = brute(rows)
    assert sum(map(len, got.values())) == len(xs) * len(e)
    for i, x in xs:
        d = sum((n * a - int(b)) ** 2 for a, b in zip(x, s))
        want = ((np.array(x) - s / n) @ c) / np.sqrt(e)
        for r in got[i]:
            assert r.n == n and r.deviation == min(d, 2**63 - 1) and r.identity_error <= 1e-9
            assert abs(r.explained - e[r.component - 1] / np.trace(v)) <= 1e-9
            assert abs(abs(r.whitened) - abs(want[r.component - 1])) <= 1e-6


@pytest.mark.parametrize("pairs", [whitening.PAIRS, 50])
def test_against_numpy(spark, monkeypatch, pairs):
    """Repeated rows and vectors count once; sign is free; products in one aggregation or several."""
    monkeypatch.setattr(whitening, "PAIRS", pairs)
    rng = random.Random(2)
    base = [[rng.gauss(0.2 * k, 0.3 + 0.1 * k) for k in range(18)] for _ in range(80)]
    rows = [(i, base[i % 60] if i < 200 else base[60 + i % 20]) for i in range(260)]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rows)


def test_odd_rows_and_clashing_columns(spark):
    rng = random.Random(4)
    rows = [(i, [rng.random() for _ in range(3)]) for i in range(20)]
    odd = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 0.0, 1.0]), (105, [1.0, 2.0])]
    vectors = spark.createDataFrame([(i, v, 1, "n") for i, v in rows + odd], "vec_id long, embedding array<float>, x int, n string")
    check(vectors, rows)
    assert [r.component for r in whitening.whitened(vectors.filter("vec_id IN (3, 4)")).collect()] == [1, 1]  # two vectors vary along one line
    assert whitening.whitened(vectors.filter("vec_id = 3")).collect() == []
    empty = whitening.whitened(vectors.limit(0))
    assert empty.collect() == [] and empty.columns == whitening.whitened(vectors.filter("vec_id < 5")).columns


def test_numbers_beyond_longs(spark):
    """A deviation that a long cannot hold is the largest long; components beyond 2**52 count as that."""
    rows = [(i, [float(1 << 40) * (i - 3), float(1 << 38) * (i * i % 5)]) for i in range(7)]
    check(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), rows)
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 0.5])], "vec_id long, embedding array<float>")
    found = whitening.whitened(huge).collect()
    assert {r.vec_id for r in found} == {1, 2, 3} and max(r.deviation for r in found) == 2**63 - 1
