import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quarry.llm import bitslice

SCHEMA = "vec_id long, embedding array<float>, label int, rank int, block int"


MOST = (1 << 63) - 1


def brute(rows, every, k, scale=256):
    q = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    queries = {}
    for i, v in q:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    for i, v in queries.items():
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in q if j != i and len(w) == len(v))[:k]
        out |= {(i, r + 1, j, max(-MOST, min(MOST, -s))) for r, (s, j) in enumerate(best)}
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0, 0) for i, v in rows], SCHEMA)


def test_top_k_is_exact_with_ties_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.1, 8)]) for i in range(230)]
    rows += [(300 + i, rows[5][1]) for i in range(40)]  # ties
    rows += [(400, None), (401, [0.1] * 7 + [None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [0.5, 0.5]), (405, [1.0, 2.0]), (None, rows[0][1]), (420, [0.0] * 8), (440, []), (460, [])]
    got = {tuple(r) for r in bitslice.top_k(frame(spark, rows), every=20, block_rows=64).collect()}
    assert got == brute(rows, 20, 5)


def test_fewer_rows_than_k_and_none(spark):
    rows = [(0, [0.5, -0.25]), (1, [1.0, 1.0])]
    assert {tuple(r) for r in bitslice.top_k(frame(spark, rows)).collect()} == brute(rows, 50, 5)
    assert bitslice.top_k(frame(spark, [])).count() == 0
    assert bitslice.top_k(frame(spark, rows[:1])).count() == 0


def test_large_finite_components(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 3) * 10.0 ** rng.integers(-3, 8, 3)]) for i in range(120)]
    rows += [(200, [1e9, 0.0, -1e9]), (201, [-1e9, 1e9, 0.25]), (202, [0.0, 5e6, 0.0]), (203, [1.0, 5e6, 0.0])]
    assert {tuple(r) for r in bitslice.top_k(frame(spark, rows), every=20, block_rows=50).collect()} == brute(rows, 20, 5)


def test_scores_beyond_a_long_are_ranked_exactly(spark):
    rows = [(0, [1e12, 1e12]), (1, [1e12, 1e12]), (2, [2e12, 1e12]), (3, [1e12, 1.5e12]), (4, [-1e12, -1e12]), (5, [0.0, 0.0])]
    got = [(r.rank, r.vec_id, r.score) for r in bitslice.top_k(frame(spark, rows), block_rows=2).orderBy("rank").collect()]
    assert got == [(1, 2, MOST), (2, 3, MOST), (3, 1, MOST), (4, 5, 0), (5, 4, -MOST)]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 150), st.integers(1, 9), st.integers(1, 300))
def test_slices_add_up(seed, n, dims, size):
    rng = np.random.default_rng(seed)
    values, query = rng.integers(0, size, (n, dims)), rng.integers(-size, size, dims)
    width = int(values.max()).bit_length()
    words = -(-n // 64)
    bits = np.zeros((dims, width, words * 64), np.uint8)
    for k in range(width):
        bits[:, k, :n] = (values >> k & 1).T
    slices = np.packbits(bits, axis=-1, bitorder="little").view(np.uint64).reshape(dims, width, words)
    scores, constant = bitslice.score_slices(slices, query)
    unpacked = np.unpackbits(scores.view(np.uint8), axis=-1, bitorder="little")[:, :n].astype(np.int64)
    assert ((unpacked << np.arange(len(scores))[:, None]).sum(0) + constant == values @ query).all()
