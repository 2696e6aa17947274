import re

import numpy as np
import pytest
import xxhash

from quarry.llm import simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles))


def roots(fps, distance=3):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= distance:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_fingerprints(odd_docs):
    got = {(r.doc_id, r.fp % (1 << 64)) for r in simhash.fingerprints(odd_docs).collect()}
    assert got == {(r.doc_id, fingerprint(r.text)) for r in odd_docs.collect()}


def test_components_of_odd_rows(odd_docs, no_docs):
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(odd_docs).collect()}
    assert {(1, 1), (2, 1), (6, 1), (3, 3), (4, 3), (None, None), (5, 5), (7, 7)} == got
    assert simhash.near_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("count,hot", [(3, 8192), (2, 8192), (4, 8192), (3, 20), (2, 10)])
def test_links_lose_none(spark, count, hot):
    rng = np.random.default_rng(count)
    fps = set()
    for centre in rng.integers(0, 1 << 63, 12).tolist():
        for _ in range(25):
            x = centre
            for b in rng.choice(64, rng.integers(0, 5), replace=False).tolist():
                x ^= 1 << b
            fps.add(x)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), 3, count, hot)
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(edges).collect()}
    want = roots(fps)
    groups = {}
    for f, r in want.items():
        groups.setdefault(r, set()).add(f)
    found = {}
    for f in fps:
        found.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_chain_is_one_component(spark):
    chain = [(1 << k) - 1 for k in range(0, 63, 3)]
    edges = simhash.links(spark.createDataFrame([(f,) for f in chain], "fp long"))
    assert len({r.root for r in simhash.components(edges).collect()}) == 1
