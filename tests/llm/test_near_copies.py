"""The stage against brute force over sets of five-word shingles."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import near_copies
from quarry.llm.shared import spread_join

from .test_simhash import LOWER


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(" ".join(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([" ".join(w)] if w else [])


def linked(a, b, similarity=0.8):
    return a == b or (len(a & b) >= similarity * len(a | b) and len(a & b) > 0)


def groups(sets):
    """A root for each set, by links; candidates share a shingle."""
    parent, by = {s: s for s in sets}, {}

    def find(x):
        while parent[x] is not x:
            x = parent[x]
        return x

    pairs = set()
    for s in parent:
        for x in s:
            by.setdefault(x, []).append(s)
    for held in by.values():
        for i, a in enumerate(held):
            for b in held[:i]:
                if linked(a, b):
                    pairs.add((a, b))
                    parent[find(a)] = find(b)
    return {s: find(s) for s in parent}, pairs


def one_of_each(rows):
    """The doc_ids that stay, and the pairs of other texts that are linked."""
    sets = {(r.doc_id, r.text): shingles(r.text) for r in rows}
    root, pairs = groups(set(sets.values()))
    least = {}
    for (i, _), s in sets.items():
        key = root[s]
        least[key] = min(least.get(key, (True, 0)), (i is None, i or 0))
    return sorted(least.values()), pairs


def ids(rows):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in rows)


def test_odd_rows(odd_docs, no_docs):
    kept = near_copies.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert ids(kept.collect()) == [(False, 1), (False, 3), (False, 5), (False, 7), (True, 0)]
    assert near_copies.drop_near_copies(no_docs).count() == 0


def test_rows_of_one_id_with_other_texts_stay(make_docs):
    texts = [" ".join(f"{w}{k}" for k in range(40)) for w in "abcdefg"]
    docs = make_docs([(None, texts[0], "a"), (None, texts[1], "a"), (3, texts[2], "a"), (3, texts[3], "a"), (1, texts[4], "a"), (None, texts[4], "b"), (2, texts[4], "b"), (2, texts[4], "b"), (None, texts[0], "c")])
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in near_copies.drop_near_copies(docs).collect())
    assert kept == [(False, 1, texts[4]), (False, 3, texts[2]), (False, 3, texts[3]), (True, 0, texts[0]), (True, 0, texts[1])]


@pytest.mark.parametrize("hot_rows", [near_copies.HOT_ROWS, 40])
def test_planted_copies(make_docs, hot_rows):
    rng = random.Random(3)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([12, 60, 300]))]
        for _ in range(25 if g else 150):
            own = list(base)
            for _ in range(rng.randrange(0, max(2, len(base) // 40))):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own), "a"))
    docs = make_docs(rows)
    got = ids(near_copies.drop_near_copies(docs, hot_rows=hot_rows).collect())
    want, pairs = one_of_each(docs.collect())
    assert set(want) <= set(got) and len(pairs) > 1000
    assert len(got) - len(want) <= 0.02 * (len(rows) - len(want))  # a copy is missed with a small chance


def pairs_of(rng, low, high, words, count):
    """Pairs of texts whose similarity lies in a band, by replacing single words."""
    out = []
    while len(out) < count:
        a = [f"w{rng.randrange(10**7)}" for _ in range(words)]
        b, order = list(a), rng.sample(range(words), words)
        while order and len(shingles(" ".join(a)) & shingles(" ".join(b))) >= low * len(shingles(" ".join(a)) | shingles(" ".join(b))):
            x, y = shingles(" ".join(a)), shingles(" ".join(b))
            if b != a and len(x & y) < high * len(x | y):
                out.append((" ".join(a), " ".join(b)))
                break
            b[order[-1]] = f"x{rng.randrange(10**7)}" if rng.random() < 0.7 else b[order[-1] - 1]
            order.pop()
    return out


@pytest.mark.parametrize(("low", "high"), [(0.8, 0.85), (0.85, 0.9), (0.9, 1.0)])
@pytest.mark.parametrize("words", [40, 100, 300])
def test_recall_by_similarity_and_length(make_docs, low, high, words):
    pairs = pairs_of(random.Random(words), low, high, words, 120)
    rows = [(2 * i + k, t, "a") for i, pair in enumerate(pairs) for k, t in enumerate(pair)]
    kept = near_copies.drop_near_copies(make_docs(rows)).count()
    assert (len(rows) - kept) / len(pairs) >= 0.95


@pytest.mark.parametrize("limits", [(near_copies.BLOCK_TEXTS, near_copies.HOT_ROWS), (32, 100)])
def test_copies_of_a_template_write_a_link_each(make_docs, monkeypatch, limits):
    """Many near copies of one text, one that is like it and not near, and a second template: a link for each text, at most."""
    monkeypatch.setattr(near_copies, "BLOCK_TEXTS", limits[0])
    rng, written = random.Random(9), []
    real = near_copies._similar
    monkeypatch.setattr(near_copies, "_similar", lambda *a: written.append(real(*a)) or written[-1])
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(1500):
        own = list(base)
        own[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own), "a"))
    rows += [(2000 + i, " ".join([*base[:92], *(f"y{i}_{k}" for k in range(28))]), "a") for i in range(4)]
    other = [*base[:88], *(f"z{k}" for k in range(32))]
    rows += [(3000 + i, " ".join([*other[:119], f"o{i}"]), "a") for i in range(300)]
    kept = ids(near_copies.drop_near_copies(make_docs(rows), hot_rows=limits[1]).collect())
    assert kept == [(False, 0), *((False, 2000 + i) for i in range(4)), (False, 3000)]
    assert 1798 <= written[0].count() <= len(rows) * (1 if limits[0] > 32 else 2)


def test_no_pair_below_the_similarity_is_linked(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir[:-5]}0.01/documents.parquet")
    got, (want, pairs) = ids(near_copies.drop_near_copies(docs).collect()), one_of_each(docs.collect())
    assert set(want) <= set(got) and len(got) - len(want) <= 0.02 * len(pairs)


def test_shape_keeps_tables_sparse_and_misses_few():
    for n in (1, 10**5, 10**7, 10**10):
        width, count, unsure = near_copies.shape(n)
        assert width * count >= near_copies.CHECKED and (n << unsure) / 2**width <= 400


def test_hot_keys_are_spread_and_lose_nothing(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else "hot" if i % 3 == 1 else f"k{i}") for i in range(600)], "id int, k string")
    table = rows.groupBy("k").count().withColumnRenamed("count", "n").filter("k IS NULL OR k <> 'k599'").selectExpr("k", "n", "coalesce(k, 'none') AS v")
    for how, size in (("left", 600), ("inner", 599)):
        got = spread_join(rows, table, "k", "n", 600, F.col("id"), how)
        assert got.columns == ["id", "k", "v"] and got.count() == size
        assert all(r.v == (r.k or "none") or r.k == "k599" for r in got.collect())
