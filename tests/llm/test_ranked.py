"""Ranked search against a plain scorer over all documents."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from quarry.llm import ranked

from .test_decontaminate import words


def brute(docs, items, top=50):
    tfs = [(i, Counter(words(t))) for i, t in docs]
    held = [(i, c) for i, c in tfs if c]
    n_docs, total, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item] |= set(words(text))
    out = []
    for item, terms in asked.items():
        found = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, rank + 1, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def got(found):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect()], key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    word = lambda: "the" if rng.random() < 0.3 else f"w{int(rng.expovariate(0.05))}"
    docs = [(i if i % 9 else None, " ".join(word() for _ in range(rng.randrange(0, 80))), "a") for i in range(300)]
    docs += [docs[3], docs[3], (1000, docs[5][1].upper(), "b"), (1001, None, "b"), (1002, "?!", "b"), (1003, "ß漢 É x", "b")]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 12)))) for i in range(20)]
    items += [(3, "w1 w2 W1"), (None, "the w3"), (40, None), (41, ""), (42, "nowhere"), (43, "ß漢 É")]
    return docs, items


@pytest.mark.parametrize(("top", "block_terms", "buckets"), [(50, ranked.BLOCK_TERMS, 64), (7, 20, 3)])
def test_against_all_documents(spark, make_docs, corpus, top, block_terms, buckets):
    docs, items = corpus
    table = spark.createDataFrame([(i, t, 5, "s") for i, t in items], "item_id long, text string, row int, score string")
    index = ranked.build(make_docs(docs), buckets)
    assert got(ranked.ranked(index, table, top, block_terms)) == brute([d[:2] for d in docs], items, top)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, "the word"), (2, "naïve")], "item_id long, text string")
    assert got(ranked.ranked(ranked.build(odd_docs), items)) == brute([(r.doc_id, r.text) for r in odd_docs.collect()], [(1, "the word"), (2, "naïve")])
    assert got(ranked.ranked(ranked.build(no_docs), items)) == []
    assert got(ranked.ranked(ranked.build(odd_docs), items.limit(0))) == []


def test_a_search_reads_only_the_buckets_of_its_terms(spark, make_docs, corpus):
    index = ranked.build(make_docs(corpus[0]))
    terms = spark.createDataFrame([("w1",), ("w2",)], "term string")
    plan = index.of(terms)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN|=|INSET)", plan)
    assert sum(r.n for r in index.of(terms).collect()) == sum(len({"w1", "w2"} & set(words(t))) for _, t, _ in corpus[0])
