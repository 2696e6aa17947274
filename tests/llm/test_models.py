import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm import quality, toxicity


def counts(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, held = Counter(windows), set()
    for i, x in enumerate(windows):
        if often[x] > 1:
            held |= {i, i + 1, i + 2}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(held)


def test_statistics(make_docs, odd_docs, no_docs):
    more = make_docs([(10, "a b c a b c a b\na b c\na b c\n\n", "x"), (11, "x y z q x y z", "x"), (12, "a a a a a", "x"), (13, "# $ | <b> & a\x0bb", "x")])
    both = odd_docs.unionByName(more)
    for r in quality.assess(both, quality.DecisionList()).collect():
        assert tuple(r.q_stats)[:5] == counts(r.text), r.doc_id
        n, _, _, _, repeated = counts(r.text)
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n) and r.kept == (not r.base_failed)
        assert r.q_words == 2
    assert quality.assess(no_docs, quality.DecisionList()).count() == 0


@pytest.fixture(scope="module")
def labelled(spark, make_docs):
    good = [(i, " ".join(f"w{(i * 7 + k) % 97}x{k}" for k in range(60 + i % 30)), "a") for i in range(120)]
    bad = [(200 + i, " | ".join(f"c{(i + k) % 89}y{k}" for k in range(60 + i % 20)), "a") for i in range(60)]
    docs = make_docs(good + bad)
    labels = spark.createDataFrame([(i, 1, 0) for i, *_ in good] + [(i, 0, 0) for i, *_ in bad] + [(None, 0, 1), (9999, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_decision_list_learns_and_keeps_clean(labelled):
    docs, labels = labelled
    rules = quality.learn(docs, labels)
    assert rules.rules
    kept = {r.doc_id: r.kept for r in quality.assess(docs, rules).collect()}
    assert all(kept[i] for i in range(120)) and not any(kept[200 + i] for i in range(60))


def test_no_labels_keep_everything(spark, labelled):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.learn(labelled[0], none).rules == []
    model = toxicity.train(labelled[0], none)
    assert {r.score for r in model.score(labelled[0]).collect()} == {0.0}


def test_quality_of_the_tables(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir[:-5]}0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.assess(docs, quality.learn(docs, labels)).join(labels, "doc_id").filter("NOT base_failed")
    n = {(r.quality, r.kept): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[(1, True)] and n.get((0, False), 0) > n.get((0, True), 0)


def test_features():
    at = dict(zip(toxicity.FEATURES, toxicity.dense_features("You IDIOT! you are a m0ron, st*pid", {}, {})))
    assert at["insults"] > 0 and at["near_person"] > 0 and at["obfuscated"] > 0 and at["uncovered"] > 0 and at["capital_words"] > 0
    assert toxicity.dense_features(None, {}, {}) == toxicity.dense_features("", {}, {}) == [0.0] * len(toxicity.FEATURES)
    learned = dict(zip(toxicity.FEATURES, toxicity.dense_features("loweixyz schön", {"lowei~": 3.0}, {})))
    assert learned["learned"] == 50


def test_toxicity_held_out(spark, sf_dir, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"{sf_dir[:-5]}0.1/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.held_out(F.col("doc_id"))
    model = toxicity.train(docs, labels.filter(~held))
    scored = model.score(docs.join(labels.filter(held), "doc_id"))
    n = {(r.toxic, r.predicted): r["count"] for r in scored.groupBy("toxic", "predicted").count().collect()}
    assert n[(1, 1)] / (n[(1, 1)] + n.get((1, 0), 0)) > 0.8 and n.get((0, 1), 0) / n[(0, 0)] < 0.03
    odd = model.score(odd_docs).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 and r.t_raw == 4 for r in odd)
    assert model.score(no_docs).count() == 0
