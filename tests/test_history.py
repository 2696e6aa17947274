"""Ancestry against a plain search over random histories, and over a very long one."""

import random

from quarry.operators import history

SCHEMA = "sha string, parents array<string>"


def reachable(parents, tip):
    seen, left = set(), [tip]
    while left:
        c = left.pop()
        if c not in seen:
            seen.add(c)
            left += [p for p in parents.get(c, []) if p]
    return seen


def test_random_histories(spark):
    """Merges, several roots, parents that no commit tells of, repeated rows, unknown commits."""
    rng = random.Random(6)
    parents = {}
    for i in range(150):
        known = [f"c{k}" for k in range(max(0, i - rng.choice([3, 40])), i)]
        parents[f"c{i}"] = rng.sample(known, min(len(known), rng.choice([0, 1, 1, 1, 2, 3]) if i % 9 else 1)) + (["lost"] if i == 60 else [""] if i % 7 == 0 else [])
    rows = [*parents.items(), *list(parents.items())[:10]]
    commits = spark.createDataFrame(rows, SCHEMA)
    tips = ["c149", "c80", "c0", "lost", "nowhere"]
    got = {}
    for r in history.ancestors(commits, spark.createDataFrame([(t,) for t in tips * 2], "sha string")).collect():
        got.setdefault(r.tip, []).append(r.sha)
    assert {t: sorted(x) for t, x in got.items()} == {t: sorted(reachable(parents, t)) for t in tips}
    asked = [(f"c{rng.randrange(150)}", f"c{rng.randrange(150)}") for _ in range(200)] + [("lost", "c149"), ("c3", "lost"), ("x", "c3"), ("c3", "x"), ("x", "x"), ("c5", "c5")]
    found = history.is_ancestor(commits, spark.createDataFrame(asked + asked[:5], "ancestor string, descendant string")).collect()
    assert len(found) == len(set(asked))
    for r in found:
        assert r.is_ancestor == (r.descendant in parents and r.ancestor in reachable(parents, r.descendant)), r


def test_a_long_line_takes_few_rounds(spark, monkeypatch):
    written = []
    keep = history._written
    monkeypatch.setattr(history, "_written", lambda rows: written.append(1) or keep(rows))
    n = 60_000
    commits = spark.range(n).selectExpr("cast(id AS string) AS sha", "array(CASE WHEN id > 0 THEN cast(id - 1 AS string) ELSE '' END) AS parents")
    pairs = spark.createDataFrame([("0", str(n - 1)), ("777", "5"), ("5", "777")], "ancestor string, descendant string")
    assert {(r.ancestor, r.is_ancestor) for r in history.is_ancestor(commits, pairs).collect()} == {("0", True), ("777", False), ("5", True)}
    assert len(written) < 30


def test_empty_histories(spark):
    none = spark.createDataFrame([], SCHEMA)
    pairs = spark.createDataFrame([("a", "b")], "ancestor string, descendant string")
    assert [r.is_ancestor for r in history.is_ancestor(none, pairs).collect()] == [False]
    assert history.is_ancestor(none, pairs.limit(0)).collect() == []
