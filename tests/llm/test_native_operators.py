import hashlib
import math
import re
import textwrap
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quarry.llm import licenses, mixing, sharding
from quarry.llm.license_entire import ENTIRE
from quarry.llm.license_texts import KNOWN, MIT


def test_canonical_form_unites_spellings(spark, make_docs):
    other = MIT.replace("Copyright (c) <year> <copyright holders>", "// Copyright 2031 Some One\n(c) Another").upper().replace("SUBLICENSE", "sub-licence").replace('"', "“")
    docs = make_docs([(1, MIT, "a"), (2, other, "a"), (3, MIT + " and more", "a"), (4, "(c) x\n  released under the mit LICENCE!\ny", "a"), (5, "Copyright 2020 x\n...", "a"), (6, None, "a"), (7, "", "a")])
    got = licenses.scan(docs, licenses.builtin_licenses(spark)).collect()
    whole = {r.doc_id: r.license_id for r in got if r.line_no is None}
    assert whole == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: None, 6: None, 7: None}
    assert [(r.doc_id, r.line_no, r.license_id) for r in got if r.line_no is not None] == [(4, 2, "MIT")]
    assert {r.doc_id for r in got if r.line_no is None and r.digest is None} == {5, 6, 7}


def test_every_known_text_finds_itself(spark):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(KNOWN)], "doc_id long, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan(docs, licenses.builtin_licenses(spark)).filter("line_no IS NULL").collect()}
    assert got == {i: k for i, (k, _) in enumerate(KNOWN)}


def test_scan_of_odd_rows(spark, odd_docs, no_docs):
    assert licenses.scan(odd_docs, licenses.builtin_licenses(spark)).filter("line_no IS NULL").count() == odd_docs.count()
    assert licenses.scan(no_docs, licenses.builtin_licenses(spark)).count() == 0


def rewrapped(text, width, mark=""):
    """Each paragraph of wording wrapped anew; paragraphs with a copyright line of their own stay."""
    keep = lambda p: "copyright (c)" in p.lower() or "copyright [" in p.lower() or "copyright <" in p.lower()
    parts = [p if keep(p) else textwrap.fill(" ".join(p.split()), width, break_long_words=False, break_on_hyphens=False) for p in re.split(r"\n\s*\n", text)]
    return "\n".join(mark + line for line in "\n\n".join(parts).split("\n"))


def test_wrapping_does_not_change_the_form(spark):
    texts = [t for _, t in KNOWN] + ["the license\n(a) one\n\n(b) two\n\n(c) You must retain all copyright notices"]
    rows = [(i, w, rewrapped(t, w, m)) for i, t in enumerate(texts) for w, m in [(10**6, ""), *[(w, m) for w in range(30, 100, 3) for m in ("", " * ")]]]
    got = spark.createDataFrame(rows, "i int, w int, text string").select("i", "w", licenses.canonical(F.col("text")).alias("form")).collect()
    forms = {r.i: r.form for r in got if r.w == 10**6}
    assert [(r.i, r.w) for r in got if r.form != forms[r.i]] == []
    assert forms[len(texts) - 1] == "the license a one b two c you must retain all copyright notices"


def test_copyright_lines_are_known_by_holder_or_year(spark):
    gone = ["Copyright 2020", "# Copyright (C) 2019-2021 A B", "(c) 2020 A", "© A", "Copyright <year> <owner>", "Copyright [yyyy] [name]", "Copyright by A", "Copyright Some Firm Inc.", "Copyright: The Authors", "(c) Copyright A", "All rights reserved.", "(c) Some One", "Copyright, 2020, A"]
    stay = ["copyright notice, this list", "copyright holder or contributors", "Copyright license to reproduce", "copyrights", "copyrighted work", "copyright", "copyright, patent, trademark", "All rights reserved. Redistribution and use"]
    rows = [(i, f"one\n{t}\ntwo") for i, t in enumerate(gone + stay)]
    got = {r.i: r.form for r in spark.createDataFrame(rows, "i int, text string").select("i", licenses.canonical(F.col("text")).alias("form")).collect()}
    assert [t for i, t in enumerate(gone) if got[i] != "one two"] == []
    assert [t for i, t in enumerate(stay, len(gone)) if got[i] == "one two"] == []


def test_entire_licenses_are_known(spark):
    assert {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-3.0-only", "MPL-2.0", "CC0-1.0"} <= {k for k, _ in ENTIRE}
    forms = [lambda t: t, lambda t: "\n".join(" * " + x for x in t.split("\n")), lambda t: "Copyright 2031 Some One\n\n" + t, lambda t: rewrapped(t, 61), lambda t: rewrapped(t, 10**6)]
    rows = [(100 * i + k, form(t)) for i, (_, t) in enumerate(ENTIRE) for k, form in enumerate(forms)]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.builtin_licenses(spark)).filter("line_no IS NULL").collect()
    assert [(r.doc_id % 100, ENTIRE[r.doc_id // 100][0], r.license_id) for r in found if r.license_id != ENTIRE[r.doc_id // 100][0]] == []
    assert len(found) == len(rows)


def bits(key):
    digest = hashlib.md5(("null" if key is None else str(key)).encode()).hexdigest()[:15]
    return bin(int(digest, 16))[2:].zfill(60)


def test_shards_are_the_first_prefixes_that_fit(make_docs):
    rows = [(i, "x" * (i * 37 % 400), "a") for i in range(300)]
    got = {r.doc_id: (r.shard_id, r.shard_bytes) for r in sharding.shards(make_docs(rows), 1500).collect()}
    sizes = defaultdict(int)
    for i, t, _ in rows:
        for k in range(61):
            sizes[bits(i)[:k]] += len(t)
    for i, _, _ in rows:
        k = next(k for k in range(61) if sizes[bits(i)[:k]] <= 1500)
        assert got[i] == (bits(i)[:k], sizes[bits(i)[:k]])


def test_shards_split_one_key_and_odd_rows(make_docs, odd_docs, no_docs):
    rows = [(7, "y" * 50, "a")] * 200 + [(i, "z" * 50, "a") for i in range(100)] + [(900, "w" * 5000, "a")]
    got = sharding.shards(make_docs(rows), 1000).collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard_id] += r.n_bytes
    assert len(got) == len(rows) and all(r.shard_bytes == sizes[r.shard_id] for r in got)
    assert sorted(sizes.values())[-1] == 5000 and sorted(sizes.values())[-2] <= 1000
    assert sharding.shards(odd_docs, 100).count() == odd_docs.count()
    assert {r.shard_id for r in sharding.shards(odd_docs, 1 << 30).collect()} == {""}
    assert sharding.shards(no_docs).count() == 0


def test_shards_by_a_hot_key(make_docs):
    rows = [(i, "x" * 10, "hot" if i % 3 else f"s{i}") for i in range(300)]
    got = sharding.shards(make_docs(rows), 200, key="source").collect()
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard_id] += r.n_bytes
    assert max(sizes.values()) <= 200 and len(got) == 300


def poisson(rate, u):
    p = total = math.exp(-rate)
    k = 0
    while total <= u and k < 2000:
        k += 1
        p *= rate / k
        total += p
    return k


def uniform(doc_id, part=1):
    return int(hashlib.md5(f"{mixing.SEED}|{doc_id}|{part}".encode()).hexdigest()[:13], 16) / (1 << 52)


def test_copies_follow_the_inverted_distribution(spark, make_docs):
    docs = make_docs([(i, "x" * 100, "big" if i % 10 else "small") for i in range(1000)])
    weights = spark.createDataFrame([("big", 1.0), ("small", 1.0)], "source string, weight double")
    got = mixing.replicate(docs, weights).collect()
    rates = {"big": round(50_000 / 90_000, 9), "small": round(50_000 / 10_000, 9)}
    times = Counter(r.doc_id for r in got)
    for i in range(1000):
        assert times[i] == poisson(rates["big" if i % 10 else "small"], uniform(i)), i
    assert all(1 <= r.copy <= r.n_copies == times[r.doc_id] for r in got)
    shares = Counter(r.source for r in got)
    assert 0.85 < shares["big"] / shares["small"] < 1.18


def test_large_rates_and_odd_rows(spark, make_docs, odd_docs, no_docs):
    docs = make_docs([(1, "x", "rare"), *[(i, "y" * 1000, "often") for i in range(2, 12)]])
    even = spark.createDataFrame([("rare", 1.0), ("often", 1.0)], "source string, weight double")
    n = mixing.replicate(docs, even).groupBy("source").count().collect()
    assert 4500 < {r.source: r["count"] for r in n}["rare"] < 5500
    weights = mixing.tempered_weights(odd_docs)
    got = mixing.replicate(odd_docs, weights)
    assert set(odd_docs.columns) <= set(got.columns) and got.count() > 0
    assert got.filter(F.col("q_by") == 3).count() == got.count()
    assert mixing.replicate(no_docs, mixing.tempered_weights(no_docs)).count() == 0
    assert mixing.replicate(docs, even.filter("source = 'often'")).filter("source = 'rare'").count() == 0


def test_many_sources_are_joined_by_spreading(monkeypatch, make_docs, odd_docs):
    docs = make_docs([(i, "x" * (i % 50), "hot" if i % 3 else f"s{i}") for i in range(400)]).unionByName(odd_docs)
    weights = mixing.tempered_weights(docs)
    want = Counter(map(repr, mixing.replicate(docs, weights).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", -1)
    assert Counter(map(repr, mixing.replicate(docs, weights).collect())) == want
