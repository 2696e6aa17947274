"""Decontamination against brute force over all windows, and what winnowing promises."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import decontaminate
from quarry.llm.byte_words import RUN_BYTES, words_of

from .test_simhash import LOWER


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        m = min(10, len(w))
        for s in range(len(w) - m + 1 if m else 0):
            windows.setdefault(tuple(w[s : s + m]), set()).add(item)
    lengths, out = {len(x) for x in windows}, []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for m in lengths:
            for s in range(len(w) - m + 1):
                if (x := tuple(w[s : s + m])) in windows:
                    hit |= set(range(s, s + m))
                    found |= windows[x]
        ids = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(w), len(hit), len(ids), ids, bool(hit)))
    return sorted(out, key=repr)


def got(docs, items):
    return sorted([(r.doc_id, r.n_words, r.n_hit, r.n_items, r.item_ids, r.contaminated) for r in decontaminate.contamination(docs, items).collect()], key=repr)


@pytest.mark.parametrize("few", [decontaminate.FEW_WINDOWS, 0])
def test_planted_windows(spark, make_docs, monkeypatch, few):
    """Passages of every length, short items, shared passages, words beyond ASCII; by broadcast and by shuffle."""
    monkeypatch.setattr(decontaminate, "FEW_WINDOWS", few)
    rng = random.Random(5)
    word = lambda n: rng.choice(["w%d", "É%d", "字%d", "X%d"]) % rng.randrange(n)
    items = [(i, " ".join(word(40) for _ in range(rng.choice([1, 3, 4, 5, 7, 9, 10, 11, 30])))) for i in range(25)]
    items += [(7, items[24][1] + " and more"), (None, "an item of no id has its own words"), (30, None), (31, " ,;. ")]
    rows = []
    for i in range(160):
        own = [word(400) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 4)):
            passage = words(rng.choice(items)[1])
            a = rng.randrange(0, len(passage) + 1)
            own[rng.randrange(0, len(own) + 1) : 0] = passage[a:] if rng.random() < 0.5 else passage
        rows.append((i % 150 if i % 11 else None, rng.choice([" ", ", ", "--"]).join(own), "a"))
    rows += [(500, "x an ITEM of.no id has its own words y", "b"), (501, None, "b"), (501, "", "b")]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, row int")
    assert got(make_docs(rows), table) == brute([r[:2] for r in rows], items)


def test_odd_and_empty_tables(spark, odd_docs, no_docs):
    items = spark.createDataFrame([(1, " ".join(["word"] * 12), "x"), (2, "naïve “quotes” çok", "y")], "item_id long, text string, doc_id string")
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert got(odd_docs, items) == brute(rows, [(r.item_id, r.text) for r in items.collect()])
    assert got(no_docs, items) == []
    assert {x[2:] for x in map(lambda r: (*r[:4], tuple(r[4]), r[5]), got(odd_docs, items.limit(0)))} == {(0, 0, (), False)}


def test_winnowing_keeps_a_gram_of_every_window():
    """Of equal windows, wherever they stand, an equal gram is kept."""
    rng = random.Random(1)
    for words_of_window in (1, 4, 5, 8, 10):
        base = [str(rng.randrange(6)) for _ in range(300)]
        whole = words_of(pa.array([" ".join(base)]))
        places, hashes = decontaminate.kept_grams(whole, words_of_window)
        k = decontaminate.gram_size(words_of_window)
        for s in range(len(base) - words_of_window + 1):
            alone = decontaminate.kept_grams(words_of(pa.array([" ".join(base[s : s + words_of_window])])), words_of_window)[1]
            inside = hashes[(places >= s) & (places <= s + words_of_window - k)]
            assert len(alone) == 1 and alone[0] in inside
        if words_of_window > k:
            assert len(places) < len(base) - k + 1


def test_words_of_bytes():
    texts = ["Hello, wörld 12", None, "", "abc", "def ghi", "x" * (RUN_BYTES + 7) + " hello", "漢字\x00hello\x7fÀb", "y" * (RUN_BYTES + 7)]
    w = words_of(pa.array(texts))
    assert [(r, w.text(i, 1)) for i, r in enumerate(w.row.tolist())] == [(i, x) for i, t in enumerate(texts) for x in words(t)]
    by_word = {}
    for i, h in enumerate(w.hashes.tolist()):
        assert by_word.setdefault(w.text(i, 1), h) == h
    assert len(set(by_word.values())) == len(by_word)
    part = words_of(pa.array(texts)[3:5])
    assert np.array_equal(part.hashes, w.hashes[np.isin(w.row, [3, 4])])
