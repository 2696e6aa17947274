import zlib
from collections import defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quarry.llm import packing, token_files, tokens
from quarry.llm.shared import new_folder

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@lru_cache
def plain(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=150, deadline=None)
@given(texts=st.lists(st.lists(st.sampled_from(list("aZé 'ßs0\n\t\r.!|<> ́İ\x1c") + ["'ll ", "  ", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "ÀÉ"])).map("".join), max_size=4))
def test_encoding_equals_the_library(path, texts):
    enc = tokens.encoder(path)
    want = [np.array(plain(path)(t), enc.dtype).tobytes() for t in texts]
    assert enc.encode(texts) == want
    assert enc.encode(texts) == want  # remembered


@pytest.mark.parametrize("path,ids", [(WORD, [3306, 49407, 1002]), (BYTE, [31373, 220, 50256, 995])])
def test_the_string_of_a_special_token_is_that_token(path, ids):
    enc = tokens.encoder(path)
    assert np.frombuffer(enc.encode(["hello <|endoftext|> world"])[0], enc.dtype).tolist() == ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, odd_docs):
    folder = new_folder(spark, "t")
    manifest = token_files.write_token_files(odd_docs, folder, WORD, 2, shard_bytes=20_000).collect()
    got = token_files.read_token_files(spark, folder).collect()
    enc = plain(WORD)
    rows = sorted(((r.doc_id, r.text) for r in odd_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    start, want = 0, []
    for doc_id, text in rows:
        ids = enc(text) + [2]
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want
    assert sum(r.n_tokens for r in manifest) == start and len(manifest) > 1
    assert {r.width for r in manifest} == {2}


def test_token_files_of_nothing(spark, no_docs):
    folder = new_folder(spark, "t")
    assert token_files.write_token_files(no_docs, folder, WORD, 2).count() == 0
    assert token_files.read_token_files(spark, folder).count() == 0


def test_packing_places_every_id_once(spark, odd_docs):
    got = packing.packed_pieces(odd_docs.filter("doc_id IS NOT NULL"), BYTE, 1).collect()
    enc, pieces, sequences = plain(BYTE), defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for r in odd_docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).collect():
        ids = enc(r.text) + [1]
        times = 2 if r.doc_id == 3 else 1
        assert sum(p.length for p in pieces[r.doc_id]) == times * len(ids)
        for p in pieces[r.doc_id]:
            assert p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[p.start : p.start + p.length])
    for rows in sequences.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert sorted(sequences) == list(range(len(sequences)))


def test_packed_sequences_hold_the_ids(spark, odd_docs):
    rows = packing.packed_sequences(odd_docs, BYTE, 1, window=64, unit=4).collect()
    total = sum(len(plain(BYTE)(r.text)) + 1 for r in odd_docs.collect())
    assert sum(len(r.ids) // 2 for r in rows) == total and all(len(r.ids) <= 128 for r in rows)
    one = next(r for r in rows if 1 in (r.doc_ids or []))
    at = one.offsets[one.doc_ids.index(1)]
    assert np.frombuffer(one.ids, "<u2")[at] == 1  # a null text is the end id alone


def test_packing_of_nothing(spark, no_docs):
    assert packing.packed_pieces(no_docs, BYTE, 1).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 500), max_size=32))
def test_plan_covers_the_histogram(histogram):
    used = defaultdict(int)
    for chosen, n in packing.plan(histogram, 32):
        assert sum(chosen) <= 32 and n > 0
        for k in chosen:
            used[k] += n
    assert dict(used) == histogram


def test_plan_wastes_little():
    rng = np.random.default_rng(3)
    histogram = dict(zip(*(x.tolist() for x in np.unique(rng.integers(1, 256, 50_000), return_counts=True))))
    sequences = sum(n for _, n in packing.plan(histogram, 256))
    assert sum(k * n for k, n in histogram.items()) / (256 * sequences) > 0.98


def test_least_squares_is_nonnegative_and_exact():
    rng = np.random.default_rng(5)
    a, x = rng.random((20, 40)), np.maximum(rng.normal(size=40), 0)
    found = packing.nonnegative_least_squares(a, a @ x)
    assert (found >= 0).all() and np.allclose(a @ found, a @ x, atol=1e-6)
