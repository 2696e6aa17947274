"""Every stage of the pipeline against a plain version of it."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quarry.llm import mixing, quality
from quarry.llm.shared import staged

from .test_native_operators import poisson, uniform
from .test_near_copies import ids, one_of_each


@pytest.fixture(scope="module")
def results(spark):
    """(rows given to a stage, rows it returned) of every stage on the smallest tables."""
    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = staged(stage(spark, docs, sf), name)
        if name != "packing":
            assert after.columns == docs.columns
        out[name] = (docs.collect(), after.collect())
        docs = after
    return out


def test_toxicity_keeps_clean_documents(spark, results):
    before, after = results["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    kept = {r.doc_id for r in after}
    assert set(after) <= set(before)
    clean = [r.doc_id for r in before if labels.get(r.doc_id) == 0]
    assert sum(i in kept for i in clean) >= 0.9 * len(clean)


def test_quality_filters_by_the_learned_rules_alone(spark, results):
    """Short texts are judged by the rules too; those labelled good stay."""
    before, after = results["quality_rules"]
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    rows = spark.createDataFrame(before)
    rules = quality.learn(rows, labels, base=False)
    kept = {r.doc_id for r in after}
    for r in quality.with_statistics(rows).select("doc_id", "q_stats").collect():
        n, chars, symbols, dup_lines, repeated, lines, upper, digits, marks = r.q_stats
        rate = lambda a, b: a / b if b else 0.0
        values = {
            "words": n, "chars_per_word": rate(chars, n), "symbols_per_word": rate(symbols, n), "dup_line_share": rate(dup_lines, lines), "repeat_share": rate(repeated, n),
            "words_per_line": rate(n, lines), "upper_share": rate(upper, chars), "digit_share": rate(digits, chars), "marks_per_word": rate(marks, n),
        }
        fits = lambda c: values[c.feature] >= c.threshold if c.at_least else values[c.feature] < c.threshold  # noqa: B023, E731
        assert (r.doc_id in kept) == (not any(all(map(fits, rule)) for rule in rules.rules))
    good = {r.doc_id for r in labels.filter("quality = 1").collect()} & {r.doc_id for r in before}
    assert len(good & kept) >= 0.99 * len(good)


def test_one_of_each_group_stays(results):
    before, after = results["simhash"]
    want, pairs = one_of_each(before)
    got = ids(after)
    assert set(want) <= set(got) and len(got) - len(want) <= 0.02 * len(pairs)


def test_stages_take_odd_and_empty_tables(spark, odd_docs, no_docs, tmp_path):
    """Every stage but the last returns the columns it was given; nothing crashes on nulls, repeats and long texts."""
    for t, schema in (("documents", odd_docs.schema), ("labels", "doc_id long, quality int, toxic int")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name in ("toxicity", "quality_rules"):  # nothing is labelled, so all stay
                assert out.columns == docs.columns and sorted(map(repr, out.collect())) == sorted(map(repr, docs.collect()))
            elif name == "packing":
                assert sorted({(r.doc_id is None, r.doc_id or 0) for r in out.collect()}) == sorted({(r.doc_id is None, r.doc_id or 0) for r in docs.collect()})
            else:
                assert out.columns == docs.columns and set(map(repr, out.collect())) <= set(map(repr, docs.collect()))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_copies_follow_the_rates(results):
    before, after = results["mixing"]
    sizes = Counter()
    for r in before:
        sizes[r.source] += len(r.text.encode())
    weights = {s: n**0.5 for s, n in sizes.items()}
    rate = {s: round(weights[s] / sum(weights.values()) * sum(sizes.values()) / sizes[s], 9) for s in sizes}
    want = {r.doc_id: poisson(rate[r.source], uniform(r.doc_id)) for r in before}
    assert Counter(r.doc_id for r in after) == Counter({i: n for i, n in want.items() if n})
    assert mixing.SEED


def test_every_id_is_packed_once(results):
    before, after = results["packing"]
    enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, got, sequences = Counter(), Counter(), defaultdict(list)
    for r in before:
        ids = enc.encode(r.text or "", add_special_tokens=False).ids + [1]
        for a in range(0, len(ids), 2048):
            part = np.array(ids[a : a + 2048], "<u4")
            want[r.doc_id, a, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
    for r in after:
        got[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for rows in sequences.values():
        assert [a for a, _ in sorted(rows)] == [sum(n for _, n in sorted(rows)[:i]) for i in range(len(rows))]
        assert sum(n for _, n in rows) <= 2048


def test_registered_queries(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 14)} <= {x.split("_")[0] for x in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)
