"""The learned operators against plain second versions: features, calibration, covering, verdict."""

import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.llm import quality, toxicity

from .test_models import counts


def plain_features(text, lexicon):
    """Word by word, without lookups kept between texts."""
    if not text:
        return [0.0] * 16
    words = re.findall(r"[^\W\d_]+", text)
    low = [w.lower() for w in words] if not text.isascii() else re.findall(r"[^\W\d_]+", text.lower())
    n = max(1, len(low))
    insult = [w in toxicity.INSULTS for w in low]
    weight = [0.0 if bad else max([lexicon.get(w, 0.0)] + [lexicon.get(w[:k] + "~", 0.0) for k in (4, 5) if len(w) > k]) for w, bad in zip(low, insult)]
    hit = [i for i in range(len(low)) if insult[i] or weight[i]]
    person = [i for i, w in enumerate(low) if w in toxicity.SECOND_PERSON]
    near = sum(any(abs(i - p) <= 5 for p in person) for i in hit)
    letters = sum(len(w) for w in words)
    masked = re.findall(r"[^\W\d_]+(?:[@$*!0-9]+[^\W\d_]+)+", text)
    swap = dict(zip("@4301!$57", "aaeoiisst"))
    upper = "[A-ZÀ-ÖØ-Þ]"
    learned = len(hit) - sum(insult)
    return [
        100 * sum(insult) / n, 100 * learned / n, 100 * sum(weight) / n, math.log1p(learned), 100 * near / n, 100 * len(person) / n,
        len(re.findall(upper, text)) / (letters or 1), 100 * len(re.findall(rf"\b{upper}{{2,}}\b", text)) / n, 100 * text.count("!") / n, 100 * text.count("?") / n,
        100 * sum(c in "#*$%&|<>@" for c in text) / n, 100 * len(masked) / n, 100 * sum("".join(swap.get(c, c) for c in m.lower()) in toxicity.INSULTS for m in masked) / n,
        100 * sum(1 for _ in re.finditer(r"([^\W\d_])\1\1\1+", text)) / n, math.log1p(len(words)), (letters or 1) / n,
    ]


PIECES = ["you ", "IDIOT ", "m0ron ", "st*pid!", "loser", "lowei", "loweixyz ", " ", "\n", "É", "aaaa", "? ", "| ", "x1y ", "DU ", "fine words here "]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=40).map("".join))
def test_features_equal_a_plain_version(text):
    lexicon, seen = {"lowei~": 3.0, "fine": 1.5, "aaaa": 2.0}, {}
    for _ in range(2):  # looked up, then remembered
        assert toxicity.dense_features(text, lexicon, seen) == pytest.approx(plain_features(text, lexicon), abs=1e-9)


def test_scores_rise_with_the_margin_of_the_trees(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir[:-5]}0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    rows = toxicity._raw(docs, model.units, model.trees).select("doc_id", "t_raw").join(model.score(docs).select("doc_id", "score", "predicted"), "doc_id").collect()
    ordered = sorted((r.t_raw, r.score) for r in rows)
    assert all(a[1] <= b[1] + 1e-12 for a, b in zip(ordered, ordered[1:]))
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_held_out_labels_do_not_matter(spark, sf_dir, tmp_path):
    sf = f"{sf_dir[:-5]}0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    spark.read.parquet(f"{sf}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    flipped.write.parquet(f"{tmp_path}/labels.parquet")
    one, two = ({r.doc_id: r.score for r in toxicity.op5_toxicity(spark, d).collect()} for d in (sf, str(tmp_path)))
    assert one == pytest.approx(two, abs=1e-6)


def test_a_labelled_id_with_several_texts_counts_once(spark, make_docs):
    docs = make_docs([(1, f"text number {i}", "a") for i in range(50)] + [(2, "other", "a")])
    chosen = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    got = toxicity.one_text(docs, chosen).collect()
    assert sorted(r.doc_id for r in got) == [1, 2]


def plain_values(text):
    n, chars, symbols, dups, repeated = counts(text)
    lines = sum(1 for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x))
    rate = lambda a, b: a / b if b else 0.0
    upper, digits, marks = (len(re.findall(p, text)) for p in ("[A-Z]", "[0-9]", "[!?]"))
    return {
        "words": float(n), "chars_per_word": rate(chars, n), "symbols_per_word": rate(symbols, n), "dup_line_share": rate(dups, lines), "repeat_share": rate(repeated, n),
        "words_per_line": rate(n, lines), "upper_share": rate(upper, chars), "digit_share": rate(digits, chars), "marks_per_word": rate(marks, n),
    }


def plain_covering(rows):
    """Rules from (bad, prune, values) rows: grown by information gain, pruned to the best prefix, kept if precise."""
    cuts = {}
    for name in rows[0][2]:
        own = sorted(v[name] for _, _, v in rows)
        cuts[name] = sorted({own[max(0, math.ceil(k / quality.BINS * len(own)) - 1)] for k in range(1, quality.BINS)})
    fits = lambda rule, v: all((v[f] >= t) == up for f, up, t in rule)
    count = lambda some: (sum(b for b, *_ in some), sum(not b for b, *_ in some))
    rules = []
    for _ in range(quality.MAX_RULES):
        left = [r for r in rows if not any(fits(x, r[2]) for x in rules)]
        rule = []
        while len(rule) < quality.MAX_CONDITIONS:
            growing = [r for r in left if not r[1] and fits(rule, r[2])]
            p0, n0 = count(growing)
            if not p0 or not n0:
                break
            best = (1e-9, None)
            for name, edges in cuts.items():
                for t in edges:
                    for up in (False, True):
                        p, n = count([r for r in growing if (r[2][name] >= t) == up])
                        if p and p + n < p0 + n0 and (gain := p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))) > best[0]:
                            best = (gain, (name, up, t))
            if best[1] is None:
                break
            rule.append(best[1])
        if not rule:
            break
        held = [count([r for r in left if r[1] and fits(rule[: k + 1], r[2])]) for k in range(len(rule))]
        k = max(range(len(rule)), key=lambda k: ((held[k][0] - held[k][1]) / max(1, sum(held[k])), -k))
        p, n = count([r for r in left if fits(rule[: k + 1], r[2])])
        if p < quality.SUPPORT or p < quality.PRECISION * (p + n) or held[k][0] < quality.PRECISION * sum(held[k]):
            break
        rules.append(rule[: k + 1])
    return rules


@pytest.mark.parametrize("base", [True, False])
def test_covering_and_verdict_equal_a_plain_version(spark, sf_dir, base):
    docs, labels = (spark.read.parquet(f"{sf_dir[:-5]}0.01/{t}.parquet") for t in ("documents", "labels"))
    part = F.pmod(F.xxhash64(F.lit("prune"), "doc_id"), F.lit(3)) == 0
    labelled = docs.join(labels.filter("quality IN (0, 1)"), "doc_id").select("doc_id", "text", "quality", part.alias("prune")).collect()
    failed = lambda t: counts(t)[0] < 50 or 100 * counts(t)[4] > 50 * counts(t)[0]
    rows = [(r.quality == 0, r.prune, plain_values(r.text or "")) for r in labelled if not (base and failed(r.text))]
    want = plain_covering(rows)
    rules = quality.learn(docs, labels, base=base)
    assert [[(c.feature, c.at_least, c.threshold) for c in rule] for rule in rules.rules] == want and (want or not base)
    for r in quality.assess(docs, rules, base=base).select("doc_id", "text", "kept").collect():
        v = plain_values(r.text or "")
        assert r.kept == (not (base and failed(r.text)) and not any(all((v[f] >= t) == up for f, up, t in rule) for rule in want))
