"""Quality rules: a learned decision list over whole-text statistics, in DataFrame functions alone.

Sequential covering: a rule for rejecting is grown as a conjunction of thresholds that gain the most
information on the growing rows, pruned to the prefix that does best on the pruning rows, and kept
if it is precise enough; the rows it covers are set aside and the next rule is grown. Every count is
an aggregation of the labelled rows by feature and quantile bin, so the driver sees a few hundred
sums. The list is emitted as an ordered Spark conditional expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import staged
from .words import SPACE, UPPER, free_name, let, one_text, windows, words

#: Labelled rows that the list is learned from: those with the smallest hashes of their doc_id.
MAX_LABELLED = 20_000
BINS, MAX_RULES, MAX_CONDITIONS = 32, 8, 3
#: Least share of truly rejected rows among those that a rule covers, and least number covered.
PRECISION, SUPPORT = 0.9, 5
SYMBOLS = "#*$%&|<>"
_STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks"]


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _repeat_words(ws: Column) -> Column:
    """Words that lie in a three-word window found twice or more. Only texts with such a window are sorted."""
    shared = lambda s, i: (F.get(s, i)["t"] == F.get(s, i - 1)["t"]) | (F.get(s, i)["t"] == F.get(s, i + 1)["t"])
    places = lambda s: F.array_sort(F.filter(F.transform(s, lambda x, i: F.when(shared(s, i), x["p"])), lambda p: p.isNotNull()))
    covered = lambda ps: F.aggregate(F.transform(ps, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(ps, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    by_window = lambda t: F.array_sort(F.transform(t, lambda x, i: F.struct(x.alias("t"), i.alias("p"))))
    slow = lambda t: let(by_window(t), lambda s: let(places(s), covered))
    return let(windows(ws, 3, lambda x: F.concat_ws(" ", *x)), lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).otherwise(slow(t)))


def with_statistics(docs: DataFrame, name: str = "q_stats") -> DataFrame:
    """``docs`` and a struct of whole-text counts, all long; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    by_words = let(words(text), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    q_words, q_lines = free_name(docs, "q_words"), free_name(docs, "q_lines")
    first = docs.withColumn(q_words, by_words).withColumn(q_lines, by_lines)
    counts = {
        "n_words": F.col(f"{q_words}.n"), "word_chars": F.length(F.translate(text, SPACE, "")), "n_symbols": _count(text, SYMBOLS),
        "n_dup_lines": F.col(f"{q_lines}.d"), "n_repeat_words": F.col(f"{q_words}.r"), "n_lines": F.col(f"{q_lines}.n"),
        "n_upper": _count(text, UPPER), "n_digits": _count(text, "0123456789"), "n_marks": _count(text, "!?"),
    }
    made = F.struct(*[counts[k].cast("long").alias(k) for k in _STATS])
    # Laid out from an array of one, so that filters on the counts read them: else Spark counts anew for every condition.
    return first.withColumn(name, F.explode_outer(F.array(made))).drop(q_words, q_lines)


def features(name: str = "q_stats") -> dict[str, Column]:
    """The statistics that rules test, each a double that is zero where it would be divided by zero."""
    s = {k: F.col(f"{name}.{k}").cast("double") for k in _STATS}
    rate = lambda a, b: F.coalesce(F.try_divide(s[a], s[b]), F.lit(0.0))
    return {
        "words": s["n_words"], "chars_per_word": rate("word_chars", "n_words"), "symbols_per_word": rate("n_symbols", "n_words"),
        "dup_line_share": rate("n_dup_lines", "n_lines"), "repeat_share": rate("n_repeat_words", "n_words"), "words_per_line": rate("n_words", "n_lines"),
        "upper_share": rate("n_upper", "word_chars"), "digit_share": rate("n_digits", "word_chars"), "marks_per_word": rate("n_marks", "n_words"),
    }


@dataclass(frozen=True)
class Condition:
    """``feature`` at least (or below) a threshold."""

    feature: str
    at_least: bool
    threshold: float

    def on(self, values: dict[str, Column]) -> Column:
        v = values[self.feature]
        return v >= F.lit(self.threshold) if self.at_least else v < F.lit(self.threshold)


@dataclass
class DecisionList:
    """Rules in order; a row that no rule covers is kept."""

    rules: list[list[Condition]] = field(default_factory=list)

    def verdict(self, values: dict[str, Column]) -> Column:
        """The ordered conditional expression: false where a rule rejects, else true."""
        out = F.when(F.lit(False), F.lit(False))
        for rule in self.rules:
            out = out.when(_all(rule, values), F.lit(False))
        return out.otherwise(F.lit(True))


def _all(rule: list[Condition], values: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, (c.on(values) for c in rule), F.lit(True))


def _best(found: list, total: tuple[int, int], cuts: dict[str, list[float]]) -> tuple[float, Condition | None]:
    """The condition of the largest information gain, from (feature, bin, rejected, kept) counts."""
    p0, n0 = total
    before = math.log2(p0 / (p0 + n0)) if p0 else 0.0
    best: tuple[float, Condition | None] = (1e-9, None)
    for name, edges in cuts.items():
        bins = {r["bin"]: (r["p"], r["n"]) for r in found if r["feature"] == name}
        below = [0, 0]
        for k, edge in enumerate(edges):
            below = [below[i] + bins.get(k, (0, 0))[i] for i in (0, 1)]
            for at_least, (p, n) in ((False, below), (True, (p0 - below[0], n0 - below[1]))):
                if p and p + n < p0 + n0 and (gain := p * (math.log2(p / (p + n)) - before)) > best[0]:
                    best = (gain, Condition(name, at_least, edge))
    return best


def _bin(value: Column, edges: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value))


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, base: bool = True) -> DecisionList:
    """A decision list for quality 0, from documents with a label 0 or 1; with ``base`` from those that pass the base limits.

    Without labels of both kinds the list is empty, so that every document is kept. Labels that are
    null or have no document are left aside; a document labelled twice counts twice, but of rows that
    share a doc_id the text with the smallest hash alone is learned from, so ``max_labelled`` bounds the rows.
    """
    chosen = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "quality").limit(max_labelled)
    counted = with_statistics(one_text(docs, chosen).join(F.broadcast(chosen), "doc_id")).select("doc_id", "quality", "q_stats")  # the limit bounds it
    # Written first: else the filter is pushed below the join, and all documents are counted.
    labelled = staged(counted, "labelled-counts")
    if base:  # the rules only ever judge what passes the base
        labelled = labelled.filter(~base_failed())
    values = features()
    part = F.pmod(F.xxhash64(F.lit("prune"), "doc_id"), F.lit(3)) == 0
    rows = staged(labelled.select((F.col("quality") == 0).alias("bad"), part.alias("prune"), *[v.alias(k) for k, v in values.items()]).repartition(4), "labelled-statistics")
    names = list(values)
    spots = [k / BINS for k in range(1, BINS)]
    quantiles = rows.agg(*[F.percentile_approx(k, spots, 10_000).alias(k) for k in names]).first()
    cuts = {k: sorted(set(quantiles[k] or [])) for k in names}
    own = {k: F.col(k) for k in names}
    binned = F.explode(F.array(*[F.struct(F.lit(k).alias("feature"), _bin(F.col(k), cuts[k]).alias("bin")) for k in names]))
    bad, good = F.count_if(F.col("bad")).alias("p"), F.count_if(~F.col("bad")).alias("n")
    out = DecisionList()
    for _ in range(MAX_RULES):
        open_rows = rows.filter(out.verdict(own))
        rule: list[Condition] = []
        while len(rule) < MAX_CONDITIONS:
            growing = open_rows.filter(~F.col("prune") & _all(rule, own))
            found = growing.select("bad", binned.alias("b")).groupBy("b.feature", "b.bin").agg(bad, good).collect()
            of_one = [r for r in found if r["feature"] == names[0]]
            total = (sum(r["p"] for r in of_one), sum(r["n"] for r in of_one))
            if not total[0] or not total[1]:
                break
            condition = _best(found, total, cuts)[1]
            if condition is None:
                break
            rule.append(condition)
        if not rule:
            break
        prefixes = [rule[: k + 1] for k in range(len(rule))]
        sums = open_rows.agg(*[F.count_if(_all(x, own) & F.col("prune") & w).alias(f"{a}{k}") for k, x in enumerate(prefixes) for a, w in (("p", F.col("bad")), ("n", ~F.col("bad")))],
                             *[F.count_if(_all(x, own) & w).alias(f"all_{a}{k}") for k, x in enumerate(prefixes) for a, w in (("p", F.col("bad")), ("n", ~F.col("bad")))]).first()
        worth = lambda k: (sums[f"p{k}"] - sums[f"n{k}"]) / max(1, sums[f"p{k}"] + sums[f"n{k}"])  # noqa: B023, E731
        k = max(range(len(rule)), key=lambda k: (worth(k), -k))
        p, n = sums[f"all_p{k}"], sums[f"all_n{k}"]
        if p < SUPPORT or p < PRECISION * (p + n) or sums[f"p{k}"] < PRECISION * (sums[f"p{k}"] + sums[f"n{k}"]):
            break
        out.rules.append(prefixes[k])
    return out


def base_failed(name: str = "q_stats") -> Column:
    """Fewer than 50 words, or over half of the words in repeated windows."""
    return (F.col(f"{name}.n_words") < 50) | (100 * F.col(f"{name}.n_repeat_words") > 50 * F.col(f"{name}.n_words"))


def assess(docs: DataFrame, rules: DecisionList, base: bool = True) -> DataFrame:
    """``docs`` with q_stats, base_failed and kept: the rules' verdict, with ``base`` only for what passes the base limits.
    Null and empty texts have no words, so they fail the base; columns of these names are replaced; rows are
    judged one by one, repeated or not."""
    judged = with_statistics(docs.drop("q_stats", "base_failed", "kept")).withColumn("base_failed", base_failed())
    verdict = rules.verdict(features())
    return judged.withColumn("kept", ~F.col("base_failed") & verdict if base else verdict)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: statistics and verdict of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rules = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return assess(docs, rules).select("doc_id", *[f"q_stats.{k}" for k in _STATS[:5]], "base_failed", "kept")
