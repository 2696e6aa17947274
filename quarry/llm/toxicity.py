"""Toxicity: gradient-boosted trees over dense features of the whole text, with isotonic calibration.

The labelled rows (a bounded sample) are dealt by hash into three parts. The first gives, for any
language, a lexicon of words and word beginnings that toxic texts hold far more often than others;
on the second the trees are grown; on the third their output is calibrated by isotonic regression.
Features are read off the text in Arrow batches; trees and calibration score inside Spark.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import release, small_batches, staged, text_batches
from .words import free_name, one_text

#: Labelled rows that are used at most: those with the smallest hashes of their doc_id.
MAX_LABELLED = 20_000
#: A learned unit is in at least so many toxic texts, and so many times likelier there; so many are kept.
SUPPORT, ODDS, MAX_UNITS = 4, 20.0, 4000
#: Lengths of word beginnings that are units beside whole words.
BEGINNINGS = (4, 5)
#: Insults that count in any corpus, and words for the second person.
INSULTS = frozenset("idiot moron stupid dumb loser scum trash pathetic worthless disgusting clown garbage imbecile cretin".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos usted ustedes ti tus vosotros".split())
#: Characters written for letters in obfuscated words.
_PLAIN = str.maketrans("@4301!$57", "aaeoiisst")
_WORD = re.compile(r"[^\W\d_]+")
_OBFUSCATED = re.compile(r"[^\W\d_]+(?:[@$*!0-9]+[^\W\d_]+)+")
_RUN = re.compile(r"([^\W\d_])\1{3,}")
_NEAR = 5
_OWN = ("t_features", "t_raw", "t_probability", "t_prediction", "t_margin")
#: Words whose weights a worker remembers; beyond, it starts anew. This changes no result.
_MEMO = 100_000
FEATURES = ["insults", "learned", "learned_weight", "learned_texts", "near_person", "person", "capitals", "capital_words", "exclaims", "asks", "marks", "obfuscated", "uncovered", "runs", "log_words", "word_length"]


@lru_cache(maxsize=1)
def _memo(units: tuple[tuple[str, float], ...]) -> tuple[dict[str, float], dict[str, float]]:
    """The lexicon, and the weights of words looked up so far by this worker. To be asked for once a batch: the units are hashed."""
    return dict(units), {}


def dense_features(text: str | None, lexicon: dict[str, float], seen: dict[str, float]) -> list[float]:
    """The features of one whole text, in the order of ``FEATURES``; all zero for null and empty texts.

    ``seen`` remembers the weights of words between texts that share the lexicon.
    """
    if not text:
        return [0.0] * len(FEATURES)
    if len(seen) > _MEMO:
        seen.clear()
    own = _WORD.findall(text)
    low = [w.lower() for w in own] if not text.isascii() else _WORD.findall(text.lower())
    n = max(1, len(low))
    hits, insults, weight = [], 0, 0.0
    for i, w in enumerate(low):
        x = seen.get(w)
        if x is None:
            x = max([lexicon.get(w, 0.0), *(lexicon.get(w[:k] + "~", 0.0) for k in BEGINNINGS if len(w) > k)], default=0.0)
            seen[w] = x = 100.0 if w in INSULTS else x
        if x:
            hits.append(i)
            if x == 100.0:
                insults += 1
            else:
                weight += x
    person = [i for i, w in enumerate(low) if w in SECOND_PERSON] if hits else []
    near = 0
    if person:
        at = np.searchsorted(person, hits)
        around = np.array([-(10**9), *person, 10**9])
        near = int(((np.array(hits) - around[at] <= _NEAR) | (around[at + 1] - np.array(hits) <= _NEAR)).sum())
    letters = sum(map(len, own)) or 1
    capitals = len(re.findall(r"[A-ZÀ-ÖØ-Þ]", text))
    masked = _OBFUSCATED.findall(text)
    uncovered = sum(m.lower().translate(_PLAIN) in INSULTS for m in masked)
    learned = len(hits) - insults
    return [
        100 * insults / n, 100 * learned / n, 100 * weight / n, math.log1p(learned), 100 * near / n, 100 * sum(w in SECOND_PERSON for w in low) / n,
        capitals / letters, 100 * len(re.findall(r"\b[A-ZÀ-ÖØ-Þ]{2,}\b", text)) / n, 100 * text.count("!") / n, 100 * text.count("?") / n,
        100 * len(re.findall(r"[#*$%&|<>@]", text)) / n, 100 * len(masked) / n, 100 * uncovered / n, 100 * len(_RUN.findall(text)) / n, math.log1p(len(own)), letters / n,
    ]


def feature_column(units: tuple[tuple[str, float], ...]):
    """A column function: text to its dense features."""

    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        lexicon, seen = _memo(units)
        made = pa.array([dense_features(t.as_py(), lexicon, seen) for t in texts], pa.list_(pa.float64()))  # one text at a time in Python
        release()
        return made

    return run


def learn_units(labelled: DataFrame) -> tuple[tuple[str, float], ...]:
    """(unit, log odds) of the words, and word beginnings (marked ``~``), that tell toxic texts; at most ``MAX_UNITS``."""
    text = F.lower(F.coalesce("text", F.lit("")))
    own = F.array_distinct(F.filter(F.split(text, r"[^\p{L}]+"), lambda w: w != ""))
    starts = [_beginnings(own, k) for k in BEGINNINGS]
    units = labelled.select("toxic", F.explode(F.array_distinct(F.concat(own, *starts))).alias("unit"))
    n = labelled.agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("n")).first()
    found = units.groupBy("unit").agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("n"))
    odds = (F.col("p") + 0.5) / F.lit(n["p"] + 1.0) / ((F.col("n") + 0.5) / F.lit(n["n"] + 1.0))
    best = found.filter(F.col("p") >= SUPPORT).withColumn("odds", odds).filter(F.col("odds") >= ODDS)
    return tuple((r["unit"], math.log(r["odds"])) for r in best.orderBy(F.desc("odds"), "unit").limit(MAX_UNITS).collect())


def _beginnings(ws: Column, k: int) -> Column:
    return F.transform(F.filter(ws, lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("~")))


@dataclass
class ToxicityModel:
    """A lexicon, boosted trees and their calibration; without labels of both kinds, a constant."""

    units: tuple[tuple[str, float], ...]
    trees: object | None
    calibration: object | None
    share: float

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with score (0 to 1) and predicted (1 from 0.5). Columns of these names are replaced."""
        plain = docs.drop("score", "predicted")
        if self.trees is None:
            scored = plain.withColumn("score", F.lit(self.share))
        else:
            aside = {c: free_name(docs, c) for c in _OWN if c in plain.columns}  # columns named as the model's own
            scored = self.calibration.transform(_raw(plain.withColumnsRenamed(aside), self.units, self.trees)).drop("t_features", "t_raw")
            scored = scored.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))).withColumnsRenamed({v: k for k, v in aside.items()})
        return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _raw(docs: DataFrame, units: tuple[tuple[str, float], ...], trees) -> DataFrame:
    text_batches(docs.sparkSession)
    vectors = docs.withColumn("t_features", array_to_vector(feature_column(units)(F.col("text"))))
    out = trees.transform(vectors)
    return out.withColumn("t_raw", vector_to_array("t_probability")[1]).drop("t_probability", "t_prediction", "t_margin")


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Learns from documents whose label is 0 or 1; only their text is looked at.

    Labels that are null or have no document are left aside. A null or empty text is a row with all
    features zero. A document labelled twice counts twice; of rows that share a doc_id the text with the
    smallest hash alone is learned from, so ``max_labelled`` bounds the rows. Where the third part lacks
    one of the labels, the calibration falls back to the trees' own rows and the third part together.
    """
    chosen = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "toxic").limit(max_labelled)
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(20))
    rows = staged(one_text(docs, chosen).join(F.broadcast(chosen), "doc_id").withColumn("part", part.cast("int")), "labelled-texts")  # the limit bounds it
    counts = {(r["kind"], r["toxic"]): r["count"] for r in rows.groupBy(F.when(F.col("part") < 9, 0).when(F.col("part") < 17, 1).otherwise(2).alias("kind"), "toxic").count().collect()}
    toxic, other = (sum(n for (_, t), n in counts.items() if t == k) for k in (1, 0))
    if not counts.get((1, 1)) or not counts.get((1, 0)):
        return ToxicityModel((), None, None, toxic / (toxic + other) if toxic + other else 0.0)
    units = learn_units(rows.filter("part < 9"))
    vectors = rows.filter("part >= 9").select("part", "toxic", feature_column(units)(F.col("text")).alias("f"))
    with small_batches(docs.sparkSession):
        vectors = staged(vectors.repartition(4), "labelled-features").withColumn("t_features", array_to_vector("f"))
    trees = GBTClassifier(featuresCol="t_features", labelCol="toxic", predictionCol="t_prediction", maxIter=15, maxDepth=3, stepSize=0.3, seed=7)
    trees = trees._set(probabilityCol="t_probability", rawPredictionCol="t_margin")
    grown = trees.fit(vectors.filter("part < 17"))
    held = vectors.filter("part >= 17") if counts.get((2, 1)) and counts.get((2, 0)) else vectors
    raw = grown.transform(held).withColumn("t_raw", vector_to_array("t_probability")[1]).withColumn("label", F.col("toxic").cast("double"))
    return ToxicityModel(units, grown, IsotonicRegression(featuresCol="t_raw", labelCol="label", predictionCol="score").fit(raw), toxic / (toxic + other))


def held_out(doc_id: Column) -> Column:
    """Whether CRC-32 of the doc_id as text leaves 0 when divided by 5; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: score and verdict of every document, learned from the rows that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))))
    return model.score(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
