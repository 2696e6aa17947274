"""The corpus pipeline: toxicity, quality rules, SimHash near-dedup, mixing to target weights, packing.

Each stage works on all that the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import mixing, near_copies, packing, quality, toxicity
from quarry.llm.shared import staged
from quarry.llm.words import free_name


def _beside(docs: DataFrame, made: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on the documents, whose own columns named as the ``made`` ones are put aside; with these columns alone."""
    aside = {c: free_name(docs, f"own_{c}") for c in docs.columns if c.lower() in made}
    done = work(docs.withColumnsRenamed(aside)).drop(*made)
    return done.withColumnsRenamed({v: k for k, v in aside.items()}).select(*[f"`{c}`" for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic; it learns from labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.train(docs, labels)
    return _beside(docs, ["score", "predicted"], lambda d: model.score(d).filter("predicted = 0"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned rules do not reject. Short ones are learned from and judged like any other."""
    rules = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), base=False)
    return _beside(docs, ["q_stats", "base_failed", "kept"], lambda d: quality.assess(d, rules, base=False).filter("kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that with the smallest doc_id."""
    return near_copies.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate draws it, in shuffled order; small sources are lifted."""
    weights = mixing.tempered_weights(docs)
    return _beside(docs, ["copy", "n_copies"], lambda d: mixing.replicate(d, weights))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in windows of 2048 tokens."""
    import public_tokenizers

    return packing.packed_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1)


#: (name, function of (spark, docs, sf_dir)).
STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("simhash", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: The first stages learn their models, which SQL cannot; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of ``sf_dir``, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
