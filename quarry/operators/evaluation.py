"""Evaluation of retrieval: recall at k over files and symbols, context hit rate, means over questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import plain_path

CUTS = (5, 10)
FLOOR = 0.5


def _share(hits: Column, expected: Column) -> Column:
    return F.when(F.size(expected) == 0, F.lit(1.0)).otherwise(hits.cast("double") / F.size(expected))


def file_recall(expected: Column, retrieved: Column, k: int) -> Column:
    """Share of expected paths among the first k retrieved (repeats are not collapsed); 1 if none is expected."""
    top = F.transform(F.slice(retrieved, 1, k), plain_path)
    return _share(F.size(F.filter(expected, lambda e: F.array_contains(top, plain_path(e)))), expected)


def symbol_recall(expected: Column, retrieved: Column, k: int) -> Column:
    """As ``file_recall``; a name fits one that equals it or is below or above it. Nulls drop out after the cut."""
    top = F.filter(F.slice(retrieved, 1, k), lambda s: s.isNotNull())
    fits = lambda e: F.exists(top, lambda s: (s == e) | s.startswith(F.concat(e, F.lit("."))) | e.startswith(F.concat(s, F.lit("."))))
    return _share(F.size(F.filter(expected, fits)), expected)


def context_rate(expected: Column, bundle: Column) -> Column:
    """Share of expected files in a bundle; null if none is expected."""
    held = F.transform(bundle, plain_path)
    hits = F.size(F.filter(expected, lambda e: F.array_contains(held, plain_path(e))))
    return F.when(F.size(expected) > 0, hits.cast("double") / F.size(expected))


def summary(runs: DataFrame) -> DataFrame:
    """Means over (expected_files, expected_symbols, paths, symbols, bundle, error); failed questions count but do not weigh."""
    fine = F.col("error").isNull()
    means = [F.avg(F.when(fine, f(F.col(f"expected_{what}"), F.col(got), k))).alias(f"recall_{what}_{k}") for what, got, f in (("files", "paths", file_recall), ("symbols", "symbols", symbol_recall)) for k in CUTS]
    return runs.agg(F.count("*").alias("questions"), F.count_if(~fine).alias("failed"), *means, F.avg(F.when(fine, context_rate(F.col("expected_files"), F.col("bundle")))).alias("context_hit_rate"))


def passes(means: DataFrame) -> DataFrame:
    return means.select("*", (F.coalesce("recall_files_10", F.lit(0.0)) >= FLOOR).alias("passed"))
