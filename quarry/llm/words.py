"""Column expressions shared by the text operators: whole-text words and values bound once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that ends a word: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
SPACES = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def free_name(df: DataFrame, name: str, *others: DataFrame) -> str:
    """``name``, with underscores added while ``df`` or another table has such a column (in any case)."""
    taken = {c.lower() for t in (df, *others) for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


def windows(ws: Column, size: int, make: Callable[[list[Column]], Column]) -> Column:
    """``make`` of each run of ``size`` consecutive elements; an empty array if there are fewer."""
    n = F.size(ws) - size + 1
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: make([F.get(ws, i + k) for k in range(size)]))


def one_text(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc_id, text) of each of the ``chosen`` doc_ids once: the text with the smallest hash where rows share a doc_id.

    ``chosen`` is a bounded sample, so it is broadcast; a hot doc_id is reduced before the shuffle.
    """
    held = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")
    return held.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("text"))
