"""Chunks of files: blocks of lines, markdown sections, and files put together again."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound

BLOCK_LINES, LOOK_BACK, LEAST = 150, 40, 20
HEADING = r"^(#{1,6})\s+(.+)$"


def block_ends(lines: list[str], size: int = BLOCK_LINES) -> list[tuple[int, int]]:
    """(first, last) lines from 0 of each block: at most ``size`` lines, a full block ending on a late blank line if it has one."""
    out, start, last = [], 0, len(lines) - 1
    while start <= last:
        end = min(start + size - 1, last)
        if end - start == size - 1:
            blanks = (i for i in range(end, max(start + LEAST, end - LOOK_BACK), -1) if not lines[i].strip())
            end = next(blanks, end)
        out.append((start, end))
        start = end + 1
    return out


def blocks(files: DataFrame, size: int = BLOCK_LINES) -> DataFrame:
    """(file_id, start_line, end_line, content) of each block of a file; none for blank files.

    Where a block may end depends on where the one before it ended, so each file is walked by a
    small helper; files are independent, and nothing is shuffled.
    """

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"first": a, "last": b} for a, b in block_ends(t.split("\n"), size)])

    some = files.filter(F.trim(F.regexp_replace(F.coalesce("content", F.lit("")), r"\s+", " ")) != "")
    found = some.withColumn("b", F.explode(cut("content")))
    held = F.array_join(F.slice(F.split("content", "\n"), F.col("b.first") + 1, F.col("b.last") - F.col("b.first") + 1), "\n")
    return found.select("file_id", (F.col("b.first") + 1).alias("start_line"), (F.col("b.last") + 1).alias("end_line"), held.alias("content"))


def blocks_between(files: DataFrame, size: int = BLOCK_LINES) -> DataFrame:
    """(file_id, start_line, end_line, content): the lines before, between and after a file's ``spans``, in blocks.

    ``spans`` holds (start_line, -end_line) of its declarations in order; what one of them ends before the
    next begins is between them. A file without any is cut from its first line to its last.
    """

    @F.pandas_udf("array<struct<first:int,last:int>>")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text, own):
            lines, out, at = text.split("\n"), [], 0
            for s in [] if own is None else own:
                if s["start_line"] - 1 > at:
                    out += [(at + a, at + b) for a, b in block_ends(lines[at : s["start_line"] - 1], size)]
                at = -s["minus_end"]
            out += [(at + a, at + b) for a, b in block_ends(lines[at:], size)]
            return [{"first": a, "last": b} for a, b in out]

        return pd.Series([one(t, s) for t, s in zip(texts, spans)])

    some = files.filter(F.col("content").rlike(r"\S"))
    found = some.withColumn("b", F.explode(cut("content", "spans")))
    held = F.array_join(F.slice(F.split("content", "\n"), F.col("b.first") + 1, F.col("b.last") - F.col("b.first") + 1), "\n")
    return found.select("file_id", (F.col("b.first") + 1).alias("start_line"), (F.col("b.last") + 1).alias("end_line"), held.alias("content"))


def line_blocks(content: Column, size: int) -> Column:
    """An array of (start_line, end_line, content): the text's lines, split once, in blocks of ``size``."""

    def cut(lines: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(lines) - 1, F.lit(size))
        block = lambda a: F.struct((a + 1).alias("start_line"), F.least(a + size, F.size(lines)).alias("end_line"), F.array_join(F.slice(lines, a + 1, size), "\n").alias("content"))
        return F.transform(starts, block)

    return bound(F.split(content, "\n"), cut)


def plain_blocks(files: DataFrame, size: int) -> DataFrame:
    """Blocks of exactly ``size`` lines, without looking for blank ones, by built-in functions alone."""
    some = files.filter(F.col("content").rlike(r"\S"))
    return some.select("file_id", F.explode_outer(line_blocks(F.col("content"), size)).alias("b")).select("file_id", "b.start_line", "b.end_line", "b.content")


def sections(files: DataFrame) -> DataFrame:
    """(file_id, heading, kind, start_line, end_line, content) of a markdown file: from each heading to the next.

    What comes before the first heading has none. Sections without text are left out. A file is one
    row, so its headings are found on the split text and what lies between is sliced; nothing is shuffled.
    """

    def cut(lines: Column) -> Column:
        places = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(HEADING), i)), lambda i: i.isNotNull())
        starts = lambda p: F.when(F.coalesce(F.get(p, F.lit(0)), F.lit(-1)) == 0, p).otherwise(F.concat(F.array(F.lit(0)), p))
        end = lambda s, k: F.coalesce(F.get(s, k + 1), F.size(lines))
        part = lambda s: F.transform(s, lambda a, k: F.struct(F.get(lines, a).alias("first"), a.alias("a"), end(s, k).alias("b"), F.array_join(F.slice(lines, a + 1, end(s, k) - a), "\n").alias("content")))
        return bound(places, lambda p: bound(starts(p), part))

    found = files.select("file_id", F.explode_outer(bound(F.split("content", "\n"), cut)).alias("s")).filter("s IS NOT NULL")
    text = F.regexp_replace("s.content", r"^\s+|\s+$", "")
    heading = F.when(F.col("s.first").rlike(HEADING), F.trim(F.nullif(F.regexp_extract("s.first", HEADING, 2), F.lit(""))))
    some = found.withColumn("content", text).filter("content <> ''").withColumn("heading", heading)
    return some.select("file_id", "heading", F.when(F.col("heading").isNull(), "module").otherwise("section").alias("kind"), (F.col("s.a") + 1).alias("start_line"), F.col("s.b").alias("end_line"), "content")


def reconstructed(chunks: DataFrame) -> DataFrame:
    """(file_id, content): a file's chunks in order, gathered once. Lines that several chunks hold are written once."""
    held = F.array_sort(F.collect_list(F.struct("start_line", "content")))
    lines = lambda c: F.split(c["content"], "\n")
    # From each chunk the lines after the last one written so far; those of a chunk that starts later are all new.
    step = lambda acc, c: F.struct(
        F.greatest(acc["upto"], c["start_line"] + F.size(lines(c)) - 1).alias("upto"),
        F.concat(acc["parts"], F.filter(F.array(F.array_join(F.slice(lines(c), F.greatest(F.lit(1), acc["upto"] - c["start_line"] + 2), F.size(lines(c))), "\n")), lambda x: acc["upto"] < c["start_line"] + F.size(lines(c)) - 1)).alias("parts"),
    )
    start = F.struct(F.lit(0).alias("upto"), F.array().cast("array<string>").alias("parts"))
    joined = F.aggregate("cs", start, step, lambda acc: F.array_join(acc["parts"], "\n"))
    return chunks.groupBy("file_id").agg(held.alias("cs")).select("file_id", joined.alias("content"))


def chunk_id(file_id: Column, content: Column, start_line: Column) -> Column:
    return F.sha2(F.concat_ws("|", file_id.cast("string"), start_line.cast("string"), content), 256)


def point_id(of_chunk: Column) -> Column:
    """A chunk's vector id: the SHA-256 of ``chunk:`` and its id in the shape of a UUID of version 5."""
    h = F.sha2(F.concat(F.lit("chunk:"), of_chunk), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.substring(h, 17, 4), F.substring(h, 21, 12))
