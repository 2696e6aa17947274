"""Text expressions: tokens, slugs, repository addresses and patterns."""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


_WORD = "abcdefghijklmnopqrstuvwxyz0123456789_"


def _parted(text: Column, kept: str = "") -> Column:
    """The lower-cased text with spaces for all but word characters and ``kept``. Most of them are ASCII, which needs no pattern."""
    between = "".join(chr(i) for i in range(128) if chr(i) not in _WORD + kept)
    return F.regexp_replace(F.translate(F.lower(text), between, " " * len(between)), r"[^\x00-\x7F]+", " ")


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores; null for null."""
    return F.array_remove(F.split(_parted(text), " "), "")


def token_lines(text: Column) -> Column:
    """The text with each line's tokens parted by single spaces; lines stay lines."""
    return F.regexp_replace(_parted(text, "\n"), " {2,}", " ")


def term_count(text: Column, term: str) -> Column:
    """How often a term is among the tokens of a text, without making the tokens."""
    return F.regexp_count(F.lower(text), F.lit(rf"(?<![a-z0-9_]){term}(?![a-z0-9_])"))


def query_terms(query: str) -> list[str]:
    """The distinct tokens of a query, in order."""
    return list(dict.fromkeys(t for t in re.sub("[^a-z0-9_]+", " ", query.lower()).split(" ") if t))


def like_pattern(query: str, wildcards: bool = False) -> str:
    """The query as an ILIKE pattern body; its own ``%`` and ``_`` are taken literally unless ``wildcards``."""
    return query if wildcards else re.sub(r"([\\%_])", r"\\\1", query)


def slugify(name: Column) -> Column:
    """Lower-case words joined by hyphens, at most 60 characters, ``project`` if nothing is left."""
    hyphens = F.regexp_replace(F.trim(F.lower(name)), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(hyphens, "^-+|-+$", ""), 1, 60), F.lit("")), F.lit("project"))


def unique_slug(base: Column, place: Column) -> Column:
    """The n-th project of a base slug (from 1) gets the base itself or ``base-n``."""
    return F.when(place == 1, base).otherwise(F.concat(base, F.lit("-"), place.cast("string")))


def normalized_url(url: Column) -> Column:
    """A repository address with its scheme; provider shorthand becomes https, anything else null."""
    trimmed = F.trim(url)
    return (
        F.when(trimmed.rlike("^(?i)(https?://|git@|ssh://|file://)"), trimmed)
        .when(trimmed.rlike(r"^(github\.com|gitlab\.com|bitbucket\.org)/[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"), F.concat(F.lit("https://"), trimmed))
    )


def provider(url: Column) -> Column:
    low = F.lower(url)
    return F.when(low.contains("github.com"), "github").when(low.contains("gitlab.com"), "gitlab").when(low.contains("bitbucket.org"), "bitbucket").otherwise("generic")


def plain_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def unescaped_path(path: Column) -> Column:
    """A path of git's output with its octal escapes (a backslash and three digits) as the characters of that code."""
    pieces = F.regexp_extract_all(path, F.lit(r"(\\[0-7]{3}|[^\\]+|\\)"), 1)
    octal = lambda p: F.char(F.conv(F.substring(p, 2, 3), 8, 10).cast("int"))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(r"^\\[0-7]{3}$"), octal(p)).otherwise(p)), "")


def compact_number(n: Column) -> Column:
    """1234 as 1.2k, 2500000 as 2.5M, smaller numbers as they are."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1000, F.format_string("%.1fk", n / 1000)).otherwise(n.cast("string"))


def relative_time(at: Column, now: Column) -> Column:
    """How long ago: just now (under a minute), minutes, hours, days."""
    s = now.cast("long") - at.cast("long")
    ago = lambda unit, name: F.concat(F.floor(s / unit).cast("string"), F.lit(f"{name} ago"))
    return F.when(s < 60, "just now").when(s < 3600, ago(60, "m")).when(s < 86_400, ago(3600, "h")).otherwise(ago(86_400, "d"))


def bucket(term: Column, buckets: int) -> Column:
    """The bucket that a term is stored in."""
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def bucket_number(term: str, buckets: int) -> int:
    """The same for a term that is at hand: XXH64 of its bytes with Spark's seed, as a signed number."""
    value = xxhash.xxh64_intdigest(term.encode(), seed=42)
    return (value - (1 << 64) if value >> 63 else value) % buckets


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def or_default(value: Column, default: Column) -> Column:
    """The project's own setting, or the default where that is null, empty or zero."""
    return F.coalesce(F.when((value.cast("string") != "") & (value.cast("string") != "0"), value), default)


def distinct_kept(items: Column) -> Column:
    """Distinct items that are neither null nor empty, in order of first appearance."""
    return F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != "")))


def key_hash(key: Column) -> Column:
    """How an API key is stored: its SHA-256."""
    return F.sha2(key, 256)


def key_prefix(key: Column) -> Column:
    """What is shown of a stored key."""
    return F.substring(key, 1, 10)


def sealed(plain: Column, key: Column) -> Column:
    """AES-GCM of a text under a 32-byte key: nonce, cipher text and tag."""
    return F.aes_encrypt(plain, key, F.lit("GCM"))


def opened(cipher: Column, key: Column) -> Column:
    return F.aes_decrypt(cipher, key, F.lit("GCM")).cast("string")
