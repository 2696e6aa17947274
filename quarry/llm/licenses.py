"""Licence scans: entire texts are brought to a canonical form, hashed and joined to known digests.

The form is that of licence matching in general: case, punctuation, white space and copyright lines
do not count, and words with two accepted spellings are written one way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_entire import ENTIRE
from .license_texts import KNOWN
from .shared import staged
from .words import let

#: Words that follow "copyright" in the wording of licences, never in a line that names a holder or year.
WORDING = [
    "able", "also", "and", "are", "as", "disclaimer", "disclaimers", "doctrine", "doctrines", "ed", "for", "holder", "holders", "if", "in", "infringement", "interest", "interests", "is",
    "law", "laws", "license", "licence", "licenses", "licences", "like", "line", "lines", "notice", "notices", "of", "on", "or", "owner", "owners", "ownership", "permission", "permissions", "protection",
    "resulting", "right", "rights", "statement", "statements", "status", "to", "treaties", "treaty", "under", "with",
]
_NAMED = rf"copyright(?:[^a-z0-9\n]*+(?:19|20)[0-9]{{2}}|(?![,.;)\"'”-])[^a-z0-9\n]++(?!(?:{'|'.join(WORDING)}|the (?:software|work|program|library))\b)[a-z0-9])"
_MARKED = r"\(c\)[^a-z0-9\n]*(?:©|<|\[|(?:19|20)[0-9]{2}|" + _NAMED + ")"
_LINE = r"(^|\n)[^a-z0-9\n]*(?:%s)[^\n]*"
_RIGHTS = r"all rights reserved(?: by\b|[^a-z0-9\n]*(?=\n|\z))"
#: Copyright lines, after any comment marks: they state a holder or year. A bare "(c)" with a name is one too, but not
#: in texts with an item "(b)", where it is the next item.
HOLDER_LINE, LETTERED_LINE = (_LINE % "|".join([_NAMED, c, "©", _RIGHTS]) for c in (r"\(c\)", _MARKED))
#: The rule of the SQL, which takes every line that starts with one of these for a copyright line.
COPYRIGHT_LINE = r"(^|\n)[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
#: What is not a letter or digit: ASCII marks and, beyond ASCII, quotation marks, dashes and the like; line feeds are kept.
OTHER = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f“”„‘’‚–—―«»‹›…•·©®™\x{a0}\x{2009}\x{3000}]+"
#: Spellings that licence matching treats as equal, after punctuation has gone.
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("judgement", "judgment"), ("per cent", "percent"),
    ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("copyright owner", "copyright holder"), ("https", "http"),
    ("organisation", "organization"), ("recognise", "recognize"), ("utilisation", "utilization"), ("initialise", "initialize"), ("favour", "favor"),
    ("honour", "honor"), ("behaviour", "behavior"), ("colour", "color"), ("centre", "center"), ("wilful", "willful"), ("whilst", "while"), ("merchantibility", "merchantability"),
]


def _plain_lines(text: Column) -> Column:
    """The text in lower case without copyright lines, its words parted by single spaces, its lines kept."""
    bare = lambda x: F.when(F.contains(x, F.lit("(b)")), F.regexp_replace(x, LETTERED_LINE, "$1")).otherwise(F.regexp_replace(x, HOLDER_LINE, "$1"))
    return F.regexp_replace(let(F.lower(text), bare), OTHER, " ")


def _spelled(plain: Column) -> Column:
    for other, one in SPELLINGS:
        plain = F.replace(plain, F.lit(other), F.lit(one))
    return F.trim(plain)


def _one_line(lines: Column) -> Column:
    return F.regexp_replace(F.replace(lines, F.lit("\n"), F.lit(" ")), " {2,}", " ")


def _hashed(form: Column) -> Column:
    return F.sha2(F.nullif(form, F.lit("")), 256)


def canonical(text: Column) -> Column:
    """The canonical form of an entire text; empty if nothing is left of it, null for null."""
    return _spelled(_one_line(_plain_lines(text)))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical form in hexadecimal; null if the form is empty or the text null."""
    return _hashed(canonical(text))


def known_digests(known: DataFrame) -> DataFrame:
    """(digest, license_id) of a table of (license_id, text); of licences with one form, the first by name."""
    named = known.select(digest(F.col("text")).alias("digest"), "license_id").filter("digest IS NOT NULL")
    return named.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def builtin_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text) of notices and short licences (KNOWN), which the SQL has too, and of ENTIRE, which it has not."""
    return spark.createDataFrame(KNOWN + ENTIRE, "license_id string, text string")


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, line_no, digest, license_id): each document as an entire text, and each of its lines that is one.

    Every row of ``docs`` gives one row with line_no null: its digest, and license_id or null. Lines,
    counted from 1, are looked up as entire texts too and come only where they are a known text, as
    notices do. Null texts and texts of punctuation or copyright lines alone have a null digest.
    Repeated rows give repeated results; an empty table gives none; other columns are left aside.
    The known digests are written first, so that Spark knows their size: it broadcasts them while they
    are small and shuffles both sides beyond.
    """
    table = known_digests(known)
    unit = lambda n, form: F.struct(n.cast("int").alias("line_no"), _hashed(form).alias("digest"))
    whole = lambda x: F.array(unit(F.lit(None), _spelled(_one_line(x))))
    lines = lambda x: F.transform(F.split(x, "\n"), lambda line, k: unit(k + 1, _spelled(line)))
    both = let(_plain_lines(F.col("text")), lambda x: F.concat(whole(x), F.coalesce(lines(x), F.array().cast("array<struct<line_no:int,digest:string>>"))))
    units = docs.select("doc_id", F.explode(both).alias("u")).select("doc_id", "u.line_no", "u.digest")
    found = units.join(staged(known_digests(known), "known-digests"), "digest", "left")
    return found.filter("line_no IS NULL OR license_id IS NOT NULL").select("doc_id", "line_no", "digest", "license_id")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the built-in licence texts."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), builtin_licenses(spark))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_lines(column: str) -> str:
    return f"regexp_replace(regexp_replace(lower({column}), {_quoted(COPYRIGHT_LINE)}, '\\1', 'g'), {_quoted(OTHER)}, ' ', 'g')"


def _sql_digest(plain: str) -> str:
    for other, one in SPELLINGS:
        plain = f"replace({plain}, '{other}', '{one}')"
    return f"sha256(nullif(trim({plain}), ''))"


_WHOLE = _sql_digest("regexp_replace(replace(plain, chr(10), ' '), ' {2,}', ' ', 'g')")
SQL = f"""
WITH texts(license_id, text) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in KNOWN)}),
known AS (SELECT {_WHOLE} AS digest, min(license_id) AS license_id FROM (SELECT license_id, {_sql_lines("text")} AS plain FROM texts) GROUP BY 1),
d AS (SELECT doc_id, {_sql_lines("text")} AS plain FROM documents),
lines AS (SELECT doc_id, generate_subscripts(l, 1)::INTEGER AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(plain, chr(10)) AS l FROM d)),
digests AS (
  SELECT doc_id, NULL::INTEGER AS line_no, {_WHOLE} AS digest FROM d
  UNION ALL
  SELECT doc_id, line_no, {_sql_digest("line")} FROM lines)
SELECT doc_id, line_no, d.digest, license_id FROM digests d LEFT JOIN known k ON d.digest = k.digest
WHERE line_no IS NULL OR license_id IS NOT NULL
"""
