"""Operator 1: license scans by canonical digest lookup.

A text is brought to a canonical form (case, copyright lines, punctuation, equivalent
spellings) and the digest of the whole of it is joined to the digests of known licence
texts that went through the same expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_texts import LICENSES, WHOLE_LICENSES

# Spellings that count as the same word, variant first.
EQUIVALENT = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("artefact", "artifact"), ("authorisation", "authorization"),
    ("authorised", "authorized"), ("cancelled", "canceled"), ("capitalisation", "capitalization"), ("centre", "center"),
    ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("favour", "favor"), ("favourite", "favorite"),
    ("fulfil", "fulfill"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("merchantibility", "merchantability"),
    ("noncommercial", "non commercial"), ("organisation", "organization"), ("organise", "organize"), ("per cent", "percent"),
    ("programme", "program"), ("recognise", "recognize"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("https", "http"),
)
#: A line that begins like this, after comment marks, names the owner, not the terms: a year, (c) or an owner follows, not a word of the terms.
_TERMS = (
    "notices?|holders?|owners?|licen[cs]es?|laws?|laws?-like|like|line|lines|statements?|interests?|rights?|protection|treaty|treaties|and|or|in|is|are|on|of|to|for|from|"
    "that|which|with|under|as|any|disclaimers?|permission|ownership|status|infringement|also|means|may|can|shall|will|page|information|management"
)
COPYRIGHT_LINE = (
    r"^[^\p{L}\p{N}(©\[<]*(all rights reserved|(copyright[ \t:,]*)?(\(c\)|©)[ \t,:]*([\[<(]?(\d|yyyy|year))|copyright[ \t:,]*(\(c\)|©)|"
    rf"©[ \t]*\p{{L}}|copyright[ \t:,]+(by[ \t]|[\[<(]?(\d|yyyy|year)|(?!({_TERMS})(?![\p{{L}}\p{{N}}]))\p{{L}}))"
)
#: The rule of the SQL below, which keeps its first form.
SQL_COPYRIGHT_LINE = r"^[ \t]*(copyright|\(c\)|©|all rights reserved)"
SPACED = r"[^\p{L}\p{N}]+"


def canonical(text: Column) -> Column:
    """Canonical form of a whole text, of built-in expressions only."""
    lines = F.filter(F.split(F.lower(text), "\n"), lambda x: ~x.rlike(COPYRIGHT_LINE))
    # a space on each side of each word, so that replacements of neighbours don't share one
    out = F.concat(F.lit(" "), F.regexp_replace(F.array_join(lines, "\n"), SPACED, "  "), F.lit(" "))
    for variant, word in EQUIVALENT:
        out = F.replace(out, F.lit(f" {variant.replace(' ', '  ')} "), F.lit(f" {word.replace(' ', '  ')} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def known_licenses(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license_id, digest) of licence texts; of texts with one canonical form the first id counts."""
    rows = sorted((texts or LICENSES | WHOLE_LICENSES).items())
    known = spark.createDataFrame(rows, "license_id string, text string")
    return known.groupBy(F.sha2(canonical(F.col("text")), 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def license_scan(df: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Look every whole text up among known licences.

    Returns doc_id, canonical_chars, digest (sha256 of the canonical form) and license_id,
    null where the whole text is no known licence. Null and empty texts, and texts of
    punctuation and copyright lines only, have an empty canonical form and no licence.
    Repeated rows are looked up each for itself; an empty table gives an empty table;
    other columns are ignored. The known table decides the join by its own size; rows
    of one digest, however many, are not gathered for it.
    """
    own = df.select(F.col(doc_id).alias("doc_id"), canonical(F.coalesce(F.col(text), F.lit(""))).alias("c"))
    own = own.select("doc_id", F.length("c").cast("long").alias("canonical_chars"), F.sha2("c", 256).alias("digest"))
    return own.join(known, "digest", "left").select(
        "doc_id", "canonical_chars", "digest", F.when(F.col("canonical_chars") > 0, F.col("license_id")).alias("license_id")
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the built-in table has 31 rows of 100 bytes
    return license_scan(table(spark, sf_dir, "documents"), F.broadcast(known_licenses(spark)))


def _canonical_sql(text: str) -> str:
    lines = f"array_to_string(list_filter(string_split(lower({text}), chr(10)), lambda x: NOT regexp_matches(x, '{SQL_COPYRIGHT_LINE}')), chr(10))"
    out = f"' ' || regexp_replace({lines}, '{SPACED}', '  ', 'g') || ' '"
    for variant, word in EQUIVALENT:
        out = f"replace({out}, ' {variant.replace(' ', '  ')} ', ' {word.replace(' ', '  ')} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


def _oracle() -> str:
    rows = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in sorted(LICENSES.items()))
    return f"""
WITH k AS (
  SELECT sha256({_canonical_sql('t')}) AS digest, min(id) AS license_id FROM (VALUES {rows}) AS v(id, t) GROUP BY 1
), d AS (SELECT doc_id, {_canonical_sql("coalesce(text, '')")} AS c FROM documents)
SELECT doc_id, length(c)::BIGINT AS canonical_chars, sha256(c) AS digest, CASE WHEN length(c) > 0 THEN license_id END AS license_id
FROM d LEFT JOIN k ON k.digest = sha256(d.c)
"""


ORACLE = _oracle()
