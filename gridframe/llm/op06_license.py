"""License scans by canonical digest lookup.

A text is brought to a canonical form: lower case; the usual spelling variants made one;
lines that state a copyright (by a sign or a year after the word, so that no wrapped line of
a licence is one) removed; everything but letters and digits a blank.  The
SHA-256 digest of that form is hash-joined to the digests of known licences, so a
document is a licence if its entire text is one.  All of it is DataFrame functions.

A null text counts as empty; a text whose canonical form is empty has no licence.
Repeated rows give repeated results; two names for one known text give the smaller name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm.licenses import LICENSES

#: Spellings that licence matching guidelines treat as the same word.
EQUIVALENT = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("copyright holder", "copyright owner"),
    ("favour", "favor"),
    ("licence", "license"),
    ("licenced", "licensed"),
    ("modelled", "modeled"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("per cent", "percent"),
    ("programme", "program"),
    ("recognised", "recognized"),
    ("sublicence", "sublicense"),
    ("whilst", "while"),
)
#: A whole line that states a copyright or reserves all rights.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n(©]*((portions )?copyright[ \t:,]*(\(c\)|©|[<\[]?([0-9]{4}|year|yyyy))[^\n]*|(\(c\)|©)[ \t]*[0-9]{4}[^\n]*|all rights reserved[^\p{L}\p{N}\n]*)$"
#: Notices by which texts name their licence, with the names of the licences.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
)


def apart(words: str) -> str:
    """The words with two blanks between, so that each has its own on either side."""
    return f" {words.replace(' ', '  ')} "


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, " ")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    for variant, word in EQUIVALENT:
        out = F.replace(out, F.lit(apart(variant)), F.lit(apart(word)))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def digests(known: DataFrame) -> DataFrame:
    """(digest, license_id) of ``known(license_id, text)``, one row per canonical text."""
    form = known.select("license_id", canonical(F.col("text")).alias("form")).where("form <> '' and license_id is not null")
    return form.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))


def scan(documents: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, digest of the canonical text (null where empty), n_canonical, license_id (null: none)."""
    form = documents.select("doc_id", canonical(F.col("text")).alias("form"))
    digested = form.select("doc_id", F.when(F.col("form") != "", F.sha2("form", 256)).alias("digest"), F.length("form").cast("long").alias("n_canonical"))
    return digested.join(digests(known), "digest", "left").select("doc_id", "digest", "n_canonical", "license_id")


def known_licenses(documents: DataFrame) -> DataFrame:
    """The notices above and the whole texts of ``licenses`` as a table of known licences."""
    return documents.sparkSession.createDataFrame([*NOTICES, *LICENSES], "license_id string, text string")


def oracle_sql() -> str:
    """DuckDB SQL with the rows of ``scan`` for the known licences above."""
    out = "' ' || trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '" + COPYRIGHT_LINE + r"', ' ', 'g'), '[^\p{L}\p{N}]+', '  ', 'g')) || ' '"
    for variant, word in EQUIVALENT:
        out = f"replace({out}, '{apart(variant)}', '{apart(word)}')"
    out = f"trim(replace({out}, '  ', ' '))"
    known = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in (*NOTICES, *LICENSES))
    return f"""WITH k AS (SELECT sha256({out}) AS digest, min(name) AS license_id FROM (VALUES {known}) v(name, text) GROUP BY 1),
      d AS (SELECT doc_id, {out} AS form FROM documents),
      f AS (SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest, length(form) AS n_canonical FROM d)
      SELECT doc_id, digest, n_canonical, license_id FROM f LEFT JOIN k USING (digest)"""
