"""License scans by canonical digest lookup.

A text is brought to a canonical form (case, punctuation, copyright lines, equivalent
spellings) and its digest looked up among those of known licences and notices, which are
made from their texts in the same way.  Only DataFrame functions are used.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import checkpointed, rows_of, skew_join
from quillspark.llm.licence_texts import LICENCES, NOTICES, TITLES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (pattern, replacement) in order, after lower-casing A-Z; the same in Java, Python and RE2.
STEPS = (
    (r"(^|\n)[^a-z0-9\n]*(copyright[ \t]*(\(c\)|©|[0-9<\[{])|\(c\)[ \t]|©)[^\n]*", "\n"),  # copyright lines, in comments too
    (r"(^|\n)[^a-z0-9\n]*([0-9][0-9]?|[a-z])[.)][ \t]+", "\n"),  # marks of a list
    (r"&", " and "),
    (r"https?://", "url "),
    (r"[^a-z0-9]+", " "),
    (r"\b(licen)c(e|es|ed|ing|or|ors|ee|ees)\b", "{1}s{2}"),
    (r"\b(organi|reali|recogni|authori)s(e|ed|es|ing|ation|ations)\b", "{1}z{2}"),
    (r"\bsub licens", "sublicens"),
    (r"\bnon infring", "noninfring"),
    (r"\bcopyright owner", "copyright holder"),
    (r"\ball rights reserved\b", ""),
    (r" +", " "),
    (r"^ +| +$", ""),
)

#: Found in every text whose canonical form has "licens" or "public domain".
HINT = r"(?i)licen[sc]|public[^a-zA-Z0-9]+domain"


def canonical_text(text: str) -> str:
    """What ``canonical`` makes of a text, for the known ones."""
    out = text.translate(str.maketrans(UPPER, LOWER))
    for pattern, new in STEPS:
        out = re.sub(pattern, new.replace("{1}", r"\g<1>").replace("{2}", r"\g<2>"), out)
    return out


def canonical(text: Column) -> Column:
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for pattern, new in STEPS:
        out = F.regexp_replace(out, pattern, new.replace("{1}", "$1").replace("{2}", "$2"))
    return out


def digest_of(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def titled(texts: dict[str, str]) -> list[tuple[str, str]]:
    """(licence, text) of each text, alone and below each of its titles: files carry either."""
    return [(name, text if not title else f"{title}\n\n{text}") for name, text in texts.items() for title in ("", *TITLES.get(name, ()))]


def known(texts: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """(digest, licence) of known texts; of equal ones the first name."""
    found: dict[str, str] = {}
    for name, text in texts:
        found.setdefault(digest_of(text), name)
    return list(found.items())


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, digest, licence, notices.

    Licence is that whose canonical text the whole document is, with one of its titles or
    without, as plain text or as a comment, or null; notices lists the
    licences of which a line of the document is a known notice, sorted and joined by commas
    ("" for none).  Null texts are empty and match nothing, as empty ones do; texts are read
    whole, however long; rows that repeat a doc_id share their notices; other columns are
    ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    # Both tables of known digests are constants of this module: they are broadcast.
    whole = F.broadcast(rows_of(spark, known([*titled(LICENCES), *NOTICES.items()]), "digest string, licence string"))
    lines = F.broadcast(rows_of(spark, known(NOTICES.items()), "line_digest string, notice string"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    looked_up = named.select("doc_id", F.sha2(canonical("text"), 256).alias("digest")).join(whole, "digest", "left")
    # Every known notice has "licens" or "public domain" in its canonical form; these are all spellings of them, so other lines need no digest.
    candidates = named.where(F.col("text").rlike(HINT)).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(F.col("line").rlike(HINT))
    hits = candidates.select("doc_id", F.sha2(canonical("line"), 256).alias("line_digest")).join(lines, "line_digest")
    noted = hits.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("notice")), ",").alias("notices"))
    return skew_join(looked_up, checkpointed(noted), ["doc_id"], "left").select("doc_id", "digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"))


def canonical_sql(column: str) -> str:
    """DuckDB SQL of ``canonical``."""
    out = f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"
    for pattern, new in STEPS:
        pattern, new = pattern.replace(r"\n", "' || chr(10) || '"), new.replace("{1}", r"\1").replace("{2}", r"\2").replace("\n", "' || chr(10) || '")
        out = f"regexp_replace({out}, '{pattern}', '{new}', 'g')"
    return out


def oracle_sql() -> str:
    values = lambda rows: ", ".join(f"('{d}', '{n}')" for d, n in rows)
    return f"""
        WITH whole(digest, licence) AS (VALUES {values(known([*titled(LICENCES), *NOTICES.items()]))}),
        lines(line_digest, notice) AS (VALUES {values(known(NOTICES.items()))}),
        docs AS (SELECT doc_id, text, sha256({canonical_sql("text")}) AS digest FROM documents),
        split AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
        hits AS (SELECT doc_id, string_agg(DISTINCT notice, ',' ORDER BY notice) AS notices
                 FROM (SELECT doc_id, sha256({canonical_sql("line")}) AS line_digest FROM split) JOIN lines USING (line_digest) GROUP BY doc_id)
        SELECT doc_id, digest, licence, coalesce(notices, '') AS notices
        FROM docs LEFT JOIN whole USING (digest) LEFT JOIN hits USING (doc_id)"""
