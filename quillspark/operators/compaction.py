"""Evidence compaction: sentences, budgets, anchors, and what a protocol can carry safely."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quillspark.functions import text as T

#: Characters that evidence of each rank may take, and all of it together.
BUDGETS = {1: 450, 2: 300, 3: 250}
CAP = 1200
#: A full stop after one of these ends no sentence.
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "st", "vs", "etc", "no", "fig", "jr", "sr", "inc", "ltd", "co")


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! ? and white space before a capital or digit, not after an abbreviation or initial."""
    guarded = F.regexp_replace(T.collapsed(text), rf"(?i)\b({'|'.join(ABBREVIATIONS)}|\p{{L}})\. ", "$1.\u0001")
    cut = F.split(F.regexp_replace(guarded, r"([.!?][\"”')\]]*) (?=[\"“'(\[]*[\p{Lu}\p{N}])", "$1\u0002"), "\u0002")
    return F.filter(F.transform(cut, lambda s: F.trim(F.translate(s, "\u0001", " "))), lambda s: s != "")


def trim(parts: list[str], most: int) -> str:
    """Whole leading sentences within ``most`` characters; of a longer first one, its whole leading words."""
    kept, used = [], -1
    for part in parts:
        if used + 1 + len(part) > most:
            break
        kept.append(part)
        used += 1 + len(part)
    if kept or not parts or most <= 0:
        return " ".join(kept)
    return parts[0][: most + 1].rpartition(" ")[0][:most]


def grow(parts: list[str], wanted: set[str], most: int) -> str:
    """The sentence with most wanted words and its neighbours, after and before by turns, as long as each fits."""
    if not parts:
        return ""
    hits = [len(wanted & set(re.findall(r"\w+", part.lower()))) for part in parts]
    seed = hits.index(max(hits))
    kept, used = set(), -1
    for i in sorted(range(len(parts)), key=lambda i: (abs(i - seed), i < seed)):
        if used + 1 + len(parts[i]) <= most:
            kept.add(i)
            used += 1 + len(parts[i])
    return " ".join(parts[i] for i in sorted(kept)) or trim(parts[seed:], most)


def usable_anchor(sentence: str) -> bool:
    """Thirty characters or more, with a letter, and no boilerplate."""
    boiler = r"cookie|subscribe|sign in|all rights reserved|privacy policy|click here"
    return len(sentence) >= 30 and re.search(r"[^\W\d_]", sentence) is not None and not re.search(boiler, sentence, re.I)


@F.pandas_udf(StringType())
def compacted(parts: pd.Series, wanted: pd.Series, rank: pd.Series) -> pd.Series:
    """Sentences of evidence within the budget of its rank, chosen by the words of the question."""
    least = min(BUDGETS.values())
    return pd.Series([grow(list(p), set(w), BUDGETS.get(r, least)) for p, w, r in zip(parts, wanted, rank, strict=True)])


@F.pandas_udf(StringType())
def hybrid(long: pd.Series, short: pd.Series, most: pd.Series) -> pd.Series:
    """An anchor sentence of the one evidence, then the sentences of the other without it, within ``most`` characters."""
    out = []
    for a, b, n in zip(long, short, most, strict=True):
        anchor = next(filter(usable_anchor, a), "")[:n]
        rest = trim([s for s in b if s != anchor], n - len(anchor) - 1 if anchor else n)
        out.append(f"{anchor} {rest}".strip())
    return pd.Series(out)


@F.pandas_udf(ArrayType(StringType()))
def within_cap(ranked: pd.Series, cap: pd.Series) -> pd.Series:
    """Evidence texts by rank, the last ones trimmed first, until all together are within the cap."""
    out = []
    for texts, most in zip(ranked, cap, strict=True):
        texts = list(texts)
        for i in range(len(texts) - 1, -1, -1):
            over = sum(map(len, texts)) - most
            if over > 0:
                texts[i] = trim([texts[i]], max(0, len(texts[i]) - over))
        out.append(texts)
    return pd.Series(out)


def sanitised(text: Column) -> list[Column]:
    """safe, urls, tags: a text without URLs, tags and control characters, and how many of each went."""
    no_urls = F.regexp_replace(text, r"https?://\S+", "")
    safe = F.regexp_replace(F.regexp_replace(no_urls, "</?[a-z_]+>", ""), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return [safe.alias("safe"), F.regexp_count(text, F.lit(r"https?://\S+")).alias("urls"), F.regexp_count(no_urls, F.lit("</?[a-z_]+>")).alias("tags")]
