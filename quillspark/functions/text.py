"""Text normalisers and tokenizers as column expressions.

They differ on purpose: one deletes punctuation, another turns it into spaces, a third
keeps apostrophes inside words.  Each has a name of its own and none stands for another.
All lower-case with ``lower``; where full case folding and compatibility forms matter,
pass the text through ``compatibility_fold`` first.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# The word lists that the published results rest on.
ARTICLES = ("a", "an", "the")
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14",
    "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19", "twenty": "20",
}
QUESTION_WORDS = tuple("what which who whom whose where when why how is are was were do does did can could would should has have had".split())
STOP_WORDS = (*QUESTION_WORDS, *"a an the of to in on at for from with and or by as it its be been being after".split())
VISUAL_WORDS = tuple(
    "image photo picture shown depicted visible this that these those object person character building logo emblem event name type located place thing model product structure street bridge tower government".split()
)
CATEGORY_WORDS = tuple("animal bird breed car company food fruit goat item man monument plant root symbol vegetable vehicle woman".split())
GENERIC_WORDS = tuple(
    dict.fromkeys((*STOP_WORDS, *VISUAL_WORDS, *"answer identify identification find tell represented represent wearing performing happening officially named".split(), *CATEGORY_WORDS))
)
CONTEXT_STOP_WORDS = tuple(
    "a an and are as at be been being by do does for from had has have he her here his how i if in into is it its of on or our she that the their them there these they this those to was we were what when where which who why with you your".split()
)
TITLES = tuple("duke duchess king queen prince princess emperor empress president saint sir dame dr doctor professor".split()) + ("grand duke", "grand duchess")
#: Words of a question that its search query leaves out: all of them, or only those that open a question.
UNSEARCHED = tuple("what which who whom whose where when why how am are can could did do does is was were would this that".split())
OPENERS = tuple("what which who whom whose where when why how".split())
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
WORD = r"[\p{L}\p{N}]+"
JOINED_WORD = rf"{WORD}(?:['’-]{WORD})*"
QUERY_WORD = rf"{WORD}(?:['’-]{WORD})?"
DATE_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "MMMM d yyyy", "MMM d yyyy", "d MMMM yyyy", "d MMM yyyy")
#: What every text in one of DATE_FORMATS looks like: a parser that fails is far slower than this.
DATE_SHAPE = r"^(?:\+?[0-9]{4,}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}/[0-9]{2}/\+?[0-9]{4,}|(?:[^ ]+ [-+]?[0-9]+|[-+]?[0-9]+ [^ ]+) \+?[0-9]{4,})$"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once a row, however often ``f`` names it: a lambda binds it. In the bodies of lambdas Spark shares no common expressions."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


@F.pandas_udf(StringType())
def compatibility_fold(text: pd.Series) -> pd.Series:
    """NFKC and full case folding, which Spark has no function for (an Arrow batch at a time)."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def collapsed(text: Column) -> Column:
    """White space runs become single spaces, outer ones go."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def without(tokens: Column, words: tuple[str, ...]) -> Column:
    """The tokens that are none of ``words``, in order, repeats kept."""
    listed = F.array(*map(F.lit, words))
    return F.filter(tokens, lambda t: ~F.array_contains(listed, t))


def protocol_answer(text: Column) -> Column:
    """Lower case, ASCII punctuation deleted, articles dropped."""
    bare = F.translate(F.lower(text), ASCII_PUNCTUATION, "")
    return collapsed(F.regexp_replace(bare, r"(?<![\p{L}\p{N}_])(a|an|the)(?![\p{L}\p{N}_])", " "))


def normal_date(text: Column) -> Column:
    """A date in one of DATE_FORMATS as "yyyy MM dd"; any other text as it is."""
    read = lambda months: F.date_format(F.coalesce(*[F.try_to_timestamp(months, F.lit(f)) for f in DATE_FORMATS]), "yyyy MM dd")
    dated = lambda plain: F.when(plain.rlike(DATE_SHAPE), once(F.initcap(plain), read))
    return once(text, lambda t: F.coalesce(once(collapsed(F.translate(t, ",", " ")), dated), t))


def evaluation_answer(text: Column, dates: bool = True) -> Column:
    """Lower case, digit commas gone, dates in one form, punctuation to spaces, no articles, number words as digits."""
    plain = F.regexp_replace(F.trim(F.lower(text)), r"(\d),(?=\d)", "$1")
    plain = normal_date(plain) if dates else plain
    spaced = F.regexp_replace(plain, r"[\p{Punct}“”‘’–—…]", " ")
    tokens = without(F.filter(F.split(spaced, r"\s+"), lambda t: t != ""), ARTICLES)
    digits = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    return F.array_join(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(digits, t), t)), " ")


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, joined by apostrophes or hyphens."""
    return all_matches(F.lower(text), JOINED_WORD)


def quality_text(text: Column) -> Column:
    return F.array_join(words(text), " ")


def content_words(text: Column, excluded: tuple[str, ...] = ()) -> Column:
    return without(words(text), (*GENERIC_WORDS, *excluded))


def query_words(text: Column) -> Column:
    """Runs of letters and digits in their case, with one apostrophe or hyphen part at most."""
    return all_matches(text, QUERY_WORD)


def context_words(text: Column) -> Column:
    return without(all_matches(F.lower(text), WORD), CONTEXT_STOP_WORDS)


def question_key(text: Column) -> Column:
    """Lower-case letters, digits and underscores, single-spaced: equal for questions alike but for punctuation."""
    return F.array_join(all_matches(F.lower(text), r"[\p{L}\p{N}_]+"), " ")


def exact_key(text: Column) -> Column:
    return collapsed(F.lower(text))


def singular_words(tokens: Column) -> Column:
    """-ies to -y in words over four letters; -s dropped in words over three unless they end in ss, us or is."""
    return F.transform(
        tokens,
        lambda t: F.when(t.endswith("ies") & (F.length(t) > 4), F.concat(F.expr("''"), F.substring(t, F.lit(1), F.length(t) - 3), F.lit("y")))
        .when(t.endswith("s") & (F.length(t) > 3) & ~t.rlike("(ss|us|is)$"), F.substring(t, F.lit(1), F.length(t) - 1))
        .otherwise(t),
    )


def person_core(text: Column) -> Column:
    """A normalised name without a leading title and without the plain words from "of" on that end it."""

    def untitled(tokens: Column) -> Column:
        first, two = F.get(tokens, F.lit(0)), F.array_join(F.slice(tokens, 1, 2), " ")
        titles = once(F.when(two.isin(*TITLES), 2).when(first.isin(*TITLES), 1).otherwise(0), lambda title: F.when(F.size(tokens) > title, F.slice(tokens, title + 1, F.size(tokens))).otherwise(tokens))
        return once(titles, without_origin)

    def without_origin(name: Column) -> Column:
        plain_after = lambda i: F.forall(F.slice(name, i + 2, F.size(name)), lambda t: t.rlike("^[a-z-]+$"))
        places = F.when(F.size(name) > 2, F.sequence(F.lit(1), F.size(name) - 2)).otherwise(F.array().cast("array<int>"))
        origin = F.get(F.filter(places, lambda i: (F.get(name, i) == "of") & plain_after(i)), F.lit(0))
        return F.array_join(once(origin, lambda at: F.when(at.isNotNull(), F.slice(name, 1, at)).otherwise(name)), " ")

    return once(F.filter(F.split(text, " "), lambda t: t != ""), untitled)


def search_title(title: Column) -> Column:
    """A page title without a file extension and what follows a spaced dash, pipe or colon."""
    head = F.split(F.regexp_replace(title, r"(?i)\.(jpe?g|png|gif|webp|svg)$", ""), r"\s+[-–—|:]\s+", 2)[0]
    return collapsed(head)


def bootstrap_query(question: Column, most: int = 32) -> Column:
    """A search query from a question: its distinct words, without the unsearched ones if three remain, else without openers and filled up to three."""
    spoken = F.array_distinct(all_matches(F.lower(F.regexp_replace(question, r"<[^>]*>", " ")), QUERY_WORD))
    few, more = without(spoken, UNSEARCHED), without(spoken, OPENERS)
    filled = F.concat(more, F.slice(F.array(F.lit("factual"), F.lit("information")), F.lit(1), F.greatest(F.lit(0), 3 - F.size(more))))
    return F.array_join(F.slice(F.when(F.size(few) > 2, few).otherwise(filled), 1, most), " ")


def query_faults(query: Column, least: int = 3, most: int = 32) -> Column:
    n = F.size(query_words(query))
    return F.array_compact(
        F.array(
            F.when(F.trim(query) == "", "empty_query"), F.when(query.rlike("<[^>]*>"), "query_contains_xml"),
            F.when(n < least, "query_too_short"), F.when(n > most, "query_too_long"),
        )
    )


def shortened(text: Column, most: int) -> Column:
    return F.rtrim(F.substring(collapsed(text), 1, most))


def canonical_url(url: Column) -> Column:
    """Lower-case scheme and host, no default port, no fragment, no tracking parameters, the rest sorted."""
    scheme, host = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.regexp_replace(host, F.when(scheme == "http", ":80$").otherwise(":443$"), "")
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(r"^(utm_[^=]*|gclid|fbclid|msclkid)(=|$)"))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(F.array_sort(kept), "&"))).otherwise("")
    return F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(path), tail)


def url_title(url: Column) -> Column:
    """The last part of a URL's path, underscores as spaces."""
    return F.translate(F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1), "_", " ")


def html_lines(html: Column) -> Column:
    """Text of HTML by patterns alone: scripts and styles dropped, block tags as line ends, other tags as nothing."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg|template)\b.*?</\1\s*>|<!--.*?-->", "")
    lined = F.regexp_replace(bare, r"(?i)</?(p|div|li|ul|ol|br|h[1-6]|tr|table|section|article|header|footer|nav)\b[^>]*>", "\n")
    tagless = F.regexp_replace(lined, r"<[^>]*>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        tagless = F.replace(tagless, F.lit(name), F.lit(char))
    lines = F.transform(F.split(tagless, r"\n"), lambda line: collapsed(line))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def candidate_answers(value: Column) -> Column:
    """The strings of a JSON list; of any other text, itself; nothing of a blank one."""
    text = F.trim(value)
    listed = F.from_json(text, "array<string>")
    items = F.when(text.startswith("["), F.coalesce(listed, F.array(text))).otherwise(F.array(F.regexp_replace(text, '^"(.*)"$', "$1")))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def accepted_answers(canonical: Column, candidates: Column) -> Column:
    """The canonical answer and the candidates, the first of each normalised form."""
    every = F.filter(F.transform(F.concat(F.array(canonical), candidate_answers(candidates)), lambda x: F.trim(x)), lambda x: protocol_answer(x) != "")
    keyed = F.transform(every, lambda x: F.struct(protocol_answer(x).alias("key"), x.alias("value")))
    found = F.struct(keyed.alias("rows"), F.transform(keyed, lambda x: x["key"]).alias("keys"))
    return once(found, lambda z: F.transform(F.filter(z["rows"], lambda x, i: F.array_position(z["keys"], x["key"]) == i + 1), lambda x: x["value"]))
