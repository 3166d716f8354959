"""What a query holds on to: entities that ranked titles share, anchors that a question or shown text names, tokens with their places."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from quillspark.functions import matching as M
from quillspark.functions import text as T
from quillspark.functions.batches import few

_TOKEN = StructType().add("token", StringType()).add("raw", StringType()).add("start", IntegerType()).add("end", IntegerType())
_EVIDENCE_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
MOST_ENTITY_TOKENS = 12


def _evidence_tokens(value: str | None) -> Iterator[tuple[str, str, int, int]]:
    for m in _EVIDENCE_WORD.finditer(unicodedata.normalize("NFKC", value or "")):
        if (word := m[0].casefold()) not in T.ARTICLES:
            yield T.NUMBER_WORDS.get(word, word), m[0], m.start(), m.end()


@F.pandas_udf(ArrayType(_TOKEN))
def placed_tokens(text: pd.Series) -> pd.Series:
    """The evidence tokens of a compatibility-normalised text, without articles, small numbers as digits, with their places in it."""

    return text.map(lambda value: [dict(zip(_TOKEN.names, t, strict=True)) for t in _evidence_tokens(value)])


def with_placed_tokens(df: DataFrame, text: str) -> DataFrame:
    """The other columns of ``df`` and token, raw, start, end: a row for each of ``placed_tokens`` of whole texts, made of a few texts at a time."""
    kept = [c for c in df.columns if c != text]
    schema = StructType([*(df.schema[c] for c in kept), *_TOKEN.fields])
    types = [to_arrow_type(f.dataType) for f in _TOKEN.fields]

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            found = [(k, *t) for k, value in enumerate(batch.column(text).to_pylist()) for t in _evidence_tokens(value)]
            if found:
                at, *fields = zip(*found, strict=True)
                columns = [batch.column(c).take(pa.array(at)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(f, t) for f, t in zip(fields, types, strict=True))], names=schema.names)

    return df.mapInArrow(placed, schema)


def named_shape(token: Column) -> Column:
    """Whether a token looks like part of a name: a capital first, or a digit in it."""
    return token.rlike(r"^\p{Lu}") | token.rlike(r"\p{N}")


def entity_words(text: Column) -> Column:
    """Lower-case tokens of a text that look like parts of names or stand in quotation marks, generic words left out."""
    quoted = F.flatten(F.transform(F.regexp_extract_all(text, F.lit("[\"“”‘’]([^\"“”‘’]+)[\"“”‘’]"), F.lit(1)), lambda q: T.words(q)))
    shaped = F.transform(F.filter(T.all_matches(text, T.JOINED_WORD), named_shape), lambda t: F.lower(t))
    return F.array_distinct(T.without(F.concat(shaped, quoted), T.GENERIC_WORDS))


def _anchor(query: Column, visible: Column, source: str) -> Column:
    shared = F.array_intersect(entity_words(query), entity_words(visible))
    tokens = T.all_matches(query, T.JOINED_WORD)
    # Runs of tokens that look named: all others become cuts.
    runs = lambda keep: F.filter(F.transform(F.split(F.array_join(F.transform(tokens, lambda t: F.when(keep(t), t).otherwise("\u0001")), " "), "\u0001"), lambda r: F.trim(r)), lambda r: r != "")
    phrases = F.filter(runs(named_shape), lambda r: M.has_phrase(T.quality_text(visible), T.quality_text(r)) & F.arrays_overlap(T.words(r), shared))
    words = runs(lambda t: F.array_contains(shared, F.lower(t)))
    longest = lambda rs: F.aggregate(rs, F.lit(None).cast("string"), lambda best, r: F.when(best.isNull() | (F.size(T.words(r)) > F.size(T.words(best))), r).otherwise(best))
    chosen = F.coalesce(longest(phrases), longest(words), F.array_min(shared))
    quoted = F.transform(F.regexp_extract_all(query, F.lit("[\"“”'‘’]([^\"“”'‘’]+)[\"“”'‘’]"), F.lit(1)), T.quality_text)
    kind = (
        F.when(F.array_contains(quoted, T.quality_text(chosen)), "quoted_entity").when(chosen.rlike(r"\p{N}"), "numeric_identifier")
        .when((F.upper(chosen) == chosen) & (F.length(chosen) > 1), "uppercase_acronym").otherwise("named_entity")
    )
    return F.when((F.size(shared) > 0) & (T.quality_text(query) != ""), F.struct(chosen.alias("anchor"), kind.alias("kind"), F.lit(source).alias("source")))


def query_anchor(query: Column, question: Column, information: Column) -> Column:
    """struct<anchor, kind, source>: the name, number, acronym or quotation of a query that its question, or else the information shown, has too."""
    return F.coalesce(_anchor(query, question, "question"), _anchor(query, information, "information"))


def visible_entity(results: DataFrame, request: str = "request") -> DataFrame:
    """request, entity, rank, title, method, fault of ranked search results (request, rank, title).

    Of cleaned titles that are names, the one of fewest words that another title holds as a
    phrase; else the first by rank.  Fault tells requests without one: all titles too
    generic, or none found.  A request's results are as many as a search shows.
    """
    results = results.withColumn("title", F.coalesce("title", F.lit("")))
    cleaned = T.search_title(F.col("title"))
    tokens = T.all_matches(F.col("cleaned"), T.JOINED_WORD)
    named = results.withColumn("cleaned", cleaned).withColumn("tokens", tokens)
    n, proper = F.size("tokens"), F.size(F.filter("tokens", lambda t: named_shape(t) | t.rlike(r"\p{Lu}") | t.rlike(r"[^\x00-\x7F]")))
    fault = (
        F.when((n == 0) | (n > MOST_ENTITY_TOKENS) | F.col("title").rlike("<[^>]*>"), "image_entity_not_found")
        .when((F.size(T.without(F.transform("tokens", lambda t: F.lower(t)), T.GENERIC_WORDS)) == 0) | (proper < F.when(n == 1, 1).otherwise(2)), "image_entity_too_generic")
    )
    named = named.withColumn("fault", fault).withColumn("line", T.quality_text(F.col("cleaned")))
    row = F.struct(F.size("tokens").alias("words"), "rank", F.lower("cleaned").alias("folded"), "cleaned", "title", "line")
    held = named.groupBy(request).agg(F.array_sort(F.collect_list(F.when(F.col("fault").isNull(), row))).alias("found"), F.max((F.col("fault") == "image_entity_too_generic").cast("int")).alias("generic"))
    shared = F.get(F.filter("found", lambda x: F.exists("found", lambda y: (y["title"] != x["title"]) & M.has_phrase(y["line"], x["line"]))), F.lit(0))
    first = F.get(F.array_sort(F.transform("found", lambda x: F.struct(x["rank"].alias("rank"), x["cleaned"].alias("cleaned"), x["title"].alias("title")))), F.lit(0))
    chosen = held.select(request, "generic", shared.alias("shared"), first.alias("first"))
    return chosen.select(
        request, F.coalesce("shared.cleaned", "first.cleaned", F.lit("")).alias("entity"), F.coalesce("shared.rank", "first.rank", F.lit(0)).alias("rank"),
        F.coalesce("shared.title", "first.title", F.lit("")).alias("title"),
        F.when(F.col("shared").isNotNull(), "shared_visible_title_phrase").when(F.col("first").isNotNull(), F.format_string("cleaned_top%d_title", "first.rank")).otherwise("none").alias("method"),
        F.when(F.col("first").isNull(), F.when(F.col("generic") == 1, "image_entity_too_generic").otherwise("image_entity_not_found")).alias("fault"),
    )
