"""Validation gates: each rule is a column, failed rules are an array of reasons, and no reason means accepted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import matching as M
from quillspark.functions import text as T
from quillspark.operators import anchors


def reasons(*rules: tuple[str, Column]) -> Column:
    """Sorted distinct names of the rules (name, failed) that fail; a null test fails nothing."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in rules]))))


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The first rule, in their order, that fails; null if none does."""
    return F.coalesce(*[F.when(failed, F.lit(name)) for name, failed in rules])


def routed(df: DataFrame, rejected: Column, quarantined: Column) -> DataFrame:
    """``df`` with its decision: rejected before quarantined before accepted."""
    return df.withColumn("decision", F.when(rejected, "rejected").when(quarantined, "quarantined").otherwise("accepted"))


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, violations: how many rows break each rule, all counted in one pass."""
    counts = df.agg(*[F.count_if(broken).alias(name) for name, broken in rules.items()])
    return counts.select(F.explode(F.create_map(*[x for n in rules for x in (F.lit(n), F.col(n))])).alias("rule", "violations"))


def gate(row: dict[str, Column], thresholds: dict[str, tuple[str, float]]) -> Column:
    """A map from each threshold's name to whether its metric holds it ("min" or "max")."""
    checks = [(F.lit(k), row[k] >= v if side == "min" else row[k] <= v) for k, (side, v) in thresholds.items()]
    return F.create_map(*[x for pair in checks for x in pair])


def passed(checks: Column) -> Column:
    return F.forall(F.map_values(checks), lambda x: x)


# Words and phrases by which a query points at a picture that a text search cannot see.
DEICTIC = ("this", "that", "these", "those")
IMAGE_CONTAINERS = ("image", "photo", "picture", "logo", "emblem")
POINTING_PHRASES = ("name of", "breed of", "breed is", "type of", "company represented by", "represented by")


def points_at_picture(query: Column, anchored: Column) -> Column:
    """Whether a query without an anchor of its own means something only its picture shows."""
    line = T.quality_text(query)
    return ~anchored & (F.arrays_overlap(T.words(query), F.array(*map(F.lit, (*DEICTIC, *IMAGE_CONTAINERS)))) | reduce(Column.__or__, [M.has_phrase(line, F.lit(p)) for p in POINTING_PHRASES]))


def text_search_faults(query: Column, visible: Column, question: Column, aliases: Column, results: Column, own_ids: Column, most_copied: float = 0.85) -> Column:
    """Sorted reasons for which a text search is no valid action; none for a valid one.

    ``results`` is an array of struct<document_id, text>; evidence must bear an answer, and
    not come from the documents ``own_ids`` alone.  Entities are content words of the query
    that the visible text names.
    """
    words, content, seen = T.words(query), F.array_distinct(T.content_words(query)), T.words(visible)
    entities = F.array_intersect(anchors.entity_words(query), anchors.entity_words(visible))
    nothing, unnamed = F.size(content) == 0, F.size(entities) == 0
    pointing = points_at_picture(query, ~unnamed)
    bearing = F.filter(results, lambda r: M.answer_bearing(r["text"], aliases))
    only_own = F.forall(bearing, lambda r: F.array_contains(own_ids, r["document_id"]))
    reachable = F.coalesce(F.size(bearing) > 0, F.lit(False))
    return reasons(
        ("strict_parser_invalid", query.rlike("[<>]")), ("query_answer_leak", M.leaks_answer(query, aliases)),
        ("entity_not_visible", ~nothing & ~F.arrays_overlap(content, seen)), ("missing_visible_entity", unnamed),
        ("generic_query", (F.trim(query) == "") | nothing | (F.size(T.without(words, T.GENERIC_WORDS)) == 0) | (unnamed & pointing)),
        ("unresolvable_visual_reference", pointing), ("question_copy_query", (M.copy_ratio(question, query) > most_copied) & unnamed),
        ("unreachable_evidence", ~reachable), ("same_context_evidence_only", reachable & only_own),
    )


def tainted_out(accepted: DataFrame, rejected: DataFrame, key: str) -> DataFrame:
    """Accepted rows whose key no rejected row has."""
    return accepted.join(rejected.select(key).distinct(), key, "left_anti")


def all_of(*tests: Column) -> Column:
    return reduce(Column.__and__, tests)
