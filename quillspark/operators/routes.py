"""Evidence decisions of routes: which records a text search, or an image search and then a text search, can serve, and what each of the others lacks.

All records are decided together: queries are columns, retrieval is one batch over all of
them, and a decision is the first rule that fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import matching as M
from quillspark.functions import text as T
from quillspark.functions.information import has_placeholder
from quillspark.functions.relations import question_relation
from quillspark.operators import anchors
from quillspark.operators import retrieval as R
from quillspark.operators.exchange import settled, skew_join
from quillspark.operators.gates import first_reason

#: Relations that a question may ask for, as (pattern, words that a query puts before the entity).
RELATIONS = (
    ("date", r"\b(when|what year|which year|what date)\b", "date of"), ("place", r"\b(where|which country|which city|what country|what city)\b", "location of"),
    ("person", r"\b(who|whom|whose)\b", "person behind"), ("number", r"\b(how many|how much|how tall|how long|how old)\b", "number of"), ("kind", r"\b(what type|what kind|which type|which kind)\b", "type of"),
)
APART = 100  # documents of a query that one search may look past
PLACEHOLDER = r"(?i)<image>|\[image\]|<img\b"


def supports(text: Column, aliases: Column) -> Column:
    """Whether a text states one of the answers as a phrase."""
    return F.coalesce(F.exists(aliases, lambda a: M.has_phrase(T.quality_text(text), T.quality_text(a))), F.lit(False))


def leaks_context(query: Column, visible: Column, hidden: Column, n: int = 4) -> Column:
    """Whether a query has a run of ``n`` words of a hidden text (array of strings) that no visible one (array) has."""
    words = T.words(query)
    runs = F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.array_join(F.slice(words, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))
    seen = lambda texts, run: F.exists(texts, lambda t: M.has_phrase(T.quality_text(t), run))
    return F.coalesce(F.exists(runs, lambda r: seen(hidden, r) & ~seen(visible, r)), F.lit(False))


def _tokens(text: Column) -> Column:
    return T.all_matches(F.lower(text), T.WORD)


def _hits(asked: DataFrame, corpus: DataFrame, k: int, without: DataFrame) -> DataFrame:
    """id, hits, others: the ``k`` best documents (array of struct<rank, doc_id, text>) of each query (id, query), and the same but for pairs (id, doc_id) in ``without``.

    One search gives both where no query has more than APART pairs: it goes on for so many ranks.
    """
    queries = asked.select("id", F.col("query").alias("text"))
    out = settled(without.select("id", "doc_id").distinct())
    most = out.groupBy("id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    best = settled(R.bm25_top(queries, corpus, _tokens, "id", "doc_id", k + (most if most <= APART else 0)).select("id", "doc_id", "score", "rank"))
    if most <= APART:
        others = R.top_k(skew_join(best.drop("rank"), out, ["id", "doc_id"], "left_anti"), "id", k, "doc_id")
    else:
        others = R.bm25_top(queries, corpus, _tokens, "id", "doc_id", k, without=out)
    told = lambda df, name: df.select("id", "rank", "doc_id", F.lit(name).alias("kind"))
    both = settled(told(best.where(F.col("rank") <= k), "hits").unionByName(told(others, "others")))
    wanted = F.broadcast(both) if both.limit(R.FEW + 1).count() <= R.FEW else both
    texts = skew_join(corpus.select("doc_id", "text"), wanted, ["doc_id"], "inner")
    of = lambda name: F.array_sort(F.collect_list(F.when(F.col("kind") == name, F.struct("rank", "doc_id", "text"))))
    some = lambda hits: F.when(F.size(hits) > 0, F.col(hits)).alias(hits)
    return texts.groupBy("id").agg(of("hits").alias("hits"), of("others").alias("others")).select("id", some("hits"), some("others"))


def _query_rules(faults: Column) -> list[tuple[str, Column]]:
    return [(name, F.array_contains(faults, name)) for name in ("empty_query", "query_too_short", "query_too_long")]


def text_route(records: DataFrame, titles: DataFrame, corpus: DataFrame, k: int = 3) -> DataFrame:
    """id, query, reason, hit_leave_one_out, documents of records (id, question, aliases).

    ``titles`` (id, title) are what the record's image search would show and a text search
    may not know; ``corpus`` has doc_id, source_id (the record a document comes from) and
    text.  Reasons in order: empty_query, query_too_short, query_too_long, answer_leak,
    unavailable_context_leak, evidence_miss; null for a record that the route serves.
    """
    hidden = titles.where(F.trim("title") != "").groupBy("id").agg(F.collect_set("title").alias("hidden"))
    asked = records.withColumn("query", T.bootstrap_query(F.col("question"))).join(hidden, "id", "left")
    leak = M.leaks_answer(F.col("query"), F.col("aliases"))
    context = leaks_context(F.col("query"), F.array("question"), F.coalesce("hidden", F.array().cast("array<string>")))
    early = first_reason(*_query_rules(T.query_faults(F.col("query"))), ("answer_leak", leak), ("unavailable_context_leak", context))
    asked = settled(asked.withColumn("early", early))
    open_ones = asked.where("early is null")
    own = skew_join(open_ones.select("id"), corpus.select(F.col("source_id").alias("id"), "doc_id"), ["id"], "inner")
    both = asked.join(_hits(open_ones, corpus, k, own), "id", "left")
    held = lambda hits: F.exists(hits, lambda h: supports(h["text"], F.col("aliases")))
    hit = F.coalesce(held(F.col("hits")), F.lit(False))
    reason = F.coalesce("early", F.when(~hit, "evidence_miss"))
    decided = both.withColumn("reason", reason)
    return decided.select("id", "query", "reason", F.when(F.col("reason").isNull(), F.coalesce(held(F.col("others")), F.lit(False))).alias("hit_leave_one_out"), F.when(F.col("reason").isNull(), F.transform("hits", lambda h: h["doc_id"])).alias("documents"))


def _asked_for(relations: tuple | None) -> tuple[Column, Column]:
    """struct<name, words> of what a question asks for, and the query that asks it of the entity."""
    if relations is None:
        found = question_relation(F.col("question"))
        named = F.when(found["name"].isNotNull(), F.struct(found["relation"].alias("name"), found["prefix"].alias("words")))
        return named, F.array_join(F.concat(F.split("found.words", " "), T.query_words(F.col("entity"))), " ")
    relation = F.coalesce(*[F.when(F.lower("question").rlike(p), F.struct(F.lit(n).alias("name"), F.lit(w).alias("words"))) for n, p, w in relations])
    return relation, F.concat_ws(" ", F.col("found.words"), F.col("entity"))


def image_text_route(records: DataFrame, results: DataFrame, corpus: DataFrame, k: int = 3, relations: tuple | None = RELATIONS) -> DataFrame:
    """id, entity, relation, query, reason, documents of records (id, question, aliases).

    ``results`` (id, rank, title, doc_id) are what the image search shows, ``corpus`` has
    doc_id and text.  The entity comes from the titles, the relation from the question: the
    first of ``relations`` (name, pattern, words) or, for None, of the ordered table of
    ``quillspark.functions.relations``, where a query of too few or too many words is an empty_query.
    Reasons in order: cache_miss, forbidden_visual_placeholder,
    answer_already_in_image_information, image_entity_not_found or image_entity_too_generic,
    relation_not_found, empty_query, query_too_short, query_too_long, answer_leak,
    text_evidence_only_image_context, text_evidence_miss, unavailable_context_leak; null for
    a record that the route serves.
    """
    shown = results.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "title"))).alias("shown"), F.collect_set("doc_id").alias("shown_ids"))
    entities = anchors.visible_entity(results.select(F.col("id").alias("request"), "rank", "title")).select(F.col("request").alias("id"), "entity", F.col("fault").alias("entity_fault"))
    held = records.join(shown, "id", "left").join(entities, "id", "left")
    relation, query = _asked_for(relations)
    held = held.withColumn("found", relation).withColumn("query", F.coalesce(query, F.lit("")))
    lines = F.array_join(F.transform("shown", lambda x: x["title"]), "\n")
    faults = T.query_faults(F.col("query"))
    rules = _query_rules(faults) if relations is not None else [("empty_query", F.size(faults) > 0)]
    early = first_reason(
        ("cache_miss", F.col("shown").isNull()), ("forbidden_visual_placeholder", lines.rlike(PLACEHOLDER) | has_placeholder(lines)), ("answer_already_in_image_information", supports(lines, F.col("aliases"))),
        ("image_entity_not_found", F.coalesce("entity_fault", F.lit("")) == "image_entity_not_found"), ("image_entity_too_generic", F.coalesce("entity_fault", F.lit("")) == "image_entity_too_generic"),
        ("relation_not_found", F.col("found").isNull()), *rules, ("answer_leak", M.leaks_answer(F.col("query"), F.col("aliases"))),
    )
    asked = settled(held.withColumn("lines", lines).withColumn("early", early))
    open_ones = asked.where("early is null")
    pairs = results.where(F.col("doc_id").isNotNull()).select("id", "doc_id")
    found = _hits(open_ones, corpus, k, pairs).withColumnsRenamed({"hits": "all_hits", "others": "hits"})
    both = asked.join(found, "id", "left")
    bearing = lambda hits: F.filter(F.coalesce(hits, F.array().cast(both.schema["hits"].dataType)), lambda h: supports(h["text"], F.col("aliases")))
    apart, together = bearing(F.col("hits")), bearing(F.col("all_hits"))
    context = F.col("early").isNull() & leaks_context(F.col("query"), F.array("question", "lines", "query"), F.transform("hits", lambda h: h["text"]))
    only = (F.size(together) > 0) & F.forall(together, lambda h: F.array_contains("shown_ids", h["doc_id"]))
    late = first_reason(("text_evidence_only_image_context", (F.size(apart) == 0) & only), ("text_evidence_miss", F.size(apart) == 0), ("unavailable_context_leak", context))
    decided = both.withColumn("reason", F.coalesce("early", late))
    return decided.select("id", "entity", F.col("found.name").alias("relation"), "query", "reason", F.when(F.col("reason").isNull(), F.transform(apart, lambda h: h["doc_id"])).alias("documents"))
