"""Queries of answer matching (MAT, leak and copy tests)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import equivalence as E
from quillspark.functions import matching as M
from quillspark.functions import text as T
from quillspark.operators import anchors as N
from quillspark.plans.declare import Table, query
from quillspark.plans.text import EVALUATION_SQL, WORD_SQL

PAIRS_SQL = "(SELECT b.item_id, b.text AS a, d.text AS t FROM benchmark b JOIN documents d ON d.doc_id = b.item_id)"


def _pairs(table: Table) -> DataFrame:
    return table("benchmark").select("item_id", F.col("text").alias("a")).join(table("documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("t")), "item_id")


@query(
    f"""SELECT c_custkey, (coalesce({EVALUATION_SQL("replace(c_name, '#', ' the ')")}, '') IN (coalesce({EVALUATION_SQL("c_name")}, ''), coalesce({EVALUATION_SQL("c_mktsegment")}, '')))::INT AS em FROM customer"""
)
def mat01_exact_match(table: Table) -> DataFrame:
    said = F.replace("c_name", F.lit("#"), F.lit(" the "))
    return table("customer").select("c_custkey", M.exact_match(said, F.array("c_name", "c_mktsegment")).alias("em"))


@query(
    f"""WITH p AS (SELECT item_id, regexp_extract_all(lower(a), '{WORD_SQL}') AS x, regexp_extract_all(lower(t), '{WORD_SQL}') AS y FROM {PAIRS_SQL}),
        c AS (SELECT item_id, len(x) AS nx, len(y) AS ny, list_sum(list_transform(list_intersect(list_distinct(x), list_distinct(y)),
              lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w))))) AS n FROM p)
        SELECT item_id, round(CASE WHEN nx = 0 OR ny = 0 OR coalesce(n, 0) = 0 THEN 0.0 ELSE 2.0 * n / (nx + ny) END, 9) AS f1 FROM c"""
)
def mat02_token_f1(table: Table) -> DataFrame:
    worded = _pairs(table).select("item_id", T.words(F.col("a")).alias("x"), T.words(F.col("t")).alias("y"))
    return worded.select("item_id", F.round(M.token_f1(F.col("x"), F.col("y")), 9).alias("f1"))


@query(
    f"""WITH n AS (SELECT p_partkey, string_split(coalesce({EVALUATION_SQL("p_name")}, ''), ' ') AS p, string_split(coalesce({EVALUATION_SQL("p_type")}, ''), ' ') AS q, string_split(coalesce({EVALUATION_SQL("p_name || ' ' || p_brand")}, ''), ' ') AS r FROM part),
        f AS (SELECT p_partkey, list_transform([q, r], lambda y: coalesce(2.0 * list_sum(list_transform(list_intersect(list_distinct(p), list_distinct(y)),
              lambda w: least(len(list_filter(p, lambda v: v = w)), len(list_filter(y, lambda v: v = w))))) / (len(p) + len(y)), 0.0)) AS fs FROM n)
        SELECT p_partkey, round(list_max(fs), 9) AS f1 FROM f"""
)
def mat03_best_alias_f1(table: Table) -> DataFrame:
    aliases = F.array(F.col("p_type"), F.concat_ws(" ", "p_name", "p_brand"))
    return table("part").select("p_partkey", F.round(M.best_alias_f1(F.col("p_name"), aliases), 9).alias("f1"))


@query(
    f"""SELECT item_id, contains(' ' || array_to_string(y, ' ') || ' ', ' ' || array_to_string(x, ' ') || ' ') AND len(x) > 0 AS supported, contains(array_to_string(y, ' '), array_to_string(x, ' ')) AND len(x) > 0 AS reachable
        FROM (SELECT item_id, regexp_extract_all(lower(a), '{WORD_SQL}') AS x, regexp_extract_all(lower(t), '{WORD_SQL}') AS y FROM {PAIRS_SQL})"""
)
def str25_str26_str27_str28_phrase_support(table: Table) -> DataFrame:
    x, y = T.words(F.col("a")), T.quality_text(F.col("t"))
    whole = F.array_join(x, " ")
    return _pairs(table).select("item_id", M.has_phrase(y, whole).alias("supported"), (F.contains(y, whole) & (whole != "")).alias("reachable"))


@query(
    f"""SELECT item_id, round(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_filter(q, lambda w: list_contains(c, w))) / len(q)::DOUBLE END, 9) AS ratio
        FROM (SELECT item_id, regexp_extract_all(lower(t), '{WORD_SQL}') AS q, regexp_extract_all(lower(a), '{WORD_SQL}') AS c0,
              list_filter(regexp_extract_all(lower(a), '{WORD_SQL}'), lambda w: NOT list_contains([{", ".join(f"'{w}'" for w in T.QUESTION_WORDS)}], w)) AS c FROM {PAIRS_SQL})"""
)
def flt10_copy_ratio(table: Table) -> DataFrame:
    return _pairs(table).select("item_id", F.round(M.copy_ratio(F.col("a"), F.col("t")), 9).alias("ratio"))


@query(
    f"""WITH p AS (SELECT item_id, list_distinct(regexp_extract_all(lower(a), '{WORD_SQL}')) AS x, list_distinct(regexp_extract_all(lower(t), '{WORD_SQL}')) AS y FROM {PAIRS_SQL})
        SELECT item_id, round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE, 9) AS similarity FROM p"""
)
def sim03_token_jaccard(table: Table) -> DataFrame:
    return _pairs(table).select("item_id", F.round(M.jaccard(F.array_distinct(T.words(F.col("a"))), F.array_distinct(T.words(F.col("t")))), 9).alias("similarity"))


@query(
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN true ELSE false END AS leaked FROM customer"""
)
def flt20_answer_leak(table: Table) -> DataFrame:
    asked = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("who is The "), "c_name", F.lit("?"))).otherwise(F.lit("who is it"))
    return table("customer").select("c_custkey", M.leaks_answer(asked, F.array("c_name")).alias("leaked"))


@query()
def mat04_mat05_num01_num08_answer_equivalence(table: Table) -> DataFrame:
    """Prices and sizes in other words and units against the plain ones."""
    p = table("part")
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat((F.col("p_size") * 1000).cast("string"), F.lit(" grams"))).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("the "), F.col("p_name"))).otherwise(F.lit("free"))
    gold = F.when(F.col("p_partkey") % 3 == 0, F.array(F.concat(F.col("p_size").cast("string"), F.lit(" kg")))).when(F.col("p_partkey") % 3 == 1, F.array("p_name")).otherwise(F.array(F.lit("no cost")))
    read = E.with_readings(p.select("p_partkey", said.alias("said"), gold.alias("gold")), F.col("said"), F.col("gold"))
    judged = E.judged(read, F.lit("how much"), "e").withColumn("signatures", F.array_join(E.signatures(F.col("_said")), "|"))
    return judged.select("p_partkey", "e.*", "signatures")


@query()
def mat06_mat07_mat08_support_match(table: Table) -> DataFrame:
    read = E.with_readings(_pairs(table), F.col("t"), F.transform(F.sentences("a"), lambda words: F.array_join(words, " ")))
    m = E.supported(F.col("_said"), F.col("_aliases"), F.lit(""))
    return read.select("item_id", m.alias("m")).select("item_id", "m.match_type", F.round("m.score", 9).alias("score"))


@query()
def str16_str19_str20_num02_num07_quantities(table: Table) -> DataFrame:
    return E.with_quantities(table("documents").select("doc_id", "text"), "text")


@query()
def str11_placed_tokens(table: Table) -> DataFrame:
    return N.with_placed_tokens(table("documents").select("doc_id", "text"), "text")


@query()
def str51_str52_query_anchors(table: Table) -> DataFrame:
    """What each benchmark item holds on to, in itself as the question or in the document of its number."""
    return _pairs(table).select("item_id", N.query_anchor(F.col("a"), F.col("a"), F.col("t")).alias("x")).select("item_id", "x.anchor", "x.kind", "x.source")


@query()
def str22_visible_entities(table: Table) -> DataFrame:
    """Turns of a conversation as ranked titles: the entity that they show."""
    results = table("conversations").select(F.col("conv_id").alias("request"), F.col("turn").alias("rank"), F.col("text").alias("title"))
    return N.visible_entity(results)
