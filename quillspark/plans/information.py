"""Queries of question relations, information blocks and tool texts (STR33, STR53, STR54, RET15 to RET19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import information as I
from quillspark.functions import relations as L
from quillspark.plans.declare import Table, query

#: Questions about a part; "{}" is its name. Some have several relations, and some none.
QUESTIONS = (
    "Who  is the ARCHITECT of {}?", "who was designed {}", "Who, they ask, designed {}?", "who built and painted {}", "Who was the photographer of {}", "which company\tmade {}", "what brand makes {}?",
    "Which organization operates {}", "who operates {}", "where was the maker of {} born", "Where is {}", "Where {} is located", "which country", "what state is {} in", "when was {} built", "What year was {} constructed",
    "when was {} released", "what year {} opened", "what is the nationality of {}", "what profession", "which genre is {}", "which is the species of {}", "how tall is {}", "what is the height of {}", "what capital",
    "which team", "what event is {} associated with", "what material is {} made of", "what is the material of {}", "who owns {}", "whowrote {}", "what is shown", "name {}", "", "when {} died or was born", "What does {} eat?", "how many {}", "made of what",
)
_ASKED = "SELECT p_partkey, trim(regexp_replace(lower(replace([" + ", ".join(f"'{q}'" for q in QUESTIONS) + f"][p_partkey % {len(QUESTIONS)} + 1], '{{}}', p_name)), '\\s+', ' ', 'g')) AS q FROM part"


def _asked(table: Table) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("p_partkey") % len(QUESTIONS) + 1).cast("int"))
    return table("part").select("p_partkey", F.replace(text, F.lit("{}"), F.col("p_name")).alias("question"))


@query(
    f"""WITH a AS ({_ASKED}), n AS (SELECT p_partkey, {L.case_sql("q", [(n, w) for n, _, w in L.RELATIONS])} AS name FROM a),
        r(name, relation, prefix) AS (VALUES {", ".join(f"('{n}', '{r}', '{L.prefix_of(r)}')" for n, r, _ in L.RELATIONS)})
        SELECT p_partkey, name, relation, prefix FROM n LEFT JOIN r USING (name)"""
)
def str33_question_relation(table: Table) -> DataFrame:
    """The first of 66 ordered relations that a question asks for."""
    return _asked(table).select("p_partkey", L.question_relation(F.col("question")).alias("r")).select("p_partkey", "r.name", "r.relation", "r.prefix")


@query(f"""WITH a AS ({_ASKED}) SELECT p_partkey, coalesce({L.case_sql("q", list(L.KINDS))}, 'unknown') AS kind FROM a""")
def str53_question_kind(table: Table) -> DataFrame:
    """The first of nine ordered kinds that a question is of."""
    return _asked(table).select("p_partkey", L.question_kind(F.trim(F.regexp_replace("question", r"\s+", " "))).alias("kind"))


@query(
    f"""WITH a AS ({_ASKED}) SELECT CASE WHEN {L.case_sql("q", [(n, w) for n, _, w in L.RELATIONS])} IS NULL THEN 'relation_not_found' ELSE 'evidence_asked' END AS stage, count(*) AS n FROM a GROUP BY 1"""
)
def flt23_relation_stage(table: Table) -> DataFrame:
    """How many questions stop at the relation and how many go on to ask for evidence."""
    found = _asked(table).select(L.question_relation(F.col("question"))["name"].alias("name"))
    return found.groupBy(F.when(F.col("name").isNull(), "relation_not_found").otherwise("evidence_asked").alias("stage")).agg(F.count(F.lit(1)).alias("n"))


def _items(kind: str) -> Column:
    turns = F.array_sort(F.collect_list(F.struct("turn", "text", F.concat_ws(":", "conv_id", "turn").alias("document_id"))))
    return I.information_block(kind, F.transform(turns, lambda t: F.struct(t["text"].alias("text"), t["document_id"].alias("document_id"))))


_LINE = r"trim(regexp_replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\s+', ' ', 'g'))"


@query(
    f"""WITH k(kind, header, lead) AS (VALUES {", ".join(f"('{k}', '{h}', '{'title: ' if k == 'image' else ''}')" for k, h in I.HEADERS.items())}),
        r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, {_LINE} AS line, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS plain FROM conversations)
        SELECT conv_id, kind, '<information>' || chr(10) || header || chr(10) || string_agg(rank || '. ' || lead || line || CASE kind WHEN 'text' THEN ' [cache_document=' || conv_id || ':' || turn || ']' ELSE '' END, chr(10) ORDER BY rank) || chr(10) || '</information>' AS block,
               kind AS read_kind, count(*) AS results, string_agg(plain, chr(10) ORDER BY rank) AS texts FROM r, k GROUP BY conv_id, kind, header, lead"""
)
def ret15_ret16_ret17_ret18_blocks(table: Table) -> DataFrame:
    """Turns as blocks of image, text and frozen results, and what is read back from them."""
    c = table("conversations").groupBy("conv_id").agg(*[_items(k).alias(k) for k in I.HEADERS])
    each = c.select("conv_id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("block")) for k in I.HEADERS])).alias("b")).select("conv_id", "b.kind", "b.block")
    read = each.withColumn("read", I.parsed_block(F.col("block")))
    return read.select("conv_id", "kind", "block", F.col("read.kind").alias("read_kind"), F.size("read.items").cast("long").alias("results"), F.array_join(F.transform("read.items", lambda x: x["text"]), "\n").alias("texts"))


@query(
    r"""WITH r AS (SELECT conv_id, conv_id % 7 AS bad, count(*) AS n, min(turn) AS first FROM conversations GROUP BY conv_id)
        SELECT conv_id, CASE bad WHEN 1 THEN 'no opening' WHEN 2 THEN 'unknown header' WHEN 3 THEN 'wrong rank' WHEN 4 THEN 'no document' WHEN 5 THEN 'no closing' WHEN 6 THEN 'no results' END AS fault,
               CASE bad WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN n + 2 WHEN 5 THEN n + 2 WHEN 6 THEN 3 END::INTEGER AS line FROM r"""
)
def ret18_block_faults(table: Table) -> DataFrame:
    """Blocks with known damage: each fault and its line."""
    c = table("conversations").groupBy("conv_id").agg(_items("text").alias("b"))
    bad, b = F.col("conv_id") % 7, F.col("b")
    broken = (
        F.when(bad == 1, F.substring(b, F.lit(15), F.length(b))).when(bad == 2, F.regexp_replace(b, r"\n\[Text Search", "\n[Other Search")).when(bad == 3, F.regexp_replace(b, r"\n1\. ", "\n7. "))
        .when(bad == 4, F.regexp_replace(b, r" \[cache_document=[^\]]*\]\n</information>$", "\n</information>")).when(bad == 5, F.regexp_replace(b, r"\n</information>$", ""))
        .when(bad == 6, F.lit(f"{I.OPEN}\n{I.HEADERS['text']}\n{I.CLOSE}")).otherwise(b)
    )
    return c.select("conv_id", I.parsed_block(broken).alias("p")).select("conv_id", "p.fault", "p.line")


@query(
    r"""WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rank, trim(regexp_replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\s+', ' ', 'g')) AS line FROM conversations)
        SELECT conv_id, rank, conv_id || ':' || turn AS document_id, line AS title FROM r WHERE conv_id % 3 <> 0"""
)
def ret19_text_results(table: Table) -> DataFrame:
    """The results that a state shows: a tool's text searches count, an image search or a user's own words do not."""
    c = table("conversations").groupBy("conv_id").agg(_items("text").alias("text"), _items("image").alias("image"))
    role = F.when(F.col("conv_id") % 3 == 0, "user").otherwise("tool")
    message = lambda r, c: F.struct(r.alias("role"), c.alias("content"))
    state = F.array(message(F.lit("tool"), F.col("image")), message(role, F.col("text")), message(F.lit("assistant"), F.lit("1. no result")))
    return c.select("conv_id", F.posexplode(I.text_results(state)).alias("at", "r")).select("conv_id", (F.col("at") + 1).cast("long").alias("rank"), "r.document_id", "r.title")


@query(
    r"""WITH w AS (SELECT p_partkey // 4 AS call, p_partkey, p_name FROM part WHERE p_partkey // 4 % 5 <> 2)
        SELECT call, row_number() OVER (PARTITION BY call ORDER BY first) AS nth, entity FROM (SELECT call, min(p_partkey) AS first, arg_min(p_name, p_partkey) AS entity FROM w WHERE p_partkey % 3 <> 2 GROUP BY call, lower(p_name))"""
)
def str54_identified_entities(table: Table) -> DataFrame:
    """Entities that successful image searches name in either of two ways, each once."""
    p, k = table("part"), F.col("p_partkey")
    text = F.when(k % 3 == 0, F.concat(F.lit("It identifies the query image as "), "p_name", F.lit(". Official sources agree"))).when(k % 3 == 1, F.concat(F.lit("File: "), "p_name", F.lit(" - Wikipedia, the free"))).otherwise(F.concat(F.lit("about "), "p_name"))
    results = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", text.alias("text")))), lambda x: x["text"])
    calls = p.groupBy(F.floor(k / 4).alias("call")).agg(results.alias("results"))
    call = F.struct(F.lit("image_search").alias("tool"), F.when(F.col("call") % 5 == 2, "error").otherwise("success").alias("status"), "results")
    found = calls.select("call", F.posexplode(I.identified_entities(F.array(call))).alias("at", "entity"))
    return found.select("call", (F.col("at") + 1).cast("long").alias("nth"), "entity")
