"""Queries of projections, predicates and gates (FLT)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import matching as M
from quillspark.functions import text as T
from quillspark.operators import gates as G
from quillspark.operators import retrieval as R
from quillspark.operators.exchange import settled, skew_join
from quillspark.plans.declare import Table, query
from quillspark.plans.text import QUERY_WORD_SQL, WORD_SQL, sql_list

URL_HOST = r"^https?://([^/?#]+)"


@query(
    r"""SELECT conv_id, list_filter(list(CASE WHEN trim(text) <> '' AND length(text) < 200 THEN turn END ORDER BY turn), lambda x: x IS NOT NULL) AS usable FROM conversations GROUP BY conv_id"""
)
def flt01_flt02_usable_results(table: Table) -> DataFrame:
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    kept = F.filter(turns, lambda x: (F.trim(x["text"]) != "") & (F.length(x["text"]) < 200))
    return table("conversations").groupBy("conv_id").agg(F.transform(kept, lambda x: x["turn"]).alias("usable"))


@query(
    r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/?#]+') THEN 'url' ELSE 'none' END AS kind, regexp_matches(regexp_extract(url, '^https?://([^/?#]+)', 1), '^(localhost|127\.|10\.|192\.168\.)') OR NOT contains(regexp_extract(url, '^https?://([^/?#]+)', 1), '.') AS private FROM pages"""
)
def flt03_flt35_url_kinds(table: Table) -> DataFrame:
    host = F.regexp_extract("url", URL_HOST, 1)
    private = host.rlike(r"^(localhost|127\.|10\.|192\.168\.)") | ~F.contains(host, F.lit("."))
    return table("pages").select("page_id", F.when(F.col("url").rlike(URL_HOST), "url").otherwise("none").alias("kind"), private.alias("private"))


_ANSWER_SQL = """SELECT doc_id, list_sort(list_distinct(list_filter([CASE WHEN n_chars < 200 THEN 'answer_unsupported' END, CASE WHEN lang <> 'en' THEN 'not_english' END,
    CASE WHEN contains(lower(text), 'opened') OR contains(lower(text), 'year') THEN 'external_fact' END], lambda x: x IS NOT NULL))) AS reasons FROM documents"""


def _answer_gate(table: Table) -> DataFrame:
    low = F.lower("text")
    outside = F.contains(low, F.lit("opened")) | F.contains(low, F.lit("year"))
    rules = [("answer_unsupported", F.col("n_chars") < 200), ("not_english", F.col("lang") != "en"), ("external_fact", outside)]
    return table("documents").select("doc_id", G.reasons(*rules).alias("reasons"))


@query(_ANSWER_SQL)
def flt05_flt40_reason_arrays(table: Table) -> DataFrame:
    return _answer_gate(table)


@query(
    f"""WITH q AS (SELECT b.item_id, regexp_extract_all(lower(b.text), '{WORD_SQL}') AS q, regexp_extract_all(lower(d.text), '{WORD_SQL}') AS v, b.text AS raw FROM benchmark b JOIN documents d ON d.doc_id = b.item_id),
        s AS (SELECT item_id, raw, q, list_filter(q, lambda w: NOT list_contains({sql_list(T.GENERIC_WORDS)}, w)) AS s, v FROM q)
        SELECT item_id, list_sort(list_filter([CASE WHEN len(s) = 0 THEN 'generic_query' END, CASE WHEN len(s) > 0 AND len(list_intersect(s, v)) = 0 THEN 'entity_not_visible' END,
               CASE WHEN len(list_intersect(q, {sql_list(T.VISUAL_WORDS)})) > 0 AND len(list_intersect(s, v)) = 0 THEN 'unresolvable_visual_reference' END, CASE WHEN contains(raw, '<') THEN 'strict_parser_invalid' END], lambda x: x IS NOT NULL)) AS reasons FROM s"""
)
def flt08_flt09_query_gate(table: Table) -> DataFrame:
    both = table("benchmark").join(table("documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("seen")), "item_id")
    worded = both.select("item_id", "text", T.words(F.col("text")).alias("q"), T.words(F.col("seen")).alias("v")).withColumn("s", T.without(F.col("q"), T.GENERIC_WORDS))
    shared = F.size(F.array_intersect("s", "v"))
    visual = F.arrays_overlap("q", F.array(*map(F.lit, T.VISUAL_WORDS)))
    rules = [
        ("generic_query", F.size("s") == 0), ("entity_not_visible", (F.size("s") > 0) & (shared == 0)),
        ("unresolvable_visual_reference", visual & (shared == 0)), ("strict_parser_invalid", F.contains("text", F.lit("<"))),
    ]
    return worded.select("item_id", G.reasons(*rules).alias("reasons"))


@query()
def flt07_text_search_faults(table: Table) -> DataFrame:
    """Benchmark items as queries before the document of their number, with the three documents that BM25 finds as evidence."""
    best = R.bm25_top(table("benchmark"), table("documents"), lambda t: T.all_matches(F.lower(t), "[a-z0-9]+"), "item_id", "doc_id", 3)
    texts = skew_join(best.select("item_id", "doc_id"), table("documents").select("doc_id", F.col("text").alias("found")), ["doc_id"], "inner")
    results = texts.groupBy("item_id").agg(F.collect_list(F.struct(F.col("doc_id").cast("string").alias("document_id"), F.col("found").alias("text"))).alias("results"))
    seen = table("documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("seen"), F.array("source").alias("answers"))
    asked = table("benchmark").join(seen, "item_id").join(results, "item_id", "left")
    own = F.array(F.col("item_id").cast("string"))
    faults = G.text_search_faults(F.col("text"), F.col("seen"), F.col("text"), F.col("answers"), F.col("results"), own)
    return asked.select("item_id", F.array_join(faults, ",").alias("faults"))


@query("SELECT o_orderkey, len(list_filter(list_distinct(list(l_suppkey)), lambda s: NOT list_contains([1, 2, 3], s))) = 0 AS inside FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def flt11_same_context_only(table: Table) -> DataFrame:
    ids = F.collect_set("l_suppkey")
    context = F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)])
    return table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(((F.size(F.array_except(ids, context)) == 0) & (F.size(ids) > 0)).alias("inside"))


@query(
    """SELECT doc_id, list_filter(['answer', 'image_search', 'text_search'], lambda a: CASE a WHEN 'answer' THEN n_chars > 300 WHEN 'image_search' THEN doc_id % 2 = 0 ELSE lang = 'en' END) AS valid,
              CASE doc_id % 3 WHEN 0 THEN n_chars > 300 WHEN 1 THEN doc_id % 2 = 0 ELSE lang = 'en' END AS target_valid FROM documents"""
)
def flt12_flt13_flt14_flt16_flt17_valid_actions(table: Table) -> DataFrame:
    checks = F.create_map(F.lit("answer"), F.col("n_chars") > 300, F.lit("image_search"), F.col("doc_id") % 2 == 0, F.lit("text_search"), F.col("lang") == "en")
    valid = F.array_sort(F.map_keys(F.map_filter(checks, lambda k, v: v)))
    target = F.element_at(F.array(*map(F.lit, ("answer", "image_search", "text_search"))), (F.col("doc_id") % 3 + 1).cast("int"))
    return table("documents").select("doc_id", valid.alias("valid"), F.array_contains(valid, target).alias("target_valid"))


@query(
    """SELECT conv_id, list_sort(list_distinct(flatten(list(r)))) AS reasons FROM (SELECT conv_id, list_filter([CASE WHEN length(text) < 80 THEN 'short' END, CASE WHEN role = 'system' THEN 'system_turn' END], lambda x: x IS NOT NULL) AS r FROM conversations) GROUP BY conv_id"""
)
def flt15_trajectory_gate(table: Table) -> DataFrame:
    turns = table("conversations").select("conv_id", G.reasons(("short", F.length("text") < 80), ("system_turn", F.col("role") == "system")).alias("r"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("r")))).alias("reasons"))


@query(
    """SELECT doc_id, CASE WHEN n_chars < 200 THEN 'rejected' WHEN lang <> 'en' THEN 'quarantined' ELSE 'accepted' END AS decision FROM documents"""
)
def flt18_flt34_three_way_route(table: Table) -> DataFrame:
    return G.routed(table("documents").select("doc_id", "n_chars", "lang"), F.col("n_chars") < 200, F.col("lang") != "en").select("doc_id", "decision")


@query(
    f"""SELECT item_id, list_filter([CASE WHEN trim(text) = '' THEN 'empty_query' END, CASE WHEN regexp_matches(text, '<[^>]*>') THEN 'query_contains_xml' END, CASE WHEN n < 3 THEN 'query_too_short' END, CASE WHEN n > 32 THEN 'query_too_long' END], lambda x: x IS NOT NULL) AS faults
        FROM (SELECT item_id, text, len(regexp_extract_all(text, '{QUERY_WORD_SQL}')) AS n FROM benchmark)"""
)
def flt19_query_faults(table: Table) -> DataFrame:
    return table("benchmark").select("item_id", T.query_faults(F.col("text")).alias("faults"))


@query(
    f"""WITH d AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) AS s FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM documents) WHERE len(w) >= 4),
        b AS (SELECT item_id, list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) AS s FROM (SELECT item_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM benchmark) WHERE len(w) >= 4),
        x AS (SELECT item_id, unnest(s) AS g FROM b), y AS (SELECT doc_id, unnest(s) AS g FROM d)
        SELECT item_id, doc_id, count(*) AS shared FROM x JOIN y USING (g) GROUP BY ALL HAVING count(*) >= 3"""
)
def flt21_context_leak(table: Table) -> DataFrame:
    """Runs of four words that a benchmark item shares with a document, as hashes; only runs that some item has are carried."""
    worded = lambda t, key: settled(table(t).select(key, F.transform(T.words(F.col("text")), lambda w: F.xxhash64(w)).alias("w")).where(F.size("w") >= 4))
    grams = lambda t, key: worded(t, key).select(key, F.explode(F.array_distinct(M.hashed_shingles(F.col("w"), 4))).alias("g"))
    asked = settled(grams("benchmark", "item_id"))
    met = skew_join(grams("documents", "doc_id"), asked.select("g").distinct(), ["g"], "left_semi")
    return skew_join(met, asked, ["g"], "inner").groupBy("item_id", "doc_id").agg(F.count("*").alias("shared")).where("shared >= 3")


@query(
    """SELECT doc_id, CASE WHEN n_chars < 100 THEN 'too_short' WHEN lang NOT IN ('en', 'fr') THEN 'wrong_language' WHEN source = 'src0' THEN 'same_source' WHEN n_chars > 5000 THEN 'too_long' END AS reason FROM documents"""
)
def flt28_first_failure(table: Table) -> DataFrame:
    rules = [("too_short", F.col("n_chars") < 100), ("wrong_language", ~F.col("lang").isin("en", "fr")), ("same_source", F.col("source") == "src0"), ("too_long", F.col("n_chars") > 5000)]
    return table("documents").select("doc_id", G.first_reason(*rules).alias("reason"))


@query("SELECT conv_id, list(role ORDER BY turn) = ['user', 'assistant', 'user', 'assistant'] AS grammatical FROM conversations GROUP BY conv_id")
def flt26_step_grammar(table: Table) -> DataFrame:
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    expected = F.array(*map(F.lit, ("user", "assistant", "user", "assistant")))
    return table("conversations").groupBy("conv_id").agg((roles == expected).alias("grammatical"))


@query(
    """SELECT 'empty_text' AS rule, count(*) FILTER (WHERE trim(text) = '') AS violations FROM documents UNION ALL SELECT 'long_text', count(*) FILTER (WHERE n_chars > 5000) FROM documents UNION ALL
       SELECT 'wrong_length', count(*) FILTER (WHERE n_chars <> length(text)) FROM documents UNION ALL SELECT 'unknown_language', count(*) FILTER (WHERE lang NOT IN ('en', 'fr', 'de', 'es')) FROM documents"""
)
def flt27_cmp14_dataset_audit(table: Table) -> DataFrame:
    rules = {"empty_text": F.trim("text") == "", "long_text": F.col("n_chars") > 5000, "wrong_length": F.col("n_chars") != F.length("text"), "unknown_language": ~F.col("lang").isin("en", "fr", "de", "es")}
    return G.violations(table("documents"), rules)


@query("SELECT doc_id, contains(lower(text), 'the') AND n_chars > 100 AS reachable, list_filter(CASE WHEN lang = 'en' THEN ['a', 'b'] ELSE ['b'] END, lambda x: list_contains(CASE WHEN n_chars > 500 THEN ['a', 'c'] ELSE ['b', 'c'] END, x)) AS eligible FROM documents")
def flt30_flt31_cmp11_eligibility(table: Table) -> DataFrame:
    lits = lambda *xs: F.array(*map(F.lit, xs))
    declared, computed = F.when(F.col("lang") == "en", lits("a", "b")).otherwise(lits("b")), F.when(F.col("n_chars") > 500, lits("a", "c")).otherwise(lits("b", "c"))
    reach = F.contains(F.lower("text"), F.lit("the")) & (F.col("n_chars") > 100)
    return table("documents").select("doc_id", reach.alias("reachable"), F.array_intersect(declared, computed).alias("eligible"))


@query("SELECT p_partkey, len(list_filter(string_split(lower(p_name), ' '), lambda w: NOT list_contains(string_split(lower(p_name || ' ' || p_type), ' '), w))) = 0 AS covered, length(p_name) >= 8 AND regexp_matches(p_name, '[a-z]') AND NOT contains(p_name, 'cookie') AS usable FROM part")
def flt32_flt36_token_cover(table: Table) -> DataFrame:
    name, all_words = F.split(F.lower("p_name"), " "), F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
    usable = (F.length("p_name") >= 8) & F.col("p_name").rlike("[a-z]") & ~F.contains("p_name", F.lit("cookie"))
    return table("part").select("p_partkey", (F.size(F.array_except(name, all_words)) == 0).alias("covered"), usable.alias("usable"))


@query("SELECT p_partkey, unnest(string_split(p_type, ' ')) AS word FROM part WHERE p_size > 20")
def flt33_filter_and_explode(table: Table) -> DataFrame:
    return table("part").where("p_size > 20").select("p_partkey", F.explode(F.split("p_type", " ")).alias("word"))


@query(
    """SELECT avg(toxic) <= 0.5 AS toxic_low, avg(quality) >= 0.3 AS quality_high, avg(toxic) <= 0.5 AND avg(quality) >= 0.3 AS passed FROM labels"""
)
def flt37_flt38_cmp31_metric_gate(table: Table) -> DataFrame:
    m = table("labels").agg(F.avg("toxic").alias("toxic"), F.avg("quality").alias("quality"))
    checks = G.gate({"toxic": F.col("toxic"), "quality": F.col("quality")}, {"toxic": ("max", 0.5), "quality": ("min", 0.3)})
    return m.select(checks["toxic"].alias("toxic_low"), checks["quality"].alias("quality_high"), G.passed(checks).alias("passed"))


@query("SELECT d.doc_id, d.lang = 'en' AND l.quality = 1 AS approved FROM documents d JOIN labels l USING (doc_id)")
def flt39_cmp45_approval_map(table: Table) -> DataFrame:
    return table("documents").select("doc_id", "lang").join(table("labels"), "doc_id").select("doc_id", ((F.col("lang") == "en") & (F.col("quality") == 1)).alias("approved"))


@query(
    f"""SELECT item_id, n = 0 AS empty, contains(text, '...') OR contains(text, '…') AS ellipsis, n < 3 AS short, len(list_filter(w, lambda x: list_contains({sql_list(T.GENERIC_WORDS)}, x))) = n AS generic FROM (SELECT item_id, text, regexp_extract_all(lower(text), '{WORD_SQL}') AS w, len(regexp_extract_all(lower(text), '{WORD_SQL}')) AS n FROM benchmark)"""
)
def flt41_flt45_query_quality(table: Table) -> DataFrame:
    b = table("benchmark").select("item_id", "text", T.words(F.col("text")).alias("w"))
    dots = F.contains("text", F.lit("...")) | F.contains("text", F.lit("…"))
    return b.select("item_id", (F.size("w") == 0).alias("empty"), dots.alias("ellipsis"), (F.size("w") < 3).alias("short"), (F.size(T.without(F.col("w"), T.GENERIC_WORDS)) == 0).alias("generic"))


@query(
    """WITH g AS (SELECT user_id, list(event_type ORDER BY ts, event_id) AS t FROM events GROUP BY user_id) SELECT user_id, len(t) <> len(list_distinct(t)) AS repeats, list_contains(t[1:3], 'purchase') AS copied FROM g"""
)
def repeats_and_first_events(table: Table) -> DataFrame:
    t = F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"])
    return table("events").groupBy("user_id").agg(t.alias("t")).select("user_id", (F.size("t") != F.size(F.array_distinct("t"))).alias("repeats"), F.array_contains(F.slice("t", 1, 3), "purchase").alias("copied"))


@query("SELECT label, count(*) FILTER (WHERE vec_id % 2 = 0) > count(*) FILTER (WHERE vec_id % 2 = 1) AS suspect FROM embeddings GROUP BY label")
def flt46_label_provenance(table: Table) -> DataFrame:
    return table("embeddings").groupBy("label").agg((F.count_if(F.col("vec_id") % 2 == 0) > F.count_if(F.col("vec_id") % 2 == 1)).alias("suspect"))


@query("SELECT l_orderkey, count(*) = count(DISTINCT l_linenumber) AND count(*) >= 2 AS whole FROM lineitem GROUP BY l_orderkey")
def flt47_win17_group_contract(table: Table) -> DataFrame:
    return table("lineitem").groupBy("l_orderkey").agg(((F.count("*") == F.count_distinct("l_linenumber")) & (F.count("*") >= 2)).alias("whole"))


@query("SELECT count(*) = count(DISTINCT o_orderkey) AS unique_ids, count(*) > 0 AS filled, count(*) FILTER (WHERE o_custkey IS NULL) = 0 AS complete FROM orders")
def flt48_src32_src34_cmp39_cmp41_cmp43_reuse_checks(table: Table) -> DataFrame:
    o = table("orders")
    return o.agg((F.count("*") == F.count_distinct("o_orderkey")).alias("unique_ids"), (F.count("*") > 0).alias("filled"), (F.count_if(F.col("o_custkey").isNull()) == 0).alias("complete"))
