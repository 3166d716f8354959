"""Queries of the text kernels (STR)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import actions as A
from quillspark.functions import hashing as H
from quillspark.functions import matching as M
from quillspark.functions import text as T
from quillspark.plans.declare import Table, query


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


WORD_SQL = r"[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*"
QUERY_WORD_SQL = r"[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)?"
PUNCTUATION_SQL = "'" + T.ASCII_PUNCTUATION.replace("'", "''") + "'"
COLLAPSE = lambda x: rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"
PROTOCOL_SQL = lambda x: rf"coalesce(array_to_string(list_filter(string_split_regex(translate(lower({x}), {PUNCTUATION_SQL}, ''), '\s+'), lambda t: t NOT IN ('', 'a', 'an', 'the')), ' '), '')"
NUMBERS_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.NUMBER_WORDS.items()) + "}"
EVALUATION_SQL = lambda x: (
    rf"list_aggregate(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(trim(lower({x})), '(\d),(\d)', '\1\2', 'g'), '(\d),(\d)', '\1\2', 'g'), '[[:punct:]“”‘’–—…]', ' ', 'g'), '\s+'),"
    rf" lambda t: t <> '' AND NOT list_contains({sql_list(T.ARTICLES)}, t)), lambda t: coalesce({NUMBERS_SQL}[t], t)), 'string_agg', ' ')"
)


@query(f"SELECT doc_id, {PROTOCOL_SQL('text')} AS normal FROM documents")
def str01_protocol_answer(table: Table) -> DataFrame:
    return table("documents").select("doc_id", T.protocol_answer(F.col("text")).alias("normal"))


@query(f"SELECT doc_id, coalesce({EVALUATION_SQL('text')}, '') AS normal FROM documents")
def str02_evaluation_answer(table: Table) -> DataFrame:
    return table("documents").select("doc_id", T.evaluation_answer(F.col("text"), dates=False).alias("normal"))


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y %m %d') AS normal FROM orders
       WHERE o_orderkey % 6 <> 5 UNION ALL SELECT o_orderkey, 'on order ' || o_orderkey FROM orders WHERE o_orderkey % 6 = 5"""
)
def str03_normal_date(table: Table) -> DataFrame:
    o = table("orders")
    written = [F.date_format("o_orderdate", f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "MMMM d, yyyy", "MMM d yyyy", "d MMMM yyyy")]
    text = F.when(F.col("o_orderkey") % 6 == 5, F.concat(F.lit("on order "), "o_orderkey")).otherwise(F.element_at(F.array(*written), (F.col("o_orderkey") % 6 + 1).cast("int")))
    return o.select("o_orderkey", T.normal_date(text).alias("normal"))


@query(f"SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '{WORD_SQL}'), ' ') AS normal, len(regexp_extract_all(lower(text), '{WORD_SQL}'))::INT AS n FROM documents")
def str04_str05_quality_words(table: Table) -> DataFrame:
    return table("documents").select("doc_id", T.quality_text(F.col("text")).alias("normal"), F.size(T.words(F.col("text"))).alias("n"))


@query(
    f"""SELECT doc_id, array_to_string(w, ' ') AS content, len(w)::INT AS n FROM (
          SELECT doc_id, list_filter(regexp_extract_all(lower(text), '{WORD_SQL}'), lambda t: NOT list_contains({sql_list(T.GENERIC_WORDS)}, t)) AS w FROM documents)"""
)
def str06_content_words(table: Table) -> DataFrame:
    w = T.content_words(F.col("text"))
    return table("documents").select("doc_id", F.array_join(w, " ").alias("content"), F.size(w).alias("n"))


@query(f"SELECT item_id, array_to_string(regexp_extract_all(text, '{QUERY_WORD_SQL}'), ' ') AS words FROM benchmark")
def str07_query_words(table: Table) -> DataFrame:
    return table("benchmark").select("item_id", F.array_join(T.query_words(F.col("text")), " ").alias("words"))


@query(
    rf"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda t: NOT list_contains({sql_list(T.CONTEXT_STOP_WORDS)}, t)), ' ') AS words FROM documents"""
)
def str08_context_words(table: Table) -> DataFrame:
    return table("documents").select("doc_id", F.array_join(T.context_words(F.col("text")), " ").alias("words"))


@query(r"SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ') AS key FROM benchmark")
def str09_question_key(table: Table) -> DataFrame:
    return table("benchmark").select("item_id", T.question_key(F.col("text")).alias("key"))


@query(f"SELECT conv_id, turn, {COLLAPSE('lower(text)')} AS key, {COLLAPSE('text')} AS clean, rtrim(left({COLLAPSE('text')}, 80)) AS short FROM conversations")
def str10_str14_str35_ret21_clean_text(table: Table) -> DataFrame:
    t = F.col("text")
    return table("conversations").select("conv_id", "turn", T.exact_key(t).alias("key"), T.collapsed(t).alias("clean"), T.shortened(t, 80).alias("short"))


@query(
    r"""SELECT item_id, array_to_string(list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda t:
            CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN left(t, length(t) - 3) || 'y'
                 WHEN t LIKE '%s' AND length(t) > 3 AND NOT regexp_matches(t, '(ss|us|is)$') THEN left(t, length(t) - 1) ELSE t END), ' ') AS singular FROM benchmark"""
)
def str17_singular_words(table: Table) -> DataFrame:
    return table("benchmark").select("item_id", F.array_join(T.singular_words(T.all_matches(F.lower("text"), T.WORD)), " ").alias("singular"))


@query(
    r"""SELECT c_custkey, regexp_replace(trim(regexp_replace(t, '^(?:grand duke|duke|king|queen|sir|dr|professor) ', '')), '\s+of\s+(?:the\s+)?[a-z][a-z\s-]+$', '') AS core
        FROM (SELECT c_custkey, ['duke ', 'queen ', 'dr ', ''][c_custkey % 4 + 1] || 'ann ' || lower(replace(c_name, '#', ' ')) || ['', ' of the hill', ' of kent'][c_custkey % 3 + 1] AS t FROM customer)"""
)
def str18_person_core(table: Table) -> DataFrame:
    pick = lambda xs, n: F.element_at(F.array(*map(F.lit, xs)), (F.col("c_custkey") % n + 1).cast("int"))
    name = F.concat(pick(["duke ", "queen ", "dr ", ""], 4), F.lit("ann "), F.lower(F.translate("c_name", "#", " ")), pick(["", " of the hill", " of kent"], 3))
    return table("customer").select("c_custkey", T.person_core(name).alias("core"))


@query(
    r"""SELECT p_partkey, trim(string_split(p_name || CASE WHEN p_partkey % 2 = 0 THEN ' - ' || p_brand ELSE ' | ' || p_type END, CASE WHEN p_partkey % 2 = 0 THEN ' - ' ELSE ' | ' END)[1]) AS title FROM part"""
)
def str21_search_title(table: Table) -> DataFrame:
    tail = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit(" - "), "p_brand")).otherwise(F.concat(F.lit(" | "), "p_type"))
    return table("part").select("p_partkey", T.search_title(F.concat("p_name", tail)).alias("title"))


@query(
    rf"""SELECT item_id, w AS width, array_to_string(regexp_extract_all(text, '{QUERY_WORD_SQL}')[1:w], ' ') AS entity
         FROM benchmark, (SELECT unnest([14, 10, 6]) AS w)"""
)
def str24_entity_windows(table: Table) -> DataFrame:
    b = table("benchmark").withColumn("w", T.query_words(F.col("text"))).withColumn("width", F.explode(F.array(F.lit(14), F.lit(10), F.lit(6))))
    return b.select("item_id", "width", F.array_join(F.slice("w", F.lit(1), F.col("width")), " ").alias("entity"))


_SHORT = tuple("what which who whom whose where when why how am are can could did do does is was were would this that".split())


@query(
    rf"""WITH t AS (SELECT item_id, list_transform(regexp_extract_all(regexp_replace(text, '<[^>]*>', ' ', 'g'), '{QUERY_WORD_SQL}'), lambda x: lower(x)) AS w FROM benchmark),
         d AS (SELECT item_id, list_filter(list_filter(w, lambda x, i: list_position(w, x) = i), lambda x: NOT list_contains({sql_list(_SHORT)}, x)) AS w FROM t)
         SELECT item_id, array_to_string(w[1:32], ' ') AS query, len(w[1:32])::INT AS n FROM d WHERE len(w) >= 3"""
)
def str31_bootstrap_query(table: Table) -> DataFrame:
    q = table("benchmark").select("item_id", T.bootstrap_query(F.col("text")).alias("query"))
    return q.withColumn("n", F.size(F.split("query", " "))).where("n >= 3")


@query(
    r"""SELECT item_id, CASE WHEN regexp_matches(q, '\bwhen\b|\byear\b') THEN 'date' WHEN regexp_matches(q, '\bwhere\b') THEN 'place'
               WHEN regexp_matches(q, '\bwho\b') THEN 'person' WHEN regexp_matches(q, '\bhow (many|much)\b') THEN 'quantity' WHEN regexp_matches(q, '\bthe\b') THEN 'entity' END AS relation
        FROM (SELECT item_id, lower(text) AS q FROM benchmark)"""
)
def str33_str53_question_relation(table: Table) -> DataFrame:
    rules = [(r"\bwhen\b|\byear\b", "date"), (r"\bwhere\b", "place"), (r"\bwho\b", "person"), (r"\bhow (many|much)\b", "quantity"), (r"\bthe\b", "entity")]
    return table("benchmark").select("item_id", A.first_rule(F.lower("text"), rules).alias("relation"))


@query()
def str34_html_text(table: Table) -> DataFrame:
    return table("pages").select("page_id", T.html_lines(F.col("html")).alias("text"))


@query(
    r"""WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS s, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) AS h,
                          regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '\?([^#]*)', 1) AS q FROM pages),
        k AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|gclid|fbclid|msclkid)(=|$)'))) AS kept FROM u)
        SELECT page_id, s || '://' || CASE WHEN s = 'http' THEN regexp_replace(h, ':80$', '') ELSE regexp_replace(h, ':443$', '') END
               || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM k"""
)
def str36_canonical_url(table: Table) -> DataFrame:
    return table("pages").select("page_id", T.canonical_url(F.col("url")).alias("url"))


@query(r"SELECT page_id, replace(string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1], '_', ' ') AS title FROM pages")
def str38_url_title(table: Table) -> DataFrame:
    return table("pages").select("page_id", T.url_title(F.col("url")).alias("title"))


@query("SELECT item_id, sha256('{\"query\":\"' || item_id || '\",\"version\":\"v1\"}') AS key FROM benchmark")
def str39_str40_stable_digest(table: Table) -> DataFrame:
    return table("benchmark").select("item_id", F.sha2(F.to_json(F.struct(F.col("item_id").cast("string").alias("query"), F.lit("v1").alias("version"))), 256).alias("key"))


@query(
    """SELECT p_partkey, array_to_string(CASE p_partkey % 3 WHEN 0 THEN [p_name, p_brand] WHEN 1 THEN [p_name] ELSE [] END, '|') AS answers FROM part"""
)
def str42_candidate_answers(table: Table) -> DataFrame:
    p = table("part")
    value = F.when(F.col("p_partkey") % 3 == 0, F.to_json(F.array("p_name", "p_brand"))).when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise("  ")
    return p.select("p_partkey", F.array_join(T.candidate_answers(value), "|").alias("answers"))


@query("SELECT p_partkey, list_transform(string_split(p_name || ' | ' || p_brand, ' | '), lambda x: trim(x)) AS parts FROM part")
def str43_str45_piped_list(table: Table) -> DataFrame:
    piped = F.concat_ws(" | ", "p_name", "p_brand")
    return table("part").select("p_partkey", F.transform(F.split(piped, r" \| "), lambda x: F.trim(x)).alias("parts"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.key'), json_extract_string(props, '$.k')) AS field FROM events")
def str44_field_alternatives(table: Table) -> DataFrame:
    return table("events").select("event_id", F.coalesce(F.get_json_object("props", "$.key"), F.get_json_object("props", "$.k")).alias("field"))


@query(
    """SELECT event_id, '{"k":' || CASE WHEN event_id % 2 = 0 THEN '"[redacted]"' ELSE json_extract_string(props, '$.k') END || '}' AS safe FROM events"""
)
def str41_redacted_fields(table: Table) -> DataFrame:
    return table("events").select("event_id", A.redacted(F.col("props"), F.when(F.col("event_id") % 2 == 0, "k").otherwise("token")).alias("safe"))


_ACTION_SQL = r"""
    WITH forms AS (
        SELECT conv_id, turn, CASE (conv_id + turn) % 9
            WHEN 0 THEN '<reason>r</reason><answer>' || t || '</answer>' WHEN 1 THEN '<reason>r</reason> <text_search>' || t || '</text_search>'
            WHEN 2 THEN '<reason>r</reason><search><img></search>' WHEN 3 THEN '' WHEN 4 THEN '<answer>' || t || '</answer>'
            WHEN 5 THEN '<reason>r</reason><answer> </answer>' WHEN 6 THEN '<reason>r</reason><answer>a</answer><answer>b</answer>'
            WHEN 7 THEN '<reason>r</reason><answer>a</answer> and more' ELSE '<reason> </reason><answer>a</answer>' END AS raw, t, (conv_id + turn) % 9 AS f
        FROM (SELECT conv_id, turn, left(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), 20) || 'x' AS t FROM conversations))
    SELECT conv_id, turn, f IN (0, 1, 2) AS valid, CASE f WHEN 0 THEN 'answer' WHEN 1 THEN 'text_search' WHEN 2 THEN 'image_search' END AS action,
           CASE f WHEN 0 THEN trim(t) WHEN 1 THEN trim(t) WHEN 2 THEN 'img' END AS content,
           CASE f WHEN 3 THEN 'empty_output' WHEN 4 THEN 'missing_reason' WHEN 5 THEN 'empty_answer' WHEN 6 THEN 'multiple_actions' WHEN 7 THEN 'extra_text' WHEN 8 THEN 'empty_reason' END AS error
    FROM forms"""


def _forms() -> list:
    """Texts of an action in nine states of form, from the row's own text."""
    t = F.concat(F.left(F.regexp_replace("text", "[^a-zA-Z ]", ""), F.lit(20)), F.lit("x"))
    return [
        F.concat(F.lit("<reason>r</reason><answer>"), t, F.lit("</answer>")), F.concat(F.lit("<reason>r</reason> <text_search>"), t, F.lit("</text_search>")),
        F.lit("<reason>r</reason><search><img></search>"), F.lit(""), F.concat(F.lit("<answer>"), t, F.lit("</answer>")), F.lit("<reason>r</reason><answer> </answer>"),
        F.lit("<reason>r</reason><answer>a</answer><answer>b</answer>"), F.lit("<reason>r</reason><answer>a</answer> and more"), F.lit("<reason> </reason><answer>a</answer>"),
    ]


def _acted(table: Table) -> DataFrame:
    which = ((F.col("conv_id") + F.col("turn")) % 9 + 1).cast("int")
    return table("conversations").select("conv_id", "turn", F.element_at(F.array(*_forms()), which).alias("raw"))


@query(_ACTION_SQL)
def str46_parsed_action(table: Table) -> DataFrame:
    return _acted(table).withColumn("p", A.parsed_action(F.col("raw"))).select("conv_id", "turn", "p.valid", "p.action", "p.content", "p.error")


@query(
    """SELECT conv_id, turn, f NOT IN (3, 6) AS one_action, true AS closed, CASE WHEN f IN (0, 4, 5, 6, 7, 8) THEN 'answer' WHEN f = 1 THEN 'text_search' WHEN f = 2 THEN 'image_search' END AS detected
       FROM (SELECT conv_id, turn, (conv_id + turn) % 9 AS f FROM conversations)"""
)
def str47_str48_tag_checks(table: Table) -> DataFrame:
    raw = F.col("raw")
    return _acted(table).select("conv_id", "turn", A.exactly_one_action(raw).alias("one_action"), A.tags_closed(raw).alias("closed"), A.detected_action(raw).alias("detected"))


@query(
    """SELECT category, count(*) AS n FROM (SELECT CASE (conv_id + turn) % 9 WHEN 0 THEN 'ok' WHEN 1 THEN 'ok' WHEN 2 THEN 'ok' WHEN 3 THEN 'format' WHEN 4 THEN 'format'
         WHEN 5 THEN 'content' WHEN 8 THEN 'content' ELSE 'structure' END AS category FROM conversations) GROUP BY 1"""
)
def str49_error_category(table: Table) -> DataFrame:
    parsed = _acted(table).withColumn("e", A.parsed_action(F.col("raw"))["error"])
    return parsed.groupBy(A.error_category(F.col("e")).alias("category")).agg(F.count("*").alias("n"))


@query(
    """SELECT conv_id, turn, s.kind, s.start::INT AS start, s.length::INT AS length FROM (
         SELECT conv_id, turn, unnest([{'kind': 'reason', 'start': 9, 'length': 1}, {'kind': 'answer', 'start': 27, 'length': length(left(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), 20) || 'x')}]) AS s
         FROM conversations)"""
)
def str50_target_segments(table: Table) -> DataFrame:
    parts = table("conversations").select("conv_id", "turn", _forms()[0].alias("raw")).select("conv_id", "turn", F.explode(A.target_segments(F.col("raw"))).alias("s"))
    return parts.select("conv_id", "turn", "s.kind", "s.start", "s.length")


@query(
    r"""SELECT conv_id, string_agg(upper(left(role, 1)) || role[2:] || ': ' || text, chr(10) ORDER BY turn) AS context FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id"""
)
def str55_visible_context(table: Table) -> DataFrame:
    turns = table("conversations").where(F.col("role").isin("user", "assistant")).withColumn("line", F.concat(F.initcap("role"), F.lit(": "), "text"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "line")))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("context"))


@query(
    """SELECT user_id, string_agg(CASE event_type WHEN 'view' THEN 'V' WHEN 'click' THEN 'C' WHEN 'purchase' THEN 'A' ELSE upper(left(event_type, 1)) END, '->' ORDER BY ts, event_id) AS route FROM events GROUP BY user_id"""
)
def str56_action_route(table: Table) -> DataFrame:
    code = F.when(F.col("event_type") == "view", "V").when(F.col("event_type") == "click", "C").when(F.col("event_type") == "purchase", "A").otherwise(F.upper(F.left("event_type", F.lit(1))))
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", code.alias("code"))))
    return table("events").groupBy("user_id").agg(F.array_join(F.transform(ordered, lambda x: x["code"]), "->").alias("route"))


@query(r"SELECT page_id, regexp_extract(url, '/([a-z]{2})/\d+', 1) AS shard, regexp_extract(url, '/(\d+)', 1) AS member FROM pages")
def str57_path_parts(table: Table) -> DataFrame:
    return table("pages").select("page_id", F.regexp_extract("url", r"/([a-z]{2})/\d+", 1).alias("shard"), F.regexp_extract("url", r"/(\d+)", 1).alias("member"))


@query(
    rf"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w, regexp_extract_all(lower(left(text, 40)), '{WORD_SQL}') AS r FROM documents)
         SELECT doc_id, (contains(array_to_string(w, ' '), array_to_string(r, ' ')) AND len(r) > 0) OR (len(r) > 0 AND len(list_intersect(list_distinct(r), w)) >= 0.5 * len(list_distinct(r))) AS bearing FROM d"""
)
def str58_answer_bearing(table: Table) -> DataFrame:
    return table("documents").select("doc_id", M.answer_bearing(F.col("text"), F.array(F.left("text", F.lit(40)))).alias("bearing"))


@query(
    """SELECT doc_id, sha256('7:' || lang || ':' || doc_id) AS key, 'doc:' || left(sha256(source), 20) AS grp,
              (('0x' || left(sha256('7:' || doc_id), 16))::UBIGINT % 10)::BIGINT AS pick, (('0x' || left(sha256('7:' || doc_id), 16))::UBIGINT % 2147483647)::BIGINT AS seed,
              round(('0x' || left(sha256('7:' || doc_id), 16))::UBIGINT::DOUBLE / 18446744073709551616, 9) AS u FROM documents"""
)
def sel15_sel16_sel17_grp01_seeded_hashes(table: Table) -> DataFrame:
    h = H.digest("7", F.col("doc_id"))
    return table("documents").select(
        "doc_id", H.digest("7", F.col("lang"), F.col("doc_id")).alias("key"), H.group_id("doc", F.col("source")).alias("grp"), H.choice(h, 10).alias("pick"), H.seed31(h).alias("seed"), F.round(H.uniform(h), 9).alias("u")
    )
