"""Queries of joins (JOIN)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import gates as G
from quillspark.operators import leakage as L
from quillspark.plans.declare import Table, query
from quillspark.plans.dedup import grp06_grp07_difference_hash
from quillspark.plans.text import WORD_SQL


@query("SELECT d.doc_id, l.quality, l.doc_id IS NULL AS missed FROM documents d LEFT JOIN labels l USING (doc_id)")
def join01_join26_cache_left(table: Table) -> DataFrame:
    labels = table("labels").select("doc_id", "quality", F.lit(True).alias("hit"))
    return table("documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", "quality", F.col("hit").isNull().alias("missed"))


@query(
    """SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey"""
)
def join02_join32_cmp08_star_left(table: Table) -> DataFrame:
    o = table("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = table("customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey"))
    n = table("nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    return o.join(c, "c_custkey", "left").join(n, "n_nationkey", "left").join(table("region"), "r_regionkey", "left").select("o_orderkey", "c_name", "n_name", "r_name")


@query("SELECT o_custkey, max_by(o_orderstatus, (o_orderdate, o_orderkey)) AS status FROM orders GROUP BY o_custkey")
def join03_join07_later_wins(table: Table) -> DataFrame:
    return table("orders").groupBy("o_custkey").agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("status"))


@query(
    """SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, ''), n_name) AS label FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"""
)
def join04_join21_primary_over_supplement(table: Table) -> DataFrame:
    own = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name"))
    joined = table("customer").join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("c_custkey", F.coalesce(F.nullif(own, F.lit("")), F.col("n_name")).alias("label"))


@query(
    """SELECT user_id, arg_min(json_extract_string(props, '$.k'), (ts, event_id)) AS first_k, arg_min(CASE WHEN value > 50 THEN value END, (ts, event_id)) FILTER (WHERE value > 50) AS first_high FROM events GROUP BY user_id"""
)
def join05_join06_first_non_null(table: Table) -> DataFrame:
    order = F.struct("ts", "event_id")
    high = F.when(F.col("value") > 50, F.struct(order, F.col("value")))
    return table("events").groupBy("user_id").agg(F.min_by(F.get_json_object("props", "$.k"), order).alias("first_k"), F.min(high)["value"].alias("first_high"))


LEAK_KEYS = ("same_id", "same_text", "same_question", "same_question_and_answer")
_LEAK_ROWS = """
        hashes AS (SELECT vec_id, sum(CASE WHEN embedding[i + 1] < embedding[i + 2] THEN 1 << i ELSE 0 END)::BIGINT AS hash FROM embeddings, (SELECT unnest(range(0, 32)) AS i) GROUP BY vec_id),
        c AS (SELECT doc_id AS id, doc_id AS same_id, sha256(text) AS same_text, key(text) AS same_question, key(text) || '|' || lang AS same_question_and_answer, hash, list_distinct(words(text)) AS w FROM documents LEFT JOIN hashes ON vec_id = doc_id),
        r AS (SELECT item_id AS id, item_id AS same_id, sha256(text) AS same_text, key(text) AS same_question, key(text) || '|en' AS same_question_and_answer, hash, list_distinct(words(text)) AS w FROM benchmark LEFT JOIN hashes ON vec_id = 300 + item_id)"""


def _leak_sql() -> str:
    rows = _LEAK_ROWS.replace("key(text)", r"array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'), ' ')").replace("words(text)", f"regexp_extract_all(lower(text), '{WORD_SQL}')")
    equal = " UNION ALL ".join(f"SELECT c.id AS candidate, min(r.id) AS reference, '{k}' AS kind FROM c JOIN r ON c.{k} = r.{k} GROUP BY c.id" for k in LEAK_KEYS)
    return f"""WITH {rows},
        s AS (SELECT c.id AS candidate, r.id AS reference, len(list_intersect(c.w, r.w)) AS n, len(c.w) + len(r.w) AS m FROM c, r WHERE len(r.w) > 0 AND len(c.w) BETWEEN 0.9 * len(r.w) AND len(r.w) / 0.9),
        t AS (SELECT candidate, reference, row_number() OVER (PARTITION BY reference ORDER BY n / (m - n)::DOUBLE DESC, candidate) AS k FROM s WHERE n / (m - n)::DOUBLE >= 0.9 AND n < m - n)
        {equal} UNION ALL SELECT c.id, r.id, 'near_hash' FROM c JOIN r ON bit_count(xor(c.hash, r.hash)) <= 5 UNION ALL SELECT candidate, reference, 'similar_tokens' FROM t WHERE k <= 20"""


@query(_leak_sql())
def join08_leakage_audit(table: Table) -> DataFrame:
    """Documents that leak from the benchmark: by four equal keys, near hashes of the vectors of their numbers, and reworded texts."""
    hashes = grp06_grp07_difference_hash(table)
    text = F.col("text")

    def rows(t: str, key: str, vector: Column, answer: Column) -> DataFrame:
        question = T.question_key(text)
        keys = [F.col(key), F.sha2(text, 256), question, F.concat_ws("|", question, answer)]
        named = table(t).select(F.col(key).alias("id"), *[c.alias(k) for c, k in zip(keys, LEAK_KEYS, strict=True)], vector.alias("vec_id"), T.words(text).alias("tokens"))
        return named.join(hashes.withColumnRenamed("dhash", "hash"), "vec_id", "left")

    candidates, references = rows("documents", "doc_id", F.col("doc_id"), F.col("lang")), rows("benchmark", "item_id", F.col("item_id") + 300, F.lit("en"))
    return L.audit(candidates, references, list(LEAK_KEYS), bits=32)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def join09_join10_join11_tainted_anti(table: Table) -> DataFrame:
    tainted = table("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return G.tainted_out(table("customer").select("c_custkey"), tainted, "c_custkey")


@query(
    """WITH seen AS (SELECT DISTINCT source FROM documents WHERE doc_id % 40 = 0), langs AS (SELECT DISTINCT lang FROM documents WHERE doc_id % 97 = 0)
       SELECT doc_id FROM documents WHERE source NOT IN (SELECT source FROM seen) AND lang NOT IN (SELECT lang FROM langs WHERE lang <> 'en')"""
)
def join12_join13_historical_groups(table: Table) -> DataFrame:
    d = table("documents").select("doc_id", "source", "lang")
    sources, langs = d.where("doc_id % 40 = 0").select("source").distinct(), d.where("doc_id % 97 = 0 and lang <> 'en'").select("lang").distinct()
    return d.join(sources, "source", "left_anti").join(langs, "lang", "left_anti").select("doc_id")


@query(
    """SELECT c_custkey, coalesce(a.p, b.p) AS part FROM customer LEFT JOIN (SELECT p_size AS k, min_by(p_name, p_partkey) AS p FROM part WHERE p_size < 10 GROUP BY 1) a ON c_custkey % 50 = a.k
       LEFT JOIN (SELECT p_size AS k, min_by(p_brand, p_partkey) AS p FROM part GROUP BY 1) b ON c_custkey % 25 = b.k"""
)
def join14_cmp22_evidence_lookup(table: Table) -> DataFrame:
    p = table("part")
    exact = p.where("p_size < 10").groupBy(F.col("p_size").alias("ka")).agg(F.min_by("p_name", "p_partkey").alias("a"))
    loose = p.groupBy(F.col("p_size").alias("kb")).agg(F.min_by("p_brand", "p_partkey").alias("b"))
    c = table("customer").select("c_custkey", (F.col("c_custkey") % 50).cast("int").alias("ka"), (F.col("c_custkey") % 25).cast("int").alias("kb"))
    return c.join(exact, "ka", "left").join(loose, "kb", "left").select("c_custkey", F.coalesce("a", "b").alias("part"))


@query(
    """SELECT a.event_id, a.value AS left_value, b.value AS right_value FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0"""
)
def join17_paired(table: Table) -> DataFrame:
    e = table("events").select("event_id", "value")
    left = e.where("event_id % 2 = 0").withColumnRenamed("value", "left_value")
    right = e.where("event_id % 2 = 1").select((F.col("event_id") - 1).alias("event_id"), F.col("value").alias("right_value"))
    return left.join(right, "event_id").select("event_id", "left_value", "right_value")


@query(
    """SELECT count(*) FILTER (WHERE d.doc_id IS NULL) AS only_right, count(*) FILTER (WHERE l.doc_id IS NULL) AS only_left, count(*) FILTER (WHERE d.doc_id = l.doc_id) AS both FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id"""
)
def join18_join25_full_outer_diff(table: Table) -> DataFrame:
    d, r = table("documents").select(F.col("doc_id").alias("a")), table("labels").select(F.col("doc_id").alias("b"))
    both = d.join(r, F.col("a") == F.col("b"), "full")
    return both.agg(F.count_if(F.col("a").isNull()).alias("only_right"), F.count_if(F.col("b").isNull()).alias("only_left"), F.count_if(F.col("a") == F.col("b")).alias("both"))


@query(
    """SELECT o_orderkey, c_name, count(*) AS lines, sum(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)))::DOUBLE AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey WHERE p_size > 25 GROUP BY ALL"""
)
def join19_rwd05_chain(table: Table) -> DataFrame:
    line = table("lineitem").join(table("part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    sums = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("lines"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double").alias("revenue"))
    named = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")
    return sums.join(named, "o_orderkey").select("o_orderkey", "c_name", "lines", "revenue")


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey AND l_suppkey % 10 = p_size % 10")
def join20_join23_composite_key(table: Table) -> DataFrame:
    left = table("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("k1"), (F.col("l_suppkey") % 10).alias("k2"))
    right = table("part").select(F.col("p_partkey").alias("k1"), (F.col("p_size") % 10).cast("long").alias("k2"), "p_name")
    return left.join(right, ["k1", "k2"]).select("l_orderkey", "l_linenumber", "p_name")


@query(
    r"""SELECT key, min(page_id) AS page_id FROM (SELECT page_id, regexp_replace(regexp_replace(lower(url), '[?#].*$', ''), '^https?://(www\.|m\.)?', '') AS key FROM pages) WHERE key LIKE '%/en/%' GROUP BY key"""
)
def join22_str37_required_pages(table: Table) -> DataFrame:
    key = F.regexp_replace(F.regexp_replace(F.lower("url"), r"[?#].*$", ""), r"^https?://(www\.|m\.)?", "")
    return table("pages").select("page_id", key.alias("key")).where(F.contains("key", F.lit("/en/"))).groupBy("key").agg(F.min("page_id").alias("page_id"))


@query(
    """SELECT a.event_id FROM events a JOIN (SELECT DISTINCT sha256('{"k":"' || json_extract_string(props, '$.k') || '","t":"' || event_type || '"}') AS h FROM events WHERE event_id < 200) s
       ON sha256('{"k":"' || json_extract_string(a.props, '$.k') || '","t":"' || a.event_type || '"}') = s.h WHERE a.event_id >= 200"""
)
def join24_ret20_replay_lookup(table: Table) -> DataFrame:
    key = F.sha2(F.to_json(F.struct(F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("t"))), 256)
    e = table("events").select("event_id", key.alias("h"))
    return e.where("event_id >= 200").join(e.where("event_id < 200").select("h").distinct(), "h", "left_semi").select("event_id")


@query("SELECT d.doc_id FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 1 AND l.toxic = 0")
def join27_cmp27_accepted_semi(table: Table) -> DataFrame:
    good = table("labels").where("quality = 1 and toxic = 0").select("doc_id")
    return table("documents").select("doc_id").join(good, "doc_id", "left_semi")


@query(
    """SELECT u.conv_id, u.turn, a.turn AS reply_turn, length(a.text)::INT AS reply_chars FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'"""
)
def join30_actions_with_results(table: Table) -> DataFrame:
    c = table("conversations")
    replies = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("turn").alias("reply_turn"), F.length("text").alias("reply_chars"))
    return c.where("role = 'user'").select("conv_id", "turn").join(replies, ["conv_id", "turn"], "left")
