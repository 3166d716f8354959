"""Queries of groups, duplicates, similarity and components (GRP, SET, SIM)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import hashing as H
from quillspark.functions import text as T
from quillspark.functions.matching import hashed_shingles
from quillspark.operators import grouping as G
from quillspark.operators.exchange import skew_join
from quillspark.plans.declare import Table, query
from quillspark.plans.text import WORD_SQL


@query(
    """SELECT p_partkey, 'entity:' || left(sha256(lower(CASE WHEN length(split_part(p_name, ' - ', 1)) >= 3 THEN split_part(p_name, ' - ', 1) ELSE p_type END)), 20) AS entity,
              'near:' || left(sha256(coalesce(CASE WHEN p_partkey % 2 = 0 THEN sha256(p_name) END, 'dhash:' || p_size)), 20) AS near FROM part"""
)
def grp02_grp03_grp04_group_ids(table: Table) -> DataFrame:
    head = F.split("p_name", " - ", 2)[0]
    entity = F.lower(F.when(F.length(head) >= 3, head).otherwise(F.col("p_type")))
    near = F.coalesce(F.when(F.col("p_partkey") % 2 == 0, F.sha2("p_name", 256)), F.concat(F.lit("dhash:"), "p_size"))
    return table("part").select("p_partkey", H.group_id("entity", entity).alias("entity"), H.group_id("near", near).alias("near"))


@query("SELECT page_id, sha256(html) AS digest, octet_length(encode(html))::INT AS bytes FROM pages")
def grp05_fingerprints(table: Table) -> DataFrame:
    return table("pages").select("page_id", F.sha2("html", 256).alias("digest"), F.octet_length("html").alias("bytes"))


@query(
    """SELECT vec_id, sum(CASE WHEN embedding[i + 1] < embedding[i + 2] THEN 1 << (i - 0) ELSE 0 END)::BIGINT AS dhash
       FROM embeddings, (SELECT unnest(range(0, 32)) AS i) GROUP BY vec_id"""
)
def grp06_grp07_difference_hash(table: Table) -> DataFrame:
    """Bits that say where neighbours of a row of numbers rise (of an image: its shrunken grey rows)."""
    rises = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.when(F.get("embedding", i) < F.get("embedding", i + 1), F.pow(F.lit(2.0), i).cast("long")).otherwise(F.lit(0).cast("long")))
    return table("embeddings").select("vec_id", F.aggregate(rises, F.lit(0).cast("long"), lambda s, x: s + x).alias("dhash"))


@query("SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def set01_first_of_each(table: Table) -> DataFrame:
    return G.first_of_each(table("documents").select("doc_id", "lang", "source"), ["lang", "source"], ["doc_id"])


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def set02_last_of_each(table: Table) -> DataFrame:
    e = table("events").select("user_id", "event_type", "event_id", "ts")
    return G.first_of_each(e, ["user_id", "event_type"], ["ts", "event_id"], last=True).drop("ts")


@query("SELECT p_partkey, array_to_string([p_name, p_brand], '|') AS answers FROM part")
def set03_accepted_answers(table: Table) -> DataFrame:
    listed = F.to_json(F.array(F.concat(F.lit("The "), "p_name"), F.upper("p_name"), "p_brand"))
    return table("part").select("p_partkey", F.array_join(T.accepted_answers(F.col("p_name"), listed), "|").alias("answers"))


@query(
    """SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS repeats_text, row_number() OVER (PARTITION BY lang, n_chars ORDER BY doc_id) > 1 AS repeats_size FROM documents"""
)
def set06_flt29_repeats_in_order(table: Table) -> DataFrame:
    hashed = table("documents").select("doc_id", "lang", "n_chars", F.sha2("text", 256).alias("h"))
    first = lambda name, *keys: hashed.groupBy(*keys).agg(F.min("doc_id").alias(name))
    both = skew_join(skew_join(hashed, first("of_text", "h"), ["h"], "inner"), first("of_size", "lang", "n_chars"), ["lang", "n_chars"], "inner")
    return both.select("doc_id", (F.col("doc_id") > F.col("of_text")).alias("repeats_text"), (F.col("doc_id") > F.col("of_size")).alias("repeats_size"))


@query(
    """SELECT 'union' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer) UNION ALL
       SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) UNION ALL
       SELECT 'intersect', count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)"""
)
def set07_set08_key_sets(table: Table) -> DataFrame:
    c, o = table("customer").select("c_custkey"), table("orders").select(F.col("o_custkey").alias("c_custkey"))
    size = lambda op, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return size("union", o.union(c).distinct()).union(size("except", c.subtract(o))).union(size("intersect", c.intersect(o)))


@query("SELECT sha256(text) AS key, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def set09_exact_groups(table: Table) -> DataFrame:
    hashed = table("documents").select("doc_id", F.sha2("text", 256).alias("key"))
    return hashed.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n > 1")


_SHINGLES_SQL = f"""w AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS s FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS w FROM documents) WHERE len(w) >= 5),
        m AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY list_sort(s)) AS same FROM w)"""


def _shingled(table: Table) -> DataFrame:
    # Tokens once a row, not once a shingle, and as hashes.
    hashed = F.transform(T.words(F.col("text")), lambda t: F.xxhash64(t))
    return table("documents").select("doc_id", T.once(hashed, lambda w: hashed_shingles(w, 5)).alias("s"))


@query(
    f"""WITH {_SHINGLES_SQL}, t AS (SELECT doc_id, unnest(s) AS t, len(s) AS n FROM m WHERE doc_id = same),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS common FROM t a JOIN t b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL)
        SELECT a, b, round(common / (na + nb - common)::DOUBLE, 9) AS similarity FROM c WHERE common / (na + nb - common)::DOUBLE >= 0.8"""
)
def sim02_similar_documents(table: Table) -> DataFrame:
    """Similar pairs of distinct texts; documents of equal shingles are in ``sim02_equal_documents``."""
    return G.similar_pairs(_shingled(table), "doc_id", "s", 0.8)[0].withColumn("similarity", F.round("similarity", 9))


@query(f"WITH {_SHINGLES_SQL} SELECT doc_id AS id, same FROM m")
def sim02_equal_documents(table: Table) -> DataFrame:
    """Each document with the first one of equal shingles, which stands for it in ``sim02_similar_documents``."""
    return G.equal_sets(_shingled(table), "doc_id", "s")


@query(
    f"""WITH q AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '{WORD_SQL}')) AS s FROM benchmark), d AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '{WORD_SQL}')) AS s FROM documents),
        p AS (SELECT item_id, doc_id, len(list_intersect(q.s, d.s)) AS c, len(q.s) AS nq, len(d.s) AS nd FROM q, d WHERE len(q.s) > 0 AND len(d.s) BETWEEN 0.9 * len(q.s) AND len(q.s) / 0.9),
        j AS (SELECT item_id, doc_id, c / (nq + nd - c)::DOUBLE AS s FROM p WHERE c / (nq + nd - c)::DOUBLE >= 0.9 AND c < nq + nd - c)
        SELECT item_id, doc_id, round(s, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY s DESC, doc_id) AS r FROM j) WHERE r <= 20"""
)
def sim02_reworded_questions(table: Table) -> DataFrame:
    """Documents that a benchmark item's words make up to nine tenths but not quite, the twenty nearest of each item."""
    words = lambda t, key: table(t).select(F.col(key).alias("id"), F.array_distinct(T.words(F.col("text"))).alias("s"))
    return G.similar_across(words("benchmark", "item_id"), words("documents", "doc_id"), 0.9, 20).select(F.col("a").alias("item_id"), F.col("b").alias("doc_id"), F.round("similarity", 9).alias("similarity"))


@query(
    """WITH h AS (SELECT vec_id, sum(CASE WHEN embedding[i + 1] < embedding[i + 2] THEN 1 << i ELSE 0 END)::BIGINT AS h FROM embeddings, (SELECT unnest(range(0, 32)) AS i) GROUP BY vec_id)
       SELECT a.vec_id AS a, b.vec_id AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM h a JOIN h b ON a.vec_id < b.vec_id AND bit_count(xor(a.h, b.h)) <= 5"""
)
def sim01_near_hashes(table: Table) -> DataFrame:
    h = grp06_grp07_difference_hash(table).select(F.col("vec_id").alias("id"), F.col("dhash").alias("hash"))
    return G.near_hashes(h, h, 5, bits=32).where("a < b")


_HASHES_SQL = """h AS (SELECT vec_id, sum(CASE WHEN embedding[i + 1] < embedding[i + 2] THEN 1 << i ELSE 0 END)::BIGINT AS h FROM embeddings, (SELECT unnest(range(0, 32)) AS i) GROUP BY vec_id),
       u AS (SELECT vec_id % 50 * 40503 % 65536 * 65536 + h % 32 AS h, vec_id FROM h)"""


def _crowded(table: Table) -> DataFrame:
    """Hashes of which many are equal, and many within a few bits."""
    h = grp06_grp07_difference_hash(table)
    return h.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 50 * 40503 % 65536 * 65536 + F.col("dhash") % 32).alias("hash"))


@query(f"WITH {_HASHES_SQL} SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY h) AS representative FROM u")
def sim01_hash_classes(table: Table) -> DataFrame:
    """Each vector with the first one of its hash."""
    return G.hash_classes(_crowded(table), 5, bits=32)[0]


@query(
    f"""WITH {_HASHES_SQL}, r AS (SELECT h, min(vec_id) AS id FROM u GROUP BY h)
       SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM r a JOIN r b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 5"""
)
def sim01_class_links(table: Table) -> DataFrame:
    """Links of unequal hashes within five bits, between the vectors that stand for them."""
    return G.hash_classes(_crowded(table), 5, bits=32)[1]


@query(
    """WITH RECURSIVE n AS (SELECT supplier.s_suppkey AS id, s_nationkey AS k FROM supplier), g AS (SELECT a.id AS a, b.id AS b FROM n a JOIN n b ON a.k = b.k OR abs(a.id - b.id) = 7 AND a.k % 2 = b.k % 2),
       r AS (SELECT a, b FROM g UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a) SELECT a AS id, min(b) AS component FROM r GROUP BY a"""
)
def set10_set11_components(table: Table) -> DataFrame:
    n = table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("k"))
    apart = n.select(F.col("id").alias("a"), F.col("k").alias("ka")).join(n.select(F.col("id").alias("b"), F.col("k").alias("kb")), F.col("b") == F.col("a") + 7).where("ka % 2 = kb % 2")
    return G.components(G.key_edges(n, "id", ["k"]).unionByName(apart.select("a", "b")))
