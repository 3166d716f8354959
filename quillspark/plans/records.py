"""Queries of record preparation: corpus rows from fields, reference unions, upserts, partitioned tables (SRC, SNK, RET, STR, CMP)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import matching as M
from quillspark.functions import text as T
from quillspark.plans.declare import Table, query
from quillspark.plans.ingest import fresh_folder
from quillspark.plans.text import COLLAPSE
from quillspark.sources import sinks as K


@query(
    r"""WITH t AS (SELECT item_id, list_transform(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: CASE WHEN w IN ('image', 'photo', 'picture') THEN 'image'
          WHEN w IN ('this', 'the', 'a', 'an') THEN 'the' ELSE w END) AS w FROM benchmark)
        SELECT item_id, array_to_string(list_filter(w, lambda x, i: NOT (x = 'the' AND coalesce(w[i + 1], '') = 'image')), ' ') AS template FROM t"""
)
def str12_question_template(table: Table) -> DataFrame:
    named = lambda w: F.when(w.isin("image", "photo", "picture"), "image").when(w.isin("this", "the", "a", "an"), "the").otherwise(w)
    t = table("benchmark").select("item_id", F.transform(T.all_matches(F.lower("text"), r"[\p{L}\p{N}]+"), named).alias("w"))
    kept = F.filter("w", lambda x, i: ~((x == "the") & F.coalesce(F.get("w", i + 1) == "image", F.lit(False))))
    return t.select("item_id", F.array_join(kept, " ").alias("template"))


@query(rf"SELECT doc_id, trim(regexp_replace(replace(lower(text), '_', ' '), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS normal, {COLLAPSE('text')} AS alias FROM documents")
def str13_str15_external_text(table: Table) -> DataFrame:
    normal = F.trim(F.regexp_replace(F.replace(F.lower("text"), F.lit("_"), F.lit(" ")), r"[^\p{L}\p{N}]+", " "))
    return table("documents").select("doc_id", normal.alias("normal"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("alias"))


@query(
    """SELECT p_partkey, 'type of ' || lower(p_brand) AS query, contains(' ' || lower(p_name || ' ' || p_brand) || ' ', ' ' || lower(p_brand) || ' ') AS visible FROM part"""
)
def str23_str32_entity_query(table: Table) -> DataFrame:
    """A query from a relation's prefix and an entity, and whether the information that was shown names the entity."""
    entity = F.lower("p_brand")
    shown = F.lower(F.concat_ws(" ", "p_name", "p_brand"))
    return table("part").select("p_partkey", F.concat(F.lit("type of "), entity).alias("query"), M.has_phrase(shown, entity).alias("visible"))


@query(
    """SELECT doc_id || ':title:' || (i - 1) AS document_id, t AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(t) <> ''"""
)
def ret02_flt01_corpus_of_titles(table: Table) -> DataFrame:
    lines = table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "text")).where(F.trim("text") != "")
    return lines.select(F.concat_ws(":", "doc_id", F.lit("title"), "i").alias("document_id"), "text")


@query(r"SELECT doc_id, trim(regexp_extract(text, '(?im)^licen[sc]e[ \t]*:[ \t]*([^\n]+)', 1)) AS licence FROM documents")
def cmp24_declared_licence(table: Table) -> DataFrame:
    return table("documents").select("doc_id", F.trim(F.regexp_extract("text", r"(?im)^licen[sc]e[ \t]*:[ \t]*([^\n]+)", 1)).alias("licence"))


@query(
    """SELECT coalesce(r.k, i.k) AS nation, coalesce(r.n, i.n) AS n, r.k IS NOT NULL AS ready FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) i
       FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) r ON r.k = i.k"""
)
def cmp20_readiness_upsert(table: Table) -> DataFrame:
    """An inventory updated by reports: a report's fields win, new keys are added."""
    held = table("customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("held"))
    report = table("supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("reported"))
    return held.join(report, "nation", "full").select("nation", F.coalesce("reported", "held").alias("n"), F.col("reported").isNotNull().alias("ready"))


@query(
    """SELECT 'benchmark' AS origin, item_id AS id, sha256(lower(trim(text))) AS key FROM benchmark UNION ALL SELECT 'documents', doc_id, sha256(lower(trim(text))) FROM documents"""
)
def cmp13_cmp21_src11_reference_union(table: Table) -> DataFrame:
    part = lambda name, key: table(name).select(F.lit(name).alias("origin"), F.col(key).alias("id"), F.sha2(F.lower(F.trim("text")), 256).alias("key"))
    return part("benchmark", "item_id").unionByName(part("documents", "doc_id"))


@query("SELECT doc_id, lang AS split FROM documents")
def snk06_src36_partitioned_round_trip(table: Table) -> DataFrame:
    """A table written in a folder for each split, the split read back from the path."""
    d = table("documents").select("doc_id", F.col("lang").alias("split"))
    path = fresh_folder(d, "splits")
    K.write_new(d, path, ["split"])
    return d.sparkSession.read.schema("doc_id long, split string").parquet(path)


@query("SELECT event_id, '[redacted]' AS api_key, event_type FROM events")
def snk11_redacted_columns(table: Table) -> DataFrame:
    return K.without_secrets(table("events").select("event_id", F.col("props").alias("api_key"), "event_type"))


@query(
    """SELECT 'trajectories' AS part, count(*) AS n FROM documents WHERE n_chars >= 100 UNION ALL SELECT 'rejected', count(*) FROM documents WHERE n_chars < 100
       UNION ALL SELECT 'split ' || lang, count(*) FROM documents WHERE n_chars >= 100 GROUP BY lang UNION ALL SELECT 'manifest gaps', 0"""
)
def snk04_snk05_dataset_folder(table: Table) -> DataFrame:
    """A dataset's folder written and read again: rows of each part, and files whose digest the manifest has wrong."""
    d = table("documents").select("doc_id", F.col("lang").alias("split"), "n_chars")
    folder, spark = fresh_folder(d, "dataset"), d.sparkSession
    listed = K.write_dataset(d.where("n_chars >= 100"), d.where("n_chars < 100"), folder)
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(name.alias("part"), "n")
    read = lambda part: spark.read.schema(d.schema).json(f"{folder}/{part}")
    now = K.manifest(spark, f"{folder}").select("path", F.col("sha256").alias("now"))
    gaps = listed.join(now, "path", "left").where("now is null or now <> sha256")
    splits = read("splits").groupBy(F.concat(F.lit("split "), "split").alias("part")).agg(F.count(F.lit(1)).alias("n"))
    return count(read("trajectories"), F.lit("trajectories")).unionByName(count(read("rejected"), F.lit("rejected"))).unionByName(splits).unionByName(count(gaps, F.lit("manifest gaps")))


@query("SELECT event_id, 'b' || (event_id % 3) AS batch FROM events")
def snk07_snk08_src35_append_log(table: Table) -> DataFrame:
    """Events appended to a log in three batches, one of them twice; the second time adds nothing."""
    e = table("events").select("event_id")
    folder = fresh_folder(e, "log")
    for k in (0, 1, 2, 1):
        K.append_log(e.where(F.col("event_id") % 3 == k), folder, f"b{k}")
    return K.read_log(e.sparkSession, folder, e.schema)
