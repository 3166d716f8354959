"""Queries of sources, sinks and streams (SRC, SNK, UDF surface)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.exchange import shared_folder
from quillspark.plans.declare import Table, query
from quillspark.sources import readers as R
from quillspark.sources import sinks as K
from quillspark.sources.registry import build, reward
from quillspark.streaming import incremental as I


def fresh_folder(df: DataFrame, name: str) -> str:
    """A fresh folder beside the session's checkpoints, which every executor can reach."""
    return f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def src01_src02_src03_snk01_snk07_json_round_trip(table: Table) -> DataFrame:
    o = table("orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    path = fresh_folder(o, "json")
    K.write_json_lines(o, path)
    return R.read_json_lines(o.sparkSession, path, o.schema)


@query("SELECT c_custkey, replace(c_name, '-', '_') AS name FROM customer")
def src05_src06_src07_src08_checked_parquet(table: Table) -> DataFrame:
    c = table("customer")
    path = fresh_folder(c, "parquet")
    K.write_new(c.select("c_custkey", "c_name"), path)
    return R.read_records(c.sparkSession, path, ["c_custkey", "c_name"], "c_custkey").select("c_custkey", F.replace("c_name", F.lit("-"), F.lit("_")).alias("name"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def src13_src14_src15_csv_round_trip(table: Table) -> DataFrame:
    n = table("nation")
    path = fresh_folder(n, "csv")
    n.write.csv(path, header=True)
    return R.read_csv(n.sparkSession, path, n.schema).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT event_id, 'k' AS field, json_extract_string(props, '$.k') AS value FROM events")
def src38_json_fields(table: Table) -> DataFrame:
    return table("events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("field", "value"))


@query("SELECT 'events' AS table_name, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::BIGINT FROM orders")
def src29_src30_src31_source_union(table: Table) -> DataFrame:
    part = lambda name, key: table(name).agg(F.count("*").alias("n"), F.sum(key).alias("ids")).select(F.lit(name).alias("table_name"), "n", "ids")
    return part("events", "event_id").unionByName(part("orders", "o_orderkey"))


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row_index FROM documents")
def src33_row_index(table: Table) -> DataFrame:
    """A dense row index by two passes: rows of each id range, then their offset; no window over all rows."""
    return R.indexed(table("documents").select("doc_id"), "doc_id")


@query("SELECT adapter, n_nationkey, n_name FROM nation, (SELECT unnest(['checked_parquet', 'csv', 'json_lines']) AS adapter)")
def udf03_udf04_adapter_scans(table: Table) -> DataFrame:
    """The nations written in each format and scanned again by the adapter of that name."""
    n = table("nation").select("n_nationkey", "n_name")
    spark, path = n.sparkSession, fresh_folder(n, "adapters")
    n.write.parquet(f"{path}/checked_parquet")
    n.write.csv(f"{path}/csv", header=True)
    K.write_json_lines(n, f"{path}/json_lines")
    how = {"checked_parquet": (["n_nationkey", "n_name"], "n_nationkey"), "csv": (n.schema,), "json_lines": (n.schema,)}
    scans = [build(name)(spark, f"{path}/{name}", *extra).select(F.lit(name).alias("adapter"), "n_nationkey", "n_name") for name, extra in how.items()]
    return reduce(DataFrame.unionByName, scans)


@query("SELECT event_id, name AS reward, round(CASE name WHEN 'clipped' THEN least(1.0, greatest(0.0, value / 100)) ELSE (value > 50)::INT END, 6) AS value FROM events, (SELECT unnest(['clipped', 'threshold']) AS name)")
def udf01_udf02_reward_registry(table: Table) -> DataFrame:
    """Rewards registered by name, made by the factory with their settings, and applied to every event."""
    made = {"clipped": reward("clipped", scale=100.0), "threshold": reward("threshold", least=50.0)}
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("reward"), F.round(f(F.col("value")), 6).alias("value")) for n, f in made.items()]))
    return table("events").select("event_id", named.alias("x")).select("event_id", "x.reward", "x.value")


@query("SELECT i AS line, CASE WHEN i % 5 = 0 THEN NULL ELSE i END AS id FROM (SELECT (event_id + 1)::BIGINT AS i FROM events) WHERE i % 5 <> 0")
def src04_tolerant_ids(table: Table) -> DataFrame:
    """Ids under the first of three keys that a line has; every fifth line is broken and skipped."""
    i = F.col("event_id") + 1
    key = F.when(i % 3 == 0, "id").when(i % 3 == 1, "data_id").otherwise("question_id")
    good = F.concat(F.lit('{"'), key, F.lit('": "'), i.cast("string"), F.lit('", "line": '), i.cast("string"), F.lit("}"))
    lines = table("events").select(F.when(i % 5 == 0, F.concat(F.lit("{broken "), i.cast("string"))).otherwise(good).alias("value"))
    path = fresh_folder(lines, "ids")
    lines.write.text(path)
    found = R.tolerant_ids(lines.sparkSession, path, ("id", "data_id", "question_id"))
    return found.select(F.col("id").cast("long").alias("line"), F.col("id").cast("long").alias("id"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lower(to_hex(doc_id)) ELSE doc_id::VARCHAR END AS raw, doc_id AS hash FROM documents")
def src12_reference_hashes(table: Table) -> DataFrame:
    """References whose image hash is a hexadecimal text under one key, or a number under another."""
    d = F.col("doc_id")
    row = F.when(d % 2 == 0, F.to_json(F.struct(d.alias("doc_id"), F.lower(F.hex("doc_id")).alias("dhash_hex")))).otherwise(F.to_json(F.struct(d.alias("doc_id"), d.alias("dhash"))))
    lines = table("documents").select(row.alias("value"))
    path = fresh_folder(lines, "references")
    lines.write.text(path)
    found = R.reference_hashes(lines.sparkSession, path, ("dhash", "dhash_hex"))
    return found.select(F.get_json_object("line", "$.doc_id").cast("long").alias("doc_id"), "raw", "hash")


@query("SELECT page_id, octet_length(encode(html))::BIGINT AS bytes, sha256(html) AS digest FROM pages")
def src37_snk03_snk16_binary_manifest(table: Table) -> DataFrame:
    pages = table("pages").select("page_id", F.encode("html", "utf-8").alias("content"))
    return pages.select("page_id", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("digest"))


@query("SELECT 'records' AS kind, n_nationkey, n_name FROM nation UNION ALL SELECT 'array', n_nationkey, n_name FROM nation UNION ALL SELECT 'lines', n_nationkey, n_name FROM nation")
def src09_wrapped_tables(table: Table) -> DataFrame:
    """The nations as a JSON document that holds its rows under a key, as an array, and as lines, read alike."""
    n = table("nation").select("n_nationkey", "n_name")
    path, spark = fresh_folder(n, "wrapped"), n.sparkSession
    rows = F.to_json(F.array_sort(F.collect_list(F.struct(*n.columns))))  # 25 rows
    n.agg(F.concat(F.lit('{"version": 1, "records": '), rows, F.lit("}")).alias("value")).write.text(f"{path}/records")
    n.agg(rows.alias("value")).write.text(f"{path}/array")
    K.write_json_lines(n, f"{path}/lines")
    scans = [R.read_wrapped_json(spark, f"{path}/{k}") if k != "lines" else R.read_json_lines(spark, f"{path}/{k}", n.schema) for k in ("records", "array", "lines")]
    return reduce(DataFrame.unionByName, [x.select(F.lit(k).alias("kind"), F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name") for k, x in zip(("records", "array", "lines"), scans, strict=True)])


@query("SELECT doc_id, sha256(text) AS digest, lang FROM documents")
def src16_compressed_lines(table: Table) -> DataFrame:
    """Documents as gzipped JSON lines, read again; a file is read by one task, so there are many."""
    d = table("documents").select("doc_id", "lang", "text")
    path = fresh_folder(d, "gz")
    d.write.option("compression", "gzip").json(path)
    return R.read_json_lines(d.sparkSession, path, d.schema).select("doc_id", F.sha2("text", 256).alias("digest"), "lang")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def stream01_incremental_metrics(table: Table) -> DataFrame:
    e = table("events").select("event_id", "ts", "user_id", "event_type", "value")
    return I.replayed(e, fresh_folder(e, "stream"), I.running_totals).select("event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def stream02_incremental_dedup(table: Table) -> DataFrame:
    e = table("events").select("event_id", "ts", "user_id", "event_type", "value")
    return I.replayed(e, fresh_folder(e, "stream"), I.first_seen)


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream03_windowed_counts(table: Table) -> DataFrame:
    e = table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return I.replayed(e, fresh_folder(e, "stream"), I.hourly_counts)
