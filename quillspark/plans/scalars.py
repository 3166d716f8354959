"""Queries of recursive scans (SRC38)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.plans.declare import Table, query
from quillspark.plans.ingest import fresh_folder
from quillspark.sources import scalars as S


@query(
    """WITH t AS (SELECT conv_id, to_json({'conv_id': conv_id, 'turns': list({'role': role, 'said': {'text': text, 'words': string_split(text, ' ')}} ORDER BY turn)}) AS j FROM conversations GROUP BY conv_id)
       SELECT conv_id, e.fullkey AS path, CASE e.type WHEN 'VARCHAR' THEN 'STRING' ELSE 'BIGINT' END AS kind, e.atom->>'$' AS value FROM t, json_tree(t.j) e WHERE e.type NOT IN ('OBJECT', 'ARRAY', 'NULL')"""
)
def src38_recursive_scalars(table: Table) -> DataFrame:
    """Conversations as nested JSON, descended to every scalar and its path."""
    said = F.struct("role", F.struct("text", F.split("text", " ").alias("words")).alias("said"))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", said.alias("x")))), lambda t: t["x"])
    c = table("conversations").groupBy("conv_id").agg(turns.alias("turns"))
    nested = c.select("conv_id", F.parse_json(F.to_json(F.struct("conv_id", "turns"))).alias("row"))
    return S.scalar_values(nested, "row")


@query(
    """WITH wanted AS (SELECT item_id AS id, text AS question, 'HTTPS://docs.example/' || item_id AS url, 'Customer#' || lpad((item_id * 3 + 1)::VARCHAR, 9, '0') AS image FROM benchmark),
       plain AS (SELECT id, trim(regexp_replace(lower(question), '[^\\w\\x{80}-\\x{10ffff}]+', ' ', 'g')) AS q, lower(url) AS u, lower(image) AS i FROM wanted),
       said AS (SELECT trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[^\\w\\x{80}-\\x{10ffff}]+', ' ', 'g')) AS q FROM documents)
       SELECT id, 'question' AS match FROM plain WHERE q <> '' AND q IN (SELECT q FROM said)
       UNION ALL SELECT id, 'url' FROM plain WHERE u IN (SELECT 'https://docs.example/' || doc_id FROM documents)
       UNION ALL SELECT id, 'image' FROM plain WHERE i IN (SELECT lower(c_name) FROM customer)"""
)
def src38_project_overlap(table: Table) -> DataFrame:
    """Benchmark items that files of documents (nested JSON lines, some broken) or customers (CSV) repeat."""
    d, i = table("documents"), F.col("item_id")
    path = fresh_folder(d, "project")
    nested = F.to_json(F.struct("doc_id", F.struct(F.concat(F.lit("https://docs.example/"), F.col("doc_id").cast("string")).alias("URL"), F.array(F.struct(F.split("text", "\n").alias("lines"))).alias("parts")).alias("meta")))
    d.select(F.when(F.col("doc_id") % 5 == 4, F.concat(nested, F.lit("}"))).otherwise(nested).alias("value")).write.text(f"{path}/json")
    table("customer").select("c_custkey", "c_name").write.csv(f"{path}/csv", header=True)
    wanted = table("benchmark").select(i.alias("id"), F.col("text").alias("question"), F.concat(F.lit("HTTPS://docs.example/"), i.cast("string")).alias("url"), F.format_string("Customer#%09d", i * 3 + 1).alias("image"))
    scalars, broken = S.json_scalars(d.sparkSession, f"{path}/json")
    cells = S.csv_scalars(d.sparkSession, f"{path}/csv")
    return S.overlap(wanted, scalars.select("file", "kind", "value").unionByName(cells.select("file", "kind", "value")), broken).select("id", "match").distinct()
