"""Queries of source adapters (SRC23 to SRC28, SRC50 to SRC52): given tables in the layouts of sources, with rejected rows and their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.plans.declare import Table, query
from quillspark.plans.ingest import fresh_folder
from quillspark.sources import adapters as A
from quillspark.sources import releases as R

_REASONS = "array_to_string(list_sort(list_filter([{}], lambda x: x IS NOT NULL)), ',')"


def _reasons(column: str = "reasons") -> Column:
    return F.array_join(column, ",")


@query(
    """WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text, lang, source FROM documents), t AS (SELECT conv_id, count(*) FILTER (trim(text) <> '') AS n FROM conversations GROUP BY conv_id)
       SELECT doc_id AS nth, CASE WHEN doc_id % 9 = 0 THEN '' ELSE doc_id::VARCHAR END AS source_id, CASE doc_id % 3 WHEN 0 THEN 'search_free' WHEN 1 THEN 'visual_search_required' END AS task_type,
              1 + CASE WHEN doc_id % 4 = 0 THEN 2 WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS aliases, CASE WHEN doc_id % 9 = 0 THEN 0 ELSE coalesce(n, 0) END AS records,
              array_to_string(list_filter([CASE WHEN doc_id % 9 = 0 THEN 'missing_source_data_id' END, CASE WHEN doc_id % 7 = 0 THEN 'missing_or_ambiguous_query_image' END], lambda x: x IS NOT NULL), ',') AS reasons
       FROM d LEFT JOIN t ON conv_id = doc_id"""
)
def src23_vqa_test(table: Table) -> DataFrame:
    """Documents as test records whose accepted answers are a JSON list, a text or nothing, with the titles that a search shows."""
    d = F.col("doc_id")
    others = F.when(d % 4 == 0, F.to_json(F.array(F.lit("one more"), F.lit("ONE MORE "), F.lit("another"), F.lit(""), F.concat(F.lit("A "), "source")))).when(d % 4 == 1, F.lit("one more"))
    rows = table("documents").select(
        d.alias("nth"), F.when(d % 9 == 0, " ").otherwise(d.cast("string")).alias("data_id"), F.col("text").alias("prompt"), F.when(d % 7 == 0, d % 2 * 2).otherwise(1).alias("n_images"),
        F.concat(F.lit("a "), "source").alias("ground_truth"), others.alias("candidate_answers"), F.when(d % 3 == 0, "Search-Free").when(d % 3 == 1, "search_required").otherwise("else").alias("category"),
    )
    titles = table("conversations").select(F.col("conv_id").alias("data_id"), F.col("turn").alias("nth"), F.col("text").alias("title"))
    found = A.vqa_test(rows, titles)
    return found.select("nth", "source_id", "task_type", F.size("aliases").alias("aliases"), F.size("records").cast("long").alias("records"), _reasons().alias("reasons"))


@query(
    """WITH w AS (SELECT conv_id, turn, text, turn % 2 AS odd FROM conversations), s AS (SELECT conv_id, count(*) FILTER (trim(text) <> '') AS n FROM w WHERE odd = 0 AND conv_id % 3 <> 0 GROUP BY conv_id),
            r AS (SELECT conv_id, arg_max(trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), turn) AS last FROM w GROUP BY conv_id)
       SELECT doc_id AS nth, CASE WHEN doc_id % 11 = 0 THEN '' ELSE doc_id::VARCHAR END AS source_id, CASE WHEN doc_id % 11 = 0 OR last IS NULL THEN 0 ELSE 2 END AS image_records,
              CASE WHEN doc_id % 11 = 0 THEN 0 WHEN coalesce(n, 0) > 0 THEN n WHEN last IS NULL THEN 0 ELSE 2 END AS text_records,
              CASE WHEN doc_id % 11 = 0 THEN 'missing_source_data_id' WHEN doc_id % 5 = 0 THEN 'missing_query_image' WHEN doc_id % 5 = 1 THEN 'unusable_query_image' ELSE '' END AS reasons
       FROM documents LEFT JOIN s ON s.conv_id = doc_id LEFT JOIN r ON r.conv_id = doc_id"""
)
def src24_web_search(table: Table) -> DataFrame:
    """Documents as end-to-end rows, conversations as their reranked websites and summaries: the last ranking counts, and summaries before websites."""
    d, c = F.col("doc_id"), table("conversations")
    rows = table("documents").select(
        d.alias("nth"), F.when(d % 11 != 0, d.cast("string")).alias("sample_id"), F.col("text").alias("query"), F.when(d % 5 == 0, F.lit(None).cast("boolean")).otherwise(d % 5 != 1).alias("image_ok"),
        F.col("source").alias("gt_answer"), F.array("lang", "source").alias("alternatives"),
    )
    site = lambda title, snippet: F.struct(title.alias("title"), snippet.alias("snippet"))
    reranked = c.select(F.col("turn").alias("nth"), F.col("conv_id").alias("sample_id"), F.array(site(F.lit("first"), F.col("text")), site(F.lit(" "), F.lit("")), site(F.lit(None).cast("string"), F.lit("third"))).alias("websites"))
    summaries = c.where("turn % 2 = 0 and conv_id % 3 <> 0").select(F.col("turn").alias("nth"), F.col("conv_id").alias("sample_id"), F.when(F.col("turn") % 4 == 0, "").alias("retrieved"), F.when(F.col("turn") % 4 == 0, F.col("text")).alias("original"), F.col("text").alias("snippet"))
    found = A.web_search(rows, reranked, summaries)
    return found.select("nth", "source_id", F.size("image_records").cast("long").alias("image_records"), F.size("text_records").cast("long").alias("text_records"), _reasons().alias("reasons"))


def _variant(**fields: Column) -> Column:
    return F.parse_json(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])))


def _held_out(table: Table, fields: dict, names: dict[str, str]) -> DataFrame:
    """Documents as rows of a held-out source; what is wrong with each goes by its number."""
    d = F.col("doc_id")
    row = {
        names["id"]: F.when(d % 13 != 0, d.cast("string")), names["question"]: F.when(d % 17 != 0, F.concat(F.lit("what says "), "source")), names["answers"]: F.when(d % 19 != 0, F.array(F.col("source"), F.upper("source"))),
        names["image"]: F.when(d % 5 != 0, F.concat(F.lit("img/"), (d * 3).cast("string"))), "license": F.when(d % 23 != 0, F.lit("cc-by")),
        "evidence": F.array(F.struct(F.lit("about").alias("title"), F.when(d % 3 != 0, F.concat(F.lit("it is "), "source")).otherwise("nothing").alias("text"))), "task_type": F.when(d % 29 == 0, "odd").when(d % 2 == 0, "search_free"),
        "eligible_task_types": F.when(d % 31 == 0, F.array(F.lit("odd"))).otherwise(F.array(F.lit("search_free"))),
    }
    rows = A.numbered(table("documents").withColumn("annotation", F.col("lang")), "annotation", "doc_id", _variant(**row))
    images = table("embeddings").select(F.concat(F.lit("img/"), F.col("vec_id").cast("string")).alias("path"), F.sha2(F.col("vec_id").cast("string"), 256).alias("sha256"))
    beside = table("documents").where(d % 6 == 0).select(d.cast("string").alias("source_id"), F.parse_json(F.to_json(F.array(F.concat(F.lit("beside: "), "source"), F.lit("")))).alias("record"))
    return A.held_out(rows, images, beside, fields)


_HELD_OUT = """WITH d AS (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS nth, doc_id % 5 <> 0 AS has_image, doc_id * 3 IN (SELECT vec_id FROM embeddings) AS readable, doc_id % 13 <> 0 AND doc_id % 6 = 0 AS beside FROM documents)
       SELECT lang AS annotation, nth, CASE WHEN doc_id % 13 = 0 THEN '' ELSE doc_id::VARCHAR END AS source_id, 1 + beside::INT AS records,
              array_to_string(list_sort(list_filter([CASE WHEN doc_id % 13 = 0 THEN 'missing_source_data_id' END, CASE WHEN doc_id % 17 = 0 THEN 'empty_question' END, CASE WHEN doc_id % 19 = 0 THEN 'empty_answer' END,
                CASE WHEN NOT has_image THEN 'missing_query_image' WHEN NOT readable THEN 'unreadable_query_image' END, CASE WHEN doc_id % 19 <> 0 AND doc_id % 3 = 0 AND NOT beside THEN 'offline_evidence_answer_unreachable' END,
                CASE WHEN doc_id % 23 = 0 THEN 'missing_license_metadata' END, CASE WHEN {eligible} AND doc_id % 31 = 0 THEN 'invalid_eligible_task_type' END, CASE WHEN {eligible} AND doc_id % 29 = 0 THEN 'invalid_suggested_task_type' END], lambda x: x IS NOT NULL)), ',') AS reasons FROM d"""


def _told(found: DataFrame) -> DataFrame:
    return found.select("annotation", "nth", "source_id", F.size(F.concat("image_records", "text_records")).alias("records"), _reasons().alias("reasons"))


@query(_HELD_OUT.format(eligible="true"))
def src25_web_search_held_out(table: Table) -> DataFrame:
    return _told(_held_out(table, A.MMSEARCH_FIELDS | {"evidence": ()}, {"id": "sample_id", "question": "query", "answers": "gt_answer", "image": "query_image"}))


@query(_HELD_OUT.format(eligible="false"))
def src26_src27_generic_held_out(table: Table) -> DataFrame:
    return _told(_held_out(table, A.FIELDS, {"id": "data_id", "question": "question", "answers": "answers", "image": "image_path"}))


@query(_HELD_OUT.format(eligible="false"))
def src28_info_seek(table: Table) -> DataFrame:
    return _told(_held_out(table, A.INFOSEEK_FIELDS, {"id": "sample_id", "question": "question", "answers": "answer_eval", "image": "image_id"}))


@query(
    """WITH d AS (SELECT doc_id, doc_id % 13 = 0 AS a, doc_id % 17 = 0 AS b, doc_id % 19 = 0 AS c, doc_id % 5 = 0 AS e, doc_id % 23 = 0 AS f, doc_id % 3 = 0 AND (doc_id % 13 = 0 OR doc_id % 6 <> 0) AS g, doc_id * 3 NOT IN (SELECT vec_id FROM embeddings) AS h FROM documents),
            r AS (SELECT doc_id, unnest(list_filter([CASE WHEN a THEN 'missing_source_data_id' END, CASE WHEN b THEN 'empty_question' END, CASE WHEN c THEN 'empty_answer' END, CASE WHEN e THEN 'missing_query_image' WHEN h THEN 'unreadable_query_image' END,
                  CASE WHEN NOT c AND g THEN 'offline_evidence_answer_unreachable' END, CASE WHEN f THEN 'missing_license_metadata' END], lambda x: x IS NOT NULL)) AS reason FROM d)
       SELECT reason, count(*) AS rows FROM (SELECT reason FROM r UNION ALL SELECT 'accepted' FROM d WHERE doc_id NOT IN (SELECT doc_id FROM r)) GROUP BY reason"""
)
def src27_rejection_counts(table: Table) -> DataFrame:
    """How many rows each reason rejects, and how many are accepted."""
    return A.rejections(_held_out(table, A.FIELDS, {"id": "data_id", "question": "question", "answers": "answers", "image": "image_path"}))


@query(
    """SELECT conv_id, list_sort(list(text) FILTER (turn < 3 AND text <> '')) AS websites FROM conversations GROUP BY conv_id HAVING count(*) FILTER (turn < 3 AND text <> '') > 0"""
)
def src51_prepared_rows(table: Table) -> DataFrame:
    """The websites of archive rows, whichever of their fields hold them."""
    fields = F.map_from_entries(F.collect_list(F.struct(F.when(F.col("turn") < 3, F.concat(F.lit("Website"), F.col("turn").cast("string"), F.lit("_info"))).otherwise(F.concat(F.lit("other"), F.col("turn").cast("string"))), "text")))
    rows = table("conversations").groupBy("conv_id").agg(F.parse_json(F.to_json(fields)).alias("row"))
    found = rows.select("conv_id", A.with_websites(F.col("row")).alias("w")).where("w is not null")
    return found.select("conv_id", F.array_sort(F.transform("w", lambda x: F.try_variant_get(x, "$", "string"))).alias("websites"))


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' WHEN 2 THEN 'test' ELSE 'unknown' END AS split, 1 + (doc_id % 2) AS aliases, 'oven_' || doc_id AS image_id FROM documents"""
)
def src52_normalised_annotations(table: Table) -> DataFrame:
    """Documents as annotations whose split stands in the row, in the file's name, or nowhere."""
    d = F.col("doc_id")
    row = _variant(split=F.when(d % 4 == 0, "Train"), data_id=d.cast("string"), answer_eval=F.when(d % 2 == 1, F.array("lang", F.col("source"), F.upper("lang"))), answer=F.array("source"), image_id=F.concat(F.lit("oven_"), d.cast("string")))
    name = F.when(d % 4 == 1, "infoseek_val_withkb.jsonl").when(d % 4 == 2, "x/infoseek_test.jsonl").otherwise("annotations.jsonl")
    rows = table("documents").select("doc_id", row.alias("row"), name.alias("annotation"))
    aliases = F.when(F.size(A.answer_texts(F.col("row"), ("answer_eval",))) > 0, A.answer_texts(F.col("row"), ("answer_eval",))).otherwise(A.answer_texts(F.col("row"), ("answer",)))
    return rows.select("doc_id", A.split_of(F.col("row"), F.col("annotation")).alias("split"), F.size(aliases).cast("long").alias("aliases"), A.text_field(F.col("row"), ("image_id",)).alias("image_id"))


@query("SELECT 'corpus' AS part, count(*) AS rows, 0 AS violations FROM documents UNION ALL SELECT 'images', count(*), 0 FROM documents WHERE doc_id * 3 IN (SELECT vec_id FROM embeddings)")
def src50_frozen_environment(table: Table) -> DataFrame:
    """A frozen environment: corpus and image results written and committed, opened only if every file is as it was, and read."""
    d = table("documents")
    shown = table("embeddings").select((F.col("vec_id") / 3).alias("doc_id")).where("doc_id = floor(doc_id)").select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(True).alias("shown"))
    rows = d.join(shown, "doc_id", "left")
    path = fresh_folder(d, "environment")
    R.write_release(rows, {"corpus": (F.lit(True), ["doc_id", "text"]), "images": (F.col("shown"), ["doc_id", "source"])}, path, {"version": "1"})
    bad = R.verify_release(d.sparkSession, path, facts={"version": "1"})
    if (fault := bad.first()) is not None:
        raise ValueError(f"{fault['part']}: {fault['rule']}")
    parts = [R.read_part(d.sparkSession, path, p, "doc_id long").select(F.lit(p).alias("part"), "doc_id") for p in ("corpus", "images")]
    return parts[0].unionByName(parts[1]).groupBy("part").agg(F.count("doc_id").alias("rows"), F.lit(0).alias("violations"))
