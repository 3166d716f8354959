"""Source adapters: rows of any layout become candidates, or rejected rows with every reason.

A source's rows are VARIANT values under an annotation's name and their number there.  A
layout is a map from what is wanted to where a row may have it.  Images and evidence are
tables that rows are joined with, so nothing is read row by row; every row comes out once.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.episodes import unique_aliases
from quillspark.operators.exchange import settled, skew_join

# Kinds of tasks, fields of a layout by default, keys of a record's text, and websites of a row.
TASK_TYPES = ("search_free", "visual_search_required", "text_search_required", "mixed_search_required")
FIELDS = {
    "source_id": ("source_data_id", "data_id", "id"), "question": ("question", "query"), "answers": ("answer_aliases", "answers", "answer", "original_answer"),
    "query_image": ("query_image", "image_path", "image"), "image_evidence": (), "text_evidence": (), "evidence": ("offline_evidence_records", "evidence"),
    "license": ("license",), "eligible_task_types": (), "task_type": (), "split": ("split",),
}
MMSEARCH_FIELDS = FIELDS | {
    "source_id": ("sample_id", "source_data_id", "id"), "question": ("query", "question"), "answers": ("alternative_gt_answers", "answer_aliases", "gt_answer"), "query_image": ("query_image",),
    "image_evidence": ("image_search_records",), "text_evidence": ("offline_evidence_records", "text_corpus_records", "evidence"), "task_type": ("task_type",), "eligible_task_types": ("eligible_task_types",),
}
INFOSEEK_FIELDS = FIELDS | {"source_id": ("data_id", "sample_id"), "answers": ("answer_eval", "answer"), "query_image": ("image_id",)}
RECORD_KEYS = ("title", "snippet", "text", "content")
WEBSITES = 8

_NONE = "array<string>"


def _at(row: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(row, "$." + ".".join(path.split(".")), kind)


def _kind(value: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0), F.lit("VOID"))


def _is_there(value: Column) -> Column:
    """Whether a VARIANT value is there: neither null nor an empty text."""
    return value.isNotNull() & ~((_kind(value) == "VOID") | ((_kind(value) == "STRING") & (F.coalesce(F.try_variant_get(value, "$", "string"), F.lit("")) == "")))


def field(row: Column, paths: tuple[str, ...]) -> Column:
    """The first value of a row (VARIANT) that is there at one of the dotted paths."""
    found = [F.when(_is_there(_at(row, p, "variant")), _at(row, p, "variant")) for p in paths]
    return F.coalesce(*found) if found else F.lit(None).cast("variant")


def text_field(row: Column, paths: tuple[str, ...]) -> Column:
    """That value as a text, without outer blanks; "" for none."""
    return F.coalesce(F.regexp_replace(F.try_variant_get(field(row, paths), "$", "string"), r"^\s+|\s+$", ""), F.lit(""))


def _items(value: Column) -> Column:
    """The items of a VARIANT array; another value is its only item; null has none."""
    one = F.when(_is_there(value), F.array(value)).otherwise(F.array().cast("array<variant>"))
    return F.when(_kind(value) == "ARRAY", F.try_variant_get(value, "$", "array<variant>")).otherwise(one)


def record_texts(value: Column) -> Column:
    """Texts of a record, a text, or a list of them: a record's title, snippet, text and content, joined; empty ones are none."""
    trimmed = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"^\s+|\s+$", "")

    def text(item: Column) -> Column:
        parts = F.filter(F.array(*[trimmed(F.try_variant_get(item, f"$.{k}", "string")) for k in RECORD_KEYS]), lambda p: p != "")
        return F.when(_kind(item) == "OBJECT", F.array_join(parts, " | ")).otherwise(trimmed(F.try_variant_get(item, "$", "string")))

    return F.filter(F.transform(_items(value), text), lambda t: t != "")


def answer_texts(row: Column, paths: tuple[str, ...]) -> Column:
    """The answers of a row at all of the paths: lists, texts that are JSON lists, and single values; each once, but for case."""
    each = []
    for path in paths:
        value = field(row, (path,))
        listed = F.try_parse_json(F.when(_kind(value) == "STRING", F.try_variant_get(value, "$", "string")))
        each.append(_items(F.when(_kind(listed) == "ARRAY", listed).otherwise(value)))
    texts = F.transform(F.concat(*each), lambda x: F.try_variant_get(x, "$", "string"))
    return unique_aliases(texts)


def numbered(rows: DataFrame, annotation: str, order: str, row: Column) -> DataFrame:
    """annotation, nth (from 0), row of the rows of each annotation in the order of a column."""
    nth = F.row_number().over(Window.partitionBy(annotation).orderBy(order)) - 1
    return rows.select(F.col(annotation).alias("annotation"), nth.cast("long").alias("nth"), row.alias("row"))


def _reachable(aliases: Column, records: Column) -> Column:
    """Whether a normalised record contains a normalised alias."""
    held = F.transform(records, lambda r: T.evaluation_answer(r))
    return F.exists(aliases, lambda a: (T.evaluation_answer(a) != "") & F.exists(held, lambda r: F.contains(r, T.evaluation_answer(a))))


def held_out(
    rows: DataFrame, images: DataFrame, evidence: DataFrame | None = None, fields: Mapping[str, tuple[str, ...]] = FIELDS, licence: str = "", evidence_mode: str = "text"
) -> DataFrame:
    """annotation, nth, source_id, question, aliases, image, image_records, text_records, licence, task_type, eligible, split, reasons of rows (annotation, nth, row) of a held-out source.

    ``images`` (path, sha256) are the images that can be read, ``evidence`` (source_id, record:
    VARIANT) what lies beside the rows, of the kind ``evidence_mode``: image, text or both.
    Accepted rows have no reasons; others all of theirs, sorted: missing_source_data_id,
    empty_question, empty_answer, missing_query_image, unreadable_query_image,
    offline_evidence_missing, offline_evidence_answer_unreachable, missing_license_metadata,
    invalid_eligible_task_type, invalid_suggested_task_type.
    """
    row = F.col("row")
    image = field(row, fields["query_image"])
    path = F.when(_kind(image) == "OBJECT", F.try_variant_get(image, "$.path", "string")).otherwise(F.try_variant_get(image, "$", "string"))
    eligible = F.when(_kind(field(row, fields["eligible_task_types"])) == "ARRAY", F.transform(_items(field(row, fields["eligible_task_types"])), lambda x: F.try_variant_get(x, "$", "string"))).otherwise(F.array().cast(_NONE))
    own = rows.select(
        "annotation", "nth", text_field(row, fields["source_id"]).alias("source_id"), text_field(row, fields["question"]).alias("question"), answer_texts(row, fields["answers"]).alias("aliases"),
        image.isNull().alias("_no_image"), path.alias("image"), record_texts(field(row, fields["image_evidence"])).alias("_image_records"), record_texts(field(row, fields["text_evidence"])).alias("_text_records"),
        record_texts(field(row, fields["evidence"])).alias("_own"), F.coalesce(F.nullif(text_field(row, fields["license"]), F.lit("")), F.lit(licence)).alias("licence"),
        F.nullif(text_field(row, fields["task_type"]), F.lit("")).alias("task_type"), eligible.alias("eligible"), F.nullif(text_field(row, fields["split"]), F.lit("")).alias("split"),
    )
    known = skew_join(own, images.select(F.col("path").alias("image"), F.col("sha256").alias("_sha256")).dropDuplicates(["image"]), ["image"], "left")
    if evidence is not None:
        beside = evidence.select("source_id", F.posexplode(record_texts(F.col("record"))).alias("at", "text"))
        lists = beside.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("_beside"))
        known = skew_join(known, lists, ["source_id"], "left")
    more = F.concat("_own", F.coalesce("_beside", F.array().cast(_NONE))) if evidence is not None else F.col("_own")
    none = F.array().cast(_NONE)
    known = known.withColumn("image_records", F.concat("_image_records", more if evidence_mode in ("image", "both") else none)).withColumn("text_records", F.concat("_text_records", more if evidence_mode in ("text", "both") else none))
    records = F.concat("image_records", "text_records")
    rules = {
        "missing_source_data_id": F.col("source_id") == "", "empty_question": F.col("question") == "", "empty_answer": F.size("aliases") <= 0,
        "missing_query_image": F.col("_no_image"), "unreadable_query_image": ~F.col("_no_image") & F.col("_sha256").isNull(),
        "offline_evidence_missing": F.size(records) <= 0, "offline_evidence_answer_unreachable": (F.size(records) > 0) & (F.size("aliases") > 0) & ~_reachable(F.col("aliases"), records),
        "missing_license_metadata": F.col("licence") == "", "invalid_eligible_task_type": F.exists("eligible", lambda x: ~F.coalesce(x.isin(*TASK_TYPES), F.lit(False))),
        "invalid_suggested_task_type": F.col("task_type").isNotNull() & ~F.col("task_type").isin(*TASK_TYPES),
    }
    reasons = F.array_sort(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))
    return known.select("annotation", "nth", "source_id", "question", "aliases", F.col("_sha256").alias("image"), "image_records", "text_records", "licence", "task_type", "eligible", "split", reasons.alias("reasons"))


def vqa_test(rows: DataFrame, titles: DataFrame) -> DataFrame:
    """nth, source_id, question, aliases, task_type, records, reasons of records (nth, data_id, prompt, n_images, ground_truth, candidate_answers, category).

    ``titles`` (data_id, nth, title) are a search's usable results.  Reasons: missing_source_data_id,
    missing_or_ambiguous_query_image.  A category that says nothing of searching leaves task_type null.
    """
    key = F.regexp_replace(F.coalesce(F.col("data_id").cast("string"), F.lit("")), r"^\s+|\s+$", "")
    listed = F.try_parse_json("candidate_answers")
    others = F.when(_kind(listed) == "ARRAY", F.transform(F.try_variant_get(listed, "$", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))).when(listed.isNull() & (F.trim("candidate_answers") != ""), F.array("candidate_answers"))
    category = F.replace(F.lower(F.coalesce("category", F.lit(""))), F.lit("-"), F.lit("_"))
    shown = titles.where(F.trim("title") != "").groupBy(F.col("data_id").cast("string").alias("source_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "title"))), lambda x: x["title"]).alias("_records"))
    found = rows.select(
        "nth", key.alias("source_id"), F.col("prompt").alias("question"), unique_aliases(F.concat(F.array("ground_truth"), F.coalesce(others, F.array().cast(_NONE)))).alias("aliases"),
        F.when(category == "search_free", "search_free").when(category == "search_required", "visual_search_required").alias("task_type"),
        F.array_compact(F.array(F.when(key == "", "missing_source_data_id"), F.when(F.coalesce("n_images", F.lit(0)) != 1, "missing_or_ambiguous_query_image"))).alias("reasons"),
    )
    return skew_join(found, shown, ["source_id"], "left").select("nth", "source_id", "question", "aliases", "task_type", F.coalesce("_records", F.array().cast(_NONE)).alias("records"), "reasons")


def web_search(rows: DataFrame, reranked: DataFrame, summaries: DataFrame) -> DataFrame:
    """nth, source_id, question, aliases, image_records, text_records, reasons of end-to-end rows (nth, sample_id, query, image_ok, gt_answer, alternatives).

    ``reranked`` (nth, sample_id, websites: array of struct<title, snippet>): the last row of
    a sample counts.  ``summaries`` (nth, sample_id, retrieved, original, snippet): the first text of each,
    in order; a sample without any has its websites' texts.  image_ok is null for no image.
    """
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    key = trimmed(F.col("sample_id").cast("string"))
    site = lambda w: F.array_join(F.filter(F.array(trimmed(w["title"]), trimmed(w["snippet"])), lambda x: x != ""), " | ")
    sites = F.filter(F.transform(F.slice("websites", 1, WEBSITES), site), lambda x: x != "")
    last = reranked.groupBy(key.alias("source_id")).agg(F.max_by(F.coalesce(sites, F.array().cast(_NONE)), "nth").alias("_sites"))
    first = trimmed(F.coalesce(F.nullif("retrieved", F.lit("")), F.nullif("original", F.lit("")), F.col("snippet")))
    texts = summaries.select(key.alias("source_id"), "nth", first.alias("text")).where("text <> ''").groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]).alias("_texts"))
    reasons = F.when(key == "", F.array(F.lit("missing_source_data_id"))).when(F.col("image_ok").isNull(), F.array(F.lit("missing_query_image"))).when(~F.col("image_ok"), F.array(F.lit("unusable_query_image"))).otherwise(F.array().cast(_NONE))
    own = rows.select("nth", key.alias("source_id"), trimmed(F.col("query")).alias("question"), unique_aliases(F.concat(F.array("gt_answer"), F.coalesce("alternatives", F.array().cast(_NONE)))).alias("aliases"), reasons.alias("reasons"))
    both = skew_join(skew_join(own, last, ["source_id"], "left"), texts, ["source_id"], "left").withColumn("image_records", F.coalesce("_sites", F.array().cast(_NONE)))
    return both.select("nth", "source_id", "question", "aliases", "image_records", F.coalesce("_texts", "image_records").alias("text_records"), "reasons")


def with_websites(row: Column) -> Column:
    """The websites of a row (VARIANT): values of fields that begin with "website" and of known lists, in the order of their names; null for none."""
    fields = F.map_entries(F.try_variant_get(row, "$", "map<string,variant>"))
    named = F.filter(fields, lambda e: (F.lower(e["key"]).startswith("website") | F.lower(e["key"]).isin("search_results", "retrieved_websites", "rerank_results")) & _is_there(e["value"]) & ~F.to_json(e["value"]).isin("[]", "{}"))
    return F.when(F.size(named) > 0, F.transform(named, lambda e: e["value"]))


def split_of(row: Column, annotation: Column) -> Column:
    """The split that a row names, or else its annotation's file name; "unknown" for none."""
    said = F.lower(text_field(row, ("data_split", "split")))
    name = F.lower(F.element_at(F.split(annotation, "/"), -1))
    named = F.coalesce(*[F.when(F.contains(name, F.lit(s)), F.lit(s)) for s in ("human", "test", "val", "train")], F.lit("unknown"))
    return F.when(said == "", named).when(F.contains(said, F.lit("human")), "human").otherwise(said)


def rejections(scanned: DataFrame) -> DataFrame:
    """reason, rows of a scan's rejected rows, and a row "accepted": with them every row is accounted for."""
    reason = F.explode(F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("accepted"))))
    return scanned.select(reason.alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("rows"))


def union(*scans: DataFrame) -> DataFrame:
    return settled(reduce(DataFrame.unionByName, scans))
