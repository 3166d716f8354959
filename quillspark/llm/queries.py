"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import licence_scan
from quillspark.llm.anisotropic_search import search
from quillspark.llm.chat_formatting import canonical_turns, format_turns, read_back, records_of
from quillspark.llm.common import checkpointed, rows_of
from quillspark.llm.exact_dedup import exact_duplicates
from quillspark.llm.fair_mixing import weighted_fair_mix
from quillspark.llm.fill_in_middle import infill, original
from quillspark.llm.html_layout import extract
from quillspark.llm.merkle_fixity import fixity, warc_record
from quillspark.llm.noisy_channel_toxicity import score_toxicity
from quillspark.llm.pii_surrogates import surrogates
from quillspark.llm.simhash_dedup import near_components
from quillspark.llm.slack_packing import pack
from quillspark.llm.source_audit import divergence


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_anisotropic_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(_table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)


def op2_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get("spark.quillspark.surrogateKey", "an example, not a secret")
    replaced = surrogates(_table(spark, sf_dir, "documents"), key)
    kinds = F.array_join(F.transform("entities", lambda e: e["kind"]), ",")
    return replaced.select("doc_id", "text", F.size("entities").alias("n_entities"), kinds.alias("kinds"))


def op4_simhash_bitslice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(_table(spark, sf_dir, "documents"))


def op5_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"))


def op6_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_chunk_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_table(spark, sf_dir, "documents"))


def warc_replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Two replicas of the WARC archives of ``pages``, 512 pages each, with offsets of their own; the second has known damage.

    Pages of number 7 mod 1009 have lost the record's last character, those of 5 mod 2003 are
    missing, and of those of 11 mod 307 the last character is another.
    """
    record, number = warc_record(F.col("page_id"), F.col("url"), F.col("html")), F.col("page_id")
    bare = F.left(record, F.length(record) - 1)
    damaged = F.when(number % 1009 == 7, bare).when(number % 307 == 11, F.concat(bare, F.lit("!"))).otherwise(record)
    archive = F.when(number.isNotNull(), F.format_string("pages-%06d.warc", F.floor(number / 512))).otherwise("pages-unnumbered.warc")
    hashed = checkpointed(pages.select(
        number.cast("long").alias("page_id"), archive.alias("archive"), F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("digest"),
        F.octet_length(damaged).cast("long").alias("damaged_length"), F.sha2(damaged, 256).alias("damaged_digest"),
    ))
    first = hashed.select("page_id", "archive", "length", "digest")
    second = hashed.where("page_id is null or page_id % 2003 <> 5").select("page_id", "archive", F.col("damaged_length").alias("length"), F.col("damaged_digest").alias("digest"))
    before = Window.partitionBy("archive").orderBy("page_id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = [checkpointed(r.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))) for r in (first, second)]
    return tuple(r.withColumn("record_id", F.col("page_id").cast("string")) for r in placed)


def op8_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = warc_replicas(_table(spark, sf_dir, "pages"))
    return fixity(first, second).select("page_id", "archive", "offset", "length", "digest", "status")


def op9_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_fair_mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_licence_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licence_scan.scan(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(_table(spark, sf_dir, "documents"))


def op12_streaming_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill(_table(spark, sf_dir, "documents"))
    digests = [F.sha2(c, 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (original(F.col("output"), F.col("form")), "restored_sha256"))]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


#: A conversation of control strings, in another layout than the table's rows.
CONTROL_RECORD = json.dumps({"conv_id": -7, "messages": [{"role": role, "content": "\\### Assistant: </turn> ok"} for role in ("user", "assistant")]})


def op13_schema_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records_of(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    records = rows.unionByName(rows_of(spark, [(-7, 0, CONTROL_RECORD)], "conv_id long, place long, record string"))
    return read_back(format_turns(canonical_turns(records)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_anisotropic_search, op2_html_layout, op3_pii_surrogates, op4_simhash_bitslice, op5_minimum_bin_slack,
        op6_noisy_channel_toxicity, op7_chunk_recipes, op8_merkle_fixity, op9_fair_queueing, op10_licence_digests,
        op11_source_divergence, op12_streaming_infill, op13_schema_chat,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op8_merkle_fixity": r"""
        WITH records AS (
            SELECT page_id, url, coalesce(html, '') AS body FROM pages),
        written AS (
            SELECT page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
                   || 'WARC-Record-ID: <urn:record:' || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
                   || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(body)) || chr(13) || chr(10) || chr(13) || chr(10)
                   || body || chr(13) || chr(10) || chr(13) || chr(10) AS record
            FROM records),
        placed AS (
            SELECT page_id, coalesce('pages-' || lpad((page_id // 512)::VARCHAR, 6, '0') || '.warc', 'pages-unnumbered.warc') AS archive, record,
                   CASE WHEN page_id % 1009 = 7 THEN left(record, length(record) - 1) WHEN page_id % 307 = 11 THEN left(record, length(record) - 1) || '!' ELSE record END AS other
            FROM written),
        hashed AS (
            SELECT page_id, archive, octet_length(encode(record))::BIGINT AS length, sha256(record) AS digest, octet_length(encode(other))::BIGINT AS other_length, sha256(other) AS other_digest FROM placed),
        one AS (
            SELECT *, coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM hashed),
        two AS (
            SELECT page_id, archive, coalesce(sum(other_length) OVER (PARTITION BY archive ORDER BY page_id, other_digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS other_offset
            FROM hashed WHERE page_id IS NULL OR page_id % 2003 <> 5)
        SELECT page_id, archive, "offset", length, digest,
               CASE WHEN other_offset IS NULL THEN 'missing' WHEN digest <> other_digest THEN 'corrupt' WHEN "offset" <> other_offset THEN 'moved' ELSE 'intact' END AS status
        FROM one LEFT JOIN two USING (page_id, archive)""",
    "op10_licence_digests": licence_scan.oracle_sql(),
    "op7_chunk_recipes": r"""
        WITH plain AS (
            SELECT doc_id, length(coalesce(text, '')) AS n_points,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents),
        ranked AS (
            SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_points DESC, doc_id) AS keep_id
            FROM plain)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked""",
    "op11_source_divergence": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
        found AS (
            SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
        kept AS (
            SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
        used AS (
            SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        langs AS (
            SELECT lang, count(*) AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
        groups AS (
            SELECT lang, source, coalesce(sum(u.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN used u USING (lang, source) GROUP BY lang, source),
        shares AS (
            SELECT g.lang, g.source, k.term, coalesce(u.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(u.n, 0) + 1)) // (g.n + l.v) AS p
            FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN used u ON u.lang = g.lang AND u.source = g.source AND u.term = k.term),
        pairs AS (
            SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        every AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
        whole AS (
            SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (k.n + 1)) // (l.n + l.v) AS q FROM kept k JOIN langs l USING (lang)),
        terms AS (
            SELECT s.lang, s.source, 'term' AS part, s.term AS item, ((p - q) * (p - q)) // q AS value FROM shares s JOIN whole w ON s.lang = w.lang AND s.term = w.term WHERE s.n > 0 AND p > q)
        SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
        FROM (SELECT * FROM every UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 200""",
    "op12_streaming_infill": r"""
        WITH drawn AS (
            SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h,
                   regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
            FROM documents),
        ranks AS (
            SELECT *, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(units) + 1) AS one, ('0x' || h[9:16])::BIGINT % (len(units) + 1) AS two,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 100 THEN 'plain'
                        WHEN ('0x' || h[25:32])::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM drawn),
        parts AS (
            SELECT *, array_to_string(units[1:least(one, two)], '') AS prefix, array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS middle,
                   array_to_string(units[greatest(one, two) + 1:], '') AS suffix
            FROM ranks)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM parts""",
    "op13_schema_chat": r"""
        WITH turns AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
        written AS (
            SELECT *, length(text) + len(regexp_extract_all(text, '\\|###|</turn>'))
                      + CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) ELSE 1 + length(role) + len(regexp_extract_all(role, '\\|###|</turn>|:')) END + 14 AS chars
            FROM turns)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
        FROM written GROUP BY conv_id""",
}
