"""Queries of retrieval and evidence (RET, TOP)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import compaction as C
from quillspark.operators import retrieval as R
from quillspark.operators.token_windows import token_windows
from quillspark.plans.declare import Table, query


def _ascii(text: Column) -> Column:
    return T.all_matches(F.lower(text), "[a-z0-9]+")


def bm25_sql(where: str = "", corpus: str = "documents", queries: str = "benchmark", qid: str = "item_id", did: str = "doc_id") -> str:
    return rf"""
        q AS (SELECT {qid} AS qid, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS term FROM {queries}),
        d AS (SELECT {did} AS did, regexp_extract_all(lower(text), '[a-z0-9]+') AS tok FROM {corpus}),
        st AS (SELECT count(*) AS n, avg(len(tok)) AS mean FROM d),
        p AS (SELECT did, len(tok) AS len, unnest(tok) AS term FROM d),
        tf AS (SELECT did, len, term, count(*) AS tf FROM p GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
        s AS (SELECT qid, did, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
              FROM q JOIN tf USING (term) JOIN df USING (term), st {where} GROUP BY qid, did HAVING score > 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS rank FROM s)"""


@query(f"WITH {bm25_sql()} SELECT qid AS item_id, did AS doc_id, score, rank::INT AS rank FROM r WHERE rank <= 3")
def ret01_bm25_top3(table: Table) -> DataFrame:
    return R.bm25_top(table("benchmark"), table("documents"), _ascii, "item_id", "doc_id", 3)


@query(
    f"""WITH {bm25_sql()}, keep AS (SELECT r.*, row_number() OVER (PARTITION BY qid ORDER BY score DESC, did) AS k FROM r
          JOIN documents ON did = doc_id WHERE source <> 'src' || (qid % 20)) SELECT qid AS item_id, did AS doc_id, score, k::INT AS rank FROM keep WHERE k <= 3"""
)
def ret03_leave_one_source_out(table: Table) -> DataFrame:
    asked = table("benchmark").withColumn("own", F.concat(F.lit("src"), F.col("item_id") % 20))
    return R.bm25_top(asked, table("documents"), _ascii, "item_id", "doc_id", 3, apart=("own", "source"))


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda t: t <> '') AS w FROM documents),
        k AS (SELECT doc_id, w, unnest(range(0, greatest(0, ceil((len(w) - 320) / 272.0))::INT + 1)) AS k FROM w WHERE len(w) > 0)
        SELECT doc_id, k::INT AS chunk, array_to_string(w[k * 272 + 1 : k * 272 + 320], ' ') AS text FROM k"""
)
def ret04_word_chunks(table: Table) -> DataFrame:
    worded = table("documents").select("doc_id", R.spaced_words(F.col("text")).alias("w"))
    chunks = worded.select("doc_id", F.posexplode(R.word_chunks(F.col("w"))).alias("chunk", "c"))
    return chunks.select("doc_id", "chunk", F.col("c.text").alias("text"))


@query()
def ret06_token_windows(table: Table) -> DataFrame:
    """Windows of 384 tokens of the pages' lines, 64 shared; 64 windows a page are the feature."""
    import public_tokenizers

    lines = table("pages").select("page_id", T.html_lines(F.col("html")).alias("text"))
    cut = lines.select("page_id", F.posexplode(token_windows(F.col("text"), str(public_tokenizers.path("byte_bpe_50k.json")))).alias("nth", "w"))
    return cut.select("page_id", "nth", "w.start", "w.tokens", "w.text")


def _page_chunks(table: Table) -> DataFrame:
    worded = table("pages").select("page_id", R.spaced_words(T.html_lines(F.col("html"))).alias("w"))
    lines = worded.select("page_id", F.posexplode(R.word_chunks(F.col("w"), 60, 10)).alias("chunk", "c"))
    return lines.select(F.col("page_id"), (F.col("page_id") * 100_000 + F.col("chunk")).alias("chunk_id"), F.col("c.text").alias("text"))


@query()
def ret05_chunks_of_request(table: Table) -> DataFrame:
    """Each page is a request of its own: its chunks that say most of the whole page come first."""
    chunks = _page_chunks(table)
    asked = table("pages").select("page_id", F.col("page_id").alias("query_id"), T.html_lines(F.col("html")).alias("text"))
    return R.top_k(R.bm25(asked, chunks, _ascii, "query_id", "chunk_id", within="page_id"), "query_id", 2, "chunk_id")


@query(
    """WITH q AS (SELECT vec_id AS query_id, embedding AS e, label FROM embeddings WHERE vec_id % 25 = 0),
       s AS (SELECT query_id, v.vec_id, round(list_dot_product(e::DOUBLE[], v.embedding::DOUBLE[]) / sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[]) * list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[])), 9) AS score
             FROM q JOIN embeddings v ON q.label = v.label AND v.vec_id <> query_id)
       SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r = 1"""
)
def ret07_top07_dense_best(table: Table) -> DataFrame:
    v = table("embeddings")
    asked = v.where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), "label")
    return R.nearest_of_group(v, asked, "label")


@query(
    r"""SELECT conv_id, string_agg((turn + 1) || '. ' || regexp_replace(text, '\n', ' ', 'g'), chr(10) ORDER BY turn) AS block, count(*)::INT AS parsed FROM conversations GROUP BY conv_id"""
)
def ret15_ret16_ret17_ret18_ranked_lines(table: Table) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("turn", F.regexp_replace("text", "\n", " ").alias("text"))))
    c = table("conversations").groupBy("conv_id").agg(R.ranked_lines(F.transform(ordered, lambda x: x["text"])).alias("block"))
    return c.withColumn("parsed", F.size(R.parsed_ranked_lines(F.col("block"))))


@query(
    r"""WITH p AS (SELECT item_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS needle FROM benchmark WHERE len(regexp_extract_all(lower(text), '[a-z0-9]+')) >= 2),
        d AS (SELECT doc_id, ' ' || array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ') || ' ' AS hay FROM documents)
        SELECT item_id, min(doc_id) AS doc_id FROM p JOIN d ON contains(hay, needle) GROUP BY item_id"""
)
def ret22_phrase_coverage(table: Table) -> DataFrame:
    phrases = table("benchmark").select("item_id", F.array_join(_ascii(F.col("text")), " ").alias("phrase"))
    return R.phrase_coverage(phrases, table("documents"), _ascii, "item_id", "doc_id")


@query(
    f"""WITH {bm25_sql()}, hit AS (SELECT r.*, contains(lower(text), 'the') AS good FROM r JOIN documents ON did = doc_id WHERE rank <= 5)
        SELECT qid AS item_id, round(coalesce(max(CASE WHEN good THEN 1.0 / rank END), 0), 6) AS utility, min(CASE WHEN good THEN rank END)::INT AS best_rank FROM hit GROUP BY qid"""
)
def ret23_top10_rank_utility(table: Table) -> DataFrame:
    best = R.bm25_top(table("benchmark"), table("documents"), _ascii, "item_id", "doc_id", 5)
    hits = best.join(table("documents").select("doc_id", F.contains(F.lower("text"), F.lit("the")).alias("good")), "doc_id")
    gain = F.when(F.col("good"), 1 / F.col("rank"))
    return hits.groupBy("item_id").agg(F.round(F.coalesce(F.max(gain), F.lit(0.0)), 6).alias("utility"), F.min(F.when(F.col("good"), F.col("rank"))).alias("best_rank"))


@query(
    """SELECT doc_id, (CASE WHEN contains(lower(text), 'the') THEN 4 ELSE 0 END + CASE WHEN lang = 'en' THEN 2 ELSE 0 END + CASE WHEN n_chars > 500 THEN 1 ELSE 0 END)::INT AS score FROM documents"""
)
def ret26_weighted_evidence(table: Table) -> DataFrame:
    tests = [(F.contains(F.lower("text"), F.lit("the")), 4), (F.col("lang") == "en", 2), (F.col("n_chars") > 500, 1)]
    return table("documents").select("doc_id", sum((F.when(c, w).otherwise(0) for c, w in tests), F.lit(0)).alias("score"))


@query(
    r"""SELECT doc_id, p.i::INT AS paragraph, p.t AS text FROM (SELECT doc_id, unnest(list_transform(list_filter(list_transform(string_split_regex(text, '\n'), lambda t, i: {'i': i - 1, 't': trim(t)}), lambda x: x.t <> ''), lambda x: {'i': x.i, 't': x.t})) AS p FROM documents)"""
)
def ret24_ret25_paragraphs(table: Table) -> DataFrame:
    lines = table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("paragraph", "t"))
    return lines.where(F.trim("t") != "").select("doc_id", "paragraph", F.trim("t").alias("text"))


@query()
def ret08_sentences(table: Table) -> DataFrame:
    split = table("documents").select("doc_id", F.posexplode(C.sentences(F.col("text"))).alias("nth", "sentence"))
    return split


@query()
def ret09_ret10_ret11_compact_evidence(table: Table) -> DataFrame:
    """The three best documents of each benchmark item, cut to the rank's budget at sentence ends."""
    best = R.bm25_top(table("benchmark"), table("documents"), _ascii, "item_id", "doc_id", 3)
    texts = best.join(table("documents").select("doc_id", "text"), "doc_id").join(table("benchmark").select("item_id", F.col("text").alias("question")), "item_id")
    cut = texts.select("item_id", "rank", C.compacted(C.sentences(F.col("text")), T.content_words(F.col("question")), F.col("rank")).alias("evidence"))
    ranked = cut.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "evidence"))), lambda x: x["evidence"]).alias("evidence"))
    return ranked.select("item_id", C.within_cap("evidence", F.lit(C.CAP)).alias("evidence"))


@query(
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, 'https?://\S+', '', 'g'), '</?[a-z_]+>', '', 'g'), '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g') AS safe,
               len(regexp_extract_all(text, 'https?://\S+'))::INT AS urls, len(regexp_extract_all(regexp_replace(text, 'https?://\S+', '', 'g'), '</?[a-z_]+>'))::INT AS tags FROM documents"""
)
def ret14_sanitised(table: Table) -> DataFrame:
    return table("documents").select("doc_id", *C.sanitised(F.col("text")))


@query()
def ret12_ret13_hybrid_evidence(table: Table) -> DataFrame:
    """An anchor from the best document of each benchmark item, evidence from the next two, within 450 characters."""
    best = R.bm25_top(table("benchmark"), table("documents"), _ascii, "item_id", "doc_id", 3)
    texts = best.join(table("documents").select("doc_id", "text"), "doc_id").groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("t"))
    cut = texts.select("item_id", C.sentences(F.col("t")[0]).alias("long"), C.sentences(F.array_join(F.slice("t", 2, 2), " ")).alias("short"))
    return cut.select("item_id", C.hybrid("long", "short", F.lit(450)).alias("evidence"))


@query(
    """SELECT rank, l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_quantity DESC, l_discount DESC, l_tax, l_extendedprice DESC, l_orderkey, l_linenumber)::INT AS rank FROM lineitem) WHERE rank <= 10"""
)
def top02_top03_top04_top05_checkpoint_ranking(table: Table) -> DataFrame:
    order = [F.desc("l_quantity"), F.desc("l_discount"), F.col("l_tax"), F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")]
    best = table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax", "l_extendedprice").orderBy(*order).limit(10)
    # The ten are ranked after the limit, so the window never sees more.
    return best.select(F.row_number().over(Window.orderBy(*order)).alias("rank"), "l_orderkey", "l_linenumber")


@query(
    """SELECT c_custkey, r::INT AS rank FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY coalesce(p, 99), c_custkey) AS r
         FROM customer LEFT JOIN (SELECT n_nationkey, n_regionkey AS p FROM nation WHERE n_regionkey < 3) ON c_nationkey = n_nationkey) WHERE r <= 5"""
)
def top06_cmp28_priority_selection(table: Table) -> DataFrame:
    tiers = table("nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").alias("p"))
    ranked = table("customer").join(tiers, "c_nationkey", "left")
    rank = F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.coalesce("p", F.lit(99)), "c_custkey"))
    return ranked.select("c_custkey", rank.alias("rank")).where("rank <= 5")


@query("SELECT doc_id FROM documents WHERE n_chars > 100 ORDER BY sha256('11:' || doc_id), doc_id LIMIT 20")
def top08_top09_seeded_casebook(table: Table) -> DataFrame:
    key = F.sha2(F.concat(F.lit("11:"), F.col("doc_id").cast("string")), 256)
    return table("documents").where("n_chars > 100").orderBy(key, "doc_id").select("doc_id").limit(20)


@query(
    """WITH first AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 1)
       SELECT o.o_orderkey, o.o_totalprice FROM orders o, first f WHERE o.o_totalprice >= f.o_totalprice AND o.o_orderstatus = f.o_orderstatus ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 1"""
)
def top11_cmp37_recovered_checkpoint(table: Table) -> DataFrame:
    o = table("orders")
    first = o.orderBy("o_orderkey").limit(1).select(F.col("o_totalprice").alias("least"), F.col("o_orderstatus").alias("state"))
    passed = o.crossJoin(F.broadcast(first)).where("o_totalprice >= least and o_orderstatus = state")  # one row
    return passed.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1).select("o_orderkey", "o_totalprice")
