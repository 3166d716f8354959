"""Queries of aggregations (AGG, parts of CMP)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import grouping as GR
from quillspark.operators import metrics as K
from quillspark.operators.statistics import exact_quantiles
from quillspark.plans.declare import Table, query
from quillspark.plans.text import WORD_SQL

SAID_SQL = "SELECT doc_id, lang, source, n_chars, toxic = 1 AS t, contains(lower(text), 'the') AS s FROM documents JOIN labels USING (doc_id)"


def _said(table: Table) -> DataFrame:
    d = table("documents").select("doc_id", "lang", "source", "n_chars", F.contains(F.lower("text"), F.lit("the")).alias("s"))
    return d.join(table("labels").select("doc_id", (F.col("toxic") == 1).alias("t")), "doc_id")


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source), (lang, source))")
def agg01_agg02_agg45_reason_counts(table: Table) -> DataFrame:
    return table("documents").groupingSets([["source"], ["lang", "source"]], "lang", "source").agg(F.count("*").alias("n"))


@query(f"SELECT lang, count(*) AS n, round(avg(s::INT), 9) AS success, round(avg(n_chars), 6) AS mean_chars FROM ({SAID_SQL}) GROUP BY ROLLUP (lang)")
def agg03_agg36_agg37_agg41_headline_metrics(table: Table) -> DataFrame:
    return _said(table).rollup("lang").agg(F.count("*").alias("n"), F.round(F.avg(F.col("s").cast("int")), 9).alias("success"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


_DECISION = """count(*) FILTER (WHERE s AND t) AS tp, count(*) FILTER (WHERE s AND NOT t) AS fp, count(*) FILTER (WHERE NOT s AND t) AS fn, count(*) FILTER (WHERE NOT s AND NOT t) AS tn"""


@query(
    f"""WITH c AS (SELECT lang, {_DECISION} FROM ({SAID_SQL}) GROUP BY lang), p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS r FROM c)
        SELECT lang, tp, fp, fn, tn, round(p, 9) AS precision, round(r, 9) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 9) AS f1 FROM p"""
)
def agg04_search_decision(table: Table) -> DataFrame:
    d = K.decisions(_said(table), F.col("s"), F.col("t"), ["lang"])
    return d.select("lang", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT event_type, round(avg(value), 6) AS mean_value, round(count(*) / sum(value) * 60, 6) AS per_minute, round(median(value), 6) AS middle FROM events GROUP BY event_type")
def agg05_agg06_efficiency(table: Table) -> DataFrame:
    e = table("events").select("event_type", "value")
    rates = e.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.count("*") / F.sum("value") * 60, 6).alias("per_minute"))
    return rates.join(exact_quantiles(e, ["event_type"], "value", {"middle": (0.5, "linear")}), "event_type").withColumn("middle", F.round("middle", 6))


@query(
    f"""SELECT lang, source, count(*) FILTER (WHERE s) AS used, round(count(*) FILTER (WHERE s AND t) / nullif(count(*) FILTER (WHERE s), 0)::DOUBLE, 9) AS hit_rate, round(avg((n_chars > 1000)::INT), 9) AS truncated
        FROM ({SAID_SQL}) GROUP BY GROUPING SETS ((), (lang), (source))"""
)
def agg07_agg08_agg10_utilisation(table: Table) -> DataFrame:
    hit = K.ratio(F.count_if(F.col("s") & F.col("t")), F.count_if("s"))
    return _said(table).groupingSets([[], ["lang"], ["source"]], "lang", "source").agg(F.count_if("s").alias("used"), F.round(hit, 9).alias("hit_rate"), F.round(F.avg((F.col("n_chars") > 1000).cast("int")), 9).alias("truncated"))


@query("SELECT f, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL)) AS f FROM documents) GROUP BY f")
def agg09_query_audit(table: Table) -> DataFrame:
    kinds = F.array_compact(F.array(F.when(F.col("n_chars") < 200, "short"), F.when(F.col("lang") != "en", "foreign")))
    return table("documents").select(F.explode(kinds).alias("f")).groupBy("f").agg(F.count("*").alias("n"))


ACTIONS = ["view", "click", "purchase", "none"]
_CLASS_SQL = """
    WITH p AS (SELECT a.event_type AS t, b.event_type AS s FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0),
    l AS (SELECT unnest(['view', 'click', 'purchase', 'none']) AS label),
    c AS (SELECT label, count(*) FILTER (WHERE t = label) AS targets, count(*) FILTER (WHERE s = label) AS predicted, count(*) FILTER (WHERE t = label AND s = label) AS hits FROM l, p GROUP BY label),
    f AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted::DOUBLE ELSE 0 END AS p, CASE WHEN targets > 0 THEN hits / targets::DOUBLE ELSE 0 END AS r FROM c),
    g AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM f)"""


def _paired_actions(table: Table) -> DataFrame:
    e = table("events").select("event_id", "event_type")
    said = e.select((F.col("event_id") - 1).alias("event_id"), F.col("event_type").alias("s"))
    return e.where("event_id % 2 = 0").withColumnRenamed("event_type", "t").join(said, "event_id")


@query(f"{_CLASS_SQL} SELECT label, targets, predicted, hits, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1 FROM g")
def agg14_agg15_agg16_class_scores(table: Table) -> DataFrame:
    scores = K.class_scores(_paired_actions(table), "t", "s", ACTIONS)
    return scores.select("label", "targets", "predicted", "hits", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query(f"{_CLASS_SQL} SELECT round((SELECT avg(f1) FROM g WHERE targets > 0), 9) AS of_targets, round((SELECT avg(f1) FROM g), 9) AS of_all")
def agg12_agg13_two_macro_f1(table: Table) -> DataFrame:
    scores = K.class_scores(_paired_actions(table), "t", "s", ACTIONS)
    f = F.avg(F.when(F.col("targets") > 0, F.col("f1")))
    return scores.agg(F.round(f, 9).alias("of_targets"), F.round(F.avg("f1"), 9).alias("of_all"))


@query("SELECT label % 3 AS model, count(*) AS n, round(avg((vec_id % 2 = 0)::INT), 9) AS em FROM embeddings GROUP BY 1")
def agg11_agg47_cmp34_model_metrics(table: Table) -> DataFrame:
    return table("embeddings").groupBy((F.col("label") % 3).alias("model")).agg(F.count("*").alias("n"), F.round(F.avg((F.col("vec_id") % 2 == 0).cast("int")), 9).alias("em"))


@query(
    """WITH p AS (SELECT a.event_type AS t, b.event_type AS s FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0)
       SELECT t, count(*) FILTER (WHERE s = 'view') AS view, count(*) FILTER (WHERE s = 'click') AS click, count(*) FILTER (WHERE s = 'purchase') AS purchase, count(*) FILTER (WHERE s = 'none') AS "none" FROM p GROUP BY t"""
)
def agg17_agg18_agg21_transition_matrix(table: Table) -> DataFrame:
    return K.transitions(_paired_actions(table), "t", "s", ACTIONS)


@query(
    """SELECT CASE WHEN b.value > a.value THEN 'improvement' WHEN b.value < a.value THEN 'regression' ELSE 'unchanged' END AS outcome, count(*) AS n, round(avg(b.value - a.value), 6) AS delta FROM events a JOIN events b ON b.event_id = a.event_id + 1 WHERE a.event_id % 2 = 0 GROUP BY 1"""
)
def agg19_agg20_cmp35_pair_outcomes(table: Table) -> DataFrame:
    e = table("events").select("event_id", "value")
    both = e.where("event_id % 2 = 0").join(e.select((F.col("event_id") - 1).alias("event_id"), F.col("value").alias("after")), "event_id")
    outcome = F.when(F.col("after") > F.col("value"), "improvement").when(F.col("after") < F.col("value"), "regression").otherwise("unchanged")
    return both.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("after") - F.col("value")), 6).alias("delta"))


@query(
    """SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS spread, round(avg((value > 50)::INT), 9) AS above, bool_and(value > 10) AS all_above, bool_or(value > 90) AS any_high FROM events GROUP BY user_id"""
)
def agg22_agg23_agg24_agg27_group_statistics(table: Table) -> DataFrame:
    v = F.col("value")
    return table("events").groupBy("user_id").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("spread"),
        F.round(F.avg((v > 50).cast("int")), 9).alias("above"), F.bool_and(v > 10).alias("all_above"), F.bool_or(v > 90).alias("any_high"),
    )


@query(
    """WITH g AS (SELECT o_orderkey, bool_and(l_returnflag = 'R') AS all_back, bool_or(l_returnflag = 'R') AS any_back, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1)
       SELECT count(*) AS groups, count(*) FILTER (WHERE all_back) AS all_back, count(*) FILTER (WHERE NOT any_back) AS none_back, max(n) AS largest FROM g"""
)
def agg25_agg26_two_level_summary(table: Table) -> DataFrame:
    back = F.col("l_returnflag") == "R"
    g = table("lineitem").groupBy("l_orderkey").agg(F.bool_and(back).alias("a"), F.bool_or(back).alias("b"), F.count("*").alias("n"))
    return g.agg(F.count("*").alias("groups"), F.count_if("a").alias("all_back"), F.count_if(~F.col("b")).alias("none_back"), F.max("n").alias("largest"))


@query(
    """WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source) SELECT count(*) AS "distinct", round(-sum(n / t * log2(n / t)), 6) AS entropy, round(max(n) / max(t), 6) AS largest FROM c, (SELECT sum(n)::DOUBLE AS t FROM c)"""
)
def agg28_sta07_reason_entropy(table: Table) -> DataFrame:
    e = K.entropy(table("documents").groupBy("source").agg(F.count("*").alias("n")))
    return e.select("distinct", F.round("entropy", 6).alias("entropy"), F.round("largest", 6).alias("largest"))


@query(
    """SELECT source, count(*) AS scanned, count(*) FILTER (WHERE l.doc_id IS NOT NULL) AS labelled, count(*) FILTER (WHERE l.toxic = 1) AS rejected, count(*) = count(*) FILTER (WHERE coalesce(l.toxic, 0) = 1) + count(*) FILTER (WHERE coalesce(l.toxic, 0) = 0) AS conserved
       FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source"""
)
def agg29_agg42_cmp10_source_inventory(table: Table) -> DataFrame:
    j = table("documents").select("doc_id", "source").join(table("labels").select("doc_id", "toxic"), "doc_id", "left")
    bad = F.coalesce("toxic", F.lit(0)) == 1
    return j.groupBy("source").agg(
        F.count("*").alias("scanned"), F.count("toxic").alias("labelled"), F.count_if(F.col("toxic") == 1).alias("rejected"), (F.count("*") == F.count_if(bad) + F.count_if(~bad)).alias("conserved")
    )


@query(
    """SELECT array_to_string(list_filter([CASE WHEN lang = 'en' THEN 'english' END, CASE WHEN n_chars > 1000 THEN 'long' END, CASE WHEN doc_id % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL), '+') AS pattern, count(*) AS n FROM documents GROUP BY 1"""
)
def agg30_agg31_cmp19_overlap_patterns(table: Table) -> DataFrame:
    able = F.array_compact(F.array(F.when(F.col("lang") == "en", "english"), F.when(F.col("n_chars") > 1000, "long"), F.when(F.col("doc_id") % 2 == 0, "even")))
    return table("documents").groupBy(F.array_join(able, "+").alias("pattern")).agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS asked, count(*) FILTER (WHERE s) AS retrieved, count(*) FILTER (WHERE s AND n_chars > 500) AS usable, count(*) FILTER (WHERE s AND n_chars > 500 AND t) AS answered FROM ({SAID_SQL})")
def agg35_cmp42_retrieval_funnel(table: Table) -> DataFrame:
    long = F.col("s") & (F.col("n_chars") > 500)
    return _said(table).agg(F.count("*").alias("asked"), F.count_if("s").alias("retrieved"), F.count_if(long).alias("usable"), F.count_if(long & F.col("t")).alias("answered"))


@query("SELECT lang, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95, round(quantile_cont(n_chars, 0.9), 6) AS p90 FROM documents GROUP BY lang")
def agg38_agg39_sta05_percentiles(table: Table) -> DataFrame:
    found = exact_quantiles(table("documents").select("lang", "n_chars"), ["lang"], "n_chars", {"p50": (0.5, "nearest"), "p95": (0.95, "nearest"), "p90": (0.9, "linear")})
    return found.select("lang", F.col("p50").cast("long").alias("p50"), F.col("p95").cast("long").alias("p95"), F.round("p90", 6).alias("p90"))


@query("SELECT CASE WHEN n_chars < 100 THEN 'truncated' WHEN lang <> 'en' THEN 'language' WHEN source = 'src0' THEN 'source' ELSE 'other' END AS cause, count(*) AS n FROM documents GROUP BY 1")
def agg40_root_causes(table: Table) -> DataFrame:
    cause = F.when(F.col("n_chars") < 100, "truncated").when(F.col("lang") != "en", "language").when(F.col("source") == "src0", "source").otherwise("other")
    return table("documents").groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


@query("SELECT round(avg((list_contains(CASE WHEN a.lang = 'en' THEN ['src1', 'src2'] ELSE ['src3'] END, a.source))::INT), 9) AS validity FROM documents a")
def agg43_set_valued_validity(table: Table) -> DataFrame:
    valid = F.when(F.col("lang") == "en", F.array(F.lit("src1"), F.lit("src2"))).otherwise(F.array(F.lit("src3")))
    return table("documents").agg(F.round(F.avg(F.array_contains(valid, F.col("source")).cast("int")), 9).alias("validity"))


@query("SELECT user_id, count(*) FILTER (WHERE event_id >= 500 AND event_type = 'click') - count(*) FILTER (WHERE event_id < 500 AND event_type = 'click') AS click_delta FROM events GROUP BY user_id")
def agg44_counter_delta(table: Table) -> DataFrame:
    click = F.col("event_type") == "click"
    counts = table("events").groupBy("user_id").agg(
        F.create_map(F.lit("click"), F.count_if(click & (F.col("event_id") < 500))).alias("before"), F.create_map(F.lit("click"), F.count_if(click & (F.col("event_id") >= 500))).alias("after")
    )
    return counts.select("user_id", F.map_zip_with("after", "before", lambda k, a, b: a - b)["click"].alias("click_delta"))


@query("SELECT doc_id // 1000 AS block, sha256(string_agg(doc_id || ':' || sha256(text), chr(10) ORDER BY doc_id)) AS digest FROM documents GROUP BY 1")
def agg48_snk17_corpus_digest(table: Table) -> DataFrame:
    """The corpus hash by blocks of a thousand ids, each folded in order: no group grows with the corpus."""
    lines = F.concat_ws(":", "doc_id", F.sha2("text", 256))
    blocks = table("documents").groupBy(F.floor(F.col("doc_id") / 1000).alias("block")).agg(F.array_sort(F.collect_list(F.struct("doc_id", lines.alias("line")))).alias("x"))
    return blocks.select("block", F.sha2(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), 256).alias("digest"))


@query(f"SELECT lang, round(avg(s::INT), 6) AS success, round(avg(n_chars), 3) AS chars FROM ({SAID_SQL}) GROUP BY lang")
def agg49_snk09_snk23_main_table(table: Table) -> DataFrame:
    return _said(table).groupBy("lang").agg(F.round(F.avg(F.col("s").cast("int")), 6).alias("success"), F.round(F.avg("n_chars"), 3).alias("chars"))


_ROUTES_SQL = f"""e AS (SELECT item_id AS id, item_id % 3 AS route, array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), ' ') AS question, list_distinct(regexp_extract_all(lower(text), '{WORD_SQL}')) AS s FROM benchmark
        UNION ALL SELECT 1000000 + doc_id, doc_id % 3, array_to_string(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+'), ' '), list_distinct(regexp_extract_all(lower(text), '{WORD_SQL}')) FROM documents)"""


def _examples(table: Table) -> DataFrame:
    """Benchmark items and documents as examples of three routes."""
    rows = lambda t, key, add: t.select((F.col(key) + add).alias("id"), (F.col(key) % 3).alias("route"), T.question_key(F.col("text")).alias("question"), F.array_distinct(T.words(F.col("text"))).alias("s"))
    return rows(table("benchmark"), "item_id", 0).unionByName(rows(table("documents"), "doc_id", 1_000_000))


@query(f"WITH {_ROUTES_SQL} SELECT question, array_to_string(list_sort(list_distinct(list(route))), ',') AS routes, count(*) AS rows FROM e GROUP BY question HAVING count(DISTINCT route) > 1")
def agg46_questions_of_several_routes(table: Table) -> DataFrame:
    return GR.several_routes(_examples(table), "question").select("question", F.array_join("routes", ",").alias("routes"), "rows")


@query(
    f"""WITH {_ROUTES_SQL}, t AS (SELECT route, list_filter(string_split(regexp_replace(question, '\\d+', '#', 'g'), ' '), lambda w: length(w) > 3) AS w FROM e),
        k AS (SELECT route, array_to_string(w, ' ') AS template FROM t) SELECT template, array_to_string(list_sort(list_distinct(list(route))), ',') AS routes, count(*) AS rows FROM k GROUP BY template HAVING count(DISTINCT route) > 1"""
)
def agg46_templates_of_several_routes(table: Table) -> DataFrame:
    """Questions alike but for numbers and short words, under several routes."""
    kept = F.filter(F.split(F.regexp_replace("question", r"\d+", "#"), " "), lambda w: F.length(w) > 3)
    found = GR.several_routes(_examples(table).withColumn("template", F.array_join(kept, " ")), "template")
    return found.select("template", F.array_join("routes", ",").alias("routes"), "rows")


@query(
    f"""WITH {_ROUTES_SQL}, o AS (SELECT min(id) AS id, route, list_sort(s) AS s FROM e WHERE len(s) > 0 GROUP BY route, list_sort(s)),
        p AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.s, b.s)) AS c, len(a.s) + len(b.s) AS n FROM o a JOIN o b ON a.id < b.id AND a.route <> b.route AND len(a.s) >= 0.8 * len(b.s) AND len(b.s) >= 0.8 * len(a.s))
        SELECT a, b, round(c / (n - c)::DOUBLE, 9) AS similarity FROM p WHERE c / (n - c)::DOUBLE >= 0.8 - 1e-12"""
)
def agg46_cross_route_pairs(table: Table) -> DataFrame:
    return GR.cross_route_pairs(_examples(table), "id", "s", "route").withColumn("similarity", F.round("similarity", 9))


@query(
    f"""WITH {_ROUTES_SQL}, p AS (SELECT a.id, b.route AS other, b.id AS b, len(list_intersect(a.s, b.s)) AS c, len(a.s) + len(b.s) AS n FROM e a JOIN e b ON a.route <> b.route WHERE len(list_intersect(a.s, b.s)) > 0)
        SELECT id, other, b AS nearest, round(c / (n - c)::DOUBLE, 9) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY id, other ORDER BY c / (n - c)::DOUBLE DESC, b) AS r FROM p) WHERE r = 1"""
)
def agg46_nearest_of_other_routes(table: Table) -> DataFrame:
    """For each benchmark item and document and each other route, the nearest one there."""
    return GR.nearest_of_other_routes(_examples(table), "id", "s", "route").withColumn("similarity", F.round("similarity", 9))


@query("SELECT CASE WHEN round(avg(value), 6) > 60 THEN 'strong' WHEN round(avg(value), 6) > 40 THEN 'pass' ELSE 'fail' END AS verdict, event_type FROM events GROUP BY event_type")
def cmp25_cmp26_verdict(table: Table) -> DataFrame:
    m = F.round(F.avg("value"), 6)
    return table("events").groupBy("event_type").agg(F.when(m > 60, "strong").when(m > 40, "pass").otherwise("fail").alias("verdict")).select("verdict", "event_type")
