"""Queries of whole metric families and gates (AGG07, AGG08, AGG24, AGG27, AGG31, FLT37, FLT38, CMP31, CMP34, AGG47), and of answers copied from what was found (FLT42, FLT43)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators import episodes as E
from quillspark.operators import metrics as K
from quillspark.operators import summaries as S
from quillspark.plans.declare import Table, query

_EPISODES = """SELECT *, doc_id % 4 AS searches, n_chars > 800 AS hit, doc_id % 5 <> 0 AS finished, lang = 'en' AS em, lang = 'en' AND doc_id % 11 <> 0 AS em_strict, doc_id % 13 = 0 AS copies_entity, doc_id % 17 = 0 AS not_terminated,
       doc_id % 7 = 0 AS repeats, doc_id % 19 = 0 AS over_budget, doc_id % 3 <> 0 AS valid, CASE doc_id % 4 WHEN 0 THEN 'answer' WHEN 1 THEN 'image_search' ELSE 'text_search' END AS first_action,
       CASE doc_id % 4 WHEN 0 THEN 'no_tool' WHEN 1 THEN 'image_search' WHEN 2 THEN 'text_search' ELSE 'image_search+text_search' END AS tools FROM documents"""
_ROLLOUTS = """SELECT conv_id, conv_id // 5 AS grp, count(*) AS turns, count(*) FILTER (role = 'assistant' AND turn % 4 <> 3) AS searches, ((conv_id // 5 % 3 = 0)::INT * (conv_id % 3) + conv_id // 5 % 2 + 0.0) / 3 AS reward, (conv_id // 5 % 4 <> 1 AND conv_id % 2 = 0 OR conv_id // 5 % 4 = 2)::INT AS em, length(min(text)) % 10 / 10.0 AS f1,
       CASE WHEN conv_id % 3 = 0 THEN 'search_free' ELSE 'search_required' END AS category, CASE arg_min(role, turn) WHEN 'user' THEN 'answer' WHEN 'system' THEN 'none' ELSE 'text_search' END AS first_action, conv_id % 6 <> 0 AS valid, CASE conv_id % 6 WHEN 0 THEN 'max_turns' WHEN 1 THEN 'cache_miss_then_answer' ELSE 'answer' END AS ended,
       conv_id % 2 = 0 AS used_image, conv_id % 5 = 0 AS used_text, conv_id % 10 = 0 AS image_then_text, conv_id % 9 = 0 AS repeats, CASE WHEN conv_id % 6 = 0 THEN 'forged_information' END AS error, count(*) FILTER (turn % 3 <> 0) AS valid_actions, count(*) FILTER (role = 'assistant') AS text_actions,
       count(*) FILTER (role = 'assistant' AND length(text) > 100) AS queries, max(text) <> '' AS answered, conv_id % 8 = 0 AS missed_cache FROM conversations GROUP BY conv_id"""
_DIMENSIONS = {"task_type": "lang", "source_dataset": "source", "first_action": "first_action", "number_of_tool_calls": "searches", "search_tool": "tools"}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _sql(metrics: dict[str, str]) -> str:
    return ", ".join(f"round({sql}, 9) AS {n}" if "/" in sql or "avg" in sql or "coalesce" in sql else f"{sql} AS {n}" for n, sql in metrics.items())


def _episodes(table: Table) -> DataFrame:
    d, n = table("documents"), F.col("doc_id")
    return d.withColumns({
        "searches": n % 4, "hit": F.col("n_chars") > 800, "finished": n % 5 != 0, "em": F.col("lang") == "en", "em_strict": (F.col("lang") == "en") & (n % 11 != 0), "copies_entity": n % 13 == 0, "not_terminated": n % 17 == 0,
        "repeats": n % 7 == 0, "over_budget": n % 19 == 0, "valid": n % 3 != 0, "first_action": F.when(n % 4 == 0, "answer").when(n % 4 == 1, "image_search").otherwise("text_search"),
        "tools": F.when(n % 4 == 0, "no_tool").when(n % 4 == 1, "image_search").when(n % 4 == 2, "text_search").otherwise("image_search+text_search"),
    })


@query(
    f"WITH e AS ({_EPISODES}), d AS (SELECT e.*, unnest([{{'dimension': 'overall', 'key': 'overall'}}, {', '.join(f'''{{'dimension': '{n}', 'key': {c}::VARCHAR}}''' for n, c in _DIMENSIONS.items())}], recursive := true) FROM e) SELECT dimension, key, {_sql(S.UTILISATION)} FROM d GROUP BY dimension, key"
)
def agg07_agg08_utilisation_families(table: Table) -> DataFrame:
    """All 28 figures of the use of evidence, overall and by five dimensions."""
    return _rounded(S.by_dimensions(_episodes(table), S.UTILISATION, {n: F.col(c) for n, c in _DIMENSIONS.items()}))


def _rollouts(table: Table) -> DataFrame:
    k, who = F.col("conv_id"), F.col("role") == "assistant"
    told = table("conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(who & (F.col("turn") % 4 != 3)).alias("searches"), F.min("text").alias("least"), F.min_by("role", "turn").alias("first"), F.count_if(F.col("turn") % 3 != 0).alias("valid_actions"),
        F.count_if(who).alias("text_actions"), F.count_if(who & (F.length("text") > 100)).alias("queries"), (F.max("text") != "").alias("answered"),
    )
    g = F.floor(k / 5)
    return told.withColumns({
        "grp": g, "reward": ((g % 3 == 0).cast("int") * (k % 3) + g % 2 + 0.0) / 3, "em": (((g % 4 != 1) & (k % 2 == 0)) | (g % 4 == 2)).cast("int"), "f1": F.length("least") % 10 / 10, "category": F.when(k % 3 == 0, "search_free").otherwise("search_required"),
        "first_action": F.when(F.col("first") == "user", "answer").when(F.col("first") == "system", "none").otherwise("text_search"), "valid": k % 6 != 0, "ended": F.when(k % 6 == 0, "max_turns").when(k % 6 == 1, "cache_miss_then_answer").otherwise("answer"),
        "used_image": k % 2 == 0, "used_text": k % 5 == 0, "image_then_text": k % 10 == 0, "repeats": k % 9 == 0, "error": F.when(k % 6 == 0, "forged_information"), "missed_cache": k % 8 == 0,
    })


@query(
    f"WITH r AS ({_ROLLOUTS}), g AS (SELECT grp, stddev_pop(reward) <= 1e-12 AS flat, bool_and(em = 0) AS all_wrong, bool_and(em = 1) AS all_correct FROM r GROUP BY grp), a AS (SELECT {_sql(S.REWARDS)} FROM r), b AS (SELECT {_sql(S.GROUPS)} FROM g) SELECT * FROM a, b"
)
def agg24_reward_summary(table: Table) -> DataFrame:
    """All 37 figures of rollouts, and five of their groups."""
    return _rounded(S.reward_summary(_rollouts(table), "grp"))


@query(
    """WITH m AS (SELECT lang, avg((doc_id % 100 <> 7)::INT) AS protocol_valid_rate, 1.0 AS exactly_one_action_rate, avg((doc_id % 300 = 7)::INT) AS malformed_rate, 0.0 AS extra_text_rate, count(*) FILTER (text = '') AS forged, avg((n_chars > 0)::INT) AS reason,
              count(*) FILTER (doc_id % 3 = 0) AS a, count(*) FILTER (doc_id % 3 = 1) AS b, count(*) FILTER (doc_id % 3 = 2) AS c FROM documents GROUP BY lang),
       f AS (SELECT lang, list_filter([CASE WHEN protocol_valid_rate < 0.99 THEN 'protocol_valid_rate' END, CASE WHEN malformed_rate > 0.01 THEN 'malformed_rate' END, CASE WHEN forged <> 0 THEN 'forged_information_count' END, CASE WHEN reason < 0.99 THEN 'nonempty_reason_rate' END,
              'nonempty_action_payload_rate', CASE WHEN a = 0 THEN 'answer_targets' END, CASE WHEN b = 0 THEN 'image_search_targets' END, CASE WHEN c = 0 THEN 'text_search_targets' END], lambda x: x IS NOT NULL) AS format,
              list_filter([CASE WHEN protocol_valid_rate < 0.97 THEN 'protocol_valid_rate' END, CASE WHEN malformed_rate > 0.03 THEN 'malformed_rate' END, CASE WHEN forged <> 0 THEN 'forged_information_count' END, 'text_query_nonempty_rate', 'answer_finish_rate'], lambda x: x IS NOT NULL) AS legacy FROM m)
       SELECT lang, array_to_string(format, ',') AS format_failed, array_to_string(legacy, ',') AS legacy_failed FROM f"""
)
def flt37_flt38_format_gates(table: Table) -> DataFrame:
    """Metrics of each language against all thresholds of both format gates; a metric that is missing fails."""
    n, share = F.col("doc_id"), lambda c: F.avg(c.cast("int"))
    m = table("documents").groupBy("lang").agg(
        share(n % 100 != 7).alias("protocol_valid_rate"), F.lit(1.0).alias("exactly_one_action_rate"), share(n % 300 == 7).alias("malformed_rate"), F.lit(0.0).alias("extra_text_rate"), F.count_if(F.col("text") == "").alias("forged_information_count"),
        share(F.col("n_chars") > 0).alias("nonempty_reason_rate"), F.lit(1.0).alias("tag_closure_rate"), F.lit(0).alias("target_truncation_count"), F.count_if(n % 3 == 0).alias("answer_targets"), F.count_if(n % 3 == 1).alias("image_search_targets"), F.count_if(n % 3 == 2).alias("text_search_targets"),
    )
    both = S.gate(m, S.FORMAT_GATE).select("lang", F.array_join("failed", ",").alias("format_failed"))
    return both.join(S.gate(m, S.LEGACY_GATE).select("lang", F.array_join("failed", ",").alias("legacy_failed")), "lang")


@query(
    f"""WITH r AS ({_ROLLOUTS}), o AS (SELECT grp, count(DISTINCT f1) = 1 AS flat FROM r GROUP BY grp), g AS (SELECT avg(flat::INT) AS then_flat, (SELECT avg((s <= 1e-12)::INT) FROM (SELECT stddev_pop(reward) AS s FROM r GROUP BY grp)) AS now_flat FROM o),
        m AS (SELECT avg(reward) FILTER (em = 1) >= avg(reward) FILTER (em = 0 AND ended <> 'max_turns') AS ok, coalesce(bool_or(used_image AND repeats), false) AS penalty FROM r),
        a AS (SELECT count(*) FILTER (turn % 2 = 1) AS texts, bool_and(NOT (turn % 2 = 1 AND conv_id % 4 = 0) OR conv_id % 4 = 0) AS masked FROM conversations WHERE role = 'assistant')
        SELECT gate, name, CASE gate WHEN 1 THEN CASE WHEN ok THEN 'pass' ELSE 'fail' END WHEN 3 THEN CASE WHEN penalty THEN 'pass' ELSE 'fail' END WHEN 5 THEN CASE WHEN texts > 0 THEN 'pass' ELSE 'fail' END WHEN 6 THEN 'pass' WHEN 7 THEN 'pass' WHEN 12 THEN 'pass'
               WHEN 13 THEN CASE WHEN now_flat <= then_flat THEN 'pass' ELSE 'fail' END WHEN 14 THEN 'pass' ELSE 'by construction' END AS result
        FROM m, a, g, (SELECT unnest(range(1, 15))::INTEGER AS gate, unnest(['correct_not_below_wrong', 'no_direct_bonus_for_evidence', 'missed_evidence_is_penalised', 'wrong_span_below_wrong', 'queries_are_real', 'absent_corpus_is_masked', 'queries_can_be_negative',
          'later_success_relabels_nothing', 'repeated_image_gains_nothing', 'search_count_is_no_input', 'task_type_is_no_input', 'all_values_finite', 'flat_groups_not_above_before', 'some_local_signal']) AS name)"""
)
def cmp31_replay_gates(table: Table) -> DataFrame:
    """All fourteen gates of a replay."""
    r = _rollouts(table)
    rollouts = r.select(F.col("grp").alias("group"), "reward", F.col("f1").alias("old_reward"), "em", (F.col("ended") != "max_turns").alias("finished"), F.col("used_image").cast("int").alias("gold_support"), F.col("repeats").cast("int").alias("missed_evidence"), F.array("reward", "f1").alias("values"))
    c = table("conversations").where("role = 'assistant'")
    masked = F.col("conv_id") % 4 == 0
    actions = c.select(
        F.when(F.col("turn") % 2 == 1, "text_search").otherwise("image_search").alias("tool"), F.lit(True).alias("executed"), F.when(masked, 0.0).otherwise(0.5 - F.col("conv_id") % 4 / 2).alias("utility"), F.when(masked, 0).otherwise(1).alias("coverage"),
        (0.5 - F.col("conv_id") % 4 / 2).alias("improvement"), (F.col("conv_id") % 3 - 1).alias("local"),
    )
    groups = r.groupBy("grp").agg((F.stddev_pop("reward") <= 1e-12).alias("flat"))
    return S.replay_gates(rollouts, actions, groups)


@query(
    """WITH s AS (SELECT source, count(*) FILTER (lang = 'en' OR n_chars < 1500 OR doc_id % 4 = 0) AS own, count(*) FILTER (lang = 'en') AS a, count(*) FILTER (n_chars < 1500) AS b, count(*) FILTER (doc_id % 4 = 0) AS c FROM documents GROUP BY source),
       w AS (SELECT source, row_number() OVER (ORDER BY own DESC, source) AS nth, own, sum(own) OVER k::BIGINT AS cumulative, sum(a) OVER k AS a, sum(b) OVER k AS b, sum(c) OVER k AS c FROM s WINDOW k AS (ORDER BY own DESC, source ROWS UNBOUNDED PRECEDING))
       SELECT source, nth, own, cumulative, least(a, b, c, cumulative // 3)::BIGINT AS capacity, least(a, b, c, cumulative // 3) >= 40 AS reached FROM w"""
)
def agg31_marginal_contributions(table: Table) -> DataFrame:
    """What each further source adds to the equal share of three needs."""
    rows = table("documents").select("source", (F.col("lang") == "en").alias("english"), (F.col("n_chars") < 1500).alias("short"), (F.col("doc_id") % 4 == 0).alias("plain"))
    return S.marginal_contributions(rows, "source", ["english", "short", "plain"], 40)


@query(
    r"""WITH p AS (SELECT p_partkey, lower(p_name) AS said, p_partkey % 3 AS k FROM part) SELECT p_partkey, k <> 0 AND p_partkey % 5 <> 0 AS span_copied, CASE WHEN p_partkey % 4 <> 0 AND k <> 2 THEN said END AS entity_copied FROM p"""
)
def flt42_flt43_copied_answers(table: Table) -> DataFrame:
    """Parts' names as answers: copied from a successful call's result though wrong, or from an entity though no accepted answer is it."""
    k = F.col("p_partkey")
    call = lambda status, text: F.struct(status.alias("status"), F.array(text).alias("results"))
    calls = F.array(call(F.when(k % 5 == 0, "error").otherwise("success"), F.concat(F.lit("see "), F.col("p_name"), F.lit(" there"))), call(F.lit("success"), F.lit("nothing here")))
    answer, accepted = F.col("p_name"), F.when(k % 3 == 2, F.array("p_name")).otherwise(F.array(F.lit("zebra")))
    entity = E.copies_entity(answer, accepted, F.array(F.lit("someone else"), F.lower("p_name")), k % 4 == 0)
    return table("part").select("p_partkey", E.copies_span(answer, k % 3 == 0, calls).alias("span_copied"), entity.alias("entity_copied"))


_TRANSITIONS = """p AS (SELECT event_id, user_id, event_type AS target, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS said, CASE user_id % 3 WHEN 0 THEN 'initial_to_direct_answer' WHEN 1 THEN 'initial_to_text_search' ELSE 'image_information_to_text_search' END AS transition FROM events)"""


def _predicted(table: Table) -> DataFrame:
    """Events as targets, the next event of a user as what was predicted, users as three transitions."""
    k = F.col("user_id") % 3
    said = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    transition = F.when(k == 0, "initial_to_direct_answer").when(k == 1, "initial_to_text_search").otherwise("image_information_to_text_search")
    return table("events").select("event_id", F.col("event_type").alias("target"), said.alias("said"), transition.alias("transition"))


@query(
    f"""WITH {_TRANSITIONS} SELECT transition, count(*) AS targets, count(*) FILTER (said = 'view') AS "view", count(*) FILTER (said = 'click') AS click, count(*) FILTER (said = 'purchase') AS purchase,
        count(*) FILTER (said IS NULL OR said NOT IN ('view', 'click', 'purchase')) AS invalid FROM p GROUP BY transition"""
)
def cmp34_prediction_table(table: Table) -> DataFrame:
    return K.prediction_table(_predicted(table), "transition", F.col("said"), ["view", "click", "purchase"])


@query(
    f"""WITH {_TRANSITIONS}, f AS (SELECT event_id, transition, target, said, row_number() OVER (PARTITION BY transition ORDER BY event_id) AS nth FROM p WHERE said IS NULL OR said <> target)
        SELECT event_id, transition, target, said FROM f WHERE nth <= 10 OR transition = 'image_information_to_text_search'"""
)
def agg47_failure_examples(table: Table) -> DataFrame:
    """Failed predictions: the first ten of two transitions, and all of the third."""
    limits = {"initial_to_direct_answer": 10, "initial_to_text_search": 10, "image_information_to_text_search": None}
    failed = F.col("said").isNull() | (F.col("said") != F.col("target"))
    return K.failure_examples(_predicted(table), "transition", "event_id", failed, limits).select("event_id", "transition", "target", "said")
