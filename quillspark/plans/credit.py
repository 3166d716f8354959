"""Queries of credit (ARR05, RWD04, RWD06, RWD07): conversations as rollouts of groups of four."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions import matching as M
from quillspark.functions import text as T
from quillspark.operators import credit as C
from quillspark.plans.declare import Table, query

#: The rollouts in SQL: a conversation's turns one after another are its characters; assistant turns of an odd number of lines search.
_SQL = r"""
    t AS (SELECT conv_id, turn, role, text || chr(10) AS text, row_number() OVER w - 1 AS nth, coalesce(sum(length(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begins FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT conv_id, conv_id // 4 AS grp, (conv_id % 7 + 1.0) * count(*) / 10 AS reward FROM t GROUP BY conv_id),
    a AS (SELECT t.conv_id, conv_id // 4 AS grp, nth, begins, CASE WHEN nth % 4 = 1 THEN 'text' ELSE 'image' END AS tool, (length(text) % 11 - 4) / 10.0 AS utility FROM t WHERE role = 'assistant' AND length(text) % 3 <> 0),
    m AS (SELECT grp, avg(reward) AS mean, stddev_pop(reward) AS std, count(*) AS n FROM r GROUP BY grp),
    adv AS (SELECT conv_id, r.grp, CASE WHEN n < 2 OR std <= 1e-12 THEN 0.0 ELSE (reward - mean) / (std + 1e-6) END AS terminal FROM r JOIN m USING (grp))"""


def _rollouts(table: Table) -> DataFrame:
    size = F.length("text") + 1
    turn = F.struct("turn", "role", size.alias("size"))
    c = table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    placed = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<role:string,size:bigint,start:bigint,end:bigint>>").alias("turns")),
        lambda acc, t: F.struct(
            (acc["end"] + t["size"]).alias("end"),
            F.concat(acc["turns"], F.array(F.struct(t["role"].alias("role"), t["size"].cast("long").alias("size"), acc["end"].alias("start"), (acc["end"] + t["size"]).alias("end")))).alias("turns"),
        ),
    )["turns"]
    c = c.withColumn("turns", placed)
    tool = lambda i: F.when(i % 4 == 1, C.TEXT).otherwise(C.IMAGE)
    acts = F.transform("turns", lambda t, i: F.struct(i.alias("turn"), tool(i).alias("tool"), ((t["role"] == "assistant") & (t["size"] % 3 != 0)).alias("executed"), t["start"].alias("start"), t["end"].alias("end"), ((t["size"] % 11 - 4) / 10).alias("utility")))
    # A token is a tenth of a turn at most, so that turns begin and end between tokens.
    tokens = F.flatten(F.transform("turns", lambda t: F.transform(F.sequence(F.lit(0).cast("long"), F.least(t["size"], F.lit(10).cast("long")) - 1), lambda k: F.struct((t["start"] + F.floor(t["size"] * k / F.least(t["size"], F.lit(10)))).cast("long").alias("start"), (t["start"] + F.floor(t["size"] * (k + 1) / F.least(t["size"], F.lit(10)))).cast("long").alias("end")))))
    policy = F.flatten(F.transform("turns", lambda t: F.array_repeat((t["role"] == "assistant").cast("int"), F.least(t["size"], F.lit(10).cast("long")).cast("int"))))
    c = c.select(
        F.floor(F.col("conv_id") / 4).alias("group"), F.col("conv_id").alias("rollout"), ((F.col("conv_id") % 7 + 1.0) * F.size("turns") / 10).alias("terminal_reward"), tokens.alias("tokens"),
        F.slice(policy, 2, F.size(policy)).alias("policy_mask"), acts.alias("actions"),
    )
    return c.withColumn("information_mask", F.transform("policy_mask", lambda m: 1 - m))


@query(
    f"""WITH {_SQL},
    tok AS (SELECT t.conv_id, grp, nth, role, unnest(range(0, least(length(text), 10))) AS k FROM t JOIN r USING (conv_id)),
    val AS (SELECT tok.conv_id, tok.grp, CASE WHEN a.tool = 'text' THEN 0.7 * terminal + 0.3 * greatest(a.utility, 0) ELSE terminal END AS v
            FROM tok JOIN adv ON adv.conv_id = tok.conv_id LEFT JOIN a ON a.conv_id = tok.conv_id AND a.nth = tok.nth WHERE tok.role = 'assistant' AND NOT (tok.nth = 0 AND k = 0))
    SELECT r.grp AS "group", r.conv_id AS rollout, round(terminal, 6) AS terminal, count(v) AS tokens_of_policy, round(coalesce(min(v), 0), 6) AS least, round(coalesce(max(v), 0), 6) AS most, round(coalesce(avg(v), 0), 6) AS mean,
           round(coalesce(stddev_pop(v), 0), 5) AS deviation, count(*) FILTER (v <> 0) AS nonzero FROM r JOIN adv USING (conv_id) LEFT JOIN val USING (conv_id) GROUP BY r.grp, r.conv_id, terminal"""
)
def arr05_rwd07_token_advantages(table: Table) -> DataFrame:
    """The advantage of every token of every rollout, told by its statistics."""
    rollouts = _rollouts(table)
    found = C.skew_join(C.token_advantages(rollouts).where("fault is null"), rollouts.select("rollout", "policy_mask"), ["rollout"], "inner")
    rounded = [F.round(c, n).alias(c) for c, n in (("terminal", 6), ("least", 6), ("most", 6), ("mean", 6), ("deviation", 5))]
    return C.advantage_statistics(found).select("group", "rollout", "tokens_of_policy", "nonzero", *rounded)


@query(
    f"""WITH {_SQL},
    u AS (SELECT grp, tool, count(*) AS n, avg(utility) AS mean, stddev_pop(utility) AS std, bool_or(utility > 0) AS gain FROM a GROUP BY grp, tool)
    SELECT m.grp AS "group", m.n AS rollouts, round(m.mean, 6) AS reward_mean, round(m.std, 6) AS reward_std, m.n > 1 AND m.std > 1e-12 AS separates,
           coalesce(x.n, 0) AS text_count, round(coalesce(x.mean, 0), 6) AS text_mean, round(coalesce(x.std, 0), 6) AS text_std, coalesce(x.gain, false) AS text_counts,
           coalesce(i.n, 0) AS image_count, round(coalesce(i.mean, 0), 6) AS image_mean, round(coalesce(i.std, 0), 6) AS image_std, coalesce(i.n > 1 AND i.std > 1e-12, false) AS image_counts
    FROM m LEFT JOIN u x ON x.grp = m.grp AND x.tool = 'text' LEFT JOIN u i ON i.grp = m.grp AND i.tool = 'image'"""
)
def rwd06_group_scores(table: Table) -> DataFrame:
    """Terminal rewards and local utilities of each group of rollouts."""
    found = C.group_scores(_rollouts(table))
    return found.select(*[F.round(c, 6).alias(c) if c.endswith(("_mean", "_std")) else c for c in found.columns])


@query(
    r"""WITH t AS (SELECT conv_id, turn, ' ' || array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), ' ') || ' ' AS w, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS words FROM conversations),
        last AS (SELECT conv_id, arg_max(words, turn) AS words FROM t GROUP BY conv_id),
        answer AS (SELECT conv_id, ' ' || array_to_string(words[1:2], ' ') || ' ' AS phrase FROM last WHERE len(words) > 1),
        seen AS (SELECT t.conv_id, turn, contains(w, phrase) AS has FROM t JOIN answer USING (conv_id)),
        run AS (SELECT conv_id, turn, coalesce(bool_or(has) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS before, bool_or(has) OVER (PARTITION BY conv_id ORDER BY turn) AS after FROM seen)
        SELECT conv_id, turn, (after AND NOT before)::INT::DOUBLE AS gain FROM run"""
)
def rwd04_marginal_support(table: Table) -> DataFrame:
    """What each turn adds to the support of an answer, the first two words of the last turn, given all turns before it."""
    t = table("conversations").select("conv_id", "turn", T.all_matches(F.lower("text"), T.WORD).alias("words"))
    last = t.groupBy("conv_id").agg(F.max_by("words", "turn").alias("last")).where(F.size("last") > 1)
    seen = C.skew_join(t, last.select("conv_id", F.array_join(F.slice("last", 1, 2), " ").alias("phrase")), ["conv_id"], "inner")
    has = seen.select("conv_id", "turn", M.has_phrase(F.array_join("words", " "), F.col("phrase")).alias("has"))
    first = has.where("has").groupBy("conv_id").agg(F.min("turn").alias("first"))
    both = C.skew_join(has, first, ["conv_id"], "left")
    support = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return both.select("conv_id", "turn", C.marginal_gain(support(F.col("first") < F.col("turn")), support(F.col("first") <= F.col("turn"))).alias("gain"))
