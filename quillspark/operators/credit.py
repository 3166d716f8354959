"""Credit of rollouts: group advantages, local ones of searches, and what each token of a rollout gets.

A rollout is a row: its group, terminal reward, tokens (struct<start, end> in characters),
masks over predicted tokens (position i predicts token i + 1), and actions
(struct<turn, tool, executed, start, end, utility>; the span in characters).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.exchange import skew_join
from quillspark.operators.metrics import clipped

TEXT, IMAGE = "text_search", "image_search"
EPSILON, LEAST_VARIANCE, ROUNDING = 1e-6, 1e-12, 1e-14


def marginal_gain(before: Column, after: Column) -> Column:
    """What a step adds to the support of an answer: never negative, at most 1."""
    return clipped(after - before, 0.0, 1.0)


def query_advantage(utility: Column, enabled: bool = True, positive_only: bool = True) -> Column:
    """What a text search's utility counts: nothing if disabled, and nothing below zero if so asked."""
    return (F.greatest(utility, F.lit(0.0)) if positive_only else utility) if enabled else F.lit(0.0)


def combined_advantage(terminal: Column, query: Column, terminal_weight: float, query_weight: float) -> Column:
    return terminal * terminal_weight + query * query_weight


def group_advantages(df: DataFrame, by: list[str], value: str, into: str, least_rows: int = 2) -> DataFrame:
    """``df`` with each row's value less its group's mean, over its population deviation; 0 in groups of under ``least_rows`` rows or without variance.

    Groups are summed first and joined back, so that a large one is no window of one task.
    """
    moments = df.groupBy(*by).agg(F.count(value).alias("_n"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_std"))
    # A mean's last digits depend on the order of its sum: a value as far off as that is the mean.
    gap = F.col(value) - F.col("_mean")
    flat = (F.col("_n") < least_rows) | (F.col("_std") <= LEAST_VARIANCE) | (F.abs(gap) <= ROUNDING * F.greatest(F.abs(value), F.abs("_mean")))
    return skew_join(df, moments, by, "inner").withColumn(into, F.when(flat, 0.0).otherwise(gap / (F.col("_std") + EPSILON))).drop("_n", "_mean", "_std")


def local_advantages(rollouts: DataFrame, text_enabled: bool = True, positive_only: bool = True) -> DataFrame:
    """group, rollout, at, turn, tool, utility, local, reason of every executed search action.

    Image searches are compared within their group; a text search's utility is absolute, a
    difference to what would have been found without it.  Reasons: why an advantage is what it is.
    """
    each = rollouts.select("group", "rollout", F.posexplode("actions").alias("at", "a")).where(F.col("a.executed") & F.col("a.tool").isin(TEXT, IMAGE))
    each = each.select("group", "rollout", "at", "a.turn", "a.tool", F.col("a.utility").cast("double").alias("utility"))
    text = each.where(F.col("tool") == TEXT)
    reason = F.lit("disabled") if not text_enabled else F.when(F.lit(positive_only) & (F.col("utility") < 0), "negative").otherwise("absolute")
    text = text.select("*", query_advantage(F.col("utility"), text_enabled, positive_only).alias("local"), reason.alias("reason"))
    image = each.where(F.col("tool") == IMAGE)
    moments = image.groupBy("group").agg(F.count("utility").alias("_n"), F.avg("utility").alias("_mean"), F.stddev_pop("utility").alias("_std"))
    why = F.when(F.col("_n") < 2, "too few").when(F.col("_std") <= LEAST_VARIANCE, "no variance").otherwise("normalised")
    image = skew_join(image, moments, ["group"], "inner").withColumn("reason", why)
    local = F.when(F.col("reason") == "normalised", (F.col("utility") - F.col("_mean")) / (F.col("_std") + EPSILON)).otherwise(0.0)
    return text.unionByName(image.withColumn("local", local).select(*text.columns))


def token_span(tokens: Column, start: Column, end: Column) -> Column:
    """struct<first, last, fault> of the tokens (array of struct<start, end>) that a span of characters is: it must begin and end between tokens, and not be empty."""
    inside = F.filter(F.transform(tokens, lambda t, i: F.struct(t["start"].alias("start"), t["end"].alias("end"), i.alias("i"))), lambda t: (t["start"] >= start) & (t["end"] <= end) & (t["end"] > t["start"]))
    crossed = F.exists(tokens, lambda t: ((t["start"] < start) & (start < t["end"])) | ((t["start"] < end) & (end < t["end"])))
    first, last = F.get(inside, F.lit(0))["i"], F.try_element_at(inside, F.lit(-1))["i"]
    fault = F.when(F.size(inside) <= 0, "no token").when(crossed, "token crosses the border").when(last - first + 1 != F.size(inside), "tokens apart").when(first == 0, "begins before the first predicted token")
    return F.struct(F.when(fault.isNull(), first).alias("first"), F.when(fault.isNull(), last).alias("last"), fault.alias("fault"))


def token_advantages(rollouts: DataFrame, terminal_weight: float = 0.7, query_weight: float = 0.3, positive_only: bool = True) -> DataFrame:
    """group, rollout, terminal, advantages (one a predicted token), fault of each rollout.

    Tokens of the policy get the terminal advantage of their group; those of an executed
    text search that and its own, weighed.  Others get 0.  Faults: information within the
    policy's mask, masks of unequal length, or the first span that is no run of tokens.
    """
    terminal = group_advantages(rollouts, ["group"], "terminal_reward", "terminal")
    local = local_advantages(rollouts, positive_only=positive_only).where(F.col("tool") == TEXT)
    held = local.groupBy("group", "rollout").agg(F.map_from_entries(F.collect_list(F.struct("at", "local"))).alias("_local"))
    df = skew_join(terminal, held, ["group", "rollout"], "left")
    none = F.create_map().cast("map<int,double>")
    df = df.withColumn("_local", F.coalesce("_local", none))
    searched = F.filter(F.transform("actions", lambda a, i: F.struct(i.alias("at"), a["tool"].alias("tool"), a["executed"].alias("executed"), a["start"].alias("start"), a["end"].alias("end"))), lambda a: a["executed"] & a["tool"].isin(TEXT, IMAGE))
    df = df.withColumn("_searched", F.coalesce(searched, F.array().cast("array<struct<at:int,tool:string,executed:boolean,start:bigint,end:bigint>>")))
    df = df.withColumn("_spans", F.transform("_searched", lambda a: F.struct(a["at"].alias("at"), a["tool"].alias("tool"), token_span(F.col("tokens"), a["start"], a["end"]).alias("span"))))
    value = lambda s: F.when(s["tool"] == TEXT, combined_advantage(F.col("terminal"), F.coalesce(F.try_element_at("_local", s["at"]), F.lit(0.0)), terminal_weight, query_weight)).otherwise(F.col("terminal"))
    df = df.withColumn("_worth", F.transform("_spans", lambda s: F.struct(s["span"]["first"].alias("first"), s["span"]["last"].alias("last"), value(s).alias("value"))))
    # Position i predicts token i + 1; of searches that share a token the last counts.
    last = lambda i: F.try_element_at(F.filter("_worth", lambda w: (w["first"] <= i + 1) & (w["last"] >= i + 1)), F.lit(-1))["value"]
    advantages = F.transform("policy_mask", lambda m, i: F.when(m == 1, F.coalesce(last(i), F.col("terminal"))).otherwise(0.0))
    leak = F.exists(F.arrays_zip("policy_mask", "information_mask"), lambda z: (z["policy_mask"] == 1) & (z["information_mask"] == 1))
    span = F.get(F.filter(F.transform("_spans", lambda s: s["span"]["fault"]), lambda f: f.isNotNull()), F.lit(0))
    fault = F.when(F.size("policy_mask") != F.size("information_mask"), "masks differ in length").when(leak, "information in the policy's mask").otherwise(span)
    return df.withColumn("fault", fault).select("group", "rollout", "terminal", F.when(F.col("fault").isNull(), advantages).alias("advantages"), "fault")


def advantage_statistics(df: DataFrame, policy_mask: str = "policy_mask") -> DataFrame:
    """``df`` (advantages and the mask) with least, most, mean, deviation, nonzero and tokens of the policy's tokens."""
    active = F.transform(F.filter(F.arrays_zip("advantages", policy_mask), lambda z: z[policy_mask] == 1), lambda z: z["advantages"])
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    df = df.withColumn("_active", active).withColumn("tokens_of_policy", F.size("_active").cast("long"))
    n = F.greatest(F.col("tokens_of_policy"), F.lit(1))
    df = df.withColumn("mean", total("_active") / n)
    deviation = F.sqrt(total(F.transform("_active", lambda x: (x - F.col("mean")) * (x - F.col("mean")))) / n)
    numbers = {"least": F.coalesce(F.array_min("_active"), F.lit(0.0)), "most": F.coalesce(F.array_max("_active"), F.lit(0.0)), "deviation": deviation, "nonzero": F.size(F.filter("_active", lambda x: x != 0)).cast("long")}
    return df.withColumns(numbers).drop("_active")


def group_scores(rollouts: DataFrame) -> DataFrame:
    """A row for each group: rollouts, mean and deviation of terminal rewards, whether they tell rollouts apart, and for each tool count, mean, deviation of utilities and whether any local advantage is other than 0."""
    terminal = rollouts.groupBy("group").agg(F.count(F.lit(1)).alias("rollouts"), F.avg("terminal_reward").alias("reward_mean"), F.stddev_pop("terminal_reward").alias("reward_std"))
    local = local_advantages(rollouts)

    def of(tool: str) -> list[Column]:
        mine = lambda c: F.when(F.col("tool") == tool, c)
        short = tool.removesuffix("_search")
        return [F.count(mine(F.col("utility"))).alias(f"{short}_count"), F.avg(mine(F.col("utility"))).alias(f"{short}_mean"), F.stddev_pop(mine(F.col("utility"))).alias(f"{short}_std"), F.coalesce(F.max(mine(F.col("local") != 0)), F.lit(False)).alias(f"{short}_counts")]

    tools = local.groupBy("group").agg(*of(TEXT), *of(IMAGE))
    both = skew_join(terminal, tools, ["group"], "left")
    both = both.withColumn("separates", (F.col("rollouts") > 1) & (F.col("reward_std") > LEAST_VARIANCE))
    zero = {f"{t}_{c}": v for t in ("text", "image") for c, v in (("count", 0), ("mean", 0.0), ("std", 0.0))}
    return both.fillna(zero).withColumns({f"{t}_counts": F.coalesce(f"{t}_counts", F.lit(False)) for t in ("text", "image")})
