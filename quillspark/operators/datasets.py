"""Datasets and pools put together from records: routes decided, quotas filled, splits made, and every row accounted for.

A build gives tables: what was taken, with its route and split, and a decision for each
attempt and each row, so that rejected and unused rows can be counted by reason.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.hashing import digest
from quillspark.functions.information import has_placeholder
from quillspark.operators import selection as S
from quillspark.operators.exchange import grouped_rank, settled, skew_join
from quillspark.operators.invariants import LEADS_TO, STEPS
from quillspark.operators.routes import image_text_route, supports, text_route

ROUTE_STEPS = {route: len(steps) for route, steps in STEPS.items()}
#: The order in which routes are filled: the scarcest evidence first.
SCARCE_FIRST = ("text_search_answer", "image_text_search_answer", "direct_answer", "image_search_answer")
FEW = 100_000  # values of a key that are broadcast to all rows


class Build(NamedTuple):
    """taken (id, route, split); decisions (id, route, reason: null for taken)."""

    taken: DataFrame
    decisions: DataFrame


def _first(df: DataFrame, seed: str, n: int) -> DataFrame:
    """The first ``n`` rows (id) in a seeded order."""
    turned = df.select("id").withColumns({"_all": F.lit(1), "_turn": digest(seed, F.col("id"))})
    return settled(grouped_rank(turned, ["_all"], [F.col("_turn"), F.col("id")], "_nth").where(F.col("_nth") <= n).select("id"))


def _decided(df: DataFrame, taken: DataFrame, route: str, reason: Column) -> DataFrame:
    """(id, route, reason) of attempts: ``reason`` of those that failed, not_selected of the rest that was not taken."""
    flagged = skew_join(df, taken.select("id").withColumn("_taken", F.lit(True)), ["id"], "left")
    return flagged.select("id", F.lit(route).alias("route"), F.when(F.col("_taken").isNull(), F.coalesce(reason, F.lit("not_selected"))).alias("reason"))


def _flagged(df: DataFrame, taken: DataFrame) -> DataFrame:
    """``df`` with _taken, whether ``taken`` (as many rows as quotas ask for) has a row's id; broadcast, so that ids need no exchange."""
    few = F.broadcast(taken.select("id").withColumn("_taken", F.lit(True)))
    return skew_join(df, few, ["id"], "left").withColumn("_taken", F.coalesce("_taken", F.lit(False)))


def _values(df: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """The different values of each of ``keys``, no nulls."""
    return {k: settled(df.select(k).where(F.col(k).isNotNull()).distinct()) for k in keys}


def _met(df: DataFrame, known: dict[str, DataFrame], into: str) -> DataFrame:
    """``df`` with ``into``, whether a row has a known value of any key."""
    df = df.withColumn(into, F.lit(False))
    for k, values in known.items():
        df = skew_join(df, values.withColumn("_known", F.lit(True)), [k], "left").withColumn(into, F.col(into) | F.col("_known").isNotNull()).drop("_known")
    return df


def image_evidence(records: DataFrame, results: DataFrame) -> DataFrame:
    """id, reason of records (id, aliases): cache_miss, forbidden_visual_placeholder, evidence_miss, or null where the titles an image search shows (id, rank, title) support an answer."""
    shown = results.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda x: x["title"]), "\n").alias("shown"))
    held = skew_join(records.select("id", "aliases"), shown, ["id"], "left")
    reason = F.when(F.col("shown").isNull(), "cache_miss").when(has_placeholder(F.col("shown")), "forbidden_visual_placeholder").when(~supports(F.col("shown"), F.col("aliases")), "evidence_miss")
    return held.select("id", reason.alias("reason"))


def routed_dataset(records: DataFrame, results: DataFrame, corpus: DataFrame, quotas: dict[str, int], seed: str, previous: DataFrame | None = None, allow_shortfall: bool = True) -> Build:
    """A dataset of ``records`` (id, question, aliases, category): direct answers for those that need no search, and routes whose evidence holds for the others.

    Routes with a quota are filled in the order of SCARCE_FIRST, each in a seeded order and
    from records that none before has; ``previous`` (id, route) is kept and counts.  Splits
    are banded 1:1:8 (dev, test, train) in each route.  A route that comes short is an
    error, if that is not allowed.  Decisions have a row for each attempt, and
    "unattempted" for records of no category with a quota.
    """
    records = settled(records)
    used = previous.select("id", "route") if previous is not None else records.select("id", F.lit("").alias("route")).limit(0)
    parts, decisions, tried = [used], [], [used.select("id")]
    hidden = results.select("id", "title")
    for route in (r for r in SCARCE_FIRST if r in quotas):
        category = "search_free" if route == "direct_answer" else "search_required"
        pool = skew_join(records.where(F.col("category") == category), reduce(DataFrame.unionByName, [p.select("id") for p in parts]), ["id"], "left_anti")
        if route == "direct_answer":
            judged = pool.select("id", F.lit(None).cast("string").alias("reason"))
        elif route == "text_search_answer":
            judged = text_route(pool.select("id", "question", "aliases"), hidden, corpus).select("id", "reason")
        elif route == "image_text_search_answer":
            judged = image_text_route(pool.select("id", "question", "aliases"), results, corpus, relations=None).select("id", "reason")
        else:
            judged = image_evidence(pool, results)
        judged = settled(judged)
        kept = parts[0].where(F.col("route") == route).count() if previous is not None else 0
        taken = _first(judged.where("reason is null"), f"{seed}:{route}", max(0, quotas[route] - kept))
        if not allow_shortfall and (n := taken.count() + kept) < quotas[route]:
            raise ValueError(f"{route} has {n} of {quotas[route]} rows")
        parts.append(taken.withColumn("route", F.lit(route)))
        decisions.append(_decided(judged, taken, route, F.col("reason")))
        tried.append(judged.select("id"))
    taken = settled(reduce(DataFrame.unionByName, parts))
    ranked = grouped_rank(taken.withColumn("_turn", digest(seed, F.col("route"), F.col("id"))), ["route"], [F.col("_turn"), F.col("id")], "_nth")
    sizes = settled(taken.groupBy("route").agg((F.floor(F.count(F.lit(1)) / 10)).alias("_tenth")))
    ranked = skew_join(ranked, sizes, ["route"], "inner")
    split = F.when(F.col("_nth") <= F.col("_tenth"), "dev").when(F.col("_nth") <= 2 * F.col("_tenth"), "test").otherwise("train")
    rest = skew_join(records.select("id"), reduce(DataFrame.unionByName, tried).distinct(), ["id"], "left_anti")
    decisions.append(rest.select("id", F.lit(None).cast("string").alias("route"), F.lit("unattempted").alias("reason")))
    if previous is not None:
        decisions.append(used.select("id", "route", F.lit(None).cast("string").alias("reason")))
    return Build(ranked.select("id", "route", split.alias("split")), reduce(DataFrame.unionByName, decisions))


def unfolded(taken: DataFrame) -> DataFrame:
    """id, route, split, step, transition, action of every step of what was taken."""
    steps = F.create_map(*[x for r, s in STEPS.items() for x in (F.lit(r), F.array(*[F.struct(F.lit(t).alias("transition"), F.lit(LEADS_TO[t]).alias("action")) for t in s]))])
    return taken.select("id", "route", "split", F.posexplode(F.try_element_at(steps, F.col("route"))).alias("step", "s")).select("id", "route", "split", "step", "s.transition", "s.action")


def route_plan(available: dict[str, int], ranges: dict[str, tuple[int, int, int]], target: int, step: int = 10) -> dict[str, int] | None:
    """How many rows of each route sum to ``target`` steps, in whole ``step``s, within (least, wanted, most) and what is available; None if none do.

    As many text searches as are wanted, then as many of images and texts; then direct
    answers nearest to what is wanted, nearest to the image searches, and fewest.
    """
    text, both, direct, image = SCARCE_FIRST
    down = lambda n: n // step * step
    cap = {r: down(min(available.get(r, 0), *ranges[r][1:])) for r in (text, both)}
    for n_text in range(cap[text], ranges[text][0] - 1, -step):
        for n_both in range(cap[both], ranges[both][0] - 1, -step):
            found = []
            for n_direct in range(ranges[direct][0], min(ranges[direct][2], available.get(direct, 0)) + 1, step):
                left = target - n_direct - 2 * n_text - 3 * n_both
                n_image = left // 2
                if left >= 0 and left % 2 == 0 and n_image % step == 0 and ranges[image][0] <= n_image <= min(ranges[image][2], available.get(image, 0)):
                    found.append((abs(n_direct - ranges[direct][1]), abs(n_direct - n_image), n_direct, n_image))
            if found:
                _, _, n_direct, n_image = min(found)
                return {text: n_text, both: n_both, direct: n_direct, image: n_image}
    return None


def availability(pool: DataFrame, keys: list[str], most: dict[str, int], free: Callable[[DataFrame], DataFrame]) -> dict[str, int]:
    """How many different groups (by ``keys``) of rows that ``free`` leaves each route of a pool has, counted up to ``most``.

    Any rows will do that have so many groups; only where ``PREFIX`` rows do not, all are counted.
    """
    groups, out = F.count_distinct(*keys), {}
    for route, wanted in most.items():
        rows, n = pool.where(F.col("route") == route).select("id", *keys), 8 * wanted + 1000
        while route not in out and n <= S.PREFIX:
            some = settled(rows.limit(n))
            found = free(some).agg(groups).first()[0]
            if found >= wanted or some.count() < n:
                out[route] = min(found, wanted)
            n *= 8
        if route not in out:
            out[route] = min(free(rows).agg(groups).first()[0], wanted)
    return out


def pool_dataset(pool: DataFrame, exposed: DataFrame, keys: list[str], exposed_keys: list[str], ranges: dict[str, tuple[int, int, int]], target: int, seed: str, exact: bool) -> Build:
    """A dataset of exactly ``target`` steps from a pool (id, route, ``keys``): rows no two of which share a key, none of them a key in ``exposed_keys`` with an exposed row.

    The plan of routes follows from what is available.  Splits: whole groups, eight, one and
    one tenth of each route; if ``exact``, test and dev of exactly a tenth of all steps.
    Decisions: exposed, not_selected, or null for taken rows.  No plan, a route that comes
    short, or a key in two splits is an error.  The pool is read for each route and for the
    decisions, not copied: only its first rows meet what is exposed before it is accounted for.
    """
    pool = pool.withColumn("steps", F.coalesce(*[F.when(F.col("route") == r, F.lit(n)) for r, n in ROUTE_STEPS.items()]).cast("long"))
    known = _values(exposed, exposed_keys)

    def fresh(rows: DataFrame) -> DataFrame:
        return reduce(lambda df, k: skew_join(df, known[k], [k], "left_anti"), known, rows)

    plan = route_plan(availability(pool, keys, {r: max(ranges[r][1:]) for r in ROUTE_STEPS if r in ranges}, fresh), ranges, target)
    if plan is None:
        raise ValueError(f"no plan of routes has {target} steps")
    order = [digest(seed, F.col("id")), F.col("id")]
    chosen = settled(S.select_in_stages(pool, keys, [S.Stage(r, F.col("route") == r, order, n, fresh) for r, n in plan.items()], strict=True).drop("stage", "nth"))
    if exact:
        taken = S.exact_weight_splits(chosen, "steps", "id", seed, {"test": target // 10, "dev": target // 10}, "train")
    else:
        placed = S.component_splits(chosen, "id", "route", keys, {"train": (8, 10), "dev": (1, 10), "test": (1, 10)}, seed)
        taken = skew_join(chosen.withColumn("key", F.col("id").cast("string")), placed.select("key", "split"), ["key"], "inner").drop("key")
    taken = settled(taken)
    if (leak := S.shared_values(taken, "split", keys).first()) is not None:
        raise ValueError(f"{leak['key']} {leak['value']} is in {', '.join(leak['pools'])}")
    seen = _met(_flagged(pool.select("id", "route", *exposed_keys), taken), known, "_exposed")
    reason = F.when(F.col("_exposed"), "exposed").when(~F.col("_taken"), "not_selected")
    return Build(taken.select("id", "route", "split"), seen.select("id", "route", reason.alias("reason")))


def format_view(pool: DataFrame, train: DataFrame, dev: DataFrame, keys: list[str], quotas: list[tuple[str, str, int]], seed: str, strict: bool = True) -> Build:
    """A view of a pool (id, route, source, ``keys``) for learning the format alone: taken rows from sources that training or dev data already have.

    ``train`` and ``dev`` (source) are what they have; a row whose source is in neither is
    forbidden, and so is any row that shares a key with it.  ``quotas`` are (split, route,
    rows) in the order in which they are filled: sources of the split first, then those of
    neither alone, those of the other last, each in a seeded order of the split.  No two
    rows share a key.  The pool is read for each key and copied nowhere but for what is allowed.
    """
    flags = [df.select("source", F.lit(n == 0).alias("_train"), F.lit(n == 1).alias("_dev")) for n, df in enumerate((train, dev))]
    known = settled(flags[0].unionByName(flags[1]).groupBy("source").agg(F.max("_train").alias("_train"), F.max("_dev").alias("_dev")))
    few = lambda df: F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df
    strange = settled(skew_join(pool.select("source").distinct(), known.select("source"), ["source"], "left_anti"))
    others = [k for k in keys if k != "source"]  # a source is forbidden with all of its rows
    forbidden = settled(skew_join(pool.select("source", *others), few(strange), ["source"], "left_semi").select(*others).distinct())
    values = _values(forbidden, others)
    # The key with the fewest forbidden values first: rows that it forbids go no further.
    left, rejected = pool, []
    for _, k in sorted((v.count(), k) for k, v in values.items()):
        rejected.append(skew_join(left, few(values[k]), [k], "left_semi"))
        left = skew_join(left, few(values[k]), [k], "left_anti")
    rejected.append(skew_join(left, known.select("source"), ["source"], "left_anti"))
    allowed = settled(skew_join(left, known, ["source"], "inner"))

    def order(split: str) -> list[Column]:
        own, other = ("_dev", "_train") if split == "dev" else ("_train", "_dev")
        tier = F.when(F.col(own), 0).when(F.col(other), 2).otherwise(1)
        return [tier, digest(seed, F.lit(split), F.col("id")), F.col("id")]

    stages = [S.Stage(f"{split}/{route}", F.col("route") == route, order(split), n) for split, route, n in quotas]
    chosen = S.select_in_stages(allowed, keys, stages, strict=strict)
    taken = settled(chosen.select("id", "route", F.split("stage", "/")[0].alias("split")))
    seen = _flagged(allowed.select("id", "route"), taken).select("id", "route", F.when(~F.col("_taken"), "not_selected").alias("reason"))
    return Build(taken, reduce(DataFrame.unionByName, [df.select("id", "route", F.lit("forbidden").alias("reason")) for df in rejected], seen))


def _last(rows: DataFrame) -> DataFrame:
    """uid, id of the last row (nth, id) of each uid."""
    return rows.groupBy("uid").agg(F.max(F.struct("nth", "id")).alias("_last")).select("uid", F.col("_last.id").alias("id"))


def prompt_pool(candidates: DataFrame, rules: list[tuple[str, Column]], historical: DataFrame, keys: list[str], quotas: list[tuple[str, str, int]], seed: str) -> Build:
    """Prompts (id, uid, nth, category, ``keys``) dealt to pools that share no key: taken (id, route: category, split: pool) and a decision for each row.

    ``rules`` (reason, condition) reject rows, the first that holds; of rows of one uid the
    last (nth) stays ("repeated").  Rows that share a key with ``historical`` go to no pool
    but train.  ``quotas`` are (pool, category, rows) in the order in which they are filled.
    Candidates are read for each pool and for the decisions, not copied: whether a row is the
    last of its uid and new is asked for the first rows of a pool.
    """
    judged = candidates.withColumn("_reason", F.coalesce(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules]))
    sound = judged.where("_reason is null").drop("_reason")
    known = _values(historical, keys)
    few = {k: F.broadcast(v) for k, v in known.items() if v.count() <= FEW}

    def last(rows: DataFrame) -> DataFrame:
        """Of ``rows``, those that are the last of their uid among all sound ones; the uids of first rows are broadcast."""
        uids = rows.select("uid").distinct()
        uids = F.broadcast(uids) if rows.limit(S.PREFIX + 1).count() <= S.PREFIX else uids
        return skew_join(rows, _last(skew_join(sound.select("uid", "nth", "id"), uids, ["uid"], "left_semi")), ["uid", "id"], "left_semi")

    def new(rows: DataFrame) -> DataFrame:
        return last(reduce(lambda df, k: skew_join(df, known[k], [k], "left_anti"), [k for k in keys if k not in few], rows))

    order = [digest(seed, F.col("uid")), F.col("uid"), F.col("id")]
    stages = [(pool, S.Stage(c, (F.col("category") == c) & (F.lit(pool == "train") | ~F.col("_old")), order, n, last if pool == "train" else new)) for pool, c, n in quotas]
    pools = S.isolated_pools(_met(sound, few, "_old"), keys, stages, "id")
    taken = settled(pools.select("id", F.col("category").alias("route"), F.col("pool").alias("split")))
    seen = _flagged(judged.select("id", "uid", "nth", "category", "_reason"), taken).withColumn("_hash", F.xxhash64("uid"))
    rest = seen.where("_reason is null")
    shared = settled(rest.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash"))
    several = settled(skew_join(rest, shared, ["_hash"], "left_semi"))  # only of these can one be repeated
    several = skew_join(several, _last(several).withColumn("_one", F.lit(True)), ["uid", "id"], "left")
    left_over = F.when(~F.col("_taken"), "not_selected")
    parts = [
        (seen.where("_reason is not null"), F.col("_reason")),
        (skew_join(rest, shared, ["_hash"], "left_anti"), left_over),
        (several, F.when(F.col("_one").isNull(), "repeated").otherwise(left_over)),
    ]
    return Build(taken, reduce(DataFrame.unionByName, [df.select("id", F.col("category").alias("route"), reason.alias("reason")) for df, reason in parts]))


def accounted(build: Build) -> DataFrame:
    """route, split, reason, rows: what was taken and what was not, and why."""
    taken = build.taken.groupBy("route", "split").agg(F.count(F.lit(1)).alias("rows")).select("route", "split", F.lit(None).cast("string").alias("reason"), "rows")
    left = build.decisions.where("reason is not null").groupBy("route", "reason").agg(F.count(F.lit(1)).alias("rows")).select("route", F.lit(None).cast("string").alias("split"), "reason", "rows")
    return taken.unionByName(left)
