"""Seeded splits, quotas, and the small combinatorial choices that follow an aggregation.

Rows are ordered by seeded hashes and cut by rank in Spark.  Choices over a few groups or
classes (largest remainders, subset sums, flows) run on the driver over counts whose
number a parameter bounds.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.hashing import digest, uniform
from quillspark.operators.exchange import grouped_rank, settled, skew_join


def seeded_rank(by: list[str], seed: str, key: str) -> Column:
    """Rank from 1 of a row among those equal in ``by``, in the order of a seeded hash of its key."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(digest(seed, F.col(key)), key))


def banded(df: DataFrame, by: list[str], seed: str, key: str, quotas: list[tuple[str, int]], rest: str | None = None) -> DataFrame:
    """Rows with ``split``: by rank in each group the first quota, then the next; beyond them ``rest`` or out.

    Only ranks within the quotas are found: Spark keeps so many rows of a group in each task
    before the exchange.  ``key`` tells rows apart.
    """
    case, at = F.lit(None).cast("string"), 0
    for name, n in quotas:
        case = F.coalesce(case, F.when(F.col("_rank") <= at + n, F.lit(name)))
        at += n
    chosen = df.withColumn("_rank", seeded_rank(by, seed, key)).where(F.col("_rank") <= at).withColumn("split", case).drop("_rank")
    if rest is None:
        return chosen
    return skew_join(df, chosen.select(key, "split"), [key], "left").withColumn("split", F.coalesce("split", F.lit(rest)))


def round_robin(df: DataFrame, stratum: str, seed: str, key: str, most: int) -> DataFrame:
    """``most`` rows, one of each stratum in turn, each stratum in its seeded order."""
    ranked = df.withColumn("_nth", seeded_rank([stratum], seed, key)).where(F.col("_nth") <= most)
    return ranked.orderBy("_nth", stratum, key).limit(most).drop("_nth")


def rarity_order(df: DataFrame, dimensions: list[str], seed: str, key: str) -> tuple[DataFrame, list[Column]]:
    """``df`` with how often each row's value of each dimension occurs, and sort keys that put rare ones first."""
    for d in dimensions:
        df = skew_join(df, df.groupBy(d).agg(F.count(F.lit(1)).alias(f"_often_{d}")), [d], "inner")
    return df, [*[F.col(f"_often_{d}") for d in dimensions], digest(seed, F.col(key)), F.col(key)]


def replaced(failed: DataFrame, spare: DataFrame, by: str, key: str) -> DataFrame:
    """``key`` of each failed row and ``reserve``, that of the spare row of the same place in its group, null where spares run out."""
    a, b = (grouped_rank(df.select(key, by), [by], [F.col(key)]) for df in (failed, spare))
    return skew_join(a, b.withColumnRenamed(key, "reserve"), [by, "rank"], "left").select(key, "reserve")


def quota_epoch(df: DataFrame, stratum: str, quotas: dict[str, int], seed: str, key: str) -> DataFrame:
    """The rows of strata that have a quota, with ``times``: each stratum in its seeded order, again and again until the quota is full."""
    names = df.sparkSession.createDataFrame(sorted(quotas.items()), f"{stratum} string, _quota long")  # a row for each quota
    return _repeated(df.join(F.broadcast(names), stratum), stratum, seed, key).where("times > 0").drop("_quota")


def _repeated(df: DataFrame, stratum: str, seed: str, key: str) -> DataFrame:
    """``df`` (with ``_quota``) and how often each row comes in its stratum's quota."""
    ranked = grouped_rank(df.withColumn("_turn", digest(seed, F.col(key))), [stratum], [F.col("_turn"), F.col(key)], "_nth")
    sizes = ranked.groupBy(stratum).agg(F.max("_nth").alias("_size"))
    ranked = skew_join(ranked, sizes, [stratum], "inner")
    times = F.floor(F.col("_quota") / F.col("_size")) + F.when(F.col("_nth") <= F.col("_quota") % F.col("_size"), 1).otherwise(0)
    return ranked.withColumn("times", times.cast("long")).drop("_turn", "_nth", "_size")


def mixed_epoch(df: DataFrame, stratum: str, natural: float, seeds: tuple[str, str], key: str) -> DataFrame:
    """``df`` with by_nature, whether a row is in the natural share of the epoch, and by_balance, how often in the balanced rest."""
    rows, strata = df.agg(F.count(F.lit(1)), F.count_distinct(stratum)).first()
    quota = int(rows * (1 - natural)) // max(1, strata)
    balanced = _repeated(df.withColumn("_quota", F.lit(quota).cast("long")), stratum, seeds[1], key).drop("_quota").withColumnRenamed("times", "by_balance")
    return balanced.withColumn("by_nature", uniform(digest(seeds[0], F.col(key))) < natural)


def largest_remainders(weights: dict[str, float], total: int) -> dict[str, int]:
    """``total`` shared in proportion to the weights, whole; what is left goes to the largest fractions, ties by name."""
    mass = sum(weights.values())
    exact = {k: total * w / mass for k, w in weights.items()} if mass else dict.fromkeys(weights, 0.0)
    out = {k: int(x) for k, x in exact.items()}
    for k in sorted(weights, key=lambda k: (out[k] - exact[k], k))[: total - sum(out.values()) if mass else 0]:
        out[k] += 1
    return out


def exact_subset(weights: list[tuple[str, int]], target: int) -> list[str] | None:
    """Names whose weights sum to the target, the earlier preferred; None if there are none."""
    reach = {0: None}
    for i, (_, w) in enumerate(weights):
        for total in sorted(reach, reverse=True):
            if (new := total + w) <= target and new not in reach:
                reach[new] = (i, total)
    if target not in reach:
        return None
    names, at = [], target
    while at:
        i, at = reach[at]
        names.append(weights[i][0])
    return names[::-1]


def fill_splits(sizes: list[tuple[str, int]], capacities: dict[str, int]) -> dict[str, str]:
    """Groups to splits, the largest first, each to the split with most room left (ties in the splits' order)."""
    left, out = dict(capacities), {}
    for name, n in sorted(sizes, key=lambda x: (-x[1], x[0])):
        split = max(left, key=lambda s: left[s])
        out[name] = split
        left[split] -= n
    return out


def group_split(groups: DataFrame, shares: dict[str, float], seed: str, large: int = 1000) -> DataFrame:
    """group, n, split of groups (group, n): whole groups to splits by share, the largest first to where most room is left.

    Choosing one by one is for the ``large`` largest groups alone, which decide how even the
    splits come out; the others, each smaller than any of these, follow a seeded hash in
    proportion to the room then left.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    first = groups.orderBy(F.desc("n"), "group").limit(large)
    chosen = fill_splits([(r["group"], r["n"]) for r in first.collect()], {k: total * v for k, v in shares.items()})  # ``large`` rows at most
    used = dict.fromkeys(shares, 0)
    placed = groups.sparkSession.createDataFrame(sorted(chosen.items()), "group string, chosen string") if chosen else None
    if placed is None:
        return groups.withColumn("split", F.lit(None).cast("string"))
    both = settled(groups.join(F.broadcast(placed), "group", "left"))  # ``large`` rows at most
    used |= {r["chosen"]: r["n"] for r in both.where("chosen is not null").groupBy("chosen").agg(F.sum("n").alias("n")).collect()}
    room = {k: max(0.0, total * v - used[k]) for k, v in shares.items()}
    u, below, rest = uniform(digest(seed, F.col("group"))) * sum(room.values()), 0.0, None
    for k, v in room.items():
        below += v
        rest = F.when(u < below, F.lit(k)) if rest is None else rest.when(u < below, F.lit(k))
    return both.select("group", "n", F.coalesce("chosen", rest.otherwise(F.lit(list(shares)[-1]))).alias("split"))


def best_plan(available: dict[str, int], ranges: dict[str, tuple[int, int, int]], target: int, step: int = 10) -> dict[str, int] | None:
    """Counts of each route within (least, wanted, most) and what is available that sum to the target nearest to the wanted.

    The distance to what is wanted is convex in each count, so steps are given one by one to
    where they cost least (ties to the later route): no plan is better.  Work grows with the
    number of routes, not of plans.
    """
    counts = {n: lo for n, (lo, _, _) in ranges.items()}
    most = {n: lo + max(-1, (min(hi, available.get(n, 0)) - lo) // step) * step for n, (lo, _, hi) in ranges.items()}
    left, names = target - sum(counts.values()), list(ranges)
    if left < 0 or left % step or any(most[n] < counts[n] for n in names):
        return None
    steps = left // step
    while steps:
        # Runs of steps of equal cost are taken at once: those up to what is wanted, the one across it, those beyond.
        open_ones = [n for n in names if counts[n] < most[n]]
        if not open_ones:
            return None
        cost = {n: abs(counts[n] + step - ranges[n][1]) - abs(counts[n] - ranges[n][1]) for n in open_ones}
        n = min(reversed(open_ones), key=lambda n: cost[n])
        room, wanted = (most[n] - counts[n]) // step, ranges[n][1] - counts[n]
        run = min(room, steps, max(1, wanted // step) if wanted >= step else 1 if wanted > 0 else room)
        counts[n] += run * step
        steps -= run
    return counts


def pattern_flow(patterns: dict[tuple[str, ...], int], quota: dict[str, int]) -> dict[tuple[tuple[str, ...], str], int]:
    """How many rows of each eligibility pattern serve each type, as many as can be: a maximum flow by shortest paths.

    Rows of a pattern are alike, so the network has a node for each pattern, not for each row.
    """
    room = {("s", p): n for p, n in patterns.items()} | {(t, "e"): n for t, n in quota.items()}
    room |= {(p, t): patterns[p] for p in patterns for t in p if t in quota}
    links: dict = {}
    for a, b in [*room]:
        links.setdefault(a, []).append(b)
        links.setdefault(b, []).append(a)
        room.setdefault((b, a), 0)
    while True:
        came, queue = {"s": None}, deque(["s"])
        while queue and "e" not in came:
            a = queue.popleft()
            for b in links.get(a, ()):
                if b not in came and room[a, b] > 0:
                    came[b] = a
                    queue.append(b)
        if "e" not in came:
            return {(p, t): room[t, p] for p in patterns for t in p if t in quota and room[t, p]}
        path, at = [], "e"
        while came[at] is not None:
            path.append((came[at], at))
            at = came[at]
        n = min(room[x] for x in path)
        for a, b in path:
            room[a, b] -= n
            room[b, a] += n


def equal_capacity(patterns: dict[tuple[str, ...], int], types: list[str]) -> int:
    """The most rows that every type can have at once (by bisection on the flow)."""
    low, high = 0, sum(patterns.values())
    while low < high:
        mid = (low + high + 1) // 2
        full = sum(pattern_flow(patterns, dict.fromkeys(types, mid)).values()) == mid * len(types)
        low, high = (mid, high) if full else (low, mid - 1)
    return low


def greedy_cover(shards: list[tuple[str, set, int]], most: int) -> list[str]:
    """Up to ``most`` shards (name, members, bytes), each time the one that adds most members, ties to fewer bytes, then by name."""
    covered, chosen, left = set(), [], list(shards)
    while left and len(chosen) < most:
        best = min(left, key=lambda s: (-len(s[1] - covered), s[2], s[0]))
        if not best[1] - covered:
            break
        chosen.append(best[0])
        covered |= best[1]
        left.remove(best)
    return chosen


def shard_cover(held: DataFrame, sizes: DataFrame, most: int) -> list[str]:
    """``greedy_cover`` of shards however many: ``held`` has shard and member, ``sizes`` shard and bytes; a pass over both for each pick."""
    left, chosen = settled(held.select("shard", "member").distinct()), []
    for _ in range(most):
        gains = left.groupBy("shard").agg(F.count(F.lit(1)).alias("gain")).join(sizes, "shard")
        best = gains.agg(F.min(F.struct((-F.col("gain")).alias("loss"), "bytes", "shard")).alias("b")).first()["b"]
        if best is None:
            break
        chosen.append(best["shard"])
        won = left.where(F.col("shard") == best["shard"]).select("member")
        left = settled(skew_join(left, won, ["member"], "left_anti"))
    return chosen


def unique_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """A greedy choice of rows in order such that no value of any key repeats.

    A row whose place is least among the remaining rows of each of its keys is what the
    sequential greedy would take; such rows are taken together and their rivals dropped,
    until none is left.  Each round takes at least the first row left; rounds follow the
    longest chain of rivals, not the rows.  Rows are put in order once, and places and keys
    alone travel in the rounds; list the key with the fewest values first.
    """
    placed = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id()))
    left, taken = placed.select("_place", *keys), []
    while not left.isEmpty():
        least = [left.groupBy(k).agg(F.min("_place").alias("_place")).select("_place") for k in keys]
        best = reduce(DataFrame.unionByName, least).groupBy("_place").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(keys))
        best = settled(skew_join(left, best.select("_place"), ["_place"], "left_semi"))
        taken.append(best.select("_place"))
        for k in keys:
            left = skew_join(left, best.select(k), [k], "left_anti")
        left = settled(left)
    return skew_join(placed, reduce(DataFrame.unionByName, taken), ["_place"], "left_semi").select(*df.columns) if taken else df.limit(0)
