"""Exact quotas, component splits and selections in tiers.

Greedy choices keep the meaning of the sequential rule they state, but run in rounds over
all rows: a row is taken once none before it has a claim on its keys.  Where the rule looks
at sizes or weights alone, rows of equal ones are a class: how many of a class go where
follows from counts, and ranks in a seeded order say which.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import cache, reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.hashing import digest
from quillspark.operators.exchange import connected_components, grouped_rank, settled, skew_join
from quillspark.operators.splits import unique_on

PREFIX = 50_000  # rows that one task sorts out as the first ones
SAMPLE = 20_000  # rows that tell where a share of the rows ends, about; what is chosen does not depend on them

# --- exact weights --------------------------------------------------------------------------------


def reachable(counts: dict[int, int], target: int) -> int:
    """The sums up to ``target`` that ``counts`` of each weight can make, as the bits of a number."""
    bits, most = 1, (1 << (target + 1)) - 1
    for weight, n in counts.items():
        part = 1
        while n > 0:  # 1, 2, 4, ... of them at once, then the rest
            taken = min(part, n)
            bits |= bits << (weight * taken) & most
            n, part = n - taken, 2 * part
    return bits


def exact_counts(counts: dict[int, int], target: int) -> dict[int, int] | None:
    """How many of each weight sum to ``target``, as near to their share as the sum allows; None if none do.

    Weights are settled from the largest down, each to the count nearest to its share of
    what is left that the smaller ones can complete, the smaller of two equally near ones.
    """
    out, weights = {}, sorted((w for w in counts if counts[w] and w > 0), reverse=True)
    reach = [reachable({w: counts[w] for w in weights[k:]}, target) for k in range(len(weights) + 1)]
    if not reach[0] >> target & 1:
        return None
    left = target
    for k, w in enumerate(weights):
        mass = sum(v * counts[v] for v in weights[k:])
        share, most = counts[w] * left / mass, min(counts[w], left // w)
        tried = sorted(range(most + 1), key=lambda n: (abs(n - share), n)) if most < 1000 else _outwards(share, most)
        out[w] = next(n for n in tried if reach[k + 1] >> (left - n * w) & 1)
        left -= out[w] * w
    return out


def _outwards(middle: float, most: int) -> Iterator[int]:
    """0 to ``most``, the nearest to ``middle`` first."""
    low, high = int(middle), int(middle) + 1
    while low >= 0 or high <= most:
        if low > most or high <= most and (low < 0 or high - middle < middle - low):
            yield high
            high += 1
        else:
            yield low
            low -= 1


def take_exact_weight(df: DataFrame, weight: str, key: str, seed: str, target: int) -> DataFrame:
    """Rows of ``df`` whose weights sum to ``target`` exactly: of each weight those first in a seeded order; ValueError if there are none.

    Only a count for each weight reaches the driver.
    """
    counts = {r[weight]: r["count"] for r in df.groupBy(weight).count().collect()}  # a row for each weight
    chosen = exact_counts({w: n for w, n in counts.items() if w is not None}, target)
    if chosen is None:
        raise ValueError(f"no rows weigh {target} together")
    wanted = df.sparkSession.createDataFrame(sorted(chosen.items()), f"{weight} long, _wanted long") if chosen else None
    if wanted is None:
        return df.limit(0)
    ranked = grouped_rank(df.withColumn("_turn", digest(seed, F.col(key))), [weight], [F.col("_turn"), F.col(key)], "_nth")
    return ranked.join(F.broadcast(wanted), weight).where(F.col("_nth") <= F.col("_wanted")).select(*df.columns)  # a row for each weight


def exact_weight_splits(df: DataFrame, weight: str, key: str, seed: str, targets: dict[str, int], rest: str) -> DataFrame:
    """``df`` with split: for each target in turn, rows of exactly that weight among those left; the rest go to ``rest``.

    ``key`` tells rows apart.
    """
    left, parts = settled(df), []
    for name, target in targets.items():
        taken = settled(take_exact_weight(left, weight, key, seed, target).withColumn("split", F.lit(name)))
        parts.append(taken)
        left = settled(skew_join(left, taken.select(key), [key], "left_anti"))
    return reduce(DataFrame.unionByName, [*parts, left.withColumn("split", F.lit(rest))])


def one_step_quotas(targets: dict[str, int], ones: int) -> dict[str, int]:
    """How many of ``ones`` rows of weight 1 each of the splits dev, test and train gets, so that rows of weight 2 fill the rest.

    Of all ways the one nearest to the splits' shares, ties to fewer in dev, then in test;
    ValueError if there is none.  Only counts near the shares and near the bounds are looked
    at, since distance is convex.
    """
    total = sum(targets.values()) or 1
    share = {k: ones * t / total for k, t in targets.items()}

    def near(name: str, extra: Iterable[float] = ()) -> list[int]:
        most = min(ones, targets[name])
        found = {int(x) + d for x in (share[name], 0, most, *extra) for d in range(-6, 7)}
        return sorted(n for n in found if 0 <= n <= most and (targets[name] - n) % 2 == 0)

    best = None
    for dev in near("dev", (ones - targets["train"] - targets["test"], ones - targets["train"] - share["test"])):
        for test in near("test", (ones - dev - targets["train"], ones - dev, ones - dev - share["train"])):
            train = ones - dev - test
            if 0 <= train <= targets["train"] and (targets["train"] - train) % 2 == 0:
                found = {"dev": dev, "test": test, "train": train}
                score = (sum(abs(found[k] - share[k]) for k in ("dev", "test", "train")), dev, test)
                if best is None or score < best[0]:
                    best = score, found
    if best is None:
        raise ValueError("rows of weight 1 and 2 cannot fill the splits exactly")
    return best[1]


def exact_split(df: DataFrame, weight: str, key: str, seed: str, targets: dict[str, int]) -> DataFrame:
    """``df`` (rows of weight 1 or 2) with split, dev, test or train, whose weights are exactly the targets.

    Each weight's rows are cut in a seeded order: dev first, then test, then train.  Targets
    that do not sum to all weights, other weights, and keys that repeat are errors.
    """
    weights = {r[weight]: r["count"] for r in df.groupBy(weight).count().collect()} if df.where(~F.coalesce(F.col(weight).isin(1, 2), F.lit(False))).isEmpty() else None  # two rows
    if weights is None:
        raise ValueError("weights must be 1 or 2")
    if sum(w * n for w, n in weights.items()) != sum(targets.values()):
        raise ValueError("targets do not sum to all weights")
    if (twice := df.groupBy(key).count().where("count > 1").first()) is not None:
        raise ValueError(f"{key} {twice[0]} repeats")
    ones = one_step_quotas(targets, weights.get(1, 0))
    quotas = {1: ones, 2: {k: (targets[k] - ones[k]) // 2 for k in targets}}
    ranked = grouped_rank(df.withColumn("_turn", digest(seed, F.col(key))), [weight], [F.col("_turn"), F.col(key)], "_nth")

    def split(w: int) -> Column:
        dev, test = quotas[w]["dev"], quotas[w]["dev"] + quotas[w]["test"]
        return F.when(F.col("_nth") <= dev, "dev").when(F.col("_nth") <= test, "test").otherwise("train")

    return ranked.withColumn("split", F.when(F.col(weight) == 1, split(1)).otherwise(split(2))).select(*df.columns, "split")


# --- whole components ------------------------------------------------------------------------------------


def components_on(df: DataFrame, keys: list[str], key: str) -> DataFrame:
    """key and component (its least key) of rows that hang together by equal values of any of ``keys``; nulls are equal to none."""
    rows = settled(df.select(F.col(key).cast("string").alias("key"), *keys).withColumn("id", F.monotonically_increasing_id()))
    edges = []
    for k in keys:
        first = rows.where(F.col(k).isNotNull()).groupBy(k).agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        edges.append(skew_join(rows.select(k, F.col("id").alias("b")), first, [k], "inner").select("a", "b"))
    linked = connected_components(reduce(DataFrame.unionByName, edges))
    placed = skew_join(rows.select("id", "key"), linked, ["id"], "left").withColumn("component", F.coalesce("component", "id"))
    names = placed.groupBy("component").agg(F.min("key").alias("name"))
    return skew_join(placed, names, ["component"], "inner").select("key", F.col("name").alias("component"))


class Placing(NamedTuple):
    """So many components of a class go to a split, the first of them with this score."""

    split: str
    order: int
    n: int
    score: int


def place_class(contribution: dict[str, int], n: int, room: dict[str, dict[str, int]], splits: tuple[str, ...]) -> list[Placing]:
    """Where ``n`` components of one contribution (route: rows) go, each in turn to the split with most room left for its routes; takes that room.

    A component fits where no route runs over; of equal splits the first counts.  The k-th
    component of a split finds its room less by k times its size, so what a split takes is
    a run of equal steps, and the n best of all runs are found by bisection on the score.
    """
    size = sum(contribution.values())
    fits = {s: min(room[r][s] // c for r, c in contribution.items()) for s in splits}
    scores = {s: sum(room[r][s] for r in contribution) for s in splits}
    if sum(fits.values()) < n:
        raise ValueError(f"no room for {n} components of {contribution}")

    def above(score: int) -> dict[str, int]:
        """How many steps of each split score more than ``score``."""
        return {s: max(0, min(fits[s], -(-(scores[s] - score) // size))) for s in splits}

    low, high = min(scores.values()) - size * max(fits.values()) - 1, max(scores.values())
    while low + 1 < high:  # the least score with fewer than or just n steps above it
        mid = (low + high) // 2
        low, high = (low, mid) if sum(above(mid).values()) <= n else (mid, high)
    taken = above(high)
    for s in splits:  # steps that score just that, in the order of the splits
        if sum(taken.values()) < n and taken[s] < fits[s] and scores[s] - size * taken[s] == high:
            taken[s] += 1
    for r, c in contribution.items():
        for s in splits:
            room[r][s] -= c * taken[s]
    return [Placing(s, k, taken[s], scores[s]) for k, s in enumerate(splits) if taken[s]]


def component_splits(df: DataFrame, key: str, route: str, keys: list[str], shares: dict[str, tuple[int, int]], seed: str) -> DataFrame:
    """key, component, split: whole components to splits so that every route has its share exactly.

    ``shares`` maps splits, the preferred first, to fractions.  The largest components come first, those of
    one size and one contribution to the routes together, in a seeded order of their
    names; each goes to the split with most room left for its routes.  A route whose rows the
    fractions do not divide, or components that do not fit, are errors.  Only a row for
    each kind of component reaches the driver.
    """
    placed = settled(skew_join(df.select(F.col(key).cast("string").alias("key"), F.col(route).alias("route")), components_on(df, keys, key), ["key"], "inner"))
    parts = placed.groupBy("component", "route").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("route", "n")))  # as many as routes
    kinds = settled(parts.groupBy("component").agg(entries.alias("contribution"), F.sum("n").alias("size")))
    classes = kinds.groupBy("size", "contribution").agg(F.count(F.lit(1)).alias("n")).collect()
    splits, room = tuple(shares), {}
    for found in classes:
        for r in found["contribution"]:
            room[r["route"]] = room.get(r["route"], 0) + r["n"] * found["n"]
    for r, n in room.items():
        if any(n * a % b for a, b in shares.values()):
            raise ValueError(f"{n} rows of {r} do not divide into the splits")
        room[r] = {s: n * a // b for s, (a, b) in shares.items()}
    rows = []
    for found in sorted(classes, key=lambda c: (-c["size"], [tuple(r) for r in c["contribution"]])):
        kind = [tuple(r) for r in found["contribution"]]
        rows += [(found["size"], kind, *p) for p in place_class(dict(kind), found["n"], room, splits)]
    if not rows:
        return placed.select("key", "component", F.lit(None).cast("string").alias("split"))
    plan = df.sparkSession.createDataFrame(rows, "size long, contribution array<struct<route:string,n:long>>, split string, `order` int, n long, score long")
    # The place of a split's j-th step among all steps of its class: by score, then in the order of the splits.
    steps = plan.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select("size", "contribution", "split", "order", (F.col("score") - F.col("size") * F.col("j")).alias("at"))
    steps = grouped_rank(steps, ["size", "contribution"], [F.desc("at"), F.col("order")], "nth")
    ranked = grouped_rank(kinds.withColumn("turn", digest(seed, F.col("component"))), ["size", "contribution"], [F.col("turn"), F.col("component")], "nth")
    names = skew_join(ranked.select("component", "size", "contribution", "nth"), settled(steps.select("size", "contribution", "nth", "split")), ["size", "contribution", "nth"], "inner")
    return skew_join(placed.select("key", "component"), names.select("component", "split"), ["component"], "inner").select("key", "component", "split")


# --- selection in tiers ----------------------------------------------------------------------------------


class Stage(NamedTuple):
    """A pool of a selection: its name, which rows may enter, their order, and how many are taken (None: all).

    ``free`` drops more rows that may not enter, each whatever the others it is given are;
    it is asked for the first rows alone, as long as these do.
    """

    name: str
    where: Column
    order: list[Column]
    most: int | None
    free: Callable[[DataFrame], DataFrame] = lambda rows: rows


def _without(df: DataFrame, used: Sequence[DataFrame], keys: list[str]) -> DataFrame:
    """``df`` without the rows that share a value of any key with ``used``."""
    for rows in used:
        for k in keys:
            df = skew_join(df, rows.select(k).where(F.col(k).isNotNull()).distinct(), [k], "left_anti")
    return df


def _first_chosen(rows: DataFrame, order: list[Column], wanted: int | None, choose: Callable[[DataFrame], DataFrame], whole: Callable[[], DataFrame]) -> DataFrame:
    """The rows of ``choose(rows)`` with nth, their place in ``order``, up to ``wanted``.

    What ``choose`` takes of the first rows must not depend on later ones.  So few rows are found among
    the first of all, eight times as many where these do not suffice; only beyond PREFIX
    rows, or where all are wanted, is ``whole`` asked for what is chosen from all rows.
    """
    rank = lambda df: grouped_rank(df.withColumn("_all", F.lit(1)), ["_all"], order, "nth").drop("_all")
    n = None if wanted is None else 8 * wanted + 1000
    while n is not None and n <= PREFIX:
        first = settled(rows.orderBy(*order).limit(n))
        chosen = settled(choose(first))
        if chosen.count() >= wanted or first.count() < n:
            return settled(rank(chosen).where(F.col("nth") <= wanted))
        n *= 8
    ranked = rank(whole())
    return settled(ranked if wanted is None else ranked.where(F.col("nth") <= wanted))


def _unique_of_many(rows: DataFrame, used: Sequence[DataFrame], keys: list[str], stage: Stage, wanted: int | None) -> DataFrame:
    """``unique_on`` of a stage's rows without those that share a value with ``used``: of about the first 3 in order for each wanted, of all where these do not do.

    Any cut in the order gives the same rows, so a sample tells where to cut.
    """
    rows = stage.free(rows)
    if used:
        rows = settled(_without(rows, [reduce(DataFrame.unionByName, [p.select(*keys) for p in used])], keys))
    if wanted is not None and (n := rows.count()) > 4 * wanted:
        share, place = min(1.0, SAMPLE / n), F.struct(*stage.order)
        cut = rows.sample(share, seed=1).select(place.alias("_cut")).orderBy("_cut").limit(round(share * 3 * wanted)).agg(F.max("_cut").alias("_cut"))
        first = rows.crossJoin(F.broadcast(settled(cut))).where(place <= F.col("_cut")).drop("_cut")  # one row
        chosen = settled(unique_on(first, keys, stage.order))
        if chosen.count() >= wanted:
            return chosen
    return unique_on(rows, keys, stage.order)


def select_in_stages(df: DataFrame, keys: list[str], stages: list[Stage], most: int | None = None, strict: bool = False) -> DataFrame:
    """``df`` with stage and nth, of the rows that a greedy choice takes, stage by stage: no two share a value of any of ``keys``.

    A stage takes rows in its order until it has enough; later stages may not use the
    values of its rows.  With ``most`` the stages share that limit.  Orders must end with
    what tells rows apart.  If strict, a stage that comes short is an error.
    """
    parts, left = [], most
    # The key with the fewest values goes first: most rows that cannot be taken drop out there.
    fewest_first = cache(lambda: [keys[i] for i in sorted(range(len(keys)), key=df.agg(*[F.approx_count_distinct(k) for k in keys]).first().__getitem__)])
    for stage in stages:
        wanted = stage.most if left is None else left if stage.most is None else min(left, stage.most)
        choose = lambda rows, stage=stage, used=tuple(parts): unique_on(_without(stage.free(rows), used, keys), keys, stage.order)
        whole = lambda stage=stage, used=tuple(parts), wanted=wanted: _unique_of_many(df.where(stage.where), used, fewest_first(), stage, wanted)
        taken = _first_chosen(df.where(stage.where), stage.order, wanted, choose, whole)
        parts.append(taken.withColumn("stage", F.lit(stage.name)))
        if strict or left is not None:
            n = parts[-1].count()
            left = None if left is None else left - n
            if strict and wanted is not None and n < wanted:
                raise ValueError(f"{stage.name} has {n} of {wanted} rows")
    return reduce(DataFrame.unionByName, parts)


def isolated_pools(df: DataFrame, keys: list[str], stages: list[tuple[str, Stage]], key: str, strict: bool = False) -> DataFrame:
    """``df`` with pool and stage, of the rows that pools take in turn: rows of one pool may share values of ``keys``, rows of two may not.

    ``stages`` are (pool, stage); stages of one pool follow each other.  ``key`` tells rows apart.
    """
    held, parts = cache(lambda: settled(df)), []
    for pool, stage in stages:
        others, own = [p for n, p in parts if n != pool], [p for n, p in parts if n == pool]

        def free(rows: DataFrame, stage=stage, others=tuple(others), own=tuple(own)) -> DataFrame:
            return reduce(lambda df, p: skew_join(df, p.select(key), [key], "left_anti"), own, _without(stage.free(rows), others, keys))

        found = _first_chosen(df.where(stage.where), stage.order, stage.most, free, lambda stage=stage, free=free: free(held().where(stage.where)))
        chosen = found.drop("nth").withColumns({"pool": F.lit(pool), "stage": F.lit(stage.name)})
        if strict and stage.most is not None and (n := chosen.count()) < stage.most:
            raise ValueError(f"{pool} {stage.name} has {n} of {stage.most} rows")
        parts.append((pool, chosen))
    return reduce(DataFrame.unionByName, [p for _, p in parts])


def shared_values(df: DataFrame, pool: str, keys: list[str]) -> DataFrame:
    """key, value, pools of each value of ``keys`` that rows of several pools share."""
    each = df.select(F.col(pool).alias("pool"), F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("k")).select("pool", "k.key", "k.value")
    met = each.where("value is not null").groupBy("key", "value").agg(F.array_sort(F.collect_set("pool")).alias("pools"))
    return met.where(F.size("pools") > 1)
