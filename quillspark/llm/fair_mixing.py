"""Mixing sources to target weights by weighted fair queueing.

Each source's documents queue in a shuffled order, again for a second and third time
after its end.  A document's virtual finish time is its source's words so far over the
source's target; finish times are range-sorted over all sources, and the order is
truncated where the budget is used up.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from quillspark.llm.common import WORD, checkpointed, skew_join, unused

MOST_COPIES = 3
BUCKET_ROWS = 1024  # rows of a source that a window orders at once, on average at most
RUN_ROWS = 4096
RANGE_ROWS = 50_000  # entries of a range of finish times
COARSE_BITS = 10
PLACE = ("finish", "no_id", "id", "no_source", "source", "size", "nth", "copy")


def source_targets(totals: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = MOST_COPIES) -> DataFrame:
    """``totals`` (source, source_size) with each source's target.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of
    all sizes; a target stops at ``most`` times its source's size and the excess is shared
    again by weight until none is above.  Only sums pass through the driver.
    """
    rows = totals.count()
    ranked = totals.withColumn("_null", F.col("source").isNull()).repartitionByRange(max(1, rows // 100_000), "_null", "source")
    ranked = checkpointed(ranked.sortWithinPartitions("_null", "source").withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_id", 33)
    starts, before = {}, 0
    for row in ranked.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row per 100,000 sources
        starts[row["part"]], before = before, before + row["count"]
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), part) if starts else F.lit(0)
    nth = (offset + F.col("_id").bitwiseAND(2**33 - 1)) % len(weights)
    weighed = ranked.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), (nth + 1).cast("int")).cast("double").alias("weight"))
    budget = weighed.agg(F.sum("source_size")).first()[0] or 0
    rate, above = 0.0, F.lit(False)
    while True:
        free, bound = weighed.agg(F.sum(F.when(~above, F.col("weight"))), F.sum(F.when(above, F.col("source_size")))).first()
        if not free:
            break
        rate = (budget - most * (bound or 0)) / free
        now = F.col("weight") * rate > most * F.col("source_size")
        if weighed.where(now & ~above).isEmpty():
            break
        above = now
    target = F.when(above, most * F.col("source_size").cast("double")).otherwise(F.col("weight") * rate)
    return weighed.select("source", "source_size", target.alias("target"))


def _sizes(text: str = "text") -> Column:
    return F.regexp_count(F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(WORD)).cast("long")


def _queued(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, source, size, nth, source_size, target, done: the source's words up to and with this document.

    Rows that agree in doc_id, source and size are numbered (nth), so each has a turn of its
    own that depends on the rows alone, and no bucket of turns is crowded.
    """
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), _sizes().alias("size"))
    equal = checkpointed(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    rows, most = equal.agg(F.sum("n"), F.max("n")).first()
    runs = equal.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN_ROWS))))
    if (most or 0) > RUN_ROWS:
        runs = runs.repartition(max(2, most // RUN_ROWS // 16))
    nth = F.sequence(F.col("run") * RUN_ROWS, F.least("n", (F.col("run") + 1) * RUN_ROWS) - 1)
    sized = runs.select("doc_id", "source", "size", F.explode(nth).alias("nth"))
    sized = checkpointed(sized.withColumn("turn", F.xxhash64(F.lit(seed), "doc_id", "size", "nth")))
    bits = max(0, math.ceil(math.log2(max(1, rows or 0) / BUCKET_ROWS)))
    sized = sized.withColumn("bucket", F.shiftrightunsigned(F.shiftrightunsigned("turn", 1), 63 - bits) if bits else F.lit(0).cast("long"))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("n")).withColumn("coarse", F.shiftright("bucket", max(0, bits - COARSE_BITS)))
    sums = checkpointed(sums)
    up_to = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    coarse = sums.groupBy("source", "coarse").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(up_to("source", "coarse")), F.lit(0)))
    fine = sums.withColumn("within", F.coalesce(F.sum("n").over(up_to("source", "coarse", "bucket")), F.lit(0)))
    fine = skew_join(fine.drop("n"), coarse.drop("n"), ["source", "coarse"], "inner").select("source", "bucket", (F.col("before") + F.col("within")).alias("before"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("n").alias("source_size")))
    starts = skew_join(fine, targets, ["source"], "inner")
    own = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "size", "nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("within", F.sum("size").over(own))
    placed = skew_join(placed, starts, ["source", "bucket"], "inner")
    return placed.select("doc_id", "source", "size", "nth", "source_size", "target", (F.col("before") + F.col("within")).alias("done"))


def _place(copy: Column) -> Column:
    """Where a copy of a queued document leaves: by finish time, then by doc_id and source (null last), so that no two places are equal."""
    finish = (F.col("done") + copy * F.col("source_size")) / F.col("target")
    document = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0).cast("long")), F.col("source").isNull(), F.coalesce("source", F.lit("")), F.col("size"), F.col("nth")]
    return F.struct(*[c.alias(n) for n, c in zip(PLACE, [finish, *document, copy.cast("long")], strict=True)])


def last_within_budget(queue: DataFrame) -> Column | None:
    """The last place of the global order whose words the budget, the sum of all sizes, still has; None for no words.

    All places are dealt to ranges of the order; their sums say in which range the budget
    ends, and that range alone is sorted.
    """
    copies = F.explode(F.array(*[F.lit(k) for k in range(MOST_COPIES)]))
    entries = queue.where("size > 0").withColumn("copy", copies).select(_place(F.col("copy")).alias("place"), F.col("size").alias("words"))
    budget, rows = queue.agg(F.sum("size"), F.count(F.lit(1))).first()
    ranges = max(1, MOST_COPIES * rows // RANGE_ROWS)
    ranged = checkpointed(entries.repartitionByRange(ranges, "place").withColumn("range", F.spark_partition_id()))
    used = 0
    for number, words in sorted(ranged.groupBy("range").agg(F.sum("words")).collect()):  # a row for each RANGE_ROWS entries
        if used + words > budget:
            break
        used += words
    else:
        return None if not budget else _literal(ranged.agg(F.max("place")).first()[0])
    order = Window.partitionBy("range").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    within = ranged.where(F.col("range") == number).withColumn("used", F.lit(used) + F.sum("words").over(order)).where(F.col("used") <= budget)
    last = within.agg(F.max("place")).first()[0] or ranged.where(F.col("range") < number).agg(F.max("place")).first()[0]
    return _literal(last) if last else None


def _literal(place: Row) -> Column:
    return F.struct(*[F.lit(place[n]).cast("double" if n == "finish" else "long" if isinstance(place[n], int) and not isinstance(place[n], bool) else ("boolean" if isinstance(place[n], bool) else "string")).alias(n) for n in PLACE])


def weighted_fair_mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, text): doc_id, size, source_size, target, taken, copies.

    Size is the number of words [^\\x20\\x09-\\x0D]+ (null text: 0), of the whole text however
    long; taken the words that the mix takes of the document, repeats counted, at most three
    times its size.  Null sources are a source of their own.  Documents without words take
    nothing; repeated rows queue one by one; equal finish times leave in the order of doc_id,
    null last; other columns are ignored; an empty table gives no rows.  The seed sets the
    shuffle: reruns agree, however the rows are dealt.
    """
    queue = checkpointed(_queued(docs, seed))
    last = last_within_budget(queue)
    taken = [F.when(_place(F.lit(k)) <= last, 1).otherwise(0) for k in range(MOST_COPIES)] if last is not None else [F.lit(0)]
    copies = F.when(F.col("size") > 0, reduce(Column.__add__, taken)).otherwise(0)
    return queue.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def apply_mix(docs: DataFrame, seed: int = 17) -> DataFrame:
    """The rows of ``docs`` the mix takes, each as often as it is taken, with all their columns.

    Rows that share doc_id, source and size share their copies evenly, whichever of them
    come first taking one more; the rest is as in ``weighted_fair_mix``.
    """
    size, copies, rows, part, nth, before, all_of_part, copy = (unused(n, docs) for n in ("_size", "_copies", "_rows", "_part", "_nth", "_before", "_n", "_copy"))
    key = ["doc_id", "source", size]
    mixed = weighted_fair_mix(docs, seed).withColumnRenamed("size", size)
    shares = checkpointed(mixed.groupBy(*key).agg(F.sum("copies").alias(copies), F.count(F.lit(1)).alias(rows)).where(F.col(copies) > 0))
    named = docs.withColumn(size, _sizes()).withColumns({c: F.col(c).cast(t) for c, t in (("doc_id", "long"), ("source", "string"))})
    joined = skew_join(named, shares, key, "inner")
    if not shares.where(F.col(rows) > 1).isEmpty():
        shared = checkpointed(joined.where(F.col(rows) > 1).withColumn(part, F.spark_partition_id()).withColumn(nth, F.monotonically_increasing_id()))
        # Ranks of rows that share a key: within a partition, and after all of the partitions before.
        earlier = Window.partitionBy(*key).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
        starts = shared.groupBy(*key, part).agg(F.count(F.lit(1)).alias(all_of_part)).withColumn(before, F.coalesce(F.sum(all_of_part).over(earlier), F.lit(0)))
        shared = shared.withColumn(nth, F.row_number().over(Window.partitionBy(*key, part).orderBy(nth)))
        shared = skew_join(shared, checkpointed(starts.drop(all_of_part)), [*key, part], "inner")
        more = F.when(F.col(before) + F.col(nth) <= F.col(copies) % F.col(rows), 1).otherwise(0)
        shared = shared.withColumn(copies, F.floor(F.col(copies) / F.col(rows)) + more).where(F.col(copies) > 0)
        joined = joined.where(F.col(rows) == 1).unionByName(shared.select(*joined.columns))
    taken = joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    return taken.select(*[F.col(f.name).cast(f.dataType) for f in docs.schema.fields])
