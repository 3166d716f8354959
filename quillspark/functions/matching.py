"""Answer matching: equality, phrases, token overlap."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T


def _merged(left: Column, right: Column, once: bool) -> Column:
    """How many elements of ``left`` meet an equal one of ``right``, each of these once, or any number of times: both are sorted and walked side by side."""
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("n"))

    def walked(z: Column) -> Column:
        most = F.size(z["a"]) + F.size(z["b"])
        steps = F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>"))

        def step(s: Column, _: Column) -> Column:
            x, y = F.get(z["a"], s["i"]), F.get(z["b"], s["j"])  # null behind the end, where nothing moves on
            one = lambda c: F.when(c, 1).otherwise(0)
            return F.struct((s["i"] + one(x <= y)).alias("i"), (s["j"] + one(y <= x if once else y < x)).alias("j"), (s["n"] + one(x == y)).alias("n"))

        return F.aggregate(steps, start, step, lambda s: s["n"])

    # Bound by a lambda, the arrays are sorted once and not at each step.
    both = F.struct(F.array_sort(left).alias("a"), F.array_sort(right).alias("b"))
    return F.get(F.transform(F.array(both), walked), F.lit(0))


def overlap_count(left: Column, right: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    return _merged(left, right, True)


def token_f1(prediction: Column, target: Column) -> Column:
    """F1 of two token arrays as multisets; 0 where either is empty."""

    def f1(z: Column) -> Column:
        p, t = F.size(z["p"]), F.size(z["t"])
        return T.once(overlap_count(z["p"], z["t"]).cast("double"), lambda common: F.when((p == 0) | (t == 0) | (common == 0), 0.0).otherwise(2 * common / (p + t)))

    return T.once(F.struct(prediction.alias("p"), target.alias("t")), f1)


def tokens_of(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda t: t != "")


def exact_match(prediction: Column, aliases: Column) -> Column:
    """1 if the normalised prediction is not empty and equals a normalised alias."""
    return T.once(T.evaluation_answer(prediction), lambda p: F.coalesce((p != "") & F.exists(aliases, lambda a: T.evaluation_answer(a) == p), F.lit(False)).cast("int"))


def best_alias_f1(prediction: Column, aliases: Column) -> Column:
    said = tokens_of(T.evaluation_answer(prediction))
    best = T.once(said, lambda p: F.array_max(F.transform(aliases, lambda a: token_f1(p, tokens_of(T.evaluation_answer(a))))))
    return F.coalesce(best, F.lit(0.0))


def has_phrase(normal_text: Column, normal_phrase: Column) -> Column:
    """Whether a phrase occurs between word boundaries; an empty phrase never does."""
    padded = lambda x: F.concat(F.lit(" "), x, F.lit(" "))
    return (normal_phrase != "") & F.contains(padded(normal_text), padded(normal_phrase))


def any_phrase(normal_text: Column, aliases: Column, normal) -> Column:
    return F.exists(aliases, lambda a: has_phrase(normal_text, normal(a)))


def leaks_answer(query: Column, aliases: Column) -> Column:
    """Whether a query gives an answer away: as a phrase, or run together if the answer is not ASCII."""
    normal = lambda x: T.protocol_answer(F.regexp_replace(x, r"\p{Punct}", " "))
    q = normal(query)
    compact = F.replace(q, F.lit(" "), F.lit(""))
    return F.exists(aliases, lambda a: has_phrase(q, normal(a)) | (normal(a).rlike(r"[^\x00-\x7F]") & F.contains(compact, normal(a))))


def jaccard(left: Column, right: Column) -> Column:
    """Share of the union of two sets that they have in common; 0 of nothing."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(left, right)) / union)


def copy_ratio(question: Column, query: Column) -> Column:
    """Share of a query's words that the question's core has."""
    q, core = T.words(query), T.without(T.words(question), T.QUESTION_WORDS)
    return F.when(F.size(q) == 0, 0.0).otherwise(_merged(q, F.array_distinct(core), False) / F.size(q))


def shingles(tokens: Column, n: int) -> Column:
    """All runs of ``n`` tokens, joined by spaces; none of shorter arrays.

    Pass a column of a table: it is read for each run.  Elements are fetched one by one,
    since ``slice`` would copy the whole array each time.
    """
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(tokens, i + k) for k in range(n)]))


def hashed_shingles(tokens: Column, n: int) -> Column:
    """``shingles`` as 64-bit hashes of their tokens' hashes: numbers alone travel. Pass a column of a table."""
    starts = F.when(F.size(tokens) >= n, F.sequence(F.lit(0), F.size(tokens) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(tokens, i + k) for k in range(n)]))


def answer_bearing(blob: Column, refs: Column, recall: float = 0.5) -> Column:
    """Whether a text contains a reference, or half of the words of one."""
    found = T.words(blob)
    return F.exists(
        refs,
        lambda r: F.contains(T.quality_text(blob), T.quality_text(r)) & (T.quality_text(r) != "")
        | (F.size(T.words(r)) > 0) & (F.size(F.array_intersect(F.array_distinct(T.words(r)), found)) >= recall * F.size(F.array_distinct(T.words(r)))),
    )
