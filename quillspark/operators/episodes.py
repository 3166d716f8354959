"""Episodes of tool use: route grammar, failures, paired runs, accepted answers, terminal rewards."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.exchange import settled, skew_join

# The steps of each route, as (what leads to what, action).
ROUTES = {
    "direct_answer": [("initial_to_direct_answer", "answer")],
    "image_search_answer": [("initial_to_image_search", "image_search"), ("image_information_to_answer", "answer")],
    "text_search_answer": [("initial_to_text_search", "text_search"), ("text_information_to_answer", "answer")],
    "image_text_search_answer": [
        ("initial_to_image_search", "image_search"), ("image_information_to_text_search", "text_search"), ("text_information_to_answer", "answer"),
    ],
}
#: Fields of a source row that may hold accepted answers, the first first.
ANSWER_FIELDS = ("answer_aliases", "alternative_gt_answers", "answers", "gt_answer", "answer", "answer_eval", "original_answer", "entity_aliases")


def _steps(route: str) -> Column:
    return F.array(*[F.struct(F.lit(t).alias("transition"), F.lit(a).alias("action")) for t, a in ROUTES[route]])


def follows_route(route: Column, steps: Column) -> Column:
    """Whether steps (array of struct<transition, action>) are those of the route; an unknown route has none."""
    expected = F.create_map(*[x for r in ROUTES for x in (F.lit(r), _steps(r))])
    bare = F.transform(steps, lambda s: F.struct(s["transition"].alias("transition"), s["action"].alias("action")))
    return F.coalesce(F.try_element_at(expected, route) == bare, F.lit(False))


def constructed(route: Column, contents: Column) -> Column:
    """The steps of a route with their contents (array of strings, one a step): null where their numbers differ."""
    made = F.create_map(*[x for r in ROUTES for x in (F.lit(r), _steps(r))])
    steps = F.try_element_at(made, route)
    filled = F.zip_with(steps, contents, lambda s, c: F.struct(s["transition"].alias("transition"), s["action"].alias("action"), c.alias("content")))
    return F.when(F.size(steps) == F.size(contents), filled)


def repeats_search(calls: Column) -> Column:
    """Whether two calls (array of struct<tool, query>) are of one tool and one normalised query."""
    signs = F.transform(calls, lambda c: F.concat_ws("\u0001", c["tool"], T.evaluation_answer(F.coalesce(c["query"], F.lit("")))))
    return T.once(signs, lambda s: F.size(s) != F.size(F.array_distinct(s)))


def copies_span(answer: Column, correct: Column, calls: Column) -> Column:
    """Whether a wrong answer stands in a result of a successful call (array of struct<status, results: array<string>>)."""
    held = lambda said: F.exists(calls, lambda c: (c["status"] == "success") & F.exists(c["results"], lambda r: F.contains(T.evaluation_answer(r), said)))
    return ~correct & T.once(T.evaluation_answer(F.coalesce(answer, F.lit(""))), lambda said: (said != "") & F.coalesce(held(said), F.lit(False)))


def copies_entity(answer: Column, accepted: Column, entities: Column, asks_for_entity: Column) -> Column:
    """The first entity that an answer repeats though no accepted answer is it; null for none, and where the question asks for an entity."""
    # Each text is normalised once, not for every pair that is compared.
    forms = lambda x: T.once(T.evaluation_answer(x), lambda n: F.struct(x.alias("text"), n.alias("normal"), T.person_core(n).alias("core")))
    same = lambda a, b: (a["normal"] == b["normal"]) | (a["core"] == b["core"])
    every = F.struct(forms(answer).alias("answer"), F.transform(accepted, forms).alias("accepted"), F.transform(entities, forms).alias("entities"))
    wrong = T.once(every, lambda z: F.filter(z["entities"], lambda e: same(z["answer"], e) & ~F.exists(z["accepted"], lambda a: same(a, e))))
    return F.when(~asks_for_entity & (F.trim(answer) != ""), F.get(wrong, F.lit(0))["text"])


def paired(left: DataFrame, right: DataFrame, key: str, identity: Iterable[str], expected: int | None = None) -> DataFrame:
    """Two runs side by side: key, the ``identity`` columns, and the others of each side as left_ and right_.

    It is an error if a key repeats or is on one side alone, if the number of pairs is not
    the expected one, or if a pair differs in an identity column.
    """
    same = list(identity)
    sides = []
    for name, run in (("left", left), ("right", right)):
        rows, keys = run.agg(F.count(F.lit(1)), F.count_distinct(key)).first()
        if rows != keys:
            raise ValueError(f"{key} repeats or is null in the {name} run")
        sides.append(run.select(key, *[F.col(c).alias(f"{name}_{c}") for c in run.columns if c != key], F.lit(True).alias(f"{name}_has")))
    both = settled(sides[0].join(sides[1], key, "full"))
    differs = [~F.col(f"left_{c}").eqNullSafe(F.col(f"right_{c}")) for c in same]
    counts = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("left_has").isNull() | F.col("right_has").isNull()).alias("alone"), *[F.count_if(d).alias(f"of_{c}") for c, d in zip(same, differs, strict=True)]).first()
    if counts["alone"]:
        raise ValueError(f"{counts['alone']} keys are in one run alone")
    if expected is not None and counts["n"] != expected:
        raise ValueError(f"{counts['n']} pairs, not {expected}")
    if bad := [c for c in same if counts[f"of_{c}"]]:
        raise ValueError(f"pairs differ in {', '.join(bad)}")
    return both.drop("left_has", "right_has", *[f"right_{c}" for c in same]).withColumnsRenamed({f"left_{c}": c for c in same})


def unique_aliases(values: Column) -> Column:
    """The strings of an array, collapsed and without blank ones, the first of each lower-case form."""
    plain = F.filter(F.transform(values, lambda v: T.collapsed(v)), lambda v: v.isNotNull() & (v != ""))
    found = T.once(plain, lambda p: F.struct(p.alias("plain"), F.transform(p, lambda v: F.lower(v)).alias("folded")))
    return T.once(found, lambda z: F.filter(z["plain"], lambda v, i: F.array_position(z["folded"], F.get(z["folded"], i)) == i + 1))


def answer_aliases(row: Column, fields: tuple[str, ...] = ANSWER_FIELDS) -> Column:
    """The accepted answers of a source row (map<string, string>) from its answer fields.

    A field is a string, a JSON list, or a JSON object with a list or string under aliases,
    answers or text.
    """

    as_list = lambda x: F.when(x.startswith("["), F.from_json(x, "array<string>")).otherwise(F.array(F.regexp_replace(x, '^"(.*)"$', "$1")))

    def listed(value: Column) -> Column:
        inner = F.coalesce(*[F.get_json_object(value, f"$.{k}") for k in ("aliases", "answers", "text")])
        found = F.when(value.startswith("{"), T.once(inner, as_list)).otherwise(as_list(value))
        return F.coalesce(F.when(value != "", found), F.array().cast("array<string>"))

    # One reading of each field for all of them: the row is built once.
    values = T.once(row, lambda r: F.array(*[F.trim(F.try_element_at(r, F.lit(name))) for name in fields]))
    return unique_aliases(F.flatten(F.transform(values, listed)))


def last_user_message(messages: Column) -> Column:
    """The content of the last message (array of struct<role, content>) that a user wrote."""
    return F.try_element_at(F.filter(messages, lambda m: m["role"] == "user"), F.lit(-1))["content"]


def representatives(components: DataFrame, rejected: DataFrame) -> DataFrame:
    """component, representative of (id, component): the least id that is not in ``rejected`` (id), or of all where each is."""
    marked = skew_join(components, rejected.select("id").distinct().withColumn("_out", F.lit(1)), ["id"], "left")
    best = marked.groupBy("component").agg(F.min(F.struct(F.coalesce("_out", F.lit(0)).alias("out"), "id")).alias("b"))
    return best.select("component", F.col("b.id").alias("representative"))


def terminal_reward(exact: Column, f1: Column, gold: Column, said: Column, quality: Column) -> Column:
    """struct<quality, grounded, bonus, terminal>: answer quality and a bonus for grounded answers that are not perfect; all within 0 and 1."""
    unit = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    grounded = quality * unit(gold) * unit(said)
    bonus = 0.15 * (1 - quality) * grounded
    return F.struct((4 * unit(exact) + unit(f1)).alias("dominance"), grounded.alias("grounded"), bonus.alias("bonus"), unit(quality + bonus).alias("terminal"))


def alignment_error(stored: Column, again: Column, mask: Column | None = None) -> Column:
    """The largest distance of two arrays of numbers where the mask is not 0; 0 of nothing, null of unequal lengths."""
    gaps = F.zip_with(stored, again, lambda a, b: F.abs(a - b))
    if mask is not None:
        gaps = F.transform(F.filter(F.arrays_zip(gaps.alias("gap"), mask.alias("on")), lambda x: x["on"] != 0), lambda x: x["gap"])
    return F.when(F.size(stored) == F.size(again), F.coalesce(F.array_max(gaps), F.lit(0.0)))
