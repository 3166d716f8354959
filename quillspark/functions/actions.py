"""The action grammar: one reason, then exactly one action, nothing else."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import once

# Tags of the grammar and the errors a reader of it reports.
OPENINGS = ("<search>", "<text_search>", "<answer>")
MARKERS = ("<search>", "</search>", "<img>", "</img>", "<text_search>", "</text_search>", "<answer>", "</answer>")
FORMAT_ERRORS = ("empty_output", "missing_reason", "incomplete_xml", "invalid_xml", "forged_information")
CONTENT_ERRORS = ("empty_reason", "empty_query", "empty_answer")
NAMES = {"answer": "answer", "text_search": "text_search", "search": "image_search"}


def first_rule(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The name of the first pattern that a text has; null for none."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(name)) for p, name in rules])


def times(text: Column, tag: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(tag), F.lit("")))) / len(tag)).cast("int")


def _any(text: Column, tags: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, tags)), lambda t: F.contains(text, t))


def _between(text: Column, tag: str) -> Column:
    """What stands between the tag's first opening and the closing after it; null if either is missing."""
    found = F.regexp_extract(text, rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    return F.when(text.rlike(rf"(?s)<{tag}>.*?</{tag}>"), found)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def parsed_action(raw: Column) -> Column:
    """A struct valid, action, reason, content, error; the first broken rule of the grammar names the error."""
    # Each step reads the one before from a bound struct, so that no expression is computed at each place that names it.
    return once(once(once(_stripped(F.coalesce(raw, F.lit(""))), _parts_of), _action_of), _judged)


def _parts_of(text: Column) -> Column:
    rest = F.regexp_extract(text, r"(?s)</reason>(.*)$", 1)
    return F.struct(
        text.alias("text"), F.lower(text).alias("low"), times(text, "<reason>").alias("opens"), times(text, "</reason>").alias("closes"), _between(text, "reason").alias("reason"),
        F.regexp_extract(text, r"(?s)^(.*?)<reason>", 1).alias("before"), rest.alias("rest"),
    )


def _action_of(p: Column) -> Column:
    rest = p["rest"]
    tag = F.when(F.contains(rest, F.lit("<search>")), "search").when(F.contains(rest, F.lit("<text_search>")), "text_search").otherwise("answer")
    pick = lambda f: F.when(tag == "search", f("search")).when(tag == "text_search", f("text_search")).otherwise(f("answer"))
    return F.struct(
        p.alias("p"), tag.alias("tag"), _stripped(rest).alias("tail"), _stripped(F.coalesce(p["reason"], F.lit(""))).alias("bare"), sum((times(rest, o) for o in OPENINGS), F.lit(0)).alias("actions"),
        pick(lambda t: F.coalesce(_between(rest, t), F.lit(""))).alias("content"),
    )


def _judged(z: Column) -> Column:
    text, low, opens, closes, reason, before, rest = (z["p"][c] for c in ("text", "low", "opens", "closes", "reason", "before", "rest"))
    tag, tail, bare, actions, content = (z[c] for c in ("tag", "tail", "bare", "actions", "content"))
    inner = [F.coalesce(_between(rest, t), F.lit("")) for t in NAMES]
    nested = F.lit(False)
    for i in inner:
        nested = nested | _any(i, OPENINGS)
    pick = lambda f: F.when(tag == "search", f("search")).when(tag == "text_search", f("text_search")).otherwise(f("answer"))
    closed = pick(lambda t: (times(rest, f"<{t}>") == 1) & (times(rest, f"</{t}>") == 1) & rest.rlike(rf"(?s)<{t}>.*</{t}>"))
    outside = pick(lambda t: F.regexp_replace(tail, rf"(?s)<{t}>.*</{t}>", ""))
    image, odd = tag == "search", content.rlike("[<>]")
    rules = [
        (text == "", "empty_output"),
        (low.rlike("</?information"), "forged_information"),
        ((opens > 1) | (closes > 1), "multiple_reasons"),
        ((opens == 0) & (closes == 0) & F.contains(low, F.lit("reason")) & low.rlike("[<>]"), "incomplete_xml"),
        ((opens == 0) & (closes == 0), "missing_reason"),
        ((opens != 1) | (closes != 1) | reason.isNull(), "incomplete_xml"),
        (_stripped(before) != "", "extra_text"),
        (_any(reason, MARKERS), "nested_action"),
        (reason.rlike("[<>]"), "invalid_xml"),
        (bare == "", "empty_reason"),
        ((actions > 1) & nested, "nested_action"),
        (actions > 1, "multiple_actions"),
        ((actions == 0) & rest.rlike("search|answer") & F.contains(rest, F.lit("<")), "incomplete_xml"),
        (actions == 0, "unknown_action"),
        (~closed, "incomplete_xml"),
        (image & ~F.contains(rest, F.lit("<img>")), "invalid_xml"),
        (image & (tail != "<search><img></search>") & _any(F.regexp_replace(F.regexp_replace(F.regexp_replace(tail, "<search>", ""), "^(.*?)<img>", "$1"), "</search>", ""), MARKERS), "nested_action"),
        (image & (tail != "<search><img></search>"), "extra_text"),
        (~image & _any(content, MARKERS), "nested_action"),
        (~image & odd, "invalid_xml"),
        (~image & (_stripped(outside) != ""), "extra_text"),
        (~image & (_stripped(content) == ""), F.when(tag == "answer", "empty_answer").otherwise("empty_query")),
    ]
    return once(F.coalesce(*[F.when(c, F.lit(e) if isinstance(e, str) else e) for c, e in rules]), lambda error: _action(z, error))


def _action(z: Column, error: Column) -> Column:
    fine, image = error.isNull(), z["tag"] == "search"
    kind = F.when(image, "image_search").otherwise(z["tag"])
    return F.struct(
        fine.alias("valid"), F.when(fine, kind).alias("action"), F.when(fine, z["bare"]).alias("reason"),
        F.when(fine, F.when(image, "img").otherwise(_stripped(z["content"]))).alias("content"), error.alias("error"),
    )


def exactly_one_action(raw: Column) -> Column:
    return sum((times(raw, o) for o in OPENINGS), F.lit(0)) == 1


def tags_closed(raw: Column) -> Column:
    """Whether each tag of the grammar opens as often as it closes."""
    out = F.lit(True)
    for t in ("reason", "search", "text_search", "answer"):
        out = out & (times(raw, f"<{t}>") == times(raw, f"</{t}>"))
    return out


def detected_action(raw: Column) -> Column:
    """The action whose tag a text has, whether or not it parses."""
    return F.coalesce(*[F.when(F.contains(raw, F.lit(f"<{t}>")), F.lit(NAMES[t])) for t in ("search", "text_search", "answer")])


def error_category(error: Column) -> Column:
    return F.when(error.isNull(), "ok").when(error.isin(*FORMAT_ERRORS), "format").when(error.isin(*CONTENT_ERRORS), "content").otherwise("structure")


def target_segments(raw: Column) -> Column:
    """kind, start (from 1) and length of the reason's and the action's content, where present."""

    def part(tag: str) -> Column:
        found = _between(raw, tag)
        start = F.locate(f"<{tag}>", raw) + len(tag) + 2
        return F.when(found.isNotNull(), F.struct(F.lit(tag).alias("kind"), start.cast("int").alias("start"), F.length(found).alias("length")))

    return F.array_compact(F.array(*[part(t) for t in ("reason", "text_search", "answer")]))


def redacted(json: Column, secret: Column) -> Column:
    """A flat JSON object's text with the value of the named field replaced."""
    fields = F.from_json(json, "map<string,string>")
    safe = F.transform_values(fields, lambda k, v: F.when(k == secret, F.lit('"[redacted]"')).otherwise(v))
    pairs = F.transform(F.map_entries(safe), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))
