"""What a question asks for: the first of many ordered patterns that it has.

A pattern is told as words; what regular expression it is, and which words a question must
have for it to be tried at all, follow from that.  So a question is held against the few
patterns that its words allow, in one expression, and not against all of them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.text import compatibility_fold

# Patterns of relations in their order: name, relation, words. Words follow each other, or stand apart where ".." is
# between them; "a|b" is either, "(a b)" may be missing, and "_" is a blank within an alternative.
RELATIONS = (
    ("who_is_architect", "architect", "who is|was the architect"),
    ("who_architected", "architect", "who .. architected"),
    ("who_commissioned", "commissioner", "who .. commissioned"),
    ("who_designed", "designer", "who (was) designed"),
    ("who_designed_object", "designer", "who .. designed"),
    ("who_is_designer", "designer", "who is the designer"),
    ("who_built", "builder", "who (was) built"),
    ("who_built_object", "builder", "who .. built"),
    ("who_created", "creator", "who (was) created"),
    ("who_created_object", "creator", "who .. created"),
    ("who_painted", "artist", "who (was) painted"),
    ("who_is_artist", "artist", "who is the artist"),
    ("who_sculpted", "sculptor", "who (was) sculpted"),
    ("who_manufactured", "manufacturer", "who (was) manufactured"),
    ("who_invented", "inventor", "who (was) invented"),
    ("who_invented_object", "inventor", "who .. invented"),
    ("who_discovered", "discoverer", "who .. discovered"),
    ("who_wrote", "author", "who .. wrote|authored"),
    ("who_directed", "director", "who .. directed|filmed"),
    ("who_composed", "composer", "who .. composed|scored"),
    ("who_founded", "founder", "who .. founded|established"),
    ("who_owns", "owner", "who .. own|owns|owned"),
    ("who_played", "performer", "who .. played|portrayed"),
    ("who_photographed", "photographer", "who .. photographed"),
    ("who_is_creator", "creator", "who is|was the creator"),
    ("who_is_author", "author", "who is|was the author"),
    ("who_is_director", "director", "who is|was the director"),
    ("who_is_composer", "composer", "who is|was the composer"),
    ("who_is_founder", "founder", "who is|was the founder"),
    ("who_is_owner", "owner", "who is|was the owner"),
    ("who_is_operator", "operator", "who is|was the operator"),
    ("who_is_manufacturer", "manufacturer", "who is|was the manufacturer"),
    ("who_is_photographer", "photographer", "who is|was the photographer"),
    ("company_made", "manufacturer", "which company|manufacturer .. made"),
    ("company_manufactured", "manufacturer", "which|what company|manufacturer .. manufactured"),
    ("company_produced", "manufacturer", "which|what company|brand .. made|makes|produced|produces|manufactured"),
    ("organization_operates", "operator", "who|which_organization .. operate|operates"),
    ("where_born", "birthplace", "where .. born|birthplace"),
    ("where_died", "death_place", "where .. died|buried"),
    ("where_made", "origin", "where .. made|manufactured|produced|originated"),
    ("where_headquartered", "headquarters", "where .. headquartered"),
    ("where_located", "location", "where .. located"),
    ("where_is", "location", "where is"),
    ("which_location", "location", "which city|country|state|region"),
    ("what_location", "location", "what city|country|state|region"),
    ("when_built", "construction_date", "when .. built|constructed"),
    ("year_built", "construction_date", "what year .. built|constructed"),
    ("when_created", "creation_date", "when .. created"),
    ("year_created", "creation_date", "what year .. created"),
    ("when_founded", "founding_date", "when .. founded|established"),
    ("when_born", "birth_date", "when .. born"),
    ("when_died", "death_date", "when .. died|deceased"),
    ("when_event", "event_date", "when|what_year .. released|published|opened|introduced|launched|completed|invented|discovered|manufactured"),
    ("what_nationality", "nationality", "what (is the) nationality"),
    ("what_occupation", "occupation", "what (is the) occupation|profession"),
    ("what_style", "style", "what|which (is the) genre|style|movement"),
    ("what_language", "language", "what|which (is the) language"),
    ("what_species", "classification", "what|which (is the) breed|species"),
    ("what_dimensions", "dimensions", "how|what tall|high|long|wide"),
    ("what_dimension_noun", "dimensions", "what (is the) height|length|width"),
    ("what_capital", "capital", "what (is the) capital"),
    ("what_affiliation", "affiliation", "what|which (is the) team|club|university|college"),
    ("associated_organization", "association", "what organization|event .. associated"),
    ("material_made", "material", "what material .. made"),
    ("which_material", "material", "which material"),
    ("what_material", "material", "what is the material"),
)
#: What a query puts before the entity, where it is not the relation's words and "of".
PREFIXES = {"style": "genre style of", "classification": "breed species of", "event_date": "date of", "association": "organization associated with"}
# Kinds of questions in their order; any of the words, wherever they stand.
KINDS = (
    ("time", "when|what_year|date|how_old|century|centuries"),
    ("place", "where|which_country|which_continent|located"),
    ("person", "who|whose|founder|founded|designed|architect"),
    ("quantity", "how_many|how_much|number|percent|percentage"),
    ("diet", "eat|diet|food|feed"),
    ("material", "material|made_of|constructed_from"),
    ("purpose", "used_for|use_of|purpose|known_for|depict"),
    ("type", "what_type|what_kind|classification|species"),
    ("attribute", "what_does|what_is|which_group|conditions|preparation|relative|damaged|closed|opened|started|finished"),
)


def prefix_of(relation: str) -> str:
    return PREFIXES.get(relation, f"{relation.replace('_', ' ')} of")


def expression_of(words: str, blank: str = r"\s+") -> tuple[str, list[list[str]]]:
    """The regular expression of a pattern's words, and for each place that must be filled the words of which a text needs one."""
    parts, needs = [], []
    for piece in re.findall(r"\([^)]*\)|\S+", words):
        if piece == "..":
            parts[-1] = parts[-1].removesuffix(blank)
            parts.append(r"\b.*\b")
        elif piece.startswith("("):
            parts.append(f"(?:{piece[1:-1].replace(' ', blank)}{blank})?")
        else:
            choices = piece.split("|")
            told = "|".join(c.replace("_", blank) for c in choices)
            parts.append((f"(?:{told})" if len(choices) > 1 else told) + blank)
            needs.append([c.split("_")[0] for c in choices])
    return rf"\b{''.join(parts).removesuffix(blank)}\b", needs


def _first(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """The name of the first pattern (name, words) that a plain text has, or null; only those that its words allow are tried."""
    told = [(name, *expression_of(w)) for name, w in patterns]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(f"(?U){e}").alias("expression"), F.array(*[F.array(*map(F.lit, x)) for x in needs]).alias("needs")) for n, e, needs in told])
    # The text goes along with each pattern, since a lambda may not look at what Python has folded.
    asked = F.struct(text.alias("text"), F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), 1).alias("words"))
    each = F.arrays_zip(rows.alias("p"), F.array_repeat(asked, len(told)).alias("q"))
    fit = F.filter(each, lambda x: F.forall(x["p"]["needs"], lambda any_of: F.arrays_overlap(any_of, x["q"]["words"])) & F.regexp_like(x["q"]["text"], x["p"]["expression"]))
    return F.get(fit, F.lit(0))["p"]["name"]


def plain_question(question: Column) -> Column:
    """A question in its compatibility form, without case, single-spaced."""
    return F.trim(F.regexp_replace(compatibility_fold(F.coalesce(question, F.lit(""))), r"(?U)\s+", " "))


def question_relation(question: Column) -> Column:
    """struct<name, relation, prefix> of the first relation that a question asks for; its fields are null for none."""
    name = _first(plain_question(question), [(n, w) for n, _, w in RELATIONS])
    relations = F.create_map(*[x for n, r, _ in RELATIONS for x in (F.lit(n), F.struct(F.lit(r).alias("relation"), F.lit(prefix_of(r)).alias("prefix")))])
    found = F.try_element_at(relations, name)
    return F.struct(name.alias("name"), found["relation"].alias("relation"), found["prefix"].alias("prefix"))


def question_kind(question: Column) -> Column:
    """The first kind that a question is of; "unknown" for none."""
    return F.coalesce(_first(F.lower(F.coalesce(question, F.lit(""))), list(KINDS)), F.lit("unknown"))


def case_sql(text: str, patterns: list[tuple[str, str]]) -> str:
    """A CASE of DuckDB SQL that names the first pattern that ``text``, an expression, has."""
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{expression_of(w)[0]}') THEN '{n}'" for n, w in patterns) + " END"
