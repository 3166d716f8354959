"""Blocks of search results as a model sees them: written by rank, and parsed again with the place of what is wrong."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import text as T

# The lines of a block.
OPEN, CLOSE = "<information>", "</information>"
HEADERS = {
    "image": "[Image Search Results] Cached results ranked in original cache order:",
    "text": "[Text Search Results] Cached webpage titles ranked by deterministic BM25:",
    "frozen_image": "[Image Search Results]",
    "frozen_text": "[Text Search Results]",
}
PLACEHOLDERS = ("<|vision_start|>", "<|image_pad|>", "<|vision_end|>")
# How a result's text names the entity that an image shows.
ENTITY_PATTERNS = (r"(?i)identifies the query image as\s+(.+?)\.\s+Official", r"(?i)^([^\n|]{2,100}?)\s+-\s+(?:Wikipedia|Wikimedia Commons)\b")
_DOCUMENT = r"\[cache_document=([^\]]+)\]"


def safe_line(text: Column) -> Column:
    """A text on one line, its markup escaped."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "), "^ | $", "")
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")), flat)


def _unescaped(text: Column) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[1]), F.lit(pair[0])), ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")), text)


def information_block(kind: str, items: Column) -> Column:
    """A block of a kind of HEADERS with its items (array of struct<text, document_id>, best first); null for none."""
    before, after = ("title: " if kind == "image" else ""), (lambda x: F.concat(F.lit(" [cache_document="), x["document_id"], F.lit("]"))) if kind == "text" else (lambda x: F.lit(""))
    lines = F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(f". {before}"), safe_line(x["text"]), after(x)))
    return F.when(F.size(items) > 0, F.array_join(F.concat(F.array(F.lit(OPEN), F.lit(HEADERS[kind])), lines, F.array(F.lit(CLOSE))), "\n"))


def parsed_block(block: Column) -> Column:
    """struct<kind, items, fault, line> of a block: what ``information_block`` was given (texts on one line), or the first fault and its line.

    Faults: no opening, unknown header, wrong rank (what is no line of the next rank),
    no title, no document, no results, no closing.
    """
    lines = F.split(F.coalesce(block, F.lit("")), "\n")
    header = F.get(lines, F.lit(1))
    kind = F.coalesce(*[F.when(header == h, F.lit(k)) for k, h in HEADERS.items()])
    body = F.slice(lines, 3, F.greatest(F.lit(0), F.size(lines) - 3))
    last = F.element_at(lines, -1)

    def item(line: Column, i: Column) -> Column:
        ranked = F.startswith(line, F.concat((i + 1).cast("string"), F.lit(". ")))
        rest = F.substring(line, F.length((i + 1).cast("string")) + 3, F.length(line))
        document = F.regexp_extract(rest, rf" {_DOCUMENT}$", 1)
        fault = F.when(~ranked, "wrong rank").when((kind == "image") & ~F.startswith(rest, F.lit("title: ")), "no title").when((kind == "text") & (document == ""), "no document")
        text = F.when(kind == "image", F.regexp_replace(rest, "^title: ", "")).when(kind == "text", F.regexp_replace(rest, rf" {_DOCUMENT}$", "")).otherwise(rest)
        return F.struct(_unescaped(text).alias("text"), F.when(kind == "text", document).alias("document_id"), fault.alias("fault"))

    items = F.transform(body, item)
    wrong = F.filter(F.transform(items, lambda x, i: F.struct((i + 3).alias("line"), x["fault"].alias("fault"))), lambda x: x["fault"].isNotNull())
    first = F.get(wrong, F.lit(0))
    fault = F.when(F.get(lines, F.lit(0)) != OPEN, "no opening").when(kind.isNull(), "unknown header").when(last != CLOSE, "no closing").when(F.size(body) <= 0, "no results").otherwise(first["fault"])
    line = F.when(fault.isNull(), None).when(fault == "no opening", 1).when(fault == "unknown header", 2).when(fault.isin("no closing", "no results"), F.size(lines)).otherwise(first["line"])
    sound = F.transform(items, lambda x: F.struct(x["text"].alias("text"), x["document_id"].alias("document_id")))
    return F.struct(F.when(fault.isNull(), kind).alias("kind"), F.when(fault.isNull(), sound).alias("items"), fault.alias("fault"), line.cast("int").alias("line"))


def has_placeholder(text: Column) -> Column:
    """Whether a text has a mark that stands for an image's content."""
    return reduce(Column.__or__, [F.contains(text, F.lit(p)) for p in PLACEHOLDERS])


def text_results(messages: Column) -> Column:
    """The results (array of struct<document_id, title>) that a state's messages (array of struct<role, content>) show: ranked lines of the tool's text searches."""
    shown = F.filter(messages, lambda m: (m["role"] == "tool") & F.contains(m["content"], F.lit("[Text Search Results]")))
    lines = F.flatten(F.transform(shown, lambda m: F.transform(F.split(m["content"], r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))))
    ranked = F.filter(lines, lambda x: x.rlike(r"^\d"))
    title = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, _DOCUMENT, ""), r"^\d+\.\s*", ""), r"(?U)^\s+|\s+$", "")
    return F.transform(ranked, lambda x: F.struct(F.regexp_extract(x, _DOCUMENT, 1).alias("document_id"), title(x).alias("title")))


def identified_entities(calls: Column) -> Column:
    """The entities that successful image searches name, each normalised form once, in order; calls are array of struct<tool, status, results: array<string>>."""
    texts = F.flatten(F.transform(F.filter(calls, lambda c: (c["tool"] == "image_search") & (c["status"] == "success")), lambda c: c["results"]))

    def entity(text: Column) -> Column:
        found = F.coalesce(*[F.when(text.rlike(p), F.trim(F.regexp_extract(text, p, 1))) for p in ENTITY_PATTERNS])
        return F.regexp_replace(found, r"(?i)^file:\s*", "")

    pairs = F.transform(texts, lambda t: F.struct(T.evaluation_answer(F.coalesce(entity(t), F.lit(""))).alias("form"), entity(t).alias("entity")))
    kept = F.filter(pairs, lambda p: p["form"] != "")
    forms = F.transform(kept, lambda p: p["form"])
    first = F.filter(F.transform(kept, lambda p, i: F.struct(p["entity"].alias("entity"), (F.array_position(forms, p["form"]) == i + 1).alias("first"))), lambda p: p["first"])
    return F.transform(first, lambda p: p["entity"])
