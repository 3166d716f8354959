"""Fill-in-the-middle: texts cut at unit borders into prefix, middle and suffix, and written in PSM or SPM order.

A streaming matcher reads each text twice.  The first pass counts the units; the second
advances a lazy match iterator to the two drawn ranks and remembers two offsets.  No array
of units is ever made, so a text of many millions of lines needs no more than itself.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, islice
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import unused

LINE = r"[^\n]*\n|[^\n]+"
FLUSH_CHARS = 4_000_000  # characters of output in a batch, but for its last text


class Plan(NamedTuple):
    """How texts are cut: the unit, the seed of the draws, how many of 100 texts are cut, how many of 100 of those are SPM, and the marks of prefix, suffix and middle."""

    unit: str = LINE
    seed: int = 7
    rate: int = 100
    spm: int = 50
    marks: tuple[str, str, str] = ("<P>", "<S>", "<M>")

    def checked(self) -> Plan:
        """The plan, if its marks can be told apart: none may begin with the end of another or of itself."""
        for a in self.marks:
            for b in self.marks:
                inside = a != b and a in b
                if not a or inside or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b))):
                    raise ValueError(f"marks {a!r} and {b!r} overlap")
        if len(set(self.marks)) < 3:
            raise ValueError("the three marks must differ")
        return self


def count_units(unit: re.Pattern, text: str) -> int:
    return sum(1 for _ in unit.finditer(text))


def unit_ends(unit: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Where unit number ``low`` and unit number ``high`` (from 1, low <= high) end; number 0 ends at 0.  One pass."""
    ends = chain((0,), (found.end() for found in unit.finditer(text)))
    first = next(islice(ends, low, None))
    return first, first if high == low else next(islice(ends, high - low - 1, None))


def transformed(plan: Plan, unit: re.Pattern, doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars, output of one text."""
    drawn = hashlib.sha256(f"{plan.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[at : at + 8], 16) for at in (0, 8, 16, 24))
    n = count_units(unit, text)
    if not text or any(mark in text for mark in plan.marks) or h3 % 100 >= plan.rate:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    first, second = unit_ends(unit, text, low, high)
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    p, s, m = plan.marks
    if h4 % 100 < plan.spm:
        return n, "spm", first, second - first, "".join((s, suffix, p, prefix, m, middle))
    return n, "psm", first, second - first, "".join((p, prefix, s, suffix, m, middle))


def infill(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:  # noqa: B008 - a tuple
    """``docs`` (doc_id, text, ...) with the columns n, form, prefix_chars, middle_chars, output in place of text.

    n counts the units of the whole text, however long.  The form is plain (the output is
    the text) for null and empty texts, both of which have the output '', for texts that
    hold a mark, and for those the rate leaves out; else psm or spm.  Lengths are code
    points, null if plain.  Draws depend on the seed and doc_id alone, so repeated rows are
    cut alike and reruns agree; a null doc_id draws like an empty one.  All other columns
    stay, but for those named like a result; an empty table gives no rows.
    """
    results = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}
    kept = [c for c in docs.columns if c != "text" and c.lower() not in results]
    plan, key, body = plan.checked(), unused("_fim_id", docs), unused("_fim_text", docs)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = re.compile(plan.unit)
        for batch in batches:
            ids, texts, rows, chars, start = batch.column(key), batch.column(body), [], 0, 0
            for at in range(batch.num_rows):
                rows.append(transformed(plan, unit, ids[at].as_py(), texts[at].as_py() or ""))
                chars += len(rows[-1][-1])
                if chars >= FLUSH_CHARS or at == batch.num_rows - 1:
                    done = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), results.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(start, len(rows)) for c in kept), *done], [*kept, *results])
                    rows, chars, start = [], 0, at + 1

    source = docs.select(*kept, F.col("doc_id").cast("long").alias(key), F.col("text").cast("string").alias(body))
    added = "n long, form string, prefix_chars long, middle_chars long, output string".split(", ")
    schema = docs.select(*kept, *[F.lit(None).cast(kind).alias(name) for name, kind in map(str.split, added)]).schema
    return source.mapInArrow(cut, schema)


def original(output: Column, form: Column, marks: tuple[str, str, str] = Plan().marks) -> Column:
    """The text that ``infill`` cut, rebuilt from its output and form alone: no part holds a mark, so the marks found are those written."""
    parts = F.split(output, "|".join(f"\\Q{mark}\\E" for mark in marks), -1)
    psm, spm = (F.concat(*[F.get(parts, F.lit(k)) for k in order]) for order in ((1, 3, 2), (2, 3, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
