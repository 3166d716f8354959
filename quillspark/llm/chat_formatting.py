"""Chat formatting: records of many layouts become canonical turns, and turns become training text with a loss mask.

A record's schema is the set of its nested field paths, such as ``messages[].role``; the
hash of that set is its fingerprint.  A fingerprint selects a declarative mapping, which
says where the turns are, and is resolved once in each task.  Records whose paths no mapping accounts for
keep their fingerprint and stay apart: nothing is guessed and nothing lost.

Turns are written by a template whose control strings are escaped within texts, so that the
output alone gives back every role and text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import unused

# --- layouts ---


class Turn(NamedTuple):
    """Where a turn is: its role, a name after ``=`` or else a path, and the paths of its text; paths start at each item of the list at ``each``."""

    role: str
    text: tuple[str, ...]
    each: str = ""


class Layout(NamedTuple):
    """A declarative mapping: the paths that a record must have, those that it may have, and its turns in order."""

    name: str
    needs: tuple[str, ...]
    turns: tuple[Turn, ...]
    may: tuple[str, ...] = ()
    roles: bool = True  # whether other names of the roles become canonical


#: Paths that say nothing of the dialogue, with all that lies below them.
ASIDE = ("conv_id", "id", "uuid", "source", "dataset", "category", "lang", "language", "model", "metadata", "meta", "tags", "score", "timestamp", "created")
SYSTEM = Turn("=system", ("system",))
LAYOUTS = (
    Layout("turn", ("role", "text"), (Turn("role", ("text",)),), may=("turn",), roles=False),
    Layout("messages", ("messages[].role", "messages[].content"), (SYSTEM, Turn("role", ("content",), "messages[]")), may=("system", "messages[].name")),
    Layout("message_parts", ("messages[].role", "messages[].content[].text"), (SYSTEM, Turn("role", ("content[].text",), "messages[]")), may=("system", "messages[].content[].type", "messages[].content")),
    Layout("data_messages", ("data.messages[].role", "data.messages[].content"), (Turn("role", ("content",), "data.messages[]"),)),
    Layout("from_value", ("conversations[].from", "conversations[].value"), (SYSTEM, Turn("from", ("value",), "conversations[]")), may=("system",)),
    Layout("exchanges", ("conversation[].human", "conversation[].assistant"), (SYSTEM, Turn("=user", ("human",), "conversation[]"), Turn("=assistant", ("assistant",), "conversation[]")), may=("system",)),
    Layout("instruction_output", ("instruction", "output"), (SYSTEM, Turn("=user", ("instruction", "input")), Turn("=assistant", ("output",))), may=("input", "system")),
    Layout("instruction_response", ("instruction", "response"), (SYSTEM, Turn("=user", ("instruction", "context")), Turn("=assistant", ("response",))), may=("context", "system")),
    Layout("prompt_completion", ("prompt", "completion"), (SYSTEM, Turn("=user", ("prompt",)), Turn("=assistant", ("completion",))), may=("system",)),
    Layout("prompt_response", ("prompt", "response"), (SYSTEM, Turn("=user", ("prompt",)), Turn("=assistant", ("response",))), may=("system",)),
    Layout("prompt_messages", ("prompt[].role", "prompt[].content", "completion[].role", "completion[].content"), (Turn("role", ("content",), "prompt[]"), Turn("role", ("content",), "completion[]"))),
    Layout("preference", ("prompt", "chosen", "rejected"), (SYSTEM, Turn("=user", ("prompt",)), Turn("=assistant", ("chosen",))), may=("system",)),
    Layout("question_answer", ("question", "answer"), (SYSTEM, Turn("=user", ("context", "question")), Turn("=assistant", ("answer",))), may=("context", "system")),
)
OTHER_ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "chatbot": "assistant", "model": "assistant", "ai": "assistant"}
CACHED = 4096  # fingerprints that a task remembers; others are resolved again


def field_paths(value: Any, prefix: str = "") -> set[str]:
    """The nested paths at which ``value`` has something: names joined by dots, ``[]`` for the items of a list."""
    found, todo = set(), [(value, prefix)]
    while todo:
        value, prefix = todo.pop()
        if isinstance(value, dict) and value:
            todo.extend((item, f"{prefix}.{name}" if prefix else name) for name, item in value.items())
        elif isinstance(value, list) and value:
            todo.extend((item, f"{prefix}[]") for item in value)
        else:
            found.add(prefix)
    return found


def fingerprint(paths: Iterable[str]) -> str:
    """The hash of a set of paths: equal for records of one schema, whatever the order of their fields and their values."""
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:32]


def layout_of(paths: set[str], layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    """The layout with the most paths among those whose needs are met and that leave no path unexplained."""
    told = {p for p in paths if not any(p == a or p.startswith((f"{a}.", f"{a}[")) for a in ASIDE)}
    fit = [x for x in layouts if told.issuperset(x.needs) and told <= {*x.needs, *x.may}]
    return max(fit, key=lambda x: len(x.needs), default=None)


def _at(value: Any, path: str) -> Iterator[Any]:
    """The values of ``value`` at ``path``, in order."""
    if not path:
        yield value
        return
    step, _, rest = path.partition(".")
    name, lists = step.removesuffix("[]"), step.endswith("[]")
    if isinstance(value, dict) and name in value:
        inside = value[name]
        for item in inside if lists and isinstance(inside, list) else [inside]:
            yield from _at(item, rest)


def _said(value: Any) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False, sort_keys=True)


def turns_of(record: Any, layout: Layout) -> Iterator[tuple[str, str]]:
    """The canonical turns (role, text) of a record; a turn of a named role whose paths are all absent is none."""
    groups: list[tuple[str, list[Turn]]] = []
    for turn in layout.turns:
        if not groups or turn.each != groups[-1][0] or not turn.each:
            groups.append((turn.each, []))
        groups[-1][1].append(turn)
    for each, turns in groups:
        for item in _at(record, each):
            for turn in turns:
                found = [[_said(v) for v in _at(item, path)] for path in turn.text]
                if turn.role.startswith("="):
                    if not any(found):
                        continue
                    role = turn.role[1:]
                else:
                    role = "".join(_said(v) for v in _at(item, turn.role))
                    role = OTHER_ROLES.get(role.strip().lower(), role) if layout.roles else role
                parts = ["".join(values) for values in found]
                yield role, parts[0] if len(parts) == 1 else "\n\n".join(p for p in parts if p)


def canonical_turns(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Rows (conv_id, place, nth, role, text, layout, fingerprint) of JSON records (conv_id long, place long, record string).

    The turns of a record are numbered (nth) from 0.  A record that no layout accounts for,
    null and malformed ones too, gives one row with nulls for layout, role and text, so that every
    record is in the result.  Null roles and texts are ''; missing lists have no turns; repeated
    records give repeated rows; very long texts stay whole; other columns are ignored.
    """

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {"conv_id": pa.int64(), "place": pa.int64(), "nth": pa.int64(), "role": pa.string(), "text": pa.string(), "layout": pa.string(), "fingerprint": pa.string()}
        known: dict[str, Layout | None] = {}
        for batch in batches:
            rows, chars = [], 0
            for conv_id, place, record in zip(*map(batch.column, ("conv_id", "place", "record")), strict=True):
                conv_id, place = conv_id.as_py(), place.as_py()
                try:
                    parsed = json.loads(record.as_py() or "")
                    paths = field_paths(parsed)
                except (ValueError, RecursionError):
                    paths, parsed = {"!"}, None
                key = fingerprint(paths)
                if key not in known:
                    if len(known) >= CACHED:
                        known.clear()
                    known[key] = layout_of(paths, layouts)
                layout = known[key]
                if layout is None:
                    rows.append((conv_id, place, 0, None, None, None, key))
                    continue
                for nth, (role, text) in enumerate(turns_of(parsed, layout)):
                    rows.append((conv_id, place, nth, role, text, layout.name, key))
                    chars += len(text)
                if chars > 4_000_000:
                    yield _batch(rows, names)
                    rows, chars = [], 0
            if rows:
                yield _batch(rows, names)

    source = records.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("place").cast("long").alias("place"), F.col("record").cast("string").alias("record"))
    return source.mapInArrow(convert, "conv_id long, place long, nth long, role string, text string, layout string, fingerprint string")


def _batch(rows: list[tuple], names: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), names.values(), strict=True)], list(names))


def records_of(df: DataFrame, conv_id: str = "conv_id", place: str = "turn") -> DataFrame:
    """Each row of ``df`` as a JSON record of all its fields, nulls included: what ``canonical_turns`` reads."""
    return df.select(F.col(conv_id).alias("conv_id"), F.col(place).alias("place"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("record"))


# --- template ---

HEAD, COLON, END = "### ", ": ", "</turn>"
SHOWN = {"system": "System", "user": "User", "assistant": "Assistant"}
CONTROL = ("\\", "###", END)  # escaped in texts by a backslash before them
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(rf"\\({_CONTROL.pattern})")
_ROLE = re.compile(rf"{_CONTROL.pattern}|:")
_ESCAPED_ROLE = re.compile(rf"\\({_ROLE.pattern})")
_SEGMENT = re.compile(rf"{HEAD}((?:[^\\:]++|\\(?:{_ROLE.pattern}))*+){COLON}((?:[^\\<]++|\\(?:{_CONTROL.pattern})|<(?!/turn>))*+){END}\n", re.S)
LEARNED = "assistant"


def escaped(text: str) -> str:
    return _CONTROL.sub(r"\\\g<0>", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def segment_of(role: str, text: str) -> tuple[str, int, int]:
    """A turn as the template writes it, and where its escaped text starts and how long that is.  Roles without a shown name stand after ``=``."""
    head = HEAD + (SHOWN.get(role) or "=" + _ROLE.sub(r"\\\g<0>", role)) + COLON
    inside = escaped(text)
    return f"{head}{inside}{END}\n", len(head), len(inside)


def read_segment(segment: str) -> tuple[str, str]:
    """Role and text of a turn that the template wrote."""
    found = _SEGMENT.fullmatch(segment)
    if found is None:
        raise ValueError(f"no turn of this template: {segment[:80]!r}")
    role = found[1]
    role = _ESCAPED_ROLE.sub(r"\1", role[1:]) if role.startswith("=") else {v: k for k, v in SHOWN.items()}[role]
    return role, unescaped(found[2])


def format_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, nth, segment, start, loss_start, loss_length): the template's text of each turn, in order.

    A conversation's text is its segments (nth from 0) one after another; start is where a
    segment begins in it and the loss mask covers loss_length characters from loss_start
    on, those of an assistant's escaped text (null for other turns), all in code points.
    ``turns`` has conv_id, place, nth, role, text, as ``canonical_turns`` gives it; rows without a
    layout are left out, if it has that column.  Turns are in the order of place and nth; ties go by role, then
    text; repeated rows stay.  Null roles and texts are ''; rows of a null conv_id are one conversation.
    Conversations are streamed in sorted order, so that one of any length needs the memory of a turn.
    """
    if "layout" in turns.columns:
        turns = turns.where(F.col("layout").isNotNull())
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    order = ["conv_id", "place", "nth", "role", "text"]
    sorted_turns = turns.select("conv_id", "place", "nth", *text).repartition("conv_id").sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {"conv_id": pa.int64(), "nth": pa.int64(), "segment": pa.string(), "start": pa.int64(), "loss_start": pa.int64(), "loss_length": pa.int64()}
        now, nth, start = (), 0, 0
        for batch in batches:
            rows = []
            for conv_id, role, said in zip(*map(batch.column, ("conv_id", "role", "text")), strict=True):
                conv_id, role = conv_id.as_py(), role.as_py()
                if now != (conv_id,):
                    now, nth, start = (conv_id,), 0, 0
                segment, head, length = segment_of(role, said.as_py())
                rows.append((conv_id, nth, segment, start, *((start + head, length) if role == LEARNED else (None, None))))
                nth, start = nth + 1, start + len(segment)
            if rows:
                yield _batch(rows, names)

    return sorted_turns.mapInArrow(write, "conv_id long, nth long, segment string, start long, loss_start long, loss_length long")


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation of ``format_turns``, all told by its segments and loss mask alone.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars and loss_sha256 (the
    unescaped text under the mask), formatted_chars.  Reads the rows in the order and dealing that
    ``format_turns`` left them in, or after ``sorted_again``; a gap raises ValueError.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
        now, n, chars, loss_chars, turns, loss = (), 0, 0, 0, None, None
        for batch in batches:
            rows = []
            for conv_id, nth, segment, start, loss_start, loss_length in zip(*map(batch.column, ("conv_id", "nth", "segment", "start", "loss_start", "loss_length")), strict=True):
                conv_id, segment, start = conv_id.as_py(), segment.as_py(), start.as_py()
                if now != (conv_id,):
                    if now:
                        rows.append((*now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    now, n, chars, loss_chars, turns, loss = (conv_id,), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                if (nth.as_py(), start) != (n, chars):
                    raise ValueError(f"conversation {conv_id}: segment {n} at {chars} is missing")
                role, text = read_segment(segment)
                turns.update(f"{role}\n{text}\n".encode())
                if loss_start.is_valid:
                    inside = unescaped(segment[loss_start.as_py() - start :][: loss_length.as_py()])
                    loss.update(inside.encode())
                    loss_chars += len(inside)
                n, chars = n + 1, chars + len(segment)
            if rows:
                yield _batch(rows, names)
        if now:
            yield _batch([(*now, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)], names)

    return formatted.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def sorted_again(formatted: DataFrame) -> DataFrame:
    """Segments that were written and read again, dealt and ordered for ``read_back``."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "nth")


def samples(formatted: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, text, loss (array of start and length), n_turns. Here a conversation's text is held whole, as a training sample is."""
    part = unused("_part", formatted)
    rows = F.sort_array(F.collect_list(F.struct("nth", "segment", "loss_start", "loss_length")))
    whole = formatted.groupBy("conv_id").agg(rows.alias(part))
    loss = F.transform(F.filter(part, lambda x: x["loss_start"].isNotNull()), lambda x: F.struct(x["loss_start"].alias("start"), x["loss_length"].alias("length")))
    return whole.select("conv_id", F.array_join(F.col(f"{part}.segment"), "").alias("text"), loss.alias("loss"), F.size(part).cast("long").alias("n_turns"))
