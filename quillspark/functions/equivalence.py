"""Unit-aware answer equivalence: texts are read once, and compared by column expressions.

A reading is what one scan over a text's tokens finds: the text with numbers in digits,
its words, a clock time, a range, a sum of money, and all quantities with their dimension.
The scan is an Arrow UDF; whether two readings agree, and how, is for Catalyst to say.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from quillspark.functions import matching as M
from quillspark.functions import text as T
from quillspark.functions.batches import few

# Units, by the dimension they measure and their size in its base unit.
UNITS = (
    ("length", 0.001, ("mm", "millimeter", "millimeters", "millimetre", "millimetres")),
    ("length", 0.01, ("cm", "centimeter", "centimeters", "centimetre", "centimetres")),
    ("length", 1.0, ("m", "meter", "meters", "metre", "metres")),
    ("length", 1000.0, ("km", "kilometer", "kilometers", "kilometre", "kilometres")),
    ("length", 0.0254, ("in", "inch", "inches")),
    ("length", 0.3048, ("ft", "foot", "feet")),
    ("length", 1609.344, ("mi", "mile", "miles")),
    ("mass", 0.001, ("g", "gram", "grams")),
    ("mass", 1.0, ("kg", "kilogram", "kilograms")),
    ("mass", 0.45359237, ("lb", "lbs", "pound", "pounds")),
    ("power", 1.0, ("w", "watt", "watts")),
    ("power", 1000.0, ("kw", "kilowatt", "kilowatts")),
    ("duration", 1.0, ("second", "seconds", "sec", "secs")),
    ("duration", 60.0, ("minute", "minutes", "min", "mins")),
    ("duration", 3600.0, ("hour", "hours", "hr", "hrs")),
    ("duration", 86400.0, ("day", "days")),
    ("duration", 604800.0, ("week", "weeks")),
    ("duration", 2629800.0, ("month", "months")),
    ("duration", 31557600.0, ("year", "years")),
    ("duration", 3155760000.0, ("century", "centuries")),
    ("percentage", 0.01, ("%", "percent", "percentage")),
    ("currency:usd", 1.0, ("$", "usd", "dollar", "dollars")),
    ("currency:eur", 1.0, ("€", "eur", "euro", "euros")),
    ("currency:gbp", 1.0, ("£", "gbp")),
)
#: Temperatures, as (degrees of the scale at the base's zero, size of a degree).
SCALES_OF_HEAT = {"celsius": (0.0, 1.0), "fahrenheit": (32.0, 5 / 9), "kelvin": (273.15, 1.0)}
#: Numbers in words, besides those up to twenty.
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
POWERS = {"k": 1e3, "thousand": 1e3, "million": 1e6, "billion": 1e9}
#: Answers that all mean that nothing is to be paid.
FREE = ("0", "free", "no cost", "zero cost", "without charge")
#: Words of a question that ask for a number, and for a time of day.
ASKS_NUMBER = (
    "when", "year", "date", "how many", "how much", "number", "percent", "percentage", "length", "distance", "height", "wide", "width", "long", "weight",
    "mass", "power", "temperature", "duration", "century", "centuries", "age", "old", "cost", "price",
)
ASKS_TIME = ("when", "what time", "close", "closes", "closed", "open", "opens", "opened")

TOLERANCE, EXACT = 0.01, 1e-9

_UNIT = {name: (dimension, size) for dimension, size, names in UNITS for name in names}
_COUNT = {**{w: int(n) for w, n in T.NUMBER_WORDS.items()}, **{w: 10 * k for k, w in enumerate(TENS, 2)}}
_SPELLED = {*_COUNT, "hundred", "thousand", "million"}
_MONEY = {name: dimension for name, (dimension, _) in _UNIT.items() if dimension.startswith("currency:")} | dict.fromkeys(("pound", "pounds"), "currency:gbp")
_TOKEN = re.compile(r"(?P<number>\d+(?:\.\d+)?)|(?P<word>[^\W\d_]+)|(?P<sign>[^\w\s])")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")


# --- reading one text -----------------------------------------------------------------------------


def spelled_out(words: list[str]) -> int:
    """The number that a run of number words says: what stands before the largest power counts so often, what follows adds to it."""
    for word, power in (("million", 1_000_000), ("thousand", 1000), ("hundred", 100)):
        if word in words:
            at = len(words) - 1 - words[::-1].index(word)
            return max(1, spelled_out(words[:at])) * power + spelled_out(words[at + 1 :])
    return sum(_COUNT[w] for w in words)


def in_digits(tokens: list[str]) -> list[str]:
    """``tokens`` with each run of number words, "and" within or after it included, as one number; powers after digits stay words."""
    out: list[str] = []
    run: list[str] = []
    for token in [*tokens, ""]:
        scales = token in POWERS and not run and bool(out) and out[-1][0].isdigit()
        if token in _SPELLED and not scales or run and token == "and":
            run.append(token)
            continue
        if run:
            out.append(str(spelled_out([w for w in run if w != "and"])))
            run = []
        if token:
            out.append(token)
    return out


def _is_number(tokens: list[str], at: int) -> bool:
    return at < len(tokens) and tokens[at][0].isdigit()


def measures(tokens: list[str]) -> Iterator[dict]:
    """The quantities of a text: each number with its power of ten and unit."""
    for at, token in enumerate(tokens):
        if not token[0].isdigit():
            continue
        value, after = float(token), at + 1
        if after < len(tokens) and tokens[after] in POWERS:
            value, after = value * POWERS[tokens[after]], after + 1
        unit = tokens[after] if after < len(tokens) else ""
        if unit == "°" and after + 1 < len(tokens):
            unit = {"c": "celsius", "f": "fahrenheit"}.get(tokens[after + 1], "")
        if unit in SCALES_OF_HEAT:
            zero, size = SCALES_OF_HEAT[unit]
            dimension, base = "temperature", (value - zero) * size
        else:
            dimension, size = _UNIT.get(unit, (None, 1.0))
            base = value * size
        before = tokens[at - 1] if at else ""
        yield {"value": value, "dimension": dimension, "base": base, "money": _MONEY.get(before) or _MONEY.get(unit)}


def clock_minutes(tokens: list[str]) -> int | None:
    """Minutes of the day, if the first number of one or two digits is an hour."""
    at = next((k for k, t in enumerate(tokens) if t.isdigit() and len(t) < 3), None)
    if at is None:
        return None
    rest, minute = tokens[at + 1 :], 0
    if rest[:1] == [":"] and len(rest) > 1 and rest[1].isdigit() and len(rest[1]) == 2:
        minute, rest = int(rest[1]), rest[2:]
    half = "".join(t for t in rest[:3] if t != ".")[:2]
    hour, halves = int(tokens[at]), {"am": 0, "pm": 12}
    if half in halves and rest[0] in ("am", "pm", "a", "p"):
        return None if not 1 <= hour <= 12 or minute > 59 else (hour % 12 + halves[half]) * 60 + minute
    return None if hour > 23 or minute > 59 else hour * 60 + minute


def bare_words(folded: str) -> list[str]:
    """The words of a folded text: digit commas closed up, other punctuation apart, articles left out, small number words as digits."""
    joined = re.sub(r"(?<=\d),(?=\d)", "", folded)
    apart = "".join(c if c in "€£°" or unicodedata.category(c)[0] not in "PS" else " " for c in joined)
    return [T.NUMBER_WORDS.get(w, w) for w in apart.split() if w not in T.ARTICLES]


def one_of(word: str) -> str:
    """A plural's singular, by its ending alone."""
    return re.sub(r"^(..+)ies$", r"\1y", word) if word.endswith("ies") else re.sub(r"^(..+[^sui])s$", r"\1", word)


def name_core(words: list[str]) -> list[str]:
    """A name without its title and without the plain words from "of" on that end it."""
    title = 2 if " ".join(words[:2]) in T.TITLES else int(bool(words) and words[0] in T.TITLES)
    name = words[title:] or words
    plain = len(name)
    while plain and re.fullmatch("[a-z-]+", name[plain - 1]):
        plain -= 1
    origin = next((k for k in range(max(1, plain), len(name) - 1) if name[k] == "of"), len(name))
    return name[:origin]


def _folded(text: str | None) -> tuple[str, list[str]]:
    """A text in compatibility form, blanks collapsed, and its tokens without digit commas."""
    folded = " ".join(unicodedata.normalize("NFKC", text or "").casefold().split())
    return folded, [m[0] for m in _TOKEN.finditer(folded.replace(",", ""))]


def quantities_in(tokens: list[str]) -> list[dict]:
    """The quantities of tokens (numbers in digits), each with a signature that tells equal ones."""
    return [{**m, "signature": f"{m['dimension'] or 'number'}:{m['base'] if m['dimension'] else m['value']:.9g}"} for m in measures(tokens)]


def reading(text: str | None) -> dict:
    folded, plain = _folded(text)
    tokens, normal = in_digits(plain), bare_words(folded)
    to = next((k for k in range(1, len(tokens)) if tokens[k] in ("-", "–", "—", "to") and _is_number(tokens, k - 1) and _is_number(tokens, k + 1)), None)
    sums = [m for m in measures(plain) if m["money"]]
    words = [T.NUMBER_WORDS.get(w, w) for w in _WORD.findall(folded) if w not in T.ARTICLES]
    return {
        "text": text, "normal": " ".join(normal), "tokens": normal, "single": list(map(one_of, normal)),
        "counted": [one_of(w) for w in bare_words(" ".join(in_digits([m[0] for m in _TOKEN.finditer(folded)])))], "core": " ".join(name_core(normal)),
        "words": words, "clock": clock_minutes(plain), "low": float(tokens[to - 1]) if to else None, "high": float(tokens[to + 1]) if to else None,
        "currency": sums[0]["money"] if sums else None, "amount": sums[0]["value"] if sums else None,
        "quantities": quantities_in(tokens),
    }


_QUANTITY = StructType().add("value", DoubleType()).add("dimension", StringType()).add("base", DoubleType()).add("money", StringType()).add("signature", StringType())
_TEXTS = ArrayType(StringType())
_READING = StructType()
for _name, _type in (
    ("text", StringType()), ("normal", StringType()), ("tokens", _TEXTS), ("single", _TEXTS), ("counted", _TEXTS), ("core", StringType()), ("words", _TEXTS), ("clock", IntegerType()),
    ("low", DoubleType()), ("high", DoubleType()), ("currency", StringType()), ("amount", DoubleType()), ("quantities", ArrayType(_QUANTITY)),
):
    _READING = _READING.add(_name, _type)


@F.pandas_udf(ArrayType(_READING))
def readings(texts: pd.Series) -> pd.Series:
    """What each text of an array says; null texts say nothing, and stand in no reading."""
    return texts.map(lambda row: [reading(t) for t in (row if row is not None else []) if t is not None])


def read(text: Column) -> Column:
    """The reading of one text, a null one as of an empty one."""
    return readings(F.array(F.coalesce(text, F.lit(""))))[0]


def with_quantities(df: DataFrame, text: str, into: str = "quantities") -> DataFrame:
    """``df`` with the quantities of whole texts instead of the texts: nothing else of a reading is made, and a few rows at a time."""
    kept = [c for c in df.columns if c != text]
    schema = StructType([df.schema[c] for c in kept]).add(into, ArrayType(_QUANTITY))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few(batches):
            made = [quantities_in(in_digits(_folded(t)[1])) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(made, to_arrow_type(ArrayType(_QUANTITY)))], names=[*kept, into])

    return df.mapInArrow(found, schema)


# --- comparing readings ----------------------------------------------------------------------------


def asks(question: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.lower(question).rlike(rf"\b({'|'.join(words)})\b"), F.lit(False))


def error(a: Column, b: Column) -> Column:
    """How far two numbers lie apart, as a share of the larger; 0 for what rounding alone parts."""
    gap, larger = F.abs(a - b), F.greatest(F.abs(a), F.abs(b))
    return F.when(gap <= F.greatest(F.lit(1e-9), larger * 1e-12), 0.0).otherwise(gap / F.greatest(larger, F.lit(1e-12)))


def _verdict(numeric: Column, unit: Column, off: Column) -> Column:
    return F.struct(numeric.alias("numeric"), unit.alias("unit"), off.cast("double").alias("error"))


def by_quantities(a: Column, b: Column, question: Column) -> Column:
    """struct<numeric, unit, error> of two arrays of quantities: some pair equal as numbers, or in one dimension, where the question or a unit calls for it."""
    fit = asks(question, ASKS_NUMBER) | F.exists(F.concat(a, b), lambda q: q["dimension"].isNotNull())

    def off(x: Column, y: Column) -> Column:  # of bare numbers as they stand, of one dimension in its base unit
        bare = x["dimension"].isNull() | y["dimension"].isNull()
        gap = F.when(bare, error(x["value"], y["value"])).when(x["dimension"] == y["dimension"], error(x["base"], y["base"]))
        return F.struct(F.when(gap <= F.when(bare, EXACT).otherwise(TOLERANCE), gap).alias("gap"), bare.alias("bare"))

    near = F.filter(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: off(x, y)))), lambda p: p["gap"].isNotNull())
    held = F.aggregate(
        F.when(fit, near).otherwise(F.slice(near, 1, 0)), _verdict(F.lit(False), F.lit(False), F.lit(None)),
        lambda v, p: _verdict(v["numeric"] | p["bare"], v["unit"] | ~p["bare"], F.least(v["error"], p["gap"])),
    )
    return held


def agreement(a: Column, b: Column, question: Column) -> Column:
    """struct<numeric, unit, error> of two readings: times of day, ranges and sums of money decide where both have them, else quantities do."""
    at_once = a["clock"] == b["clock"]
    spans = (error(a["low"], b["low"]) <= EXACT) & (error(a["high"], b["high"]) <= EXACT)
    paid = error(a["amount"], b["amount"])
    same = (a["currency"] == b["currency"]) & (paid <= TOLERANCE)
    return (
        F.when(asks(question, ASKS_TIME) & a["clock"].isNotNull() & b["clock"].isNotNull(), _verdict(at_once, F.lit(False), F.when(at_once, 0.0)))
        .when(a["low"].isNotNull() & b["low"].isNotNull(), _verdict(spans, F.lit(False), F.when(spans, 0.0)))
        .when(a["currency"].isNotNull() & b["currency"].isNotNull(), _verdict(F.lit(False), same, F.when(same, paid)))
        .otherwise(by_quantities(a["quantities"], b["quantities"], question))
    )


def with_readings(df: DataFrame, said: Column, aliases: Column) -> DataFrame:
    """``df`` with ``_said``, the reading of an answer or text, and ``_aliases``, those of the answers accepted."""
    return df.withColumns({"_said": read(said), "_aliases": F.coalesce(readings(aliases), F.array().cast(ArrayType(_READING)))})


def same_name(a: Column, b: Column) -> Column:
    """Whether two readings differ as texts, yet are equal in the singular, or as names of two words or more without title and origin."""
    named = (a["core"] == b["core"]) & F.contains(a["core"], F.lit(" "))
    return (a["normal"] != "") & (b["normal"] != "") & (a["normal"] != b["normal"]) & ((a["single"] == b["single"]) | named)


def evaluated(mine: Column, theirs: Column, question: Column) -> Column:
    """How the reading of an answer agrees with those of its accepted aliases: struct<exact, numeric, unit, alias, semantic, strict, f1, unit_error>."""
    found = F.transform(
        theirs,
        lambda r: F.struct(
            agreement(mine, r, question).alias("measure"), (r["normal"] == mine["normal"]).alias("exact"), same_name(mine, r).alias("alias"), r["normal"].isin(*FREE).alias("free"),
            F.greatest(M.token_f1(mine["tokens"], r["tokens"]), M.token_f1(mine["counted"], r["counted"])).alias("f1"),
        ),
    )
    exact = (mine["normal"] != "") & F.exists(found, lambda v: v["exact"])
    numeric, unit = F.exists(found, lambda v: v["measure"]["numeric"]), F.exists(found, lambda v: v["measure"]["unit"])
    alias, semantic = F.exists(found, lambda v: v["alias"]), mine["normal"].isin(*FREE) & F.exists(found, lambda v: v["free"])
    return F.struct(
        exact.alias("exact"), numeric.alias("numeric"), unit.alias("unit"), alias.alias("alias"), semantic.alias("semantic"),
        F.coalesce(F.array_max(F.transform(found, lambda v: v["f1"])), F.lit(0.0)).alias("f1"), F.array_min(F.transform(found, lambda v: v["measure"]["error"])).alias("unit_error"),
    )


def judged(df: DataFrame, question: Column, into: str = "evaluation") -> DataFrame:
    """``df`` of ``with_readings`` with the evaluation: strict is any agreement but that of meaning, and either makes the F1 one."""
    df = df.withColumn(into, evaluated(F.col("_said"), F.col("_aliases"), question))
    e = F.col(into)
    strict = e["exact"] | e["numeric"] | e["unit"] | e["alias"]
    return df.withColumn(into, e.withField("strict", strict).withField("f1", F.when(strict | e["semantic"], 1.0).otherwise(e["f1"])))


def answer_score(verdict: Column, exact: float = 0.75, overlap: float = 0.25) -> Column:
    """A weighted sum of the strict agreement and the token F1 of an evaluation, between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), exact * verdict["strict"].cast("int") + overlap * verdict["f1"]))


def supported(told: Column, theirs: Column, question: Column) -> Column:
    """How the reading of a text supports answers: struct<match_type, alias, score> of the first alias that it states, else of the best remembered one."""
    line, single = F.array_join(told["words"], " "), F.array_join(T.singular_words(told["words"]), " ")
    essential = lambda words: T.without(words, T.CONTEXT_STOP_WORDS)

    def stated(r: Column) -> Column:
        normal, tokens, core = r["normal"], r["tokens"], r["core"]
        # A name with a title or an origin is stated by any window that has the same core, and so by the core itself.
        named = (core != normal) & F.contains(core, F.lit(" ")) & M.has_phrase(line, core)
        value = by_quantities(r["quantities"], told["quantities"], question)
        main = essential(tokens)
        recall = F.when((F.size(tokens) > 1) & (F.size(main) > 1), M.overlap_count(main, essential(told["words"])) / F.size(main)).otherwise(0.0)
        kind = (
            F.when(M.has_phrase(line, normal), "normalized_exact")
            .when(M.has_phrase(single, F.array_join(r["single"], " ")) | named, "alias_equivalent")
            .when(value["unit"], "unit_equivalent").when(value["numeric"], "numeric_equivalent")
        )
        return F.struct(kind.alias("kind"), r["text"].alias("alias"), recall.alias("recall"))

    each = F.transform(F.filter(theirs, lambda r: r["normal"] != ""), stated)
    first = F.get(F.filter(each, lambda s: s["kind"].isNotNull()), F.lit(0))
    most = F.array_max(F.transform(each, lambda s: s["recall"]))
    best = F.get(F.filter(each, lambda s: (s["recall"] == most) & (most > 0)), F.lit(0))
    result = lambda kind, alias, score: F.struct(kind.alias("match_type"), alias.alias("alias"), score.alias("score"))
    return (
        F.when(first.isNotNull(), result(first["kind"], first["alias"], F.lit(1.0)))
        .when(best.isNotNull(), result(F.lit("core_token_recall"), best["alias"], best["recall"]))
        .otherwise(result(F.lit("none"), F.lit(None).cast("string"), F.lit(0.0)))
    )




def signatures(told: Column) -> Column:
    """The distinct quantities of a reading as "dimension:number" of nine digits, sorted."""
    return F.array_sort(F.array_distinct(F.transform(told["quantities"], lambda q: q["signature"])))
