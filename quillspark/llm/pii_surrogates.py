"""PII surrogates: detected entities get keyed, type-consistent replacements.

A surrogate comes from a keyed permutation of all strings of the entity's own form: each
value moves to the next in a secret order.  So equal values get equal surrogates in every
document (coreference), unequal ones unequal surrogates (distinctness), no value is its
own, and nothing has to be looked up.  A distributed check verifies both on the corpus.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import checkpointed as settled
from quillspark.llm.common import skew_join, small, written

# Given names by gender and script, surnames by script; a surrogate name comes from the same list.
GIVEN = {
    ("f", "latin"): "Alice Anna Barbara Carla Charlotte Clara Diana Elena Emma Eva Fatima Hannah Helen Ingrid Irene Isabella Jane Julia Karen Laura Linda Lucia Maria Marta Mary Nina Olivia Paula Rosa Sara Sofia Susan Teresa Ursula Valentina Vera".split(),
    ("m", "latin"): "Adam Albert Alexander Antonio Bernard Carlos Charles Daniel David Diego Edward Felix Frank George Hans Henry Hugo Ivan James Jan John Jorge Juan Karl Lucas Luis Marco Martin Michael Miguel Oscar Otto Pablo Paul Peter Robert Thomas Victor William".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Наталья Ольга Светлана Татьяна".split(),
    ("m", "cyrillic"): "Александр Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
    ("f", "greek"): "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    ("m", "greek"): "Γιώργος Δημήτρης Ιωάννης Κώστας Νίκος Πέτρος".split(),
}
SURNAMES = {
    "latin": "Adams Allen Anderson Baker Becker Bennett Brown Campbell Carter Clark Cooper Davis Diaz Edwards Evans Fischer Garcia Gomez Gonzalez Green Hall Harris Hernandez Hill Hoffmann Hughes Jackson Johnson Jones King Klein Koch Lee Lewis Lopez Martinez Meyer Miller Mitchell Moore Morgan Morris Muller Murphy Nelson Parker Perez Phillips Ramirez Reed Richter Roberts Robinson Rodriguez Rogers Sanchez Schmidt Schneider Schulz Scott Smith Stewart Taylor Thompson Torres Turner Wagner Walker Weber White Williams Wilson Wolf Wood Wright Young Zimmermann".split(),
    "greek": "Αθανασίου Βασιλείου Γεωργίου Δημητρίου Κωνσταντίνου Νικολάου Παπαδόπουλος Παπαδοπούλου Χρήστου".split(),
}
#: Endings of surnames that tell gender or origin; a surname keeps its own.
ENDINGS = tuple("ская ский цкая цкий ова ева ёва ина ына ов ев ёв ин ын енко ук юк ян skaya skaia ska sky skiy ski ova eva ina ov ev in son sen mann berg stein ez opoulos opoulou".split())
TITLES = ("Mr", "Herr", "Señor", "Monsieur", "Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Dr", "Prof", "Sir", "Lady", "Lord")
#: Alphabets that a letter stays in.
ALPHABETS = ("aeiouy", "bcdfghjklmnpqrstvwxz", "àáâäèéêëìíîïòóôöùúûü", "çñß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "0123456789")
SIGNS = "._%+-"  # what the local part of an address may have besides letters and digits
_PLACE = {c: (a, a.index(c)) for a in ALPHABETS for c in a}
_HEX = {c: (a, a.index(c)) for a in ("0123456789", "abcdef") for c in a}
_UPPER = {c: "ẞ" if c == "ß" else c.upper() for c in _PLACE}
_LOWER = {u: c for c, u in _UPPER.items()}  # only what the other leads back to, so that no two letters become one
_LISTS = {**GIVEN, **{("surname", script): names for script, names in SURNAMES.items()}}
#: Lower-case given names and surnames; no word is both.
_NAMED = {name.lower(): (key, k) for key, names in GIVEN.items() for k, name in enumerate(names)}
_SURNAMED = {name.lower(): (("surname", script), k) for script, names in SURNAMES.items() for k, name in enumerate(names)}
_TITLED = {t.lower() for t in TITLES}
_CALLED = [w for name in sorted({n for names in GIVEN.values() for n in names}, key=lambda n: (-len(n), n)) for w in dict.fromkeys((name, name.upper()))]
_ADDRESSED = [w for t in TITLES for w in dict.fromkeys((t, t.upper()))]

#: Words within a name that stay as they are, but for its last word: as a surname one goes to another of them.
PARTICLES = "al bin da dal de del della den der di do dos du el la las le los ten ter van von zu zum zur".split()
_PARTICLED = {word: ("particle", k) for k, word in enumerate(PARTICLES)}
_PART = r"(?:[^\W\d_]{1,2}['’](?=[^\W\d_]{2}))?[^\W\d_]{2,}"
_NAME = rf"(?:[^\W\d_]\. )*(?:(?:{'|'.join([*PARTICLES, *map(str.upper, PARTICLES)])}) )*{_PART}(?:-{_PART})*"
PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("ip", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"),
    ("ipv6", r"(?<![\w:.])(?=(?:[0-9A-Fa-f]*:){3})(?=[A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:])"),
    ("card", r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"),
    ("title", rf"\b(?:{'|'.join(_ADDRESSED)})\.? {_NAME}(?: {_NAME})?"),
    ("name", rf"\b(?:{'|'.join(_CALLED)}) {_NAME}"),
)
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
_HINT = re.compile(rf"[0-9@]|\b(?:{'|'.join([*_ADDRESSED, *_CALLED])})\b")


# --- keyed permutations -----------------------------------------------------------------------------


def _feistel(x: int, bits: int, key: bytes, back: bool) -> int:
    """A keyed permutation of the numbers of ``bits`` bits (an even number), or its inverse."""
    half = bits // 2
    mask = (1 << half) - 1
    a, b = x >> half, x & mask
    for k in range(7, -1, -1) if back else range(8):
        if back:
            a, b = b ^ _round(key, k, a, half), a
        else:
            a, b = b, a ^ _round(key, k, b, half)
    return a << half | b


def _round(key: bytes, k: int, x: int, half: int) -> int:
    size = -(-half // 8)
    seed = hmac.digest(key, bytes([k]) + x.to_bytes(size, "big"), "sha256")
    while len(seed) < size:
        seed += hashlib.sha256(seed).digest()
    return int.from_bytes(seed[:size], "big") & ((1 << half) - 1)


def permuted(x: int, n: int, key: bytes) -> int:
    """The next after ``x`` in a secret cyclic order of 0 .. n - 1: a permutation that moves every number (n > 1)."""
    bits = max(2, (n - 1).bit_length() + (n - 1).bit_length() % 2)
    walk = lambda y, back: _walk(y, n, bits, key, back)
    return walk((walk(x, True) + 1) % n, False)


def _walk(x: int, n: int, bits: int, key: bytes, back: bool) -> int:
    x = _feistel(x, bits, key, back)
    while x >= n:  # walks the cycle until it is back among 0 .. n - 1: a permutation still
        x = _feistel(x, bits, key, back)
    return x


@cache
def _others() -> dict[str, tuple[str, int]]:
    """(alphabet, place) of all letters that ALPHABETS lacks: those of a category among 64 neighbours, single ones together."""
    groups: dict[tuple, list[str]] = {}
    for c in map(chr, range(0x80, 0x110000)):
        if (kind := unicodedata.category(c))[0] == "L" and c not in _PLACE and c not in _LOWER:
            groups.setdefault((kind, ord(c) >> 6), []).append(c)
    alphabets: dict[tuple, str] = {}
    for (kind, run), letters in groups.items():
        to = (kind, run) if len(letters) > 1 else (kind,)
        alphabets[to] = alphabets.get(to, "") + "".join(letters)
    return {c: (a, k) for a in alphabets.values() for k, c in enumerate(a)}


def alike(value: str, key: bytes, places: dict[str, tuple[str, int]] = _PLACE) -> str:
    """Another string of the same form: digits stay digits, letters stay in their alphabet and case, all else stays."""
    low = "".join(_LOWER.get(c, c) for c in value)
    spots = [(i, *(places.get(c) or _others()[c])) for i, c in enumerate(low) if c in places or c > "\x7f" and c in _others()]
    n, x = 1, 0
    for _, alphabet, at in spots:
        n, x = n * len(alphabet), x * len(alphabet) + at
    if n < 2:
        return value
    # The form is the key's domain: values of different forms never meet.
    form = list(low)
    for i, alphabet, _ in spots:
        form[i] = alphabet[0]
    form = "".join(form)
    y, out = permuted(x, n, hmac.digest(key, form.encode(), "sha256")), list(value)
    for i, alphabet, _ in reversed(spots):
        y, k = divmod(y, len(alphabet))
        out[i] = _UPPER[alphabet[k]] if value[i] != low[i] else alphabet[k]
    return "".join(out)


def _luhn(digits: str) -> int:
    """The check digit for the digits before it."""
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 == 0 else int(d) for k, d in enumerate(reversed(digits)))
    return -total % 10


def _refilled(form: str, digits: str) -> str:
    given = iter(digits)
    return "".join(next(given) if c.isdigit() else c for c in form)


def surrogate(kind: str, value: str, key: bytes) -> str:
    """The replacement of an entity as it is written."""
    key = hmac.digest(key, (b"name" if kind == "title" else kind.encode()), "sha256")  # with a title or without, a person is the same
    if kind == "email":
        local, _, domain = value.partition("@")
        name, _, top = domain.rpartition(".")
        within = hmac.digest(key, name.lower().encode(), "sha256")
        return f"{alike(local, within) if re.search('[A-Za-z0-9]', local) else _signs(local, within)}@{alike(name, hmac.digest(key, b'domain', 'sha256'))}.{top}"
    if kind == "ip":
        parts = [int(p) for p in value.split(".")]
        fixed = 2 if parts[:2] == [192, 168] else 1 if parts[0] in (10, 127) else 0  # private addresses stay private
        n = 256 ** (4 - fixed)
        x = permuted(int.from_bytes(bytes(parts), "big") % n, n, hmac.digest(key, bytes(parts[:fixed]), "sha256"))
        return ".".join(map(str, [*parts[:fixed], *x.to_bytes(4 - fixed, "big")]))
    if kind == "ipv6":
        network, _, host = value.partition(":")  # the network's first group stays
        if not re.search("[0-9A-Fa-f]", host):
            return alike(value, key, _HEX)
        return f"{network}:{alike(host, hmac.digest(key, network.lower().encode(), 'sha256'), _HEX)}"
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        body = alike(digits[:-1], key)
        valid = _luhn(digits[:-1]) == int(digits[-1])
        # A valid number stays valid; another keeps its distance from validity.
        last = _luhn(body) if valid else (_luhn(body) + int(digits[-1]) - _luhn(digits[:-1])) % 10
        return _refilled(value, f"{body}{last}")
    if kind == "phone" and value.startswith("+"):
        country = re.match(r"\+\d{1,3}(?=[ .(-])", value)
        at = country.end() if country else 2
        return value[:at] + _refilled(value[at:], alike(re.sub(r"\D", "", value[at:]), key))
    if kind == "iban":
        plain = value.replace(" ", "")
        account = alike(plain[4:], hmac.digest(key, plain[:2].encode(), "sha256"))
        new = iter(plain[:2] + _check_digits(plain, account) + account)
        return "".join(c if c == " " else next(new) for c in value)
    if kind in ("title", "name"):
        words = value.split(" ")
        first = 1 if words[0].rstrip(".").lower() in _TITLED and len(words) > 1 else 0
        return " ".join([*words[:first], *(_name(w, key, k == len(words) - 1) for k, w in enumerate(words) if k >= first)])
    if kind in ("phone", "ssn"):
        return _refilled(value, alike(re.sub(r"\D", "", value), key))
    return alike(value, key)


def _check_digits(plain: str, account: str) -> str:
    """The check digits of another account of the same country: right ones for right ones, and for the n-th wrong ones the n-th wrong ones."""
    right = [f"{98 - int(''.join(str(int(c, 36)) for c in number + plain[:2] + '00')) % 97:02d}" for number in (plain[4:], account)]
    if plain[2:4] == right[0]:
        return right[1]
    wrong = [[f"{k:02d}" for k in range(100) if f"{k:02d}" != r] for r in right]
    return wrong[1][wrong[0].index(plain[2:4])]


def _listed(word: str, known: dict[str, tuple], key: bytes) -> str:
    kind, at = known[word.lower()]
    names = PARTICLES if kind == "particle" else _LISTS[kind]
    new = names[permuted(at, len(names), hmac.digest(key, "".join(kind).encode(), "sha256"))]
    return new.upper() if word.isupper() else new.capitalize() if word[0].isupper() else new


def _kept_apart(word: str, last: bool = False) -> str:
    """"particle" and "listed" for words that have no surrogate of letters, and so are none; else ""."""
    low = word.lower()
    if low in _PARTICLED and (word in (low, low.upper()) or last and word == low.capitalize()):
        return "particle"
    return "listed" if (low in _NAMED or low in _SURNAMED) and (word.isupper() or word == word.capitalize()) else ""


def _ending(word: str) -> str:
    low = word.lower()
    return next((e for e in ENDINGS if low.endswith(e) and len(low) - len(e) > 1), "")


def _name(word: str, key: bytes, last: bool = False) -> str:
    """The surrogate of a word of a name: upper or lower case, one word gets one surrogate.

    Listed names go to names of their own list, if they are written as there or all in
    capitals, and a particle that is the last word to another particle; other words to
    letters of the same kind before the same ending.
    """
    if kind := _kept_apart(word, last):
        if kind == "particle":
            return _listed(word, _PARTICLED, key) if last else word
        return _listed(word, _NAMED if word.lower() in _NAMED else _SURNAMED, key)
    ending = _ending(word)
    at = len(word) - len(ending)
    within = hmac.digest(key, b"stem" + ending.encode(), "sha256")
    new = alike(word[:at], within)
    while _kept_apart(new + word[at:], last) or _ending(new + word[at:]) != ending:  # on in the same cycle, so that no two words meet
        new = alike(new, within)
    return new + word[at:]


def _signs(local: str, key: bytes) -> str:
    """Another local part of as many signs, for one that has neither letters nor digits."""
    x = 0
    for c in local:
        x = x * len(SIGNS) + SIGNS.index(c)
    y, out = permuted(x, len(SIGNS) ** len(local), key), ""
    for _ in local:
        y, k = divmod(y, len(SIGNS))
        out = SIGNS[k] + out
    return out


def entities(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the entities of a text, in order and apart."""
    found = _FIND.search(text) if _HINT.search(text) else None
    while found:
        kind, value, at = found.lastgroup, found[0], found.end()
        if kind in ("title", "name"):
            words = value.split(" ")
            # A name ends before the first word that is neither capitalised nor a particle, and with no small particle.
            n = next((k for k, w in enumerate(words) if not w[0].isupper() and w not in _PARTICLED), len(words))
            while n and not words[n - 1][0].isupper():
                n -= 1
            if n < len(words):
                value, at = " ".join(words[:n]), found.start() + max(1, len(" ".join(words[:n])))
            if n < 2:
                kind = None
        if kind:
            yield found.start(), found.start() + len(value), kind, value
        found = _FIND.search(text, at)


def replacer(key: bytes) -> Callable[[str], tuple[str, list[tuple[str, str, str, int]]]]:
    known: dict[tuple[str, str], str] = {}

    def replace(text: str) -> tuple[str, list[tuple[str, str, str, int]]]:
        out, at, found, moved = [], 0, [], 0
        for start, end, kind, value in entities(text):
            if (new := known.get((kind, value))) is None:
                if len(known) > 100_000:
                    known.clear()
                new = known[kind, value] = surrogate(kind, value, key)
            out += [text[at:start], new]
            at = end
            found.append((kind, value, new, start + moved))
            moved += len(new) - len(value)
        return "".join([*out, text[at:]]), found

    return replace


# --- the operator ---------------------------------------------------------------------------------------


ENTITIES = "array<struct<kind:string,value:string,surrogate:string,start:long>>"
_ENTITIES = pa.list_(pa.struct([("kind", pa.string()), ("value", pa.string()), ("surrogate", pa.string()), ("start", pa.int64())]))


def with_surrogates(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text (entities replaced), entities (array of kind, value, surrogate and its start in the new text, in order) of each row of ``docs``.

    Null texts stay null without entities; other columns are ignored; an empty table gives no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replace = replacer(key.encode())
        for batch in small(batches):
            texts, lists = [], []
            for text in batch.column("text").to_pylist():
                new, found = replace(text) if text else (text, [])
                texts.append(new)
                lists.append([{"kind": k, "value": v, "surrogate": s, "start": at} for k, v, s, at in found])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(lists, _ENTITIES)], ["doc_id", "text", "entities"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(rows, f"doc_id long, text string, entities {ENTITIES}")


def collisions(replaced: DataFrame) -> DataFrame:
    """kind, surrogate of what stands for several values, and of values that have several or their own: none, if all is well."""
    found = replaced.select(F.explode("entities").alias("e")).select("e.*")
    pairs = found.groupBy("kind", "value").agg(F.min("surrogate").alias("surrogate"), F.max("surrogate").alias("other"))
    met = pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.max((F.col("surrogate") != F.col("other")) | (F.col("surrogate") == F.col("value"))).alias("bad"))
    return met.where("n > 1 or bad").select("kind", "surrogate")


def mended(replaced: DataFrame, met: DataFrame, key: str) -> DataFrame:
    """``replaced`` (written) with a token of its own for each value whose surrogate is one of ``met`` (kind, surrogate); all else stays.

    A token is 96 bits of a keyed hash behind the entity's kind.  Only rows that hold such a
    value are rewritten, each with what a join tells of its own entities.
    """
    row, told = "_row", "_tokens"
    found = replaced.select(F.monotonically_increasing_id().alias(row), "*")
    each = found.select(row, F.posexplode("entities").alias("at", "e")).select(row, "at", F.col("e.kind").alias("kind"), F.col("e.value").alias("value"), F.col("e.surrogate").alias("surrogate"))
    bad = skew_join(each, met.select("kind", "surrogate"), ["kind", "surrogate"], "left_semi")
    token = F.concat(F.col("kind"), F.lit("-"), F.substring(F.sha2(F.concat_ws("\0", F.lit(key), "kind", "value"), 256), 1, 24))
    tokens = settled(bad.groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(F.col("at"), token))).alias(told)))
    joined = skew_join(found, tokens, [row], "left")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            texts, lists = [], []
            for text, entities, new in zip(*(batch.column(c).to_pylist() for c in ("text", "entities", told)), strict=True):
                out, at, moved, new = [], 0, 0, dict(new or ())
                for k, entity in enumerate(entities if new else ()):
                    start, end = entity["start"], entity["start"] + len(entity["surrogate"])
                    out += [text[at:start], new.get(k, entity["surrogate"])]
                    entity["surrogate"], entity["start"], at = out[-1], start + moved, end
                    moved += len(out[-1]) - (end - start)
                texts.append("".join([*out, text[at:]]) if new else text)
                lists.append(entities)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(lists, _ENTITIES)], ["doc_id", "text", "entities"])

    return joined.select("doc_id", "text", "entities", told).mapInArrow(rewrite, replaced.schema)


def surrogates(docs: DataFrame, key: str) -> DataFrame:
    """``with_surrogates``, checked: values that have their own or another's surrogate get tokens instead (``mended``), and no other value changes.

    ``key`` is a secret of the caller's: who knows it can lead surrogates back to values.
    Texts are searched once and written to the shared folder; the check and the caller read
    what was written.  Very long texts are read whole; repeated rows get equal surrogates.
    """
    replaced = written(with_surrogates(docs, key))
    met = settled(collisions(replaced))
    return replaced if met.isEmpty() else written(mended(replaced, met, key))
