"""The operators of training-data pipelines against brute force, on whole small tables and on hard little cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillspark.llm import anisotropic_search, exact_dedup, fair_mixing, html_layout, licence_scan, merkle_fixity, noisy_channel_toxicity, pii_surrogates, queries, simhash_dedup, slack_packing
from quillspark.llm.common import connected_components
from tests.oracle import SF_DIR, connection, of_frame, of_sql

DOCS = "doc_id long, text string, lang string, source string, n_chars long, group_size int"
#: Nulls, empty and blank texts, repeated rows, ties, a long text, and a column whose name clashes with a result's.
HARD = [
    (1, None, None, None, None, 1), (2, "", "en", "a", 0, 1), (3, " \n\t ", "en", None, 4, None), (4, "One two three four five six", "en", "b", 27, 2), (5, "One  two three four five\nsix", "en", "b", 28, 2),
    (5, "One  two three four five\nsix", "en", "b", 28, 2), (6, "Öne twó three", "de", "c", 13, 1), (7, "word " * 30_000, "en", "a", 150_000, 1), (None, "no id here at all", "en", "a", 17, 1),
]


@pytest.fixture(scope="module")
def hard(spark):
    return spark.createDataFrame(HARD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return [(r["doc_id"], r["text"], r["source"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_agrees_with_sql(spark, name):
    assert of_frame(queries.QUERIES[name](spark, SF_DIR)) == of_sql(connection(), queries.ORACLE_SQL[name])


def test_components(spark):
    random.seed(3)
    pairs = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(0, k) for k in range(400, 460)] + [(k, k + 1) for k in range(500, 560)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    found = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {x: root(x) for pair in pairs if pair[0] != pair[1] for x in pair}


# --- 1: search ---


def test_search_recall(spark):
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    ids, x = np.array([r[0] for r in rows]), np.stack([r[1] for r in rows])
    found = {}
    for r in queries.QUERIES["op1_anisotropic_search"](spark, SF_DIR).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in ids.tolist() if i % 20 == 0}
    hits = 0
    for q, got in found.items():
        exact = (x * x[ids == q]).sum(axis=1)
        best = sorted((-s, i) for s, i in zip(exact, ids.tolist(), strict=True) if i != q)[:20]
        hits += len({i for _, i in best} & {i for _, i, _ in got})
        assert [k for k, _, _ in sorted(got)] == list(range(1, 21))
        assert all(abs(s - exact[ids == i][0]) < 1e-12 for _, i, s in got)
    assert hits / (20 * len(found)) >= 0.95


def test_search_hard_rows(spark):
    bad = [(20, None), (40, []), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [float("nan"), 1.0]), (120, [float("inf"), 1.0])]
    good = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 5.0])]
    df = spark.createDataFrame(bad + good, "vec_id long, embedding array<float>")
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in anisotropic_search.search(df).collect())
    assert found == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 3, -1.0)]
    assert anisotropic_search.search(df.limit(0)).count() == 0


# --- 2: HTML ---


def test_html_layout():
    page = "<head><title>t</title></head><p>Hello <b>wor<i>ld</b>!<p>Second<br>line<ul><li>One<li>Two<ol><li>a<li>b</ol></ul><table><tr><th>Name<th>Qty<tr><td>Apple pie<td>3</table><p hidden>no<p style='display: none'>no<p>&lt;end&gt;<script>x='</p>'</script>"
    assert html_layout.visible_text(page) == "Hello world!\n\nSecond\nline\n\n- One\n- Two\n  1. a\n  2. b\n\nName       Qty\nApple pie  3\n\n<end>"
    assert html_layout.visible_text(None) == "" == html_layout.visible_text("")
    assert html_layout.visible_text("<div>" * 5000 + "deep") == "deep"
    assert html_layout.visible_text("a < b <unclosed") .startswith("a < b")


def test_html_tables_and_visibility():
    seen = html_layout.visible_text
    assert seen("<table><tr><td rowspan=2>A<td>B<tr><td>C<tr><td colspan=2>wide one<td>z</table>") == "A  B\n   C\nwide one  z"
    assert seen("<table><tr>loose<td>a</td><script>x</script><div hidden>y</div><td>b</table>") == "loose\n\na  b"
    assert seen("<table><tr><td>one<td>two<tr><td>a longer cell<td>x</table>") == "one            two\na longer cell  x"
    assert seen("<style>.x, #k{display:none} p.z {visibility:hidden} em{ visibility: hidden }</style><p class='a x'>no<p id=k>no<p class=z>kept: two selectors<p>yes <em>not <b style='visibility:visible'>but</b></em> end") == "kept: two selectors\n\nyes but end"
    assert seen("<div style='visibility:hidden'>a<span style='visibility:visible'>b</span><ul><li>c<li style='visibility: visible'>d</ul></div>") == "b\n\n- d"
    assert seen("<svg><title>t</title><text>lab<tspan>el</tspan></text></svg> <math><mi>x</mi><mo>=</mo><mn>2</mn></math> <select><option>1<option selected>7</select><textarea>a\n  b</textarea>") == "label x=2 7\na\n  b"
    assert seen("<select multiple><option>1<option>2</select>") == "1 2" and seen("<dialog>no</dialog><dialog open>yes</dialog>") == "yes"
    assert seen("<table><td colspan=0 rowspan=0>a<td rowspan=99999999>b<tr><td>c") .split() == ["a", "b", "c"]


def test_html_all_words_stay(spark):
    """Every word outside hidden elements comes out, in order."""
    for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").limit(50).collect():
        bare = re.sub(r"(?is)<(script|style|title|head)\b.*?</\1>|<!--.*?-->", "", r["html"])
        plain = re.sub(r"<[^>]*>", " ", re.sub(r"</?(?:b|i|a|em|strong)\b[^>]*>", "", bare))
        import html as h

        found = [w for w in html_layout.visible_text(r["html"]).split() if w not in ("-",)]
        assert [w for w in h.unescape(plain).split() if w != "-"] == found


# --- 3: PII ---


def test_permutation_is_one_and_moves_all():
    for n in (2, 3, 10, 37, 100):
        moved = [pii_surrogates.permuted(x, n, b"k") for x in range(n)]
        assert sorted(moved) == list(range(n)) and all(x != y for x, y in enumerate(moved))


def test_surrogates_keep_type_and_reference(spark):
    text = "Anna Petrova (anna.p@example.org, +1 (212) 555-7713, 4111 1111 1111 1111, 192.168.1.5) wrote; Anna Petrova. Иван Петров, Mr. John Smith."
    df = spark.createDataFrame([(1, text), (2, "Anna Petrova"), (3, None), (4, "nothing here")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii_surrogates.surrogates(df, "k").collect()}
    new = {e["value"]: e["surrogate"] for e in got[1]["entities"]}
    assert got[2]["text"] == new["Anna Petrova"] and got[1]["text"].count(new["Anna Petrova"]) == 2
    assert new["Anna Petrova"].split()[0] in pii_surrogates.GIVEN["f", "latin"] and new["Иван Петров"].split()[0] in pii_surrogates.GIVEN["m", "cyrillic"]
    card = new["4111 1111 1111 1111"].replace(" ", "")
    assert pii_surrogates._luhn(card[:-1]) == int(card[-1]) and new["192.168.1.5"].startswith("192.168.")
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", new["+1 (212) 555-7713"]) and re.fullmatch(r"\w{4}\.\w@\w+\.org|\w{4}\.\w@example\.org", new["anna.p@example.org"])
    assert got[3]["text"] is None and got[4]["text"] == "nothing here"
    assert pii_surrogates.collisions(pii_surrogates.surrogates(spark.read.parquet(f"{SF_DIR}/documents.parquet"), "k")).isEmpty()


def test_surrogates_of_odd_values_do_not_stop_the_rest(spark):
    text = "_@foo.com ...@foo.com, Mr. Łł, Mr. İnan; Mary Smith-Jones, John O'Brien, John F. Kennedy, Maria de la Cruz, John Smith's book"
    got = pii_surrogates.surrogates(spark.createDataFrame([(1, text), (2, "Anna Petrova")], "doc_id long, text string"), "k").collect()
    new = {e["value"]: e["surrogate"] for r in got for e in r["entities"]}
    assert set(new) == {"_@foo.com", "...@foo.com", "Mr. Łł", "Mr. İnan", "Mary Smith-Jones", "John O'Brien", "John F. Kennedy", "Maria de la Cruz", "John Smith", "Anna Petrova"}
    assert len(set(new.values())) == len(new) and all(v != s for v, s in new.items())
    assert "foo.com" not in got[0]["text"] + got[1]["text"] and "Jones" not in got[0]["text"] + got[1]["text"]


def test_surrogates_follow_case_and_kind():
    new = lambda kind, value: pii_surrogates.surrogate(kind, value, b"k")
    turned = lambda v: v.replace(" ", "")[4:] + v[:4]
    mod97 = lambda v: int("".join(str(int(c, 36)) for c in turned(v))) % 97
    for iban in ("DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "FR1420041010050500013M02606"):
        assert mod97(iban) == 1 == mod97(new("iban", iban)) and new("iban", iban)[:2] == iban[:2] and new("iban", iban) != iban
    assert new("iban", "DE89370400440532013000") == new("iban", "DE89 3704 0044 0532 0130 00").replace(" ", "")
    numbers = [f"DE{k:02d}370400440532013000" for k in range(100)]
    assert len({new("iban", n) for n in numbers}) == 100 and [mod97(n) == 1 for n in numbers] == [mod97(new("iban", n)) == 1 for n in numbers]
    for name in ("John Smith", "Anna Petrova", "Mary Smith-Jones", "Иван Петров"):
        assert new("name", name.upper()) == new("name", name).upper()
    assert new("name", "John Smith").split()[1] in pii_surrogates.SURNAMES["latin"] and new("name", "Anna Petrova").endswith("ova") and new("name", "Анна Иванова").endswith("ова")
    assert [k for _, _, k, _ in pii_surrogates.entities("so JOHN SMITH and MR. SMITH said")] == ["name", "title"]


def test_surrogate_words_never_meet():
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a.upper() + b + c for a in letters for b in letters for c in letters] + [w for names in pii_surrogates._LISTS.values() for w in names if len(w) != 3]
    new = [pii_surrogates._name(w, b"k") for w in words]
    assert len(set(new)) == len(words) and all(a != b for a, b in zip(words, new, strict=True))
    capitals = ["ÇA", "ÑA", "ẞA", "ÇE", "ÑE", "ẞE", "KA", "\u212aA"]
    assert len({pii_surrogates._name(w, b"k") for w in capitals}) == len(capitals)


# --- 4: SimHash ---


def fingerprint(text, words=3):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + words]), 42) for i in range(max(1, len(w) - words + 1))] if w else []
    return sum((sum(x >> b & 1 for x in h) * 2 > len(h)) << b for b in range(64))


def brute_components(items, near):
    up = list(range(len(items)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(items)):
        for j in range(i):
            if near(items[i], items[j]):
                up[root(i)] = root(j)
    return [root(i) for i in range(len(items))]


def test_simhash_components(spark, documents):
    docs = [(d, t) for d, t, _ in documents] + [(10_000, None), (10_001, ""), (10_002, "A b"), (10_003, "a  B")]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash_dedup.near_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    fps = [fingerprint(t) for _, t in docs]
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (d, _), r in zip(docs, roots, strict=True):
        least[r] = min(least.get(r, d), d)
    assert got == {d: (f"{f:016x}", least[r]) for (d, _), f, r in zip(docs, fps, roots, strict=True)}


@pytest.mark.parametrize("radius, words", [(3, 1), (7, 1), (42, 4)])
def test_bit_sliced_distances(radius, words):
    random = np.random.Generator(np.random.PCG64(radius))
    base = random.integers(0, 2**63, (40, words), dtype=np.uint64)
    rows = np.concatenate([base, *[base ^ (np.uint64(1) << random.integers(0, 64, base.shape, dtype=np.uint64)) for _ in range(12)]])
    got = {(int(i), int(j)) for tile, near in simhash_dedup.near_rows(rows, radius) for i, n in zip(tile, near, strict=True) for j in np.flatnonzero(n)}
    distance = np.bitwise_count(rows[:, None] ^ rows[None]).sum(axis=2)
    assert got == {(i, j) for i, j in zip(*np.nonzero(distance <= radius), strict=True) if i < j}


def test_full_buckets_are_divided(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "BLOCK", 16)
    random.seed(5)
    base = random.getrandbits(64)
    fps = {base ^ (random.getrandbits(10) << 20) for _ in range(150)} | {random.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    df = spark.createDataFrame([(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)], "id long, fp long")
    got = {r["id"]: r["component"] for r in connected_components(simhash_dedup.links_within(df)).collect()}
    roots = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, i), i)
    assert {i: got.get(i, i) for i in range(len(fps))} == {i: least[r] for i, r in enumerate(roots)}


@pytest.mark.parametrize("kind", ["chain", "clusters"])
def test_crowded_keys_lose_no_links(spark, monkeypatch, kind):
    monkeypatch.setattr(simhash_dedup, "BLOCK", 16)
    random.seed(7)
    if kind == "chain":  # each is near its two neighbours only, so no row may stand for another
        fps = [(1 << 3 * k) - 1 for k in range(80)]
    else:
        bases = [random.getrandbits(256) for _ in range(12)]
        fps = list({base ^ sum({1 << random.randrange(256) for _ in range(random.randrange(1, 4))}) for base in bases for _ in range(20)})
    random.shuffle(fps)
    keys = [[1, 2 + i % 3] for i in range(len(fps))]
    words = lambda f: np.array([f >> 64 * k & 2**64 - 1 for k in range(4)], np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(i, words(f), k) for i, (f, k) in enumerate(zip(fps, keys, strict=True))], "id long, fp array<long>, keys array<long>")
    got = {r["id"]: r["component"] for r in connected_components(simhash_dedup.signature_links(df, 3)).collect()}
    roots = brute_components(range(len(fps)), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    least = {}
    for i, r in enumerate(roots):
        least[r] = min(least.get(r, i), i)
    assert {i: got.get(i, i) for i in range(len(fps))} == {i: least[r] for i, r in enumerate(roots)}


def test_near_copies_go_and_others_stay(spark):
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(6))
    docs, base = [], [[word() for _ in range(300)] for _ in range(30)]
    for i, b in enumerate(base):
        docs.append((i, " ".join(b)))
        for k in range(3):
            c = list(b)
            for _ in range(4):
                c[random.randrange(300)] = word()
            docs.append((100 + 10 * i + k, " ".join(c)))
    docs += [(900, None), (901, "  "), (902, "too short")]
    kept = {r["doc_id"] for r in simhash_dedup.keep_one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == {*range(30), 900, 901, 902}


# --- 5: packing ---


def test_packing(spark, documents, hard, empty):
    from tokenizers import Tokenizer
    import public_tokenizers

    model = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    for docs in ([(d, t) for d, t, _ in documents], [(r[0], r[1]) for r in HARD]):
        rows = slack_packing.pack(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        expected = []
        for d, t in docs:
            ids = model.encode(t or "", add_special_tokens=False).ids + [0]
            first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
            starts = [0, *range(first, len(ids), 2048)]
            for k, (s, e) in enumerate(zip(starts, [*starts[1:], len(ids)], strict=True)):
                expected.append((d, k, s, e - s, zlib.crc32(np.array(ids[s:e], "<u4").tobytes())))
        key = lambda x: tuple((v is None, v or 0) for v in x)
        assert sorted([tuple(r)[:5] for r in rows], key=key) == sorted(expected, key=key)
        bins = {}
        for r in rows:
            bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for places in bins.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 2048
        total = sum(r["length"] for r in rows)
        assert len(bins) <= -(-total // 2048) * 1.02 + 1
    assert slack_packing.pack(empty).count() == 0
    assert slack_packing.pack(hard).count() == len(rows)


def test_ids_are_those_of_the_tokenizer_file(monkeypatch):
    from tokenizers import Tokenizer
    import public_tokenizers

    monkeypatch.setattr(slack_packing, "LONG", 40)
    model, encode = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), slack_packing.token_bytes()
    random.seed(1)
    parts = ["a", "Bc", " ", "\n", ".", ",", "'s", "é", "ß", "12", "😀", "\t", " ", "<|endoftext|>", "Ġ", "-", "日本", "́", "\x1c", "\x85", "\xa0", "Ж", "한", "—", "\u2028", " " * 1200]
    texts = ["".join(random.choice(parts) for _ in range(random.randint(0, 14))) for _ in range(5000)]
    texts += [f"a{chr(c)} {chr(c)}{chr(c)}1 {chr(c)}\n{chr(c)}b" for c in range(0x3200) if not slack_packing._UNUSUAL.search(chr(c))]
    texts += ["".join(random.choice("ab cde\nf. ") for _ in range(500)) for _ in range(50)]
    for text in texts:
        assert encode(text) == np.array(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)
    assert slack_packing.token_bytes("word_bpe_49k.json")("Some words") == np.array(Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json"))).encode("Some words", add_special_tokens=False).ids, "<u4").tobytes()


def test_fullest_is_the_best_of_all_subsets():
    random.seed(2)
    for _ in range(200):
        counts = {random.randint(1, 30): random.randint(1, 3) for _ in range(5)}
        items, room = [n for n, c in counts.items() for _ in range(c)], random.randint(1, 60)
        best = max(sum(n for k, n in enumerate(items) if mask >> k & 1) for mask in range(1 << len(items)) if sum(n for k, n in enumerate(items) if mask >> k & 1) <= room)
        chosen = slack_packing.fullest(sorted(counts, reverse=True), counts, room)
        assert sum(n * k for n, k in chosen) == best and all(k <= counts[n] for n, k in chosen)


# --- 6: toxicity ---


def test_lattice_restores_words():
    text = "stupid idiot people are not very good to others and the loser said so again " * 50
    counts = np.ones((noisy_channel_toxicity.CLASSES,) * 3)
    k = noisy_channel_toxicity._CLASS[np.frombuffer(text.encode("latin-1"), np.uint8)]
    np.add.at(counts, (k[:-2], k[1:-1], k[2:]), 100)
    model = np.log(counts / counts.sum(axis=2, keepdims=True)).astype(np.float32)
    assert [noisy_channel_toxicity.restore(w, model) for w in ("1d10t", "$tup1d", "l0ser", "i.d.i.o.t", "stuuuupid")] == ["idiot", "stupid", "loser", "idiot", "stupid"]
    assert "idiot" in noisy_channel_toxicity.words_of("you i d i o t there")


def test_toxicity_scores(spark):
    random.seed(4)
    word = lambda: "".join(random.choice(["ba", "ko", "mi", "tu", "se"]) for _ in range(3))
    docs = [(i, " ".join([word() for _ in range(40)] + (["vilebad"] if i % 5 == 1 else []))) for i in range(600)]
    df, labels = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 == 1)) for i in range(600)], "doc_id long, toxic int")
    extra = spark.createDataFrame([(1000, None), (1001, ""), (1002, "some v1lebad text"), (None, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in noisy_channel_toxicity.score_toxicity(df.unionByName(extra), labels).collect()}
    assert all(got[i]["predicted"] == int(i % 5 == 1) for i in range(600)) and len(got) == 604
    assert got[1000]["score"] == got[1001]["score"] < 0.5 < got[1002]["score"]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600))
    assert noisy_channel_toxicity.score_toxicity(df.limit(0), labels).count() == 0


# --- 7: exact dedup ---


def test_exact_dedup(spark, hard, empty):
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_duplicates(hard).collect()), key=repr)
    sha = lambda t: hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()
    groups = {}
    for d, t, *_ in HARD:
        groups.setdefault(sha(t), []).append((-len(t or ""), d is None, d or 0))
    expected = []
    for d, t, *_ in HARD:
        g = sorted(groups[sha(t)])
        keep = None if g[0][1] else g[0][2]
        expected.append((d, keep, len(g), keep == d, sha(t)))
    first = expected.index((5, 5, 3, True, sha(HARD[4][1])))
    expected[first] = (5, 5, 3, False, sha(HARD[4][1]))  # of two equal rows one stays
    assert got == sorted(expected, key=repr)
    assert exact_dedup.exact_duplicates(empty).count() == 0
    kept = exact_dedup.keep_one(hard)
    assert kept.columns == hard.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "5", "6", "7", "None"]


def test_unverified_chunks_fall_back_to_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "chunk_conflicts", lambda docs: docs.sparkSession.createDataFrame([(bytearray(xxhash.xxh3_128_digest(b"same")),)], "chunk binary"))
    df = spark.createDataFrame([(1, "same"), (2, "sa me"), (3, "other")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(df).collect()) == [(1, 2, 2), (2, 2, 2), (3, 3, 1)]


def test_chunks_follow_content():
    random.seed(9)
    body = bytes(random.randrange(97, 123) for _ in range(50_000))
    cut = lambda data: {data[a:b] for a, b in zip([0, *exact_dedup.chunk_ends(data)], exact_dedup.chunk_ends(data), strict=False)}
    assert b"".join(exact_dedup._chunks(body)) == body
    assert len(cut(b"prefix" + body) & cut(body)) >= len(cut(body)) - 3


# --- 8: fixity ---


RECORDS = "archive string, record_id string, offset long, length long, digest string"


def test_fixity_of_replicas(spark):
    rows = [(f"a{i % 3}", str(i), i * 40_000, 40_000, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(3000)]
    left = spark.createDataFrame(rows, RECORDS)
    changed = [r for r in rows if r[1] != "100"]
    changed = [(a, i, o, n, "x" if i == "2000" else d) for a, i, o, n, d in changed]
    changed = [(a, i, o + 7 * (i == "2999"), n, d) for a, i, o, n, d in changed] + [("a9", "new", 5, 1, "new")]
    got = sorted((r["archive"], r["record_id"], r["status"]) for r in merkle_fixity.audit(left, spark.createDataFrame(changed, RECORDS)).collect())
    assert got == sorted([("a1", "100", "missing"), ("a2", "2000", "corrupt"), ("a2", "2999", "moved"), ("a9", "new", "extra")])
    assert merkle_fixity.audit(left, left).count() == 0 == merkle_fixity.audit(left.limit(0), left.limit(0)).count()


def test_fixity_passes_nothing_it_cannot_compare(spark):
    rows = [(None, "1", 0, 5, "a"), ("x", None, 0, 5, "b"), ("x", "2", None, 5, "c"), ("x", "3", 9, 5, None), ("x", "4", 20, None, "d"), ("x", "4", 20, None, "d"), ("y", "5", 0, 5, "e")]
    other = [(a, i, o, n, d and d + "?") for a, i, o, n, d in rows]
    left, right = spark.createDataFrame(rows, RECORDS), spark.createDataFrame(other, RECORDS)
    schema = left.columns
    assert {tuple(r[c] for c in ("archive", "record_id")): r["status"] for r in merkle_fixity.fixity(left, right).collect()} == {(a, i): "corrupt" for a, i, *_ in rows}
    same = merkle_fixity.fixity(left.withColumn("status", F.lit("old")), left)
    assert same.columns == [*schema, "status"] and {r["record_id"]: r["status"] for r in same.collect()} == {**{i: "intact" for _, i, *_ in rows}, "3": "corrupt"} and same.count() == len(rows)


def test_archives_are_written_and_read(spark, tmp_path):
    bodies = {1: "plain", 2: "blank\r\n\r\nlines", 3: "", 4: "é" * 100, 5: "last"}
    pages = spark.createDataFrame([(i, f"http://x/{i}", b) for i, b in bodies.items()], "page_id long, url string, html string")
    record = merkle_fixity.warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    rows = pages.select(F.when(F.col("page_id") < 4, "a").otherwise("b").alias("archive"), F.col("page_id").alias("nth"), record.alias("record"), "page_id")
    texts = {r["page_id"]: r["record"].encode() for r in rows.collect()}
    for kind in ("none", "gzip"):
        merkle_fixity.write_archives(rows, f"{tmp_path}/{kind}", kind)
        got = sorted(tuple(r) for r in merkle_fixity.read_archives(spark, f"{tmp_path}/{kind}").collect())
        expected, at = [], {"a": 0, "b": 0}
        for i, text in texts.items():
            archive = "a" if i < 4 else "b"
            expected.append((archive, at[archive], len(text), str(i), hashlib.sha256(text).hexdigest()))
            at[archive] += len(text)
        assert got == sorted(expected)
    damaged = texts[1][:-1] + texts[2] + texts[3][:40] + texts[4]
    found = list(merkle_fixity.records_in(damaged))
    assert [f[0] for f in found] == [0, len(texts[1]) - 1, len(texts[1]) + len(texts[2]) - 1, len(damaged) - len(texts[4])] and found[1][3] == hashlib.sha256(texts[2]).hexdigest()


# --- 9: mixing ---


def test_mixing(spark, documents, hard, empty):
    got = queries.QUERIES["op9_fair_queueing"](spark, SF_DIR).collect()
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _ in documents}
    sources = sorted({s for _, _, s in documents})
    total = {s: sum(size[d] for d, _, x in documents if x == s) for s in sources}
    weight, target, bound = {s: k % 3 + 1 for k, s in enumerate(sources)}, {}, set()
    while True:
        free = [s for s in sources if s not in bound]
        rate = (sum(total.values()) - sum(3 * total[s] for s in bound)) / sum(weight[s] for s in free)
        target = {s: 3 * total[s] if s in bound else rate * weight[s] for s in sources}
        if not (over := {s for s in free if target[s] > 3 * total[s]}):
            break
        bound |= over
    name = {d: s for d, _, s in documents}
    taken = dict.fromkeys(sources, 0)
    for r in got:
        s = name[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == total[s] and abs(r["target"] - target[s]) < 1e-6
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        taken[s] += r["taken"]
    largest = max(size.values())
    assert sum(taken.values()) <= sum(total.values()) and all(abs(taken[s] - target[s]) <= 2 * largest for s in sources)
    again = queries.QUERIES["op9_fair_queueing"](spark, SF_DIR).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    mixed = fair_mixing.weighted_fair_mix(hard).collect()
    assert len(mixed) == len(HARD) and sum(r["taken"] for r in mixed) <= sum(r["size"] for r in mixed)
    applied = fair_mixing.apply_mix(hard)
    assert applied.columns == hard.columns and applied.count() == sum(r["copies"] for r in mixed)
    assert fair_mixing.weighted_fair_mix(empty).count() == 0


def test_targets_stop_at_three_sizes(spark):
    totals = spark.createDataFrame([("a", 1000), ("b", 10), (None, 10)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in fair_mixing.source_targets(totals).collect()}
    assert got == {"a": 960.0, "b": 30.0, None: 30.0}


# --- 10: licences ---


def test_licence_scan(spark):
    mit = "Copyright (c) 2020 Someone\n\n" + licence_scan.LICENCES["MIT"].replace("sublicense", "sub-license").upper()
    df = spark.createDataFrame([(1, mit), (2, "words\nLICENCED under the Apache Licence, version 2.0\nmore"), (3, None), (4, ""), (5, "plain")], "doc_id long, text string")
    got = {r["doc_id"]: (r["licence"], r["notices"]) for r in licence_scan.scan(df).collect()}
    assert got == {1: ("MIT", ""), 2: (None, "Apache-2.0"), 3: (None, ""), 4: (None, ""), 5: (None, "")}


def test_notices_in_every_spelling(spark):
    spellings = ["This work is dedicated to the public-domain.", "This work is dedicated to the public  domain", "THIS work is dedicated to the Public\tDomain"]
    df = spark.createDataFrame(list(enumerate(spellings)), "doc_id long, text string")
    assert [r["notices"] for r in licence_scan.scan(df).collect()] == ["CC0-1.0"] * 3
    assert all("licens" in c or "public domain" in c for c in map(licence_scan.canonical_text, licence_scan.NOTICES.values()))


# --- the pipeline ---


def test_pipeline(spark, hard):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = {r["doc_id"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.columns == docs.columns, name
        ids = [r["doc_id"] for r in out.collect()]
        assert set(ids) <= before and ids, name
        before, docs = set(ids), spark.createDataFrame(out.collect(), out.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR)
    assert {r["doc_id"] for r in packed.collect()} == before
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, hard, SF_DIR).collect()
        stage(spark, hard.limit(0), SF_DIR).collect()


def test_html_operator(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a<p>b"), (2, None, None)], "page_id long, url string, html string")
    assert sorted((r["page_id"], r["text"]) for r in html_layout.extract(pages).collect()) == [(1, "a\n\nb"), (2, "")]
    assert html_layout.extract(pages.where(F.lit(False))).count() == 0
