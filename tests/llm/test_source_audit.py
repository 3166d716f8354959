"""The divergence of sources against plain counting, with every bound made small, and the tries against dictionaries."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import source_audit
from quillspark.llm.source_audit import Merge, pieces, shared_bytes, terms_of, trie_in, trie_of

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(docs, least=3, top=200):
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        terms = TERM.findall(text.translate(SMALL))
        counts[lang, source].update(terms)
        in_docs[lang].update(set(terms))
        groups.add((lang, source))
    rows = []
    for lang, source in groups:
        kept = [t for t, n in in_docs[lang].items() if n >= least]
        sums = {g: sum(counts[g][t] for t in kept) for g in groups if g[0] == lang}

        def share(n, total, size=len(kept)):
            return 1 + 1_000_000_000 * (n + 1) // (total + size)

        def ranked(part, found, lang=lang, source=source):
            rows.extend((lang, source, part, item, value, rank) for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1))

        own = {t: share(counts[lang, source][t], sums[lang, source]) for t in kept}
        pairs = []
        for g in sums:
            if g[1] != source:
                q = {t: share(counts[g][t], sums[g]) for t in kept}
                pairs.append((sum((own[t] - q[t]) ** 2 // q[t] for t in kept), g[1]))
        ranked("pair", pairs)
        whole = {t: share(sum(counts[g][t] for g in sums), sum(sums.values())) for t in kept}
        terms = [((own[t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[lang, source][t] and own[t] > whole[t]]
        ranked("term", sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:top])
    return sorted(rows)


def corpus(n, sources, seed=4):
    random.seed(seed)
    words = ["a", "Ab", "abc", "abd", "straße", "ß", "naïve", "漢字", "漢", "\U0001f600", "zebra", "É", "é", "x" * 50] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)]
    docs = [(None, None, None), ("", "en", "empty"), ("123 ?! \x7f\x00", "en", None), ("only here " * 9, "none", "s1"), ("only other " * 9, "none", "s2"), ("word " * 60_000, "en", "s0")]
    for _ in range(n):
        source = 0 if random.random() < 0.4 else random.randrange(sources)
        docs.append((random.choice(" -,\n0").join(random.choices(words, k=random.randrange(40))), random.choice(["en", "de", "fr"]), f"s{source}"))
    return docs + docs[10:13] * 2


def rows_of(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


def frame(spark, docs):
    return spark.createDataFrame(docs, "text string, lang string, source string").withColumns({"n_terms": F.lit(1), "item": F.lit("clash"), "doc_id": F.lit(None).cast("long")}).repartition(5)


def test_divergence_against_counting(spark):
    docs = corpus(400, 6)
    assert rows_of(source_audit.divergence(frame(spark, docs))) == expected(docs)
    assert rows_of(source_audit.divergence(frame(spark, docs), 1, 5)) == expected(docs, 1, 5)


def test_divergence_with_small_bounds(spark, monkeypatch):
    docs = corpus(300, 40, 9)
    for name, value in (("HELD", 50), ("HEAD", 1), ("MOST_LEAVES", 8), ("GROUPS", 25), ("CELLS", 100)):
        monkeypatch.setattr(source_audit, name, value)
    assert rows_of(source_audit.divergence(frame(spark, docs), 2, 7)) == expected(docs, 2, 7)


def test_divergence_of_empty_tables(spark):
    none = frame(spark, [("a", "en", "s")]).limit(0)
    assert source_audit.divergence(none).count() == 0
    assert rows_of(source_audit.divergence(frame(spark, [("a", "en", "s"), (None, "en", None)]))) == [("en", "", "pair", "s", 0, 1), ("en", "s", "pair", "", 0, 1)]


def told_by(trie):
    return {t: (int(trie.docs[k]), {trie.names[trie.sources[e]]: int(trie.counts[e]) for e in range(trie.first[k], trie.first[k + 1])}) for k, t in enumerate(trie.terms)}


@pytest.mark.parametrize("letters", [b"ab", bytes(range(1, 256))])
def test_tries_add_up_like_dictionaries(letters, monkeypatch):
    monkeypatch.setattr(source_audit, "FOLD", 5)
    random.seed(1)
    merge, every = Merge(), {}
    for size in (1, 2000, 0, 700, 300, 300, 40, 1):
        docs, counts = Counter(), defaultdict(Counter)
        for _ in range(size):
            term, source = bytes(random.choices(letters, k=random.choice([1, 2, 3, 5, 80]))), random.choice("xyz")
            docs[term] += random.choice([1, 1, 300, 70_000])
            counts[source][term] += random.choice([1, 2, 70_000, 5_000_000_000])
        if not docs:
            continue
        told = {t: (n, {s: c[t] for s, c in counts.items() if c[t]}) for t, n in docs.items()}
        assert told_by(trie_of(docs, counts)) == told and trie_of(docs, counts).terms == sorted(told)
        for depth in (1, 3, 90):
            trie = trie_of(docs, counts)
            cut = list(pieces(trie, depth))
            assert [head for head, *_ in cut] == sorted({t[:depth] for t in told}) and sum(n for _, n, *_ in cut) == len(told)
            again = [trie_in(sources, subtrie) for _, _, sources, subtrie in cut]
            assert {k: v for t in again for k, v in told_by(t).items()} == told
        for part in again:
            merge.add(part)
        for t, (n, c) in told.items():
            old = every.get(t, (0, {}))
            every[t] = (old[0] + n, {s: old[1].get(s, 0) + c.get(s, 0) for s in {*old[1], *c}})
    for least in (1, 3):
        assert told_by(merge.trie(least)) == {t: x for t, x in every.items() if x[0] >= least}
        assert merge.trie(least).terms == sorted(t for t, x in every.items() if x[0] >= least)


def test_shared_bytes():
    terms = sorted([b"a", b"ab", b"abc", b"b" * 40, b"b" * 41, b"b" * 50 + b"c", "é".encode(), "è".encode()])
    found = shared_bytes(terms).tolist()
    assert found[:3] == [0, 1, 2] and found[-1] == 1 and all(a[:n] == b[:n] for a, b, n in zip(terms[:-1], terms[1:], found[1:], strict=True))


def test_terms_of_long_texts():
    text = ("Añ-b " * 1000 + "x" * 500 + "_é").encode()
    whole = [t for part in terms_of(text) for t in part]
    assert [t for part in terms_of(text, 7) for t in part] == whole == [m.encode() for m in TERM.findall(text.decode().translate(SMALL))]


@pytest.mark.parametrize("counts", [[0, 5, 10**9], [9_000_000_001, 10**13, 3]])
def test_shares_are_exact(counts):
    total, size = sum(counts), 7
    found = source_audit._shares(np.array(counts, np.int64), np.int64(total), size)
    assert found.tolist() == [1 + 1_000_000_000 * (n + 1) // (total + size) for n in counts]
