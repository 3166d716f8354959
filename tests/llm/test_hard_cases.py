"""Each operator and pipeline stage on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import anisotropic_search, exact_dedup, fair_mixing, html_layout, licence_scan, merkle_fixity, noisy_channel_toxicity, pii_surrogates, simhash_dedup, slack_packing
from tests.oracle import SF_DIR

#: Names that operators use inside, as columns of the input.
CLASHING = ("kept", "repeated", "stays", "status", "score", "size", "_size", "_copies", "_rows", "_nth", "_copy", "_skew_key", "_right_doc_id", "_r_doc_id", "digest", "rank", "component", "taken", "_stays", "_found", "row_id")
SENTENCE = " ".join(f"word{k}" for k in range(60))
ROWS = [
    (1, None, None), (2, "", "a"), (3, " \n\t ", None), (4, SENTENCE, "a"), (5, SENTENCE.replace(" ", "  "), "b"), (5, SENTENCE.replace(" ", "  "), "b"), (6, SENTENCE.upper(), "b"),
    (7, "long words " * 20_000, "c"), (8, "x" * 200_000, "c"), (None, "no id here at all", "a"), (None, "no id here at all", "a"), (9, "other text of its own", ""),
]


@pytest.fixture(scope="module")
def hard(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text"))
    for name in CLASHING:
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (4, 1), (7, None), (None, 1), (9, 0), (9, 1)], "doc_id long, toxic int")


def ids(df):
    return sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=lambda x: (x is None, x or 0))


def test_operators_on_hard_rows(spark, hard, labels):
    n, every = len(ROWS), sorted((r[0] for r in ROWS), key=lambda x: (x is None, x or 0))
    for result in (simhash_dedup.near_components(hard), noisy_channel_toxicity.score_toxicity(hard, labels), exact_dedup.exact_duplicates(hard), fair_mixing.weighted_fair_mix(hard), licence_scan.scan(hard), pii_surrogates.surrogates(hard, "k")):
        assert ids(result) == every
    packed = slack_packing.pack(hard).collect()
    assert len([r for r in packed if r["piece"] == 0]) == n and sum(r["length"] for r in packed if r["doc_id"] in (1, 2)) == 2
    pages = hard.select(F.col("doc_id").alias("page_id"), F.col("text").alias("html"), *CLASHING)
    text = html_layout.extract(pages)
    assert text.columns == ["page_id", *CLASHING, "text"] and text.count() == n
    assert {r["page_id"]: r["text"] for r in text.collect()}[8] == "x" * 200_000


def test_operators_on_empty_tables(spark, hard, labels):
    none, no_labels = hard.limit(0), labels.limit(0)
    for result in (
        simhash_dedup.near_components(none), simhash_dedup.near_duplicates(none), noisy_channel_toxicity.score_toxicity(none, labels), noisy_channel_toxicity.score_toxicity(none, no_labels),
        exact_dedup.exact_duplicates(none), fair_mixing.weighted_fair_mix(none), licence_scan.scan(none), pii_surrogates.surrogates(none, "k"), slack_packing.pack(none),
        html_layout.extract(none, "text", "seen"), anisotropic_search.search(spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ):
        assert result.count() == 0
    scores = noisy_channel_toxicity.score_toxicity(hard, no_labels).collect()
    assert len({r["score"] for r in scores}) == 1 and len(scores) == len(ROWS)


def test_stages_on_hard_rows(spark, hard, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    expected = {
        "exact_dedup": [3, 5, 7, 8, 9, None],  # of equal texts the longest stays, of repeated rows one
        "near_dedup": [1, 2, 3, 4, 7, 8, 9, None, None],  # 5 and 6 read as 4 does; texts without words stay
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, hard, str(tmp_path))
        assert out.columns == hard.columns, name
        kept = out.collect()
        assert all(r[c] == c for r in kept for c in CLASHING), name
        if name in expected:
            got = sorted((r["doc_id"] for r in kept), key=lambda x: (x is None, x or 0))
            if name == "exact_dedup":
                assert sorted(got, key=str) == sorted([*expected[name], 6], key=str)
            else:
                assert got == expected[name]
        if name == "mixing":
            mixed = fair_mixing.weighted_fair_mix(hard).collect()
            assert len(kept) == sum(r["copies"] for r in mixed)
            for row in {(r["doc_id"], r["source"]) for r in mixed}:
                assert sum(r["copies"] for r in mixed if (r["doc_id"], r["source"]) == row) == sum(1 for r in kept if (r["doc_id"], r["source"]) == row)
        assert stage(spark, hard.limit(0), str(tmp_path)).count() == 0


def test_search_agrees_whatever_the_cores(spark):
    """Blocks are of the rows alone, so their number does not follow the session's cores."""
    random = np.random.Generator(np.random.PCG64(3))
    x = random.normal(size=(16_000, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(16)
    found = {}
    asked = "vec_id % 400 = 0"
    for r in anisotropic_search.search(df, asked, 20).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    again = {(r["query_id"], r["rank"], r["vec_id"]) for r in anisotropic_search.search(df.coalesce(1), asked, 20).collect()}
    assert again == {(q, k, v) for q, got in found.items() for k, (v, _) in got.items()}
    hits = 0
    for q, got in found.items():
        exact = x.astype(float) @ x[q].astype(float)
        exact[q] = -np.inf
        hits += len(set(np.argsort(-exact)[:20].tolist()) & {v for v, _ in got.values()})
    assert hits / (20 * len(found)) >= 0.95


def test_search_ties_and_repeats(spark):
    rows = [(i, [1.0, 0.0]) for i in range(60)] + [(5, [9.0, 9.0]), (5, [1.0, 0.0])]
    got = [(r["rank"], r["vec_id"]) for r in anisotropic_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id = 0", 20).collect()]
    assert sorted(got) == [(k, k) for k in range(1, 21)]


def test_mixing_is_sort_and_truncate(spark):
    """The words taken are those of a sequential sort of all finish times, cut at the budget; many capped sources tie at one."""
    random.seed(8)
    rows = [(i, f"s{i}", "w " * 3) for i in range(300)] + [(1000 + i, random.choice("abc"), "w " * random.randint(0, 40)) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    queue = fair_mixing._queued(docs, 17)
    entries = sorted((((r["done"] + k * r["source_size"]) / r["target"], r["doc_id"], k), r["size"], r["doc_id"]) for r in queue.collect() if r["size"] for k in range(3))
    budget, used, taken = sum(len(t.split()) for _, _, t in rows), 0, {}
    for _, size, doc in entries:
        if used + size > budget:
            break
        used += size
        taken[doc] = taken.get(doc, 0) + size
    assert {r["doc_id"]: r["taken"] for r in fair_mixing.weighted_fair_mix(docs).where("taken > 0").collect()} == taken


def test_mixing_ranges_agree(spark, monkeypatch):
    random.seed(9)
    docs = spark.createDataFrame([(None if i % 3 == 0 else i, random.choice(["a", "b", None]), "w " * random.randint(1, 5)) for i in range(500)], "doc_id long, source string, text string")
    whole = sorted(map(repr, fair_mixing.weighted_fair_mix(docs).collect()))
    monkeypatch.setattr(fair_mixing, "RANGE_ROWS", 100)
    monkeypatch.setattr(fair_mixing, "RUN_ROWS", 8)
    assert sorted(map(repr, fair_mixing.weighted_fair_mix(docs.repartition(5)).collect())) == whole


def shingle_sets(rows):
    out = {}
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        if w:
            out[doc] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    return out


def test_near_duplicates_are_those_of_all_pairs(spark):
    """Groups by exact Jaccard similarity of 0.8 or more over all pairs, on a whole table with planted near copies of every degree."""
    random.seed(10)
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").collect()]
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(6))
    for k in range(60):
        base = [word() for _ in range(random.choice([12, 40, 150, 600]))]
        for j in range(4):
            edited = [w if random.random() > 0.004 * j else word() for w in base]
            rows.append((100_000 + 10 * k + j, " ".join(edited)))
    sets = shingle_sets(rows)
    ones, up = {}, {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    def join(a, b):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)

    for d in sorted(sets):
        if sets[d] in ones:
            join(d, ones[sets[d]])
        ones.setdefault(sets[d], d)
    meet, links = {}, 0
    for s, d in ones.items():
        for x in s:
            meet.setdefault(x, []).append(d)
    for a, b in {(a, b) for ds in meet.values() if len(ds) < 200 for a in ds for b in ds if a < b}:
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links += 1
            join(a, b)
    got = {r["doc_id"]: r["group_id"] for r in simhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert links > 100 and set(got) == set(sets)
    assert sum(got[d] != root(d) for d in got) <= 0.01 * len(got)
    assert all(root(d) == root(got[d]) for d in got)  # no group joins what is not linked


def test_viterbi_is_the_best_of_all_paths():
    random.seed(12)
    noise = np.random.Generator(np.random.PCG64(1)).random((noisy_channel_toxicity.CLASSES,) * 3) + 0.01
    model = np.log(noise / noise.sum(axis=2, keepdims=True)).astype(np.float32)
    for word in ("1d10t", "sttt@", "a-b", "0|0", "$$$o", "x9!", "aab1"):
        leaving = {}
        for start, to, letters, cost in noisy_channel_toxicity.arcs(word):
            leaving.setdefault(start, []).append((to, letters, cost))

        def paths(at, state, score, text):
            if at == len(word):  # noqa: B023
                yield score + float(model[(*state, 0)]), text  # noqa: B023
            for to, letters, cost in leaving.get(at, ()):  # noqa: B023
                s, now = score + cost, state
                for letter in letters:
                    k = noisy_channel_toxicity._NUMBER[letter]
                    s, now = s + float(model[(*now, k)]), (now[1], k)  # noqa: B023
                yield from paths(to, now, s, text + letters)

        best, text = max(paths(0, (0, 0), 0.0, ""))
        got = noisy_channel_toxicity.restore(word, model)
        assert max(s for s, t in paths(0, (0, 0), 0.0, "") if t == got) >= best - 1e-9, (word, got, text)
    long = "1d10t" * 400
    assert len(noisy_channel_toxicity.restore(long, model)) >= 400


def test_toxicity_on_the_held_out_fold(spark):
    """Accuracy and AUC on labelled rows whose labels were never read, of a whole table."""
    folder = SF_DIR.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    scored = noisy_channel_toxicity.score_toxicity(docs, labels).where("held_out").join(labels.where("toxic is not null"), "doc_id").select("score", "predicted", "toxic").collect()
    toxic, clean = [r["score"] for r in scored if r["toxic"]], [r["score"] for r in scored if not r["toxic"]]
    auc = sum((a > b) + 0.5 * (a == b) for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert len(scored) > 500 and auc >= 0.93 and sum(r["predicted"] == r["toxic"] for r in scored) / len(scored) >= 0.95


def test_whole_licences(spark):
    known = licence_scan.LICENCES
    assert {"Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0", "CC0-1.0", "MIT", "BSD-3-Clause"} <= set(known)
    df = spark.createDataFrame([(k, t.upper()) for k, t in enumerate(known.values())], "doc_id long, text string")
    assert [r["licence"] for r in licence_scan.scan(df).orderBy("doc_id").collect()] == list(known)


def test_surrogates_read_a_key(spark):
    df = spark.createDataFrame([(1, "write to anna.p@example.org"), (1, "write to anna.p@example.org")], "doc_id long, text string")
    one, two = ([r["text"] for r in pii_surrogates.surrogates(df, key).collect()] for key in ("k", "other"))
    assert one[0] == one[1] != two[0] and "anna.p" not in one[0]


def test_a_cluster_session_must_name_its_folder():
    from quillspark.operators import exchange

    class Context:
        master = "spark://somewhere"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(ValueError):
        exchange.shared_folder(Session())
    assert SparkSession is not None and math.isfinite(zlib.crc32(b"x")) and merkle_fixity.levels_for(0) == 1
