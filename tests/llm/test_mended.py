"""Faults that were found in the operators, each with the case that showed it."""

import gzip
import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import html_layout, licence_scan, merkle_fixity, pii_surrogates, simhash_dedup
from quillspark.llm.common import connected_components
from quillspark.llm.licence_texts import LICENCES, TITLES
from tests.oracle import SF_DIR, connection, of_frame, of_sql

# --- 2: HTML ---


def test_quotes_open_values_only_behind_an_equals_sign():
    seen = html_layout.visible_text
    assert seen("<p>One</p><a title=it's>Hello</a><p>Two, don't go</p><p>Three</p>") == "One\n\nHello\n\nTwo, don't go\n\nThree"
    assert seen("<p>5 o'clock <b title=don't>bold</b> text</p><p>It's here</p>") == "5 o'clock bold text\n\nIt's here"
    assert seen('<p "q>t</p>x') == "t\n\nx" and seen('<a title="x>Hello</a> more') == "Hello more"
    assert seen("<a b='1>2' c = \"3>4\" d=5>x</a>") == "x" and seen("<!-->a<!--->b<!-- c > d --!>e") == "abe"
    assert html_layout.build_tree("<a X=1 x=2 y = 'é&amp;' z=\"'\" w>").children[0].attribute("y") == "é&"


@pytest.mark.parametrize("bad", ['<a "', "<a '", '<a b="', "<!", "<!--", "<style>", "</script ", "<a b='c", "<?", "<p/", "<textarea>", "<style>/*", "<style>{", "<a =", "<style>@media{"])
def test_tag_soup_takes_time_in_proportion(bad):
    began = time.time()
    html_layout.visible_text(bad * (10_000_000 // len(bad)))
    assert time.time() - began < 5


def test_style_rules_for_screens_only():
    rules = html_layout.style_rules
    assert rules("@media print{.a{display:none}} @media screen{.b{display:none}} @media (max-width:9px){.c{display:none}}.d{color:red;display:none}") == {".b": ";display:none", ".d": ";color:red;display:none"}
    assert rules("@import 'x;{'; .a{content:'}';visibility:hidden} .b{.c{display:none} color:red} .e{display:block}") == {".a": ";content:'}';visibility:hidden"}
    assert rules("@supports (x:y){.a{display:none}} @media all, print{#k, p.q{display:none}} }}{ .z{display:none}") == {"#k": ";display:none"}
    seen = html_layout.visible_text
    assert seen("<style>@media print{.noprint{display:none}}</style><style media=print>p{display:none}</style><p class=noprint>kept") == "kept"


def test_no_text_is_lost_to_strange_attributes(spark):
    random.seed(6)
    pages = [r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect() if r["html"]]
    strange = [" title=it's", " alt='a\"b'", ' x="o\'clock >"', " don't", ' "', " y = z'", "/", " data-k=\"<p>\""]
    for page in pages:
        noisy = re.sub(r"<(p|b|a|div|li|td|span|h[1-6]|em|ul|tr)((?:\s[^<>]*)?)>", lambda m: f"<{m[1]}{random.choice(strange) if not m[2] else ' '.join(['', *random.choices(strange[:3], k=1)])}{m[2]} q>", page)
        assert html_layout.visible_text(noisy).split() == html_layout.visible_text(page).split()


# --- 3: surrogates ---


def test_particles_as_surnames_move():
    key = b"k"
    said, new = [], []
    for title in pii_surrogates.TITLES:
        for t in (title, title.upper()):
            for particle in pii_surrogates.PARTICLES:
                for surname in (particle.upper(), particle.capitalize()):
                    value = f"{t} {surname}"
                    found = list(pii_surrogates.entities(f"dear {value}, hello"))
                    assert [(k, v) for _, _, k, v in found] == [("title", value)]
                    said.append(value)
                    new.append(pii_surrogates.surrogate("title", value, key))
    assert all(a != b for a, b in zip(said, new, strict=True)) and len(set(new)) == len(set(said))
    assert pii_surrogates.surrogate("title", "MR VON", key).title() == pii_surrogates.surrogate("title", "Mr Von", key)
    words = [chr(97 + a) + chr(97 + b) for a in range(26) for b in range(26)]
    names = [f"Mr {w.upper()}" for w in words] + [f"Mr {w.capitalize()}" for w in words]
    assert len({pii_surrogates.surrogate("title", n, key) for n in names}) == len(names)


def test_texts_that_ended_the_table(spark):
    rows = [(1, "dear MR LE, hello"), (2, "Mrs VAN met Dr VON at ::1 and 2001:db8::ff00:42:8329, Mr Le Pen"), (3, "Mr ⅧⅧ wrote"), (4, None), (5, "MR LE again"), (6, "no one: 10:30:45, a::b, std::move")]
    found = {r["doc_id"]: r for r in pii_surrogates.surrogates(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    assert len(found) == 6 and found[4]["text"] is None and found[6]["text"] == rows[5][1]
    for k, text in rows:
        if text:
            for e in found[k]["entities"]:
                assert e["surrogate"] != e["value"] and found[k]["text"][e["start"] :].startswith(e["surrogate"])
    assert found[1]["entities"][0]["surrogate"] == found[5]["entities"][0]["surrogate"]
    assert [e["kind"] for e in found[2]["entities"]] == ["title", "title", "ipv6", "title"] and re.fullmatch(r"2001:[0-9a-f]{3}::[0-9a-f]{4}:\d\d:\d{4}", found[2]["entities"][2]["surrogate"])
    assert re.fullmatch(r"title-[0-9a-f]{24} wrote", found[3]["text"])


def test_colliding_values_are_mended_alone(spark):
    schema = f"doc_id long, text string, entities {pii_surrogates.ENTITIES}"
    one = [("name", "Ann Lee", "Eva Kim", 6), ("ip", "1.2.3.4", "5.6.7.8", 18), ("name", "Bo Po", "Eva Kim", 26)]
    rows = [(1, "hello Eva Kim and 5.6.7.8 Eva Kim!", one), (1, "Eva Kim", [("name", "Bo Po", "Eva Kim", 0)]), (2, "9.9.9.9", [("ip", "9.9.9.8", "9.9.9.9", 0)]), (None, None, [])]
    replaced = spark.createDataFrame(rows, schema)
    met = pii_surrogates.collisions(replaced)
    assert [tuple(r) for r in met.collect()] == [("name", "Eva Kim")]
    found = sorted((tuple(r) for r in pii_surrogates.mended(replaced, met, "k").collect()), key=repr)
    ann, bo = (f"name-{spark.range(1).select(F.sha2(F.lit(f'k{chr(0)}name{chr(0)}{v}'), 256)).first()[0][:24]}" for v in ("Ann Lee", "Bo Po"))
    assert sorted(r[1] or "" for r in found) == sorted(["", "9.9.9.9", bo, f"hello {ann} and 5.6.7.8 {bo}!"])
    assert pii_surrogates.collisions(pii_surrogates.mended(replaced, met, "k")).isEmpty()
    assert all(r[1][e["start"] :].startswith(e["surrogate"]) for r in found for e in r[2])


# --- near duplicates ---


def components_of(nodes, pairs):
    up = {x: x for x in nodes}

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


@pytest.mark.parametrize("block", [16, 2048])
def test_links_are_found_however_many_nearer_pairs_fail(spark, monkeypatch, block):
    """Few of the pairs within the radius are alike, and those at random: far ones as well as near ones."""
    monkeypatch.setattr(simhash_dedup, "BLOCK", block)
    random.seed(3)
    fps = [sum(1 << random.randrange(64) for _ in range(4)) & (2**64 - 1) for _ in range(60)]
    keys = [[i % 2 + 1, 7] if i % 5 else [7] for i in range(len(fps))]
    kinds = [random.sample(range(10_000), random.choice([10, 40])) for _ in range(20)]
    sets = [sorted({*random.choice(kinds), 20_000 + i % 2}) for i in range(len(fps))]
    close = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 7]
    alike = [(a, b) for a, b in close if len({*sets[a]} & {*sets[b]}) >= 0.8 * len({*sets[a]} | {*sets[b]})]
    df = spark.createDataFrame([(i, [int(np.uint64(f).astype(np.int64))], k) for i, (f, k) in enumerate(zip(fps, keys, strict=True))], "id long, fp array<long>, keys array<long>")
    held = spark.createDataFrame(list(enumerate(sets)), "id long, shingles array<int>")
    got = {r["id"]: r["component"] for r in connected_components(simhash_dedup.signature_links(df, 7, held)).collect()}
    assert {i: got.get(i, i) for i in range(len(fps))} == components_of(range(len(fps)), alike) and len(close) > 300 and 20 < len(alike) < 100


def test_shared_elements():
    random.seed(9)
    sets = [np.array(sorted(random.sample(range(30_000), random.randrange(1, 9000))), np.int32) for _ in range(12)]
    found = simhash_dedup._shared(sets)
    assert all(found[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(12) for j in range(12) if i != j)


def test_short_near_copies_are_found(spark):
    random.seed(8)
    word = lambda: "".join(random.choices("abcdefghij", k=6))
    rows, pairs = [], []
    for k in range(300):
        long = [word() for _ in range(random.choice([9, 10, 14, 24, 36, 44]))]
        n = len(long) - 4
        short = long[: len(long) - int(0.2 * n + 1e-9)]  # shares its shingles, four fifths or more of the longer one's
        rows += [(2 * k, " ".join(long)), (2 * k + 1, " ".join(short))]
        pairs.append((2 * k, 2 * k + 1))
    rows += [(10_000 + k, " ".join(word() for _ in range(9))) for k in range(300)]
    got = {r["doc_id"]: r["group_id"] for r in simhash_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = sum(got[a] == got[b] for a, b in pairs)
    assert found >= 0.99 * len(pairs) and len(set(got.values())) >= len(rows) - len(pairs)


# --- 8: damaged archives ---


def warc(name, body):
    return f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:record:{name}>\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()


def test_damaged_archives_give_rows(spark, tmp_path):
    random.seed(4)
    records = [warc(k, "".join(random.choices("abcdef \n", k=3000))) for k in range(20)]
    members = [gzip.compress(r) for r in records]
    places = [sum(map(len, members[:k])) for k in range(21)]
    digests = [hashlib.sha256(r).hexdigest() for r in records]
    whole, file = gzip.compress(b"".join(records)), b"".join(members)
    for name, content in {
        "good": file, "cut": file[: places[9] + 40], "flip": file[: places[5] + 60] + bytes([file[places[5] + 60] ^ 255]) + file[places[5] + 61 :],
        "head": file[: places[7]] + b"\x1f\x8b\x09" + file[places[7] + 3 :], "one": whole[: len(whole) // 2], "noise": b"\x1f\x8b" + bytes(1000), "empty": b"",
        "long": warc(1, "x").replace(b"Content-Length: 1", b"Content-Length: " + b"9" * 5000) + records[2], "plain": b"".join(records),
    }.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(content)
    found = {}
    for r in merkle_fixity.read_archives(spark, str(tmp_path), places=True).collect():
        found.setdefault(r["archive"].removesuffix(".warc.gz"), []).append(r)
    told = {name: [(r["record_id"], r["digest"]) for r in rows] for name, rows in found.items()}
    every = list(zip(map(str, range(20)), digests, strict=True))
    assert told["good"] == told["plain"] == every and [r["place"] for r in found["good"]] == places[:-1] and [r["offset"] for r in found["good"]] == [r["offset"] for r in found["plain"]] == [r["place"] for r in found["plain"]]
    assert told["cut"][:9] == every[:9] and f"unreadable:{places[9]}" in dict(told["cut"]) and not set(told["cut"]) & set(every[9:])
    assert set(every) - set(told["flip"]) == {every[5]} and f"unreadable:{places[5]}" in dict(told["flip"])
    assert set(every) - set(told["head"]) == {every[7]} and f"unreadable:{places[7]}" in dict(told["head"])
    assert "unreadable:0" in dict(told["one"]) and 5 <= len(set(told["one"]) & set(every)) < 15
    assert [name for name, _ in told["noise"]] == ["unreadable:0"] and "empty" not in told
    assert ("2", digests[2]) in told["long"] and len(told["long"]) == 2
    read = merkle_fixity.read_archives(spark, str(tmp_path))
    good, flip = (read.where(f"archive = '{name}.warc.gz'").withColumn("archive", F.lit("a")) for name in ("good", "flip"))
    status = {r["record_id"]: r["status"] for r in merkle_fixity.audit(good, flip).collect()}
    assert status["5"] in ("missing", "corrupt") and status[f"unreadable:{places[5]}"] == "extra" and {s for i, s in status.items() if i not in ("5", f"unreadable:{places[5]}")} <= {"moved"}


# --- 10: licence files ---


def test_licence_files_as_published_are_found(spark, tmp_path):
    mit, bsd = LICENCES["MIT"], LICENCES["BSD-3-Clause"]
    commented = "/*\n * Copyright (c) 2020 Some One\n *\n" + "\n".join(f" * {line}" for line in mit.split("\n")) + "\n */"
    texts = {
        "MIT": [f"MIT License\n\nCopyright (c) 2019 A\n\n{mit}", f"The MIT License (MIT)\n\nCopyright © 2020 B\nCopyright 2021 C\n\n{mit}\n", commented, "\n".join(f"# {line}" for line in mit.split("\n")), mit.upper()],
        "ISC": [f"ISC License\n\nCopyright (c) 2001, A\n\n{LICENCES['ISC']}"], "Zlib": [f"zlib License\n\n(C) 2001 A\n\n{LICENCES['Zlib']}"],
        "BSD-3-Clause": [f"BSD 3-Clause License\n\nCopyright (c) 2020, A\nAll rights reserved.\n\n{bsd}", f"Copyright (c) 2020, A. All rights reserved.\n\n{re.sub('(?m)^[0-9][.] ', '* ', bsd)}", re.sub("(?m)^([0-9])[.] ", r"  \1) ", bsd), re.sub("(?m)^1[.] ", "a. ", bsd)],
        None: [mit + " And more.", "MIT License", "", None, f"Title of a book\n{mit}", "All rights reserved."],
    }
    rows = [(k, name, text) for k, (name, text) in enumerate((n, t) for n, ts in texts.items() for t in ts)]
    rows += [(1000 + k, name, f"{title}\n\n{LICENCES[name]}") for name, titles in TITLES.items() for k, title in enumerate(titles)]
    spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = licence_scan.scan(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert sorted((r["doc_id"], r["licence"] or "") for r in found.collect()) == sorted((i, n or "") for i, n, _ in rows)
    con = connection()
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert of_frame(found) == of_sql(con, licence_scan.oracle_sql())
