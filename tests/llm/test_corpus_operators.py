"""Each corpus operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns of clashing names."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from datavane.llm import bpe, common, conversations, exact, interactions, jaccard, language, licenses, merkle, packing, queries, shards, substrings, suffixes, url_rules
from pyspark.sql import functions as F

WS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def passage(rng, n, words=400):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def corpus():
    rng = random.Random(7)
    shared = passage(rng, 70, 10_000)
    rows = []
    for i in range(60):
        words = passage(rng, rng.choice([3, 8, 60, 200]), 5000)
        if i % 6 == 0:
            words += shared + passage(rng, 20, 5000)
        rows.append(" ".join(words))
    base = passage(rng, 150, 5000)
    for i in range(8):  # a chain of near copies
        own = list(base)
        for j in range(i):
            own[j * 10 + 1] = f"x{i}"
        rows.append("  ".join(own) if i % 2 else "\n".join(own))
    rows += [rows[3], rows[3], rows[5] + " ", "\t" + rows[5], None, "", "   ", "É ü 漢字 <|endoftext|> ok", "only one", "Only One", " ".join(passage(rng, 20_000, 3000)), "a  b\n c\x0bd", "aaaa" * 50]
    return [(i, t, "en" if i % 2 else "de", "s", 0) for i, t in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # columns whose names the operators also use inside
    return spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("shard", F.lit(1)).withColumn("component_id", F.lit("x")).withColumn("digest", F.lit(None).cast("string")).withColumn("n", F.lit(2)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_url_rules(spark):
    urls = ["http://a.com/en/x", "https://WWW.example.com/en/1?q#f", "http://example.com/en/", "http://example.com/fr", "http://m.example.net/es/2", "http://net/fr/", "nothing", None, "http://", "http://x.com", "http://x.com?y/", "ftp://b.example.com/en/z", "http://notexample.com/en/"] + ["http://hot.net/es/1"] * 50
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in url_rules.url_verdicts(df, rules).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = raw.translate({c: c + 32 for c in range(65, 91)}), re.match(r"[^?#]*", rest[len(raw) :])[0]
        fit = [(len(h + p), h + p, v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, None, "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, best[1], best[2]), u
    assert url_rules.url_verdicts(df.limit(0), rules).count() == 0


def test_url_rules_ties_nulls_and_repeated_rows(spark):
    rules = spark.createDataFrame([("a.com", "/x", "block"), ("a.com", "/x", "allow"), ("com", "/x/abc", "block"), ("b.a.com", "/", "block"), (None, "/", "block"), ("COM", None, "block")], "host string, path string, verdict string")
    df = spark.createDataFrame([(None, "h://a.com/x"), (None, "h://a.com/x"), (1, "h://z.a.com/x/abc"), (1, "h://z.a.com/x/abc"), (2, "h://b.a.com/x"), (3, None), (4, "h://q.com/x/abc?")], "page_id long, url string")
    got = Counter((r.page_id, r.rule, r.verdict) for r in url_rules.url_verdicts(df, rules).collect())
    # equal rules: the smaller verdict; a.com/x and com/x/abc: the longer; b.a.com/ and a.com/x: the longer
    assert got == Counter({(None, "a.com/x", "allow"): 2, (1, "com/x/abc", "block"): 2, (2, "b.a.com/", "block"): 1, (3, None, "allow"): 1, (4, "com/x/abc", "block"): 1})


def test_language(spark, empty):
    rng = random.Random(3)
    alphabet = {"aa": "aeiourst", "bb": "mnzwkyp", "cc": "äöüßxq"}
    rows = []
    for i in range(90):
        lang = ["aa", "bb", "cc"][i % 3]
        rows.append((i, " ".join("".join(rng.choice(alphabet[lang]) for _ in range(5)) for _ in range(40)), lang, "s", 0))
    rows += [(90, None, "aa", "s", 0), (91, "", None, "s", 0), (92, "123 !!", "bb", "s", 0), (93, "z" * 3_000_000, "bb", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    learned = language.learn(df.where(~language.held_out(F.col("doc_id"))))
    assert set(learned) == {"aa", "bb", "cc"}
    got = {r.doc_id: r for r in language.identify(df, learned).collect()}
    assert all(got[i].lang_pred == rows[i][2] for i in range(90)) and got[93].lang_pred == "bb"
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (90, 91, 92)) and all(0 <= r.score <= 1 for r in got.values())
    held = {r.doc_id for r in df.where(language.held_out(F.col("doc_id"))).collect()}
    assert held == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {r.doc_id for r in language.keep_identified(df, learned).collect()} == set(range(90)) | {93}
    assert language.identify(empty, learned).count() == 0 and language.learn(empty) == {}
    assert {r.lang_pred for r in language.identify(df, {}).collect()} == {"und"}


def brute_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    count = Counter()
    for w in words:
        count.update(w)
    line = " " + " ".join(words) + " " if words else ""
    count.update(line[i : i + 2] for i in range(len(line) - 1))
    count.update(line[i : i + 3] for i in range(len(line) - 2) if line[i + 1] != " ")
    code = lambda g: sum((0 if c == " " else ord(c)) + 1 << 21 * i for i, c in enumerate(g))
    return {code(g): n for g, n in count.items()}


def test_language_against_brute_force(spark):
    rng = random.Random(9)
    words = {"xx": ["the", "and", "über", "night"], "yy": ["der", "und", "the", "nacht"], "zz": ["el", "y", "noche", "und"]}
    rows = [(i, " ".join(rng.choices(words[lang] + ["same"], k=rng.choice([1, 2, 5, 30]))) + rng.choice(["", "!", " 12 É"]), lang, None, 0) for i, lang in enumerate(["xx", "yy", "zz"] * 40)]
    rows += [(200, "the the", "xx", None, 0), (200, "the the", "xx", None, 0), (None, "und", None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    k = 20
    total = {lang: Counter() for lang in words}
    for _, t, lang, *_ in rows:
        if lang:
            total[lang].update(brute_grams(t))
    best = {lang: sorted(c, key=lambda g: (-c[g], g))[:k] for lang, c in total.items()}
    learned = language.learn(df, k=k)
    assert {lang: list(map(int, p)) for lang, p in learned.items()} == best
    want = Counter()
    for i, t, *_ in rows:
        c = brute_grams(t)
        mine = sorted(c, key=lambda g: (-c[g], g))[:k]
        far = {lang: sum(min(k, abs(n - p.index(g))) if g in p else k for n, g in enumerate(mine)) for lang, p in best.items()}
        lang = min(far, key=lambda x: (far[x], x))
        want[i, lang, round(1 - far[lang] / (k * len(mine)), 9)] += 1
    assert Counter((r.doc_id, r.lang_pred, round(r.score, 9)) for r in language.identify(df, learned, k=k).collect()) == want


def test_language_without_labels_keeps_texts(spark):
    rows = [(0, "some words", None, "s", 0), (1, "Öl 1", None, "s", 0), (2, "12 !", None, "s", 0), (3, None, None, "s", 0), (4, "", None, "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    learned = language.learn(df)
    assert learned == {} and {r.doc_id for r in language.keep_identified(df, learned).collect()} == {0, 1}


def test_gram_counts_in_pieces():
    text = "Straße über den Fluß, und so weiter. " * 40
    one, two = language.gram_counts(text), language.gram_counts(text, piece=97)
    assert dict(zip(*map(list, one), strict=True)) == dict(zip(*map(list, two), strict=True))


def test_shards(docs, rows, empty):
    got = shards.byte_shards(docs).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    size = {i: len((t or "").encode()) + 1 for i, t, *_ in rows}
    order = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in order] == list(range(len(rows)))  # contiguous
    per = defaultdict(list)
    for r in order:
        assert r["size"] == size[r.doc_id] and r.text_crc32 == zlib.crc32((rows[r.doc_id][1] or "").encode()) and r.law == "bytes" and r.grown_shard is None
        per[r.shard].append(r.slot)
    assert all(v == list(range(len(v))) for v in per.values()) and set(per) <= set(range(8))
    total, longest = sum(size.values()), max(size.values())
    sums = Counter()
    for r in got:
        sums[r.shard] += r["size"]
    assert all(s <= total / 8 + longest for s in sums.values())
    start, want = 0, {}
    for i in range(len(rows)):
        want[i] = min(7, int((2 * start + size[i]) * 8 // (2 * total)))
        start += size[i]
    assert {r.doc_id: r.shard for r in got} == want
    assert shards.byte_shards(empty).count() == 0


def test_licenses(spark):
    filler = "the of and to " * 30
    files = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.txt", filler), (3, "a/b/LICENSE", f"{filler}\n\nLicensed under the Apache License, Version 2.0.\n\nmore"), (4, "a/b/c/y.txt", f"head\nLicensed under CC BY-NC 4.0.\n{filler}"), (5, "z/q.txt", None), (6, None, ""), (7, "a/z.txt", filler), (8, "top.txt", "x" * 100_000)]
    df = spark.createDataFrame(files, "doc_id long, path string, text string").withColumn("license", F.lit("clash"))
    got = by_id(licenses.inherit(licenses.scan(df)))
    assert {i: (r.license, r.basis) for i, r in got.items()} == {1: ("MIT", "own"), 2: ("Apache-2.0", "inherited"), 3: ("Apache-2.0", "own"), 4: ("CC-BY-NC-4.0", "own"), 5: (None, "none"), 6: (None, "none"), 7: ("MIT", "inherited"), 8: (None, "none")}
    assert got[2].license_dir == "a/b" and licenses.inherit(licenses.scan(df.limit(0))).count() == 0


def test_license_inheritance_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY 4.0.", "no word of it", None, "some words. Released under the ISC License. more words"]
    files = []
    for i in range(120):
        folder = "/".join(rng.choice("ab") for _ in range(rng.randrange(4)))
        name = rng.choice(["LICENSE", "LICENSE-1", "LICENSE-2", "x.txt"])
        files.append((i, f"{folder}/{name}" if folder else name, rng.choice(texts)))
    files += [(200, None, texts[0]), (201, None, None), (202, "a/x.txt", texts[0]), (202, "a/x.txt", texts[0])]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    scanned = licenses.scan(df)
    label = {r.doc_id: (r.own_license, r.own_score) for r in scanned.collect()}
    split = lambda p: p.rpartition("/")[::2]
    held = defaultdict(list)
    for i, p, _ in files:
        if p and split(p)[1].startswith("LICENSE") and label[i][0]:
            held[split(p)[0]].append((-label[i][1], split(p)[1], label[i][0]))
    want = Counter()
    for i, p, _ in files:
        own, got = label[i][0], (None, None)
        if p is not None:
            at = split(p)[0].split("/") if split(p)[0] else []
            near = next((d for d in ("/".join(at[:n]) for n in range(len(at), -1, -1)) if held.get(d)), None)
            got = (min(held[near])[2], near) if near is not None else got
        want[(i, own, "own", split(p)[0] if p else None) if own else (i, got[0], "inherited" if got[0] else "none", got[1])] += 1
    assert Counter((r.doc_id, r.license, r.basis, r.license_dir) for r in licenses.inherit(scanned, "LICENSE(?:-.*)?").collect()) == want
    assert len({w[2] for w in want}) == 3


def test_license_scan_against_brute_force(spark):
    """The scan's label and score are those of the best of all units around the places that name a licence."""
    rng = random.Random(8)
    notices = [t for _, t in licenses.TEMPLATES[::23]]
    files = [(i, "x", "\n".join(" ".join(passage(rng, 6)) if rng.random() < 0.7 else rng.choice(notices) for _ in range(4))) for i in range(40)]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    model = licenses.Templates(licenses.TEMPLATES, 0.6, licenses.frequencies(df, {w for t in licenses.TEMPLATES for w in licenses.tokens(t[1])}))
    got = by_id(licenses.scan(df))
    for i, _, text in files:
        words, best = licenses.tokens(text), (0.0, 1)
        lines = [n for n, line in enumerate(text.split("\n")) for _ in licenses.tokens(line)]
        for label, a, b in licenses.named(words):
            spans = {(lo, hi) for lo in range(a + 1) for hi in range(b, len(words) + 1) if hi - lo in model.sizes[label] or (lo == a and hi == b) or (lo == 0 and hi == len(words))}
            spans.add((min(n for n, x in enumerate(lines) if x == lines[a]), max(n for n, x in enumerate(lines) if x == lines[b - 1]) + 1))
            best = max([best, *((c, -j) for c, j in (model.cosine(words[lo:hi], label) for lo, hi in spans))])
        if best[0] < 0.6:
            assert got[i].own_license is None or got[i].own_score >= 0.6
        else:
            assert got[i].own_score >= round(best[0], 6) and got[i].own_license is not None


def test_license_variants_are_told_apart(spark):
    notices = [
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"), ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"), ("Licensed under CC BY-NC 3.0.", "CC-BY-NC-3.0"),
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0"), ("Released under CC0 1.0.", "CC0-1.0"),
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0-only"), ("This work is licensed under the GNU General Public License, version 2 or later.", "GPL-2.0-or-later"),
        ("This work is licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0-only"), ("Licensed under the GNU Lesser General Public License, version 2.1.", "LGPL-2.1-only"),
        ("Licensed under the Apache License, Version 1.1.", "Apache-1.1"), ("Licensed under the Mozilla Public License, version 2.0.", "MPL-2.0"), ("Licensed under the BSD 2-Clause License.", "BSD-2-Clause"),
        ("Released under the ISC License.", "ISC"), ("Released under the Unlicense.", "Unlicense"), ("SPDX-License-Identifier: GPL-3.0+", "GPL-3.0-or-later"), ("SPDX-License-Identifier: MIT-0", "MIT-0"),
        ("Licensed under the BSD License.", None), ("Licensed under CC BY.", None), ("SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", None), ("Licensed under the GNU General Public License.", None), ("Den mit Lizenz.", None),
    ]
    got = by_id(licenses.scan(spark.createDataFrame([(i, "x", t) for i, (t, _) in enumerate(notices)], "doc_id long, path string, text string")))
    assert [(t, got[i].own_license) for i, (t, _) in enumerate(notices)] == notices
    assert all({name} == {x for x, _, _ in licenses.named(licenses.tokens(t))} for name, t in licenses.TEMPLATES)


def test_licenses_with_words_around_them(spark):
    rng = random.Random(11)
    many = " ".join(passage(rng, 400))
    notices = [
        ("Distributed under the MIT License. See LICENSE for details.", "MIT", 0),
        ("Copyright 2021 Jane Doe. Licensed under the Apache License, Version 2.0.", "Apache-2.0", 0),
        ("SPDX-License-Identifier: MIT", "MIT", 0),
        (f"{many} This work is licensed under the GNU General Public License, version 3. {many}", "GPL-3.0-only", 0),
        (f"{many}\n{many}\nThis work is licensed under the GNU\nGeneral Public\nLicense, version 2.\n{many}", "GPL-2.0-only", 2),
        (f"{many}\nThis work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License {many}", "CC-BY-SA-4.0", 1),
        (many, None, None),
    ]
    files = [(i, "x", t) for i, (t, *_) in enumerate(notices)] + [(i, "x", " ".join(passage(rng, 50))) for i in range(10, 60)]
    df = spark.createDataFrame(files, "doc_id long, path string, text string")
    got = by_id(licenses.scan(df))
    assert [(t, got[i].own_license, got[i].own_line) for i, (t, *_) in enumerate(notices)] == notices
    total, counts = licenses.frequencies(df, {"mit"})
    assert total == len(files) and counts["mit"] == 2 and all(c == sum(w in licenses.tokens(t) for *_, t in files) for w, c in counts.items())


def test_license_bodies_reach_to_the_next_notice():
    forms = "Redistribution and use in source and binary forms, with or without modification, are permitted"
    binary, third, much = "Redistributions in binary form must reproduce the above copyright notice.", "Neither the name of the owner", "Some other clause is met here. " * 2000
    free = "Permission is hereby granted, free of charge, to any person obtaining a copy"
    cases = [
        (f"{forms} {binary} {much} {third}", ["BSD-3-Clause"]),
        (f"{forms} {much} {binary}", ["BSD-2-Clause"]),
        (f"{forms} {binary} {forms} {binary} {much} {third}", ["BSD-2-Clause", "BSD-3-Clause"]),
        (f"{free} {much} the software is provided as is", ["MIT-0"]),
        (f"{free} {much} this notice shall be included {much} the software is provided as is", ["MIT"]),
        (f"{free} the software is provided as is {forms} {binary} {much} except as contained in this notice", ["MIT-0", "BSD-2-Clause"]),
    ]
    assert [[x for x, *_ in licenses.named(licenses.tokens(t))] for t, _ in cases] == [want for _, want in cases]


def test_license_anchors_lose_nothing():
    model = licenses.Templates(licenses.TEMPLATES, 0.6)
    rng = random.Random(1)
    words = sorted(model.idf) + ["foo", "bar"]
    for _ in range(5000):
        unit = [rng.choice(words) for _ in range(rng.randrange(1, 15))]
        if model.best(unit)[0] >= 0.6:
            assert model.any.search(" ".join(unit))


def test_bpe(docs, rows, empty):
    from tokenizers import Tokenizer

    path = queries.VOCABULARY
    t = Tokenizer.from_file(path)
    got, ids = by_id(bpe.round_trip(docs, path)), by_id(bpe.encode(docs, path))
    texts = by_id(bpe.decode(bpe.encode(docs, path), path))
    for i, text, *_ in rows:
        want = t.encode(text or "", add_special_tokens=False).ids
        assert ids[i].ids == want and got[i].n_tokens == len(want)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        back = t.decode(want, skip_special_tokens=False)
        assert got[i].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest() and texts[i].text == back == (text or "")
    assert bpe.round_trip(empty, path).count() == 0


def brute_removed(rows, size=50):
    first, at = {}, {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        w = WS.findall(text or "")
        at[i] = w
        for j in range(len(w) - size + 1):
            first.setdefault(tuple(w[j : j + size]), i)
    out = {}
    for i, w in at.items():
        gone = set()
        for j in range(len(w) - size + 1):
            if first[tuple(w[j : j + size])] < i:
                gone.update(range(j, j + size))
        out[i] = (len(w), len(gone), [x for j, x in enumerate(w) if j not in gone])
    return out


def test_substrings(docs, rows, empty):
    got, want = by_id(substrings.removed_words(docs)), brute_removed(rows)
    assert set(got) == set(want) and sum(w[1] for w in want.values()) > 500
    for i, (n, m, kept) in want.items():
        assert (got[i].n_words, got[i].n_removed, got[i].kept_sha256) == (n, m, hashlib.sha256(" ".join(kept).encode()).hexdigest()), i
    out = by_id(substrings.remove_repeats(docs))
    assert all(out[i].text == (" ".join(kept) if m else rows[i][1]) for i, (n, m, kept) in want.items())
    assert substrings.removed_words(empty).count() == 0


def test_a_sketch_of_any_size_or_kind_gives_the_same(docs, rows):
    want = {i for i, w in brute_removed(rows).items() if w[1]}
    base = docs.select("doc_id", "text")
    for more in ({"cells_per_item": 0}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "cells_per_item": 0}):
        assert {r.doc_id for r in substrings.repeated_windows(base, **more).collect()} == want


def test_without_broadcast_keys(docs, rows, monkeypatch):
    """Where ids are too many for a broadcast the texts are shuffled; nothing else changes."""
    monkeypatch.setattr(common, "MAX_KEYS", 0)
    want = brute_removed(rows)
    assert {i: r.n_removed for i, r in by_id(substrings.removed_words(docs)).items()} == {i: w[1] for i, w in want.items()}
    assert {i: r.component_id for i, r in by_id(jaccard.near_duplicates(docs)).items()} == {i: c for i, (_, c) in brute_components(rows).items()}
    assert exact.drop_duplicates(docs).count() == len({re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t, *_ in rows})


def thue_morse(size):
    s = "a"
    while len(s) < size:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


@pytest.fixture(scope="module")
def twins(spark):
    """Documents that differ in one word only: a Thue-Morse word and its complement, which cancel out in polynomials."""
    rng, rows = random.Random(1), []
    for size in (64, 1024, 2048, 4096):
        word = thue_morse(size)
        for w in (word, word.translate(str.maketrans("ab", "ba"))):
            rows += [(len(rows), f"{w} {w}", None, None, 0), (len(rows) + 1, " ".join(passage(random.Random(size), 30) + [w] + passage(random.Random(size + 1), 25)), None, None, 0)]
        rng.random()
    return rows, spark.createDataFrame(rows, SCHEMA).coalesce(1)


def test_words_that_cancel_out_in_polynomials_stay_apart(spark, twins):
    from tokenizers import Tokenizer

    rows, df = twins
    t = Tokenizer.from_file(queries.VOCABULARY)
    ids = {i: t.encode(text, add_special_tokens=False).ids for i, text, *_ in rows}
    assert {r.doc_id: r.ids for r in bpe.encode(df, queries.VOCABULARY).collect()} == ids
    crc = {i: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in [*v, 2])) for i, v in ids.items() if len(v) < 1024}
    got = {r.doc_id: r.ids_crc32 for r in packing.token_pieces(df, queries.RANKS, queries.VOCABULARY).collect() if r.doc_id in crc}
    assert got == crc
    assert {i: r.n_removed for i, r in by_id(substrings.removed_words(df)).items()} == {i: w[1] for i, w in brute_removed(rows).items()}
    assert {i: (r.n_shingles, r.component_id) for i, r in by_id(jaccard.near_duplicates(df)).items()} == brute_components(rows)


def test_chunks_with_one_hash_are_told_apart_by_their_bytes(monkeypatch, rows):
    import numpy as np
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "word_hashes", lambda raw, s, e: np.full(len(s), 7, dtype=np.uint64))
    model, t = bpe.PairIndexBPE(queries.VOCABULARY), Tokenizer.from_file(queries.VOCABULARY)
    coder = bpe.ChunkEncoder(model.encode_many, model.special)
    for text in [r[1] or "" for r in rows[:5]] * 2 + ["a b a b c", "b c", ""]:
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        got, at = coder.encode(raw, np.array([0, len(raw)]))
        assert got.tolist() == t.encode(text, add_special_tokens=False).ids and at.tolist() == [0, len(got)]


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.VOCABULARY)
    got = packing.pack(packing.token_pieces(docs, queries.RANKS, queries.VOCABULARY)).collect()
    per = defaultdict(list)
    for r in got:
        per[r.doc_id].append(r)
    for i, text, *_ in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        own = sorted(per[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        assert all(r.length == 1024 for r in own[1:])
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 1024
    histogram = [0] * 1025
    for r in got:
        histogram[r.length] += 1
    assert len(seqs) <= best_fit_alone(histogram) + 1
    assert packing.pack(packing.token_pieces(empty, queries.RANKS, queries.VOCABULARY)).count() == 0


def test_packing_with_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b c " * 500, None, None, 0)] * 3 + [(None, None, None, None, 0)] * 2 + [(None, "x", None, None, 0)], SCHEMA)
    got = packing.pack(packing.token_pieces(df, queries.RANKS, queries.VOCABULARY)).collect()
    assert sum(r.doc_id is None for r in got) == 3 and len({(r.sequence_id, r.offset) for r in got}) == len(got)
    assert len({r.ids_crc32 for r in got if r.doc_id == 1}) * 3 == sum(r.doc_id == 1 for r in got)


def test_patterns_hold_the_demand():
    import numpy as np

    rng = np.random.default_rng(5)
    lengths = np.minimum(1024, rng.lognormal(5.5, 0.9, 20_000).astype(int) + 1)
    demand = np.bincount(lengths, minlength=1025)
    found, _ = packing.patterns(demand)
    assert (sum(k * p for p, k in found) == demand).all() and all((p * np.arange(1025)).sum() <= 1024 for p, _ in found)
    assert sum(k for _, k in found) <= 1.02 * -(-(demand * np.arange(1025)).sum() // 1024)


def test_patterns_keep_only_what_they_hold():
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(6)
    demand = np.bincount(np.minimum(1024, rng.lognormal(5.5, 0.9, 100_000).astype(int) + 1), minlength=1025)
    tracemalloc.start()
    packing.short_patterns(demand)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6  # whole rows of every round took over 100 MB


def best_fit_alone(demand, capacity=1024):
    """Sequences that best fit needs: the longest piece first, filled by a subset sum of the others, longest first."""
    left, n = {i: int(x) for i, x in enumerate(demand) if x}, 0
    while left:
        top = max(left)
        room, came = capacity - top, {0: None}
        for size in sorted(left, reverse=True):
            copies, many = min(left[size] - (size == top), room // size), 1
            while copies > 0:
                many = min(many, copies)
                for c in [c for c in came if c + size * many <= room and c + size * many not in came]:
                    came[c + size * many] = (c, size, many)
                copies, many = copies - many, many * 2
            if room in came:
                break
        p, c = Counter({top: 1}), max(came)
        while came[c]:
            c, size, many = came[c]
            p[size] += many
        k = min(left[x] // m for x, m in p.items())
        n += k
        for x, m in p.items():
            left[x] -= k * m
            if not left[x]:
                del left[x]
    return n


@pytest.mark.parametrize("pieces", [500, 5000, 500_000])
def test_the_program_packs_as_well_as_best_fit(pieces):
    import numpy as np

    rng = np.random.default_rng(pieces)
    for lengths in (rng.lognormal(5.5, 0.9, pieces).astype(int) + 1, rng.integers(300, 700, pieces)):
        demand = np.bincount(np.minimum(1024, lengths), minlength=1025)
        found, report = packing.patterns(demand)
        assert (sum(k * p for p, k in found) == demand).all() and all((p * np.arange(1025)).sum() <= 1024 for p, _ in found)
        assert report["bound"] <= report["sequences"] == sum(k for _, k in found) <= 1.0005 * best_fit_alone(demand) + 1


@pytest.mark.parametrize("demand", [{10: 1000}, {10: 100_000}, {3: 40_000, 700: 1000, 900: 500}, {1: 5000, 7: 3, 1024: 2}])
def test_patterns_fill_with_hot_short_lengths(demand):
    import numpy as np

    want = np.zeros(1025, dtype=np.int64)
    for size, n in demand.items():
        want[size] = n
    found, _ = packing.patterns(want)
    assert (sum(k * p for p, k in found) == want).all() and all((p * np.arange(1025)).sum() <= 1024 for p, _ in found)
    least = max(-(-int((want * np.arange(1025)).sum()) // 1024), int(want[513:].sum()), -(-int(want[10]) // 102))
    assert sum(k for _, k in found) <= 1.01 * least + 1


def test_exact(docs, rows, empty):
    got = docs.transform(exact.exact_duplicates).collect()
    groups = defaultdict(list)
    for i, text, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((-len(text or ""), i))
    assert len(got) == len(rows)
    for r in got:
        norm = re.sub(r"[\x20\x09-\x0D]", "", rows[r.doc_id][1] or "")
        keep = min(groups[norm])[1]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(groups[norm]), r.doc_id == keep, hashlib.sha256(norm.encode()).hexdigest())
    assert {r.doc_id for r in exact.drop_duplicates(docs).collect()} == {min(g)[1] for g in groups.values()}
    assert exact.exact_duplicates(empty).count() == 0


def test_exact_with_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a b", None, None, 0)] * 3 + [(2, "ab", None, None, 0), (None, "q", None, None, 0), (None, "q", None, None, 0)], SCHEMA)
    got = exact.exact_duplicates(df).collect()
    assert len(got) == 6 and sum(r.kept for r in got) == 2
    out = exact.drop_duplicates(df).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "None", "None"]


def test_a_clash_of_digests_is_found(spark, monkeypatch):
    """The state says that two texts are equal; their bytes do not."""
    base = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    d = hashlib.sha256(b"b").hexdigest()
    state = spark.createDataFrame([(d, 2, 1, 0, 1, "")], "digest string, n long, keep_id long, keep_uid long, keep_chars long, keep_locator string")
    texts = base.withColumn("text", F.lit("b"))
    assert exact._clashes(texts, state).count() == 0
    monkeypatch.setattr(exact.F, "sha2", lambda c, n: F.lit(d))  # every digest falls together
    assert {r.digest for r in exact._clashes(base, state).collect()} == {d}
    monkeypatch.undo()
    assert {(r.doc_id, r.kept) for r in exact._by_text(base, spark.createDataFrame([(d,)], "digest string")).collect()} == {(2, True)}


def brute_components(rows, k=5):
    sets = {}
    for i, text, *_ in rows:
        w = WS.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("tile_bytes", "tile_rows", "guests", "cap"), [(16 << 20, 256, 16, 32), (2000, 256, 1, 32), (4000, 3, 0, 2), (16 << 20, 2, 2, 1)])
def test_near_duplicates(docs, rows, tile_bytes, tile_rows, guests, cap):
    got, want = by_id(jaccard.near_duplicates(docs, tile_bytes=tile_bytes, tile_rows=tile_rows, pair_rows=2 * tile_rows, guests=guests, cap=cap)), brute_components(rows)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert len({c for _, c in want.values()}) <= len(want) - 8


def test_near_duplicates_of_large_families(spark):
    """A chain of near copies and many copies of one text, in far more tiles than one; and many small sets with one common run."""
    rng, rows = random.Random(6), []
    base = passage(rng, 80, 5000)
    for i in range(120):  # neighbours in the chain link, its ends don't
        own = list(base)
        own[i % 80] = f"c{i}"
        if i % 3 == 0:
            base = own
        rows.append(" ".join(own))
    rows += [" ".join(passage(rng, 6, 10_000) + "one common run of words".split()) for _ in range(300)]
    rng.shuffle(rows)
    rows = [(i, t, None, None, 0) for i, t in enumerate(rows)]
    got = by_id(jaccard.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(6), tile_rows=16, pair_rows=40, guests=2, cap=4))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(rows)


def test_salted_prefix_groups_give_the_same_edges(docs):
    sig = jaccard._signatures(docs.select("doc_id", "text"), 5, 80).cache()
    roots = [{(r.node, r.root) for r in common.components(jaccard._shared_prefixes(sig, 2, **more)).collect()} for more in ({}, {"fold_rows": 10, "group_bytes": 1000})]
    assert roots[0] == roots[1] and len(roots[0]) > 5


def prefix_edges(spark, texts, cap=32):
    sig = jaccard._signatures(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, 80).cache()
    return jaccard._shared_prefixes(sig, cap).count()


def test_sets_meet_only_if_their_prefixes_share_what_similar_sets_must(spark):
    rng = random.Random(8)
    base = passage(rng, 100, 50_000)
    ended = lambda n: " ".join(base[: 100 - n] + passage(rng, n, 50_000))
    assert prefix_edges(spark, [ended(8), ended(0)]) == 1  # Jaccard 0.85
    assert prefix_edges(spark, [ended(18), ended(0), " ".join(base[:60])]) == 0  # 0.81 and less of the larger one, 0.58: some shared prefix shingles, but too few
    # 40 sets with a frequent run: each has two of its shingles in its prefix, similar sets share more
    assert prefix_edges(spark, [ended(21) for _ in range(40)]) == 0
    assert prefix_edges(spark, [ended(6) for _ in range(40)]) == 39


def test_shared_at_least_is_a_lower_bound(spark):
    rng, rows = random.Random(9), []
    length = lambda m: m - (80 * m + 99) // 100 + max(1, m // jaccard.DEPTH)
    for _ in range(400):
        a = set(rng.sample(range(1000), rng.choice([1, 2, 3, 7, 19, 20, 39, 40, 41, 100, 260])))
        b = set(sorted(a, key=lambda x: rng.random())[: rng.randint(-(-len(a) * 8 // 10), len(a))]) | set(rng.sample(range(1000, 2000), rng.randint(0, len(a) // 8)))
        if 100 * len(a & b) >= 80 * len(a | b):
            order = rng.sample(range(2000), 2000)  # any order will do
            head = lambda s: set(sorted(s, key=lambda x: order[x])[: length(len(s))])  # noqa: E731, B023
            rows.append((len(a), len(b), len(head(a) & head(b))))
    got = spark.createDataFrame(rows, "a long, b long, n long").withColumn("t", jaccard.shared_at_least(F.col("a"), F.col("b"), 80))
    assert len(rows) > 100 and got.where("n < t").count() == 0 and got.where("n = t").count() > 0


def test_joined_sets_are_compared_with_the_others_only():
    import numpy as np

    s = [np.arange(10, dtype=np.uint64), np.arange(9, dtype=np.uint64), np.arange(8, dtype=np.uint64), np.arange(100, 110, dtype=np.uint64)]
    assert jaccard.linked_in_tile(np.arange(4), s, 80, np.array([True, True, False, False])) == [(1, 2)]
    assert jaccard.linked_in_tile(np.arange(4), s, 80, np.array([True] * 4)) == []


def test_near_duplicates_odd_rows(spark, empty):
    assert jaccard.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f", None, None, 0), (4, "a b c d e f", None, None, 0), (4, "a b c d e f", None, None, 0), (9, "A b c d e f", None, None, 0)], SCHEMA)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in jaccard.near_duplicates(df).collect()) == [("4", "4"), ("4", "4"), ("9", "4"), ("None", "None")]


def test_linked_in_tile_keeps_every_connection():
    import numpy as np

    rng = np.random.default_rng(2)
    base = np.unique(rng.integers(0, 2**63, 60, dtype=np.uint64))
    sets = []
    for i in range(40):
        s = base.copy()
        s[: i % 12] = rng.integers(0, 2**63, i % 12, dtype=np.uint64)
        sets.append(np.unique(s))
    links = jaccard.linked_in_tile(np.arange(40), sets, 80)
    def comps(pairs):
        root = list(range(40))
        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(40)]
    every = [(a, b) for a in range(40) for b in range(a) if 180 * len(np.intersect1d(sets[a], sets[b])) >= 80 * (len(sets[a]) + len(sets[b]))]
    assert comps(links) == comps(every) and len(links) < 40


def brute_tree(text):
    return [[[hashlib.sha256(x.encode()).hexdigest() for x in re.findall(merkle.LEAF, p)] for p in s.split("\n")] for s in text.split("\n\n")]


def brute_first_edit(a, b):
    if a == b:
        return None
    at = []
    for empty in ([["-"]], ["-"], "-"):
        i = next(i for i in range(max(len(a), len(b))) if a[i : i + 1] != b[i : i + 1])
        a, b = (x[i] if i < len(x) else empty for x in (a, b))
        at.append(i)
        if empty == ["-"] and a == b:
            break
    return ".".join(map(str, at))


def test_merkle(docs, rows, empty):
    got = by_id(merkle.fingerprints(docs))
    texts = [t or "" for _, t, *_ in rows]
    flat = lambda tree: {x[:12] for s in tree for p in s for x in p}
    for i, text in enumerate(texts):
        nxt = texts[(i + 1) % len(texts)]
        edited = text[: len(text) - len(text) // 2] + nxt[: len(text) // 2]
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint == r.edited_fingerprint) == (text == edited)
        a, b, c = map(brute_tree, (text, edited, nxt))
        for near, other in ((r.near_edited, b), (r.near_next, c)):
            x, y = flat(a), flat(other)
            assert near == (2 * len(x & y) / (len(x) + len(y)) if x or y else 1.0)
        assert r.first_edit == brute_first_edit(a, b), (text[:50], edited[:50])
    same = defaultdict(set)
    for i, t in enumerate(texts):
        same[t].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in same.values()) and len({got[i].fingerprint for i in got}) == len(same)
    assert merkle.fingerprints(empty).count() == 0
    assert merkle.fingerprints(docs.where("doc_id = 1")).first().near_next == 1.0


def test_merkle_shares_leaves_within_long_sentences(spark):
    text = " ".join(passage(random.Random(5), 3000)) + "!!"
    df = spark.createDataFrame([(0, text, None, None, 0), (1, "other " * 3000, None, None, 0)], SCHEMA)
    r = by_id(merkle.fingerprints(df))[0]
    assert 0.3 < r.near_edited < 1 and r.near_next == 0.0 and r.first_edit.startswith("0.0.")


def test_merkle_and_shards_with_repeated_and_null_ids(spark):
    rows = [(None, "x y", None, None, 0)] * 2 + [(3, f"text {i}", None, None, 0) for i in range(200)] + [(3, "text 1", None, None, 0), (9, None, None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = merkle.fingerprints(df).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 2
    order = sorted(((r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode())), r[1] or "") for r in rows)
    want = Counter()
    for i, (_, t) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1]
        want[hashlib.sha256((t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]).encode()).hexdigest()] += 1
    assert Counter(r.edited_sha256 for r in got) == want
    placed = shards.byte_shards(df, 4).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in placed) == Counter((r[0], zlib.crc32((r[1] or "").encode())) for r in rows)
    assert [(r.doc_id is not None, r.doc_id or 0, r.text_crc32) for r in sorted(placed, key=lambda r: (r.shard, r.slot))] == [k for k, _ in order]


def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    live = [r for r in rows if r[1] and re.search(r"[^\W\d_]", r[1])]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.saved(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        if name == "exact_dedup":
            groups = defaultdict(list)
            for r in live:
                groups[re.sub(r"[\x20\x09-\x0D]", "", r[1])].append((-len(r[1]), r[0], r))
            live = [min(g)[2] for g in groups.values()]
        elif name == "ngram_jaccard":
            comp = brute_components(live)
            live = [r for r in live if comp[r[0]][1] == r[0]]
        elif name == "substring_dedup":
            cut = brute_removed(live)
            live = [(r[0], " ".join(cut[r[0]][2]) if cut[r[0]][1] else r[1], *r[2:]) for r in live]
        assert {r.doc_id: r.text for r in docs.collect()} == {r[0]: r[1] for r in live}, name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {r[0] for r in live}


def test_pipeline_on_empty_and_letterless_tables(spark, tmp_path):
    import corpus_pipeline

    for name, some in (("none", []), ("und", [(1, "12 34", None, "s", 5), (2, None, "en", "s", 0), (3, "", "de", "s", 0)])):
        spark.createDataFrame(some, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{name}")
        assert out.count() == 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


def brute_repair(rows):
    """conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, hash), with every row's whole audit strings compared."""
    ink = re.compile(r"[^\x20\x09-\x0D]")
    convs = defaultdict(list)
    for c, t, r, x in rows:
        body = convs[c]
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        body += [] if k == 0 else [(t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    after, out = {"": "su", "s": "u", "u": "a", "a": "u"}, {}
    for c, body in convs.items():
        body.sort(key=lambda z: (z[0] is not None, z[0] or 0, z[1].encode(), hashlib.sha256(z[2].encode()).digest()))
        seen, fault = set(), []
        for _, r, x in body:
            found = ink.findall(x)
            fault.append("b" if not found else "d" if (r, x) in seen else "t" if found[-1] not in ".!?" else "n")
            seen.add((r, x))
        first = [r[:1] for _, r, _ in body]
        turns = [t for t, _, _ in body if t is not None]
        best = {}
        for i in range(len(body), -1, -1):
            now = {p: [(0, "", ())] if i == len(body) and p in ("", "a") else [] for p in after}
            for p in after if i < len(body) else ():
                ways = [(4, "D", p, ())]
                if fault[i] in "nt":
                    cut = 3 * (fault[i] == "t")
                    ways += [(cut, "K", first[i], (f"{body[i][1]}:{body[i][2]}",))] if first[i] and first[i] in after[p] else []
                    ways += [(3 + cut, "R", r[0], (f"{r}:{body[i][2]}",)) for r in ("user", "assistant") if r[0] in after[p]]
                now[p] = [(w[0] + z[0], w[1] + z[1], w[3] + z[2]) for w in ways for z in best[i + 1, w[2]][:1]]
            for _ in range(4):
                for p in after:
                    now[p] = sorted(now[p] + [(3 + z[0], "I" + z[1], (f"{r}:",) + z[2]) for r in ("user", "assistant") if r[0] in after[p] for z in now[r[0]][:1]], key=lambda z: z[:2])[:1]
            best |= {(i, p): z for p, z in now.items()}
        cost, audit, done = best[0, ""][0]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
        out[c] = (gaps, *map(fault.count, "bdt"), illegal, cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())
    return out


def test_conversation_repair(spark):
    rng = random.Random(1)
    rows = []
    for c in [*range(120), None]:
        for _ in range(rng.choice([1, 2, 5, 9, 30])):
            rows.append((c, rng.choice([None, 0, 1, 2, 3, 7, 9]), rng.choice(["user", "assistant", "system", "tool", None, "", "agent", "user", "assistant", "Ü"]), rng.choice([None, "", " \t", "Hi.", "Hi", "yes!", "a b?  ", "ok\n", "no.", "...", "É"])))
    rows += [rows[5]] * 4 + [(500, i, "user" if i % 2 else "assistant", f"turn {i // 3}.") for i in range(3000)]  # repeated rows, a long conversation
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows, schema).withColumn("digest", F.lit(1)).withColumn("copies", F.lit("x")).withColumn("place", F.lit(0))
    harm = conversations.damaged(df)
    got = {r[0]: tuple(r)[1:] for r in conversations.repair_report(harm).collect()}
    assert got == brute_repair(rows)
    # the operator's own output: whole repaired rows
    found = conversations.structure(harm)
    fixed = [r for r in conversations.repaired(harm, found).collect() if r.conv_id == 7 and r.place]
    assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in sorted(fixed, key=lambda r: r.place)).encode()).hexdigest() == got[7][-1]
    assert all(re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in sorted(fixed, key=lambda r: r.place))) for _ in [0])
    assert conversations.repair_report(conversations.damaged(spark.createDataFrame([], schema))).count() == 0
    text_ids = spark.createDataFrame([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Yes.")], "conv_id string, turn long, role string, text string")
    assert {(r.conv_id, r.audit) for r in conversations.repair_report(conversations.damaged(text_ids)).collect()} == {("a", brute_repair([("a", 0, "user", "Hi."), ("a", 1, "assistant", "Yes.")])["a"][6])}


def test_automaton_nodes_are_shared():
    node = conversations.grown(conversations.LETTERS["u", "n"], conversations._END)
    assert node[0] == (3, "K", 2) and node[2][0] == 3  # a lone user row: kept, then an assistant row inserted at the end


def test_suffix_array_and_common_prefixes():
    rng = random.Random(2)
    for text in (b"banana\xff", b"a" * 700, bytes(rng.choice(b"ab") for _ in range(900)), b"\0" * 9 + b"\xff", b"x", b"ab\0\0ab\0"):
        data = suffixes.np.frombuffer(text, suffixes.np.uint8)
        order = suffixes.suffix_array(data)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        before, shared = suffixes.common_prefixes(data, order)
        for x, y in zip(order.tolist(), order.tolist()[1:]):
            k = 0
            while k < min(len(text) - x, len(text) - y) and text[x + k] == text[y + k]:
                k += 1
            assert before[y] == x and shared[y] == k


def brute_bytes(rows, size):
    times = Counter()
    for _, t in rows:
        d = (t or "").encode()
        times.update(d[i : i + size] for i in range(len(d) - size + 1))
    out = Counter()
    for i, t in rows:
        d = (t or "").encode()
        gone = bytearray(len(d))
        for j in range(len(d) - size + 1):
            if times[d[j : j + size]] > 1:
                gone[j : j + size] = b"\1" * size
        runs = sum(g and (j == 0 or not gone[j - 1]) for j, g in enumerate(gone))
        out[i, len(d), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest()] += 1
    return out


@pytest.mark.parametrize(("size", "shard"), [(400, 1 << 21), (400, 4000), (64, 3000)])
def test_suffix_dedup(spark, size, shard):
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(n))
    p, q, rows = text(150), text(400), []
    for i in range(40):
        t = text(rng.choice([2, 100, 200]))
        t = t + p + text(20) if i % 3 == 0 else t
        t = text(30) + q[rng.randint(0, 200) :] + t if i % 5 == 0 else t
        rows.append((i, t + t[: len(t) // 2] if i % 7 == 0 else t))
    rows += [(70, None), (71, ""), (72, "a" * 3000), (73, "ab" * 900), (74, "a" * 399), (75, rows[3][1]), (75, rows[3][1]), (None, p), (None, p[1:]), (76, "x" * 10 + "a" * 401 + "yy" * 10), (77, q), (78, q)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumn("uid", F.lit(1)).withColumn("spans", F.lit("x")).withColumn("key", F.lit(None).cast("string"))
    assert Counter(tuple(r) for r in suffixes.removed_bytes(df, size, shard).collect()) == brute_bytes(rows, size)


def test_suffix_dedup_of_a_text_of_several_blocks(spark, empty):
    rng = random.Random(6)
    long = "".join(rng.choice("abcdefgh ") for _ in range(2_300_000))
    rows = [(0, long), (1, long[1_048_300:1_049_300]), (2, long[100:450]), (3, "z" * 10 + long[-500:])]
    got = {r.doc_id: r for r in suffixes.removed_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[0].n_removed, got[0].n_spans, got[1].n_removed, got[2].n_removed, got[3].n_removed) == (1500, 2, 1000, 0, 500)
    assert got[0].kept_sha256 == hashlib.sha256((long[:1_048_300] + long[1_049_300:-500]).encode()).hexdigest()
    assert suffixes.removed_bytes(empty).count() == 0


def test_filter_audit(spark, empty):
    rng = random.Random(8)
    texts = [None, "", "a b", "A B C", "x#y", " ".join(f"w{i}" for i in range(120)), "w " * 150, "W " * 150 + "&", "A" * 30]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""]), "s", 0) for i in range(150)] + [(200, "dup", "en", "s", 0)] * 3 + [(201, "dup", "en", "s", 0), (None, "dup", "de", "s", 0), (None, "dup", "de", "s", 0)]
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(2, 1, 0), (201, 1, 1), (None, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    df = spark.createDataFrame(rows, SCHEMA).withColumn("mask", F.lit("x")).withColumn("good", F.lit(9))
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *m in marks if m[k] == 1 and i is not None} for k in (0, 1))
    want = {}
    fails = []
    for i, t, lang, *_ in rows:
        t = t or ""
        w = WS.findall(t)
        bad = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and i > least.get(t, i)}
        fails.append((lang or "", {c for c, b in bad.items() if b}, i in good, i in toxic))
    total = Counter()
    for part in {f[0] for f in fails}:
        mine = [f for f in fails if f[0] == part]
        for order in interactions.ORDERS:
            for step, c in enumerate(order):
                before = set(order[:step])
                here = [f for f in mine if c in f[1] and not f[1] & before]
                want[part, order, step + 1] = [sum(not f[1] & (before | {c}) for f in mine), len(here), sum(c in f[1] and bool(f[1] & before) for f in mine), sum(f[1] == {c} for f in mine), sum(f[2] for f in here), sum(f[3] for f in here)]
                total[part, c] += len(here)
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in interactions.filter_audit(df, labels).collect()}
    assert got == {k: [*v, total[k[0], k[1][k[2] - 1]]] for k, v in want.items()} and len(got) == 3 * 600
    assert interactions.filter_audit(empty, labels).count() == 0 and interactions.filter_audit(df, labels.limit(0)).count() == 1800


def test_packing_encodes_small_groups_and_keeps_few_chunks(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(packing.bpe, "ChunkEncoder", lambda many, special, limit=400_000: seen.setdefault("limit", limit) and None)
    docs = type("Docs", (), {"schema": spark.range(1).select(F.col("id").alias("doc_id")).schema, "select": lambda self, *a: self, "mapInArrow": lambda self, f, t: f})()
    list(packing.token_pieces(docs, queries.RANKS, queries.VOCABULARY)(iter([])))
    assert packing.SLICE_BYTES <= 1 << 20 and seen["limit"] <= 100_000
