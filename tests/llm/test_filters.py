"""Quality rules, licence scan, decontamination and URL filter."""

import itertools
import random

import duckdb
import pandas as pd

from fieldstate.llm import decontaminate, licences, quality, urls

from .data import documents, frame, prose


def with_sql(sql, **tables):
    con = duckdb.connect()
    for name, (rows, columns) in tables.items():
        con.register(name, pd.DataFrame(rows, columns=columns))
    return sorted(con.execute(sql).fetchall(), key=repr)


def test_quality_counts_match_sql(spark):
    rng = random.Random(8)
    docs = documents(7) + [
        (2000, " ".join(prose(rng, 60)) + "\nsame line here\nother\nsame line here\n \n \n"),
        (2001, "the of and " * 40), (2002, "# * $ % & | < > " * 20), (2003, "WOW!! " * 60), (2004, "\x0b\x0c a\x0bb\x0cc\r\nd"), (None, "f f f f"), (2001, None),
    ]
    got = quality.digest(frame(spark, docs))
    want = with_sql(quality.sql(), documents=(docs, ["doc_id", "text"]))
    rows = sorted(((None if r[0] is None else float(r[0]), *r[1:]) for r in map(tuple, got.collect())), key=repr)
    assert rows == sorted(((None if r[0] is None or r[0] != r[0] else float(r[0]), *r[1:]) for r in want), key=repr)


def test_quality_verdicts(spark):
    rng = random.Random(9)
    clean = " ".join(w + (" the" if k % 8 == 0 else " of the river" if k % 11 == 0 else "") for k, w in enumerate(prose(rng, 200, 5000)))
    docs = [(1, clean), (2, "too short"), (3, " | ".join(prose(rng, 200, 5000))), (4, " ".join(w + "!!" for w in clean.split())), (5, None), (6, "again and again " * 50)]
    out = quality.quality_rules(frame(spark, docs))
    assert out.columns == [*frame(spark, docs).columns, "quality"]
    got = {r.doc_id: (r.base_failed, r.kept) for r in out.select("doc_id", "quality.*").collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (False, False), 4: (False, False), 5: (True, False), 6: (True, False)}
    assert out.filter("quality.kept").count() == 1
    assert quality.quality_rules(frame(spark, [])).count() == 0


def test_quality_runs_without_python(spark):
    plan = quality.quality_rules(frame(spark, documents()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


LICENCED = [
    (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nMore text."),
    (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
     '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions: \nx\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of "
     "the Software. \n\n THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES "
     "OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."),
    (3, "The software is provided as is. The above copyright notice and this permission notice shall be included in all copies or substantial portions "
     "of the Software."),
    (4, "a license that nobody knows"), (5, None), (6, ""), (None, "Licensed under CC BY-NC 4.0. Licensed under CC BY-NC 4.0."),
    (7, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
     "a.\nb.\nc.\nd.\ne.\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
]


def test_licences_by_hand_and_sql(spark):
    got = sorted(map(tuple, licences.licence_matches(frame(spark, LICENCED)).collect()), key=repr)
    assert got == sorted([
        (1, "apache-named", "Apache-2.0", 1, 1), (2, "mit-text", "MIT", 0, 3),
        (None, "ccbync-named", "CC-BY-NC-4.0", 0, 0), (None, "ccbync-named", "CC-BY-NC-4.0", 1, 1)], key=repr)
    want = with_sql(licences.sql(), documents=([r for r in LICENCED if r[0]], ["doc_id", "text"]))
    assert [r for r in got if r[0]] == want
    assert licences.licence_matches(frame(spark, [])).count() == 0
    assert all(any(m in s for m in licences.MARKS) for s in licences.SENTENCES.values())


def test_contamination_tolerates_substitutions(spark):
    rng = random.Random(10)
    items = [(k, " ".join(prose(rng, 40, 100_000))) for k in range(5)] + [(5, None), (6, "too short an item"), (7, "")]
    words = [t.split() for _, t in items[:5]]
    changed = [w if k % 9 else "changed" for k, w in enumerate(words[1])]
    half = words[2][:22]
    far = [w if k % 3 else "changed" for k, w in enumerate(words[3])]
    filler = lambda n: prose(rng, n, 100_000)
    docs = [
        (0, " ".join(filler(30) + words[0] + filler(30))), (1, " ".join(filler(5) + changed)), (2, " ".join(half + filler(9))), (3, " ".join(far)),
        (4, " ".join(filler(300))), (5, None), (6, ""), (7, " ".join(words[0]).upper().replace(" ", ", ")), (7, " ".join(words[0])),
        (8, " ".join(words[4] + words[0])), (None, " ".join(words[4])), (9, "too short an item"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contaminations(frame(spark, docs), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(0, 0), (1, 1), (2, 2), (7, 0), (8, 4), (8, 0), (None, 4)} and len(got) == 7
    by = {(r.doc_id, r.item_id): r for r in got}
    assert by[0, 0].doc_start == 30 and by[0, 0].n_matched == 40 and by[1, 1].n_matched == 35
    kept = decontaminate.decontaminated(frame(spark, docs), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 9] and kept.columns == frame(spark, docs).columns
    assert decontaminate.contaminations(frame(spark, []), bench).count() == 0
    assert decontaminate.contaminations(frame(spark, docs), bench.limit(0)).count() == 0


def test_seeds_reach_every_accepted_pattern():
    assert all(m[0] == m[-1] == "1" for m in decontaminate.MASKS)
    for words in range(12, 21):
        free = [sum(1 << (at + i) for i, bit in enumerate(m) if bit == "1") for m in decontaminate.MASKS for at in range(words - len(m) + 1)]
        for places in itertools.combinations(range(words), words // 5):
            gone = sum(1 << p for p in places)
            assert any(not gone & f for f in free), (words, places)


def test_contamination_with_four_words_of_twenty_substituted(spark):
    rng = random.Random(14)
    lost = {20: (2, 6, 10, 14), 15: (3, 7, 11)}  # no clean place for masks of weight 8 over 12 words
    items = [(n, " ".join(prose(rng, n, 100_000))) for n in lost]
    docs = [(n, " ".join("changed" if k in lost[n] else w for k, w in enumerate(t.split()))) for n, t in items]
    got = decontaminate.contaminations(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id, r.n_matched) for r in got} == {(20, 20, 16), (15, 15, 12)}


def test_url_rules_and_parts(spark):
    pages = [
        (1, "https://WWW.Example.com/en/1?x#y"), (2, "http://a.example.com/en/1"), (3, "http://example.com/de/"), (4, "http://x.com"), (5, None), (6, "no url"),
        (7, "https://a.b.net/es/q?z"), (8, "https://net/fr/"), (9, "https://dotnet/es/1"), (10, "http://example.org?u=://b.com/en/"), (11, "x://h#://"), (11, "x://h/p"),
    ]
    labels = spark.createDataFrame([], "page_id long, bad long")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.url_verdicts(spark.createDataFrame(pages, "page_id long, url string"), labels).collect()}
    assert got == {
        (1, "www.example.com", "/en/1", "www.example.com/en/", "allow"), (2, "a.example.com", "/en/1", "example.com/en/", "block"),
        (3, "example.com", "/de/", "com/", "allow"), (4, "x.com", "", None, "allow"), (5, "", "", None, "allow"), (6, "", "", None, "allow"),
        (7, "a.b.net", "/es/q", "net/es/", "block"), (8, "net", "/fr/", "net/fr/", "block"), (9, "dotnet", "/es/1", None, "allow"),
        (10, "example.org", "", None, "allow"), (11, "h", "", None, "allow"), (11, "h", "/p", None, "allow"),
    }
    assert urls.url_verdicts(spark.createDataFrame([], "page_id long, url string"), labels).count() == 0


def test_url_templates_and_purity(spark):
    pages, labels = [], []
    for k in range(200):  # one branch full of bad pages, one clean, ids as variable segments
        pages.append((k, f"http://host.org/{'spam' if k % 2 else 'news'}/{k}/view"))
        if k % 3 == 0:
            labels.append((k, k % 2))
    pages += [(1000 + k, f"http://other.org/{'a' if k % 2 else 'b'}/{k}") for k in range(100)]
    labels += [(1000 + k, int(k % 9 == 0)) for k in range(100)]
    out = urls.url_verdicts(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad long"), rules=())
    got = {(r.template, r.verdict) for r in out.collect()}
    assert got == {("/spam/*/view", "block"), ("/news/*/view", "allow"), ("/a/*", "allow"), ("/b/*", "allow")}
    # a and b do not differ significantly, so both stand on their host's counts
    assert {(r.labelled, r.bad) for r in out.filter("host = 'other.org'").select("labelled", "bad").collect()} == {(100, 12.0)}


def test_bad_section_stays_apart_whatever_the_number_of_siblings(spark):
    for sections in (8, 40):
        pages = [(1000 * s + k, f"http://host.org/{'casino' if s == 3 else f'part{s}'}/{k}") for s in range(sections) for k in range(30)]
        labels = [(i, int(i // 1000 == 3)) for i, _ in pages if i % 2]
        out = urls.url_verdicts(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad long"), rules=())
        assert {r.page_id for r in out.filter("verdict = 'block'").collect()} == {i for i, _ in pages if i // 1000 == 3}, sections
        if sections > urls.CHILDREN:  # sections like each other still share a template, and so do single pages
            assert {r.template for r in out.collect()} == {"/casino/*", "/*/*"}


def test_deep_branches_stay_apart(spark):
    pages = [(1000 * d + k, f"http://host.org/a/b/c/d/e/f/g/h/{'spam' if d else 'news'}/{k}/view") for d in range(2) for k in range(40)]
    pages += [(5000, "http://host.org/a/b" + "/x" * 300)]  # one long path needs no rounds of its own
    labels = [(i, int(i // 1000 == 1)) for i, _ in pages if i % 2]
    out = urls.url_verdicts(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad long"), rules=()).collect()
    assert len(out) == len(pages) and {r.page_id for r in out if r.verdict == "block"} == {1000 + k for k in range(40)}
    assert {r.template for r in out} == {"/a/b/c/d/e/f/g/h/spam/*/view", "/a/b/c/d/e/f/g/h/news/*/view", "/a/b" + "/x" * 300}
