"""Periodic runs, license scans and lexical search against brute-force versions, on odd rows and on generated ones."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from movewise.llm import lexical, licenses, queries, runs
from movewise.llm.terms import terms

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LOWEST, HIGHEST = -(2**63), 2**63 - 1
#: Clashing names on purpose: the operators use such names inside.
SCHEMA = "doc_id long, text string, n long, terms string, score int, start int, rank int, item_id int, labels int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3, 4, 5, 6) for i, t in rows], SCHEMA).repartition(parts)


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdeéßX") for _ in range(rng.randint(1, 5))) for _ in range(120)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(k, text(rng.randint(1, 150))) for k in range(60)]
    for k in range(60, 90):  # runs of several periods, next to each other and inside each other
        unit = text(rng.randint(1, 9)).split()
        inner = (unit * 5 + text(2).split()) * rng.randint(3, 4)
        rows.append((k, " ".join(text(5).split() + inner + unit * rng.randint(3, 12) + text(3).split())))
    rows += [(100, None), (101, ""), (102, " \t\n "), (103, "one"), (104, "a " * 50), (105, "\x0b".join(["a", "b"] * 12)), (106, rows[70][1]), (106, rows[70][1]), (107, text(12000)), (108, "la " * 9000 + text(4)), (109, "x" * 60000)]
    rows += [(None, rows[61][1]), (None, None), (LOWEST, rows[62][1]), (HIGHEST, rows[63][1]), (-1, rows[64][1])]
    rng.shuffle(rows)
    return rows


ROWS = corpus()


# Runs.


def brute_runs(words, least=24, times=3):
    found = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q - i), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def test_runs_by_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        least, times = rng.choice([(24, 3), (6, 2), (2, 2), (9, 3), (10, 4), (4, 3)])
        n, k = rng.randint(0, 110), rng.choice([1, 2, 3, 8])
        ids = [rng.randrange(k) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            p = 1 + (n - a) // rng.randint(2, 9)
            ids = [ids[i] if i < a else ids[a + (i - a) % p] for i in range(n)]
        want = brute_runs(ids, least, times)
        assert runs.runs(ids, least, times) == want
        size = runs.gram(least, times)
        seen = collections.Counter(tuple(ids[i : i + size]) for i in range(n - size + 1))
        again = np.array([seen[tuple(ids[i : i + size])] > 1 for i in range(n - size + 1)], bool)
        assert runs.runs(ids, least, times, again) == want


def test_words_that_stay():
    tokens = [b"%d" % i for i in range(40)]
    assert runs.collapsed(tokens, []) == tokens
    assert runs.collapsed(tokens, [(2, 30, 4), (0, 12, 1)]) == [tokens[0], *tokens[32:]]


def brute_report(doc, text, plant):
    words = WORD.findall(text or "")
    n = len(words)
    if plant and doc is not None and n:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = brute_runs(words) if len(words) < 2000 else None
    if found is None:  # too long for plain search: the vectors' way of finding periods, one by one
        ids = np.unique(np.array(words), return_inverse=True)[1]
        seen = {}
        for q in range(1, n // 3 + 1):
            same = np.flatnonzero(np.diff(np.r_[0, (ids[q:] == ids[:-q]).astype(np.int8), 0]))
            for i, j in same.reshape(-1, 2).tolist():
                if j + q - i >= max(24, 3 * q):
                    seen.setdefault((i, j + q - i), q)
        found = sorted((s, m, q) for (s, m), q in seen.items())
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    top = min(found, key=lambda r: (-(r[1] * 10**9 // r[2]), r[0], r[2])) if found else None
    best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc, len(found), *best, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("plant", [True, False])
def test_run_report(spark, plant):
    got = [tuple(r) for r in runs.run_report(table(spark, ROWS), rewrite=runs.planted if plant else None).collect()]
    want = [brute_report(i, t, plant) for i, t in ROWS]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] for r in got) > 60


def test_runs_are_collapsed(spark):
    before = table(spark, ROWS)
    after = runs.collapse_runs(before)
    assert after.schema == before.schema
    want = []
    for i, t in ROWS:
        words = WORD.findall(t or "")
        gone = {k for s, n, q in runs.runs(words) for k in range(s + q, s + n)}
        want.append((i, " ".join(w for k, w in enumerate(words) if k not in gone) if gone else t))
    assert sorted(((r["doc_id"], r["text"]) for r in after.collect()), key=str) == sorted(want, key=str)
    spans = runs.run_spans(before).where("doc_id = 104").collect()
    assert [tuple(r) for r in spans] == [(104, 0, 50, 1, "a")]


def test_planted_runs_of_the_query(spark):
    out = queries.op11_periodic_runs(spark, "/root/testdata/sf0.001")
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(tuple(r) for r in out.collect()) == sorted(brute_report(i, t, True) for i, t in text.items())


# Licences.


def brute_scan(text):
    words = TERM.findall((text or "").translate(LOWER))
    hits = [(i, label) for phrase, label in {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    rules = licenses.parse_rules(licenses.RULES)
    joined = " ".join(words).encode()
    found = []
    for rule in rules:  # every rule, without keywords
        for m in rule.expression.finditer(joined):
            start = len(joined[: m.start()].split())
            found.append(licenses.Detection(start, start + len(m.group().split()), rule))
    stay = brute_suppressed(found)
    labels = {x for _, x in hits} | {d.rule.label for d in stay}
    at = [i for i, _ in hits]
    score = max([d.rule.score for d in stay] + [0.5] * bool(hits), default=0.0)
    return len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})), ",".join(sorted(labels)), score


def brute_suppressed(found):
    stay = []
    for d in sorted(found, key=lambda d: (-d.rule.priority, d.start - d.end, d.rule.number, d.start)):
        if not any(x.start <= d.start and d.end <= x.end for x in stay):
            stay.append(d)
    return stay


LICENSED = [
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0. cc by, CC-BY cc by by", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "GNU Lesser General Public License v2.1 or later",
    "SPDX-License-Identifier: Apache-2.0\nApache  License", "amit license; MIT\x00License; mit licenses", "é cc by é", "mit license" * 3, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "Confidential and proprietary. All rights reserved. Released into the public domain? This is dedicated to the public domain", "GPLv3, GPL-2.0, LGPL 2.1, AGPLv3, CC0 1.0 Universal, Creative Commons Attribution-ShareAlike 4.0 International", "Neither the name of the University nor the names of its contributors may be used to endorse or promote products",
]


def test_license_report(spark):
    rng = random.Random(4)
    words = " ".join(licenses.RULES.replace("; ", " ").replace("(?:", " ").replace(")", " ").split()).split()
    noise = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(40)]
    glued = [". ".join(rng.sample(LICENSED, 3)).upper() for _ in range(20)]
    rows = [(k, t) for k, t in enumerate([*LICENSED, *noise, *glued])] + [(900, "plain text " * 3000 + LICENSED[3] + " x" * 70000)] + ROWS
    got = [tuple(r) for r in licenses.license_report(table(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(i, *brute_scan(t)) for i, t in rows], key=str)


def test_each_rule_asks_for_its_keywords():
    rules = licenses.parse_rules(licenses.RULES)
    assert len(rules) > 300
    scanner = licenses.Scanner(rules)
    for rule in rules:  # a text made of the expression's own words
        plain = re.sub(rb"\(\?<!\\S\)\(\?:|\)\(\?!\\S\)$", b"", rule.expression.pattern)
        while (less := re.sub(rb"\(\?!([^()]*)\)", b"", re.sub(rb"\(\?:([^()|]*)(?:\|[^()]*)?\)(\{\d+,\d+\}|\?)?", rb"\1", plain))) != plain:
            plain = less
        sample = plain.replace(b" ?", b" ").replace(b"licen[cs]e", b"license").replace(b"\\d\\d", b"20").replace(b"\\S+", b"term").replace(b"v ?", b"v ").replace(b"?", b"").replace(b"+", b"")
        match = rule.expression.search(sample)
        if match:
            assert rule in scanner.candidates(set(sample.split())), (rule.label, sample)


def test_suppression_by_brute_force():
    rules = licenses.parse_rules(licenses.RULES)
    rng = random.Random(6)
    for _ in range(800):
        found = [licenses.Detection(a := rng.randrange(12), a + rng.randint(1, 8), rng.choice(rules)) for _ in range(rng.randint(0, 9))]
        assert licenses.suppressed(found) == sorted(brute_suppressed(found), key=lambda d: (d.start, d.end, d.rule.number))


def test_license_spans(spark):
    got = licenses.license_spans(table(spark, [(1, "x " + LICENSED[0]), (2, None)])).collect()
    assert [(r["doc_id"], r["label"], r["first_word"], r["last_word"]) for r in got] == [(1, "gpl-3.0", 4, 12)]


# Search.


def test_terms():
    for text in ["Ab-c_d 9é\x00Ü\x7f{x}`y`", "", "ﬀ İ ΑΣ", "\x1c\x85a"]:
        assert [t.decode() for t in terms(text.encode())] == TERM.findall(text.translate(LOWER))


def duck(rows, items):
    c = duckdb.connect()
    c.execute("create table documents (doc_id bigint, text varchar)")
    c.execute("create table benchmark (item_id bigint, text varchar)")
    for name, data in (("documents", rows), ("benchmark", items)):
        if data:
            c.executemany(f"insert into {name} values (?, ?)", data)
    return c.execute(queries.ORACLE["op13_lexical_search"]).fetchall()


def searched(spark, rows, items, **options):
    found = lexical.rank(table(spark, rows, options.pop("parts", 3)), spark.createDataFrame(items, "item_id long, text string"), **options)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


ITEMS = [(1, ROWS[3][1]), (2, "a a b É ß"), (3, None), (4, ""), (5, "nowhere-to-be-found"), (6, " ".join((ROWS[9][1] or "x").split()[:4])), (6, "a one"), (None, "one two"), (HIGHEST, "xab la")]


def test_search_matches_sql(spark, monkeypatch):
    assert searched(spark, ROWS, ITEMS) == sorted(duck(ROWS, ITEMS), key=str)
    ties = [(k, "same words here") for k in range(40)] + [(None, "same words here")] * 3 + [(7, "same words here")] * 2 + [(LOWEST, "Same Words Here")]
    assert searched(spark, ties, [(1, "words"), (2, "here words")], parts=5) == sorted(duck(ties, [(1, "words"), (2, "here words")]), key=str)
    few = [(1, "a b"), (None, "a c"), (2, None)]
    assert searched(spark, few, [(1, "a b c")]) == sorted(duck(few, [(1, "a b c")]), key=str)


def test_items_in_blocks(spark):
    assert searched(spark, ROWS, ITEMS, block=5) == searched(spark, ROWS, ITEMS)


def test_empty_search(spark):
    assert searched(spark, [], ITEMS) == searched(spark, ROWS, []) == searched(spark, [(1, None), (2, "-")], ITEMS) == []


def test_maxscore_gives_the_best_of_all_documents():
    rng = np.random.default_rng(5)
    for _ in range(40):
        held, plain = lexical.Best(7), []
        weight = rng.integers(0, 3000, 50)
        wanted = rng.choice(50, 12, replace=False).tolist()
        for first in range(0, 400, 80):
            lengths = rng.integers(0, 20, 80)
            found = np.concatenate([rng.choice(50, k, replace=False, p=None) for k in lengths] or [[]]).astype(np.int64)
            freq, n = rng.integers(1, 4, len(found)), lengths * 3 + 1
            shard = lexical.Shard.of(n, lengths, found, freq, weight, 400, 9000)
            at, score = shard.candidates(wanted, held.least)
            held.add(score, np.zeros(len(at), bool), at + first)
            doc = np.repeat(np.arange(80), lengths)
            for d in range(80):
                total = sum(int(weight[t]) * (10**9 * int(f) // (1000 * int(f) + 8 * (10 + 90 * int(n[d]) * 400 // 9000))) for t, f in zip(found[doc == d], freq[doc == d], strict=True) if t in wanted)
                if total:
                    plain.append((-total, d + first))
        assert list(zip((-held.score).tolist(), held.doc.tolist(), strict=True)) == sorted(plain)[:7]


def test_long_documents_do_not_overflow():
    n = np.array([1, 10**8], np.int64)
    assert lexical.length_norm(n, 10**10, 10**13).tolist() == [10 + 90 * 10**10 // 10**13, 10 + 90 * 10**18 // 10**13]


def test_results_do_not_depend_on_partitions(spark):
    for op in (lambda d: runs.run_report(d, rewrite=runs.planted), licenses.license_report):
        one, many = (sorted((tuple(r) for r in op(table(spark, ROWS, k)).collect()), key=str) for k in (1, 9))
        assert one == many
    assert searched(spark, ROWS, ITEMS, parts=1) == searched(spark, ROWS, ITEMS, parts=9)


def test_empty_tables(spark):
    none = table(spark, [])
    assert runs.run_report(none).count() == licenses.license_report(none).count() == runs.run_spans(none).count() == licenses.license_spans(none).count() == runs.collapse_runs(none).count() == 0
    assert runs.run_report(table(spark, [(1, None)])).select("n_runs", F.col("start").isNull()).first() == (0, True)
