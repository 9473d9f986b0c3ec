import random
import re
import time

from cases import documents, odd_texts, prose
from pyspark.sql import functions as F
from rosterkit.llm.license_rules import HINT, NAME, NOTICE, TEXT, Rule, all_rules
from rosterkit.llm.license_scan import labels_of, scan_licenses

RULES = all_rules()
LICENSE_TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "All rights reserved.",
    "Released under the MIT License.", "SPDX-License-Identifier: GPL-2.0-or-later", "Copyright (c) 2021 Someone. All Rights Reserved.",
    "GNU Lesser General Public License v2.1 or later", "https://creativecommons.org/licenses/by-sa/3.0/", "cc by cc by cc-by 4.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "in the public domain", "distributed under the terms of the Mozilla Public License 2.0 or the EUPL v1.2", "licensed by the licence",
    "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential", "GPLv3", "éGPLv3 cc byé",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "general public license all rights reserved cc by",
    "provided as is, without warranty of any kind", "do what the f you want to public license", "no part of this book may be copied",
]


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def brute_force(text, rules=RULES):
    """All rules on all texts, all detections compared with all."""
    words = words_of(text)
    spaced = " " + "  ".join(words) + " " if words else "  "
    found = []
    for number, rule in enumerate(rules):
        for m in re.finditer(rule.expression, spaced):
            before = len(spaced[:m.start()].split())
            found.append((before, before + len(m[0].split()), rule.priority, number))

    def covers(c, d):
        return c != d and c[2] <= d[2] and c[0] <= d[0] and c[1] >= d[1] and (c[:2] != d[:2] or (c[2], c[3]) < (d[2], d[3]))

    standing = [d for d in found if rules[d[3]].base or not any(covers(c, d) for c in found)]
    return len(words), sorted((s, e, rules[n].label, p, n) for s, e, p, n in standing)


def check(spark, texts, rules=None):
    rows = scan_licenses(documents(spark, texts).repartition(3), rules).collect()
    assert all(r.row.lang == "en" and r.row.component_id == 1 for r in rows)
    rows.sort(key=lambda r: r.row.doc_id)
    got = [(r.n_words, sorted((s.start, s.end, s.label, s.priority, s.number) for s in r.spans)) for r in rows]
    assert got == [brute_force(t, rules or RULES) for t in texts]
    return rows


def test_license_texts_and_odd_texts_match_brute_force(spark):
    rng = random.Random(4)
    mixed = [" ".join(rng.choice([prose(i * 50 + j, 3), rng.choice(LICENSE_TEXTS), rng.choice(LICENSE_TEXTS)[:40]]) for j in range(rng.randrange(1, 9)))
             for i in range(150)]
    rows = check(spark, odd_texts() + LICENSE_TEXTS + mixed)
    named = {t: {s.label for s in r.spans} for t, r in zip(odd_texts() + LICENSE_TEXTS + mixed, rows)}
    assert named[LICENSE_TEXTS[0]] == {"apache-2.0"}
    assert named[LICENSE_TEXTS[1]] == {"gpl", "gpl-3.0"}
    assert named[LICENSE_TEXTS[2]] == {"cc-by", "cc-by-nc-4.0"}
    assert named["GPLv3"] == {"gpl-3.0"} and named["éGPLv3 cc byé"] == set()
    assert "gpl-2.0-or-later" in named[LICENSE_TEXTS[5]] and "lgpl-2.1-or-later" in named[LICENSE_TEXTS[7]]


def test_priority_and_containment(spark):
    rules = [Rule("text", "a b c d", TEXT, 0.9), Rule("notice", "b c d e f", NOTICE, 0.8), Rule("name", "b c", NAME, 0.7), Rule("twin", "b c", NAME, 0.7),
             Rule("wide", "a b c d e f", HINT, 0.4), Rule("base", "c d", HINT, 0.5, True), Rule("tail", "e f g", NAME, 0.6)]
    rows = check(spark, ["a b c d e f g", "b c", "x b c d e f", "c d c d", "a b c d a b c d", None], rules)
    assert [[s.label for s in r.spans] for r in rows] == [
        ["wide", "text", "notice", "base", "tail"], ["name"], ["notice", "base"], ["base", "base"], ["text", "base", "text", "base"], []]


def test_rules_are_many_and_gated_by_words_they_need():
    assert len(RULES) >= 300 and all(r.keywords for r in RULES)
    assert [r.priority for r in RULES] == sorted(r.priority for r in RULES)
    for rule in RULES:
        for text in LICENSE_TEXTS:
            if re.search(rule.expression, " " + "  ".join(words_of(text)) + " "):
                assert set(rule.keywords) <= set(words_of(text))
    assert Rule("x", "(?:gnu )?gpl v(?:ersion)? 2(?: 0)? ends?", NAME, 1.0).keywords == ["gpl", "2"]


def test_repeated_rows_labels_and_empty_table(spark):
    rows = scan_licenses(documents(spark, ["GPLv3. All rights reserved"] * 3, [1, 1, None]))
    assert {r[0] for r in rows.select(labels_of(F.col("spans"))).collect()} == {"gpl-3.0,reserved"} and rows.count() == 3
    assert scan_licenses(documents(spark, [])).count() == 0


def test_time_grows_with_the_length_of_one_text(spark):
    took = []
    line = "some own words here GNU General Public License version 2 or later, all rights reserved. "
    for n in (10_000, 10_000, 20_000):
        start = time.perf_counter()
        row = scan_licenses(documents(spark, [line * n])).first()
        took.append(time.perf_counter() - start)
        assert sum(s.label == "reserved" for s in row.spans) == n == sum(s.label == "gpl-2.0-or-later" for s in row.spans)
    assert took[2] < 4 * took[1] + 1
