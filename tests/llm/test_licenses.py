from __future__ import annotations

import random
import re
import time
from re import _constants as C
from re import _parser

from conftest import SMALL
from pyspark.sql import functions as F

from pingworks.llm import license_rules, licenses
from pingworks.llm.license_rules import signatures

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _brute(text: str):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    at, labels = [], set()
    for label, phrase in licenses.PHRASES.items():
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def _check(rows, texts):
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == _brute(texts[r.doc_id] or ""), texts[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_base_columns_on_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = licenses.query(spark, SMALL).collect()
    assert len(rows) == len(texts)
    _check(rows, texts)


def test_edges(spark):
    texts = dict(enumerate([
        None, "", "MIT License", "mit--\nlicense, the Apache  license.", "summit license", "mit licensed", "mit. mit license mit license",
        "the GNU General\nPublic\tLicense x", "émit license", "mit license" + " x" * 5000 + " apache license", "İ MİT license",
    ]))
    rows = licenses.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    _check(rows, texts)


def test_containment_and_priority(spark):
    texts = [
        "Licensed under the Apache License, Version 2.0.", "GNU Lesser General Public License v2.1", "Licensed under CC BY-NC 4.0.", "SPDX-License-Identifier: MIT",
        "All rights reserved. Released under the MIT License.", "See the MPL.", "bsd 3-clause", "Mozilla Public License 2.0 and Mozilla Public License 1.1",
    ]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {
        0: "apache,apache-2.0", 1: "gpl,lgpl-2.1", 2: "cc-by-nc-4.0", 3: "mit", 4: "all-rights-reserved,mit", 5: "", 6: "bsd-3-clause", 7: "mpl-1.1,mpl-2.0",
    }


def test_there_are_hundreds_of_valid_rules_behind_the_gate():
    rules = licenses.rules()
    assert len(signatures()) > 200 and len(rules) > 300 and all(r.priority in range(1, licenses.PRIORITIES + 1) for r in rules)


def _samples(tree) -> list[str]:
    """The shortest texts of a pattern, one at least for each branch, blanks as \\r\\n and two blanks."""
    out = [""]
    for op, arg in tree:
        if op is C.LITERAL:
            more = [chr(arg)]
        elif op is C.IN:
            kind, x = next((i for i in arg if i[0] is C.CATEGORY), arg[0])
            more = ["\r\n" if x is C.CATEGORY_SPACE else "1" if x is C.CATEGORY_DIGIT else "w" if kind is C.CATEGORY or kind is C.NEGATE else chr(x if kind is C.LITERAL else x[0])]
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            inner = _samples(arg[2])
            more = ["  " if x == "\r\n" and arg[1] is C.MAXREPEAT and k else x * arg[0] for x in inner for k in range(2 if arg[0] else 1)]
        elif op is C.SUBPATTERN:
            more = _samples(arg[3])
        elif op is C.BRANCH:
            more = [x for b in arg[1] for x in _samples(b)]
        else:
            assert op in (C.ASSERT_NOT, C.AT, C.ANY, C.NOT_LITERAL), op
            more = ["" if op in (C.ASSERT_NOT, C.AT) else "w"]
        out = [a + b for a in out for b in dict.fromkeys(more)][:256]
    return out


def test_what_every_rule_matches_passes_the_gate():
    for r in licenses.rules():
        hits = [x for x in _samples(_parser.parse(r.pattern)) if re.search("(?i)" + r.pattern, x)]
        assert hits, r
        for x in hits:
            assert re.search(licenses.GATE, x) and any(k in x.lower() for k in r.keywords), (r.label, x)


def test_wrapped_commons_names_are_scanned(spark):
    texts = ["Creative\r\nCommons Attribution-ShareAlike 4.0", "Creative  Commons Attribution 4.0"]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {0: "cc-by-sa-4.0", 1: "cc-by-4.0"}


def test_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([(1, "MIT License", "mine")], "doc_id long, text string, other string")
    assert licenses.scan(df).first().other == "mine"
    assert licenses.scan(df.limit(0)).count() == 0


def test_each_signature_finds_its_example(spark):
    signs = license_rules.signatures()
    assert len({s[4] for s in signs}) == len(signs) > 150
    low = [s[5].lower() for s in signs]
    assert [s for s, x in zip(signs, low) if not any(k in x for k in s[3])] == []
    rows = [(i, s[5], licenses.Rule(s[0], s[4], s[3], s[1], s[2])) for i, s in enumerate(signs)]
    table = spark.createDataFrame([(i, x, "(?i)" + r.pattern) for i, x, r in rows], "doc_id long, text string, pattern string")
    missed = table.filter(~F.expr("text RLIKE pattern")).collect()
    assert [r.text for r in missed] == []
    ungated = table.filter(~F.col("text").rlike(licenses.GATE)).collect()
    assert [r.text for r in ungated] == []
    # families are matched apart from any other text, in the whole scan
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(table.select("doc_id", "text")).collect()}
    assert [(s[0], got[i]) for i, s in enumerate(signs) if not any(x == s[0] or x.startswith(s[0]) or s[0].startswith(x) for x in got[i] if x)] == []


def test_headers_expressions_and_bodies(spark):
    texts = {
        "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "gpl-3": "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "bsl-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software",
        "lgpl-2.1": "License: LGPL-2.1+", "eupl-1.2": "EUPL v1.2", "gpl-2": "GPL-2.0-only OR MIT", "apache-2.0": "http://www.apache.org/licenses/LICENSE-2.0",
        "bsd-3-clause": "Neither the name of the owner nor the names of its contributors may be used to endorse or promote products",
        "mit": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM", "zlib": "The origin of this software must not be misrepresented",
    }
    rows = licenses.scan(spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")).collect()
    for r in rows:
        assert list(texts)[r.doc_id] in r.labels.split(","), (r.text, r.labels)


def test_repeated_notices_cost_their_length(spark):
    text = "copyright 2020 x. All rights reserved. Licensed under the MIT License.\n" * 14_000  # 1 MB
    began = time.time()
    (r,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert time.time() - began < 90
    assert r.labels == "all-rights-reserved,copyright,mit" and r.n_base == 14_000 and len(r.detections) == 3 * 14_000
    assert r.detections[-1].end == len(text) - 2


def test_suppression_is_that_of_a_plain_version(spark):
    rng = random.Random(6)
    places = [(rng.randrange(400), rng.randrange(1, 60), rng.randrange(1, 5), i) for i in range(700)]
    rows = [(a, -(a + n), p, i, str(i), 0.5) for a, n, p, i in places]
    df = spark.createDataFrame([(rows,)], "places array<struct<start:int,back:int,priority:int,rule:int,label:string,confidence:double>>")
    (got,) = df.select(licenses._suppress(F.col("places")).alias("kept")).collect()
    want, seen = [], []
    for a, back, p, i, label, _ in sorted(rows):
        if not any(e >= -back and q <= p for e, q in seen):
            want.append((a, -back, label))
        seen.append((-back, p))
    assert [(k.start, k.end, k.label) for k in got.kept] == want


def test_clashing_names_nulls_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "MIT License", "x", 7), (1, "MIT License", "x", 7), (1, "MIT License", "x", 7), (2, None, None, None)], "doc_id long, text string, labels string, score int")
    rows = licenses.scan(df).collect()
    assert sorted((r.doc_id or 0, r.labels, r.n_base) for r in rows) == [(0, "mit", 1), (1, "mit", 1), (1, "mit", 1), (2, "", 0)]
    assert licenses.scan(df.limit(0)).count() == 0


HEADERS = {
    "gpl-3": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "lgpl-2.1": """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted. Neither the name of the
University nor the names of its contributors may be used to
endorse or promote products derived from this software.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in
compliance with the License.""",
}


def test_headers_in_comments_get_their_versions(spark):
    marks = ["", " * ", "# ", "// ", ";; ", "-- ", "\t *\t", "%% "]
    rows = []
    for label, text in HEADERS.items():
        for m in marks:
            rows.append((len(rows), label, "/*\n" + "\n".join(m + line for line in text.split("\n")) + "\n" + m.rstrip() + "\n" + m + "\n*/\nint main;"))
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, label string, text string")).collect()
    assert [(r.label, r.labels, r.text) for r in got if r.label not in r.labels.split(",")] == []
