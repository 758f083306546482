import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cantata.llm import licenses


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "path string, text string").selectExpr("*", "'x' as license", "1 as score")
    return {r.path: (r.license, r.origin) for r in licenses.scan(df.withColumnRenamed("path", "p"), F.col("p"), keep=("p",), **options).collect()}


FILLER = "some words of plain prose that say nothing about terms at all " * 5


def test_statements_and_inheritance(spark):
    rows = [
        ("a/LICENSE", "Released under the MIT License.\n" + FILLER),
        ("a/x/1", FILLER),
        ("a/x/y/2", FILLER + "\nLicensed under the Apache License, Version 2.0."),
        ("a/x/y/3", FILLER),
        ("a/x/z/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("a/x/z/w/4", ""),
        ("b/5", FILLER),
        ("b/6", FILLER + " and this paragraph says it is Licensed under CC BY-NC 4.0. And goes on " + FILLER),
        ("b/7", "a license to thrill"),
        ("ab/8", None),
        (None, "All rights reserved."),
    ]
    got = run(spark, rows)
    assert got == {
        "a/LICENSE": ("MIT", "own"), "a/x/1": ("MIT", "inherited"), "a/x/y/2": ("Apache-2.0", "own"), "a/x/y/3": ("MIT", "inherited"), "a/x/z/COPYING.txt": ("GPL-3.0", "own"), "a/x/z/w/4": ("GPL-3.0", "inherited"),
        "b/5": ("Proprietary", "inherited"), "b/6": ("CC-BY-NC-4.0", "own"), "b/7": ("Proprietary", "inherited"), "ab/8": ("Proprietary", "inherited"), "": ("Proprietary", "own"),
    }


def test_nothing_declared_and_empty(spark):
    assert run(spark, [("a/1", "x"), ("a/1", "x"), ("b", None)]) == {"a/1": (None, "none"), "b": (None, "none")}
    assert run(spark, []) == {}


def test_document_frequency_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    frequency, n = licenses.document_frequency(docs, "text")
    texts = [set(licenses.terms(r.text)) for r in docs.collect()]
    assert n == len(texts)
    assert frequency == {w: sum(w in t for t in texts) for w in licenses.VOCABULARY}


def test_every_planted_statement_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = F.concat_ws("/", "source", F.col("doc_id").cast("string"))
    got = {r.doc_id: (r.license, r.origin) for r in licenses.scan(docs, path).collect()}
    names = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "All rights reserved.": "Proprietary"}
    own = 0
    for r in docs.collect():
        lines = {names[x] for x in r.text.split("\n") if x in names}
        if lines:
            assert got[r.doc_id][0] in lines and got[r.doc_id][1] == "own"
            own += 1
    assert own and sum(o == "own" for _, o in got.values()) <= own + 5


def plain_cosine(found, template, idf, unknown):
    from collections import Counter

    vector = lambda w: {x: n * idf.get(x, unknown) for x, n in Counter(w).items()}
    a, b = vector(found), vector(template)
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    return sum(x * b.get(w, 0) for w, x in a.items()) / (norm(a) * norm(b))


def test_scores_against_plain_cosines():
    frequency, n = {w: (i * 37) % 400 for i, w in enumerate(licenses.VOCABULARY)}, 1000
    scorer = licenses.Scorer(frequency, n)
    idf = {w: math.log((1 + n) / (1 + frequency[w])) + 1 for w in licenses.VOCABULARY}
    text = "Some prose. Licensed under the Apache License, Version 2.0; or released under the MIT license at your option, foo bar"
    found = licenses.terms(text)
    h = licenses._hashes(found)
    units = [(0, 5), (2, 9), (3, 12), (0, len(found)), (10, 14)]
    score, best, _, _ = scorer.scores(h, *(np.array(x) for x in zip(*units)))
    for (a, b), value, k in zip(units, score, best):
        every = [plain_cosine(found[a:b], licenses.terms(t), idf, math.log(1 + n) + 1) for _, t, _ in licenses.TEMPLATES]
        assert abs(max(every) - value) < 1e-6 and abs(every[k] - value) < 1e-6


GNU = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU {}General Public License as published by
# the Free Software Foundation, either version {} of the License, or
# (at your option) any later version.
"""
MIT = """Copyright (c) 2001 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
"""
BSD = """Copyright (c) The Owners
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution.
"""


def test_headers_and_texts_over_line_breaks(spark):
    rows = [(GNU.format("", 2), "GPL-2.0"), (GNU.format("", 3), "GPL-3.0"), (GNU.format("Lesser ", "2.1"), "LGPL-2.1"), (GNU.format("Affero ", 3), "AGPL-3.0"), (MIT, "MIT"), (BSD, "BSD-2-Clause")]
    rows += [(BSD + "3. Neither the name of the owner nor the names of its contributors\n may be used to endorse or promote products derived from this software\n without specific prior written permission.\n", "BSD-3-Clause")]
    rows += [(f"// SPDX-License-Identifier: {x}\nint main;", y) for x, y in (("MIT", "MIT"), ("GPL-2.0-or-later", "GPL-2.0"), ("LGPL-2.1-only", "LGPL-2.1"), ("BSD-3-Clause", "BSD-3-Clause"), ("EPL-2.0", "EPL-2.0"), ("ISC", "ISC"))]
    rows += [("This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/.", "MPL-2.0")]
    rows += [("word " * 50_000 + "\nReleased under the MIT License.\n" + "word " * 50_000, "MIT"), ("license " * 1000 + "to drive", None)]
    got = run(spark, [(f"d{i}/f", t) for i, (t, _) in enumerate(rows)])
    assert [got[f"d{i}/f"][0] for i in range(len(rows))] == [x for _, x in rows]


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts here")
def test_whole_licence_texts(spark):
    names = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "BSD": "BSD-3-Clause"}
    names = {k: v for k, v in names.items() if os.path.exists(f"/usr/share/common-licenses/{k}")}
    got = run(spark, [(f"{k}/LICENSE", open(f"/usr/share/common-licenses/{k}", encoding="utf-8").read()) for k in names] + [(f"x{i}/f", FILLER) for i in range(40)])
    assert {k: got[f"{k}/LICENSE"][0] for k in names} == names


def plain_inheritance(files):
    """files: path to (licence, score, whether it declares its directory). Directories walked up one by one."""
    out = {}
    for path, (name, _, _) in files.items():
        if name is None:
            at = path.rsplit("/", 1)[0] if "/" in path else ""
            while True:
                given = [(s, n) for p, (n, s, whole) in files.items() if whole and (p.rsplit("/", 1)[0] if "/" in p else "") == at]
                if given or not at:
                    name = max(given)[1] if given else None
                    break
                at = at.rsplit("/", 1)[0] if "/" in at else ""
        out[path] = name
    return out


def test_inheritance_against_plain_version(spark):
    rng = random.Random(3)
    said = {"MIT": "Released under the MIT License.", "GPL-2.0": "Licensed under the GNU General Public License, version 2", None: FILLER}
    files, rows = {}, []
    for i in range(150):
        folder = "/".join(rng.choice("abc") for _ in range(rng.randint(0, 5)))
        name = rng.choice([None, None, "MIT", "GPL-2.0"])
        whole = name is not None and rng.random() < 0.3
        path = f"{folder}/LICENSE.{i}".lstrip("/") if whole else f"{folder}/f{i}".lstrip("/")
        text = said[name] + ("\n" + FILLER * 2 if name else "")
        rows.append((path, text))
        files[path] = (name, 1.0, whole)
    scores = {r.p: r.score for r in licenses.scan(spark.createDataFrame(rows, "p string, text string"), F.col("p"), keep=("p",)).collect()}
    files = {p: (n, scores[p], w) for p, (n, _, w) in files.items()}
    for limit in (32 << 20, 0):
        assert {p: n for p, (n, _) in run(spark, rows, limit=limit).items()} == plain_inheritance(files)


def test_bytes_that_are_no_utf8(spark):
    df = spark.createDataFrame([("a/f", b"\xff Released under the MIT License. \xe4")], "p string, b binary").selectExpr("p", "cast(b as string) as text")
    assert [r.license for r in licenses.scan(df, F.col("p"), keep=("p",)).collect()] == ["MIT"]


def frequent_scorer():
    """As in a corpus where the words of statements are rare."""
    return licenses.Scorer({w: 2 + i % 5 for i, w in enumerate(licenses.VOCABULARY)}, 10_000)


def found(scorer, *texts):
    raw = [t.encode() for t in texts]
    return [x[0] for x in scorer.scan(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), licenses.THRESHOLD)]


def test_order_and_negations():
    s = frequent_scorer()
    assert found(s, "Artists reserved all rights", "Not licensed under the MIT License", "This is not released under the MIT License, as you know", "rights of all reserved seats") == [None] * 4
    assert found(s, "Copyright 2020 Foo. Licensed under a commercial license") == [None]
    assert found(s, "Copyright 2020 Foo. All rights reserved.", "It is not hard. Licensed under the MIT License", "Released under the MIT License, not the GPL", "we do NOT ship it\n\nLicensed under the Apache License, Version 2.0") == ["Proprietary", "MIT", "MIT", "Apache-2.0"]
    for name, called in licenses.NAMES.items():
        for title in called:
            assert found(s, f"Licensed under the {title}.")[0] is not None, (name, title)


def test_many_cues_take_time_in_proportion():
    import time

    s, took = frequent_scorer(), []
    for n in (5_000, 40_000):
        began = time.perf_counter()
        assert found(s, "rights license copyright permission spdx " * (n // 5) + "\n\nReleased under the MIT License.\n") in (["MIT"], [None])
        took.append(time.perf_counter() - began)
    assert took[1] < 16 * took[0] + 1 and took[1] < 40
