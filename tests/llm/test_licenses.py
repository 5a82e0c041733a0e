"""Licence scans against a plain version, and the wordings that files really have."""

import math
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lockstep.llm import op7_licenses as op7
from lockstep.llm.licence_texts import FORMS

SF = "/root/testdata/sf0.001"
GPL = """# Copyright (C) 2020 Foo Bar
# This program is free software{0} you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation{1} either version {2} of the License, or
# (at your option) any later version.
import os"""
BSD = """// Copyright Foo
// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are
// met:
//   1. Redistributions of source code must retain the above copyright
//      notice, this list of conditions and the following disclaimer.
//   2. Redistributions in binary form must reproduce the above copyright
//      notice, this list of conditions and the following disclaimer in the
//      documentation and/or other materials provided with the distribution.
"""
THIRD = """//   3. Neither the name of the copyright holder nor the names of its
//      contributors may be used to endorse or promote products derived
//      from this software without specific prior written permission.
"""
APACHE = """/*
 * Licensed under the Apache License, Version 2.0 (the "License");
 * you may not use this file except in compliance with the License.
 * You may obtain a copy of the License at
 *
 *     http://www.apache.org/licenses/LICENSE-2.0
 */
int main() { return 0; }"""
MIT = """-- Permission is hereby granted, free of charge, to any person obtaining a
-- copy of this software and associated documentation files (the "Software"),
-- to deal in the Software without restriction, including without limitation
-- the rights to use, copy, modify, merge, publish, distribute, sublicense,
-- and/or sell copies of the Software, and to permit persons to whom the
-- Software is furnished to do so, subject to the following conditions:
select 1"""
#: path, text, licence
FILES = [
    ("a/apache.c", APACHE, "Apache-2.0"),
    ("a/gpl3.py", GPL.format(":", ",", 3), "GPL-3.0"),
    ("a/gpl2.py", GPL.format(";", ";", 2), "GPL-2.0"),
    ("a/bsd2.c", BSD + "int x;", "BSD-2-Clause"),
    ("a/bsd3.c", BSD + THIRD + "int x;", "BSD-3-Clause"),
    ("a/mit.sql", MIT, "MIT"),
    ("b/x.txt", "A short readme of a small tool that sorts lists of words by length. Released under the MIT License.", "MIT"),
    ("b/none.txt", "The permission of the king was needed to enter the hall.", None),
    ("b/whole/COPYING", "\n\n".join(FORMS["ISC"]), "ISC"),
    ("b/whole/deep/er/x.c", "int y;", "ISC"),
    ("c/LICENSE.b", "Released under the MIT License", "MIT"),
    ("c/LICENSE.a", "Licensed under the Apache License, Version 2.0", "Apache-2.0"),
    ("c/d/e.txt", None, "Apache-2.0"),  # a tie: the smallest path
    ("a", "", None),
    (None, "Released under the MIT License", "MIT"),
    ("z.txt", "Licensed under CC BY-NC 4.0.\n" + "word " * 30000, "CC-BY-NC-4.0"),
]
PROSE = [(f"p/{i}.txt", "the quick brown fox jumps over the lazy dog and this is that of a to in it " * 3 + f" word{i}", None) for i in range(120)]


def plain(files, declares):
    """path, license, cosine of each of (path, text), one after the other."""
    split = lambda t: [w for x in re.split(r"[\t\n\r\x0b\x0c ]+", t.lower()) if (w := x.strip(op7.EDGES))]
    marked = lambda t: any(m in t or m.upper() in t for m in op7.MARKS)
    n, df = len(files), Counter(w for _, t in files for w in set(split(t or "")))
    idf = lambda w: math.log((1 + n) / (1 + df[w])) + 1

    def vector(text):
        return {w: c * idf(w) for w, c in Counter(split(text)).items()}

    forms = [(name, vector(f)) for name, texts in FORMS.items() for f in texts]
    known = {w for _, v in forms for w in v}

    def best(text):
        v = vector(text)
        norm = math.sqrt(sum(x * x for x in v.values()))
        dots = [(-round(sum(x * f[w] for w, x in v.items() if w in f) / math.sqrt(sum(y * y for y in f.values())), 9), name) for name, f in forms]
        dot, name = min(dots)
        return round(-dot / norm, 9), name, sum(x * x for w, x in v.items() if w in known) / norm**2

    own = {}
    for k, (path, text) in enumerate(files):
        rows = [r for r in re.split(r"\n|(?<=[.!?])[ \t]+", text or "") if split(r)]
        found = []
        for i, r in enumerate(rows):
            if not marked(r):
                continue
            cosine, name, share = best(r)
            tried = [(cosine, name)]
            if cosine < op7.SURE and share >= op7.SHARE:
                runs = set()
                for a in range(max(0, i - op7.BEFORE), i + 1):
                    part = rows[a : a + op7.LINES]
                    for size in op7.WORDS:
                        total, z = 0, 0
                        while z < len(part) - 1 and total + len(split(part[z])) < size:
                            total += len(split(part[z]))
                            z += 1
                        if a + z >= i and z:
                            runs.add((a, a + z))
                tried += [best(" ".join(rows[a : z + 1]))[:2] for a, z in runs]
            found.append((i, tried))
        if rows and declares(path, text) and marked(text):
            found.append((-1, [best(" ".join(rows))[:2]]))
        lines = [min((-c, i, name) for c, name in tried) for i, tried in found]
        lines = [x for x in lines if -x[0] >= op7.LEAST_COSINE]
        own[k] = min(lines) if lines else None
    given = {}
    for k, (path, text) in enumerate(files):
        if path is not None and declares(path, text) and own[k]:
            folder = path.rpartition("/")[0]
            given[folder] = min(given.get(folder, (1, "", "")), (own[k][0], path, own[k][2]))
    out = []
    for k, (path, _) in enumerate(files):
        if own[k]:
            out.append((path, own[k][2], -own[k][0], "own"))
            continue
        up = path.rpartition("/")[0] if path is not None else None
        while up and up not in given:
            up = up.rpartition("/")[0]
        out.append((path, given[up][2], None, "inherited") if up in given else (path, None, None, "none"))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), str(r[1]), str(r[3]))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in want]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in want], abs=1e-8)


def test_wrapped_headers_are_told_apart(spark):
    files = FILES + PROSE
    x = spark.createDataFrame([(p, t, 1) for p, t, _ in files], "path string, text string, license int").repartition(3)
    got = [(r["path"], r["license"], r["cosine"], r["origin"]) for r in op7.scan_licenses(x).collect()]
    assert {p: name for p, name, _, _ in got} == {p: name for p, _, name in files}
    same(got, plain([(p, t) for p, t, _ in files], lambda p, t: p is not None and bool(re.search(op7.NAMES, p.rpartition("/")[2]))))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_the_query_against_the_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    files = [(f"{r['source'] or 'unknown'}/{r['lang'] or 'unknown'}/{r['doc_id']}.txt", r["text"]) for r in docs]
    got = op7.op7_licenses(spark, SF).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs)
    assert all(r["path"].endswith(f"/{r['doc_id']}.txt") for r in got)
    same([(r["path"], r["license"], r["cosine"], r["origin"]) for r in got], plain(files, lambda p, t: len(re.split(r"\s+", t or "")) < 20))


def test_ids_are_carried_and_rows_may_repeat(spark, tmp_path):
    rows = [(None, "Released under the MIT License."), (-7, "Released under the MIT License."), (3, "words"), (3, "words"), (3, None)]
    spark.createDataFrame([(i, t, "s", None) for i, t in rows], "doc_id bigint, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(((r["doc_id"], r["path"], r["license"]) for r in op7.op7_licenses(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(None, None, "MIT"), (-7, "s/unknown/-7.txt", "MIT"), *[(3, "s/unknown/3.txt", "MIT")] * 3], key=str)
    assert op7.scan_licenses(spark.createDataFrame([], "path string, text string")).count() == 0
    assert op7.scan_licenses(spark.createDataFrame([("x", "y")], "path string, text string").where(F.lit(False)), carry=["text"]).columns == ["text", "path", "license", "cosine", "origin", "from_dir", "n_headers"]
