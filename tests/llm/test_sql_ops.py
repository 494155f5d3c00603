"""Operators with SQL: against DuckDB on the small tables and on hand-made edge cases."""

import pandas as pd
import pytest

from batchlake.llm import chat, licenses, packing, quality, queries
from conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert same_rows(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name])


LONG = "Word " * 30_000
EDGE = [
    (1, None), (2, ""), (3, "  \n\t "), (None, "No id here. All rights reserved."), (5, LONG), (6, "tie"), (6, "tie"), (6, "other"),
    (7, "Licensed under the Apache License,\nversion 2.0 (the \"License\").\nYou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\n"),
    (8, "Released under the MIT License. Released under the MIT License.\nAll rights reserved."), (9, "This is permission of a kind nobody knows."), (10, "A!! B!! C!! D!! E!! F!!"), (11, "a | b | c | d | e | f | g"), (12, "of of of of of of of of of of of of"), (13, "$$$ ### &&& x$$$ y###"), (14, "Ünïcode größer 中文 text"),
]


@pytest.fixture
def edge(spark):
    d = spark.createDataFrame([(i, t, "en", 1, 2, "x") for i, t in EDGE], "doc_id long, text string, lang string, n_words long, bin long, seq string")
    return d, {"documents": pd.DataFrame({"doc_id": pd.array([i for i, _ in EDGE], "Int64"), "text": [t for _, t in EDGE]})}


@pytest.mark.parametrize("f,sql", [(licenses.scan, licenses.SCAN_SQL), (packing.pack, packing.PACK_SQL), (quality.ledger, quality.LEDGER_SQL), (lambda d: quality.ablation(quality.ledger(d)), quality.ABLATION_SQL)])
def test_edge_cases_equal_sql(edge, f, sql):
    d, views = edge
    same_rows(f(d), sql, "/nowhere", views)
    assert f(d.filter("false")).count() == 0


def test_licences_found(edge):
    got = {r.doc_id: r for r in licenses.scan(edge[0]).collect()}
    assert got[7].licenses == "Apache-2.0" and got[7].sentences == "<Apache2the><Apache2not><Apache2copy>"
    assert got[8].licenses == "MIT,all-rights-reserved" and got[8].sentences == "<MITshort><MITshort><AllRights>"
    assert got[9].status == "unknown" and got[2].status == "none" and got[None].licenses == "all-rights-reserved"


GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
LGPL = """ * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
"""
MIT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
AGPL = GPL.replace("GNU General Public", "GNU Affero General Public")
MPL = """// This Source Code Form is subject to the terms of the Mozilla Public
// License, v. 2.0. If a copy of the MPL was not distributed with this
// file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.
"""
ASF = APACHE.replace("Licensed under", "Licensed to the Apache Software Foundation (ASF) under one or more\n   contributor license agreements.  See the NOTICE file distributed with\n   this work for additional information regarding copyright ownership.\n   The ASF licenses this file to You under")
HEADERS = [
    (GPL, "GPL-3.0-or-later", "<GPLfree3><GPLhope><GPLsee>"), (APACHE, "Apache-2.0", "<Apache2the><Apache2not><Apache2copy><Apache2asis><Apache2see>"), (LGPL, "LGPL-2.1-or-later", "<LGPLfree>"),
    (MIT, "MIT", "<MITperm><MITnotice><AsIsMIT>"), (BSD, "BSD-3-Clause", "<BSDuse><BSDsource><BSDbinary><BSDnames>"),
    (AGPL, "AGPL-3.0-or-later", "<AGPLfree3><GPLhope><AGPLsee>"), (MPL, "MPL-2.0", "<MPL2>"), (ISC, "ISC", "<ISC><ISCasis>"),
    (ASF, "Apache-2.0", "<ASFgrant><ASFnotice><ASFthis><Apache2not><Apache2copy><Apache2asis><Apache2see>"), ("/* SPDX-License-Identifier: GPL-2.0-only */\nint x;", "GPL-2.0-only", "<SPDX:GPL-2.0-only>"),
]


def test_headers_as_published(spark):
    rows = [(k, t) for k, (t, _, _) in enumerate(HEADERS)] + [(10 + k, " ".join(t.split())) for k, (t, _, _) in enumerate(HEADERS[:3])]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sql = licenses.SCAN_SQL
    same_rows(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")), sql, "/nowhere", views={"documents": pd.DataFrame(rows, columns=["doc_id", "text"])})
    for k, (_, name, run) in enumerate(HEADERS):
        assert got[k].licenses == name and run in got[k].sentences
        if k < 3:
            assert got[10 + k].licenses == name


def test_wrapped_cues(spark):
    texts = ["All rights\nreserved.", "This is free and unencumbered software released into the public\ndomain.", "This work is dedicated to the public  domain under CC0 1.0", "some rights-reserved", "plain prose"]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k].licenses for k in range(3)] == ["all-rights-reserved", "Unlicense", "CC0-1.0"]
    assert got[3].status == "unknown" and got[4].status == "none"


def test_rules_and_policies(edge):
    got = {r.doc_id: r for r in quality.ledger(edge[0]).collect()}
    bit = {n: 1 << b for n, b in quality.BIT.items()}
    assert got[1].fail_bits == got[2].fail_bits == got[3].fail_bits == bit["no_words"]
    assert got[10].fail_bits & bit["exclamations"] and got[11].fail_bits & bit["pipes"] and got[12].fail_bits & bit["adjacent_repeats"] and got[13].fail_bits & bit["symbols"]
    assert got[12].keep_v1 and not got[12].keep_v2 and got[14].keep_v2
    kept = quality.keep_good(edge[0])
    assert kept.columns == edge[0].columns and sorted((r.doc_id for r in kept.collect()), key=str) == sorted((6, 6, 6, 7, 8, 9, 14, None), key=str)


def test_repeated_lines_are_rejected_and_ablated(spark):
    import corpus_pipeline

    rows = [(1, "the same line\n" * 9), (2, "\n".join(f"line {'abcdefghi'[k]} of nine" for k in range(9)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.quality_rules(spark, d, SF).collect()] == [2]
    got = {(r.policy, r.rule): r for r in quality.ablation(quality.ledger(d)).collect()}
    assert set(got) == {(v, r) for v in ("v1", "v2", "v3") for r in quality.RULES}
    r, unused = got["v3", "duplicate_lines"], got["v2", "duplicate_lines"]
    assert r.used and (r.failed, r.only_this, r.kept, r.kept_without, r.kept_with) == (1, 1, 1, 2, 1)
    assert not unused.used and (unused.failed, unused.only_this, unused.kept, unused.kept_without, unused.kept_with) == (1, 0, 2, 2, 1)


def test_bins_keep_texts_as_they_are(spark):
    texts = {1: "  two\tblanks  before\n\n" * 40 + "end \n", 2: "one\ntwo", 3: "w\n" * 130, 4: "\tonly " * 64}
    d = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    where = {(r.doc_id, r.piece): (r.shard, r["class"], r.bin, r.slot) for r in packing.pack(d, 64).collect()}
    bins = {(r.shard, r["class"], r.bin): r.text.split("\f") for r in packing.packed_bins(d, 64).collect()}
    for i, t in texts.items():
        pieces = [bins[where[i, k][:3]][where[i, k][3]] for k in range(sum(x[0] == i for x in where))]
        assert "".join(pieces) == t
    assert packing.packed_bins(d.filter("false")).count() == 0


def test_bins_hold_whole_texts(edge):
    d = edge[0]
    bins = packing.packed_bins(d, 64).collect()
    assert all(r.n_tokens <= 64 and len(r.doc_ids) == r.n_docs for r in bins)
    back = sorted(w for r in bins for w in r.text.split())
    assert back == sorted(w for _, t in EDGE if t for w in t.split())
    plan = packing.pack(d, 64).collect()
    assert sum(r.n_tokens for r in plan) == sum(r.n_tokens for r in bins)
    full = {}
    for r in plan:
        full.setdefault((r.shard, r["class"], r.bin), []).append(r)
    assert all(len(v) <= k[1] and sum(r.n_tokens for r in v) <= 64 for k, v in full.items())
    open_bins = {}
    for k, v in full.items():
        open_bins[k[:2]] = open_bins.get(k[:2], 0) + (len(v) < k[1])
    assert max(open_bins.values()) <= 1


TALK = [(1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 2, "guest", "hey"), (1, 0, "system", "be kind"), (2, 1, "system", "alone"), (3, 1, None, None), (3, None, "user", "first"), (4, 1, "user", "same"), (4, 1, "user", "same"), (None, 1, "user", "no id")]


def test_perspectives(spark):
    d = spark.createDataFrame([(*r, 0) for r in TALK], "conv_id long, turn long, role string, text string, participant int")
    views = {"conversations": pd.DataFrame({"conv_id": pd.array([r[0] for r in TALK], "Int64"), "turn": pd.array([r[1] for r in TALK], "Int64"), "role": [r[2] for r in TALK], "text": [r[3] for r in TALK]})}
    same_rows(chat.perspectives(d), chat.PERSPECTIVES_SQL, "/nowhere", views)
    got = {(r.conv_id, r.participant): r for r in chat.perspectives(d).collect()}
    assert (2, "system") not in got and set(got) == {(1, "user"), (1, "assistant"), (1, "guest"), (3, "unknown"), (3, "user"), (4, "user"), (None, "user")}
    r = got[(1, "guest")]
    assert "<|im_start|>user name=assistant\nhello<|im_end|>" in r.text and "<|im_start|>assistant\nhey<|im_end|>" in r.text and r.text.startswith("<|im_start|>system\nbe kind")
    (span,) = r.mask.split(",")
    a, b = map(int, span.split(":"))
    assert r.text[a:b] == "hey<|im_end|>"
    assert chat.perspectives(d.filter("false")).count() == 0
