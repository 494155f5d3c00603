"""Operator 1: licences of documents by their sentences.

A text is cut into sentences, a sentence is normalised (lower case, only letters,
digits and single blanks), and a normalised sentence that is known becomes an
identifier. Rules, tried in their order, name a licence for a run of identifiers;
a run that a rule has used is not used again, so a rule for a longer run goes
before those for its parts.

A known sentence is found over line ends of any kind, be the next line's first
letter a capital, a bracket or behind a blank line. SCAN_SQL says the same in SQL.

Only documents with a cue can hold a known sentence, as every known sentence
has one (checked when this module is loaded); the others are settled by a
search, in which anything but letters and digits may be between a cue's words.

Cases: a null or empty text has status `none`; sentences with a cue that nobody
knows make `unknown` if no rule matches; repeated rows and null doc_ids have
rows of their own; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

CUES = ("licen", "copyright", "rights reserved", "permission", "warrant", "redistribut", "public domain", "the above")

#: identifier -> the sentence, as it would be written.
SENTENCES: dict[str, str] = {
    "AllRights": "All rights reserved",
    "MITshort": "Released under the MIT License",
    "MITlicensed": "Licensed under the MIT License",
    "MITperm": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "MITnotice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "AsIsMIT": "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement",
    "Apache2short": "Licensed under the Apache License, Version 2.0",
    "Apache2the": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "Apache2not": "You may not use this file except in compliance with the License",
    "Apache2copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Apache2asis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "Apache2see": "See the License for the specific language governing permissions and limitations under the License",
    "GPL3work": "This work is licensed under the GNU General Public License, version 3",
    "GPL2work": "This work is licensed under the GNU General Public License, version 2",
    "GPLfree3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "GPLfree2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version",
    "GPLhope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY, without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "GPLsee": "See the GNU General Public License for more details",
    "LGPLfree": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version",
    "MPL2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "BSDuse": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSDsource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "BSDbinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "BSDnames": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "BSDshort": "Released under the BSD License",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "CCBYNC4": "Licensed under CC BY-NC 4.0",
    "CCBY4": "Licensed under CC BY 4.0",
    "CCBYSA4": "Licensed under CC BY-SA 4.0",
    "CC0": "This work is dedicated to the public domain under CC0 1.0",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "MITproject": "This project is licensed under the MIT License",
    "MITfile": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file or at https://opensource.org/licenses/MIT",
    "MITliable": "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software",
    "Apache2project": "This project is licensed under the Apache License 2.0",
    "ASFgrant": "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements",
    "ASFnotice": "See the NOTICE file distributed with this work for additional information regarding copyright ownership",
    "ASFthis": "The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\")",
    "GPLcopy": "You should have received a copy of the GNU General Public License along with this program",
    "GNUsite": "If not, see <https://www.gnu.org/licenses/>",
    "GNUsiteOld": "If not, see <http://www.gnu.org/licenses/>",
    "GPLonly2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "GPLonly3": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation",
    "GPL3project": "This project is licensed under the GNU General Public License v3.0",
    "AGPLfree3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "AGPLsee": "See the GNU Affero General Public License for more details",
    "AGPLcopy": "You should have received a copy of the GNU Affero General Public License along with this program",
    "LGPLfree3": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version",
    "LGPLprogram3": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "LGPLhope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "LGPLsee": "See the GNU Lesser General Public License for more details",
    "LGPLcopy": "You should have received a copy of the GNU Lesser General Public License along with this library",
    "BSD3project": "This project is licensed under the BSD 3-Clause License",
    "BSDfile": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "BSDasis": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED",
    "ISCasis": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS",
    "ZeroBSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "ZlibAsIs": "This software is provided 'as-is', without any express or implied warranty",
    "ZlibUse": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "BSLgrant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following",
    "BSLshort": "Distributed under the Boost Software License, Version 1.0",
    "EPL2": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    "CC0law": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "CCBYNCSA4": "Licensed under CC BY-NC-SA 4.0",
    "CCBYND4": "Licensed under CC BY-ND 4.0",
    "CCBY4work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CCBYSA4work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CCBYNC4work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "CCBYNCSA4work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
}
#: Names that stand in an SPDX line.
SPDX = "MIT Apache-2.0 BSD-3-Clause BSD-2-Clause GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-or-later LGPL-3.0-or-later AGPL-3.0-or-later MPL-2.0 ISC 0BSD Zlib BSL-1.0 EPL-2.0 CC0-1.0 Unlicense CC-BY-4.0 CC-BY-SA-4.0".split()
SENTENCES |= {f"SPDX:{x}": f"SPDX-License-Identifier: {x}" for x in SPDX}

#: (licence, run of identifiers), in the order in which they are tried.
RULES: list[tuple[str, tuple[str, ...]]] = [
    ("MIT", ("MITperm", "MITnotice", "AsIsMIT", "MITliable")),
    ("MIT", ("MITperm", "MITnotice", "AsIsMIT")),
    ("MIT", ("MITperm", "MITnotice")),
    ("BSD-3-Clause", ("BSDuse", "BSDsource", "BSDbinary", "BSDnames", "BSDasis")),
    ("BSD-3-Clause", ("BSDuse", "BSDsource", "BSDbinary", "BSDnames")),
    ("BSD-2-Clause", ("BSDuse", "BSDsource", "BSDbinary", "BSDasis")),
    ("BSD-2-Clause", ("BSDuse", "BSDsource", "BSDbinary")),
    ("AGPL-3.0-or-later", ("AGPLfree3", "GPLhope", "AGPLsee")),
    ("AGPL-3.0-or-later", ("AGPLfree3",)),
    ("LGPL-3.0-or-later", ("LGPLfree3", "LGPLhope", "LGPLsee")),
    ("LGPL-3.0-or-later", ("LGPLfree3",)),
    ("LGPL-3.0-or-later", ("LGPLprogram3",)),
    ("LGPL-2.1-or-later", ("LGPLfree", "LGPLhope", "LGPLsee")),
    ("GPL-2.0-only", ("GPLonly2", "GPLhope", "GPLsee")),
    ("GPL-3.0-only", ("GPLonly3", "GPLhope", "GPLsee")),
    ("GPL-2.0-only", ("GPLonly2",)),
    ("GPL-3.0-only", ("GPLonly3",)),
    ("GPL-3.0-or-later", ("GPLfree3", "GPLhope", "GPLsee", "GPLcopy")),
    ("GPL-2.0-or-later", ("GPLfree2", "GPLhope", "GPLsee", "GPLcopy")),
    ("GPL-3.0-or-later", ("GPLfree3", "GPLhope", "GPLsee")),
    ("GPL-2.0-or-later", ("GPLfree2", "GPLhope", "GPLsee")),
    ("GPL-3.0-or-later", ("GPLfree3",)),
    ("GPL-2.0-or-later", ("GPLfree2",)),
    ("LGPL-2.1-or-later", ("LGPLfree",)),
    ("Apache-2.0", ("ASFgrant", "ASFnotice", "ASFthis", "Apache2not", "Apache2copy", "Apache2asis", "Apache2see")),
    ("Apache-2.0", ("ASFthis",)),
    ("Apache-2.0", ("Apache2the", "Apache2not", "Apache2copy", "Apache2asis", "Apache2see")),
    ("Apache-2.0", ("Apache2the", "Apache2not", "Apache2copy")),
    ("Apache-2.0", ("Apache2the",)),
    ("Apache-2.0", ("Apache2short",)),
    ("MIT", ("MITshort",)),
    ("MIT", ("MITlicensed",)),
    ("GPL-3.0", ("GPL3work",)),
    ("GPL-2.0", ("GPL2work",)),
    ("MPL-2.0", ("MPL2",)),
    ("BSD", ("BSDshort",)),
    ("ISC", ("ISC", "ISCasis")),
    ("ISC", ("ISC",)),
    ("0BSD", ("ZeroBSD",)),
    ("Zlib", ("ZlibAsIs", "ZlibUse")),
    ("Zlib", ("ZlibUse",)),
    ("BSL-1.0", ("BSLgrant",)),
    ("BSL-1.0", ("BSLshort",)),
    ("EPL-2.0", ("EPL2",)),
    ("WTFPL", ("WTFPL",)),
    ("MIT", ("MITproject",)),
    ("MIT", ("MITfile",)),
    ("Apache-2.0", ("Apache2project",)),
    ("GPL-3.0", ("GPL3project",)),
    ("BSD-3-Clause", ("BSD3project",)),
    ("BSD", ("BSDfile",)),
    ("CC-BY-NC-SA-4.0", ("CCBYNCSA4",)),
    ("CC-BY-NC-SA-4.0", ("CCBYNCSA4work",)),
    ("CC-BY-ND-4.0", ("CCBYND4",)),
    ("CC-BY-NC-4.0", ("CCBYNC4work",)),
    ("CC-BY-SA-4.0", ("CCBYSA4work",)),
    ("CC-BY-4.0", ("CCBY4work",)),
    ("CC0-1.0", ("CC0law",)),
    ("CC-BY-NC-4.0", ("CCBYNC4",)),
    ("CC-BY-SA-4.0", ("CCBYSA4",)),
    ("CC-BY-4.0", ("CCBY4",)),
    ("CC0-1.0", ("CC0",)),
    ("Unlicense", ("Unlicense",)),
    *((x, (f"SPDX:{x}",)) for x in SPDX),
    ("all-rights-reserved", ("AllRights",)),
]

#: A line end inside a sentence; a sentence's end.
WRAP = r"([a-z0-9,;])[ \t]*\r?\n[ \t*#/]*([a-z])"
END = r"[.!?]+[ \t\r\n]+|\n"


def normalise(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


_KNOWN = {normalise(re.split(END, s)[0]): name for name, s in SENTENCES.items()}
assert len(_KNOWN) == len(SENTENCES) and all(x in SENTENCES for _, run in RULES for x in run)
assert all(any(c in s for c in CUES) for s in _KNOWN)

#: Clauses that published headers join into one sentence: the sentence -> its identifiers.
JOINT = {normalise(SENTENCES[a] + "; " + SENTENCES["Apache2not"]): (a, "Apache2not") for a in ("Apache2the", "ASFthis")}
_MARKS = _KNOWN | {s: "><".join(names) for s, names in JOINT.items()}
#: Ends of sentences and of lines in a normalised text; pieces are known sentences, over any line ends, or what is between ends.
STOP, LINE = "\x01", "\x02"
PIECE = "(?:" + "|".join(s.replace(" ", f"[ {LINE}]+") for s in sorted(_MARKS, key=len, reverse=True)) + f")(?![^{STOP}{LINE}])|[^{STOP}{LINE}]+"


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, status, licenses, sentences): matched | unknown | none; names joined by `,`, identifiers as `<a><b>`."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("__t"))
    low = F.lower("__t")
    cue = F.lit(False)
    for c in CUES:
        # the pattern is tried only where the cue's last word is
        cue = cue | (F.contains(low, F.lit(c)) if " " not in c else F.contains(low, F.lit(c.split()[-1])) & F.rlike(low, F.lit(c.replace(" ", "[^a-z0-9]+"))))
    d = d.withColumn("__t", F.when(cue, F.col("__t")).otherwise(F.lit("")))
    text = F.lower(F.regexp_replace(F.translate("__t", STOP + LINE, "  "), WRAP, "$1 $2"))
    hard, soft = END.split("|")
    text = F.regexp_replace(F.regexp_replace(text, hard, STOP), soft, LINE)
    text = F.regexp_replace(F.regexp_replace(text, f"[^a-z0-9{STOP}{LINE}]+", " "), f" ?([{STOP}{LINE}]) ?", "$1")
    pieces = F.regexp_extract_all(F.trim(text), F.lit(PIECE), F.lit(0))
    d = d.select("doc_id", F.transform(pieces, lambda s: F.trim(F.regexp_replace(s, f"{LINE}+", " "))).alias("__s"))
    known = F.create_map(*(F.lit(x) for kv in _MARKS.items() for x in kv))
    has_cue = lambda s: F.exists(F.array(*(F.lit(c) for c in CUES)), lambda c: F.contains(s, c))
    marks = F.filter(F.transform("__s", lambda s: F.coalesce(F.element_at(known, s), F.when(has_cue(s), F.lit("?")))), lambda x: x.isNotNull())
    d = d.select("doc_id", F.concat(F.lit(""), F.array_join(F.transform(marks, lambda x: F.concat(F.lit("<"), x, F.lit(">"))), "")).alias("__seq"))
    d = d.select("doc_id", F.col("__seq").alias("sentences"), F.when(F.col("__seq") != "", _matched(F.col("__seq"))).otherwise("").alias("__found"))
    return d.select("doc_id", F.when(F.col("__found") != "", "matched").when(F.col("sentences") != "", "unknown").otherwise("none").alias("status"), F.substring("__found", 2, 1 << 20).alias("licenses"), "sentences")


def _matched(seq: Column) -> Column:
    """`,name` for each licence that the rules, tried in their order, find in a sequence; what a rule uses is marked off."""
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"<{x}>" for x in run)).alias("run")) for name, run in RULES))

    def try_rule(state: Column, rule: Column) -> Column:
        seq, found = state["seq"], state["found"]
        new = F.contains(seq, rule["run"]) & ~F.contains(F.concat(found, F.lit(",")), F.concat(F.lit(","), rule["name"], F.lit(",")))
        return F.struct(F.replace(seq, rule["run"], F.lit("<>")).alias("seq"), F.when(new, F.concat(found, F.lit(","), rule["name"])).otherwise(found).alias("found"))

    return F.aggregate(rules, F.struct(seq.alias("seq"), F.lit("").alias("found")), try_rule)["found"]


def _sql() -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    cues = "|".join(c.replace(" ", "[^a-z0-9]+") for c in CUES)
    piece = "(?:" + "|".join(s.replace(" ", f"[ {LINE}]+") for s in sorted(_MARKS, key=len, reverse=True)) + f")(?:$|[{STOP}{LINE}])|[^{STOP}{LINE}]+"
    piece = q(piece.replace(STOP, r"\x01").replace(LINE, r"\x02"))
    hard, soft = END.split("|")
    sub = lambda x, a, b: f"regexp_replace({x}, {a}, {b}, 'g')"
    text = f"lower({sub('replace(replace(t, chr(1), chr(32)), chr(2), chr(32))', q(WRAP), q(chr(92) + '1 ' + chr(92) + '2'))})"
    text = sub(sub(text, q(hard), "chr(1)"), q(soft), "chr(2)")
    text = sub(text, q(r"[^a-z0-9\x01\x02]+"), "' '")
    text = sub(text, q(r" ?([\x01\x02]) ?"), q(chr(92) + "1"))
    out = f"""with known(s, id) as (values {", ".join(f"({q(s)}, {q(i)})" for s, i in _MARKS.items())}),
d as (select row_number() over () as rid, doc_id, case when regexp_matches(lower(text), {q(cues)}) then text else '' end as t from documents),
a as (select rid, regexp_extract_all(trim({text}), {piece}) as a from d where t <> ''),
p as (select rid, generate_subscripts(a, 1) as i, trim({sub("unnest(a)", q(r"[\x01\x02]+"), "' '")}) as s from a),
m as (select rid, i, coalesce(id, case when {" or ".join(f"contains(p.s, {q(c)})" for c in CUES)} then '?' end) as mark from p left join known using (s)),
g as (select rid, string_agg('<' || mark || '>', '' order by i) as seq from m where mark is not null group by rid),
r0 as (select doc_id, coalesce(seq, '') as sentences, coalesce(seq, '') as seq, '' as found from d left join g using (rid))"""
    for k, (name, run) in enumerate(RULES):
        pattern = q("".join(f"<{x}>" for x in run))
        out += f""",
r{k + 1} as (select doc_id, sentences, replace(seq, {pattern}, '<>') as seq,
  case when contains(seq, {pattern}) and not contains(found || ',', ',{name},') then found || ',{name}' else found end as found from r{k})"""
    return out + f"""
select doc_id, case when found <> '' then 'matched' when sentences <> '' then 'unknown' else 'none' end as status, substring(found, 2) as licenses, sentences from r{len(RULES)}"""


SCAN_SQL = _sql()
