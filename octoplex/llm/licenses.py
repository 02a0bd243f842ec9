"""License scans: Dice coefficient over word bigrams between normalised text and license templates.

Passages of a text are compared with templates: the whole text, each of its paragraphs and lines, and, wherever the
first two words of a template stand, the window of as many words as the template has, so that a notice or license
inside a longer line or file is found too. A passage is only compared with the templates whose number of bigrams lets
it reach the threshold, and of the licenses of a passage only the most similar counts, which tells apart those that
share most of their words. DataFrame operations only.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

THRESHOLD = 0.8

# Public license texts and the notices that licenses recommend, without their copyright lines.
_PERMISSION = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, "
    "EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
    "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_GNU = "This {} is free software{} you can redistribute it and/or modify it under the terms of the GNU {}General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
_HEAD = "GNU {}GENERAL PUBLIC LICENSE Version {}, {}"
_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
    "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, "
    "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
    "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
    "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
    "See the License for the specific language governing permissions and limitations under the License."
)
_CC = "This work is licensed under a Creative Commons {} {} International License."
_SPDX = "MIT MIT-0 ISC Apache-2.0 BSD-2-Clause BSD-3-Clause 0BSD Zlib BSL-1.0 Unlicense GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later MPL-2.0 EPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0".split()

#: Notices and license texts by SPDX identifier. A license may have several.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This software is released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", f"{_PERMISSION}, subject to the following conditions:"),
    ("MIT", f"{_PERMISSION}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    ("MIT-0", f"{_PERMISSION}. {_AS_IS}"),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_END}"),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_THIRD + _BSD_END),
    ("Zlib", _ZLIB),
    ("BSL-1.0", _BOOST),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", _UNLICENSE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0-only", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-3.0-or-later", _GNU.format("program", ":", "", ",", "3")),
    ("GPL-2.0-or-later", _GNU.format("program", ";", "", ";", "2")),
    ("LGPL-2.1-or-later", _GNU.format("library", ";", "Lesser ", ";", "2.1")),
    ("LGPL-3.0-or-later", _GNU.format("program", ":", "Lesser ", ",", "3")),
    ("AGPL-3.0-or-later", _GNU.format("program", ":", "Affero ", ",", "3")),
    ("GPL-3.0-only", f"{_HEAD.format('', '3', '29 June 2007')} {_VERBATIM}"),
    ("GPL-2.0-only", f"{_HEAD.format('', '2', 'June 1991')} {_VERBATIM}"),
    ("LGPL-3.0-only", f"{_HEAD.format('LESSER ', '3', '29 June 2007')} {_VERBATIM}"),
    ("LGPL-2.1-only", f"{_HEAD.format('LESSER ', '2.1', 'February 1999')} {_VERBATIM}"),
    ("AGPL-3.0-only", f"{_HEAD.format('AFFERO ', '3', '19 November 2007')} {_VERBATIM}"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("CC-BY-4.0", _CC.format("Attribution", "4.0")),
    ("CC-BY-SA-4.0", _CC.format("Attribution-ShareAlike", "4.0")),
    ("CC-BY-NC-4.0", _CC.format("Attribution-NonCommercial", "4.0")),
    ("CC-BY-NC-SA-4.0", _CC.format("Attribution-NonCommercial-ShareAlike", "4.0")),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    *((name, f"SPDX-License-Identifier: {name}") for name in _SPDX),
)

#: What is taken out of a text first: copyright statements at the start of a line, up to its end or the first stop.
COPYRIGHT = r"(?im)^[ \t#/*;%-]*(?:copyright|\(c\)|©)(?:[ \t]+(?:copyright|\(c\)|©))*[ \t]+[^\n.]*[0-9]{4}[^\n.]*\.?"
_PARAGRAPH = r"\n[ \t#/*;%-]*\n"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _once(column: Column) -> Column:
    """For select: evaluated here, and never again in a filter or a lambda above."""
    return F.explode(F.array(column))


def _pairs(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))


def _numbered(pairs: Column) -> Column:
    """Repeated pairs get numbers, so that the set has as many members as there are pairs."""
    number = F.transform(pairs, lambda p, i: F.concat_ws("#", p, F.nullif(F.size(F.filter(F.slice(pairs, F.lit(1), i), _equals(p))), F.lit(0))))
    return F.when(F.size(F.array_distinct(pairs)) < F.size(pairs), number).otherwise(pairs)


def _equals(p: Column):
    return lambda x: x == p


def _listed(pairs: list[str], words: list[str]):
    """Pairs of words, repeats numbered, as _pairs and _numbered make them."""
    for a, b in zip(words, words[1:], strict=False):
        pair = f"{a} {b}"
        pairs.append(f"{pair}#{n}" if (n := sum(p.partition("#")[0] == pair for p in pairs)) else pair)
    return pairs


def templates(chosen=TEMPLATES) -> list[dict]:
    """license, head (its first pair), words, size and pairs of each template; a list of fixed size."""
    out = []
    for name, body in chosen:
        words = [w for w in re.split(r"[\W_]+", body.lower()) if w]
        pairs = _listed([], words)
        out.append({"license": name, "head": pairs[0], "words": len(words), "size": len(pairs), "pairs": pairs})
    return out


_TEMPLATE = "array<struct<license:string,head:string,words:int,size:int,pairs:array<string>>>"


def _similar(known: Column, pairs: Column, threshold: float) -> Column:
    """(dice, license) of the templates in `known` that are the most similar to the pairs, if they reach the threshold."""
    size = F.size(pairs)
    each = F.transform(known, lambda t: F.struct((2 * F.size(F.array_intersect(pairs, t["pairs"])) / (size + t["size"])).alias("dice"), t["license"].alias("license")))
    return _foremost(each, threshold)


def _foremost(each: Column, threshold: float) -> Column:
    top = F.array_max(F.transform(each, lambda x: x["dice"]))
    return F.filter(each, lambda x: (x["dice"] >= threshold) & (x["dice"] == top))


def scan(docs: DataFrame, threshold: float = THRESHOLD, chosen=TEMPLATES) -> DataFrame:
    """(doc_id, license, dice): for each document and license found in it, the best coefficient over its passages.

    Dice of sets of a and b bigrams is 2 min(a, b) / (a + b) at most, so only templates with t a / (2 - t) <= b and
    b <= (2 - t) a / t are candidates, and of a passage's bigrams t a / (2 - t) at least must stand in some template.
    Of a passage only the most similar license counts; ties all do. Null and empty texts have no passages. Rows that
    share a doc_id, null ids too, are one document. Other columns are ignored.
    """
    rows = templates(chosen)
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    known = F.from_json(F.lit(json.dumps(rows)), _TEMPLATE)  # a constant of the plan, so nothing is joined
    shortest, longest = max(1, int(min(r["size"] for r in rows) * low)), int(max(r["size"] for r in rows) * high) + 1
    text = docs.select("doc_id", _once(F.regexp_replace(F.coalesce("text", F.lit("")), COPYRIGHT, "")).alias("text"))
    pieces = F.array_distinct(F.concat(F.split("text", r"\n"), F.split("text", _PARAGRAPH), F.array("text")))
    each = text.select("doc_id", F.explode(pieces).alias("passage")).where(F.char_length("passage") >= 2 * shortest + 1)
    # Exploded, so that the filters below are not merged with the cutting into words and evaluated twice.
    each = each.select("doc_id", _once(_words(F.col("passage"))).alias("w")).where(F.size("w").between(shortest + 1, longest + 1))
    listed = {p.partition("#")[0] for r in rows for p in r["pairs"]}
    each = each.select("doc_id", _once(_pairs(F.col("w"))).alias("p")).where(F.size(F.filter("p", lambda x: x.isin(listed))) >= low * F.size("p"))
    each = each.select("doc_id", _once(_numbered(F.col("p"))).alias("p"))
    size = F.size("p")
    fitting = F.filter(known, lambda t: (size >= t["size"] * low) & (size <= t["size"] * high))
    whole = each.select("doc_id", F.explode(_similar(fitting, F.col("p"), threshold)).alias("x"))
    # Windows of the templates' own sizes, cut before they are exploded, so that no row carries a whole text.
    heads, widest = {r["head"] for r in rows}, max(r["words"] for r in rows)
    words = text.select("doc_id", _once(_words(F.col("text"))).alias("w"))
    starts = F.filter(F.transform("w", lambda x, i: F.struct(i.alias("i"), F.concat_ws(" ", x, F.get("w", i + 1)).alias("head"))), lambda s: s["head"].isin(heads))
    found = words.select("doc_id", F.explode(F.transform(starts, lambda s: F.struct(s["head"].alias("head"), F.slice("w", s["i"] + 1, F.lit(widest)).alias("w")))).alias("s"))
    headed = F.filter(known, lambda t: t["head"] == F.col("s.head"))
    compared = F.transform(headed, lambda t: F.struct(_cut_dice(F.slice(F.col("s.w"), F.lit(1), t["words"]), t).alias("dice"), t["license"].alias("license")))
    inner = found.select("doc_id", F.explode(_foremost(compared, threshold)).alias("x"))
    return whole.union(inner).groupBy("doc_id", F.col("x.license").alias("license")).agg(F.max("x.dice").alias("dice"))


def _cut_dice(words: Column, t: Column) -> Column:
    pairs = _numbered(_pairs(words))
    return 2 * F.size(F.array_intersect(pairs, t["pairs"])) / (F.size(words) - 1 + t["size"])


def best(found: DataFrame) -> DataFrame:
    """Of each document's licenses the one of the highest coefficient, then the first by name."""
    order = Window.partitionBy("doc_id").orderBy(F.desc("dice"), "license")
    return found.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def op2_query(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "license", F.round("dice", 6).alias("dice"))


def _sql_pairs(w: str) -> str:
    return f"list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1] || coalesce('#' || nullif(len(list_filter(range(1, i), lambda j: {w}[j] = {w}[i] AND {w}[j + 1] = {w}[i + 1])), 0), ''))"


_VALUES = ", ".join("({}, '{}', '{}')".format(k, name, body.replace("'", "''")) for k, (name, body) in enumerate(TEMPLATES))
_SQL_WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_LOW, _HIGH = THRESHOLD / (2 - THRESHOLD), (2 - THRESHOLD) / THRESHOLD
OP2_SQL = rf"""
WITH t AS (SELECT template, license, {_SQL_WORDS.format('body')} AS tw FROM (VALUES {_VALUES}) v(template, license, body)),
tp AS (SELECT *, {_sql_pairs('tw')} AS tp, tw[1] || ' ' || tw[2] AS head FROM t),
x AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{COPYRIGHT}', '', 'g') AS text FROM documents),
p AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '{_PARAGRAPH}'), [text])) AS passage FROM x),
pw AS (SELECT doc_id, passage, {_SQL_WORDS.format('passage')} AS w FROM p),
pp AS (SELECT doc_id, passage, {_sql_pairs('w')} AS pp FROM pw WHERE len(w) BETWEEN 2 AND (SELECT max(len(tp)) * {_HIGH} + 2 FROM tp)),
pd AS (SELECT doc_id, passage AS spot, license, 2.0 * len(list_intersect(pp, tp)) / (len(pp) + len(tp)) AS dice FROM pp, tp WHERE len(pp) >= {_LOW} * len(tp) AND len(pp) <= {_HIGH} * len(tp)),
w AS (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM (SELECT doc_id, {_SQL_WORDS.format('text')} AS w FROM x)),
ww AS (SELECT doc_id, i, license, tp, w[i : i + len(tw) - 1] AS v FROM w JOIN tp ON w[i] || ' ' || w[i + 1] = head),
wd AS (SELECT doc_id, CAST(i AS VARCHAR) AS spot, license, 2.0 * len(list_intersect({_sql_pairs('v')}, tp)) / (len(v) - 1 + len(tp)) AS dice FROM ww),
d AS (SELECT doc_id, license, dice, max(dice) OVER (PARTITION BY k, doc_id, spot) AS top FROM (SELECT 0 AS k, * FROM pd UNION ALL SELECT 1, * FROM wd))
SELECT doc_id, license, round(max(CAST(dice AS DOUBLE)), 6) AS dice FROM d WHERE dice = top AND dice >= {THRESHOLD} GROUP BY 1, 2
"""
