"""Operator 2, licence scans [native]: text units against licence templates by Dice coefficient over word bigrams.

A text is lower-cased and everything but letters, digits and line ends becomes a space. Its units are its lines, its
paragraphs (parted by blank lines) and the whole text, so that both a notice inside a document and a licence file are
found. A unit and a template are compared by ``2 * |A & B| / (|A| + |B|)`` over their sets of word bigrams. A Dice value
of ``t`` or more needs ``t/(2-t) * |B| <= |A| <= (2-t)/t * |B|``; those size bounds prune the templates of a unit.

Templates are a parameter (name and text, a few dozen rows in the plan as literals). There is no shuffle: a row is
scanned alone. Null and empty texts have no licence; very long ones are scanned whole. Ties go to the template whose name
sorts first; repeated rows get equal results. Other columns pass through; one named ``licenses`` is replaced. An empty table
gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_mark, table

THRESHOLD = 0.8

#: Public licence texts and the notices that stand for them. ``name/variant``.
TEMPLATES: Mapping[str, str] = {
    "mit/notice": "Released under the MIT License.",
    "mit/licensed": "This project is licensed under the terms of the MIT license.",
    "mit/text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0/header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
        "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
        "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language "
        "governing permissions and limitations under the License."
    ),
    "gpl-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0/header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details. You should have received a copy of the GNU General Public License along with this program. If not, see "
        "https://www.gnu.org/licenses/."
    ),
    "gpl-2.0/notice": "Licensed under the GNU General Public License, version 2.",
    "lgpl-2.1/notice": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "agpl-3.0/notice": "Licensed under the GNU Affero General Public License, version 3.",
    "mpl-2.0/header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "bsd-3-clause/notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "isc/text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
        "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, "
        "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION "
        "OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS "
        "SOFTWARE."
    ),
    "unlicense/text": "This is free and unencumbered software released into the public domain.",
    "cc0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "cc-by-4.0/notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0/notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0/notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-nd-4.0/notice": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by-4.0/long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0/long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc-4.0/long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "all-rights-reserved/notice": "Copyright. All rights reserved.",
}


def template_bigrams(text: str) -> list[tuple[str, str]]:
    """The distinct word bigrams of a template, in order."""
    words = re.sub(r"[\W_]+", " ", text.lower()).split()
    return list(dict.fromkeys(zip(words, words[1:])))


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")


def scan(df: DataFrame, text: str = "text", templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``licenses`` to every row: array of (dice, license, n_bigrams), one for each unit at or over the threshold, best first."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be in (0, 1]")
    grams = {name: template_bigrams(t) for name, t in sorted(templates.items())}
    grams = {name: g for name, g in grams.items() if g}
    if not grams:
        raise ValueError("no template has two words")
    low, high = threshold / (2 - threshold) - 1e-9, (2 - threshold) / threshold + 1e-9  # a bound met exactly is met
    least, most = low * min(map(len, grams.values())), high * max(map(len, grams.values()))
    known = F.array(
        *(
            F.struct(F.lit(name).alias("name"), F.lit(len(g)).alias("n"), F.array(*(F.xxhash64(F.lit(a), F.lit(b)) for a, b in g)).alias("grams"))
            for name, g in grams.items()
        )
    )
    own, m = [F.col(f"`{c}`") for c in df.columns if c != "licenses"], fresh_mark(df.columns)
    step = df.select(*own, normalised(F.col(f"`{text}`")).alias(f"{m}norm"))
    units = F.array_distinct(F.concat(F.split(f"{m}norm", "\n"), F.split(f"{m}norm", r"\n *\n[ \n]*"), F.array(F.col(f"{m}norm"))))
    step = step.select(*own, F.transform(units, lambda u: F.split(F.btrim(u, F.lit(" \n")), r"[ \n]+")).alias(f"{m}units"))
    step = step.select(*own, F.filter(f"{m}units", lambda w: F.size(w) - 1 >= least).alias(f"{m}units"))
    bigrams = F.transform(
        f"{m}units", lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.xxhash64(a, b)))
    )
    step = step.select(*own, F.filter(bigrams, lambda g: F.size(g).between(least, most)).alias(f"{m}units"))

    def best(g: Column) -> Column:
        near = F.filter(known, lambda t: F.size(g).between(low * t["n"], high * t["n"]))
        scored = F.transform(
            near,
            lambda t: F.struct(
                (-2.0 * F.size(F.array_intersect(g, t["grams"])) / (F.size(g) + t["n"])).alias("minus_dice"), t["name"].alias("license"), F.size(g).alias("n_bigrams")
            ),
        )
        return F.array_min(scored)

    step = step.select(*own, F.transform(f"{m}units", best).alias(f"{m}best"))
    hits = F.filter(f"{m}best", lambda b: b["minus_dice"] <= -threshold)
    return step.select(*own, F.transform(F.sort_array(hits), lambda b: F.struct((-b["minus_dice"]).alias("dice"), b["license"].alias("license"), b["n_bigrams"].alias("n_bigrams"))).alias("licenses"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, license, dice, n_matches``: the best template of each document (null: none) and the number of matching units."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    best = F.get("licenses", F.lit(0))
    return scan(docs).select("doc_id", best["license"].alias("license"), best["dice"].alias("dice"), F.size("licenses").cast("long").alias("n_matches"))


_ROWS = ", ".join(f"('{n}', [{', '.join(repr(f'{a} {b}') for a, b in template_bigrams(t))}])" for n, t in sorted(TEMPLATES.items()))
OP2_SQL = rf"""
WITH t(name, grams) AS (VALUES {_ROWS}),
n AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS norm FROM documents),
u AS (SELECT doc_id, unnest(list_distinct(list_concat(string_split(norm, chr(10)), regexp_split_to_array(norm, '\n *\n[ \n]*'), [norm]))) AS unit FROM n),
w AS (SELECT doc_id, row_number() OVER () AS k, regexp_split_to_array(trim(unit, ' ' || chr(10)), '[ \n]+') AS ws FROM u),
g AS (SELECT doc_id, k, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS grams FROM w WHERE len(ws) >= 2),
s AS (SELECT doc_id, k, t.name, 2.0 * len(list_intersect(g.grams, t.grams)) / (len(g.grams) + len(t.grams)) AS dice, len(g.grams) AS nb
      FROM g JOIN t ON len(g.grams) BETWEEN len(t.grams) * ({THRESHOLD / (2 - THRESHOLD)!r} - 1e-9) AND len(t.grams) * ({(2 - THRESHOLD) / THRESHOLD!r} + 1e-9)),
b AS (SELECT * FROM s WHERE dice >= {THRESHOLD} QUALIFY row_number() OVER (PARTITION BY doc_id, k ORDER BY dice DESC, name) = 1),
d AS (SELECT doc_id, first(name ORDER BY dice DESC, name) AS license, max(dice)::DOUBLE AS dice, count(*) AS n FROM b GROUP BY doc_id)
SELECT documents.doc_id, d.license, d.dice, coalesce(d.n, 0)::BIGINT AS n_matches FROM documents LEFT JOIN d ON d.doc_id = documents.doc_id
"""
