"""Which licence a text, a paragraph or a line of it states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Public licence notices and texts, as their owners publish them.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file"
        " except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in"
        " writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT"
        " WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the"
        " specific language governing permissions and limitations under the License."
    ),
    "MIT notice": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
        " and associated documentation files (the \"Software\"), to deal in the Software without"
        " restriction, including without limitation the rights to use, copy, modify, merge, publish,"
        " distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
        " Software is furnished to do so, subject to the following conditions: The above copyright"
        " notice and this permission notice shall be included in all copies or substantial portions of"
        " the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR"
        " IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A"
        " PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE"
        " LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR"
        " OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER"
        " DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or"
        " without fee is hereby granted, provided that the above copyright notice and this permission"
        " notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL"
        " WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY"
        " AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR"
        " CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,"
        " WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN"
        " CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0 header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the"
        " GNU General Public License as published by the Free Software Foundation, either version 3 of"
        " the License, or (at your option) any later version. This program is distributed in the hope"
        " that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of"
        " MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for"
        " more details. You should have received a copy of the GNU General Public License along with"
        " this program. If not, see https://www.gnu.org/licenses/."
    ),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy"
        " of the MPL was not distributed with this file, You can obtain one at"
        " https://mozilla.org/MPL/2.0/."
    ),
    "BSD notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 header": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all rights reserved": "All rights reserved.",
}

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> list[str]:
    low = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower())
    return low.split()


def template_grams(templates: dict[str, str] | None = None) -> dict[str, list[str]]:
    """Distinct word bigrams of each template, of those that have any."""
    templates = TEMPLATES if templates is None else templates
    grams = {}
    for name, text in templates.items():
        words = _words(text)
        pairs = sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})
        if pairs:
            grams[name] = pairs
    return grams


def _units(text: Column) -> Column:
    """Lines, paragraphs and the whole text in lower case, words parted by spaces."""
    low = F.translate(text, _UPPER, _LOWER)
    plain = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9\n]+", " "), "(?m)^ +| +$", "")
    return F.transform(
        F.array(plain),
        lambda t: F.array_distinct(
            F.concat(F.split(t, "\n"), F.split(t, "\n\n+"), F.array(t))
        ),
    )[0]


def _gram_sets(units: Column, least: int) -> Column:
    """Distinct bigrams of each unit, null for those too short for any template."""

    def grams(words: Column) -> Column:
        pair = lambda i: F.concat(words[i], F.lit(" "), words[i + 1])
        every = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - 2), pair))
        return F.when(F.size(words) > least, every)

    def words_of(unit: Column) -> Column:
        return F.filter(F.split(unit, "[ \n]+"), lambda w: w != "")

    return F.transform(units, lambda u: F.transform(F.array(words_of(u)), grams)[0])


def scan_licences(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The licence that each text states best, and how many of its parts state one.

    A text's units are its lines, its paragraphs (parted by empty lines) and
    the whole; equal units count once. Text and templates are normalised alike:
    A-Z in lower case, all but a-z and 0-9 a gap. A unit states a template if
    the Dice coefficient of their sets of word bigrams is ``threshold`` or more.
    A template can only reach it if the sizes of both sets are within a factor
    of ``(2 - threshold) / threshold``, so others are not compared; nor are units
    too short for all templates turned into bigrams.

    Columns ``doc_id, license, dice, n_units``: the best template (ties: the name
    that sorts last), its coefficient, and the units that state some template.
    A null or empty text, or one that states none, has null, null and 0. One row
    per row, all in one narrow pass without a shuffle; the templates are literals
    of the plan.
    """
    known = template_grams(templates)
    reach = threshold / (2 - threshold)
    least = min((reach * len(g) for g in known.values()), default=0)
    found = "array<struct<dice:double,name:string>>"
    if known:
        table = F.array(
            *[
                F.struct(F.lit(name).alias("name"), F.lit(len(g)).alias("n"), F.array(*map(F.lit, g)).alias("grams"))
                for name, g in known.items()
            ]
        )

        def dice(grams: Column, t: Column) -> Column:
            shared = F.size(F.array_intersect(grams, t["grams"]))
            return 2.0 * shared / (F.size(grams) + t["n"])

        def best(grams: Column) -> Column:
            fits = F.filter(
                table,
                lambda t: (F.size(grams) >= reach * t["n"]) & (F.size(grams) * reach <= t["n"]),
            )
            scores = F.transform(fits, lambda t: F.struct(dice(grams, t).alias("dice"), t["name"].alias("name")))
            return F.array_max(scores)

        sets = F.filter(_gram_sets(_units(F.col(text_col)), max(1, int(least))), lambda g: g.isNotNull())
        stated = F.filter(F.transform(sets, best), lambda b: b["dice"] >= threshold)
    else:
        stated = F.lit(None).cast(found)
    scored = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(stated, F.array().cast(found)).alias("stated")
    )
    return scored.select(
        "doc_id",
        F.array_max("stated")["name"].alias("license"),
        F.array_max("stated")["dice"].alias("dice"),
        F.size("stated").cast("long").alias("n_units"),
    )


def licence_sql(threshold: float = THRESHOLD) -> str:
    """The same over ``documents`` in SQL, with the built-in templates."""
    rows = ", ".join(
        "('{}', [{}])".format(name, ", ".join(f"'{g}'" for g in grams))
        for name, grams in template_grams().items()
    )
    return f"""
WITH templates(name, grams) AS (VALUES {rows}),
plain AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_replace(regexp_replace(translate(text, '{_UPPER}', '{_LOWER}'), '[^a-z0-9\\n]+', ' ', 'g'),
            '(?m)^ +| +$', '', 'g') AS t
    FROM documents
), units AS (
    SELECT r, unnest(list_distinct(list_concat(string_split(t, chr(10)),
        list_concat(string_split_regex(t, '\\n\\n+'), [t])))) AS u
    FROM plain WHERE t IS NOT NULL
), words AS (
    SELECT r, list_filter(regexp_split_to_array(u, '[ \\n]+'), lambda w: w <> '') AS w FROM units
), sets AS (
    SELECT r, list_distinct(list_transform(range(1, len(w)),
        lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1
), best AS (
    SELECT s.r, s.g, max({{'dice': 2.0::DOUBLE * len(list_intersect(s.g, t.grams)) / (len(s.g) + len(t.grams)),
        'name': t.name}}) AS b
    FROM (SELECT row_number() OVER () AS k, * FROM sets) s JOIN templates t
        ON len(s.g) >= {threshold / (2 - threshold)!r} * len(t.grams)
        AND len(s.g) * {threshold / (2 - threshold)!r} <= len(t.grams)
    GROUP BY s.k, s.r, s.g
), stated AS (
    SELECT r, max(b) AS b, count(*) AS n FROM best WHERE b.dice >= {threshold} GROUP BY r
)
SELECT doc_id, b.name AS license, round(b.dice, 6) AS dice, coalesce(n, 0) AS n_units
FROM plain LEFT JOIN stated USING (r)
"""
