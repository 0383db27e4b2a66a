"""Licence scans: TF-IDF cosine of headers and licence files to templates, then inheritance along directories."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.shared import small_or_stored, stored

#: Texts of common licences and the notices that name them.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
)
_MIT_END = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS "
    "FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER "
    "IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies. "
)
_ISC_END = (
    "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
    "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_ADVERTISING = (
    "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. "
)
_ZLIB = (
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
)
_ZLIB_END = (
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product "
    "documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
    "3. This notice may not be removed or altered from any source distribution."
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, "
    "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, "
    "all subject to the following: "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF "
    "USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Licence, the terms that a unit must have to meet the template, text.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("Apache-2.0", "2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "mit", "Released under the MIT License."),
    ("MIT", "mit", "The MIT License"),
    ("MIT", "granted charge", _MIT[:138]),
    ("MIT", "granted charge", _MIT),
    ("MIT", "granted charge", _MIT + _MIT_END),
    ("ISC", "fee", _ISC),
    ("ISC", "fee", _ISC + _ISC_END),
    ("ISC", "isc", "ISC License"),
    ("BSD", "redistribution", _BSD),
    ("BSD-2-Clause", "redistribution", _BSD + _BSD_TWO + _BSD_END),
    ("BSD-3-Clause", "endorse", _BSD_THIRD),
    ("BSD-3-Clause", "redistribution endorse", _BSD + _BSD_TWO + _BSD_THIRD + _BSD_END),
    ("BSD-4-Clause", "advertising acknowledgement", _BSD_ADVERTISING),
    ("BSD-4-Clause", "redistribution advertising", _BSD + _BSD_TWO + _BSD_ADVERTISING),
    ("BSD-4-Clause", "redistribution advertising endorse", _BSD + _BSD_TWO + _BSD_ADVERTISING + _BSD_THIRD.replace("3.", "4.") + _BSD_END),
    ("Zlib", "misrepresented", _ZLIB + _ZLIB_END),
    ("Zlib", "alter freely", _ZLIB),
    ("Zlib", "zlib", "zlib License"),
    ("BSL-1.0", "boost 1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("BSL-1.0", "boost 1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "boost 1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BSL-1.0", "transmit derivative third-parties", _BOOST),
    ("CC0-1.0", "cc0 1.0", "CC0 1.0 Universal"),
    ("CC0-1.0", "cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal."),
    ("CC0-1.0", "waived neighboring", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, published under the CC0 Public Domain Dedication."),
    ("MPL-1.1", "1.1 mozilla", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
    ("MPL-1.1", "1.1 mozilla", "Mozilla Public License Version 1.1"),
    ("MPL-2.0", "2.0 mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "2.0 mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
     "You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "2.0 mozilla", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "4.0 cc", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "4.0 attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "4.0 by-sa", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "4.0 sharealike", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "4.0 by-nc", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "4.0 noncommercial", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."),
    ("Unlicense", "unencumbered", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "rights reserved", "All rights reserved."),
    ("proprietary", "rights reserved", "Copyright (c) All rights reserved."),
)
#: The GNU licences: name, title, what it covers, version, date of the text.
GNU = (
    ("GPL-1.0", "GNU General Public License", "program", "1", "February 1989"),
    ("GPL-2.0", "GNU General Public License", "program", "2", "June 1991"),
    ("GPL-3.0", "GNU General Public License", "program", "3", "29 June 2007"),
    ("LGPL-2.0", "GNU Library General Public License", "library", "2", "June 1991"),
    ("LGPL-2.1", "GNU Lesser General Public License", "library", "2.1", "February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License", "library", "3", "29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License", "program", "3", "19 November 2007"),
)
#: Terms that tell members of a family apart; a unit meets only templates that have those it has.
FAMILY = ("lesser", "affero", "library-general", "advertising", "endorse", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd", "sharealike", "noncommercial", "noderivatives")
#: Stop words; they are no terms.
COMMON = frozenset("a all and any are by can in is it may of or the this to under use v with without you".split())
#: Names that licence files have, and what any notice of a licence mentions.
FILE_NAMES = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
NOTICE = r"(?i)(licen[cs]|permission|permitted|rights reserved|public domain|free software|redistribut|endorse|gpl|cc0|waived)"
#: What says that a licence does not hold; and licences put together, which are kept as they are written.
NEGATED = r"(?i)(\bnot|\bnever|n't) +(been +|being +|be +)?(released|licensed|distributed|available|offered|covered|published) +(under|by) [^.\n]*"
COMPOUND = r"(?i:spdx|spdx-license-identifier|license): *(\(?[A-Za-z0-9.+-]+(?: +(?:AND|OR|WITH) +\(?[A-Za-z0-9.+-]+\)?)+)"
#: Fixed value: words of a name that make one term.
_LIBRARY = r"(?i)\blibrary\s+general\s+public"
_TERM = r"[\p{L}\p{N}]+([.-][\p{L}\p{N}]+)*"
_COMMENT = r"(?s)/\*.*?\*/"
_MARKED = r"^[ \t]*(#|//|/\*|\*|--|;|%|<!--)"


def all_templates() -> tuple[tuple[str, str, str], ...]:
    """The templates above, those of the GNU licences, and one-line tags for every licence."""
    out = list(TEMPLATES)
    for name, title, covered, v, date in GNU:
        kind = title.split()[1].lower()
        own = f"{'library-general' if kind == 'library' else kind} {v}"
        freely = f"This {covered} is free software: you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation, "
        out += [
            (name, own, f"{title} Version {v}"), (name, own, f"{title} Version {v}, {date}"), (name, own, f"This work is licensed under the {title}, version {v}."),
            (name, own, freely + f"either version {v} of the License, or (at your option) any later version."),
            (name, own, freely + f"either version {v} of the License, or (at your option) any later version. This {covered} is distributed in the hope that it will be useful, but WITHOUT ANY "
             f"WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {title} for more details. You should have received a copy of the {title} "
             f"along with this {covered}. If not, see https://www.gnu.org/licenses/."),
        ]
    for name in sorted({t[0] for t in out} - {"proprietary", "BSD"}):
        for tag in [name, f"{name}-only", f"{name}-or-later"] if "GPL" in name else [name]:
            out += [(name, tag.lower(), f"SPDX-License-Identifier: {tag}"), (name, tag.lower(), f"License: {tag}")]
    return tuple(out)


def _terms(text: str) -> list[str]:
    text = re.sub(_LIBRARY, "library-general public", text).lower()
    return [m[0] for m in re.finditer(r"[^\W_]+(?:[.-][^\W_]+)*", text) if m[0] not in COMMON]


def _terms_of(text: Column) -> Column:
    stop = F.array(*[F.lit(x) for x in sorted(COMMON)])
    return F.filter(F.regexp_extract_all(F.lower(F.regexp_replace(text, _LIBRARY, "library-general public")), F.lit(_TERM), 0), lambda t: ~F.array_contains(stop, t))


@dataclass
class Template:
    licence: str
    must: list[str]
    terms: list[str]
    norm: float


class Weights:
    """Squared inverse document frequencies over the templates, and the templates themselves."""

    def __init__(self, templates: tuple[tuple[str, str, str], ...] | None = None):
        templates = all_templates() if templates is None else templates
        found = [sorted(set(_terms(t))) for _, _, t in templates]
        n, df = len(found), Counter(t for x in found for t in x)
        self.unseen = (math.log(1 + n) + 1) ** 2
        self.squares = dict.fromkeys(FAMILY, self.unseen) | {t: (math.log((1 + n) / (1 + d)) + 1) ** 2 for t, d in sorted(df.items())}
        self.templates = [Template(name, must.split(), x, math.sqrt(sum(self.squares[t] for t in x))) for (name, must, _), x in zip(templates, found, strict=True)]


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in values]).cast("array<string>")


def _units(text: Column) -> Column:
    """What is compared: the lines, sentences, paragraphs and comments that may be notices, and the whole text."""
    lines = F.split(text, "\n", -1)

    def bare(x: Column) -> Column:
        return F.regexp_replace(x, r"^[^\p{L}\p{N}]+", "")

    paragraphs = F.transform(F.split(F.array_join(F.transform(lines, bare), "\n"), "\n\n+", -1), lambda p: F.replace(p, F.lit("\n"), F.lit(" ")))
    sentences = F.flatten(F.transform(F.filter(paragraphs, lambda p: p.rlike(NOTICE)), lambda p: F.split(F.regexp_replace(p, r"([.!?][\"')]*) +([\p{Lu}(])", "$1\n$2"), "\n", -1)))
    comments = F.split(F.array_join(F.transform(lines, lambda x: F.when(x.rlike(_MARKED), x).otherwise(F.lit("\x01"))), "\n"), "\x01", -1)
    found = F.concat(F.transform(lines, bare), sentences, paragraphs, comments, F.regexp_extract_all(text, F.lit(_COMMENT), 0), F.array(text))
    return F.array_distinct(F.filter(found, lambda x: x.rlike(NOTICE)))


def _best_match(text: Column, w: Weights, least: float) -> Column:
    """(grant, evidence, score, licence, size) of the best unit of the text, or null."""
    written, text = text, F.regexp_replace(text, NEGATED, " ")
    vocabulary, family = _strings(list(w.squares)), _strings(list(FAMILY))
    squares = F.create_map(*[F.lit(x) for pair in w.squares.items() for x in pair])
    templates = F.array(*[
        F.struct(F.lit(t.licence).alias("licence"), _strings(t.must).alias("must"), _strings(t.terms).alias("terms"), F.lit(t.norm).alias("norm"))
        for t in w.templates
    ])

    def weigh(unit: Column) -> Column:
        """Of a unit: its numbers of terms and of distinct ones, and those of the vocabulary with their squared weights."""
        return F.transform(F.array(_terms_of(unit)), lambda t: F.struct(
            F.size(t).alias("size"), F.size(F.array_distinct(t)).alias("n"), F.transform(F.array_intersect(t, vocabulary), lambda x: F.struct(x.alias("t"), F.element_at(squares, x).alias("w"))).alias("known")
        ))[0]

    def total(known: Column) -> Column:
        return F.aggregate(known, F.lit(0.0), lambda a, x: a + x["w"])

    def judged(u: Column) -> Column:
        """(n, known, norm, names) of a unit that some template may be near, by Cauchy-Schwarz, else null."""
        own = total(u["known"])
        norm = own + (u["n"] - F.size(u["known"])) * F.lit(w.unseen)
        return F.when(own >= (least * least - 1e-9) * norm, F.struct(u["size"].alias("size"), u["n"].alias("n"), u["known"].alias("known"), F.sqrt(norm).alias("norm"), u["known"]["t"].alias("names")))

    def score(u: Column, t: Column) -> Column:
        fits = F.forall(t["must"], lambda x: F.array_contains(u["names"], x)) & F.forall(
            F.array_intersect(u["names"], family), lambda x: F.array_contains(t["terms"], x)
        )
        near = F.round(total(F.filter(u["known"], lambda x: F.array_contains(t["terms"], x["t"]))) / (u["norm"] * t["norm"]), 6)
        return F.when(fits, F.struct((t["licence"] != "proprietary").alias("grant"), F.round(near * u["n"], 6).alias("evidence"), near.alias("score"), t["licence"].alias("licence"), u["size"].alias("size")))

    units = F.filter(F.transform(F.transform(_units(text), weigh), judged), lambda u: u.isNotNull())
    found = F.flatten(F.transform(units, lambda u: F.transform(templates, lambda t: score(u, t))))
    compound = F.regexp_extract(written, COMPOUND, 1)
    whole = F.struct(F.lit(True).alias("grant"), F.lit(1.0).alias("evidence"), F.lit(1.0).alias("score"), compound.alias("licence"), F.size(_terms_of(compound)).alias("size"))
    return F.when(compound != "", whole).when(text.rlike(NOTICE), F.array_max(F.filter(found, lambda m: m["score"] >= least)))


def scan_licences(
    files: DataFrame, path: Column, least: float = 0.6, templates: tuple[tuple[str, str, str], ...] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per file: doc_id, path, licence, origin, score, licence_dir.

    Units of the whole text are compared with the templates by the cosine of
    TF-IDF vectors (a term counts once; frequencies over the templates, unseen
    terms weigh most): its lines, its sentences, its paragraphs, its comments
    (runs of marked lines, and C comments) and all of it, where they mention what every notice
    does (NOTICE). A unit meets a template only if it has the terms that decide
    (versions, names) and no term of another member of the family. Of all
    matches from ``least`` on, that with the most evidence (score times distinct
    terms of the unit) gives the licence, then the higher score, then the later name; a
    bare rights notice gives way to any grant. What a text says it is not
    licensed under is left out. A tag of several licences with AND, OR or WITH
    gives that expression as it is written, with score 1. Licences that have no
    template are not named.

    origin is ``file`` where the name says so or the unit has at least half of
    the text's terms, else ``header``. A file without a licence of its own
    inherits that of the nearest ancestor directory which has a licence file
    (``inherited``, the best match in it), else has ``none`` with nulls.

    The comparison is one narrow pass with no shuffle, linear in the length of a
    text, very long ones and lines included; its verdicts are stored.
    Directories are reduced to one row each before ancestors are joined. Files
    then join their directory: by broadcast if there are few, else by a shuffle
    in which a directory with a third of all files can be split.

    Null or empty text has no licence of its own. A null path counts as the root
    directory. Repeated rows are rows of their own; ids may be null. Other
    columns are ignored. An empty table gives no rows.
    """
    w = Weights(templates)
    rows = files.select(F.col(id_col).alias("id"), F.coalesce(path, F.lit("")).alias("path"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("own", _best_match(F.col("text"), w, least))
    rows = rows.withColumns({"dir": F.regexp_extract("path", "^(.*)/[^/]*$", 1), "name": F.regexp_extract("path", "([^/]*)$", 1)})
    whole = F.when(F.col("own").isNotNull(), 2 * F.col("own.size") >= F.size(_terms_of(F.col("text"))))
    is_file = F.col("own").isNotNull() & (F.col("name").rlike(FILE_NAMES) | whole)
    rows = stored(rows.select("id", "path", "dir", "own", F.coalesce(is_file, F.lit(False)).alias("is_file")), "licences")

    given = rows.where("is_file").groupBy("dir").agg(F.max("own").alias("given"))
    depths = F.when(F.col("dir") == "", F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.size(F.split("dir", "/"))))
    ancestors = rows.select("dir").distinct().select("dir", F.explode(depths).alias("depth"))
    ancestors = ancestors.withColumn("above", F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("substring_index(dir, '/', depth)")))
    nearest = ancestors.join(given.withColumnRenamed("dir", "above"), "above").groupBy("dir").agg(F.max(F.struct("depth", "above", "given")).alias("near"))
    out = rows.join(small_or_stored(nearest, "nearest"), "dir", "left")
    own = F.col("own").isNotNull()
    return out.select(
        F.col("id").alias(id_col), "path",
        F.when(own, F.col("own.licence")).otherwise(F.col("near.given.licence")).alias("licence"),
        F.when(F.col("is_file"), "file").when(own, "header").when(F.col("near").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(own, F.col("own.score")).otherwise(F.col("near.given.score")).alias("score"),
        F.when(~own, F.col("near.above")).alias("licence_dir"),
    )


def document_path() -> Column:
    """Where a document of the test tables would lie: source, language, id."""
    return F.concat_ws("/", F.col("source"), F.col("lang"), F.col("doc_id").cast("string"))


def oracle(least: float = 0.6, templates: tuple[tuple[str, str, str], ...] | None = None) -> str:
    """The scan over ``documents`` as DuckDB SQL."""
    w = Weights(templates)
    quoted = lambda values: "[" + ", ".join(f"'{x}'" for x in values) + "]::varchar[]"
    squares = ", ".join(f"('{t}', {x!r}::double)" for t, x in w.squares.items())
    temps = ", ".join(f"({i}, '{t.licence}', {quoted(t.must)}, {quoted(t.terms)}, {t.norm!r}::double)" for i, t in enumerate(w.templates))
    stop = ", ".join(f"'{t}'" for t in sorted(COMMON))
    terms = f"list_filter(regexp_extract_all(lower(regexp_replace(X, '{_LIBRARY}', 'library-general public', 'g')), '{_TERM}'), lambda t: t not in ({stop}))"
    negated = NEGATED.replace("'", "''")
    return rf"""with q(t, x) as (values {squares}), tp(i, licence, must, terms, norm) as (values {temps}),
 d as (select doc_id, concat_ws('/', source, lang, cast(doc_id as varchar)) as path, concat_ws('/', source, lang) as dir, coalesce(text, '') as text from documents),
 n as (select doc_id, regexp_replace(text, '{negated}', ' ', 'g') as text from d),
 c as (select doc_id, regexp_extract(text, '{COMPOUND}', 1) as whole from d where regexp_matches(text, '{COMPOUND}')),
 l as (select doc_id, text, string_split(text, chr(10)) as lines, list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[^\p{{L}}\p{{N}}]+', '')) as bare
  from n where regexp_matches(text, '{NOTICE}')),
 p as (select *, list_transform(string_split_regex(array_to_string(bare, chr(10)), '\n\n+'), lambda x: replace(x, chr(10), ' ')) as paragraphs from l),
 u as (select doc_id, unnest(list_distinct(list_filter(list_concat(bare,
   flatten(list_transform(list_filter(paragraphs, lambda x: regexp_matches(x, '{NOTICE}')), lambda x: string_split(regexp_replace(x, '([.!?]["'')]*) +([\p{{Lu}}(])', '\1' || chr(10) || '\2', 'g'), chr(10)))),
   paragraphs, string_split(array_to_string(list_transform(lines, lambda x: case when regexp_matches(x, '{_MARKED}') then x else chr(1) end), chr(10)), chr(1)),
   regexp_extract_all(text, '{_COMMENT}'), [text]),
   lambda x: regexp_matches(x, '{NOTICE}')))) as unit from p),
 k as (select doc_id, row_number() over () as r, {terms.replace("X", "unit")} as each, list_distinct(each) as ts from u),
 e as (select r, unnest(ts) as t from k),
 g as (select k.r, any_value(doc_id) as doc_id, any_value(len(ts)) as n, any_value(len(each)) as size, any_value(ts) as ts, sqrt(sum(coalesce(x, {w.unseen!r}::double))) as norm from k join e on k.r = e.r left join q on e.t = q.t group by 1),
 m as (select g.r, g.doc_id, n, size, licence, round(sum(x) / (g.norm * tp.norm), 6) as score from g, tp, unnest(list_intersect(ts, terms)) as z(t) join q on q.t = z.t
  where list_has_all(ts, must) and list_has_all(terms, list_intersect(ts, {quoted(FAMILY)})) group by g.r, g.doc_id, n, size, tp.i, licence, g.norm, tp.norm),
 o as (select doc_id, max({{'g': licence <> 'proprietary', 'evidence': round(score * n, 6), 'score': score, 'licence': licence, 'size': size}}) as own from m
   where score >= {least} and doc_id not in (select doc_id from c) group by 1
  union all select doc_id, {{'g': true, 'evidence': 1.0::double, 'score': 1.0::double, 'licence': whole, 'size': len({terms.replace("X", "whole")})}} from c),
 r as (select d.doc_id, path, dir, own, coalesce(2 * own.size >= len({terms.replace("X", "text")}), false) as is_file from d left join o on d.doc_id = o.doc_id),
 h as (select dir, max(own) as given from r where is_file group by 1),
 a as (select dir, unnest(generate_series(0, len(string_split(dir, '/')))) as depth from (select distinct dir from r)),
 v as (select dir, depth, array_to_string(string_split(dir, '/')[1:depth], '/') as above from a),
 f as (select v.dir, arg_max(v.above, depth) as above, arg_max(given, depth) as given from v join h on v.above = h.dir group by 1)
 select doc_id, path, coalesce(own.licence, given.licence) as licence,
  case when is_file then 'file' when own is not null then 'header' when given is not null then 'inherited' else 'none' end as origin,
  coalesce(own.score, given.score) as score, case when own is null then f.above end as licence_dir
 from r left join f on r.dir = f.dir"""
