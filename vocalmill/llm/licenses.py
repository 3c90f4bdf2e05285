"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Words are runs of ASCII letters, digits and non-ASCII characters of the lower-cased text.  A text's content is its
lines that have words and don't begin with the word copyright; every window of consecutive content lines, from one
line to the whole text, is a piece.  The coefficient is twice the number of common distinct bigrams by the sum of
both numbers.  Of the windows that are like a template, the most alike are reported, as many as don't overlap, so
licences that follow one another, or are repeated, are found one by one.

Windows are pruned by bounds that lose nothing.  With threshold t, n bigrams in the window and m in the template, of
which c are common: c >= t (n + m) / 2 and c <= m, so the bigrams of the window that no template has are at most
(2 / t - 2) m, and the others at least t n / (2 - t).  A window whose first or last line adds no template bigram is
never reported, as it scores less without that line, or the same with fewer lines.  Nothing is shuffled; the templates
are a fixed table of a few kilobytes.

Defined cases: a null or empty text has no pieces; a window of fewer than two words has no bigram; of equal scores the
window of fewer lines, then the one that begins first, then the template whose name sorts first is reported; a very long
text is scanned whole, a window at a time; repeated rows get repeated results; an empty table gives an empty result;
only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C
from .decontamination import words_of

THRESHOLD = 0.8
#: Characters of all templates together; more is no table to give to every executor.
MAX_TEMPLATE_CHARS = 16_000_000

# Names of licences that are commonly stated in one sentence, with their identifiers.
STATED = {
    "MIT License": "MIT",
    "Apache License, Version 2.0": "Apache-2.0",
    "GNU General Public License, version 2": "GPL-2.0",
    "GNU General Public License, version 3": "GPL-3.0",
    "GNU Lesser General Public License, version 2.1": "LGPL-2.1",
    "GNU Lesser General Public License, version 3": "LGPL-3.0",
    "GNU Affero General Public License, version 3": "AGPL-3.0",
    "Mozilla Public License, version 2.0": "MPL-2.0",
    "BSD 2-Clause License": "BSD-2-Clause",
    "BSD 3-Clause License": "BSD-3-Clause",
    "ISC License": "ISC",
    "CC0 1.0": "CC0-1.0",
    "CC BY 4.0": "CC-BY-4.0",
    "CC BY-SA 4.0": "CC-BY-SA-4.0",
    "CC BY-NC 4.0": "CC-BY-NC-4.0",
    "CC BY-ND 4.0": "CC-BY-ND-4.0",
    "CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0",
}
SENTENCES = ("Licensed under the {}", "Licensed under {}", "Released under the {}", "Released under {}", "This work is licensed under the {}", "This work is licensed under {}", "Distributed under the terms of the {}")

# Fixed texts: the wording of the licences themselves.
TEXTS = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}
_THIRD_CLAUSE = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def bigrams(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:], strict=False))


def template_texts() -> list[tuple[str, str, str]]:
    """(licence, template, text) for all built-in templates."""
    out = [(name, "notice", text) for name, text in TEXTS.items()]
    head, _, tail = TEXTS["BSD-2-Clause"].partition("\nTHIS SOFTWARE")
    out.append(("BSD-3-Clause", "notice", f"{head}\n{_THIRD_CLAUSE}\nTHIS SOFTWARE{tail}"))
    for name, key in STATED.items():
        out += [(key, f"sentence {k}", sentence.format(name)) for k, sentence in enumerate(SENTENCES)]
        out.append((key, "tag", f"SPDX-License-Identifier: {key}"))
    return out


def read_templates(spark: SparkSession, folder: str) -> tuple[tuple[str, str, str], ...]:
    """Templates from a folder of text files, a licence each, named by the file without its ending; for ``texts``."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value"))
    if (files.agg(F.sum(F.length("value"))).first()[0] or 0) > MAX_TEMPLATE_CHARS:
        raise ValueError(f"the templates in {folder} have more than {MAX_TEMPLATE_CHARS} characters")
    return tuple(sorted((r.name.rsplit(".", 1)[0] if r.name.endswith(".txt") else r.name, "text", r.value) for r in files.collect()))


class Templates:
    """The templates of each bigram, and the name and number of bigrams of each; equal templates of a licence once."""

    def __init__(self, texts: tuple[tuple[str, str, str], ...]):
        found = {(key, frozenset(bigrams(words_of(text)))) for key, _, text in texts}
        listed = sorted(((key, grams) for key, grams in found if grams), key=lambda x: (x[0], len(x[1]), sorted(x[1])))
        self.names = [key for key, _ in listed]
        self.sizes = np.array([len(grams) for _, grams in listed], np.int64)
        where: dict = {}
        for k, (_, grams) in enumerate(listed):
            for g in grams:
                where.setdefault(g, []).append(k)
        self.where = {g: np.array(at) for g, at in where.items()}
        self.largest = int(self.sizes.max(initial=0))


@lru_cache(maxsize=4)
def templates(texts: tuple[tuple[str, str, str], ...] | None = None) -> Templates:
    return Templates(tuple(template_texts()) if texts is None else texts)


def windows(lines: list[list[bytes]], known: Templates, threshold: float = THRESHOLD) -> list[tuple[float, int, int, str]]:
    """(score, first line, last line, licence) of each window that is like a template, but for those that can't be reported."""
    where, sizes = known.where, known.sizes
    strange = (2 / threshold - 2) * known.largest + 1e-9
    share = threshold / (2 - threshold) - 1e-9
    own = [bigrams(words) for words in lines]
    joint = [(a[-1], b[0]) for a, b in zip(lines, lines[1:], strict=False)]
    hit = [not where.keys().isdisjoint(grams) for grams in own]
    crossed = [g in where for g in joint]
    found = []
    for i in range(len(lines)):
        if not (hit[i] or (i < len(joint) and crossed[i])):
            continue
        grams: set = set()
        common = np.zeros(len(sizes), np.int64)
        alike = 0
        for j in range(i, len(lines)):
            fresh = own[j] - grams if j == i else (own[j] | {joint[j - 1]}) - grams
            grams |= fresh
            for g in fresh:
                if (at := where.get(g)) is not None:
                    common[at] += 1
                    alike += 1
            if len(grams) - alike > strange:
                break
            if not fresh or not (hit[j] or (j > i and crossed[j - 1])) or alike < share * len(grams):
                continue
            scores = 2 * common / (len(grams) + sizes)
            best = int(scores.argmax())  # the first of equal ones, and names are in order
            if scores[best] >= threshold:
                found.append((float(scores[best]), i, j, known.names[best]))
    return found


def scan(text: str | None, texts: tuple[tuple[str, str, str], ...] | None = None, threshold: float = THRESHOLD) -> list[tuple[str, float, int, int]]:
    """(licence, score, first line, number of lines) of the reported windows of a text, in order; lines count from 0."""
    if not text:
        return []
    content = [(i, words) for i, line in enumerate(text.split("\n")) if (words := words_of(line)) and words[0] != b"copyright"]
    taken, out = [False] * len(content), []
    for score, i, j, key in sorted(windows([w for _, w in content], templates(texts), threshold), key=lambda x: (-x[0], x[2] - x[1], x[1], x[3])):
        if not any(taken[i : j + 1]):
            taken[i : j + 1] = [True] * (j + 1 - i)
            out.append((key, score, content[i][0], content[j][0] - content[i][0] + 1))
    return sorted(out, key=lambda x: x[2])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, texts: tuple[tuple[str, str, str], ...] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: the id and ``matches``, array of (license, dice, first_line, n_lines)."""
    source = C.id_and_text(docs, id_col, text_col)
    item = pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_line", pa.int32()), ("n_lines", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in C.text_slices(batches):
            rows = [[dict(zip(("license", "dice", "first_line", "n_lines"), x, strict=True)) for x in scan(t, texts, threshold)] for t in C.text_array(part.column(1)).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, pa.list_(item))], names=["__id", "matches"])

    schema = f"__id {source.schema[0].dataType.simpleString()}, matches array<struct<license:string,dice:double,first_line:int,n_lines:int>>"
    return source.mapInArrow(run, schema).withColumnRenamed("__id", id_col)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(C.table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m.license)))
    return found.select("doc_id", F.size("matches").cast("bigint").alias("n_matches"), F.array_join(names, ",").alias("licenses"), F.coalesce(F.array_max(F.transform("matches", lambda m: m.dice)), F.lit(0.0)).alias("best_dice"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_W = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PAIRS = "list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))"
_SQL = f"""
WITH RECURSIVE given AS (SELECT * FROM (VALUES {{values}}) AS v(name, body)),
tmpl AS (SELECT row_number() OVER () AS t, name, grams, CAST(len(grams) AS double) AS m FROM (SELECT DISTINCT name, list_sort({_PAIRS}) AS grams FROM (SELECT name, {_W.format("body")} AS w FROM given)) WHERE len(grams) > 0),
member AS (SELECT t, unnest(grams) AS g FROM tmpl),
vocabulary AS (SELECT DISTINCT g FROM member),
lines AS (
  SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, lead(w[1]) OVER (PARTITION BY doc_id ORDER BY i) AS follows
  FROM (SELECT doc_id, i, {_W.format("s[i]")} AS w FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)))
  WHERE len(w) > 0 AND w[1] != 'copyright'),
occurs AS (
  SELECT x.*, v.g IS NOT NULL AS alike FROM (
    SELECT doc_id, k AS a, k AS b, unnest({_PAIRS}) AS g FROM lines
    UNION ALL SELECT doc_id, k, k + 1, w[len(w)] || ' ' || follows FROM lines WHERE follows IS NOT NULL) x LEFT JOIN vocabulary v USING (g)),
starts AS (SELECT DISTINCT doc_id, a AS i FROM occurs WHERE alike),
ends AS (SELECT DISTINCT doc_id, b AS j FROM occurs WHERE alike),
met AS (SELECT s.doc_id, s.i, o.g, o.alike, min(o.b) AS b FROM starts s JOIN occurs o ON o.doc_id = s.doc_id AND o.a >= s.i GROUP BY ALL),
strange AS (SELECT doc_id, i, b, row_number() OVER (PARTITION BY doc_id, i ORDER BY b) AS nth FROM met WHERE NOT alike),
reach AS (SELECT doc_id, i, min(b) AS over FROM strange WHERE nth > (SELECT 0.5 * max(m) FROM tmpl) GROUP BY doc_id, i),
near AS (SELECT met.* FROM met LEFT JOIN reach USING (doc_id, i) WHERE reach.over IS NULL OR b < reach.over),
wins AS (
  SELECT x.doc_id, x.i, e.j, CAST(count(*) AS double) AS n, count_if(x.alike) AS c
  FROM near x JOIN ends e ON e.doc_id = x.doc_id AND e.j >= x.b LEFT JOIN reach r ON r.doc_id = x.doc_id AND r.i = x.i
  WHERE e.j >= x.i AND (r.over IS NULL OR e.j < r.over) GROUP BY ALL HAVING 3 * count_if(x.alike) >= 2 * count(*)),
scored AS (
  SELECT w.doc_id, w.i, w.j, tmpl.name, 2 * count(*) / (w.n + tmpl.m) AS score
  FROM wins w JOIN near x ON x.doc_id = w.doc_id AND x.i = w.i AND x.b <= w.j AND x.alike JOIN member USING (g) JOIN tmpl ON tmpl.t = member.t
  GROUP BY w.doc_id, w.i, w.j, w.n, tmpl.t, tmpl.name, tmpl.m HAVING 2 * count(*) / (w.n + tmpl.m) >= {THRESHOLD}::double),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, j - i, i, name) AS r FROM scored),
walk AS (
  SELECT doc_id, CAST(0 AS bigint) AS r, CAST([] AS bigint[]) AS taken, CAST(NULL AS varchar) AS name, CAST(NULL AS double) AS score FROM (SELECT DISTINCT doc_id FROM ranked)
  UNION ALL
  SELECT p.doc_id, p.r, CASE WHEN free THEN list_concat(taken, range(i, j + 1)) ELSE taken END, CASE WHEN free THEN p.name END, CASE WHEN free THEN p.score END
  FROM (SELECT q.*, w.taken, len(list_intersect(w.taken, range(q.i, q.j + 1))) = 0 AS free FROM walk w JOIN ranked q ON q.doc_id = w.doc_id AND q.r = w.r + 1) p)
SELECT d.doc_id, count(x.name) AS n_matches, coalesce(string_agg(DISTINCT x.name, ',' ORDER BY x.name), '') AS licenses, coalesce(max(x.score), 0) AS best_dice
FROM documents d LEFT JOIN walk x ON x.doc_id = d.doc_id AND x.name IS NOT NULL GROUP BY d.doc_id
"""


def sql(texts: list[tuple[str, str, str]] | None = None) -> str:
    """The query in SQL, for documents with unique ids."""
    return _SQL.format(values=", ".join(f"({_quoted(name)}, {_quoted(text)})" for name, _, text in texts or template_texts()))


QUERIES = {"op3_license_scan": op3_license_scan}
ORACLE = {"op3_license_scan": sql()}
