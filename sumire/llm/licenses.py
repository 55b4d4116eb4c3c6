"""License scans: Dice coefficient over word bigrams against templates."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

#: Least Dice coefficient of a match.
ALIKE = 0.8

_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"

#: (licence, template): whole short licences, and the notices by which others are named.
TEMPLATES = [
    ("mit", f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}"),
    ("mit", f"{_MIT}"),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("bsd", f"{_BSD} {_BSD_END}"),
    ("bsd", f"{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("bsd", "Licensed under the BSD License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "Licensed under the GNU General Public License v3.0."),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]
KEEP = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))
DIGITS, SENTENCE = re.compile(rb"[0-9]+"), re.compile(rb"[.!?]+[ \t]+")
#: Paragraphs that a licence within a longer text has at most.
WINDOW = 6


def normal(text: bytes) -> list[bytes]:
    """Lower-case runs of ASCII letters and digits, each run of digits written as one #."""
    return DIGITS.sub(b"#", text.translate(KEEP)).split()


class Templates:
    def __init__(self, templates: list[tuple[str, str]], alike: float):
        self.alike = alike
        self.rows = [(name, Counter(zip(w, w[1:], strict=False)), len(w) - 1) for name, t in templates if len(w := normal(t.encode())) > 1]
        self.words = {w for _, c, _ in self.rows for pair in c for w in pair}
        low, high = alike / (2 - alike), (2 - alike) / alike
        self.least, self.most = min((n * low for *_, n in self.rows), default=1), max((n * high for *_, n in self.rows), default=0)

    def may(self, n: int, known: int) -> bool:
        """Whether a unit of n bigrams, of whose words so many are in templates, can match at all."""
        return self.least - 1e-9 <= n <= self.most + 1e-9 and known >= self.alike / (2 - self.alike) * n

    def best(self, words: list[bytes]) -> tuple[str, float] | None:
        """The licence of the highest coefficient, the first by name of equals; templates whose size alone keeps them below are passed over."""
        n = len(words) - 1
        if not self.may(n, sum(map(self.words.__contains__, words))):
            return None
        own, found = Counter(zip(words, words[1:], strict=False)), None
        for name, pairs, m in self.rows:
            if 2 * min(n, m) < self.alike * (n + m) - 1e-9:
                continue
            dice = 2.0 * sum(min(k, pairs[p]) for p, k in own.items() if p in pairs) / (n + m)
            if dice >= self.alike and (found is None or (-dice, name) < (-found[1], found[0])):
                found = (name, dice)
        return found

    def scan(self, text: bytes | None) -> tuple[str | None, float | None, int]:
        """Best licence and coefficient among a text's units, and how many lines match."""
        raw = (text or b"").replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
        lines = [normal(x) for x in raw]
        known = [sum(map(self.words.__contains__, w)) for w in lines]
        matched, found = 0, []
        for x, w, k in zip(raw, lines, known, strict=True):
            if self.may(len(w) - 1, k) and (got := self.best(w)):
                matched += 1
                found.append(got)
            if k > 1 and len(pieces := SENTENCE.split(x)) > 1:
                found += [self.best(normal(y)) for y in pieces]
        parts: list[list[int]] = []  # paragraphs: numbers of their lines
        for i, w in enumerate(lines):
            if w:
                if parts and parts[-1][-1] == i - 1:
                    parts[-1].append(i)
                else:
                    parts.append([i])
        size, of = [sum(len(lines[i]) for i in p) for p in parts], [sum(known[i] for i in p) for p in parts]
        for i in range(len(parts)):
            n = k = 0
            for j in range(i, min(i + WINDOW, len(parts))):
                n, k = n + size[j], k + of[j]
                if n - 1 > self.most:
                    break
                if (j > i or len(parts[i]) > 1) and self.may(n - 1, k):
                    found.append(self.best([x for p in parts[i : j + 1] for line in p for x in lines[line]]))
        if len(parts) > WINDOW and self.may(sum(size) - 1, sum(of)):
            found.append(self.best([x for w in lines for x in w]))
        best = min((f for f in found if f), key=lambda f: (-f[1], f[0]), default=(None, None))
        return (*best, matched)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, alike: float = ALIKE) -> DataFrame:
    """(doc_id, license, dice, n_lines) for each row: the best licence or null, its coefficient, and how many lines match one.

    Units of a text are the whole, its lines, the sentences of its lines (parted by . ! or ? and blanks), and up to WINDOW of its paragraphs in
    a row. Line ends are LF, CRLF or CR; lines without letters and digits, as in comments, part paragraphs. Null and empty texts match nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Templates(templates, alike)
        for b in batches:
            out = [own.scan(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.int64())))], ["doc_id", "license", "dice", "n_lines"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, license string, dice double, n_lines long")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ",".join("(%d, '%s', '%s')" % (i, name, t.replace("'", "''")) for i, (name, t) in enumerate(TEMPLATES))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = "string_split(trim(regexp_replace(regexp_replace(translate({}, '%s', '%s'), '[^a-z0-9]+', ' ', 'g'), '[0-9]+', '#', 'g')), ' ')" % (upper, lower)
    return f"""
WITH t AS (SELECT t, name, {words.format("body")} AS w FROM (VALUES {rows}) v(t, name, body)),
tb AS (SELECT t, name, len(w) - 1 AS m, w[i] || ' ' || w[i + 1] AS g, count(*) AS k FROM (SELECT *, unnest(range(1, len(w))) AS i FROM t) GROUP BY ALL),
l AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS i, unnest(s) AS text FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS s FROM documents)),
lw AS (SELECT doc_id, i, text, array_to_string({words.format("text")}, ' ') AS t FROM l),
p AS (SELECT doc_id, g, string_agg(t, ' ' ORDER BY i) AS t FROM (SELECT *, sum(CASE WHEN t = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM lw) WHERE t <> '' GROUP BY doc_id, g),
r AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY g) AS r FROM p),
n AS (SELECT doc_id, 0 AS kind, 0 AS i, string_split(string_agg(t, ' ' ORDER BY r), ' ') AS w FROM r GROUP BY doc_id
  UNION ALL SELECT doc_id, 1, i, string_split(t, ' ') FROM lw
  UNION ALL SELECT doc_id, 2, r * 10 + k, string_split(string_agg(t, ' ' ORDER BY br), ' ') FROM (SELECT a.doc_id, a.r, k, b.r AS br, b.t FROM r a CROSS JOIN range(1, {WINDOW + 1}) w(k) JOIN r b ON a.doc_id = b.doc_id AND b.r BETWEEN a.r AND a.r + k - 1) GROUP BY doc_id, r, k HAVING count(*) = k
  UNION ALL SELECT doc_id, 3, i * 100000 + j, {words.format("x")} FROM (SELECT doc_id, i, unnest(range(len(s))) AS j, unnest(s) AS x FROM (SELECT doc_id, i, string_split_regex(text, '[.!?]+[ \\t]+') AS s FROM l))),
c AS (SELECT * FROM n WHERE len(w) BETWEEN 2 AND 500),
ub AS (SELECT doc_id, kind, i, len(w) - 1 AS n, w[j] || ' ' || w[j + 1] AS g, count(*) AS k FROM (SELECT *, unnest(range(1, len(w))) AS j FROM c) GROUP BY ALL),
d AS (SELECT doc_id, kind, i, t, name, 2.0::DOUBLE * sum(least(ub.k, tb.k))::DOUBLE / (n + m) AS dice FROM ub JOIN tb USING (g) GROUP BY doc_id, kind, i, t, name, n, m HAVING dice >= {ALIKE}),
b AS (SELECT doc_id, arg_min(name, (-dice, name)) AS license, max(dice) AS dice, count(DISTINCT i) FILTER (WHERE kind = 1) AS n_lines FROM d GROUP BY doc_id)
SELECT doc_id, license, dice, coalesce(n_lines, 0) AS n_lines FROM documents LEFT JOIN b USING (doc_id)"""


SQL = {"op1_license_scan": _sql()}
