"""Licence scan: text against licence templates by the Dice coefficient over word bigrams, with DataFrame functions alone.

A licence in a corpus is a line, a sentence, a paragraph, up to RUN neighbouring paragraphs or the whole of a text; each
of these is a unit. A unit is normalised (lower case, copyright lines' years and holders dropped with all that isn't a
letter or digit) and becomes a set A of word bigrams; with a template's set B the coefficient is 2 |A n B| / (|A| + |B|). At THRESHOLD t or more

* sizes bound each other: t / (2 - t) <= |A| / |B| <= (2 - t) / t, so that other templates aren't compared, and
* A lacks at most |B| (1 - t / (2 - t)) of B's bigrams, so it has a word of any set of words that stand in more of
  them than that. Such words, chosen once for each template, tell which texts have to be split up at all.

Both bounds are exact: what they prune lies below the threshold. Nothing is shuffled; a text is one row throughout.

Edge cases: null and empty texts, and texts without a match, have no licence, 0 matches and a coefficient of 0;
ties of coefficients and of sizes go to the smaller licence id; a very long text is one row whose units are judged one
at a time; repeated rows are judged each; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.arrays import let
from attestry.llm.common import table

THRESHOLD = 0.8
#: Neighbouring paragraphs that may make one licence.
RUN = 4
#: Public licences' own texts, where they are short, and the usual notices that name one.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "MIT-0": ("Licensed under the MIT No Attribution License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    "ISC": ("Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "0BSD": ("Licensed under the BSD Zero Clause License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to https://unlicense.org/"),
    "Zlib": ("This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely.", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
}

#: Lines that name a holder, dropped before the comparison.
HOLDER = r"(?i)(^|\n)[^a-z0-9\n]*(?:copyright|\(c\)|©)[^\n]*[0-9]{4}[^\n]*"
#: What stands between paragraphs and after sentences, and the mark that takes its place.
_SPACE = r"[\x20\t\n\r\f]"
BREAK = rf"\n[\x20\t\r]*\n{_SPACE}*"
STOP, MARK = rf"([.!?]){_SPACE}+|{BREAK}", "\x01"


def texts_of(folder: str) -> dict[str, tuple[str, ...]]:
    """Whole licence texts from the files of a folder, by name: to be added to TEMPLATES where long texts matter. A driver's file list, not data."""
    return {p.stem: (p.read_text(),) for p in sorted(Path(folder).iterdir()) if p.is_file()}


def template_words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def telling_words(texts: list[str], threshold: float = THRESHOLD) -> list[str]:
    """Words of which a unit at the threshold must hold one, whichever template it is like. Longer words are rarer."""
    chosen: set[str] = set()
    for text in texts:
        left = {tuple(b.split()) for b in template_bigrams(text)}
        may_miss = len(left) * (1 - threshold / (2 - threshold))
        held: set[tuple[str, ...]] = {b for b in left if chosen & {*b}}
        for word in sorted({w for b in left for w in b}, key=lambda w: (-len(w), w)):
            if len(held) > may_miss + 1e-9:
                break
            chosen.add(word)
            held |= {b for b in left if word in b}
    return sorted(chosen)


def _templates(templates: dict[str, tuple[str, ...]]) -> Column:
    rows = [(name, template_bigrams(t)) for name, ts in sorted(templates.items()) for t in ts]
    return F.array(*(F.struct(F.lit(name).alias("licence"), F.lit(len(b)).alias("n"), F.array(*map(F.lit, b)).alias("bigrams")) for name, b in rows))


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b)))


def scanned(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and matches (licence, dice, unit) of every row; a unit is compared with the templates of a like size."""
    texts = [t for ts in templates.values() for t in ts]
    sizes = [len(template_bigrams(t)) for t in texts]
    ratio = threshold / (2 - threshold)
    least = min(sizes) * ratio
    hint = "(?i)(?<![a-z0-9])(?:" + "|".join(telling_words(texts, threshold)) + ")(?![a-z0-9])"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    none = "array<struct<licence:string,dice:double,unit:string>>"

    def compared(words: Column) -> Column:
        """The templates that a unit's words reach the threshold with."""

        def against(a: Column) -> Column:
            like = F.filter(_templates(templates), lambda t: (F.size(a) >= ratio * t["n"]) & (ratio * F.size(a) <= t["n"]))
            dice = F.transform(like, lambda t: F.struct(t["licence"].alias("licence"), (2 * F.size(F.array_intersect(a, t["bigrams"])) / (F.size(a) + t["n"])).cast("double").alias("dice")))
            return F.filter(dice, lambda d: d["dice"] >= threshold)

        return F.element_at(F.transform(F.array(_bigrams(words)), against), 1)

    def of_unit(kind: Column, unit: Column) -> Column:
        words = F.regexp_extract_all(F.lower(F.regexp_replace(unit, HOLDER, "$1")), F.lit("[a-z0-9]+"), F.lit(0))
        # a unit of w words has w - 1 bigrams or fewer, and too long a one may still repeat itself
        found = F.transform(F.filter(F.array(words), lambda w: F.size(w) > least), compared)
        return F.transform(F.flatten(found), lambda d: F.struct(d["licence"].alias("licence"), d["dice"].alias("dice"), kind.alias("unit")))

    def units(kind: str, each: Column) -> Column:
        return F.flatten(F.transform(F.filter(each, lambda u: u.rlike(hint)), lambda u: of_unit(F.lit(kind), u)))

    def runs(paragraphs: Column) -> Column:
        def of(k: int) -> Column:
            starts = F.filter(F.sequence(F.lit(1), F.size(paragraphs)), lambda i: i + k <= F.size(paragraphs) + 1)
            return F.transform(starts, lambda i: F.array_join(F.slice(paragraphs, i, k), "\n"))

        return F.concat(units("paragraph", paragraphs), units("paragraphs", F.concat(*map(of, range(2, RUN + 1)))))

    text = F.col("text")
    several, empty = text.rlike(BREAK), F.array().cast(none)
    paragraphs = F.when(several, let(F.split(text, BREAK, -1), runs)).otherwise(empty)
    whole = F.when(text.contains("\n"), of_unit(F.lit("text"), text)).otherwise(empty)
    sentences = F.when(text.rlike(STOP), units("sentence", F.split(F.regexp_replace(text, STOP, f"$1{MARK}"), MARK, -1))).otherwise(empty)
    found = F.concat(units("line", F.split(text, r"\r?\n", -1)), sentences, paragraphs, whole)
    return rows.select("doc_id", F.when(text.rlike(hint), found).otherwise(F.array().cast(none)).alias("matches"))


def judged(found: DataFrame) -> DataFrame:
    """doc_id, licence and dice of the best match, and how many licences and units match."""
    best = F.array_min(F.transform("matches", lambda m: F.struct((-m["dice"]).alias("d"), m["licence"].alias("licence"))))
    named = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["licence"])))
    return found.select(
        "doc_id",
        best["licence"].alias("licence"),
        F.coalesce(F.round(-best["d"], 6), F.lit(0.0)).alias("dice"),
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(named, ",").alias("licences"),
    )


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(scanned(table(spark, sf_dir, "documents")))


def _sql() -> str:
    rows = ",\n  ".join(f"('{name}', '{' '.join(template_words(t))}')" for name, ts in sorted(TEMPLATES.items()) for t in ts)
    words = lambda x: f"regexp_extract_all(translate(regexp_replace({x}, '{HOLDER}', '\\1', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')"
    bigrams = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
    return rf"""
WITH templates(licence, t) AS (VALUES
  {rows}
), b AS (
  SELECT licence, row_number() OVER () AS template, {bigrams("string_split(t, ' ')")} AS bigrams FROM templates
), d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), units AS (
  SELECT r, unnest(regexp_split_to_array(text, '\r?\n')) AS unit FROM d
  UNION ALL SELECT r, unnest(string_split(regexp_replace(text, '{STOP}', '\1' || chr(1), 'g'), chr(1))) FROM d WHERE regexp_matches(text, '{STOP}')
  UNION ALL SELECT r, array_to_string(list_slice(ps, i, i + k - 1), chr(10)) FROM (SELECT r, ps, k, unnest(range(1, len(ps) - k + 2)) AS i FROM
    (SELECT r, regexp_split_to_array(text, '{BREAK}') AS ps, unnest(range(1, {RUN + 1})) AS k FROM d WHERE regexp_matches(text, '{BREAK}')) WHERE len(ps) >= k)
  UNION ALL SELECT r, text FROM d WHERE contains(text, chr(10))
), numbered AS (
  SELECT r, row_number() OVER () AS u, {words("unit")} AS ws FROM units
), a AS (
  SELECT r, u, {bigrams("ws")} AS bigrams FROM numbered
), shared AS (
  SELECT x.u, y.template, count(*) AS n FROM (SELECT u, unnest(bigrams) AS g FROM a) x JOIN (SELECT template, unnest(bigrams) AS g FROM b) y ON x.g = y.g GROUP BY ALL
), matches AS (
  SELECT a.r, b.licence, 2 * n / (len(a.bigrams) + len(b.bigrams)) AS dice FROM shared JOIN a USING (u) JOIN b USING (template)
  WHERE 2 * n / (len(a.bigrams) + len(b.bigrams)) >= {THRESHOLD}
), best AS (
  SELECT r, arg_min(licence, (-dice, licence)) AS licence, max(dice) AS dice, count(*) AS n_matches, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences FROM matches GROUP BY r
)
SELECT doc_id, licence, round(coalesce(dice, 0), 6) AS dice, coalesce(n_matches, 0) AS n_matches, coalesce(licences, '') AS licences FROM d LEFT JOIN best USING (r)
"""


QUERIES = {"op7_licences": op7_licences}
SQL = {"op7_licences": _sql()}
