"""Licence notices and texts by Dice coefficient over word bigrams, in DataFrame functions only.

A text is normalised as a whole (lower case, words of letters and digits), so line breaks, comment marks and indents do not
part a notice. Each template is compared with the windows of its own number of words that begin at one of its bigrams, or
with what is left of the text there. With b distinct bigrams in the template and a window of a pairs, m of the template's
found among them, the coefficient is 2m / (b + a - h + m), h being the window's pairs that are the template's, so that a pair
of the template counts once however often it comes, and a foreign one each time.

Size bounds prune: a coefficient of t takes m >= t / (2 - t) * b, so texts and windows with fewer of a template's pairs, read
off the sorted places of its pairs, meet it not at all; and since any such m pairs include one with a word of a short list
(a cover), texts that lack all words of some cover of every template are left out. A text is taken apart once for that, and
what its words have in common with all covers is what each cover is held against. The templates' few thousand bigrams, a
fixed table, are broadcast; only hits are shuffled.

Defined cases: null text matches nothing; texts of fewer than two words have no bigrams; a row gives one line for each
template it matches, its best window, the first on ties; rows are told apart, whether doc_ids are null or repeat.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import with_row

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. """
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. """
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
_GPL_END = """ This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""

# Licence notices as they stand in files, and whole texts of the short licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "Apache-2.0-notice": _APACHE,
    "BSD-2-Clause-text": _BSD + _BSD_END,
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause-text": _BSD + _BSD_3 + _BSD_END,
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": _GPL,
    "GPL-3.0-or-later-notice": _GPL + _GPL_END,
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "ISC-text": _ISC,
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.",
    "MIT-text": _MIT + _AS_IS,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Zlib-text": _ZLIB,
}


def words_of(notice: str) -> list[str]:
    """Words of a template; templates are plain enough for this to be what normalised() says."""
    return re.findall(r"[^\W_]+", notice.lower())


def normalised(text: Column) -> Column:
    """Lower-case words of letters and digits with one blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def needed(pairs: int, threshold: float) -> int:
    """Pairs of a template with `pairs` distinct ones that a window of the threshold must hold."""
    return max(1, math.ceil(threshold / (2 - threshold) * pairs - 1e-9))


def covers(notice: str, threshold: float, most: int = 3) -> list[list[str]]:
    """Up to `most` lists of words without a common one; any match of the template holds a word of each.

    So many of the template's pairs have a word of the list that those without are too few for a match.
    """
    w = words_of(notice)
    pairs = set(zip(w, w[1:]))
    short = len(pairs) - needed(len(pairs), threshold) + 1
    free, out = set(w), []
    while len(out) < most:
        open_, chosen = set(pairs), []
        while len(pairs) - len(open_) < short:
            gain = {x: sum(x in p for p in open_) * len(x) ** 2 for x in free.difference(chosen)}
            best = min(gain, key=lambda x: (-gain[x], x), default=None)
            if best is None or not gain[best]:
                return out
            chosen.append(best)
            open_ = {p for p in open_ if best not in p}
        out.append(sorted(chosen))
        free.difference_update(chosen)
    return out


def templates(spark: SparkSession, named: dict[str, str], threshold: float) -> DataFrame:
    """(license, n_words, n_pairs, need, gram), a row for each distinct pair."""
    rows = []
    for k, notice in sorted(named.items()):
        w = words_of(notice)
        pairs = sorted({f"{a} {b}" for a, b in zip(w, w[1:])})
        rows += [(k, len(w), len(pairs), needed(len(pairs), threshold), p) for p in pairs]
    return spark.createDataFrame(rows, "license string, n_words int, n_pairs int, need int, gram string")


def matches(docs: DataFrame, threshold: float = 0.8, named: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, dice, start_word, n_words): each row's best window for each template with at least that coefficient.

    start_word counts the text's words from 0; n_words is the window's length.
    """
    named = named or TEMPLATES
    rows, row = with_row(docs.where("text is not null"))
    words = F.split(normalised(F.col("text")), " ")
    wanted = [covers(notice, threshold) for notice in named.values()]
    told = F.array_intersect(words, F.lit(sorted({w for lists in wanted for listed in lists for w in listed})))
    # a lambda's argument is computed once a row, an expression in a filter as often as it stands there
    some = lambda own: reduce(or_, (reduce(and_, (F.arrays_overlap(own, F.lit(listed)) for listed in lists)) for lists in wanted))
    said = rows.where(F.exists(F.array(told), some)).select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words.alias("words"))
    n = F.size("words")
    pairs = F.zip_with(F.slice("words", 1, F.greatest(n - 1, F.lit(0))), F.slice("words", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    placed = said.select("row", "doc_id", (n - 1).alias("total"), F.posexplode(pairs).alias("pos", "gram"))
    hits = placed.join(F.broadcast(templates(docs.sparkSession, named, threshold)), "gram")  # the fixed table
    found = hits.groupBy("row", "doc_id", "total", "license", "n_words", "n_pairs", "need").agg(F.array_sort(F.collect_list(F.struct("pos", "gram"))).alias("hits")).where(F.size("hits") >= F.col("need"))
    # window from hit i on: its pairs are hits i.. up to place pos + n_words - 2, no more than n_words - 1 of them
    size, width = F.size("hits"), F.col("n_words") - 1
    place = lambda i: F.get("hits", (i - 1).cast("int"))["pos"]  # noqa: E731  null beyond the hits: a caller's filter may be tried before the one on their number
    starts = F.filter(F.sequence(F.lit(1), size - F.col("need") + 1), lambda i: place(i + F.col("need") - 1) - place(i) < width)

    def judged(i: Column) -> Column:
        start = place(i)
        inside = F.filter(F.slice("hits", i, width), lambda h: h["pos"] - start < width)
        m = F.size(F.array_distinct(F.transform(inside, lambda h: h["gram"])))
        a = F.least(width, F.col("total") - start)
        dice = F.round(2 * m / (F.col("n_pairs") + a - F.size(inside) + m), 6)
        return F.struct(dice.alias("dice"), (-start).alias("back"), (a + 1).alias("n_words"))

    best = found.where(F.size("hits") >= F.col("need")).select("doc_id", "license", F.array_max(F.transform(starts, judged)).alias("b"))
    return best.where(F.col("b.dice") >= threshold).select("doc_id", "license", "b.dice", (-F.col("b.back")).cast("int").alias("start_word"), F.col("b.n_words").cast("int").alias("n_words"))
