"""Licence scans by canonical digests of entire texts, with DataFrame functions only.

A text is brought to a canonical form: lower case, copyright lines dropped, equivalent spellings made one, punctuation and
white space to single blanks. The sha-256 of the form is joined with the digests of known licence texts, so a whole text is
known or not; there is no fuzzy matching. The same lookup runs over the blocks between blank lines and over the lines of a
text, which finds notices and paragraphs of licences inside other text: each of them is an entire text of its own.

Defined cases: a null or empty text has the canonical form '' and matches nothing; repeated rows are reported each; known
texts with equal digests are one entry under their smallest name; lines and blocks whose form is longer than the longest known
one (a property of the known texts) cannot match and are not hashed; an empty table gives no rows; columns in keep are returned inside
`doc`, so their names cannot clash.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence notices, and spellings that count as equal.
NOTICES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("all rights reserved", "All rights reserved."),
]
# Whole public licence texts.
TEXTS = [
    ("MIT", """MIT License

Copyright (c) 2020 Holder

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Copyright (c) 2020 Holder

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """BSD Zero Clause License

Copyright (c) 2020 Holder

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """BSD 2-Clause License

Copyright (c) 2020, Holder

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """BSD 3-Clause License

Copyright (c) 2020, Holder

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Zlib", """zlib License

Copyright (c) 2020 Holder

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""),
    ("Apache-2.0", """Copyright 2020 Holder

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
]
BLANK_LINES = r"\n[ \t\r\n]*\n"


def known_texts() -> list[tuple[str, str]]:
    """(licence, text): the notices; each whole text with and without its title; and those paragraphs of at least eight words
    that stand in the text of one licence alone."""
    owners: dict[str, set[str]] = {}
    for name, text in TEXTS:
        for paragraph in text.split("\n\n"):
            owners.setdefault(paragraph, set()).add(name)
    alone = [(min(names), p) for p, names in owners.items() if len(names) == 1 and len(p.split()) >= 8]
    untitled = [(name, text.split("\n\n", 1)[1]) for name, text in TEXTS]
    return [*NOTICES, *TEXTS, *untitled, *alone]


SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("sub licence", "sublicense"), ("sub license", "sublicense"), ("non commercial", "noncommercial"),
    ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("v", "version"), ("ver", "version"), ("organisation", "organization"),
    ("favour", "favor"), ("fulfil", "fulfill"), ("per cent", "percent"), ("version 2 0", "version 2"), ("version 3 0", "version 3"), ("programme", "program"),
]
COPYRIGHT_LINE = r"(?im)^[ \t]*(copyright\b|\(c\)|©)[^\n]*[0-9]{4}[^\n]*$"


def canonical(text: Column) -> Column:
    """Of a whole text."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), COPYRIGHT_LINE, " ")
    plain = F.concat(F.lit(" "), F.regexp_replace(F.lower(kept), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    for was, now in SPELLINGS:
        plain = F.replace(plain, F.lit(f" {was} "), F.lit(f" {now} "))
    return F.trim(F.regexp_replace(plain, " +", " "))


def digest(form: Column) -> Column:
    return F.sha2(form.cast("binary"), 256)


def known_digests(known: DataFrame, name: str = "licence", text: str = "text") -> DataFrame:
    """(digest, licence, size of the canonical form, its words that stand in a text as they are) of known texts."""
    forms = known.select(F.col(name).alias("licence"), canonical(F.col(text)).alias("form")).where("form <> ''")
    made = {w for _, now in SPELLINGS for w in now.split()}
    kept = F.filter(F.array_distinct(F.split("form", " ")), lambda w: w.rlike("^[a-z]{4,}$") & ~w.isin(*made))
    return forms.groupBy(digest(F.col("form")).alias("digest")).agg(F.min("licence").alias("licence"), F.max(F.length("form")).alias("size"), F.first(kept).alias("words"))


def anchors(forms: list[list[str]]) -> list[str] | None:
    """A few words of which every known form has one; None if a form has no word to choose from."""
    left, chosen = [set(words) for words in forms], []
    if not all(left):
        return None
    while left:
        counts = Counter(w for words in left for w in words)
        chosen.append(min(counts, key=lambda w: (-counts[w], -len(w), w)))
        left = [words for words in left if chosen[-1] not in words]
    return chosen


def scanned(docs: DataFrame, keep: list[str], known: DataFrame, *, text: str = "text") -> DataFrame:
    """`doc` (columns in keep), digest of the whole text's form, licence (of the whole text, or null), and notices: the
    sorted distinct licences of its lines and blocks."""
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.struct(*keep).alias("doc"), F.col(text).alias("text__"))
    listed = known.select("size", "words").collect()  # the known texts
    longest, some = max((r["size"] for r in listed), default=0), anchors([r.words for r in listed])
    given = F.lower(F.coalesce("text__", F.lit("")))  # a form is the same whether made of the text or of its lower case
    lines = F.array_distinct(F.concat(F.split(given, "\n"), F.split(given, BLANK_LINES)))
    marked = rows.select("uid", "doc", digest(canonical(F.col("text__"))).alias("digest"), lines.alias("lines"))
    line = marked.select("uid", F.explode("lines").alias("line"))
    if some is not None:  # a line or block without any of these words has no known form
        line = line.where(reduce(or_, [F.contains(F.col("line"), F.lit(w)) for w in some], F.lit(False)))
    line = line.select("uid", canonical(F.col("line")).alias("form"))
    line = line.where((F.col("form") != "") & (F.length("form") <= longest)).select("uid", digest(F.col("form")).alias("line_digest"))
    table = known.select(F.col("digest").alias("known_digest"), F.col("licence").alias("known_licence"))
    hits = line.join(table, F.col("line_digest") == F.col("known_digest")).groupBy("uid").agg(F.array_sort(F.collect_set("known_licence")).alias("found"))
    whole = marked.select("uid", "doc", "digest").join(table, F.col("digest") == F.col("known_digest"), "left")
    none = F.array().cast("array<string>")
    return whole.join(hits, "uid", "left").select("doc", "digest", F.col("known_licence").alias("licence"), F.coalesce("found", none).alias("notices"))
