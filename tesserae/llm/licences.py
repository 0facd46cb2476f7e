"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams. DataFrame functions only."""

from __future__ import annotations

from collections import Counter

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tesserae.llm import common

#: Short notices by which texts state their licence, licence texts, standard headers and the beginnings of long texts, as
#: their authors give them, with the licence's usual identifier.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    # licence texts and standard headers
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.'),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.'),
    ("Unlicense", 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.'),
    ("MPL-2.0", 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.'),
    ("GPL-1.0", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.'),
    ("GPL-2.0", 'This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.'),
    ("LGPL-2.0", 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Library General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Library General Public License for more details.'),
    ("LGPL-2.1", 'This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.'),
    ("LGPL-3.0", 'This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.'),
    ("AGPL-3.0", 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    # how licence texts begin
    ("Apache-2.0", 'Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "License" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document. "Licensor" shall mean the copyright owner or entity authorized by the copyright owner that is granting the License. "Legal Entity" shall mean the union of the acting entity and all other entities that control, are controlled'),
    ("Artistic-1.0", 'The "Artistic License" Preamble The intent of this document is to state the conditions under which a Package may be copied, such that the Copyright Holder maintains some semblance of artistic control over the development of the package, while giving the users of the package the right to use and distribute the Package in a more-or-less customary fashion, plus the right to make reasonable modifications. Definitions: "Package" refers to the collection of files distributed by'),
    ("CC0-1.0", 'Creative Commons Legal Code CC0 1.0 Universal CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM AND DOES NOT PROVIDE LEGAL SERVICES. DISTRIBUTION OF THIS DOCUMENT DOES NOT CREATE AN ATTORNEY-CLIENT RELATIONSHIP. CREATIVE COMMONS PROVIDES THIS INFORMATION ON AN "AS-IS" BASIS. CREATIVE COMMONS MAKES NO WARRANTIES REGARDING THE USE OF THIS DOCUMENT OR THE INFORMATION OR WORKS PROVIDED HEREUNDER, AND DISCLAIMS LIABILITY FOR DAMAGES RESULTING FROM THE USE OF THIS DOCUMENT OR THE INFORMATION OR WORKS'),
    ("GFDL-1.2", 'GNU Free Documentation License Version 1.2, November 2002 Copyright (C) 2000,2001,2002 Free Software Foundation, Inc. 51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. 0. PREAMBLE The purpose of this License is to make a manual, textbook, or other functional and useful document "free" in the sense of freedom: to assure everyone the effective freedom to'),
    ("GFDL-1.3", 'GNU Free Documentation License Version 1.3, 3 November 2008 Copyright (C) 2000, 2001, 2002, 2007, 2008 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. 0. PREAMBLE The purpose of this License is to make a manual, textbook, or other functional and useful document "free" in the sense of freedom: to assure everyone the effective freedom to copy and redistribute'),
    ("GPL-1.0", 'GNU GENERAL PUBLIC LICENSE Version 1, February 1989 Copyright (C) 1989 Free Software Foundation, Inc. 51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The license agreements of most software companies try to keep users at the mercy of those companies. By contrast, our General Public License is intended to guarantee your freedom to share'),
    ("GPL-2.0", 'GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom'),
    ("GPL-3.0", 'GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. Preamble The GNU General Public License is a free, copyleft license for software and other kinds of works. The licenses for most software and other practical works are designed to take away your freedom to share and change the'),
    ("LGPL-2.0", 'GNU LIBRARY GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1991 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. [This is the first released version of the library GPL. It is numbered 2 because it goes with version 2 of the ordinary GPL.] Preamble The licenses for most software are'),
    ("LGPL-2.1", 'GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. [This is the first released version of the Lesser GPL. It also counts as the successor of the GNU Library Public License, version 2, hence the version number 2.1.] Preamble'),
    ("LGPL-3.0", 'GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/> Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below. 0. Additional Definitions. As used herein, "this License"'),
    ("MPL-1.1", 'MOZILLA PUBLIC LICENSE Version 1.1 1. Definitions. 1.0.1. "Commercial Use" means distribution or otherwise making the Covered Code available to a third party. 1.1. "Contributor" means each entity that creates or contributes to the creation of Modifications. 1.2. "Contributor Version" means the combination of the Original Code, prior Modifications used by a Contributor, and the Modifications made by that particular Contributor. 1.3. "Covered Code" means the Original Code or Modifications or the combination of'),
    ("MPL-2.0", 'Mozilla Public License Version 2.0 1. Definitions 1.1. "Contributor" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. "Contributor Version" means the combination of the Contributions of others (if any) used by a Contributor and that particular Contributor\'s Contribution. 1.3. "Contribution" means Covered Software of a particular Contributor. 1.4. "Covered Software" means Source Code Form to which the initial Contributor has attached the notice in'),
]
THRESHOLD = 0.8
#: Templates are broadcast up to this number; more of them are joined by a shuffle.
BROADCAST_TEMPLATES = 10_000
#: Beginnings of texts by which rare words are told from common ones.
SAMPLE_TEXTS = 1000
_OTHER = r"[^\p{L}\p{N}]+"


def _normal(c):
    return F.trim(F.regexp_replace(F.lower(c), _OTHER, " "))


def _bigrams(norm):
    """Distinct pairs of neighbouring words. The pairs are zipped, so that the words aren't split again for each of them."""
    words, n = F.split(norm, " "), F.size(F.split(norm, " ")) - 1
    return F.array_distinct(F.zip_with(F.slice(words, 1, n), F.slice(words, 2, n), lambda x, y: F.concat_ws(" ", x, y)))


def _words(text: str) -> list[str]:
    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


#: What tells a licence's version or kind from others': these pairs of words of a template have to stand in a text.
_TELLING = regex.compile(r"(?:version|v|attribution|by|sa|nc|bsd) [0-9]+|gnu [a-z]+|(?:library|lesser|affero) general")


def telling(body: str) -> list[str]:
    """The telling bigrams of a template, with the second part of a version such as 2.1."""
    words = _words(body)
    out = []
    for i, (x, y) in enumerate(zip(words, words[1:], strict=False)):
        if _TELLING.fullmatch(f"{x} {y}"):
            out.append(f"{x} {y}")
            if y.isdigit() and i + 2 < len(words) and words[i + 2].isdigit():
                out.append(f"{y} {words[i + 2]}")
    return sorted(set(out))


def anchors(templates: list[tuple[str, str]], threshold: float, common_words: Counter | None = None) -> list[str]:
    """Words of which any text that reaches the threshold holds one.

    It has to share threshold / (2 - threshold) of a template's bigrams, so it is enough that fewer of them are without such a word.
    Words that are rare by the counts common_words are taken first, then long ones. Which words are taken changes how many texts are
    looked at, never what is found in them.
    """
    often = common_words or Counter()
    out: set[str] = set()
    for _, body in templates:
        words = _words(body)
        left = set(zip(words, words[1:], strict=False))
        need = threshold / (2 - threshold) * len(left)
        left = {g for g in left if not out.intersection(g)}
        for w in sorted(set(words), key=lambda w: (often[w], -len(w), w)):
            if len(left) < need - 1e-9 or not left:
                break
            out.add(w)
            left = {g for g in left if w not in g}
    return sorted(out)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Find segments of documents that state a licence.

    Segments are the lines of a text (segment 0, 1, ...), for texts of several lines the whole text (-1), and of each text and template
    the best run of as many words as the template has (-2; the first of equals), which begins with one of its bigrams at the word
    `start` of the whole text: so notices and licence texts are found amid other words and over line ends. Of whole texts, and of runs that overlap in a
    text, only the one that shares most bigrams stays (then that of the higher coefficient, then of the earlier template). A segment or
    run has to hold the bigrams that tell a template's version and kind. Templates have a million words at most. Text is lower-cased, and all
    but letters and digits becomes one space. A segment with a bigrams can reach the threshold t with a template of b only if
    t / (2 - t) <= a / b <= (2 - t) / t: these bounds prune segments before their bigrams are looked up; texts without any word that such
    a segment needs are left out before that. Returns a row for each segment and template with Dice coefficient >= threshold: doc_id,
    segment, start (-1 but for runs), licence, template (its place in the list), n_shared, dice. Null and empty texts, and segments
    under two words, give none; repeated rows give rows each; a null doc_id stays; an empty table gives no rows; texts are read whole,
    however long; further columns are ignored.
    """
    spark = docs.sparkSession
    given = spark.createDataFrame([(i, name, text, telling(text)) for i, (name, text) in enumerate(templates)], "template int, licence string, body string, telling array<string>")
    norm = _normal(F.col("body"))
    small = given.withColumn("bigrams", _bigrams(norm)).withColumn("m", F.size(F.split(norm, " "))).withColumn("b", F.size("bigrams")).where("b > 0")
    up = (2 - threshold) / threshold
    sizes = small.agg(F.min("b"), F.max("b")).first()
    least, most = (int(sizes[0] / up), int(sizes[1] * up) + 1) if sizes[0] else (1, 0)
    probes = small.select("template", "licence", "b", "m", "telling", F.explode("bigrams").alias("bigram"))
    probes = F.broadcast(probes) if len(templates) <= BROADCAST_TEMPLATES else probes

    rows = common.pick(docs, "doc_id", "text").where(F.col("text").isNotNull())
    if len(templates) <= BROADCAST_TEMPLATES:
        some = rows.select(F.substring("text", 1, 4000).alias("text")).limit(SAMPLE_TEXTS).collect()
        needed = anchors(templates, threshold, Counter(w for r in some for w in set(_words(r["text"]))))
        # as whole words of the lower-cased text; a template without bigrams needs none
        rows = rows.where(F.lower("text").rlike(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(needed)})(?![\p{{L}}\p{{N}}])") if needed else F.lit(False))
    rows = rows.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.transform(F.split("text", "\n"), lambda x: _normal(x)).alias("lines"))
    rows = common.materialize(rows, "licence-texts")  # few, and numbered once
    whole = F.array_join(F.filter("lines", lambda x: x != ""), " ")
    numbered = F.transform("lines", lambda x, i: F.struct(i.alias("segment"), x.alias("norm")))
    more = F.when(F.size("lines") > 1, F.array(F.struct(F.lit(-1).alias("segment"), whole.alias("norm")))).otherwise(F.array().cast("array<struct<segment:int,norm:string>>"))
    segs = rows.select("row", "doc_id", F.inline(F.concat(numbered, more)))
    words = F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1
    # n words make at most n - 1 distinct bigrams, and w distinct words at least w - 1: a long segment is seldom paired up
    few = (words <= most + 1) | (F.size(F.array_distinct(F.split("norm", " "))) <= most + 1)
    segs = segs.where((F.col("norm") != "") & (words > max(least, 1)) & few).withColumn("bigrams", _bigrams(F.col("norm"))).withColumn("a", F.size("bigrams"))
    segs = segs.where(F.col("a").between(max(least, 1), most)).select("row", "doc_id", "segment", "a", F.explode("bigrams").alias("bigram"))
    fits = (F.col("a") <= F.col("b") * F.lit(up) + 1e-9) & (F.col("b") <= F.col("a") * F.lit(up) + 1e-9)
    told = F.count_if(F.array_contains("telling", F.col("bigram")))
    shared = segs.join(probes, "bigram").where(fits).groupBy("row", "doc_id", "segment", "template", "licence", "a", "b").agg(F.count("*").alias("n_shared"), told.alias("told"), F.max(F.size("telling")).alias("telling"))
    shared = shared.where("told = telling")
    dice = ((F.lit(2.0) * F.col("n_shared")) / (F.col("a") + F.col("b"))).alias("dice")
    found = shared.select("row", "doc_id", "segment", F.lit(-1).alias("start"), "licence", "template", "n_shared", dice).where(F.col("dice") >= threshold)
    best = F.row_number().over(W.partitionBy("row", "segment").orderBy(F.desc("n_shared"), F.desc("dice"), "template"))
    found = found.withColumn("place", best).where("segment >= 0 OR place = 1").drop("row", "place")

    # runs: places of a template's bigrams, and how many distinct ones lie within as many words from each of them on
    w = F.split(whole, " ")
    pairs = F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda x, y: F.concat_ws(" ", x, y))
    places = rows.where(F.size(w) > 1).select("row", F.posexplode(pairs).alias("start", "bigram")).join(probes, "bigram")
    # ranges of m - 1 bigrams for each template at once: places are measured in such ranges
    ahead = F.expr("size(collect_set(bigram) OVER (PARTITION BY row, template ORDER BY start / (m - 1) RANGE BETWEEN CURRENT ROW AND 0.9999999D FOLLOWING))")
    places = places.withColumn("n_shared", ahead.cast("long")).where(F.col("n_shared") >= F.col("b") / up - 1e-9)
    texts = rows.select("row", "doc_id", w.alias("w"))
    run = F.slice("w", F.col("start") + 1, F.col("m"))
    runs = places.join(texts, "row").withColumn("own", _bigrams(F.array_join(run, " "))).withColumn("a", F.size("own")).where(F.size(F.array_except("telling", "own")) == 0)
    runs = runs.select("row", "doc_id", "start", "licence", "template", "n_shared", dice, "m")
    first = F.row_number().over(W.partitionBy("row", "template").orderBy(F.desc("dice"), "start"))
    runs = runs.where(F.col("dice") >= threshold).withColumn("place", first).where("place = 1")
    # a text has at most one run of each template here
    both = runs.groupBy("row", "doc_id").agg(F.collect_list(F.struct("n_shared", "dice", (-F.col("template")).alias("later"), "start", "m", "licence", "template")).alias("runs"))
    over = lambda x, y: (y["start"] < x["start"] + x["m"]) & (x["start"] < y["start"] + y["m"])
    better = lambda x, y: F.struct(y["n_shared"], y["dice"], y["later"]) > F.struct(x["n_shared"], x["dice"], x["later"])
    kept = F.filter("runs", lambda x: ~F.exists("runs", lambda y: over(x, y) & better(x, y)))
    runs = both.select("doc_id", F.inline(kept)).withColumn("segment", F.lit(-2))
    return found.unionByName(runs.select(*found.columns))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


def _values() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({i}, {quote(n)}, {quote(t)}, [{', '.join(map(quote, telling(t)))}]::VARCHAR[])" for i, (n, t) in enumerate(TEMPLATES))


ORACLE = rf"""
WITH t0(template, licence, body, telling) AS (VALUES {_values()}),
d AS (SELECT doc_id, row_number() OVER () AS r, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT r, doc_id, unnest(range(0, len(ls))) AS segment, unnest(ls) AS raw FROM d),
n AS (SELECT r, doc_id, segment, trim(regexp_replace(lower(raw), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS norm FROM l),
w AS (SELECT r, any_value(doc_id) AS doc_id, -1 AS segment, string_agg(norm, ' ' ORDER BY segment) FILTER (norm <> '') AS norm FROM n GROUP BY r HAVING count(*) > 1),
s AS (SELECT r, doc_id, segment, string_split(norm, ' ') AS w FROM (SELECT * FROM n UNION ALL SELECT * FROM w)
      WHERE norm <> ''),
g AS (SELECT r, doc_id, segment, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM s WHERE len(w) > 1),
t AS (SELECT template, licence, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b
      FROM (SELECT template, licence, string_split(trim(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM t0)),
ge AS (SELECT r, doc_id, segment, len(b) AS a, unnest(b) AS bigram FROM g),
te AS (SELECT template, licence, len(b) AS b, unnest(b) AS bigram FROM t),
x AS (SELECT r, doc_id, segment, licence, template, a, b, count(*) AS n_shared, count(*) FILTER (list_contains(telling, bigram)) AS told, any_value(len(telling)) AS tells FROM ge JOIN te USING (bigram) JOIN (SELECT template, telling FROM t0) USING (template) GROUP BY r, doc_id, segment, licence, template, a, b),
tm AS (SELECT template, len(string_split(trim(regexp_replace(lower(body), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ')) AS m FROM t0),
pw AS (SELECT r, any_value(doc_id) AS doc_id, string_split(string_agg(norm, ' ' ORDER BY segment) FILTER (norm <> ''), ' ') AS w FROM n GROUP BY r),
bp AS (SELECT r, p, w[p] || ' ' || w[p + 1] AS bigram FROM (SELECT r, w, unnest(range(1, len(w))) AS p FROM pw)),
mt AS (SELECT r, p, template, licence, m, b, bigram FROM bp JOIN te USING (bigram) JOIN tm USING (template)),
rn AS (SELECT x.r, x.p, x.template, x.licence, x.m, x.b, count(DISTINCT y.bigram) AS n_shared FROM mt x JOIN mt y ON x.r = y.r AND x.template = y.template AND y.p BETWEEN x.p AND x.p + x.m - 2 GROUP BY ALL),
sc AS (SELECT rn.*, doc_id, list_has_all(list_transform(range(p, least(p + m - 1, len(w))), lambda i: w[i] || ' ' || w[i + 1]), telling) AS told, 2.0::DOUBLE * n_shared / (len(list_distinct(list_transform(range(p, least(p + m - 1, len(w))), lambda i: w[i] || ' ' || w[i + 1]))) + b) AS dice FROM rn JOIN pw ON rn.r = pw.r JOIN (SELECT template AS tt, telling FROM t0) ON tt = template WHERE n_shared >= 2 * b / 3.0 - 1e-6),
bs AS (SELECT *, row_number() OVER (PARTITION BY r, template ORDER BY dice DESC, p) AS place FROM sc WHERE dice >= {THRESHOLD} AND told),
b1 AS (SELECT * FROM bs WHERE place = 1),
keep AS (SELECT * FROM b1 x WHERE NOT EXISTS (SELECT 1 FROM b1 y WHERE y.r = x.r AND y.p < x.p + x.m AND x.p < y.p + y.m AND (y.n_shared, y.dice, -y.template) > (x.n_shared, x.dice, -x.template)))
SELECT doc_id, CAST(segment AS INTEGER) AS segment, -1 AS start, licence, template, n_shared, dice FROM
(SELECT *, row_number() OVER (PARTITION BY r, segment ORDER BY n_shared DESC, dice DESC, template) AS place FROM
 (SELECT *, 2.0::DOUBLE * n_shared / (a + b) AS dice FROM x WHERE told = tells) WHERE dice >= {THRESHOLD}) WHERE segment >= 0 OR place = 1
UNION ALL SELECT doc_id, -2, CAST(p - 1 AS INTEGER), licence, template, n_shared, dice FROM keep
"""
