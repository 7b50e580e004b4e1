"""License notices by the Dice coefficient over word bigrams, in DataFrame functions alone.

A text is cut into pieces at line and sentence ends; each is lower-cased and reduced to words. Pieces,
and stretches of neighbouring pieces, are compared with templates, so a notice is found however its
lines are wrapped. The sets of word bigrams of a stretch (n of them) and a template (m) reach a
coefficient t only if they share m t / (2 - t) of the template's: a text that does not hold so many of
a template's bigrams anywhere is not compared with it. A few words of the templates are chosen so that
every match holds one of them, and texts without any are left at once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The coefficient in percent that counts as a match.
PERCENT = 80
NOT_WORD = r"[^\p{L}\p{N}]+"
SENTENCE_END = r"([.!?])[ \t]+"
#: Marks, while a text is cut, a sentence that does not begin its line.
INSIDE = "\x01"

#: Words that many texts hold are the last to be chosen for the first look at a text.
COMMON = frozenset("a an and any by for from in is it of on or that the this to under with without you".split())

# Customary notices, one sentence each. A licence may have several.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3 or later."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use "
     "this file except in compliance with the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, "
     "are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
     "International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
     "International License."),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the "
     "terms of the GNU General Public License as published by the Free Software Foundation, either "
     "version 3 of the License, or (at your option) any later version."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
     "software and associated documentation files (the \"Software\"), to deal in the Software without "
     "restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
    "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission. "
)
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR "
    "ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF "
    "ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions:"
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
)


def _gnu(name: str, version: str) -> str:
    return (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} "
        f"as published by the Free Software Foundation, either version {version} of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT "
        "ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
        f"See the {name} for more details. You should have received a copy of the {name} along with this program."
    )


# Notices uncut, of one sentence or many.
NOTICES = (
    ("AGPL-3.0", _gnu("GNU Affero General Public License", "3")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
     "except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
     "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
     "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
     "permissions and limitations under the License."),
    ("BSD-2-Clause", _BSD + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_DISCLAIMER),
    ("GPL-2.0", _gnu("GNU General Public License", "2")),
    ("GPL-3.0", _gnu("GNU General Public License", "3")),
    ("ISC", _ISC),
    ("ISC", _ISC + " THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO "
     "THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
     "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING "
     "FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
     "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-3.0", _gnu("GNU Lesser General Public License", "3")),
    ("MIT", _MIT),
    ("MIT", _MIT + " The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, "
     "EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
     "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
     "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN "
     "CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of "
     "the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
     "modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
     "compiled binary, for any purpose, commercial or non-commercial, and by any means."),
)


def words_of(notice: str) -> list[str]:
    return re.findall(r"[^\W_]+", notice.lower())


def bigrams_of(words: list[str]) -> list[str]:
    """Distinct bigrams in order; a single word is its own one."""
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    return list(dict.fromkeys(pairs or words))


def least_shared(m: int, percent: int = PERCENT) -> int:
    """The fewest bigrams that a match shares with a template of m: ceil(m t / (2 - t))."""
    return -(-m * percent // (200 - percent))


def telling_words(templates=TEMPLATES, percent: int = PERCENT) -> list[str]:
    """Words of which every match of every template holds at least one.

    For each template more bigrams hold one of the words than a match can be without.
    """
    open_grams: list[set[str]] = []
    needed: list[int] = []
    for _, notice in templates:
        grams = bigrams_of(words_of(notice))
        open_grams.append(set(grams))
        needed.append(len(grams) - least_shared(len(grams), percent) + 1)
    holding = [{w: {g for g in grams if w in g.split()} for w in {w for g in grams for w in g.split()}} for grams in open_grams]
    chosen: list[str] = []
    pool = sorted({w for held in holding for w in held})
    nobody: set[str] = set()

    def gain(word: str) -> int:
        each = zip(needed, open_grams, holding, strict=True)
        return sum(min(max(need, 0), len(grams & held.get(word, nobody))) for need, grams, held in each)

    while any(need > 0 for need in needed):
        # Long and rare words first.
        gains = {w: gain(w) for w in pool}
        better = [w for w in pool if gains[w]]
        rare = [w for w in better if w not in COMMON]
        longest = [w for w in rare if len(w) > 4] or [w for w in rare if len(w) > 1] or better
        word = min(longest, key=lambda w: (-gains[w], w))
        chosen.append(word)
        for k, held in enumerate(holding):
            found = open_grams[k] & held.get(word, nobody)
            needed[k] -= len(found)
            open_grams[k] -= found
    return chosen


def pieces_of(text: Column) -> Column:
    """The words of each line's sentences; inside is true for those that follow another on their line."""
    marked = F.regexp_replace(F.translate(text, INSIDE, " "), SENTENCE_END, f"$1\n{INSIDE}")
    pieces = F.transform(
        F.split(marked, "\n"),
        lambda s: F.struct(
            F.split(F.trim(F.regexp_replace(s, NOT_WORD, " ")), " ").alias("words"),
            F.startswith(s, F.lit(INSIDE)).alias("inside"),
        ),
    )
    return F.filter(pieces, lambda p: p["words"][0] != "")


def bigrams(words: Column) -> Column:
    n = F.size(words)
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(n - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.array_distinct(F.when(n < 2, words).otherwise(pairs))


def template_table(spark, templates=TEMPLATES, notices=NOTICES, percent: int = PERCENT) -> DataFrame:
    rows = []
    for number, (licence, notice) in enumerate((*templates, *notices)):
        words = words_of(notice)
        grams = bigrams_of(words)
        rows.append((number, licence, grams, least_shared(len(grams), percent), 2 * len(words), number >= len(templates)))
    return spark.createDataFrame(
        rows, "template int, license_id string, theirs array<string>, least int, most_words int, whole boolean"
    )


def scan(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT, notices=NOTICES) -> DataFrame:
    """doc_id, license_id, dice, n_sentences of each licence found in each document.

    docs holds doc_id and text; other columns are ignored. A find is a piece (a line's sentence), or a
    stretch of neighbouring pieces, that matches a template; a stretch has at most twice the template's
    words, and one that matches a sentence runs over line ends, not over sentence ends within a line. What starts at a piece counts for its best template (the first on a tie). Of finds that
    overlap one counts: a stretch that matches a whole notice before a piece, a piece before a stretch
    that matches a sentence, then the better one. n_sentences is the number of a licence's finds, dice
    their best coefficient. Documents without a notice, null and empty texts give no row; rows that
    repeat a doc_id are counted together; a null doc_id is a group of its own; an empty table gives an
    empty result.
    """
    lower = F.lower("text")
    telling = F.lit(False)
    for word in telling_words((*templates, *notices), percent):
        # The plain search is fast and rules most texts out; what it finds must be a whole word.
        whole = lower.rlike(rf"(?<![\p{{L}}\p{{N}}]){word}(?![\p{{L}}\p{{N}}])")
        telling = telling | (F.contains(lower, F.lit(word)) & whole)
    # The templates are a constant of the module, so their broadcast has a known size.
    table = F.broadcast(template_table(docs.sparkSession, templates, notices, percent))
    listed = [bigrams_of(words_of(notice)) for _, notice in (*templates, *notices)]
    every = F.lit(sorted({g for grams in listed for g in grams}))
    # A notice of one word is its own bigram.
    singles = any(" " not in g for grams in listed for g in grams)
    said = F.concat(bigrams(F.col("words")), "words") if singles else bigrams(F.col("words"))
    held = (
        docs.select("doc_id", "text")
        .where(telling)
        .withColumn("words", F.split(F.trim(F.regexp_replace(lower, NOT_WORD, " ")), " "))
        # The number keeps the condition on known from being pushed below it and computed twice.
        .select("doc_id", "text", F.array_intersect(said, every).alias("known"), F.monotonically_increasing_id().alias("no"))
        .where(F.size("known") >= min(least_shared(len(grams), percent) for grams in listed))
        .join(table, F.size(F.array_intersect("known", "theirs")) >= F.col("least"))
        .drop("known")
    )
    return _settled(_finds(held.withColumn("parts", pieces_of(F.lower("text"))), percent))


def _finds(held: DataFrame, percent: int) -> DataFrame:
    """What matches a document's template among its pieces (parts) and stretches of them.

    The pieces stay one value while stretches are cut from it: a row for each would copy them all.
    """
    all_starts = F.sequence(F.lit(1), F.size("parts"))

    def words_at(first: Column, n: Column) -> Column:
        return F.flatten(F.slice("parts", first, n)["words"])

    def scored(texts: Column) -> Column:
        """Shared bigrams, both sides' bigrams and place of each list of words."""
        return F.transform(
            F.transform(texts, bigrams),
            lambda g, i: F.struct(
                F.size(F.array_intersect(g, "theirs")).alias("shared"),
                (F.size(g) + F.size("theirs")).alias("both"),
                i.alias("at"),
            ),
        )

    def good(x: Column) -> Column:
        return x["shared"] * 200 >= x["both"] * percent

    def find(kind: Column, x: Column, first: Column, last: Column) -> Column:
        return F.struct(
            kind.alias("kind"),
            (-(x["shared"] * 2 / x["both"])).alias("less"),
            F.col("template").alias("template"),
            first.alias("first"),
            last.alias("last"),
            F.col("license_id").alias("license_id"),
        )

    def run(first: Column) -> Column:
        """How many pieces a stretch that starts here can have; each has a word at least."""
        return F.aggregate(
            F.transform(F.slice("parts", first, F.col("most_words")), lambda p: F.size(p["words"])),
            F.struct(F.lit(0).alias("words"), F.lit(0).alias("pieces")),
            lambda acc, n: F.struct(
                (acc["words"] + n).alias("words"),
                (acc["pieces"] + F.when(acc["words"] + n <= F.col("most_words"), 1).otherwise(0)).alias("pieces"),
            ),
            lambda acc: acc["pieces"],
        )

    alone = F.transform(
        F.filter(scored(F.col("parts")["words"]), good), lambda x: find(F.lit(1), x, x["at"] + 1, x["at"] + 1)
    )
    runs = F.filter(
        F.transform(all_starts, lambda i: F.struct(i.alias("first"), run(i).alias("run"))), lambda s: s["run"] > 1
    )
    # The longest stretch of a start holds all the bigrams that its stretches hold.
    longest = scored(F.transform(runs, lambda s: words_at(s["first"], s["run"])))
    starts = F.transform(
        F.filter(F.arrays_zip(runs.alias("s"), longest.alias("x")), lambda z: z["x"]["shared"] >= F.col("least")),
        lambda z: z["s"],
    )

    def stretches(s: Column) -> Column:
        of_start = scored(F.transform(F.sequence(F.lit(2), s["run"]), lambda n: words_at(s["first"], n)))
        # A sentence runs over line ends only.
        joined = lambda x: F.col("whole") | ~F.exists(
            F.slice("parts", s["first"] + 1, x["at"] + 1), lambda p: p["inside"]
        )
        return F.transform(
            F.filter(of_start, lambda x: good(x) & joined(x)),
            lambda x: find(F.when(F.col("whole"), 0).otherwise(2), x, s["first"], s["first"] + x["at"] + 1),
        )

    found = F.concat(alone, F.flatten(F.transform("starts", stretches)))
    return (
        held.withColumn("starts", starts)
        .select("no", "doc_id", F.explode(found).alias("match"))
    )


def _settled(finds: DataFrame) -> DataFrame:
    """Of each document's finds those that count, summed up for each licence."""
    best = finds.groupBy("no", "doc_id", F.col("match.kind"), F.col("match.first")).agg(F.min("match").alias("match"))
    taken = F.aggregate(
        F.slice("ordered", 2, F.size("ordered")),
        F.slice("ordered", 1, 1),
        lambda acc, m: F.when(
            F.exists(acc, lambda a: (a["first"] <= m["last"]) & (m["first"] <= a["last"])), acc
        ).otherwise(F.concat(acc, F.array(m))),
    )
    each = (
        best.groupBy("no", "doc_id")
        .agg(F.array_sort(F.collect_list("match")).alias("ordered"))
        .select("doc_id", F.explode(taken).alias("match"))
    )
    return each.groupBy("doc_id", F.col("match.license_id").alias("license_id")).agg(
        F.max(-F.col("match.less")).alias("dice"), F.count("*").alias("n_sentences")
    )


def oracle(templates=TEMPLATES, percent: int = PERCENT) -> str:
    """The same rows over table documents, in DuckDB's SQL."""
    listed = ",\n    ".join(
        f"({k}, '{licence}', [{', '.join(repr(g) for g in bigrams_of(words_of(notice)))}])"
        for k, (licence, notice) in enumerate(templates)
    )
    return f"""WITH templates(template, license_id, theirs) AS (VALUES
    {listed}),
  sentences AS (
    SELECT doc_id, unnest(string_split(
      regexp_replace(lower(text), '([.!?])[ \\t]+', '\\1' || chr(10), 'g'), chr(10))) AS s
    FROM documents),
  numbered AS (
    SELECT doc_id, row_number() OVER () AS no,
      string_split(trim(regexp_replace(s, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS w
    FROM sentences),
  ours AS (
    SELECT doc_id, no, list_distinct(CASE WHEN len(w) < 2 THEN w
      ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS g
    FROM numbered),
  scored AS (
    SELECT doc_id, no, template, license_id,
      len(list_intersect(g, theirs)) AS shared, len(g) + len(theirs) AS total
    FROM ours JOIN templates ON len(g) * {percent} <= len(theirs) * {200 - percent}
      AND len(theirs) * {percent} <= len(g) * {200 - percent}),
  best AS (
    SELECT *, row_number() OVER (PARTITION BY no
      ORDER BY CAST(shared * 2 AS DOUBLE) / total DESC, template) AS r
    FROM scored WHERE shared * 200 >= total * {percent})
SELECT doc_id, license_id, max(CAST(shared * 2 AS DOUBLE) / total) AS dice, count(*) AS n_sentences
FROM best WHERE r = 1 GROUP BY doc_id, license_id"""
