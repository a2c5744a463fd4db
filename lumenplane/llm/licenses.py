"""Licence scan by canonical digests.

A text is normalised (case, copyright notices, punctuation, equivalent spellings) and its SHA-256 is
looked up, whole, among the digests of known licences; every line of a text is looked up in the same
way, since licences are often granted in one line. No part of a text is compared otherwise. A notice is
a line that begins with "copyright" and its sign, a year or a placeholder, so that a text wrapped in front
of that word keeps its line. Lines that lack a word that all known texts need are not normalised at all.

Defined results: null and empty texts, and texts that normalise to nothing, match nothing and have a
null digest. Rows that share a doc_id are told apart by their text; repeated rows all stay. Extra columns
are ignored. Only DataFrame functions are used. The table of known digests is a constant of this module, below
two hundred rows; that is the proven bound behind its broadcast. Full texts are known with and without
their title lines and what follows their terms, wrapped as published and with a line for each
paragraph.
"""

from __future__ import annotations

import functools
import operator
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Equivalent spellings, each rewritten to the second word.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("gnu gpl", "gnu general public license"),
    ("v2 0", "version 2 0"),
    ("v3", "version 3"),
    ("https", "http"),
)

# Public licence texts and one-line grants; full texts with titles follow below.
KNOWN = (
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "SPDX-License-Identifier: CC0-1.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("ISC", "SPDX-License-Identifier: ISC"),
)

_ISC = dict(KNOWN[:2])["ISC"]
_WTFPL = """Everyone is permitted to copy and distribute verbatim or modified
copies of this license document, and changing it is allowed as long
as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""
#: Licence, its text (None: the file of its name in texts), its titles, and where its terms end if more may follow.
FULL = (
    ("MIT", KNOWN[0][1], ("MIT License", "The MIT License", "The MIT License (MIT)"), None),
    ("ISC", _ISC, ("ISC License", "The ISC License"), None),
    ("ISC", _ISC.replace("modify, and/or distribute", "modify, and distribute"), ("ISC License", "The ISC License"), None),
    ("WTFPL", _WTFPL, ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004", "WTFPL"), None),
    ("Apache-2.0", None, ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", "Apache License\nVersion 2.0, January 2004"), "END OF TERMS AND CONDITIONS"),
    ("GPL-2.0-only", None, ("GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991",), "END OF TERMS AND CONDITIONS"),
    ("GPL-3.0-only", None, ("GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007",), "END OF TERMS AND CONDITIONS"),
    ("LGPL-2.1-only", None, ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999",), "END OF TERMS AND CONDITIONS"),
    ("LGPL-3.0-only", None, ("GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007",), None),
    ("MPL-2.0", None, ("Mozilla Public License Version 2.0", "Mozilla Public License, version 2.0"), None),
    ("CC0-1.0", None, ("Creative Commons Legal Code\n\nCC0 1.0 Universal", "CC0 1.0 Universal"), None),
    ("Unlicense", None, ("The Unlicense", "Unlicense"), None),
    *((f"BSD-{n}-Clause", None, (f"BSD {n}-Clause License", f"The BSD {n}-Clause License", f"BSD {n}-Clause License\nAll rights reserved.", "All rights reserved."), None) for n in (2, 3)),
)


def _versions(text: str | None, name: str, titles: tuple, end: str | None) -> list[str]:
    """A licence with and without its title and what follows its terms, as wrapped and by paragraphs."""
    text = text or (Path(__file__).parent / "texts" / f"{name}.txt").read_text("utf-8")
    bodies = [text, text[: text.index(end) + len(end)]] if end else [text]
    if name.startswith("BSD"):
        bodies.append(re.sub(r"(?m)^\s*[123]\. ", "* ", text))
    notice = re.compile(r"(?im)^\W*copyright (?:\(c\)|\d{4}).*\n")
    bodies += ["\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", notice.sub("", b))) for b in bodies]
    return [f"{title}\n\n{b}" for title in ("", *titles) for b in bodies]


KNOWN += tuple(dict.fromkeys((name, version) for name, text, titles, end in FULL for version in _versions(text, name, titles, end)))

_COPYRIGHT = "(?m)^[^a-z0-9\\n]*(?:copyright:?[ \\t]+(?:\\(c\\)|©|[0-9]{4}|\\[|<)|(?:\\(c\\)|©)[ \\t]*(?:copyright[ \\t]+)?[0-9]{4})[^\\n]*$"


def canonical(text: Column) -> Column:
    """Lower case, no copyright notices, words of ASCII letters and digits with single blanks, one spelling."""
    words = F.regexp_replace(F.regexp_replace(F.lower(text), _COPYRIGHT, ""), "[^a-z0-9]+", "  ")
    padded = F.concat(F.lit(" "), F.trim(words), F.lit(" "))  # each word has two blanks of its own
    for old, new in SPELLINGS:
        padded = F.replace(padded, F.lit(f" {old} ".replace(" ", "  ")[1:-1]), F.lit(f" {new} ".replace(" ", "  ")[1:-1]))
    return F.trim(F.replace(padded, F.lit("  "), F.lit(" ")))


def needles(texts) -> list[str]:
    """Words of which every text with the canonical form of a known one holds at least one, in lower case."""

    def before(word: str) -> frozenset[str]:
        """What a word may have been spelled from: itself, or the longest word of an equivalent."""
        found, todo = set(), [word]
        while todo:
            w = todo.pop()
            if w not in found:
                found.add(w)
                todo += [max(old.split(), key=len) for old, new in SPELLINGS if w in new.split()]
        return frozenset(found)

    held = []
    for _, text in texts:
        words = f" {' '.join(re.findall('[a-z0-9]+', text.lower()))} "
        for old, new in SPELLINGS:
            words = re.sub(rf"(?<= ){old}(?= )", new, words)
        held.append({w: before(w) for w in set(words.split())})
    chosen: set[str] = set()
    rarity = {w: sum(w in words for words in held) for words in held for w in words}
    for words in sorted(held, key=len):
        if words and not any(own <= chosen for own in words.values()):
            chosen |= words[max(words, key=lambda w: (min(len(x) for x in words[w]) >= 6, rarity[w], w))]
    return sorted(w for w in chosen if not any(o != w and o in w for o in chosen))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical text; null if nothing is left of it."""
    return F.sha2(F.nullif(canonical(text), F.lit("")), 256)


def known(spark: SparkSession, texts=KNOWN) -> DataFrame:
    return spark.createDataFrame(list(texts), "license string, text string").select(digest(F.col("text")).alias("digest"), "license").distinct()


def scan(docs: DataFrame, texts=KNOWN, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, text_digest, license (of the whole text) and line_licenses (sorted, joined by commas)."""
    spark = docs.sparkSession
    table = F.broadcast(known(spark, texts))
    whole = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    wanted = needles(texts)
    may_hold = lambda c: functools.reduce(operator.or_, [F.contains(F.lower(c), F.lit(w)) for w in wanted])
    digests = whole.select("k", F.xxhash64("t").alias("h"), digest(F.col("t")).alias("text_digest"))
    lines = whole.where(may_hold(F.col("t"))).select("k", F.xxhash64("t").alias("h"), F.explode(F.array_distinct(F.filter(F.split("t", "\n"), may_hold))).alias("line"))
    hits = lines.select("k", "h", digest(F.col("line")).alias("digest")).join(table, "digest").groupBy("k", "h").agg(F.array_join(F.array_sort(F.collect_set("license")), ",").alias("line_licenses"))
    by_text = digests.join(table.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
    same = by_text["k"].eqNullSafe(hits["k"]) & (by_text["h"] == hits["h"])
    return by_text.join(hits, same, "left").select(by_text["k"].alias(key), "text_digest", "license", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"))
