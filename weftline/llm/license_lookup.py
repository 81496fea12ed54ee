"""Licence texts by canonical digest.

A text is made canonical: typographic quotes, dashes, bullets and spaces to plain ones and marks without width out, lower case, lines of copyright
notices and marks of list items out, punctuation and white space to single spaces, equivalent spellings to one.  The digest of the result is looked up, by a hash
join, among the digests of known texts, made the same way.  Entire texts are looked up:
the document as a whole, and each of its lines by itself, since a notice is a line.

A copyright notice is a line that, comment marks aside, says "copyright" or its sign and then a sign, a year or a
name, or that reserves all rights and says no more.  Up to two lines that go on with it (an empty line comes after them, and none starts as a known
text does) belong to it.  A licence's own lines about copyright stay, however they are wrapped.

Known are the texts in KNOWN, with and without their usual headings, and those of the folder ``licences``, a file for each,
named as in the SPDX list; a caller may give a table of others.

Only DataFrame functions are used.  Texts are read once; lines whose canonical length is
that of no known text are not digested, as they can't be equal to one.

Defined results: a null text has a null digest and no licence; a text without letters or digits has the
digest of the empty string and no licence; known texts that are equal in canonical form give the
first name in order; repeated rows are looked up alike; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache, reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

# Spellings that licence matching treats as equal.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "calibre": "caliber",
    "cancelled": "canceled",
    "capitalisations": "capitalizations",
    "catalogue": "catalog",
    "categorise": "categorize",
    "centre": "center",
    "emphasised": "emphasized",
    "favour": "favor",
    "favourite": "favorite",
    "fulfil": "fulfill",
    "fulfilment": "fulfillment",
    "initialise": "initialize",
    "judgement": "judgment",
    "labelling": "labeling",
    "labour": "labor",
    "licence": "license",
    "licences": "licenses",
    "licenced": "licensed",
    "maximise": "maximize",
    "modelled": "modeled",
    "modelling": "modeling",
    "non commercial": "noncommercial",
    "offence": "offense",
    "optimise": "optimize",
    "organisation": "organization",
    "organisations": "organizations",
    "organise": "organize",
    "owner": "holder",
    "owners": "holders",
    "per cent": "percent",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "recognised": "recognized",
    "signalling": "signaling",
    "sub license": "sublicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_WTFPL = """Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""

# Published licence texts and their usual headings.
TEXTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "0BSD": (_ISC.replace(", provided that the above copyright notice and this permission notice appear in all copies", ""), ("BSD Zero Clause License", "Zero-Clause BSD")),
    "BSD-2-Clause": (_BSD_HEAD + _BSD_TAIL, ("BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", "BSD License")),
    "BSD-3-Clause": (_BSD_HEAD + _BSD_THIRD + _BSD_TAIL, ("BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "BSD License")),
    "BSL-1.0": (_BOOST, ("Boost Software License - Version 1.0 - August 17th, 2003",)),
    "ISC": (_ISC, ("ISC License", "The ISC License", "ISC License (ISC)")),
    "MIT": (_MIT, ("MIT License", "The MIT License", "The MIT License (MIT)")),
    "Unlicense": (_UNLICENSE, ("The Unlicense",)),
    "Unlicense ": (_UNLICENSE + "\nFor more information, please refer to <https://unlicense.org>", ("The Unlicense",)),
    "Unlicense  ": (_UNLICENSE + "\nFor more information, please refer to <http://unlicense.org/>", ()),
    "WTFPL": (_WTFPL, ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004",)),
    "Zlib": (_ZLIB, ("zlib License", "The zlib License")),
}
# One-line notices.
KNOWN: list[tuple[str, str]] = [
    *((name.strip(), f"{heading}\n\n{text}".strip()) for name, (text, headings) in TEXTS.items() for heading in ("", *headings)),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "GPL-3.0", "ISC", "MIT", "WTFPL", "Zlib")),
]


@lru_cache(maxsize=1)
def known_texts() -> list[tuple[str, str]]:
    """(license, text) of KNOWN and of the files beside this module, with and without advice on how to apply them."""
    out = list(KNOWN)
    for file in sorted((Path(__file__).parent / "licences").glob("*.txt")):
        text = file.read_text(encoding="utf-8")
        terms, end, rest = text.partition("END OF TERMS AND CONDITIONS")
        out += [(file.stem, text)] + ([(file.stem, terms + end)] if rest.strip() else [])
    return out


# Typographic characters, and what each stands for; those after the last pair stand for nothing.
PLAIN = {
    "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000": " ",
    "\u0085\u2028\u2029": "\n",
    "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u2043": "-",
    "\u2018\u2019\u201a\u201b\u2032\u2039\u203a": "'",
    "\u201c\u201d\u201e\u201f\u2033\u00ab\u00bb": '"',
    "\u2022\u2023\u2219\u25aa\u25ab\u25cf\u25cb\u25e6\u25a0\u25a1\u00b7": "*",
    "\u2026": ".",
}
NOTHING = "\ufeff\u200b\u200c\u200d\u2060\u00ad"
FROM, TO = "".join(PLAIN) + NOTHING, "".join(to * len(of) for of, to in PLAIN.items())

#: Comment marks before a line, and words that mark one.
_MARKS = r"[ \t\r/*#;|!<>%\"'.-]*"
_REMARK = r"(?:rem|dnl)(?![a-z0-9_])"
#: Words after "copyright" that are a licence's own words and no name.
_OWN_WORDS = "notices?|holders?|owners?|laws?|licen[sc]es?|statements?|interests?|ownership|treat(?:y|ies)|protections?|permissions?|disclaimers?|status|act|and|or|in|to|of|is|on|as|for|by its|under|grant|resulting|governing|assignment|disputes?|infringements?|rights?|works?|material"
_NOTICE = rf"(?:copyright[ \t:]*(?:\(c\)|©|&copy;|[0-9<\[{{])|(?:\(c\)|©|&copy;)[ \t]*(?:copyright|[0-9])|copyright[ \t]+(?!(?:{_OWN_WORDS})\b)[a-z]|all rights reserved[ \t\r.!]*$)[^\n]*"
COPYRIGHT_LINE = rf"(?m)^{_MARKS}(?:{_REMARK}{_MARKS})?{_NOTICE}"
_ITEM = r"\(?(?:[0-9]{1,2}|[a-z])[.)](?=[ \t])"
ITEM_MARK = rf"(?m)^{_MARKS}(?:{_REMARK}(?:{_MARKS}{_ITEM})?|{_ITEM})"
PUNCTUATION = r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f]+"


@lru_cache(maxsize=1)
def first_words() -> list[str]:
    """With which one or two words known texts and their paragraphs start, whatever stands between the words."""
    starts = {tuple(re.findall("[a-z]+", p.lower())[:2]) for _, t in known_texts() for p in re.split(r"\n\s*\n", t)}
    return sorted("[^a-z0-9]+".join(w) for w in starts if w and w[0] != "copyright")


@lru_cache(maxsize=1)
def notice_pattern() -> str:
    """A copyright line with the lines that go on with it."""
    marks = rf"{_MARKS}(?:{_REMARK}{_MARKS})?"
    on = rf"\n(?!{marks}(?:(?:{_ITEM}[ \t]*)?(?:{'|'.join(first_words())})(?![a-z0-9_])|$))[^\n]*"
    return rf"{COPYRIGHT_LINE}(?:(?:{on}){{1,2}}(?=\n{marks}(?:\n|\z)))?"


@lru_cache(maxsize=1)
def _spelled() -> str:
    """Any of SPELLINGS, by first letter."""
    by: dict[str, list[str]] = {}
    for old in SPELLINGS:
        by.setdefault(old[0], []).append(old[1:].replace(" ", "  "))
    return " (?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by.items())) + ") "


def canonical_lines(text: Column) -> Column:
    """Canonical text with its lines apart; each line starts and ends with a space."""
    text = F.when(F.octet_length(text) == F.char_length(text), text).otherwise(F.translate(text, FROM, TO))
    out = F.regexp_replace(F.regexp_replace(F.lower(text), notice_pattern(), ""), ITEM_MARK, "")
    out = F.concat(F.lit(" "), F.regexp_replace(out, PUNCTUATION, "  "), F.lit(" "))
    return F.replace(out, F.lit("\n"), F.lit(" \n "))


def respelled(lines: Column) -> Column:
    """Equivalent spellings as one, in texts that have any."""
    one = reduce(lambda s, x: F.replace(s, F.lit(f" {x[0].replace(' ', '  ')} "), F.lit(f" {x[1]} ")), SPELLINGS.items(), lines)
    return F.when(lines.rlike(_spelled()), one).otherwise(lines)


def whole(lines: Column) -> Column:
    return F.trim(F.regexp_replace(lines, "[ \\n]+", " "))


def digests_of(known: DataFrame) -> DataFrame:
    """(license, digest, length) of known texts (license, text), by first name where equal."""
    lines = known.select("license", canonical_lines(F.col("text")).alias("c"))
    canonical = lines.select("license", whole(respelled(F.col("c"))).alias("c")).where("c <> ''")
    return canonical.groupBy(F.sha2("c", 256).alias("digest"), F.length("c").alias("length")).agg(F.min("license").alias("license"))


def lookup(docs: DataFrame, scratch: Scratch, known: DataFrame | None = None) -> DataFrame:
    """doc_id, text_digest, license (of the whole text), notices (licences of single lines, joined by commas)."""
    spark = docs.sparkSession
    known = known if known is not None else spark.createDataFrame(known_texts(), "license string, text string")
    known = scratch.save(digests_of(known), "known")
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    lines = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), canonical_lines(F.col("text")).alias("c"))
    lines = lines.withColumn("c", respelled(F.col("c")))
    # sent to the driver and back: as many lengths as there are known texts at most
    lengths = F.array(*[F.lit(r["length"]) for r in known.select("length").distinct().collect()]).cast("array<int>")
    single = F.transform(F.split("c", "\n"), lambda x: F.trim(F.regexp_replace(x, " +", " ")))
    notices = F.array_distinct(F.transform(F.filter(single, lambda x: F.array_contains(lengths, F.length(x))), lambda x: F.sha2(x, 256)))
    rows = scratch.save(lines.select("doc_id", "row", F.sha2(whole(F.col("c")), 256).alias("text_digest"), notices.alias("notices")), "rows")
    digests = known.select("digest", "license")
    found = rows.where(F.size("notices") > 0).select("row", F.explode("notices").alias("digest")).join(digests, "digest")
    found = scratch.save(found.groupBy("row").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices")), "found")
    out = rows.select("doc_id", "row", "text_digest").join(found, "row", "left")
    return out.join(digests.withColumnRenamed("digest", "text_digest"), "text_digest", "left").select("doc_id", "text_digest", "license", "notices")


def op5_license_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup(table(spark, sf_dir, "documents"), Scratch(spark, "op5"))


def _sql() -> str:
    """By lists of lines and words: a line is a notice if it starts like one and goes on like none of the licence's own words."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    head, remark = "^[[:space:]/*#;|!<>%\"'.-]*", "(rem|dnl)([^a-z0-9_]|$)"
    starts = [r"copyright[ \t:]*([(]c[)]|©|&copy;|[0-9]|<|\[|[{])", r"([(]c[)]|©|&copy;)[ \t]*(copyright|[0-9])", r"copyright[ \t]+[a-z]", r"all rights reserved[[:space:].!]*$"]
    own = rf"^copyright[ \t]+({_OWN_WORDS.replace('?:', '')})([^0-9a-z_]|$)"
    item = r"[(]?([0-9][0-9]?|[a-z])[.)]([ \t])"
    known = "|".join(first_words())
    plain = f"string_split(lower(translate(text, {quoted(FROM)}, {quoted(TO)})), chr(10))"
    bare = f"regexp_replace(regexp_replace(regexp_replace(l, {quoted(head)}, ''), {quoted('^' + remark)}, '\\2'), {quoted(head)}, '')"
    notice = f"(regexp_matches(l, {quoted('^(' + '|'.join(starts) + ')')}) AND NOT (regexp_matches(l, {quoted(own)})))"
    stop = f"(l = '' OR regexp_matches(l, {quoted('^(' + item[:-1] + '[ ' + chr(92) + 't]*))?(' + known + ')([^a-z0-9_]|$)')}))"
    after = "(i > {0} AND noticed[i - {0}])"
    goes_on = f"NOT stops[i] AND ({after.format(1)} AND (empty[i + 1] OR (NOT stops[i + 1] AND empty[i + 2])) OR {after.format(2)} AND NOT stops[i - 1] AND empty[i + 1])"
    marked = f"regexp_replace(regexp_replace(lines[i], {quoted(head + remark)}, '\\2'), {quoted(head + item)}, '\\2')"
    lines = f"list_transform(range(1, len(lines) + 1), lambda i: CASE WHEN noticed[i] OR coalesce({goes_on}, false) THEN '' ELSE {marked} END)"

    def with_lines(source: str, keep: str) -> str:
        flags = f"SELECT *, list_transform(bare, lambda l: {notice}) AS noticed, list_transform(bare, lambda l: {stop}) AS stops, list_transform(bare, lambda l: l = '') AS empty"
        return f"(SELECT {keep}, {lines} AS kept FROM ({flags} FROM (SELECT *, list_transform(lines, lambda l: {bare}) AS bare FROM (SELECT *, {plain} AS lines FROM {source}))))"

    single = ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in SPELLINGS.items() if " " not in a)
    words = f"list_transform(list_filter(regexp_split_to_array(l, '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+'), lambda w: w <> ''), lambda w: coalesce(element_at(MAP {{{single}}}, w)[1], w))"
    line = f"'  ' || array_to_string({words}, '  ') || '  '"
    for old, new in SPELLINGS.items():
        if " " in old:
            line = f"replace({line}, {quoted('  ' + old.replace(' ', '  ') + '  ')}, {quoted('  ' + new + '  ')})"
    flat = "trim(regexp_replace({}, '[ ]+', ' ', 'g'))"
    canon = f"list_transform(kept, lambda l: {flat.format(line)})"
    joined = flat.format("array_to_string({}, ' ')")
    values = ", ".join(f"({quoted(a)}, {quoted(b)})" for a, b in known_texts())
    return f"""
WITH known AS (
  SELECT sha256(c) AS digest, min(license) AS license
  FROM (SELECT license, {joined.format('c')} AS c FROM (SELECT license, {canon} AS c FROM {with_lines(f"(VALUES {values}) AS k(license, text)", "license")}))
  WHERE c <> '' GROUP BY 1),
docs AS (SELECT doc_id, row, c, sha256({joined.format('c')}) AS text_digest FROM (SELECT doc_id, row_number() OVER () AS row, {canon} AS c FROM {with_lines("documents", "doc_id")})),
lines AS (SELECT DISTINCT row, sha256(line) AS digest FROM (SELECT row, unnest(c) AS line FROM docs)),
found AS (SELECT row, string_agg(DISTINCT license, ',' ORDER BY license) AS notices FROM lines JOIN known USING (digest) GROUP BY row)
SELECT d.doc_id, d.text_digest, k.license, f.notices
FROM docs d LEFT JOIN known k ON k.digest = d.text_digest LEFT JOIN found f ON f.row = d.row
"""


OP5_SQL = _sql()
