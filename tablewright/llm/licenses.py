"""Licence scan by canonical digest: DataFrame functions only.

A text is brought to a canonical form (case, dashes and quotes, copyright lines,
list marks, equivalent spellings, punctuation, white space), digested, and hash-joined
to the digests of known licence texts, which go through the same expressions.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that licence matching treats as the same.
EQUIVALENT = {
    "acknowledgement": "acknowledgment", "analogue": "analog", "analyse": "analyze", "artefact": "artifact", "authorisation": "authorization",
    "authorised": "authorized", "calibre": "caliber", "cancelled": "canceled", "capitalisations": "capitalizations", "catalogue": "catalog",
    "categorise": "categorize", "centre": "center", "copyright holder": "copyright owner", "copyright holders": "copyright owners", "emphasised": "emphasized", "favour": "favor",
    "favourite": "favorite", "fulfil": "fulfill", "fulfilment": "fulfillment", "initialise": "initialize", "judgement": "judgment",
    "labelling": "labeling", "labour": "labor", "licence": "license", "licences": "licenses", "licenced": "licensed", "maximise": "maximize", "modelled": "modeled",
    "modelling": "modeling", "offence": "offense", "optimise": "optimize", "organisation": "organization", "organise": "organize",
    "practise": "practice", "programme": "program", "realise": "realize", "recognise": "recognize", "signalling": "signaling",
    "sub license": "sublicense", "sub-license": "sublicense", "utilisation": "utilization", "whilst": "while", "wilful": "willful", "noncommercial": "non-commercial", "per cent": "percent", "http": "https",
}

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""

_BSD_NAME = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""

_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""

#: Whole licence texts, a file for each, named by its identifier.
TEXTS = Path(__file__).parent / "licence_texts"

#: Known texts: (licence, text). Short notices are texts too.
KNOWN = [
    *((f.stem, f.read_text(encoding="utf-8")) for f in sorted(TEXTS.glob("*.txt"))),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-2-Clause", _BSD_HEAD + "\n" + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + "\n" + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_NAME + "\n" + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_NAME + "\n" + _BSD_TAIL),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]

#: ASCII punctuation and control characters, one by one: Java looks such a class up in a table.
_MARKS = "".join(f"\\x{b:02X}" for b in range(128) if not (chr(b).isdigit() or chr(b).islower() or chr(b).isupper() or b == 32))
#: Punctuation beyond ASCII.
_WIDE = r"\x{2010}-\x{2033}\x{2212}«»´·"

#: Fixed steps of the canonical form, in order, read alike by Java and RE2: (a string without which the
#: step changes nothing, or none, pattern, replacement).
STEPS = [
    (("copyright", "©", "(c)"), r"(?m)^[ \t/*#;!-]*(?:portions )?(?:copyright|©|\(c\))[^\n]*[0-9]{4}[^\n]*$", " "),
    # without a year only behind a mark that opens no list entry, as (c) may
    (("copyright", "©"), r"(?m)^[ \t/*#;!-]*(?:portions )?(?:copyright[ \t]+(?:©|\(c\)|[<\[{])|©)[^\n]*$", " "),
    (("all rights reserved",), r"(?m)^[ \t/*#;!-]*all rights reserved\.?[ \t\r]*$", " "),
    ((), r"(?m)^[ \t/*#;!-]*(?:\(?[0-9a-z]{1,2}[.)]|[•·])[ \t]+", " "),
    (("©",), "©", " (c) "),
    ((f"[{_WIDE}]",), f"[{_WIDE}]+", " "),
    # a run of punctuation and spaces becomes one space; a single space is such a run already
    ((), f" *[{_MARKS}][{_MARKS} ]*|  +", " "),
]


def _variants() -> list[tuple[str, str]]:
    return [tuple(" " + x.replace("-", " ") + " " for x in pair) for pair in EQUIVALENT.items()]


def _any_variant() -> str:
    """One pattern for all variants, with a branch for each first letter."""
    by_letter: dict[str, list[str]] = {}
    for a, _ in _variants():
        by_letter.setdefault(a[1], []).append(a[2:])
    return " (?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in sorted(by_letter.items())) + ")"


def step(out: Column, needs: tuple[str, ...], pattern: str, to: str) -> Column:
    changed = F.regexp_replace(out, pattern, to)
    if not needs:
        return changed
    if needs[0].startswith("["):
        has = out.rlike(needs[0])
    else:
        has = out.contains(needs[0])
        for n in needs[1:]:
            has |= out.contains(n)
    return F.when(has, changed).otherwise(out)


def respelled(out: Column) -> Column:
    """Spelling variants brought to one, in texts that hold any; ``out`` has a space at either end."""
    new = out
    for a, b in _variants():
        new = F.replace(new, F.lit(a), F.lit(b))
    return F.trim(F.when(out.rlike(_any_variant()), new).otherwise(out))


def digests(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """license and digest of the known texts, one row for each digest; its size is that of
    the list, which the caller holds, so it may be broadcast."""
    rows = spark.createDataFrame(known or KNOWN, "license string, text string")
    return _formed(rows, "license", "text").select("license", F.sha2("_c", 256).alias("digest")).groupBy("digest").agg(F.min("license").alias("license_id"))


def _formed(df: DataFrame, keep: str, text: str) -> DataFrame:
    """The column kept and _c, the canonical text: lower case without copyright lines, list marks,
    punctuation and spelling variants, one space between words, none at the ends; empty for null.
    Each step is a projection of its own, which Catalyst doesn't merge with the next, as that reads it twice."""
    df = df.select(F.col(keep), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_c"))
    for needs, pattern, to in STEPS:
        df = df.select(F.col(keep), step(F.col("_c"), needs, pattern, to).alias("_c"))
    df = df.select(F.col(keep), F.concat(F.lit(" "), F.trim("_c"), F.lit(" ")).alias("_c"))
    return df.select(F.col(keep), respelled(F.col("_c")).alias("_c"))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", known: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, n_canonical (code points), digest (hex SHA-256 of the canonical text) and
    license_id (null where the whole text is no known licence), a row for each row.

    Null and empty texts have the digest of the empty text and no licence. Null and repeated
    ids are kept; other columns are dropped, whatever their names.
    """
    c = _formed(df, doc_id, text).select(F.col(doc_id), F.length("_c").cast("bigint").alias("n_canonical"), F.sha2("_c", 256).alias("digest"))
    return c.join(F.broadcast(digests(df.sparkSession, known)), "digest", "left").select(doc_id, "n_canonical", "digest", "license_id")


def oracle() -> str:
    """The same in DuckDB SQL, over the table documents."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def form(column: str) -> str:
        out = f"lower(coalesce({column}, ''))"
        for _, pattern, to in STEPS:
            out = f"regexp_replace({out}, {quote(pattern)}, {quote(to)}, 'g')"
        out = f"' ' || trim({out}, ' ') || ' '"
        for a, b in _variants():
            out = f"replace({out}, {quote(a)}, {quote(b)})"
        return f"trim({out}, ' ')"

    known = ", ".join(f"({quote(k)}, {quote(t)})" for k, t in KNOWN)
    return f"""
        WITH known AS (SELECT sha256({form("t")}) AS digest, min(k) AS license_id FROM (VALUES {known}) AS v(k, t) GROUP BY 1),
        c AS (SELECT doc_id, {form("text")} AS c FROM documents)
        SELECT doc_id, CAST(length(c) AS BIGINT) AS n_canonical, sha256(c) AS digest, license_id
        FROM c LEFT JOIN known ON known.digest = sha256(c)"""
