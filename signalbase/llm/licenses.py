"""Licence scan by canonical digest lookup.

A text is brought into canonical form: copyright lines dropped, lower case,
equivalent spellings made one, punctuation and white space reduced to single
spaces. Its digest is joined to a table of known licences' digests. So are
the digests of single lines that mention a licence or begin a word as a known
name does, for notices; lines that name one and are not known are counted.

A copyright line is known by its form, a mark, a year or a name after the
word, so that a licence may be wrapped at any width: lines that go on from
the sentence before (``copyright notice and ...``) stay.

The table of known digests is a constant of this module (or a caller's, of
checked size) and is broadcast; rows without a licence line are not shuffled.

Defined cases: a null, empty or blank text has no digest and no licence;
repeated rows have equal results; rows of equal id and different text are
kept apart; a null id is kept; an empty table gives an empty result; of
licences of one digest the first by name counts; texts of any length take
linear time. Other columns, of any name, are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbase.llm.common import staged

#: Spellings that count as one.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("organisation", "organization"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("judgement", "judgment"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("redistributions", "redistribution"),
    ("https", "http"),
    ("copyright owner", "copyright holder"),
    ("per cent", "percent"),
)

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""

_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_ITEMS = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_UNLICENSE_LINK = "\n\nFor more information, please refer to <https://unlicense.org>"

_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def _bsd(items: int, numbered: bool) -> str:
    lines = [f"{k}. {x}" if numbered else f"* {x}" for k, x in enumerate(_BSD_ITEMS[:items], 1)]
    return "\n\n".join([_BSD_HEAD, *lines, _BSD_WARRANTY])


#: Fixed values: (licence, text of a whole licence). Text below a title is given with and without it.
TEXTS = tuple(
    (name, title + text)
    for name, text, titles in (
        ("MIT", _MIT, ("", "MIT License\n\n", "The MIT License\n\n", "The MIT License (MIT)\n\n")),
        ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_WARRANTY}", ("", "ISC License\n\n")),
        ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_WARRANTY}", ("", "BSD Zero Clause License\n\n", "Zero-Clause BSD\n\n")),
        ("Unlicense", _UNLICENSE, ("",)),
        ("Unlicense", _UNLICENSE + _UNLICENSE_LINK, ("",)),
        ("Zlib", _ZLIB, ("", "zlib License\n\n", "The zlib License\n\n")),
        ("BSL-1.0", _BOOST, ("", "Boost Software License - Version 1.0 - August 17th, 2003\n\n")),
        ("BSD-2-Clause", _bsd(2, True), ("", "BSD 2-Clause License\n\n")),
        ("BSD-2-Clause", _bsd(2, False), ("", "BSD 2-Clause License\n\n")),
        ("BSD-3-Clause", _bsd(3, True), ("", "BSD 3-Clause License\n\n")),
        ("BSD-3-Clause", _bsd(3, False), ("", "BSD 3-Clause License\n\n")),
    )
    for title in titles
)

_NAMES = (
    ("MIT", ("MIT License", "MIT licence terms")),
    ("ISC", ("ISC License",)),
    ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License")),
    ("GPL-2.0", ("GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2")),
    ("GPL-3.0", ("GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3")),
    ("LGPL-2.1", ("GNU Lesser General Public License, version 2.1", "LGPLv2.1")),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3", "LGPLv3")),
    ("AGPL-3.0", ("GNU Affero General Public License, version 3", "AGPLv3")),
    ("MPL-2.0", ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0")),
    ("BSD-2-Clause", ("BSD 2-Clause License",)),
    ("BSD-3-Clause", ("BSD 3-Clause License",)),
    ("CC0-1.0", ("CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal")),
)
#: The Creative Commons licences: each choice of conditions, in both versions and under all its names.
_CC = (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"))
_CC_NAMES = tuple(
    (f"CC-{short}-{v}", (f"CC {short} {v}", f"CC-{short}-{v}", f"CC {short} {v} License", *(f"Creative Commons {full} {v} {x}".strip() for x in ("", "International", "International License", "Unported License", "License"))))
    for short, full in _CC
    for v in ("3.0", "4.0")
)
_OPENINGS = ("", *(f"{x}{the}" for x in ("Licensed under", "Released under", "Distributed under", "Published under", "Available under", "Provided under", "This work is licensed under", "This file is licensed under", "This software is licensed under", "This project is licensed under") for the in ("", " the", " a")))
#: One-line notices: every opening with every name of a licence, and identifier lines.
NOTICES = tuple((name, f"{opening} {full}.") for name, names in _NAMES + _CC_NAMES for full in names for opening in _OPENINGS) + tuple(
    (name, f"SPDX-License-Identifier: {name}{later}") for name in sorted({n for n, _ in _NAMES + _CC_NAMES + TEXTS}) for later in ("", "-only", "-or-later")[: 3 if "GPL" in name else 1]
)

#: Digests of the canonical forms of published licences' whole texts, and of the Apache licence without its appendix.
DIGESTS: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543"),
    ("Apache-2.0", "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f"),
    ("Apache-2.0", "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40"),
    ("CC0-1.0", "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e"),
    ("GFDL-1.2", "94541e73869af10ab6bd68a29575eede324e54e7d5237e7386d12444f593af60"),
    ("GFDL-1.3", "a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826"),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224"),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821"),
    ("GPL-3.0", "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a"),
    ("LGPL-2.0", "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908"),
    ("LGPL-2.1", "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891"),
    ("LGPL-3.0", "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be"),
    ("MPL-1.1", "a1b36de49a400e3d3385d5987188db954a084f9876243aa7207cd91de3f24a7b"),
    ("MPL-2.0", "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d"),
    ("Artistic-1.0", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
)

#: A table of known digests up to this size is broadcast, a larger one joined by a shuffle.
BROADCAST_ROWS = 100_000

_MARKERS = r"[\s/*#;!<>\-]*"
#: A copyright line, and lines that go on from a sentence before.
_COPYRIGHT = rf"^{_MARKERS}(?:(?i:copyright)\s*:?\s*(?:\([cC]\)|©|[0-9]{{4}}|[<\[{{]|(?i:by)\s)|[Cc](?:opyright|OPYRIGHT)\s+[A-Z](?:[a-z]|\.)|(?:\([cC]\)|©)\s*(?:[0-9]{{4}}|(?i:copyright))|(?i:all rights reserved)[\s.]*$)"
_GOES_ON = rf"(?i)^{_MARKERS}copyright\s+(?:holders?|owners?|notices?|laws?|interests?|licen[cs]es?|statements?|treaty|protection|disclaimers?|management|permission)\b"
#: What a line that is looked up has in it: the first letters of a known name, or a word of one-line grants.
_LICENSE_LINE = r"(?i)licen[cs]e|permission|redistribution|(?<![\p{L}\p{N}])(?:" + "|".join(sorted({re.match("[A-Za-z]+", full)[0] for _, names in _NAMES + _CC_NAMES for full in names})) + r")"
#: A line that names a licence, whether known or not.
_NAMING = r"(?i)\b(?:licen[cs]ed|released|distributed|published|available) under\b|spdx-license-identifier"


def canonical(text: Column) -> Column:
    """The canonical form; an empty one is null."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(_COPYRIGHT) | x.rlike(_GOES_ON))
    out = F.trim(F.regexp_replace(F.lower(F.array_join(lines, "\n")), r"[^\p{L}\p{N}]+", " "))
    out = F.concat(F.lit(" "), out, F.lit(" "))
    for spelling, one in SPELLINGS:
        out = F.replace(out, F.lit(spelling), F.lit(one))
    return F.nullif(F.trim(out), F.lit(""))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark: SparkSession, known: tuple[tuple[str, str], ...] = TEXTS + NOTICES, digests: tuple[tuple[str, str], ...] = DIGESTS) -> DataFrame:
    """(digest, license) of known texts, and of texts known by their digest alone; each digest once."""
    rows = spark.createDataFrame(list(known), "license string, text string").select(digest(F.col("text")).alias("digest"), "license")
    more = spark.createDataFrame(list(digests), "license string, digest string").select("digest", "license")
    return rows.union(more).groupBy("digest").agg(F.min("license").alias("license"))


def find_licenses(df: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text: str = "text", mentions: str = _LICENSE_LINE) -> DataFrame:
    """(id_col, text_digest, license, notices, n_notices, n_unknown) for every row: the whole text's licence, those its lines name, and how many lines name another.

    Lines are looked up that match ``mentions``, which all built-in notices do; a caller's own table may need another pattern.
    """
    known = staged(known_digests(df.sparkSession) if known is None else known, "license-digests")
    known = F.broadcast(known) if known.count() <= BROADCAST_ROWS else known
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(mentions) | x.rlike(_NAMING))
    line = lambda x: F.struct(digest(x).alias("digest"), x.rlike(_NAMING).alias("naming"))
    rows = rows.select("id", "text_hash", digest(F.col("text")).alias("text_digest"), F.coalesce(F.transform(lines, line), F.array().cast("array<struct<digest:string,naming:boolean>>")).alias("lines"))
    # Read twice below; only digests are written.
    rows = staged(rows, "license-rows")
    rows = rows.join(known.withColumnRenamed("digest", "text_digest"), "text_digest", "left")
    some = rows.filter(F.size("lines") > 0)
    # Rows that repeat count once.
    each = some.select("id", "text_hash", "lines").distinct().select("id", "text_hash", F.inline("lines"))
    hits = each.join(known.withColumnRenamed("license", "notice"), "digest", "left").filter("notice IS NOT NULL OR naming")
    found = F.array_join(F.sort_array(F.collect_set("notice")), ",")
    named = hits.groupBy(F.col("id").alias("of"), F.col("text_hash").alias("hash")).agg(
        found.alias("notices"), F.count_distinct("digest", "notice").alias("n_notices"), F.count_if(F.col("notice").isNull()).alias("n_unknown")
    )
    gained = some.join(named, F.col("id").eqNullSafe(F.col("of")) & F.col("text_hash").eqNullSafe(F.col("hash")), "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = gained.select("id", "text_digest", "license", F.coalesce("notices", F.lit("")).alias("notices"), number("n_notices"), number("n_unknown"))
    none = F.lit(0).cast("long")
    rest = rows.filter(F.size("lines") == 0).select("id", "text_digest", "license", F.lit("").alias("notices"), none.alias("n_notices"), none.alias("n_unknown"))
    return out.unionByName(rest).withColumnRenamed("id", id_col)


def _canonical_sql(text: str) -> str:
    lines = f"[x FOR x IN string_split({text}, chr(10)) IF NOT regexp_matches(x, '{_COPYRIGHT}') OR regexp_matches(x, '{_GOES_ON}')]"
    out = f"trim(regexp_replace(lower(array_to_string({lines}, chr(10))), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    out = f"' ' || {out} || ' '"
    for spelling, one in SPELLINGS:
        out = f"replace({out}, '{spelling}', '{one}')"
    return f"nullif(trim({out}), '')"


def oracle(known: tuple[tuple[str, str], ...] = TEXTS + NOTICES, digests: tuple[tuple[str, str], ...] = DIGESTS) -> str:
    """DuckDB SQL of the query op7, from the same table of licences."""
    quoted = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in known)
    more = ", ".join(f"('{d}', '{name}')" for name, d in digests)
    return f"""
WITH known AS (SELECT digest, min(license) AS license FROM (
    SELECT sha256({_canonical_sql('text')}) AS digest, license FROM (VALUES {quoted}) AS t(license, text)
    UNION ALL SELECT * FROM (VALUES {more}) AS m(digest, license)) GROUP BY 1),
lines AS (SELECT doc_id, sha256({_canonical_sql('line')}) AS digest, regexp_matches(line, '{_NAMING}') AS naming
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
named AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(license) FILTER (license IS NOT NULL))), ',') AS notices,
    count(DISTINCT CASE WHEN license IS NOT NULL THEN digest END) AS n_notices, count(*) FILTER (license IS NULL AND naming) AS n_unknown FROM lines LEFT JOIN known USING (digest) GROUP BY doc_id),
whole AS (SELECT doc_id, sha256({_canonical_sql('text')}) AS text_digest FROM documents)
SELECT w.doc_id, w.text_digest, k.license, coalesce(n.notices, '') AS notices, coalesce(n.n_notices, 0) AS n_notices, coalesce(n.n_unknown, 0) AS n_unknown
FROM whole w LEFT JOIN known k ON k.digest = w.text_digest LEFT JOIN named n USING (doc_id)"""
