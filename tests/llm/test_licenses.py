import os
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from signalbase.llm import licenses
from signalbase.llm.queries import ORACLES, QUERIES
from tests.compare import both

MIT = dict(licenses.TEXTS)["MIT"]


def test_whole_texts_and_notices(spark):
    body = next(t for n, t in licenses.TEXTS if n == "BSD-3-Clause")
    rows = [
        (1, "Copyright (c) 2020 A. Person\n\n" + MIT.upper()),
        (2, "/*\n * " + body.replace("\n", "\n * ").replace("Redistributions", "Redistribution") + "\n */"),
        (3, MIT + " extra"),
        (4, "some code\n// Released under the MIT Licence\nmore\nlicensed under the GNU General Public License, Version 3."),
        (5, None),
        (6, " ,. "),
        (None, MIT),
        (7, "nothing here"),
        (7, "nothing here"),
        (8, "Boost Software Licence, Version 1.0 - August 17th, 2003\n\n" + dict(licenses.TEXTS)["BSL-1.0"].split("\n\n", 1)[1]),
        (9, "The zlib licence\nCopyright 1999 N. N.\n" + next(t for n, t in licenses.TEXTS if n == "Zlib")),
    ]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license string")
    got = [(r["doc_id"], r["license"], r["notices"]) for r in licenses.find_licenses(frame).collect()]
    assert sorted(got, key=repr) == sorted([(1, "MIT", ""), (2, "BSD-3-Clause", ""), (3, None, ""), (4, None, "GPL-3.0,MIT"), (5, None, ""), (6, None, ""), (None, "MIT", ""), (7, None, ""), (7, None, ""), (8, "BSL-1.0", ""), (9, "Zlib", "")], key=repr)


def test_oracles(spark):
    for name in ORACLES:
        ours, theirs = both(QUERIES[name](spark, "/root/testdata/sf0.001"), ORACLES[name], "/root/testdata/sf0.001")
        assert ours == theirs, name


def test_empty_table(spark):
    assert licenses.find_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_canonical(text):
    """The canonical form by a plain second way: whole copyright statements go, by what follows the word."""
    sentence = set("holder holders owner owners notice notices law laws interest interests license licenses licence licences statement statements treaty protection disclaimer disclaimers management permission".split())
    kept = []
    for line in (text or "").split("\n"):
        bare = line.lstrip(" \t\r\f\v/*#;!<>-")
        first, _, rest = bare.partition(" ")
        low, rest = first.lower().rstrip(":"), rest.strip()
        year = rest[:4].isdigit() and len(rest) >= 4
        marked = rest[:3].lower() == "(c)" or rest[:1] in ("©", "<", "[", "{") or year or rest.lower().startswith("by ")
        name = rest[:1].isupper() and (rest[1:2].islower() or rest[1:2] == ".") and re.match("[A-Za-z]*", rest)[0].lower() not in sentence
        after = bare[3:].strip() if bare[:3].lower() == "(c)" else bare[1:].strip() if bare[:1] == "©" else ""
        if low == "copyright" and (marked or name) or after[:4].isdigit() and len(after) > 3 or after.lower().startswith("copyright") or bare.lower().rstrip(". \t\r") == "all rights reserved":
            continue
        kept.append(line)
    out = " " + " ".join(re.findall(r"[^\W_]+", " ".join(kept).lower())) + " "
    for a, b in licenses.SPELLINGS:
        out = out.replace(a, b)
    return out.strip()


def test_wrapped_texts_are_found_at_any_width(spark):
    rows, names = [], {}
    for name, text in licenses.TEXTS:
        for width in range(40, 101, 6):
            for mark in ("", "# ", " * "):
                body = "\n".join(mark + line for part in text.split("\n") for line in (textwrap.wrap(part, width, break_on_hyphens=False) or [""]))
                names[len(rows)] = name
                rows.append((len(rows), f"{mark}Copyright (c) 2024 Jane Q. Doe <j@doe.org>\n{mark}All rights reserved.\n\n{body}\n"))
    got = {r["doc_id"]: r["license"] for r in licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [k for k in names if got[k] != names[k]] == []
    sample = rows[:: max(1, len(rows) // 200)]
    frame = spark.createDataFrame(sample, "doc_id long, text string").select("doc_id", licenses.canonical(F.col("text")).alias("c"))
    assert {r["doc_id"]: r["c"] for r in frame.collect()} == {k: plain_canonical(t) for k, t in sample}


COMMON = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(COMMON), reason="no licence texts on this machine")
def test_whole_texts_known_by_digest(spark):
    rows = []
    for k, (name, file) in enumerate([("Apache-2.0", "Apache-2.0"), ("GPL-2.0", "GPL-2"), ("GPL-3.0", "GPL-3"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3.0", "LGPL-3"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0")]):
        with open(f"{COMMON}/{file}") as f:
            text = f.read()
        # As published, with other line ends and margins, and in one paragraph a line.
        rows += [(k, name, text), (k, name, text.replace("\n", "\r\n   ")), (k, name, re.sub(r"(?<!\n)\n[ \t]*(?=[a-z])", " ", text))]
    got = licenses.find_licenses(spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(rows)], "doc_id long, text string"))
    assert {r["doc_id"]: r["license"] for r in got.collect()} == {i: n for i, (_, n, _) in enumerate(rows)}


LINES = [
    ("Licensed under CC BY-NC 4.0.", "CC-BY-NC-4.0", 0),
    ("// SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0", 0),
    ("Released under the Creative Commons Attribution-NoDerivatives 3.0 Unported License", "CC-BY-ND-3.0", 0),
    ("This project is licensed under a private licence of ours.", "", 1),
    ("a driving license is needed", "", 0),
    ("", "", 0),
    (None, "", 0),
    ("word " * 400_000 + "\nLicensed under the MIT License.", "MIT", 0),
]


def test_every_notice_of_the_table_is_found(spark):
    rows = [(k, f"A line before.\n{mark}{line}\nAnd one after.") for k, (_, line) in enumerate(licenses.NOTICES) for mark in ("", "# ", "_")]
    got = licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # Of names that share a canonical form the first counts.
    first = {}
    for name, line in licenses.NOTICES:
        first[plain_canonical(line)] = min(name, first.get(plain_canonical(line), name))
    assert len(got) == len(rows) and all(r["notices"] == first[plain_canonical(licenses.NOTICES[r["doc_id"]][1])] for r in got)


def test_lines_that_name_a_licence(spark):
    frame = spark.createDataFrame([(k, t, "x", 1) for k, (t, *_) in enumerate(LINES)] * 2, "doc_id long, text string, license string, id long")
    got = licenses.find_licenses(frame).collect()
    assert len(got) == 2 * len(LINES)
    for r in got:
        assert (r["notices"], r["n_unknown"]) == LINES[r["doc_id"]][1:] and r["n_notices"] == (1 if r["notices"] else 0)
