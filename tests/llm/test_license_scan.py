"""License scans against a plain reading of the rules."""

import re

from dispatchlens.llm import license_scan as L

from ..conftest import SF_SMALL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def base(text):
    w = WORD.findall(fold(text))
    starts, labels = [], set()
    for phrase, label in L.BASE.items():
        p = phrase.split()
        for k in range(len(w) - len(p) + 1):
            if w[k:k + len(p)] == p:
                starts.append(k)
                labels.add(label)
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def detections(text):
    text = text or ""
    found = []
    for rank, (level, label, _, regex) in enumerate(L.rules()):
        found += [(m.start(), -m.end(), level, rank, label) for m in re.finditer("(?i)" + regex, text, re.ASCII)]
    kept, seen = [], []
    for start, end, level, rank, label in sorted(found):
        if not any(a <= start and b <= end and lv <= level for a, b, lv in seen):
            kept.append((start, -end, level, label))
        seen.append((start, end, level))
    return kept


def fixture():
    return [
        "Released under the MIT License. mit  license\nMIT, License!", "smit license mit licenses", None, "",
        "SPDX-License-Identifier: Apache-2.0\nLicensed under the Apache License, Version 2.0 (the License)",
        "This is licensed under the GNU General Public License version 3; GNU Lesser General Public License v2.1",
        "Copyright (c) 2019-2021 A. All rights reserved. https://www.gnu.org/licenses/gpl-3.0.html",
        "É mit license émit license mit license", "copyleft " * 300 + "the Unlicense", "plain text", "x" * 5000,
        "creative commons attribution-sharealike 4.0 international license and Creative Commons Zero", "Apache\0License apache\x7flicense",
        "😀😀😀😀 mit license here", "😀 😀 😀 mit license x apache license", "𠀀𠀁 mit license 𠀂 😀 mit license 😀",
        "/* Mozilla Public\n * License, version 2.0 */", "# GNU Lesser General Public\n# License", "licensed under the\n// Apache License",
        " * This program is free software; you can\n * redistribute it and/or modify",
        "Redistributions of source code must\r\n retain the above copyright notice",
    ]


WRAPPED = {"Mozilla Public\n * License": "mpl", "GNU Lesser\n# General Public\n# License": "lgpl", "licensed under the\n\tMIT License": "mit",
           "; eclipse public\n; license": "epl", "// distributed under the Boost Software\n// License": "boost",
           "Permission to use, copy, modify, and\n * distribute this software for any purpose with or without fee": "isc"}


def test_wrapped_headers(spark):
    docs = spark.createDataFrame(list(enumerate(WRAPPED)), "doc_id long, text string")
    got = {r.doc_id: r.labels.split(",") for r in L.digest(L.scanned(docs)).collect()}
    assert all(label in got[i] for i, label in enumerate(WRAPPED.values())), got


def test_base_and_detections_match_a_plain_reading(spark):
    rows = list(enumerate(fixture()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in L.scanned(docs).collect()}
    short = {r.doc_id: r for r in L.digest(L.scanned(docs)).collect()}
    for i, text in rows:
        r, s = got[i], short[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, ",".join(r.base_labels)) == base(text), text
        assert [tuple(d) for d in r.detections] == detections(text), text
        assert s.labels == ",".join(sorted(set(r.base_labels) | {d.label for d in r.detections}))
        assert 0 <= s.score <= 1


def test_documents_and_keywords(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    got = {r.doc_id: r for r in L.scanned(docs).collect()}
    for r in docs.collect():
        d = got[r.doc_id]
        assert (d.n_words, d.n_base, d.first_word, d.last_word, ",".join(d.base_labels)) == base(r.text)
        assert [tuple(x) for x in d.detections] == detections(r.text)
    assert len(L.rules()) > 300


def test_empty_table_and_extra_columns(spark):
    docs = spark.createDataFrame([(1, "mit license", "x")], "doc_id long, text string, labels string")
    assert L.scanned(docs.limit(0)).collect() == []
    assert L.digest(L.scanned(docs)).columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
