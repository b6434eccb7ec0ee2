"""License scans by ordered signature rules, with DataFrame expressions only.

A rule is a regex with a license label, a keyword without which it can't match, and
a level: 0 for SPDX tags and canonical links, 1 for licensing sentences, 2 for
license names, 3 for general notices.  A text that holds none of a few word roots is
done at once; in the others a rule runs only if its keyword is there.  The matches
of a text are sorted by place, longest first, and one that lies inside a match of
its own or a stronger level is suppressed; of equal matches the earlier rule stays.

Beside the rules stand the base phrases (``mit license`` ...), found as consecutive
words and counted at all places.

Defined results: a null or empty text has no words, places or labels and scores 0;
rows are judged one by one, so repeated rows, ties and empty tables need no rule;
other columns are not read.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
OUT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Label, SPDX identifiers, regex of the name, and the keyword of the name.
LICENSES = (
    ("mit", "MIT|MIT-0", r"(?:mit|expat)[ -]+licen[cs]e", "licen"),
    ("x11", "X11", r"x11[ -]+licen[cs]e", "x11"),
    ("apache", "Apache-1.1|Apache-2.0", r"apache(?: software)? licen[cs]e(?:,? (?:version )?(?:1\.1|2(?:\.0)?))?", "apache"),
    ("gpl", "GPL-1.0|GPL-2.0|GPL-2.0-only|GPL-2.0-or-later|GPL-3.0|GPL-3.0-only|GPL-3.0-or-later",
     r"(?:gnu )?general public licen[cs]e(?:,? (?:version |v)?[123](?:\.0)?)?", "general public"),
    ("lgpl", "LGPL-2.0|LGPL-2.1|LGPL-2.1-only|LGPL-2.1-or-later|LGPL-3.0|LGPL-3.0-only|LGPL-3.0-or-later",
     r"(?:gnu )?(?:lesser|library) general public licen[cs]e(?:,? (?:version |v)?(?:2(?:\.[01])?|3(?:\.0)?))?", "general public"),
    ("agpl", "AGPL-1.0|AGPL-3.0|AGPL-3.0-only|AGPL-3.0-or-later",
     r"(?:gnu )?affero general public licen[cs]e(?:,? (?:version |v)?[13](?:\.0)?)?", "affero"),
    ("gfdl", "GFDL-1.1|GFDL-1.2|GFDL-1.3", r"(?:gnu )?free documentation licen[cs]e", "free documentation"),
    ("bsd-2-clause", "BSD-2-Clause", r"(?:simplified bsd|freebsd|bsd 2-clause|2-clause bsd) licen[cs]e", "bsd"),
    ("bsd-3-clause", "BSD-3-Clause", r"(?:new bsd|modified bsd|revised bsd|bsd 3-clause|3-clause bsd) licen[cs]e", "bsd"),
    ("bsd-4-clause", "BSD-4-Clause", r"(?:original bsd|bsd 4-clause|4-clause bsd) licen[cs]e", "bsd"),
    ("bsd", "0BSD|BSD-1-Clause", r"bsd[ -](?:style )?licen[cs]e", "bsd"),
    ("isc", "ISC", r"isc licen[cs]e", "isc"),
    ("mpl", "MPL-1.0|MPL-1.1|MPL-2.0", r"mozilla public licen[cs]e(?:,? (?:version |v\.? ?)?(?:1\.[01]|2(?:\.0)?))?", "mozilla"),
    ("epl", "EPL-1.0|EPL-2.0", r"eclipse public licen[cs]e", "eclipse"),
    ("edl", "EDL-1.0", r"eclipse distribution licen[cs]e", "eclipse"),
    ("cddl", "CDDL-1.0|CDDL-1.1", r"common development and distribution licen[cs]e", "common development"),
    ("cpl", "CPL-1.0", r"common public licen[cs]e", "common public"),
    ("cpal", "CPAL-1.0", r"common public attribution licen[cs]e", "attribution"),
    ("eupl", "EUPL-1.1|EUPL-1.2", r"european union public licen[cs]e", "european union"),
    ("osl", "OSL-2.1|OSL-3.0", r"open software licen[cs]e", "open software"),
    ("afl", "AFL-2.1|AFL-3.0", r"academic free licen[cs]e", "academic free"),
    ("artistic", "Artistic-1.0|Artistic-2.0", r"artistic licen[cs]e", "artistic"),
    ("boost", "BSL-1.0", r"boost software licen[cs]e", "boost"),
    ("bsl", "BUSL-1.1", r"business source licen[cs]e", "business source"),
    ("zlib", "Zlib", r"zlib(?:/libpng)? licen[cs]e", "zlib"),
    ("libpng", "Libpng", r"libpng licen[cs]e", "libpng"),
    ("unlicense", "Unlicense", r"the unlicense", "unlicense"),
    ("wtfpl", "WTFPL", r"do what the f\w+ you want to public licen[cs]e", "you want to"),
    ("python", "PSF-2.0|Python-2.0", r"python software foundation licen[cs]e", "python software"),
    ("php", "PHP-3.0|PHP-3.01", r"php licen[cs]e", "php"),
    ("ruby", "Ruby", r"ruby licen[cs]e", "ruby"),
    ("postgresql", "PostgreSQL", r"postgresql licen[cs]e", "postgresql"),
    ("openssl", "OpenSSL", r"openssl licen[cs]e", "openssl"),
    ("sleepycat", "Sleepycat", r"sleepycat licen[cs]e", "sleepycat"),
    ("vim", "Vim", r"vim licen[cs]e", "vim"),
    ("ofl", "OFL-1.1", r"(?:sil )?open font licen[cs]e", "open font"),
    ("ms-pl", "MS-PL", r"microsoft public licen[cs]e", "microsoft"),
    ("ms-rl", "MS-RL", r"microsoft reciprocal licen[cs]e", "microsoft"),
    ("ncsa", "NCSA", r"(?:university of illinois/)?ncsa open source licen[cs]e", "ncsa"),
    ("upl", "UPL-1.0", r"universal permissive licen[cs]e", "universal permissive"),
    ("qpl", "QPL-1.0", r"q public licen[cs]e", "q public"),
    ("apsl", "APSL-2.0", r"apple public source licen[cs]e", "apple public"),
    ("sspl", "SSPL-1.0", r"server side public licen[cs]e", "server side"),
    ("elastic", "Elastic-2.0", r"elastic licen[cs]e", "elastic"),
    ("odbl", "ODbL-1.0", r"open (?:data commons )?database licen[cs]e", "database"),
    ("odc-by", "ODC-By-1.0", r"open data commons attribution licen[cs]e", "open data commons"),
    ("cecill", "CECILL-2.1|CECILL-B|CECILL-C", r"cecill(?:-[bc])? (?:free software )?licen[cs]e", "cecill"),
    ("mulan", "MulanPSL-2.0", r"mulan (?:permissive software|psl) ?licen[cs]e", "mulan"),
    ("openrail", "OpenRAIL-M", r"(?:bigscience )?openrail(?:-m)? licen[cs]e", "openrail"),
    ("cc0", "CC0-1.0", r"creative commons (?:zero|cc0)|cc0 licen[cs]e", "cc0|zero"),
    ("cc-by", "CC-BY-3.0|CC-BY-4.0", r"creative commons attribution(?: [34]\.0)?(?: international)? licen[cs]e", "creative commons"),
    ("cc-by-sa", "CC-BY-SA-3.0|CC-BY-SA-4.0", r"creative commons attribution[ -]share ?alike(?: [34]\.0)?(?: international)? licen[cs]e",
     "creative commons"),
    ("cc-by-nc", "CC-BY-NC-3.0|CC-BY-NC-4.0",
     r"creative commons attribution[ -]non ?commercial(?: [34]\.0)?(?: international)? licen[cs]e", "creative commons"),
    ("cc-by-nd", "CC-BY-ND-3.0|CC-BY-ND-4.0",
     r"creative commons attribution[ -]no ?deriv(?:ative|s)(?: [34]\.0)?(?: international)? licen[cs]e", "creative commons"),
)
#: What a licensing sentence says before a name, and canonical links.
SENTENCES = (r"(?:is |are )?(?:re)?licen[cs]ed under(?: the)?(?: terms of the)?", r"(?:re)?distributed under(?: the)?(?: terms of the)?",
             r"under the terms of the", r"subject to the(?: terms of the)?", r"(?:released|available|made available) under the")
LINKS = (("apache", r"https?://www\.apache\.org/licen[cs]es/licen[cs]e-[0-9.]+", "apache.org"),
         ("mit", r"https?://(?:www\.)?opensource\.org/licen[cs]es/mit\b", "opensource.org"),
         ("gpl", r"https?://www\.gnu\.org/licen[cs]es/(?:old-licen[cs]es/)?gpl\b", "gnu.org"),
         ("lgpl", r"https?://www\.gnu\.org/licen[cs]es/(?:old-licen[cs]es/)?lgpl\b", "gnu.org"),
         ("agpl", r"https?://www\.gnu\.org/licen[cs]es/agpl\b", "gnu.org"),
         ("mpl", r"https?://(?:www\.)?mozilla\.org/(?:en-us/)?mpl/", "mozilla.org"),
         ("cc-by", r"https?://creativecommons\.org/licen[cs]es/by/", "creativecommons.org"),
         ("cc-by-sa", r"https?://creativecommons\.org/licen[cs]es/by-sa/", "creativecommons.org"),
         ("cc0", r"https?://creativecommons\.org/publicdomain/zero/", "creativecommons.org"))
NOTICES = (("permissive", r"permission is hereby granted,? free of charge", "hereby granted"),
           ("bsd", r"redistribution and use in source and binary forms", "redistribution and use"),
           ("public-domain", r"(?:placed|released|dedicated) (?:in|into|to) the public domain", "public domain"),
           ("proprietary", r"all rights reserved", "all rights reserved"),
           ("copyright", r"(?:copyright (?:\(c\)|©)|©|copyright) ?(?:19|20)\d\d(?:[-, ]+(?:19|20)\d\d)*", "copyright|©"),
           ("copyleft", r"copyleft", "copyleft"))
#: Sentences that only the text of one license, or its usual header, has.
BODIES = (("mit", r"the above copyright notice and this permission notice shall be included in all copies", "permission notice"),
          ("bsd", r"redistributions of source code must retain the above copyright notice", "redistributions of source"),
          ("bsd", r"redistributions in binary form must reproduce the above copyright notice", "redistributions in binary"),
          ("bsd-3-clause", r"neither the names? of .{1,80} nor the names of (?:its|the) contributors may be used", "nor the names of"),
          ("apache", r"unless required by applicable law or agreed to in writing, software distributed under the licen[cs]e", "applicable law"),
          ("gpl", r"this program is free software[:;,] you can redistribute it and/or modify", "free software"),
          ("lgpl", r"this library is free software[:;,] you can redistribute it and/or modify", "free software"),
          ("mpl", r"this source code form is subject to the terms of the mozilla public licen[cs]e", "source code form"),
          ("isc", r"permission to use, copy, modify,? and(?:/or)? distribute this software for any purpose with or without fee", "without fee"),
          ("zlib", r"this software is provided 'as-is', without any express or implied warranty", "'as-is'"),
          ("boost", r"to any person or organization obtaining a copy of the software and accompanying documentation", "person or organization"),
          ("unlicense", r"this is free and unencumbered software released into the public domain", "unencumbered"))
#: Every rule's match holds one of these.
ROOTS = (r"(?i)licen|spdx|creative ?commons|gnu\.org|mozilla\.org|hereby granted|redistribution and use|public domain|copyright|©|copyleft"
         r"|all rights|free software|without fee|'as-is'|permission notice|person or organization|nor the names")
#: What stands for a blank of a rule: white space, with a comment mark after it where a header is wrapped.
WRAP = r"\s+(?:[*#/;]{1,3}\s+)?"
CONFIDENCE = (0.95, 0.8, 0.6, 0.3)


def wrapped(regex: str) -> str:
    """A rule's regex with its blanks, outside of classes, open to wrapped lines."""
    return re.sub(r"(\[[^\]]*\])| (\?)?(?!\*)", lambda m: m[1] or (f"(?:{WRAP})?" if m[2] else WRAP), regex)


def rules() -> list[tuple[int, str, str, str]]:
    """(level, label, keyword alternatives, regex), strongest first."""
    out = []
    for label, ids, _, _ in LICENSES:
        for spdx in ids.split("|"):
            out.append((0, label, "spdx", r"spdx-license-identifier: *\(?" + spdx.lower().replace(".", r"\.") + r"(?![\w.+-])"))
    out += [(0, label, keyword, regex) for label, regex, keyword in LINKS]
    for label, _, name, keyword in LICENSES:
        out += [(1, label, keyword, rf"(?<!\w){sentence} (?:{name})(?!\w)") for sentence in SENTENCES]
    out += [(1, label, keyword, regex) for label, regex, keyword in BODIES]
    out += [(2, label, keyword, rf"(?<!\w)(?:{name})(?!\w)") for label, _, name, keyword in LICENSES]
    out += [(3, label, keyword, regex) for label, regex, keyword in NOTICES]
    return [(level, label, keyword, wrapped(regex)) for level, label, keyword, regex in out]


def rule_table() -> Column:
    """All rules as one constant array."""
    made = [{"level": level, "rank": at, "label": label, "keywords": keyword.split("|"), "regex": "(?i)" + regex}
            for at, (level, label, keyword, regex) in enumerate(rules())]
    return F.from_json(F.lit(json.dumps(made)),
                       "array<struct<level: int, rank: int, label: string, keywords: array<string>, regex: string>>")


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def places(text: Column, rule: Column) -> Column:
    """Start, end and rule of every match, from the pieces between the matches."""
    nothing = F.array().cast("array<struct<start: int, end: int>>")

    def walk(between: Column, found: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), nothing.alias("spans"))

        def step(s: Column, x: Column) -> Column:
            begin = s["at"] + F.length(x["between"])
            end = begin + F.length(x["found"])
            return F.struct(end.alias("at"), F.concat(s["spans"], F.array(F.struct(begin.alias("start"), end.alias("end")))).alias("spans"))

        return F.aggregate(F.arrays_zip(F.slice(between, 1, F.size(found)).alias("between"), found.alias("found")), start, step,
                           lambda s: s["spans"])

    found = let(F.regexp_extract_all(text, rule["regex"], F.lit(0)), lambda f: walk(F.split(text, rule["regex"], -1), f))
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), (-m["end"]).alias("minus_end"), rule["level"].alias("level"), rule["rank"].alias("rank"),
        rule["label"].alias("label")))


def resolved(sorted_matches: Column) -> Column:
    """The matches that no match of their own or a stronger level contains."""
    kept = F.array().cast("array<struct<start: int, end: int, level: int, label: string>>")
    start = F.struct(F.array(*[F.lit(-1)] * len(CONFIDENCE)).alias("reach"), kept.alias("kept"))

    def step(s: Column, m: Column) -> Column:
        end = -m["minus_end"]
        inside = F.array_max(F.slice(s["reach"], 1, m["level"] + 1)) >= end
        reach = F.transform(s["reach"], lambda r, i: F.when(i == m["level"], F.greatest(r, end)).otherwise(r))
        one = F.array(F.struct(m["start"].alias("start"), end.alias("end"), m["level"].alias("level"), m["label"].alias("label")))
        return F.struct(reach.alias("reach"), F.when(inside, s["kept"]).otherwise(F.concat(s["kept"], one)).alias("kept"))

    return F.aggregate(sorted_matches, start, step, lambda s: s["kept"])


def scanned(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` columns, words, base places and the detections (start, end, level, label) of each text."""
    body = F.coalesce(F.col(text), F.lit(""))
    phrase = f"(?<!{IN})(?:" + "|".join((OUT + "+").join(p.split()) for p in BASE) + f")(?!{IN})"
    rows = docs.select(*keep, body.alias("_text")).withColumn("_maybe", F.col("_text").rlike(wrapped(ROOTS)))
    rows = rows.withColumn("_base", F.when(F.col("_maybe"), F.regexp_count("_text", F.lit("(?i)" + phrase))).otherwise(0))
    word = F.lit(IN + "+")
    first = F.regexp_count(F.regexp_extract("_text", "(?is)^(.*?)" + phrase, 1), word)
    last = F.regexp_count(F.regexp_extract("_text", "(?is)^(.*)" + phrase, 1), word)
    labels = F.filter(F.array(*(F.when(F.col("_text").rlike(f"(?i)(?<!{IN})" + (OUT + "+").join(p.split()) + f"(?!{IN})"), label)
                                for p, label in BASE.items())), lambda x: x.isNotNull())
    none = F.array().cast("array<string>")
    able = let(F.regexp_replace(F.lower("_text"), F.lit(WRAP), F.lit(" ")), lambda low: F.filter(rule_table(), lambda r: F.exists(r["keywords"], lambda k: F.contains(low, k))))
    able = F.filter(able, lambda r: F.call_function("rlike", F.col("_text"), r["regex"]))
    matches = F.array_sort(F.flatten(F.transform(able, lambda r: places(F.col("_text"), r))))
    found = F.array().cast("array<struct<start: int, end: int, level: int, label: string>>")
    return rows.select(
        *keep, F.regexp_count("_text", word).cast("long").alias("n_words"), F.col("_base").cast("long").alias("n_base"),
        F.when(F.col("_base") > 0, first.cast("long")).alias("first_word"),
        F.when(F.col("_base") > 0, last.cast("long")).alias("last_word"),
        F.when(F.col("_base") > 0, F.array_sort(labels)).otherwise(none).alias("base_labels"),
        F.when(F.col("_maybe"), resolved(matches)).otherwise(found).alias("detections"))


def digest(found: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    every = F.array_sort(F.array_union("base_labels", F.transform("detections", lambda d: d["label"])))
    sure = F.transform("detections", lambda d: F.element_at(F.array(*map(F.lit, CONFIDENCE)), d["level"] + 1))
    score = F.greatest(F.coalesce(F.array_max(sure), F.lit(0.0)), F.when(F.col("n_base") > 0, 0.6).otherwise(0.0))
    return found.select(*keep, "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join(every, ",").alias("labels"), score.alias("score"))
