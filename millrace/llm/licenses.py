"""License scans: known licence sentences, and ordered rules over their sequence.  DataFrame functions only.

A text is cut into sentences, each is normalised, and those that are known give the document's sequence of sentence
identifiers.  Known are the sentences of notices (SENTENCES), those with a name in them (NAMED_SLOTS), grants that name a
licence ("released under the ...", NAMES) and SPDX lines (SPDX).  A sentence may be wrapped over lines, with comment marks before each.  RULES are tried in order,
longest and most specific first: each takes all places where its identifiers follow one another with at most GAP sentences
between two, so that a later rule only sees what earlier ones left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised sentences of public licence notices and their identifiers, separated by spaces.
_MIT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
_BSD = "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_ENDORSE = "may be used to endorse or promote products derived from this software without specific prior written permission"
SENTENCES = {
    "licensed under the apache license version 2 0 the license": "apache2-the",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "license-copy-at",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "license-copy-at",
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "license-copy-at",
    _MIT: "mit-grant",
    f"{_MIT} including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-permit",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    _BSD: "bsd-binary",
    f"neither the name of the copyright holder nor the names of its contributors {_ENDORSE}": "bsd-names",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "all advertising materials mentioning features or use of this software must display the following acknowledgment": "bsd-advertising",
    "apache license version 2 0 january 2004": "apache2-text",
    "mozilla public license version 2 0": "mpl2-text",
    "boost software license version 1 0 august 17th 2003": "bsl1-text",
    "eclipse public license v 2 0": "epl2-text",
    "gnu general public license version 2 june 1991": "gpl2-text",
    "gnu general public license version 3 29 june 2007": "gpl3-text",
    "gnu lesser general public license version 2 1 february 1999": "lgpl2.1-text",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-text",
    "gnu affero general public license version 3 19 november 2007": "agpl3-text",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-waiver",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-permit",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-permit",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-permit",
    "this source code form is subject to the terms of the mozilla public license v": "mpl2-form",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-obtain",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-obtain",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-available",
    "this is free and unencumbered software released into the public domain": "unlicense-free",
    "this program is free software": "gpl-free",
    "this library is free software": "gpl-free",
    "this file is free software": "gpl-free",
    "this work is dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
}
# How licences are named in a grant.
NAMES = {
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license"],
    "MIT": ["mit license", "mit"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "modified bsd license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "ISC": ["isc license"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mpl 2 0"],
    "EPL-2.0": ["eclipse public license version 2 0", "eclipse public license 2 0"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license"],
    "Unlicense": ["unlicense"],
    "CC0-1.0": ["cc0 1 0", "cc0 1 0 universal", "creative commons zero v1 0 universal", "cc0"],
}
_GNU = {"GPL": "gnu general public license", "LGPL": "gnu lesser general public license", "AGPL": "gnu affero general public license"}
_VERSIONS = {"GPL": ["2.0", "3.0"], "LGPL": ["2.0", "2.1", "3.0"], "AGPL": ["3.0"]}
_KINDS = {"BY": "attribution", "BY-SA": "attribution sharealike", "BY-NC": "attribution noncommercial", "BY-ND": "attribution noderivatives", "BY-NC-SA": "attribution noncommercial sharealike", "BY-NC-ND": "attribution noncommercial noderivatives"}
# Identifiers of SPDX lines beside the GNU and Creative Commons families.
SPDX = ["0BSD", "AFL-3.0", "Apache-1.1", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "ISC", "MIT", "MIT-0", "MPL-1.1", "MPL-2.0", "MS-PL", "MS-RL", "NCSA", "OFL-1.1", "OSL-3.0", "PostgreSQL", "Python-2.0", "Unlicense", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "Zlib"]
# Licences and the identifier sequences that grant them, in the order of trial.
NOTICE_RULES = [
    ("Apache-2.0", ["apache2-the", "apache2-comply", "license-copy-at"]),
    ("BSD-4-Clause", ["bsd-permit", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-permit", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-permit", "bsd-source", "bsd-names"]),
    ("BSD-3-Clause", ["bsd-permit", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-permit", "bsd-source", "bsd-binary"]),
    ("BSD-2-Clause", ["bsd-permit", "bsd-source"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("MPL-2.0", ["mpl2-form", "mpl2-obtain"]),
    ("ISC", ["isc-permit"]),
    ("Zlib", ["zlib-permit"]),
    ("EPL-2.0", ["epl2-available"]),
    ("Unlicense", ["unlicense-free"]),
    ("CC0-1.0", ["cc0-waiver"]),
    ("Apache-2.0", ["apache2-text"]),
    ("MPL-2.0", ["mpl2-text"]),
    ("BSL-1.0", ["bsl1-text"]),
    ("EPL-2.0", ["epl2-text"]),
    ("GPL-2.0", ["gpl2-text"]),
    ("GPL-3.0", ["gpl3-text"]),
    ("LGPL-2.1", ["lgpl2.1-text"]),
    ("LGPL-3.0", ["lgpl3-text"]),
    ("AGPL-3.0", ["agpl3-text"]),
    ("Public-Domain", ["public-domain"]),
    ("All-Rights-Reserved", ["reserved"]),
]
# End of fixed values.

#: Sentences with slots of bounded length: a start, a pattern (underscores are spaces) and the identifier.  An endorsement clause counts
#: whatever its wording, so that a notice that has one is never taken for one that hasn't.
_SLOT = lambda n: f"(?:_[a-z0-9]+){{0,{n}}}"
NAMED_SLOTS = [
    ("endorse or promote products derived from", f"[a-z0-9]+{_SLOT(30)}_endorse_or_promote_products_derived_from{_SLOT(24)}", "bsd-names"),
    ("to the extent possible under law", f"to_the_extent_possible_under_law{_SLOT(16)}_(?:has|have)_waived_all_copyright_and_related_or_neighboring_rights_to{_SLOT(12)}", "cc0-waiver"),
]
#: What may follow the name in a grant: where the licence is to be found.
TAIL = f"(?:_(?:see|found_in|as_found_in|which_can_be_found|a_copy_of_which){_SLOT(16)})?"
_TAIL = " (?:see|found in|as found in|which can be found|a copy of which)(?: .*)?$"
#: Most sentences between two of one rule.
GAP = 8
#: Each known sentence has one of these words or word beginnings, so a text without them needs no further look.
MARKS = ("licen", "reserved", "permission", "redistribut", "software", "domain", "under", "mpl", "endorse")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands before a licence's name in a grant, as a pattern; underscores are spaces.
GRANT = "(?:(?:this|the)_(?:work|project|software|program|library|package|code|file)_is_)?(?:licensed|released|distributed|available|published)_under_(?:the_terms_of_)?(?:the_|a_|an_)?"


def plain_words(name: str) -> str:
    return "".join(c if c.isalnum() else " " for c in name.lower())


def _families() -> tuple[dict[str, str], dict[str, list[str]], list[str], list[tuple[str, list[str]]]]:
    """The GNU and Creative Commons families by rule: sentences, names, SPDX identifiers and rules."""
    sentences, names, spdx, rules = {}, {}, [], []
    for kind, words in _GNU.items():
        for version in _VERSIONS[kind]:
            short = plain_words(version.removesuffix(".0"))
            mark = f"{kind.lower()}{version.removesuffix('.0')}"
            head = f"you can redistribute it and or modify it under the terms of the {words}"
            both = f"{kind.lower()}-redistribute {mark}-or-later"
            halves = f"{kind.lower()}-redistribute v{version}-or-later", f"{kind.lower()}-redistribute v{version}-only"
            # After a semicolon the version stands in a sentence of its own, whatever the family.
            sentences[f"{head} as published by the free software foundation"] = f"{kind.lower()}-redistribute"
            sentences[f"either version {short} of the license or at your option any later version"] = f"v{version}-or-later"
            sentences[f"version {short} of the license"] = f"v{version}-only"
            sentences[f"{head} as published by the free software foundation either version {short} of the license or at your option any later version"] = both
            sentences[f"{head} as published by the free software foundation version {short} of the license"] = f"{mark}-only"
            sentences[f"{head} version {short} as published by the free software foundation"] = f"{mark}-only"
            rules += [(f"{kind}-{version}-or-later", ["gpl-free", *both.split()]), (f"{kind}-{version}-or-later", both.split()), (f"{kind}-{version}-only", ["gpl-free", f"{mark}-only"]), (f"{kind}-{version}-only", [f"{mark}-only"])]
            rules += [(f"{kind}-{version}-{how}", [*free, *half.split()]) for free in (["gpl-free"], []) for how, half in zip(("or-later", "only"), halves, strict=True)]
            names[f"{kind}-{version}"] = [f"{words} version {short}", f"{words} v{short}", f"gnu {kind.lower()} version {short}", f"gnu {kind.lower()} v{short}", f"{kind.lower()} version {short}", f"{kind.lower()} v{short}", f"{kind.lower()}v{short}", f"{kind.lower()} {plain_words(version)}"]
            spdx += [f"{kind}-{version}-only", f"{kind}-{version}-or-later", f"{kind}-{version}", f"{kind}-{version}+"]
    for kind, words in _KINDS.items():
        for version, law in (("4.0", "international"), ("3.0", "unported")):
            v = plain_words(version)
            names[f"CC-{kind}-{version}"] = [f"cc {plain_words(kind)} {v}", f"creative commons {words} {v}", f"creative commons {words} {v} {law} license", f"creative commons {words} {v} license"]
            spdx.append(f"CC-{kind}-{version}")
    return sentences, names, spdx, rules


_SENTENCES, _NAMES, _SPDX, _RULES = _families()
ALL_SENTENCES = {**_SENTENCES, **SENTENCES}
NAMED = {n: licence for licence, ns in {**NAMES, **_NAMES}.items() for n in ns}
#: "or later" is no choice between licences.
LINES = {plain_words(x.replace("+", "-plus")).replace(" or later", " orlater"): x for x in [*SPDX, *_SPDX]}
RULES = [*_RULES, *NOTICE_RULES, *((x, [f"{x.lower()}-under"]) for x in {**NAMES, **_NAMES}), *((x, [f"spdx-{x}"]) for x in LINES.values())]

#: A known sentence between two ends or line ends, of which each stands twice, so that neighbours don't share one; or an end.
_GRANTED = "(?:" + "|".join(sorted(NAMED, key=lambda x: (-len(x), x))).replace(" ", "_") + ")"
PATTERN = "[\n\x01](?:[0-9a-f]_)?(".replace("_", " ") + "|".join([*(x.replace(" ", "_") for x in sorted(ALL_SENTENCES, key=lambda x: (-len(x), x))), GRANT + _GRANTED + TAIL, *(x for _, x, _ in NAMED_SLOTS), "spdx_license_identifier_[a-z0-9 ]+"]).replace("_", "(?: |\n\n)") + ")[\n\x01]|\x03"
#: The steps from a lower-case text to words, line ends and ends: pattern and replacement; \1 is what was found.
STEPS = [
    ("license-identifier:[ \\t]*", "license-identifier "),
    (r"\+(?:[^a-z0-9+]|$)", "-plus "),
    ("[.]([ \\t\\r\\f\\x0B]*(?:\\n[^a-z0-9\\n]*)?nor )", "\\1"),
    ("[.!?;:][ \\t\\r\\f\\x0B\\n]+", "\x01"),
    ("\\n[^a-z0-9\x01]*\\n", "\x01"),
    ("[^a-z0-9\\n\x01]+", " "),
    (" ?([\\n\x01]) ?", "\\1"),
]


def identifiers(text: Column) -> Column:
    """The identifiers of a text's known sentences, in order, with # where more than GAP sentences lie between two.

    A sentence starts at a line's start or after an end, and stops at a line's end or at an end; between, its words may be
    wrapped over lines.  An end is .!?;: before white space, or a line without letters and digits.  Of several sentences
    from one place the longest counts.
    """
    s = F.translate(text, UPPER + "\x01", LOWER + " ")
    for pattern, new in STEPS:
        s = F.regexp_replace(s, pattern, new.replace("\\", "$"))
    s = F.replace(F.replace(F.concat(F.lit("\x01"), F.trim(s), F.lit("\x01")), F.lit("\n"), F.lit("\n\n")), F.lit("\x01"), F.lit("\x01\x03\x01"))
    found = F.regexp_extract_all(s, F.lit(PATTERN), F.lit(1))
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    known, named, lines = table(ALL_SENTENCES), table(NAMED), table(LINES)

    def names(x: Column) -> Column:
        x = F.regexp_replace(x, "\n\n", " ")
        granted = F.try_element_at(named, F.regexp_extract(F.regexp_replace(x, _TAIL, ""), " under (?:the terms of )?(?:the |a |an )?(.*)$", 1))
        parts = F.split(F.replace(F.regexp_extract(x, "^spdx license identifier (.*)$", 1), F.lit(" or later"), F.lit(" orlater")), " (?:or|and) ")
        spdx = F.transform(parts, lambda p: F.concat(F.lit("spdx-"), F.coalesce(F.try_element_at(lines, F.trim(F.regexp_replace(p, " with .*$", ""))), F.lit("other"))))
        slots = F.when(x == "", F.array(F.lit("\x01")))
        for part, _, identifier in NAMED_SLOTS:
            slots = slots.when(x.contains(part), F.array(F.lit(identifier)))
        return slots.when(x.startswith("spdx "), spdx).otherwise(F.coalesce(F.split(F.try_element_at(known, x), " "), F.array(F.concat(F.lower(granted), F.lit("-under")))))

    # Repeated groups would overflow the matcher's stack on long texts, so ends are single characters and identifiers stand apart.
    marks = F.transform(F.flatten(F.transform(found, names)), lambda x: F.when(x == "\x01", x).otherwise(F.concat(F.lit("\x02"), x, F.lit("\x02"))))
    joined = F.regexp_replace(F.btrim(F.array_join(marks, ""), F.lit("\x01")), f"\x01{{{GAP + 2},}}", "\x02#\x02")
    return F.filter(F.split(F.replace(joined, F.lit("\x01"), F.lit("")), "\x02"), lambda x: x != "")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_sentences (known ones), sentences, licenses, unmatched.

    sentences: the identifiers joined by spaces.  An exception that an SPDX line adds to a licence (WITH) isn't named.  licenses: the licences of the rules' places in order, each once, joined
    by spaces.  unmatched: identifiers that no rule took.  Null, empty and other texts without known sentences have
    zero and empty strings.  Repeated rows are scanned each; extra columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    marked = F.translate(text, UPPER, LOWER).rlike("|".join(MARKS))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.when(marked, identifiers(text)).alias("ids"))
    rows = rows.select("doc_id", F.coalesce("ids", F.array().cast("array<string>")).alias("all"))
    # Identifiers stand doubled separators apart: |a||b|, so that neighbours can each be matched.
    left = F.concat_ws("", F.transform("all", lambda x: F.concat(F.lit("|"), x, F.lit("|"))))
    for licence, ids in RULES:
        left = F.replace(left, F.lit("".join(f"|{x}|" for x in ids)), F.lit(f"|={licence}|"))
    rows = rows.withColumn("left", F.split(left, r"\|+")).withColumn("ids", F.filter("all", lambda x: x != "#"))
    found = F.array_distinct(F.transform(F.filter("left", lambda x: x.startswith("=")), lambda x: F.substring(x, 2, 99)))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.concat_ws(" ", "ids").alias("sentences"),
        F.concat_ws(" ", found).alias("licenses"),
        F.size(F.filter("left", lambda x: (x != "") & (x != "#") & ~x.startswith("="))).cast("long").alias("unmatched"),
    )


def sql() -> str:
    """The scan in DuckDB's SQL, from the same tables and patterns."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    table = lambda d: "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in d.items()) + "}"
    s = f"translate(coalesce(text, ''), '{UPPER}\x01', '{LOWER} ')"
    for pattern, new in STEPS:
        s = f"regexp_replace({s}, {q(pattern)}, {q(new)}, 'g')"
    s = f"replace(replace('\x01' || trim({s}) || '\x01', '\n', '\n\n'), '\x01', '\x01\x03\x01')"
    left = "coalesce(list_aggregate(list_transform(every, lambda x: '|' || x || '|'), 'string_agg', ''), '')"
    for licence, ids in RULES:
        left = f"replace({left}, '{''.join(f'|{x}|' for x in ids)}', '|={licence}|')"
    name = r"regexp_extract(regexp_replace(x, '" + _TAIL + r"', ''), ' under (?:the terms of )?(?:the |a |an )?(.*)$', 1)"
    parts = r"string_split_regex(replace(regexp_extract(x, '^spdx license identifier (.*)$', 1), ' or later', ' orlater'), ' (?:or|and) ')"
    slots = " ".join(f"WHEN contains(x, '{part}') THEN '{identifier}'" for part, _, identifier in NAMED_SLOTS)
    return f"""
WITH cut AS (SELECT doc_id, list_transform(regexp_extract_all({s}, {q(PATTERN)}, 1), lambda x: replace(x, '\n\n', ' ')) AS found FROM documents),
tables AS MATERIALIZED (SELECT {table(ALL_SENTENCES)} AS known, {table(NAMED)} AS named, {table(LINES)} AS lines),
named AS (SELECT doc_id, list_transform(found, lambda x: CASE WHEN x = '' THEN '\x01' {slots} WHEN starts_with(x, 'spdx ') THEN array_to_string(list_transform({parts}, lambda p: 'spdx-' || coalesce(lines[trim(regexp_replace(p, ' with .*$', ''))], 'other')), '\x02')
  ELSE coalesce(replace(known[x], ' ', '\x02'), lower(named[{name}]) || '-under') END) AS n FROM cut, tables),
joined AS (SELECT doc_id, replace(regexp_replace(trim(coalesce(array_to_string(list_transform(n, lambda x: CASE WHEN x = '\x01' THEN x ELSE '\x02' || x || '\x02' END), ''), ''), '\x01'), '\x01{{{GAP + 2},}}', '\x02#\x02', 'g'), '\x01', '') AS j FROM named),
listed AS (SELECT doc_id, list_filter(string_split(j, '\x02'), lambda x: x <> '') AS every FROM joined),
ruled AS (SELECT doc_id, list_filter(every, lambda x: x <> '#') AS ids, string_split_regex({left}, '\\|+') AS l FROM listed)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ' '), '') AS sentences,
  coalesce((SELECT string_agg(x, ' ' ORDER BY i) FROM (SELECT substr(u, 2) AS x, min(i) AS i FROM (SELECT unnest(l) AS u, generate_subscripts(l, 1) AS i) WHERE u LIKE '=%' GROUP BY 1)), '') AS licenses,
  CAST(len(list_filter(l, lambda x: x <> '' AND x <> '#' AND x NOT LIKE '=%')) AS BIGINT) AS unmatched
FROM ruled
"""
