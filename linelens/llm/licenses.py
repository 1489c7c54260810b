"""Licence scans by sentence rules, with DataFrame functions only.

Texts are normalised and cut into sentences. A map of the known licence sentences,
in all their wordings, gives their identifiers; a sentence that is not in the map gets
the identifier of the known one that it contains. Other sentences that speak of
licences get the identifier of an unknown one. The identifiers of a document, in
order, are then matched against ordered rules: a rule is a sequence of identifiers that
stand for a licence; longer rules come first, and what a rule has matched is used up.
Unknown sentences and copyright lines may stand between those of a rule.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A text without any of these has no licence sentence.
HINTS = ("licen", "copyright", "permission", "warrant", "redistribut", "rights reserved", "public domain", "unlicense")

#: Identifier and pattern of known sentences; the first that matches counts.
SENTENCES = (
    ("apache_header", "under the apache license,? (v|version )?2\\.0.* you may not use this (file|work) except in compliance with the license"),
    ("apache_use", "you may not use this (file|work) except in compliance with the license"),
    ("apache_copy", "you may obtain a copy of the license at"),
    ("apache_as_is", "software distributed under the license is distributed on an as is basis"),
    ("apache_limits", "see the license for the specific language governing permissions and limitations"),
    ("mit_grant", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit_notice", "the above copyright notice and this permission notice shall be included in all copies"),
    ("mit_as_is", "the software is provided as is , without warranty of any kind"),
    ("isc_grant", "permission to use, copy, modify, (and|and or) distribute this software for any purpose with or without fee is hereby granted"),
    ("isc_as_is", "the software is provided as is and the author disclaims all warranties"),
    ("bsd_intro", "redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("bsd_source", "redistributions of source code must retain the above copyright notice"),
    ("bsd_binary", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd_name", "neither the names? of .* may be used to endorse or promote products"),
    ("bsd_as_is", "this software is provided by .* as is and any express or implied warranties"),
    ("gpl_redistribute_3_later", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation[,;] either version 3 of the license, or \\(at your option\\) any later version"),
    ("gpl_redistribute_2_later", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation[,;] either version 2 of the license, or \\(at your option\\) any later version"),
    ("lgpl_redistribute_later", "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation[,;] either version (2\\.1|3) of the license, or"),
    ("gpl_hope", "distributed in the hope that it will be useful, but without any warranty"),
    ("gpl_details", "see the gnu (lesser |affero )?general public license for more details"),
    ("gpl_received", "you should have received a copy of the gnu (lesser |affero )?general public license"),
    ("mpl_subject", "this source code form is subject to the terms of the mozilla public license,? v(\\.|ersion)? ?2\\.0"),
    ("mpl_copy", "if a copy of the mpl was not distributed with this file"),
    ("unlicense_domain", "this is free and unencumbered software released into the public domain"),
    ("ref_agpl_3", "gnu affero general public license,? (v|version )?3"),
    ("ref_lgpl_3", "gnu lesser general public license,? (v|version )?3"),
    ("ref_lgpl_2_1", "gnu lesser general public license,? (v|version )?2\\.1"),
    ("ref_gpl_3", "gnu general public license,? (v|version )?3"),
    ("ref_gpl_2", "gnu general public license,? (v|version )?2"),
    ("ref_apache_2", "apache license,? (v|version )?2(\\.0)?"),
    ("ref_mit", "(under|the|of) (the )?mit license"),
    ("ref_bsd_3", "(bsd 3 clause|3 clause bsd) license"),
    ("ref_bsd_2", "(bsd 2 clause|2 clause bsd) license"),
    ("ref_mpl_2", "mozilla public license,? (v|version )?2\\.0"),
    ("ref_cc_by_nc_sa_4", "\\bcc by nc sa 4\\.0|creative commons attribution noncommercial sharealike 4\\.0"),
    ("ref_cc_by_nc_nd_4", "\\bcc by nc nd 4\\.0|creative commons attribution noncommercial noderivatives 4\\.0"),
    ("ref_cc_by_nc_4", "\\bcc by nc 4\\.0|creative commons attribution noncommercial 4\\.0"),
    ("ref_cc_by_sa_4", "\\bcc by sa 4\\.0|creative commons attribution sharealike 4\\.0"),
    ("ref_cc_by_nd_4", "\\bcc by nd 4\\.0|creative commons attribution noderivatives 4\\.0"),
    ("ref_cc_by_4", "\\bcc by 4\\.0|creative commons attribution 4\\.0"),
    ("ref_cc0", "\\bcc0\\b( 1\\.0)?|creative commons zero"),
    ("public_domain", "(released|placed|dedicated) (in|into|to) the public domain"),
    ("all_rights", "all rights reserved"),
    ("copyright", "copyright ((\\(c\\)|©) )?[0-9]{4}"),
)

#: Licence and sequence of identifiers; earlier rules are tried first.
RULES = (
    ("BSD-3-Clause", ("bsd_intro", "bsd_source", "bsd_binary", "bsd_name", "bsd_as_is")),
    ("BSD-2-Clause", ("bsd_intro", "bsd_source", "bsd_binary", "bsd_as_is")),
    ("Apache-2.0", ("apache_header", "apache_copy", "apache_as_is", "apache_limits")),
    ("Apache-2.0", ("ref_apache_2", "apache_use", "apache_copy", "apache_as_is", "apache_limits")),
    ("Apache-2.0", ("apache_use", "apache_copy", "apache_as_is", "apache_limits")),
    ("GPL-3.0-or-later", ("gpl_redistribute_3_later", "gpl_hope", "gpl_details", "gpl_received")),
    ("GPL-2.0-or-later", ("gpl_redistribute_2_later", "gpl_hope", "gpl_details", "gpl_received")),
    ("LGPL-or-later", ("lgpl_redistribute_later", "gpl_hope", "gpl_details", "gpl_received")),
    ("MIT", ("mit_grant", "mit_notice", "mit_as_is")),
    ("ISC", ("isc_grant", "isc_as_is")),
    ("MPL-2.0", ("mpl_subject", "mpl_copy")),
    ("Apache-2.0", ("apache_header",)),
    ("GPL-3.0-or-later", ("gpl_redistribute_3_later",)),
    ("GPL-2.0-or-later", ("gpl_redistribute_2_later",)),
    ("LGPL-or-later", ("lgpl_redistribute_later",)),
    ("MPL-2.0", ("mpl_subject",)),
    ("Unlicense", ("unlicense_domain",)),
    ("MIT", ("mit_grant",)),
    ("AGPL-3.0", ("ref_agpl_3",)),
    ("LGPL-3.0", ("ref_lgpl_3",)),
    ("LGPL-2.1", ("ref_lgpl_2_1",)),
    ("GPL-3.0", ("ref_gpl_3",)),
    ("GPL-2.0", ("ref_gpl_2",)),
    ("Apache-2.0", ("ref_apache_2",)),
    ("MIT", ("ref_mit",)),
    ("BSD-3-Clause", ("ref_bsd_3",)),
    ("BSD-2-Clause", ("ref_bsd_2",)),
    ("MPL-2.0", ("ref_mpl_2",)),
    ("CC-BY-NC-SA-4.0", ("ref_cc_by_nc_sa_4",)),
    ("CC-BY-NC-ND-4.0", ("ref_cc_by_nc_nd_4",)),
    ("CC-BY-NC-4.0", ("ref_cc_by_nc_4",)),
    ("CC-BY-SA-4.0", ("ref_cc_by_sa_4",)),
    ("CC-BY-ND-4.0", ("ref_cc_by_nd_4",)),
    ("CC-BY-4.0", ("ref_cc_by_4",)),
    ("CC0-1.0", ("ref_cc0",)),
    ("Public-Domain", ("public_domain",)),
    ("All-Rights-Reserved", ("all_rights",)),
)

UNKNOWN, PASSED_OVER = "unknown", "copyright"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Comment marks, quotes, dashes and the like count as white space.
MARKS = "[\\x00-\\x20*/#\"'`<>|=_~^\\\\-]+"


#: What else a text with a known sentence has, with marks as spaces.
MORE_HINTS = ("creative", "cc by", "cc  ", "cc0", "mpl", "under the license")
KNOWN = "creative commons|\\bcc by\\b|\\bcc0\\b|under the license|copy of the mpl"
ENDS = " .!?;:,"


def wordings(pattern: str) -> list[str] | None:
    """All strings that a pattern of letters, groups, options and sets stands for; none if there is no end of them."""
    at = 0

    def one() -> list[str] | None:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "(":
            got = either()
            at += 1
        elif c == "[":
            end = pattern.index("]", at)
            got, at = (None if "-" in pattern[at:end] else list(pattern[at:end])), end + 1
        elif c == "\\":
            got, at = [""] if pattern[at] == "b" else [pattern[at]], at + 1
        else:
            got = None if c == "." else [c]
        if at < len(pattern) and pattern[at] == "?":
            at += 1
            got = None if got is None else [*got, ""]
        elif at < len(pattern) and pattern[at] in "*+{":
            return None
        return got

    def row() -> list[str] | None:
        out: list[str] | None = [""]
        while at < len(pattern) and pattern[at] not in "|)":
            if (got := one()) is None:
                return None
            out = [x + y for x in out for y in got]
        return out

    def either() -> list[str] | None:
        nonlocal at
        out = row()
        while out is not None and at < len(pattern) and pattern[at] == "|":
            at += 1
            out = None if (more := row()) is None else out + more
        return out

    return either()


def sentence_map() -> dict[str, str]:
    """Known sentences in all their wordings, without what ends them, and their identifiers."""
    out: dict[str, str] = {}
    for _, pattern in SENTENCES:
        for text in wordings(pattern) or ():
            out.setdefault(text.strip(ENDS), next(n for n, p in SENTENCES if re.search(p, text)))
    return out


def _contains(text: Column, *parts: str) -> Column:
    out = text.contains(parts[0])
    for p in parts[1:]:
        out = out | text.contains(p)
    return out


def _identify(sentence: Column) -> Column:
    whole = F.element_at(F.create_map(*(F.lit(x) for pair in sentence_map().items() for x in pair)), F.btrim(sentence, F.lit(ENDS)))
    inside = F.when(sentence.rlike(SENTENCES[0][1]), F.lit(SENTENCES[0][0]))
    for name, pattern in SENTENCES[1:]:
        inside = inside.when(sentence.rlike(pattern), F.lit(name))
    return F.coalesce(whole, inside.otherwise(F.lit(UNKNOWN)))


def sentence_ids(text: Column) -> Column:
    """Identifiers of the licence sentences of a text, in order."""
    low = F.translate(F.coalesce(text, F.lit("")), CAPITALS, SMALL)
    # A text without any of these has no known sentence, however its marks are.
    marks = "".join(map(chr, range(1, 32))) + "*/#\"'`<>|=_~^\\-"
    may = _contains(F.translate(low, marks, " " * len(marks)), *HINTS, *MORE_HINTS)
    marked = F.regexp_replace(F.regexp_replace(low, MARKS, " "), "([.!?]) +", "$1\n")
    sentences = F.filter(F.split(marked, "\n", -1), lambda s: _contains(s, *HINTS) | s.rlike(KNOWN))
    return F.when(may, F.transform(sentences, _identify)).otherwise(F.array().cast("array<string>"))


def match_rules(ids: Column) -> Column:
    """Names of the licences whose rules match a sequence of identifiers."""
    rules = F.array(*(F.struct(F.lit(n).alias("name"), F.lit("".join(f"<{i}>" for i in seq)).alias("ids")) for n, seq in RULES))
    start = F.struct(F.concat_ws("", F.transform(F.filter(ids, lambda i: ~i.isin(PASSED_OVER, UNKNOWN)), lambda i: F.concat(F.lit("<"), i, F.lit(">")))).alias("rest"), F.array().cast("array<string>").alias("names"))
    done = F.aggregate(
        rules, start,
        lambda acc, r: F.when(acc["rest"].contains(r["ids"]), F.struct(F.replace(acc["rest"], r["ids"], F.lit("|")).alias("rest"), F.array_append(acc["names"], r["name"]).alias("names"))).otherwise(acc),
    )
    return F.array_sort(F.array_distinct(done["names"]))


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, sentence_ids, licenses, n_known, n_unknown.

    sentence_ids are the identifiers in order and licenses the names in order of the
    alphabet, both comma-joined and empty where there are none. n_known and n_unknown
    count recognised and other licence sentences. Null and empty texts have none. No
    rows are dropped or merged, and nothing is shuffled.
    """
    found = docs.select(F.col(id_col), sentence_ids(F.col(text_col)).alias("__ids"))
    unknown = F.size(F.filter("__ids", lambda i: i == UNKNOWN))
    licenses = F.when(F.size("__ids") > 0, F.array_join(match_rules(F.col("__ids")), ",")).otherwise("")
    return found.select(id_col, F.array_join("__ids", ",").alias("sentence_ids"), licenses.alias("licenses"), (F.size("__ids") - unknown).cast("long").alias("n_known"), unknown.cast("long").alias("n_unknown"))


def oracle(table: str = "documents", id_col: str = "doc_id", text_col: str = "text") -> str:
    """The same scan in DuckDB's SQL."""

    def q(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def hinted(x: str) -> str:
        return "(" + " OR ".join(f"contains({x}, {q(h)})" for h in HINTS) + ")"

    cases = " ".join(f"WHEN regexp_matches(s, {q(p)}) THEN {q(n)}" for n, p in SENTENCES)
    steps = []
    for k, (name, seq) in enumerate(RULES):
        ids = q("".join(f"<{i}>" for i in seq))
        steps.append(f"r{k + 1} AS (SELECT * REPLACE (replace(rest, {ids}, '|') AS rest, CASE WHEN contains(rest, {ids}) THEN list_append(names, {q(name)}) ELSE names END AS names) FROM r{k})")
    return f"""
WITH low AS (SELECT {id_col}, translate(coalesce({text_col}, ''), '{CAPITALS}', '{SMALL}') AS t FROM {table}),
cut AS (SELECT {id_col}, string_split(regexp_replace(regexp_replace(t, {q(MARKS)}, ' ', 'g'), '([.!?]) +', '\\1' || chr(10), 'g'), chr(10)) AS ss FROM low),
ids AS (SELECT {id_col}, list_transform(list_filter(ss, lambda s: {hinted("s")} OR regexp_matches(s, {q(KNOWN)})),
  lambda s: CASE {cases} ELSE '{UNKNOWN}' END) AS ids FROM cut),
r0 AS (SELECT {id_col}, ids, array_to_string(list_transform(list_filter(ids, lambda i: i NOT IN ('{PASSED_OVER}', '{UNKNOWN}')), lambda i: '<' || i || '>'), '') AS rest, []::VARCHAR[] AS names FROM ids),
{", ".join(steps)}
SELECT {id_col}, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(list_sort(list_distinct(names)), ','), '') AS licenses,
  len(list_filter(ids, lambda i: i <> '{UNKNOWN}'))::BIGINT AS n_known, len(list_filter(ids, lambda i: i = '{UNKNOWN}'))::BIGINT AS n_unknown FROM r{len(RULES)}"""
