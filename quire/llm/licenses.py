"""Operator 8, license scans by sentence rules, in DataFrame and SQL functions only.

A text is split into sentences, each is normalised (lower case, only letters, digits and inner dots, single spaces), and
known license sentences become identifiers. A sentence may be wrapped over lines; where the whole isn't known, that
without its first line (a heading) and then the single lines are looked up. The sequence of a text's identifiers is matched against ordered rules: each
rule is a sequence of identifiers that must stand next to each other among the known sentences, an earlier rule uses up
its sentences, and what it used is not seen by later rules. Nothing is shuffled: all work stays within a row.

Defined results: a null or empty text, or one without known sentences, has no license and an empty sequence; a very long
text takes time in proportion to its length; a license found twice is named once; repeated rows give repeated results;
columns besides doc_id and text are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from quire.llm.common import columns

# Sentences of public license texts and of the usual notices, by identifier.
SENTENCES = {
    "apache_notice": "licensed under the apache license version 2.0",
    "apache_notice_full": "licensed under the apache license version 2.0 the license",
    "apache_not_use": "you may not use this file except in compliance with the license",
    "apache_obtain": "you may obtain a copy of the license at",
    "apache_as_is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_limits": "see the license for the specific language governing permissions and limitations under the license",
    "mit_notice": "released under the mit license",
    "mit_notice_licensed": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_as_is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_as_is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "bsd_grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3_notice": "this work is licensed under the gnu general public license version 3",
    "gpl3_notice_short": "licensed under the gnu general public license version 3",
    "gpl2_notice": "licensed under the gnu general public license version 2",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl_hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_see": "see the gnu general public license for more details",
    "lgpl_notice": "licensed under the gnu lesser general public license version 3",
    "mpl_notice": "this source code form is subject to the terms of the mozilla public license v",
    "cc_by": "licensed under cc by 4.0",
    "cc_by_sa": "licensed under cc by sa 4.0",
    "cc_by_nc": "licensed under cc by nc 4.0",
    "cc_by_nd": "licensed under cc by nd 4.0",
    "cc0": "licensed under cc0 1.0",
    "spdx_apache": "spdx license identifier apache 2.0",
    "spdx_mit": "spdx license identifier mit",
    "spdx_isc": "spdx license identifier isc",
    "spdx_bsd3": "spdx license identifier bsd 3 clause",
    "spdx_bsd2": "spdx license identifier bsd 2 clause",
    "spdx_gpl3": "spdx license identifier gpl 3.0 only",
    "spdx_gpl3_later": "spdx license identifier gpl 3.0 or later",
    "spdx_mpl": "spdx license identifier mpl 2.0",
    "agpl_notice": "licensed under the gnu affero general public license version 3",
    "agpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "zlib_as_is": "this software is provided as is without any express or implied warranty",
    "zlib_grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost_notice": "distributed under the boost software license version 1.0",
    "eclipse_notice": "this program and the accompanying materials are made available under the terms of the eclipse public license v 2.0",
    "spdx_agpl3": "spdx license identifier agpl 3.0 only",
    "spdx_lgpl3": "spdx license identifier lgpl 3.0 only",
    "spdx_gpl2": "spdx license identifier gpl 2.0 only",
    "spdx_unlicense": "spdx license identifier unlicense",
    "spdx_zlib": "spdx license identifier zlib",
    "spdx_boost": "spdx license identifier bsl 1.0",
    "spdx_eclipse": "spdx license identifier epl 2.0",
    "spdx_cc0": "spdx license identifier cc0 1.0",
    "spdx_cc_by": "spdx license identifier cc by 4.0",
    "copyright_reserved": "all rights reserved",
}
#: Every known sentence holds one of these words, so a text without them needs no splitting.
ANCHORS = ["licens", "warrant", "permission", "redistribut", "without specific prior written", "free software", "public domain", "rights reserved"]
#: (license, sequence of identifiers), in the order of matching: longer texts before the notices they contain.
RULES = [
    ("Apache-2.0", ["apache_notice_full", "apache_not_use", "apache_obtain", "apache_as_is", "apache_limits"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_names"]),
    ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("MIT", ["mit_grant", "mit_keep", "mit_as_is"]),
    ("ISC", ["isc_grant", "isc_as_is"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl_hope", "gpl_see"]),
    ("AGPL-3.0-or-later", ["agpl_free", "gpl_hope", "gpl_see"]),
    ("Zlib", ["zlib_as_is", "zlib_grant"]),
    *((name, [s]) for name, s in [
        ("Apache-2.0", "apache_notice"), ("Apache-2.0", "apache_notice_full"), ("Apache-2.0", "spdx_apache"),
        ("MIT", "mit_notice"), ("MIT", "mit_notice_licensed"), ("MIT", "mit_grant"), ("MIT", "spdx_mit"),
        ("ISC", "isc_grant"), ("ISC", "spdx_isc"), ("BSD-3-Clause", "spdx_bsd3"), ("BSD-2-Clause", "spdx_bsd2"),
        ("GPL-3.0-only", "gpl3_notice"), ("GPL-3.0-only", "gpl3_notice_short"), ("GPL-3.0-only", "spdx_gpl3"),
        ("GPL-3.0-or-later", "gpl_free"), ("GPL-3.0-or-later", "spdx_gpl3_later"), ("GPL-2.0-only", "gpl2_notice"),
        ("LGPL-3.0-only", "lgpl_notice"), ("MPL-2.0", "mpl_notice"), ("MPL-2.0", "spdx_mpl"),
        ("CC-BY-4.0", "cc_by"), ("CC-BY-SA-4.0", "cc_by_sa"), ("CC-BY-NC-4.0", "cc_by_nc"), ("CC-BY-ND-4.0", "cc_by_nd"), ("CC0-1.0", "cc0"), ("CC0-1.0", "spdx_cc0"), ("CC-BY-4.0", "spdx_cc_by"),
        ("AGPL-3.0-only", "agpl_notice"), ("AGPL-3.0-only", "spdx_agpl3"), ("AGPL-3.0-or-later", "agpl_free"), ("LGPL-3.0-only", "spdx_lgpl3"), ("GPL-2.0-only", "spdx_gpl2"),
        ("Unlicense", "unlicense_free"), ("Unlicense", "spdx_unlicense"), ("Zlib", "zlib_grant"), ("Zlib", "spdx_zlib"),
        ("BSL-1.0", "boost_notice"), ("BSL-1.0", "spdx_boost"), ("EPL-2.0", "eclipse_notice"), ("EPL-2.0", "spdx_eclipse"),
    ]),
]
_NUMBER = {s: k + 1 for k, s in enumerate(SENTENCES)}
_DOTS = r"(?<![0-9])[.]|[.](?![0-9])"
#: A line end within a sentence: after neither the end of one nor a blank, and before more text. It becomes a mark.
_WRAP = r"([^ \\t.!?;:\\n\\r])[ \\t]*\\r?\\n[ \\t]*(?=[^ \\t\\n\\r])"
_MARK = chr(1)
#: Each alternative starts at one character only, so long runs of dots or blanks cost no more than their length.
_SPLIT = r"[\\n\\r]+|[.!?](?:[ \\t]+|$)"


def scan(documents: DataFrame) -> DataFrame:
    """doc_id, licenses (in rule order, comma-joined), n_known (known sentences), sentences (their numbers in order, comma-joined)."""
    known = ", ".join(f"'{s}', {_NUMBER[k]}" for k, s in SENTENCES.items())
    maybe = " or ".join(f"contains(t, '{a}')" for a in ANCHORS)
    anchored = " or ".join(f"contains(s, '{a}')" for a in ANCHORS)
    df = columns(documents, doc_id="long", text="string").selectExpr("doc_id", "lower(text) t").selectExpr("doc_id", f"if({maybe}, t, '') t")
    number = lambda s: f"element_at(map({known}), trim(regexp_replace(regexp_replace({s}, '[^a-z0-9.]+', ' '), '{_DOTS}', '')))"
    df = df.selectExpr("doc_id", f"transform(filter(split(regexp_replace(t, '{_WRAP}', '$1{_MARK}'), '{_SPLIT}'), s -> {anchored}), s -> split(s, '{_MARK}')) sentences")
    whole, rest = number("array_join(s, ' ')"), number("array_join(slice(s, 2, size(s)), ' ')")
    parts = f"case when {whole} is not null then array({whole}) when size(s) > 1 and {rest} is not null then array({number('s[0]')}, {rest}) when size(s) > 1 then transform(s, l -> {number('l')}) else array() end"
    df = df.selectExpr("doc_id", f"array_compact(flatten(transform(sentences, s -> {parts}))) ids")
    rules = ", ".join(f"struct('{name}' name, ',{','.join(str(_NUMBER[s]) for s in sequence)},' want)" for name, sequence in RULES)
    fold = f"""aggregate(array({rules}), struct(concat(',', array_join(ids, ','), ',') s, cast(array() as array<string>) found),
        (a, r) -> struct(replace(a.s, r.want, ',;,') s, if(contains(a.s, r.want), array_append(a.found, r.name), a.found) found), a -> a.found)"""
    return df.selectExpr("doc_id", f"if(size(ids) = 0, '', array_join(array_distinct({fold}), ',')) licenses", "cast(size(ids) as bigint) n_known", "array_join(ids, ',') sentences")


_LIST = "[" + ", ".join(f"'{s}'" for s in SENTENCES.values()) + "]"


def _oracle() -> str:
    """The same rules in DuckDB."""
    maybe = " or ".join(f"contains(lower(text), '{a}')" for a in ANCHORS)
    inner = lambda s: f"regexp_replace(regexp_replace({s}, '[^a-z0-9.]+', ' ', 'g'), '([0-9])[.]([0-9])', '\\1#\\2', 'g')"
    number = lambda s: f"list_position({_LIST}, trim(replace(replace({inner(s)}, '.', ''), '#', '.')))"
    wrapped = "regexp_replace(t, '([^ \\t.!?;:\\n\\r])[ \\t]*\\r?\\n[ \\t]*([^ \\t\\n\\r])', '\\1' || chr(1) || '\\2', 'g')"
    whole, rest = number("array_to_string(s, ' ')"), number("array_to_string(s[2:], ' ')")
    parts = f"case when {whole} > 0 then [{whole}] when len(s) > 1 and {rest} > 0 then [{number('s[1]')}, {rest}] when len(s) > 1 then list_transform(s, lambda l: {number('l')}) else [] end"
    ids = f"list_filter(flatten(list_transform(regexp_split_to_array({wrapped}, '[\\n\\r]+|[.!?](?:[ \\t]+|$)'), lambda p: list_transform([string_split(p, chr(1))], lambda s: {parts})[1])), lambda x: x > 0)"
    steps, found = [], []
    for k, (name, sequence) in enumerate(RULES):
        want = "," + ",".join(str(_NUMBER[s]) for s in sequence) + ","
        steps.append(f"r{k + 1} as (select *, contains(s{k}, '{want}') f{k}, replace(s{k}, '{want}', ',;,') s{k + 1} from r{k})")
        found.append(f"case when f{k} then '{name}' end")
    return f"""
with d as (select doc_id, case when {maybe} then lower(text) else '' end t from documents),
r0 as (select doc_id, ids, ',' || array_to_string(ids, ',') || ',' s0 from (select doc_id, {ids} ids from d)),
{", ".join(steps)}
select doc_id, array_to_string(list_filter([{", ".join(found)}], lambda x, i: x is not null and list_position([{", ".join(found)}], x) = i), ',') licenses,
  cast(len(ids) as bigint) n_known, array_to_string(ids, ',') sentences from r{len(RULES)}
"""


ORACLE = _oracle()
