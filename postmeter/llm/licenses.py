"""Licence scan by sentences.

A text is cut into sentences, each is normalised and looked up in a table of known
licence sentences, and the order of the identifiers found is matched against ordered
rules.  Only DataFrame operations are used; the tables are constants of this module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# Licence sentences as their licences word them, by identifier.
SENTENCES = {
    "apache-header": "Licensed under the Apache License, Version 2.0",
    "apache-may-not": "you may not use this file except in compliance with the License",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-header-license": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache-asf": "The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\")",
    # Without a blank line after the address there is no stop before "Unless".
    "apache-obtain-as-is": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache-obtain-as-is-https": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "mit-released": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-title": "The MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl-redistribute-3": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "mpl2-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    # The sentence ends at "v." in a text.
    "mpl2-form-v": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    # Section 0 or 1 of the whole texts, each worded for its licence and version.
    "gpl2-applies": "This License applies to any program or other work which contains a notice placed by the copyright holder saying it may be distributed under the terms of this General Public License",
    "gpl3-refers": "\"This License\" refers to version 3 of the GNU General Public License",
    "lgpl2-applies": "This License Agreement applies to any software library which contains a notice placed by the copyright holder or other authorized party saying it may be distributed under the terms of this Library General Public License (also called \"this License\")",
    "lgpl2-1-applies": "This License Agreement applies to any software library or other program which contains a notice placed by the copyright holder or other authorized party saying it may be distributed under the terms of this Lesser General Public License (also called \"this License\")",
    "lgpl3-refers": "As used herein, \"this License\" refers to version 3 of the GNU Lesser General Public License, and the \"GNU GPL\" refers to version 3 of the GNU General Public License",
    "agpl3-refers": "\"This License\" refers to version 3 of the GNU Affero General Public License",
}
# The notices of the GNU family: key, name in the text, version, licence.
_GNU = (
    ("gpl", "GNU General Public License", "2", "GPL-2.0"),
    ("gpl", "GNU General Public License", "3", "GPL-3.0"),
    ("lgpl-library", "GNU Library General Public License", "2", "LGPL-2.0"),
    ("lgpl", "GNU Lesser General Public License", "2.1", "LGPL-2.1"),
    ("lgpl", "GNU Lesser General Public License", "3", "LGPL-3.0"),
    ("agpl", "GNU Affero General Public License", "3", "AGPL-3.0"),
)
_TERMS = "you can redistribute it and/or modify it under the terms of the"
_FSF = "as published by the Free Software Foundation"
for _key, _name, _v, _ in _GNU:
    _id = f"{_key}{_v.replace('.', '-')}"
    SENTENCES |= {
        # With a semicolon after "Foundation" the notice is two sentences, else one.
        f"{_key}-terms": f"{_TERMS} {_name} {_FSF}",
        f"version-{_v.replace('.', '-')}-or-later": f"either version {_v} of the License, or (at your option) any later version",
        f"version-{_v.replace('.', '-')}-only": f"version {_v} of the License",
        f"{_key}-redistribute-{_v.replace('.', '-')}": f"{_TERMS} {_name} {_FSF}, either version {_v} of the License, or (at your option) any later version",
        f"{_id}-redistribute-only": f"{_TERMS} {_name}, version {_v}, {_FSF}",
        f"{_id}-redistribute-only-of": f"{_TERMS} {_name} {_FSF}, version {_v} of the License",
        f"{_id}-licensed": f"Licensed under the {_name}, version {_v}",
        f"{_id}-work": f"This work is licensed under the {_name}, version {_v}",
    }
# Licence, the sentences that must follow one another (others may stand between), and
# whether it restricts use in a training corpus.
RULES = (
    ("Apache-2.0", ("apache-header",), False),
    ("Apache-2.0", ("apache-header-license",), False),
    ("Apache-2.0", ("apache-header", "apache-may-not", "apache-as-is"), False),
    ("Apache-2.0", ("apache-header-license", "apache-may-not", "apache-as-is"), False),
    ("Apache-2.0", ("apache-asf",), False),
    ("Apache-2.0", ("apache-may-not", "apache-obtain-as-is"), False),
    ("Apache-2.0", ("apache-may-not", "apache-obtain-as-is-https"), False),
    ("MIT", ("mit-title",), False),
    ("MIT", ("mit-released",), False),
    ("MIT", ("mit-licensed",), False),
    ("MIT", ("mit-grant", "mit-notice"), False),
    ("GPL-3.0", ("gpl3-work",), True),
    ("GPL-3.0", ("gpl-redistribute-3", "gpl-hope"), True),
    ("CC-BY-NC-4.0", ("cc-by-nc",), True),
    ("CC-BY-4.0", ("cc-by",), False),
    ("CC-BY-SA-4.0", ("cc-by-sa",), True),
    ("BSD-2-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary"), False),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names"), False),
    ("MPL-2.0", ("mpl2-form",), True),
    ("MPL-2.0", ("mpl2-form-v",), True),
    ("ISC", ("isc-grant",), False),
    ("GPL-2.0", ("gpl2-applies",), True),
    ("GPL-3.0", ("gpl3-refers",), True),
    ("LGPL-2.0", ("lgpl2-applies",), True),
    ("LGPL-2.1", ("lgpl2-1-applies",), True),
    ("LGPL-3.0", ("lgpl3-refers",), True),
    ("AGPL-3.0", ("agpl3-refers",), True),
)
for _key, _name, _v, _licence in _GNU:
    _id, _v = f"{_key}{_v.replace('.', '-')}", _v.replace(".", "-")
    RULES += tuple(
        (_licence, (ids,), True)
        for ids in (
            # The comma: the second follows the first with no known sentence between.
            f"{_key}-terms,version-{_v}-or-later", f"{_key}-terms,version-{_v}-only", f"{_key}-redistribute-{_v}",
            f"{_id}-redistribute-only", f"{_id}-redistribute-only-of", f"{_id}-licensed", f"{_id}-work",
        )
    )
# Identifier lines, by the names of the licences; those of the GNU family have two more.
SENTENCES["spdx"] = "SPDX-License-Identifier"
for _name, _restricts in sorted({(name, r) for name, _, r in RULES}):
    for _word in (_name, f"{_name}-only", f"{_name}-or-later") if "GPL" in _name else (_name,):
        _key = "spdx-" + _word.lower().replace(".", "-")
        SENTENCES[_key] = _word
        RULES += ((_name, (f"spdx,{_key}",), _restricts),)
# A sentence ends at these signs before white space.
_END = "[.!?;:]+([ \\t\\r\\n]|$)"
# A blank line, also one that holds the signs of a comment only.
_BLANK = r"\n[^\p{L}\p{N}\n]*\n"
_SIGNS = "[^a-z0-9.]+"
READINGS = (0, 1, 2)
_WORTH = "licens|permission|redistribut|distributed"


def _normal(sentence: str, replace: str) -> str:
    """SQL of a sentence in lower case with single blanks; one text for both engines."""
    inner = replace.format(f"lower({sentence})", _SIGNS, " ")
    return f"trim({replace.format(f'trim({inner})', '^[.]+|[.]+$', '')})"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _known_sql(replace: str, q) -> str:
    rows = ", ".join(f"({_quoted(k)}, {q(s)})" for k, s in SENTENCES.items())
    return f"select sid, {_normal('s', replace)} as normal from (values {rows}) as v(sid, s)"


def _pattern(rule: tuple[str, ...]) -> str:
    return "," + ",([a-z0-9-]+,)*".join(rule) + ","


def _in_order(rule: tuple[str, ...]) -> str:
    """The same for Java: what is found first is kept, so a text is passed once per rule."""
    first, *rest = rule
    return f"^(?>.*?,{first},)" + "".join(f"(?>(?:.*?,)??{r},)" for r in rest)


def _count(sequence: str, sid: str) -> str:
    return f"((length({sequence}) - length(replace({sequence}, '{sid},', ''))) / {len(sid) + 1})"


def _alone(sequence: str, name: str, ids: tuple[str, ...]) -> str:
    """SQL: the rule is met more often than the longer rules of other licences that begin with it."""
    longer = {x[len(ids)] for other, x, _ in RULES if other != name and x[: len(ids)] == ids and len(x) > len(ids)}
    return "".join(f" and {_count(sequence, ids[-1])} > {_count(sequence, x)}" for x in sorted(longer))


def _case_rules(sequence: str, test: str, pattern=_pattern) -> str:
    return ", ".join(
        f"case when {test.format(sequence, _quoted(pattern(ids)))}{_alone(sequence, name, ids)} then {_quoted(name)} end"
        for name, ids, _ in RULES
    )


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``row, doc_id, n_sentences, sentence_ids, licenses`` of every row of ``docs``.

    A text is read three times: with each line feed as the end of a sentence, with line
    feeds as blanks, and so within paragraphs, which blank lines end; a rule may match in
    any reading.  A rule that begins a longer rule of another licence counts only if it is
    met more often than that one.  ``sentence_ids`` are those of the first reading in their order, then
    those that only the second has, then those that only the third has; ``n_sentences``
    counts them.  Null texts are empty; rows are documents of their own,
    also with a null or repeated ``doc_id``; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"),
        docs["doc_id"].cast("long").alias("doc_id"),
        text_or_empty(docs).alias("text"),
    )
    worth = F.expr(f"rlike(lower(text), '{_WORTH}')")
    by_line = F.split(F.regexp_replace("text", _END, "\n"), "\n")
    by_stop = F.split(F.regexp_replace(F.translate("text", "\n", " "), _END, "\n"), "\n")
    by_paragraph = F.flatten(
        F.transform(F.split("text", _BLANK), lambda p: F.split(F.regexp_replace(F.translate(p, "\n", " "), _END, "\n"), "\n"))
    )
    views = F.when(worth, F.array(by_line, by_stop, by_paragraph)).otherwise(F.array(F.array(F.lit(""))))
    rows = numbered.select("row", "doc_id", F.posexplode(views).alias("reading", "sentences")).select(
        "row", "doc_id", "reading", F.posexplode("sentences").alias("pos", "sentence")
    )
    replace = "regexp_replace({}, '{}', '{}')"
    # A constant table of the size of SENTENCES.
    known = F.broadcast(spark.sql(_known_sql(replace, lambda s: _quoted(s).replace("\\", "\\\\"))))
    matched = rows.withColumn("normal", F.expr(_normal("sentence", replace))).join(known, "normal", "left")
    # A row with no known sentence still sends its first one, so that it is reported.
    sequences = (
        matched.where("sid is not null or (pos = 0 and reading = 0)")
        .groupBy("row", "doc_id")
        .agg(F.array_sort(F.collect_list(F.when(F.col("sid").isNotNull(), F.struct("reading", "pos", "sid")))).alias("found"))
    )
    ids = "transform(filter(found, x -> x.reading = {}), x -> x.sid)"
    joined = sequences.select(
        "row", "doc_id",
        *[F.expr(f"concat(',', array_join({ids.format(r)}, ','), ',')").alias(f"s{r}") for r in READINGS],
        F.expr(ids.format(0)).alias("sentence_ids"),
        *[F.expr(ids.format(r)).alias(f"ids{r}") for r in READINGS[1:]],
    )
    for r in READINGS[1:]:
        # As the variable of a lambda the few distinct identifiers are made once.
        seen = "transform(array(array_distinct(sentence_ids)), seen -> filter(ids{}, x -> not array_contains(seen, x)))"
        joined = joined.withColumn("sentence_ids", F.expr(f"concat(sentence_ids, get({seen.format(r)}, 0))"))
    rules = ", ".join(_case_rules(f"s{r}", "rlike({}, {})", _in_order) for r in READINGS)
    return joined.select(
        "row", "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        "sentence_ids",
        F.expr(f"array_sort(array_distinct(array_compact(array({rules}))))").alias("licenses"),
    )


def license_report(docs: DataFrame) -> DataFrame:
    """One row per document: its known sentences, its licences, and whether one restricts use.

    Rows as in ``scan_licenses``.
    """
    restricted = ", ".join(sorted({_quoted(name) for name, _, r in RULES if r}))
    return scan_licenses(docs).select(
        "doc_id",
        "n_sentences",
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        F.expr(f"arrays_overlap(licenses, array({restricted}))").alias("restricted"),
    )


def oracle_sql() -> str:
    replace = "regexp_replace({}, '{}', '{}', 'g')"
    restricted = ", ".join(sorted({_quoted(name) for name, _, r in RULES if r}))
    end = _END.replace("\\t", "\t").replace("\\r", "\r").replace("\\n", "\n")
    blank = _BLANK.replace("\\n", "\n")
    rules = ", ".join(_case_rules(f"s{r}", "regexp_matches({}, {})") for r in READINGS)
    named = ", ".join(f"',' || array_to_string(l{r}, ',') || ',' as s{r}" for r in READINGS)
    lists = ", ".join(f"coalesce(list(sid order by pos) filter (reading = {r}), []) as l{r}" for r in READINGS)
    return f"""
        with known as ({_known_sql(replace, _quoted)}),
        readings as (
            select doc_id, 0 as reading, coalesce(text, '') as t from documents
            union all select doc_id, 1, replace(coalesce(text, ''), chr(10), ' ') from documents
            union all select doc_id, 2,
                replace(regexp_replace(coalesce(text, ''), '{blank}', chr(1), 'g'), chr(10), ' ') from documents
        ),
        split as (
            select doc_id, reading,
                   string_split(replace(regexp_replace(t, '{end}', chr(10), 'g'), chr(1), chr(10)), chr(10)) as s
            from readings where regexp_matches(lower(t), '{_WORTH}')
        ),
        sentences as (
            select doc_id, reading, unnest(range(len(s))) as pos, unnest(s) as sentence from split
        ),
        found as (
            select doc_id, {lists} from sentences join known on {_normal('sentence', replace)} = normal group by doc_id
        ),
        listed as (select doc_id, {", ".join(f"coalesce(l{r}, []) as l{r}" for r in READINGS)} from documents left join found using (doc_id)),
        first as (select *, list_concat(l0, list_filter(l1, lambda x: not list_contains(l0, x))) as l01, {named} from listed),
        whole as (select *, list_concat(l01, list_filter(l2, lambda x: not list_contains(l01, x))) as ids from first),
        named as (
            select doc_id, ids, list_sort(list_distinct([x for x in [{rules}] if x is not null])) as l from whole
        )
        select doc_id, len(ids) as n_sentences, array_to_string(ids, ',') as sentence_ids, array_to_string(l, ',') as licenses,
               list_has_any(l, [{restricted}]) as restricted
        from named
    """
