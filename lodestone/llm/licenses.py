"""Operator 5: licence scan by recognised sentences.

A text becomes one normalised stream (lower case, runs of other characters than letters and digits
become one space) with two marks: X where a sentence or paragraph ends, Y where a line, a clause (: ;)
or an abbreviation does. A known licence sentence may run across Y, so wrapped and commented notices
match, but not across X. It begins at a mark and ends at one, but for the notices of ``RUN_ON``, whose
sentences go on in the licence itself. The identifiers that a text holds, in order, are matched
against ordered rules: a rule is a sequence of identifiers that must follow one another. A rule whose
match is part of a longer rule's match, by listing the longer one first, yields to it.

``n_sentences`` counts pieces between newlines and marks of punctuation.

Null and empty texts have no sentences. A text of any length is one stream. Of two known sentences that
begin at one mark the longer wins; licences are listed in the order of the rules. Repeated rows are
answered row by row. An empty table gives no rows. Extra columns, of whatever name, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Identifiers of licence sentences, in their normalised form.
SENTENCES = {
    "apache2": ("licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license"),
    "apache2_obey": ("you may not use this file except in compliance with the license",),
    "apache2_copy": ("you may obtain a copy of the license at",),
    "mit": ("released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"),
    "mit_grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",),
    "mit_notice": ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",),
    "as_is": ("the software is provided as is without warranty of any kind", "the software is provided as is without warranty of any kind express or implied"),
    "gpl3": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "licensed under the gplv3"),
    "gpl2": ("this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "licensed under the gplv2"),
    "lgpl3": ("this work is licensed under the gnu lesser general public license version 3", "licensed under the gnu lesser general public license version 3"),
    "agpl3": ("this work is licensed under the gnu affero general public license version 3", "licensed under the gnu affero general public license version 3"),
    "gnu_free": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",),
    "gnu_v3": ("either version 3 of the license or at your option any later version",),
    "gnu_v2": ("either version 2 of the license or at your option any later version",),
    "mpl2": ("this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0"),
    "bsd_any": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "bsd_source": ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",),
    "bsd_binary": ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",),
    "bsd_name": ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",),
    "bsd3": ("licensed under the bsd 3 clause license", "released under the bsd 3 clause license"),
    "bsd2": ("licensed under the bsd 2 clause license", "released under the bsd 2 clause license"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "released under the isc license"),
    "cc0": ("released under cc0 1 0", "licensed under cc0 1 0"),
    "cc_by4": ("licensed under cc by 4 0",),
    "cc_by_sa4": ("licensed under cc by sa 4 0",),
    "cc_by_nc4": ("licensed under cc by nc 4 0",),
    "cc_by_nd4": ("licensed under cc by nd 4 0",),
    "cc_by_nc_sa4": ("licensed under cc by nc sa 4 0",),
    "cc_by_nc_nd4": ("licensed under cc by nc nd 4 0",),
    "unlicense": ("this is free and unencumbered software released into the public domain",),
    "reserved": ("all rights reserved",),
}

# Fixed values: (licence, identifiers that must follow one another), the more specific first.
RULES = (
    ("Apache-2.0", ("apache2", "apache2_obey", "apache2_copy")),
    ("Apache-2.0", ("apache2",)),
    ("MIT", ("mit_grant", "mit_notice", "as_is")),
    ("MIT", ("mit_grant", "mit_notice")),
    ("MIT", ("mit",)),
    ("GPL-3.0-or-later", ("gnu_free", "gnu_v3")),
    ("GPL-2.0-or-later", ("gnu_free", "gnu_v2")),
    ("GPL-3.0", ("gpl3",)),
    ("GPL-2.0", ("gpl2",)),
    ("LGPL-3.0", ("lgpl3",)),
    ("AGPL-3.0", ("agpl3",)),
    ("MPL-2.0", ("mpl2",)),
    ("BSD-3-Clause", ("bsd_any", "bsd_source", "bsd_binary", "bsd_name")),
    ("BSD-2-Clause", ("bsd_any", "bsd_source", "bsd_binary")),
    ("BSD-3-Clause", ("bsd3",)),
    ("BSD-2-Clause", ("bsd2",)),
    ("ISC", ("isc",)),
    ("CC0-1.0", ("cc0",)),
    ("CC-BY-4.0", ("cc_by4",)),
    ("CC-BY-SA-4.0", ("cc_by_sa4",)),
    ("CC-BY-NC-4.0", ("cc_by_nc4",)),
    ("CC-BY-ND-4.0", ("cc_by_nd4",)),
    ("CC-BY-NC-SA-4.0", ("cc_by_nc_sa4",)),
    ("CC-BY-NC-ND-4.0", ("cc_by_nc_nd4",)),
    ("Unlicense", ("unlicense",)),
    ("Proprietary", ("reserved",)),
)
_KNOWN = {s: i for i, forms in SENTENCES.items() for s in forms}
#: Notices whose sentences go on after the known words.
RUN_ON = ("apache2_copy", "mit_grant", "as_is", "gnu_free", "bsd_any", "mpl2")
_OR_LATER = "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {} of the license or at your option any later version"
#: Sentences as the licences have them that hold more than one identifier, or known words otherwise put.
_WHOLE = {_OR_LATER.format(3): "gnu_free,gnu_v3", _OR_LATER.format(2): "gnu_free,gnu_v2", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc"}
#: A text without any of these words holds no known sentence.
_HINT = r"(?i)licen|releas|permi|warrant|redistribut|rights|copyright|free|either|neither|terms|gpl|notice"
#: Text to stream, in order. Each pattern takes a run from its first character on, so none backtracks far.
_STEPS = (
    (r"(?m)^[ \t]*(?:dnl|rem)\b", " "),
    (r"[;:]([ \t])", "Y$1"),
    (r"\bv\.([ \t\n])", "vY$1"),
    (r"[.!?]([ \t\n])", "X$1"),
    (r"\n", "N"),
    (r"[^a-z0-9XYN]+", " "),
    (r"N[ YN]*N", "X"),
    (r"X[ XYN]*", "X"),
    (r"[YN][ YN]*", "Y"),
    (r" ?Y? ?X ?", " X "),
    (r" ?Y ?", " Y "),
)


def _pattern(gap: str = " ", mark: str = "Y", run_on: str = "(?= )", stop: str = "(?= [XY] )") -> str:
    """Known sentences, the longest first; a list's number may stand before one."""
    every = {s: i in RUN_ON for s, i in _KNOWN.items()} | {s: False for s in _WHOLE}
    forms = []
    for s, goes_on in sorted(every.items(), key=lambda x: -len(x[0])):
        *words, last = s.split()
        forms.append("".join(f"{w}{gap}(?:{mark}{gap})?" for w in words) + last + (run_on if goes_on else stop))
    return f"[XY]{gap}(?:[0-9]{{1,2}}{gap})?(" + "|".join(forms) + ")"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_known, sentence_ids (joined, in order), licenses (distinct, in the
    rules' order, joined) and license (the first, or null)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    pieces = F.split(F.regexp_replace(text, r"([.;:!?])[ \t]+", "$1\n"), "\n")
    stream = F.concat(F.lit("\n"), F.lower(text), F.lit("\n\n"))
    for old, new in _STEPS:
        stream = F.regexp_replace(stream, old, new)
    table = F.create_map(*[F.lit(x) for kv in (_KNOWN | _WHOLE).items() for x in kv])
    said = F.when(text.rlike(_HINT), F.regexp_extract_all(stream, F.lit(_pattern()), F.lit(1)))
    names = F.transform(said, lambda s: F.split(F.try_element_at(table, F.trim(F.regexp_replace(s, "[ XY]+", " "))), ","))
    ids = F.coalesce(F.flatten(names), F.array().cast("array<string>"))
    count = F.size(F.filter(pieces, lambda s: s.rlike("[A-Za-z0-9]"))).cast("long")
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), count.alias("n_sentences"), ids.alias("ids"))
    left = F.concat(F.lit(","), F.array_join(F.transform("ids", lambda i: F.concat(i, F.lit(","))), ","))
    known = known.withColumn("left", left)
    hits = []
    for n, (name, seq) in enumerate(RULES):
        run = ",,".join(seq)
        known = known.withColumn(f"hit{n}", F.instr("left", f",{run},") > 0).withColumn("left", F.replace(F.col("left"), F.lit(f",{run},"), F.lit("|")))
        hits.append(F.when(F.col(f"hit{n}"), F.lit(name)))
    found = F.array_distinct(F.array_compact(F.array(*hits)))
    return known.select(
        "doc_id",
        "n_sentences",
        F.size("ids").cast("long").alias("n_known"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(found, ",").alias("licenses"),
        F.get(found, F.lit(0)).alias("license"),
    )


def oracle() -> str:
    """The same in SQL. Its expressions look neither ahead nor behind, so gaps and marks are doubled: one
    match takes the first half of the mark that ends it, the next match begins with the second."""
    values = ", ".join(f"('{s}', '{i}')" for s, i in (_KNOWN | _WHOLE).items())
    stream = "chr(10) || lower(body) || chr(10) || chr(10)"
    for old, new in (*_STEPS, (" ", "  "), ("([XY])", "$1$1")):
        stream = f"regexp_replace({stream}, '{old}', '{new.replace('$', chr(92))}', 'g')"
    pattern = _pattern("  ", "YY", " ", "  [XY]")
    steps, last = [], "j"
    for n, (_, seq) in enumerate(RULES):
        run = ",,".join(seq)
        steps.append(f"r{n} as (select *, contains(rest{n}, ',{run},') hit{n}, replace(rest{n}, ',{run},', '|') rest{n + 1} from {last})")
        last = f"r{n}"
    names = ", ".join(f"case when hit{n} then '{name}' end" for n, (name, _) in enumerate(RULES))
    return rf"""
with known(s, id) as (values {values}),
d as (select row_number() over () rid, doc_id, coalesce(text, '') body from documents),
p as (select rid, doc_id, len(list_filter(string_split(regexp_replace(body, '([.;:!?])[ \t]+', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '[A-Za-z0-9]')))::bigint n_sentences,
             regexp_extract_all({stream}, '{pattern}', 1) said from d),
e as (select rid, i, trim(regexp_replace(said[i], '[ XY]+', ' ', 'g')) s from p, unnest(range(1, len(said) + 1)) u(i)),
k as (select rid, string_split(string_agg(id, ',' order by i), ',') ids from e join known using (s) group by rid),
j as (select doc_id, n_sentences, coalesce(ids, []) ids,
             ',' || array_to_string(list_transform(coalesce(ids, []), lambda x: x || ','), ',') rest0 from p left join k using (rid)),
{", ".join(steps)},
o as (select doc_id, n_sentences, ids, list_filter([{names}], lambda x: x is not null) all_names from {last})
select doc_id, n_sentences, len(ids)::bigint n_known, array_to_string(ids, ',') sentence_ids,
       array_to_string(list_filter(all_names, lambda x, i: list_position(all_names, x) = i), ',') licenses, all_names[1] as license
from o
"""
