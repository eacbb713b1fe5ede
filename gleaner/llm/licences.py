"""Licence scans by sentence rules.

A text falls into sentences; what a normalised sentence says about licences
becomes identifiers, in the order of its words; the ordered identifiers of a
text are matched against ordered rules.  Longer rules come first and use up what they
match, so a part never counts as another licence.  All steps are row-local
SQL expressions over whole texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# sentences end at a mark before white space, or at a blank line
SPLIT = r"[.!?]+[ \t\r\n]+|\n[ \t\r]*\n"
# only sentences with one of these words are looked at
HINT = "licen[cs]|copyright|permission|warrant|redistribut|liab|spdx|public domain|merchantab|endorse|later version|creative commons|cc0|cc by|cc-by|gpl"

# What a normalised sentence (lower case, words of a-z and 0-9 with single spaces) says about a licence.
# A sentence is read from the left; where several fit at one place, the first of this list counts.
SENTENCES = [
    ("spdx_apache2", r"spdx license identifier apache"),
    ("spdx_mit", r"spdx license identifier mit\b"),
    ("spdx_bsd3", r"spdx license identifier bsd 3"),
    ("spdx_bsd2", r"spdx license identifier bsd 2"),
    ("spdx_gpl3_later", r"spdx license identifier gpl 3 0 or later"),
    ("spdx_gpl2_later", r"spdx license identifier gpl 2 0 or later"),
    ("spdx_gpl3", r"spdx license identifier gpl 3"),
    ("spdx_gpl2", r"spdx license identifier gpl 2"),
    ("spdx_lgpl", r"spdx license identifier lgpl"),
    ("spdx_agpl", r"spdx license identifier agpl"),
    ("spdx_mpl2", r"spdx license identifier mpl"),
    ("spdx_isc", r"spdx license identifier isc\b"),
    ("spdx_mit", r"(clause|only|or later|\b0) (or|and) mit\b"),
    ("spdx_apache2", r"\b(or|and) apache 2 0\b"),
    ("spdx_bsd3", r"\b(or|and) bsd 3 clause"),
    ("spdx_bsd2", r"\b(or|and) bsd 2 clause"),
    ("cc_by_nc_nd", r"\b(cc by nc nd|creative commons attribution noncommercial noderiv)"),
    ("cc_by_nc_sa", r"\b(cc by nc sa|creative commons attribution noncommercial sharealike)"),
    ("cc_by_nc", r"\b(cc by nc|creative commons attribution noncommercial)"),
    ("cc_by_nd", r"\b(cc by nd|creative commons attribution noderiv)"),
    ("cc_by_sa", r"\b(cc by sa|creative commons attribution share ?alike)"),
    ("cc0", r"\b(cc0|creative commons zero)\b"),
    ("cc_by", r"\b(cc by|creative commons attribution)\b"),
    ("agpl", r"(version 3 of the )?gnu affero general public license"),
    ("lgpl", r"(version (2 1|2|3) of the )?gnu (lesser|library) general public license"),
    ("gpl3", r"gnu general public license (as published by the free software foundation )?(either )?(version|v) ?3"),
    ("gpl2", r"gnu general public license (as published by the free software foundation )?(either )?(version|v) ?2"),
    ("gpl3", r"version 3 of the gnu general public license"),
    ("gpl2", r"version 2 of the gnu general public license"),
    ("gpl_later", r"(at your option )?any later version"),
    ("gpl", r"gnu general public license"),
    ("gpl3", r"\b(gnu )?gpl (version |v )?3|\bgplv3"),
    ("gpl2", r"\b(gnu )?gpl (version |v )?2|\bgplv2"),
    ("apache2", r"apache license (version |v ?)?2( 0)?\b"),
    ("apache_copy", r"you may obtain a copy of the license at"),
    ("apache_except", r"you may not use this file except in compliance with the license"),
    ("apache_asis", r"software distributed under the license is distributed on an as is basis"),
    ("mpl2", r"mozilla public license (version |v ?)?2 0"),
    ("epl2", r"eclipse public license (version |v ?)?2 0"),
    ("epl1", r"eclipse public license (version |v ?)?1 0"),
    ("mit_grant", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit_notice", r"above copyright notice and this permission notice shall be included"),
    ("mit_warranty", r"software is provided as is without warranty of any kind"),
    ("mit_liability", r"in no event shall the authors or copyright holders be liable"),
    ("mit", r"\b(under|the|or) (the )?(terms of the )?mit license"),
    ("isc_grant", r"permission to use copy modify and or distribute this software for any purpose"),
    ("isc", r"\bisc license"),
    ("bsd_redist", r"redistribution and use in source and binary forms"),
    ("bsd_source", r"redistributions of source code must retain"),
    ("bsd_binary", r"redistributions in binary form must reproduce"),
    ("bsd_endorse", r"neither the name of .* may be used to endorse"),
    ("bsd_disclaim", r"software is provided by the copyright holders and contributors as is"),
    ("bsd3", r"bsd (3|three) clause|3 clause bsd"),
    ("bsd2", r"bsd (2|two) clause|2 clause bsd"),
    ("bsd", r"\bbsd (style )?license"),
    ("unlicense", r"free and unencumbered software released into the public domain"),
    ("public_domain", r"\bpublic domain\b"),
    ("all_rights", r"\ball rights reserved\b"),
]
ANY = "|".join(f"(?:{p})" for _, p in SENTENCES)

# Ordered identifiers and the licence they make, longest first.
RULES = [
    ("BSD-3-Clause", ["bsd_redist", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_disclaim"]),
    ("BSD-2-Clause", ["bsd_redist", "bsd_source", "bsd_binary", "bsd_disclaim"]),
    ("MIT", ["mit", "mit_grant", "mit_notice", "mit_warranty", "mit_liability"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_warranty", "mit_liability"]),
    ("Apache-2.0", ["apache2", "apache_except", "apache_copy", "apache_asis"]),
    ("ISC", ["isc", "isc_grant"]),
    ("GPL-3.0-or-later", ["gpl3", "gpl_later"]),
    ("GPL-2.0-or-later", ["gpl2", "gpl_later"]),
    ("LGPL", ["lgpl", "gpl_later"]),
    ("AGPL-3.0", ["agpl", "gpl_later"]),
    ("BSD-3-Clause", ["bsd_redist", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_redist", "bsd_source", "bsd_binary"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("Apache-2.0", ["spdx_apache2"]),
    ("MIT", ["spdx_mit"]),
    ("BSD-3-Clause", ["spdx_bsd3"]),
    ("BSD-2-Clause", ["spdx_bsd2"]),
    ("ISC", ["spdx_isc"]),
    ("GPL-3.0-or-later", ["spdx_gpl3_later"]),
    ("GPL-2.0-or-later", ["spdx_gpl2_later"]),
    ("GPL-3.0", ["spdx_gpl3"]),
    ("GPL-2.0", ["spdx_gpl2"]),
    ("LGPL", ["spdx_lgpl"]),
    ("AGPL-3.0", ["spdx_agpl"]),
    ("MPL-2.0", ["spdx_mpl2"]),
    ("CC-BY-NC-ND", ["cc_by_nc_nd"]),
    ("CC-BY-NC-SA", ["cc_by_nc_sa"]),
    ("CC-BY-NC", ["cc_by_nc"]),
    ("CC-BY-ND", ["cc_by_nd"]),
    ("CC-BY-SA", ["cc_by_sa"]),
    ("CC0", ["cc0"]),
    ("CC-BY", ["cc_by"]),
    ("AGPL-3.0", ["agpl"]),
    ("LGPL", ["lgpl"]),
    ("GPL-3.0", ["gpl3"]),
    ("GPL-2.0", ["gpl2"]),
    ("GPL", ["gpl"]),
    ("Apache-2.0", ["apache2"]),
    ("MPL-2.0", ["mpl2"]),
    ("EPL-2.0", ["epl2"]),
    ("EPL-1.0", ["epl1"]),
    ("MIT", ["mit"]),
    ("ISC", ["isc_grant"]),
    ("ISC", ["isc"]),
    ("BSD-3-Clause", ["bsd3"]),
    ("BSD-2-Clause", ["bsd2"]),
    ("BSD", ["bsd"]),
    ("Unlicense", ["unlicense"]),
    ("Public-Domain", ["public_domain"]),
]


def _identifier(said: Column) -> Column:
    """The identifier of what :data:`ANY` found."""
    found = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES):
        found = F.when(said.rlike(f"^(?:{pattern})$"), name).otherwise(found)
    return found


def identifiers(text: Column) -> Column:
    """What the text's sentences say about licences, in order; null says nothing."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT)
    likely = F.filter(parts, lambda s: s.rlike(HINT))
    normal = F.transform(likely, lambda s: F.trim(F.regexp_replace(s, "[^a-z0-9]+", " ")))
    said = F.flatten(F.transform(normal, lambda s: F.regexp_extract_all(s, F.lit(ANY), F.lit(0))))
    return F.transform(said, _identifier)


def matched(ids: Column) -> Column:
    """(left, names): the rules that fit the identifier sequence, in rule order, and the identifiers that none used."""
    # an identifier stands as |a|, a sequence as |a||b|
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("".join(f"|{i}|" for i in seq)).alias("seq")) for name, seq in RULES])
    start = F.struct(F.concat(F.lit("|"), F.array_join(ids, "||"), F.lit("|")).alias("left"), F.array().cast("array<string>").alias("names"))

    def step(acc: Column, rule: Column) -> Column:
        used = F.struct(F.replace(acc["left"], rule["seq"], F.lit("|#|")).alias("left"), F.concat(acc["names"], F.array(rule["name"])).alias("names"))
        return F.when(F.contains(acc["left"], rule["seq"]), used).otherwise(acc)

    return F.aggregate(rules, start, step)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_sentences, identifiers, licences) per row.

    ``n_sentences`` is the number of known statements, ``identifiers`` joins
    them in order, ``licences`` the
    distinct licences in alphabetical order, both by a comma.  Null and empty
    texts have none; repeated rows stay; an empty table gives an empty table.
    """
    ids = docs.select(F.col(id_col).alias("doc_id"), identifiers(F.col(text_col)).alias("ids"))
    ruled = ids.select("doc_id", "ids", F.when(F.size("ids") > 0, matched(F.col("ids"))["names"]).otherwise(F.array().cast("array<string>")).alias("names"))
    return ruled.select("doc_id", F.size("ids").alias("n_sentences"), F.array_join("ids", ",").alias("identifiers"),
                        F.array_join(F.array_sort(F.array_distinct("names")), ",").alias("licences"))


def oracle() -> str:
    """DuckDB SQL with the rows of :func:`scan` over ``documents``."""
    cases = " ".join(f"when regexp_matches(n, '^(?:{p})$') then '{name}'" for name, p in SENTENCES)
    sql = (f"with s as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{SPLIT}'), "
           f"lambda x: regexp_matches(x, '{HINT}')) as parts from documents), "
           f"i as (select r, doc_id, list_transform(flatten(list_transform(list_transform(parts, lambda x: trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g'))), "
           f"lambda x: regexp_extract_all(x, '{ANY}'))), lambda n: case {cases} end) as ids from s), "
           "t0 as (select r, doc_id, ids, '|' || array_to_string(ids, '||') || '|' as left_, [] :: varchar[] as names from i)")
    for k, (name, seq) in enumerate(RULES):
        wanted = "|" + "||".join(seq) + "|"
        sql += (f", t{k + 1} as (select r, doc_id, ids, replace(left_, '{wanted}', '|#|') as left_, "
                f"case when contains(left_, '{wanted}') then list_append(names, '{name}') else names end as names from t{k})")
    return sql + (f" select doc_id, len(ids)::int as n_sentences, array_to_string(ids, ',') as identifiers, "
                  f"array_to_string(list_sort(list_distinct(names)), ',') as licences from t{len(RULES)}")
