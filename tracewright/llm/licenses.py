"""Licence recognition by sentence rules, with DataFrame and SQL functions only.

Sentences are normalised and mapped to identifiers of known licence sentences; sequences of identifiers are matched
against ordered licence rules. The same rule tables also write the SQL for another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A text without any of these words has no licence sentence; every sentence that a pattern matches holds one of them.
FILTER = (
    "licen[cs]e|copyright|permission|redistribut|warrant|spdx|public domain|all rights reserved|as is|licensing|gpl|cc0|released under|dedicated to|liable|in the hope that"
    "|neither the name of|provided by"
)
#: The licence expression of a tag.
SPDX = r"(?i)spdx-licen[cs]e-identifier:[ \t]*((?:[A-Za-z0-9.+()-]+[ \t]+(?:AND|OR|WITH)[ \t]+)*[A-Za-z0-9.+()-]*[A-Za-z0-9+)])"
#: A line that is shorter than this ends a sentence, as a line does that ends with a stop; others may be wrapped.
WRAPPED = 40

#: Known licence sentences, fixed values: identifier and pattern of the whole normalised sentence (lower case, words of
#: letters and digits with single spaces between). The first pattern that matches names the sentence.
SENTENCES = [
    ("spdxTag", r".*spdx licen[cs]e identifier .*"),
    ("negated", r"(.* )?(not|never|no longer) (be )?(licensed|released|distributed|available|covered) under .*"),
    ("dualMitGpl", r"(.* )?(dual )?licensed under (the )?(terms of )?(the )?(mit (license )?(and|or) (the )?(gnu )?gpl|(gnu )?gpl (license )?(and|or) (the )?mit)( (version |v)?[23])?( licen[cs]es?)?"),
    ("dualMitApache2", r"(.* )?(dual )?licensed under (the )?(terms of )?((both )?(the )?mit (license )?(and|or) (the )?apache (license )?(version )?2 0|(both )?(the )?apache (license )?(version )?2 0 (license )?(and|or) (the )?mit)( licen[cs]es?)?"),
    ("apache2Ref", r"(.* )?(licensed|released|distributed|available) under (the )?(terms of )?(the )?apache (software )?license(,)? (version )?2( 0)?( the license)?"),
    ("apacheLimits", r"you may not use this (file|work|software) except in compliance with the license"),
    ("apacheCopy", r"you may obtain a copy of the license at.*"),
    ("apacheAsIs", r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis.*"),
    ("apacheSee", r"see the license for the specific language governing permissions and limitations under the license"),
    ("mitRef", r"(.* )?(licensed|released|distributed|available|covered) under (the )?(terms of )?(the )?(mit|expat) license"),
    ("mitTitle", r"(the )?mit license( mit)?"),
    ("mitGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software.*"),
    ("mitNotice", r"the above copyright notice and this permission notice.* shall be included in all copies or substantial portions of the software"),
    ("iscGrant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that.*"),
    ("zeroBsdGrant", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("iscRef", r"(.* )?(licensed|released|distributed|available|covered) under (the )?(terms of )?(the )?isc license"),
    ("zeroBsdRef", r"(.* )?(licensed|released|distributed|available|covered) under (the )?(terms of )?(the )?(0bsd|0 clause bsd|zero clause bsd)( license)?"),
    ("artisticRef", r"(.* )?under (the )?(terms of )?(the )?(perl )?artistic license( (version )?2 0)?( .*)?"),
    ("ncsaRef", r"(.* )?under (the )?(terms of )?(the )?(university of illinois )?ncsa open source license( .*)?"),
    ("wtfplRef", r"(.* )?under (the )?(terms of )?(the )?(wtfpl|do what the fuck you want to public license)( .*)?"),
    ("asIsNoWarranty", r"the software is provided as is without warranty of any kind.*"),
    ("noLiability", r"in no event shall the (authors or copyright holders|copyright (holder|owner)s? or contributors|author) be liable.*"),
    ("bsdRef", r"(.* )?(licensed|released|distributed|available) under (the )?(terms of )?(the )?(new |simplified |modified |[234] clause )*bsd( [234] clause)? license"),
    ("bsdGrant", r"redistribution and use in source and binary forms with or without modification are permitted provided that.*"),
    ("bsdSource", r"([0-9] )?redistributions of source code must retain the above copyright notice.*"),
    ("bsdBinary", r"([0-9] )?redistributions in binary form must reproduce the above copyright notice.*"),
    ("bsdNoEndorse", r"([0-9] )?neither the name of .* may be used to endorse or promote products.*"),
    ("bsdAsIs", r"this software is provided by .* as is and any express or implied warranties.*"),
    ("agpl3Ref", r"(.* )?(licensed|released|distributed|available|covered) under (the )?(terms of )?(the )?(gnu affero general public license|agpl|gnu agpl)( as published by the free software foundation)?( either)? (version |v)?3( 0)?( or .*later.*)?( of the license)?"),
    ("lgplRef", r"(.* )?(licensed|released|distributed|available|covered) under (the )?(terms of )?(the )?(gnu (lesser|library) general public license|lgpl|gnu lgpl)( as published by the free software foundation)?( either)?( (version |v)?[23]( [01])?)?( or .*later.*)?( of the license)?"),
    ("gpl3Ref", r"(.* )?(licensed|released|distributed|available|covered) under (the )?(terms of )?(the )?(gnu general public license|gpl|gnu gpl)( as published by the free software foundation)?( either)? (version |v)?3( 0)?( of the license)?( or .*later.*)?"),
    ("gpl2Ref", r"(.* )?(licensed|released|distributed|available|covered) under (the )?(terms of )?(the )?(gnu general public license|gpl|gnu gpl)( as published by the free software foundation)?( either)? (version |v)?2( 0)?( of the license)?( or .*later.*)?"),
    ("agplFree", r"(.* )?you can redistribute it and or modify it under the terms of the gnu affero general public license.*"),
    ("lgplFree", r"(.* )?you can redistribute it and or modify it under the terms of the gnu (lesser|library) general public license.*"),
    ("gpl3Free", r"(.* )?you can redistribute it and or modify it under the terms of the gnu general public license.* version 3.*"),
    ("gpl2Free", r"(.* )?you can redistribute it and or modify it under the terms of the gnu general public license.* version 2.*"),
    ("gplFree", r"(.* )?you can redistribute it and or modify it under the terms of the gnu general public license.*"),
    ("eplRef", r"(.* )?under (the )?(terms of )?(the )?eclipse public license (version |v )?(v)?[12] 0.*"),
    ("boostRef", r"(.* )?(licensed|released|distributed) under (the )?(terms of )?(the )?boost software license( version 1 0)?.*"),
    ("zlibAsIs", r"this software is provided as is without any express or implied warranty.*"),
    ("apacheTitle", r"apache license( version 2 0)?( january 2004)?"),
    ("gplHope", r"(.* )?distributed in the hope that it will be useful but without any warranty.*"),
    ("gplCopy", r"you should have received a copy of the gnu (affero |lesser )?general public license.*"),
    ("mplRef", r"(.* )?subject to the terms of the mozilla public license v(ersion)? ?( )?2 0( if a copy of the mpl was not distributed with this file.*)?"),
    ("mplName", r"(.* )?(licensed|released|distributed|available) under (the )?(terms of )?(the )?mozilla public license (version |v )?2 0"),
    ("ccByNcNd", r"(.* )?licensed under (a |the )?(creative commons|cc) (attribution noncommercial noderiv(ative)?s|by nc nd) [1-4] [05]( international)?( license)?"),
    ("ccByNcSa", r"(.* )?licensed under (a |the )?(creative commons|cc) (attribution noncommercial sharealike|by nc sa) [1-4] [05]( international)?( license)?"),
    ("ccByNc", r"(.* )?licensed under (a |the )?(creative commons|cc) (attribution noncommercial|by nc) [1-4] [05]( international)?( license)?"),
    ("ccByNd", r"(.* )?licensed under (a |the )?(creative commons|cc) (attribution noderiv(ative)?s|by nd) [1-4] [05]( international)?( license)?"),
    ("ccBySa", r"(.* )?licensed under (a |the )?(creative commons|cc) (attribution sharealike|by sa) [1-4] [05]( international)?( license)?"),
    ("ccBy", r"(.* )?licensed under (a |the )?(creative commons|cc) (attribution|by) [1-4] [05]( international)?( license)?"),
    ("cc0", r"(.* )?(licensed under|released under|dedicated to) (the )?(creative commons |cc)?(0|cc0|zero|public domain).*"),
    ("unlicense", r"this is free and unencumbered software released into the public domain"),
    ("allRights", r"(.* )?all rights reserved"),
    ("copyright", r"copyright (c )?[0-9]{4}.*"),
    ("mention", r".*\b(licen[cs]e|licen[cs]ed|licensing)\b.*"),
]

#: Ordered licence rules, fixed values: a licence and the identifiers that must follow one another. The first rules
#: are tried first, and what they match is used up.
RULES = [
    ("MIT", ["mitGrant", "mitNotice", "asIsNoWarranty", "noLiability"]),
    ("MIT", ["mitGrant", "mitNotice", "asIsNoWarranty"]),
    ("MIT", ["mitGrant", "mitNotice"]),
    ("ISC", ["iscGrant", "asIsNoWarranty"]),
    ("ISC", ["iscGrant"]),
    ("0BSD", ["zeroBsdGrant", "asIsNoWarranty"]),
    ("0BSD", ["zeroBsdGrant"]),
    ("BSD-3-Clause", ["bsdGrant", "bsdSource", "bsdBinary", "bsdNoEndorse", "bsdAsIs"]),
    ("BSD-3-Clause", ["bsdGrant", "bsdSource", "bsdBinary", "bsdNoEndorse"]),
    ("BSD-2-Clause", ["bsdGrant", "bsdSource", "bsdBinary", "bsdAsIs"]),
    ("BSD-2-Clause", ["bsdGrant", "bsdSource", "bsdBinary"]),
    ("Apache-2.0", ["apache2Ref", "apacheLimits", "apacheCopy", "apacheAsIs", "apacheSee"]),
    ("Apache-2.0", ["apache2Ref", "apacheLimits", "apacheCopy"]),
    *((licence, [free, *rest]) for licence, free in [("AGPL-3.0", "agplFree"), ("LGPL", "lgplFree"), ("GPL-3.0", "gpl3Free"), ("GPL-2.0", "gpl2Free"), ("GPL", "gplFree")] for rest in (["gplHope", "gplCopy"], ["gplHope"], [])),
    ("Apache-2.0", ["apacheLimits", "apacheCopy", "apacheAsIs"]),
    ("Apache-2.0", ["apache2Ref"]),
    ("Apache-2.0", ["apacheTitle"]),
    ("GPL==MIT", ["dualMitGpl"]),  # two licences
    ("Apache-2.0==MIT", ["dualMitApache2"]),
    ("ISC", ["iscRef"]),
    ("0BSD", ["zeroBsdRef"]),
    ("Artistic", ["artisticRef"]),
    ("NCSA", ["ncsaRef"]),
    ("WTFPL", ["wtfplRef"]),
    ("MIT", ["mitRef"]),
    ("MIT", ["mitTitle"]),
    ("BSD", ["bsdRef"]),
    ("AGPL-3.0", ["agpl3Ref"]),
    ("LGPL", ["lgplRef"]),
    ("GPL-3.0", ["gpl3Ref"]),
    ("GPL-2.0", ["gpl2Ref"]),
    ("EPL", ["eplRef"]),
    ("BSL-1.0", ["boostRef"]),
    ("Zlib", ["zlibAsIs"]),
    ("MPL-2.0", ["mplRef"]),
    ("MPL-2.0", ["mplName"]),
    ("CC-BY-NC-ND", ["ccByNcNd"]),
    ("CC-BY-NC-SA", ["ccByNcSa"]),
    ("CC-BY-NC", ["ccByNc"]),
    ("CC-BY-ND", ["ccByNd"]),
    ("CC-BY-SA", ["ccBySa"]),
    ("CC-BY", ["ccBy"]),
    ("CC0-1.0", ["cc0"]),
    ("Unlicense", ["unlicense"]),
    ("SPDX", ["spdxTag"]),
]


def _used_up(column: str, replace: str = "replace") -> str:
    """Nested SQL calls that put ``=licence=`` in the place of each rule's sequence, the first rule innermost."""
    for licence, sequence in RULES:
        column = f"{replace}({column}, '{''.join(f';{s};' for s in sequence)}', '={licence}=')"
    return column


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, licenses, sentences, n_sentences, unmatched``.

    ``licenses`` are the distinct licences that rules found and the expressions of SPDX tags, sorted and joined by commas;
    ``sentences`` the identifiers of all licence sentences in the order of the text, joined by commas; ``unmatched``
    counts those that no rule used. Sentences end at white space after one of ``.!?`` and at a line's end if the line is
    a licence sentence of its own, ends with a stop, is short or empty; other lines are wrapped and go on in the next.
    Signs such as comment marks count as white space. Null, empty and plain texts give empty strings
    and zeros. Repeated rows are scanned alike. Other columns are ignored, whatever their names. No rows give no rows;
    nothing is shuffled.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.when(F.lower(text).rlike(FILTER.replace(" ", "[^a-z0-9]+")), text).otherwise("").alias("text"))
    # The stop of a "v." before a number ends no sentence.
    lines = F.split(F.regexp_replace(F.regexp_replace("text", r"([Vv])\.[ \t]*([0-9])", "$1 $2"), r"([.!?])[ \t\r]+", "$1\n"), "\n")

    def named(s, last: int):
        out = F.lit(None).cast("string")
        for name, pattern in reversed(SENTENCES[:last]):
            out = F.when(s.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
        return F.when(s.rlike(FILTER), out)

    def plain(s):
        ends = s.rlike(r"[.!?:;][ \t\r]*$") | (F.length(s) < WRAPPED)
        return F.concat(F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " ")), F.when(ends, "\n").otherwise(" "))

    # A line that is a sentence of its own (a mere mention is none) becomes its identifier after a tilde.
    own = lambda s: F.coalesce(F.concat(F.lit("\n~"), named(F.regexp_replace(s, "[ \n]$", ""), -1), F.lit("\n")), s)
    joined = F.split(F.array_join(F.transform(F.transform(lines, plain), own), ""), "\n")
    ids = F.filter(F.transform(joined, lambda s: F.when(s.startswith("~"), F.substring(s, 2, 99)).otherwise(named(F.trim(s), len(SENTENCES)))), lambda s: s.isNotNull())
    found = texts.select("doc_id", ids.alias("ids"), F.regexp_extract_all("text", F.lit(SPDX), F.lit(1)).alias("tags"))
    found = found.withColumn("left", F.expr(_used_up("concat(';', array_join(ids, ';;'), ';')")))
    by_rule = F.filter(F.regexp_extract_all("left", F.lit("=([^=]+)="), F.lit(1)), lambda s: (s != "SPDX") | (F.size("tags") == 0))
    over = F.size(F.filter(F.split(F.regexp_replace("left", "=[^=]+=", ";"), ";"), lambda s: s != ""))
    return found.select(
        "doc_id", F.array_join(F.array_sort(F.array_distinct(F.concat(by_rule, "tags"))), ",").alias("licenses"), F.array_join("ids", ",").alias("sentences"),
        F.size("ids").cast("long").alias("n_sentences"), over.cast("long").alias("unmatched"),
    )


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    case = lambda last: f"CASE WHEN NOT regexp_matches(s, '{FILTER}') THEN NULL " + " ".join(f"WHEN regexp_full_match(s, '{p}') THEN '{n}'" for n, p in SENTENCES[:last]) + " END"
    return f"""
WITH t AS (SELECT doc_id, CASE WHEN regexp_matches(lower(coalesce(text, '')), '{FILTER.replace(" ", "[^a-z0-9]+")}') THEN text ELSE '' END AS text FROM documents),
w AS (SELECT doc_id, text, list_transform(string_split(regexp_replace(regexp_replace(text, '([Vv])\\.[ \\t]*([0-9])', '\\1 \\2', 'g'), '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)),
  lambda s: {{'s': trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')), 'e': CASE WHEN regexp_matches(s, '[.!?:;][ \\t\\r]*$') OR length(s) < {WRAPPED} THEN chr(10) ELSE ' ' END}}) AS plain FROM t),
o AS (SELECT doc_id, text, list_transform(plain, lambda x: x.s) AS s, list_transform(plain, lambda x: x.s || x.e) AS x FROM w),
n AS (SELECT doc_id, text, x, list_transform(s, lambda s: {case(-1)}) AS own FROM o),
j AS (SELECT doc_id, text, string_split(array_to_string(list_transform(list_zip(own, x), lambda z: coalesce(chr(10) || '~' || z[1] || chr(10), z[2])), ''), chr(10)) AS parts FROM n),
m AS (SELECT doc_id, text, list_filter(list_transform(list_transform(parts, lambda p: trim(p)), lambda s: CASE WHEN s[1] = '~' THEN s[2:] ELSE {case(len(SENTENCES))} END), lambda s: s IS NOT NULL) AS ids FROM j),
u AS (SELECT doc_id, ids, regexp_extract_all(text, '{SPDX}', 1) AS tags, {_used_up("';' || array_to_string(ids, ';;') || ';'")} AS rest FROM m)
SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(rest, '=([^=]+)=', 1), lambda s: s <> 'SPDX' OR len(tags) = 0), tags))), ','), '') AS licenses,
  coalesce(array_to_string(ids, ','), '') AS sentences, CAST(len(ids) AS BIGINT) AS n_sentences,
  CAST(len(list_filter(string_split(regexp_replace(rest, '=[^=]+=', ';', 'g'), ';'), lambda s: s <> '')) AS BIGINT) AS unmatched
FROM u
"""


OP9_SQL = _sql()
