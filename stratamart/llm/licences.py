"""Licence scan: sentences to identifiers, identifier sequences to licences; SQL functions only.

A text is cut into sentences at ``.``, ``!`` or ``?`` before white space and at blank lines;
other white space becomes one space and A-Z lower case. A sentence that speaks of a licence gets
the identifiers of all patterns it contains, in the order of their places, or ``Unknown``. The
identifiers of a text, in order, are then rewritten by the licence rules, one rule after the other: a
rule takes up the identifiers it matches, so a full licence text wins over its parts. An SPDX
expression gives each of its identifiers.

The scan is one projection: nothing is shuffled, and a text without a licence word is only
searched for that word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# words that speak of a licence; sentences of WORDLESS patterns need none of them
LICENCE_WORDS = ["licen[cs]e", "copyright", "warrant", "permission", "redistribut", "public domain", "all rights reserved"]

_VERSION = r"(?:v|version )?([0-9]+(?:[.][0-9]+)?)"

_SPDX = r"\(*[a-z0-9.+-]*[a-z0-9+]\)*"
_UNDER = r"(?:(?:licensed|released|distributed|available|covered) under (?:the terms of )?(?:either )?|or |and )"

# identifier -> pattern of a normalised sentence; a group is the version
SENTENCES: list[tuple[str, str]] = [
    ("Spdx", rf"spdx-license-identifier: ?({_SPDX}(?: (?:or|and|with) {_SPDX})*)"),
    ("GplFreeLater", r"under the terms of the gnu general public license.* either " + _VERSION + r" of the license, or .*any later version"),
    ("LgplFreeLater", r"under the terms of the gnu (?:lesser|library) general public license.* either " + _VERSION + r" of the license, or .*any later version"),
    ("AgplRef", r"gnu affero general public license,? " + _VERSION),
    ("LgplRef", r"gnu (?:lesser|library) general public license,? " + _VERSION),
    ("GplRef", _UNDER + r"the (?:gnu general public license|gpl),? " + _VERSION),
    ("GplCopy", r"you should have received a copy of the gnu (?:[a-z]+ )?general public license"),
    ("GplWarranty", r"distributed in the hope that it will be useful, but without any warranty"),
    ("ApacheRef", r"(?:under (?:either )?|or |and )(?:the )?apache license,? " + _VERSION),
    ("ApacheUse", r"you may not use this file except in compliance with the license"),
    ("ApacheObtain", r"you may obtain a copy of the license at"),
    ("ApacheUnless", r"unless required by applicable law or agreed to in writing, software distributed under the license"),
    ("ApachePermissions", r"see the license for the specific language governing permissions and limitations"),
    ("MitRef", _UNDER + r"(?:the )?mit license"),
    ("MitGrant", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("MitNotice", r"copyright notice and this permission notice shall be included in all copies"),
    ("MitAsIs", r"the software is provided .?as is.?, without warranty of any kind"),
    ("IscGrant", r"permission to use, copy, modify, and/?o?r? distribute this software for any purpose"),
    ("BsdRef", _UNDER + r"(?:the|a) bsd(?:-style)? license"),
    ("BsdGrant", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BsdSource", r"redistributions of source code must retain the above copyright notice"),
    ("BsdBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BsdEndorse", r"neither the name of .* may be used to endorse or promote products"),
    ("BsdAsIs", r"this software is provided by .* .?as is.? and any express or implied warranties"),
    ("MplRef", r"mozilla public license,? " + _VERSION),
    ("CcByNcNd", r"(?:cc by-nc-nd|creative commons attribution-noncommercial-noderivatives) " + _VERSION),
    ("CcByNcSa", r"(?:cc by-nc-sa|creative commons attribution-noncommercial-sharealike) " + _VERSION),
    ("CcByNc", r"(?:cc by-nc|creative commons attribution-noncommercial) " + _VERSION),
    ("CcByNd", r"(?:cc by-nd|creative commons attribution-noderivatives) " + _VERSION),
    ("CcBySa", r"(?:cc by-sa|creative commons attribution-sharealike) " + _VERSION),
    ("CcBy", r"(?:cc by|creative commons attribution) " + _VERSION),
    ("PublicDomain", r"(?:released|dedicated|placed|is) (?:in|into|to) the public domain"),
    ("AllRights", r"all rights reserved"),
    ("Copyright", r"copyright (?:\(c\) |© )?[0-9]{4}"),
]

# patterns of sentences without a licence word -> words that such a sentence has
WORDLESS = {"GplRef": "gpl", "BsdEndorse": "endorse or promote", **dict.fromkeys(["CcByNcNd", "CcByNcSa", "CcByNc", "CcByNd", "CcBySa", "CcBy"], "cc by|creative commons")}

# licence <- sequence of identifiers, tried in this order; {v} is the version of the first one
RULES: list[tuple[str, str]] = [
    ("BSD-3-Clause", "[BsdGrant:][BsdSource:][BsdBinary:][BsdEndorse:][BsdAsIs:]?"),
    ("BSD-2-Clause", "[BsdGrant:][BsdSource:][BsdBinary:][BsdAsIs:]?"),
    ("MIT", "[MitRef:]?[MitGrant:][MitNotice:][MitAsIs:]"),
    ("MIT", "[MitRef:]"),
    ("ISC", "[IscGrant:][MitAsIs:]?"),
    ("Apache-{v}", "[ApacheRef:v][ApacheUse:]?[ApacheObtain:]?[ApacheUnless:]?[ApachePermissions:]?"),
    ("GPL-{v}-or-later", "[GplFreeLater:v][GplWarranty:]?[GplCopy:]?"),
    ("LGPL-{v}-or-later", "[LgplFreeLater:v][GplWarranty:]?[GplCopy:]?"),
    ("AGPL-{v}", "[AgplRef:v]"),
    ("LGPL-{v}", "[LgplRef:v]"),
    ("GPL-{v}", "[GplRef:v]"),
    ("MPL-{v}", "[MplRef:v]"),
    ("CC-BY-NC-ND-{v}", "[CcByNcNd:v]"),
    ("CC-BY-NC-SA-{v}", "[CcByNcSa:v]"),
    ("CC-BY-NC-{v}", "[CcByNc:v]"),
    ("CC-BY-ND-{v}", "[CcByNd:v]"),
    ("CC-BY-SA-{v}", "[CcBySa:v]"),
    ("CC-BY-{v}", "[CcBy:v]"),
    ("BSD", "[BsdRef:]"),
    ("{v}", "[Spdx:v]"),
    ("Public-Domain", "[PublicDomain:]"),
    ("All-Rights-Reserved", "[AllRights:]"),
]

_OPERATORS = ["", "or", "and", "with"]  # words of an SPDX expression that name no licence

SPACE = r"[ \t\n\x0B\f\r]"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEPS = [(r"\n[ \t\r]*\n", "\x01"), (rf"([.!?]){SPACE}+", "{1}\x01"), (rf"{SPACE}+", " ")]


def _rule_pattern(sequence: str) -> str:
    """``[Id:v][Id:]?`` as a regular expression over ``<Id:version>`` marks; group 1 is ``v``."""
    out = []
    for part in sequence.replace("]?", "?]").split("]"):
        if part:
            optional, (name, version) = part.endswith("?"), part.strip("[?").split(":")
            item = f"<{name}:" + ("([^>]*)" if version else "[^>]*") + ">"
            out.append(f"(?:{item})?" if optional else item)
    return "".join(out)


def _grouped(pattern: str) -> bool:
    """Whether a pattern has a group, which is the version."""
    return "(" in pattern.replace("(?:", "").replace(r"\(", "")


def _identifiers(sentence: Column) -> Column:
    """The marks of a sentence, by where each pattern is first found."""
    found = []
    for k, (name, pattern) in enumerate(SENTENCES):
        version = F.regexp_extract(sentence, pattern, 1) if _grouped(pattern) else F.lit("")
        found.append(F.when(sentence.rlike(pattern), F.struct(
            F.instr(sentence, F.regexp_extract(sentence, pattern, 0)).alias("at"), F.lit(k).alias("k"),
            F.concat(F.lit(f"<{name}:"), version, F.lit(">")).alias("mark"))))
    marks = F.transform(F.array_sort(F.filter(F.array(*found), lambda m: m.isNotNull())), lambda m: m["mark"])
    return F.when(F.size(marks) > 0, marks).otherwise(F.array(F.lit("<Unknown:>")))


def licence_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``sentence_ids`` (identifiers of its licence sentences, in order), ``licences``
    (distinct, sorted, joined by a comma), ``n_sentences`` and ``n_unknown`` (licence sentences
    that no pattern knows).

    Null and empty texts have none, an empty table gives no rows, and a text is scanned whole, however
    long. Every row is returned, repeated ones too; a column of ``docs``
    that has the name of a result column is replaced by it.
    """
    words = "|".join([*LICENCE_WORDS, *(p for name, p in SENTENCES if name in WORDLESS)])
    search = "|".join([*LICENCE_WORDS, *dict.fromkeys(WORDLESS.values())]).replace(" ", f"{SPACE}+")
    cut = F.translate(F.col(text), _UPPER, _LOWER)
    for pattern, replacement in _STEPS:
        cut = F.regexp_replace(cut, pattern, replacement.replace("{1}", "$1"))
    sentences = F.filter(F.split(cut, "\x01"), lambda s: s.rlike(words))
    marks = F.when(F.col(text).rlike(f"(?i){search}"), F.transform(sentences, _identifiers)).otherwise(F.array().cast("array<array<string>>"))
    found = docs.withColumn("_marks", marks)
    sequence = F.array_join(F.flatten("_marks"), "")
    for licence, rule in RULES:
        sequence = F.regexp_replace(sequence, _rule_pattern(rule), "{" + licence.replace("{v}", "$1") + "}")
    named = F.regexp_extract_all(sequence, F.lit(r"\{([^}]*)\}"), F.lit(1))
    single = F.flatten(F.transform(named, lambda l: F.filter(F.split(l, "[ ()]+"), lambda w: ~w.isin(*_OPERATORS))))
    return found.withColumns({
        "sentence_ids": F.regexp_replace(F.array_join(F.flatten("_marks"), ","), "[<>]|:>", ""),
        "licences": F.array_join(F.array_sort(F.array_distinct(single)), ","),
        "n_sentences": F.size("_marks").cast("bigint"),
        "n_unknown": F.size(F.filter("_marks", lambda m: F.array_contains(m, "<Unknown:>"))).cast("bigint"),
    }).drop("_marks")


def oracle() -> str:
    """The same scan as DuckDB SQL over ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    words = "|".join([*LICENCE_WORDS, *(p for name, p in SENTENCES if name in WORDLESS)])
    cut = f"translate(text, '{_UPPER}', '{_LOWER}')"
    for pattern, replacement in _STEPS:
        to = "'" + replacement.replace("{1}", r"\1").replace("\x01", "' || chr(1) || '") + "'"
        cut = f"regexp_replace({cut}, {quote(pattern)}, {to}, 'g')"
    found = []
    for k, (name, pattern) in enumerate(SENTENCES):
        version = f"regexp_extract(s, {quote(pattern)}, 1)" if _grouped(pattern) else "''"
        found.append(f"CASE WHEN regexp_matches(s, {quote(pattern)}) THEN {{'at': strpos(s, regexp_extract(s, {quote(pattern)})), 'k': {k}, "
                     f"'mark': '<{name}:' || {version} || '>'}} END")
    marks = f"list_transform(list_sort(list_filter([{', '.join(found)}], lambda m: m IS NOT NULL)), lambda m: m.mark)"
    sequence = "array_to_string(flatten(marks), '')"
    for licence, rule in RULES:
        to = "'{" + licence.replace("{v}", r"\1") + "}'"
        sequence = f"regexp_replace({sequence}, {quote(_rule_pattern(rule))}, {to}, 'g')"
    named = f"regexp_extract_all({sequence}, '\\{{([^}}]*)\\}}', 1)"
    operators = ", ".join(map(quote, _OPERATORS))
    single = f"flatten(list_transform({named}, lambda l: list_filter(string_split_regex(l, '[ ()]+'), lambda w: w NOT IN ({operators}))))"
    return f"""
WITH cut AS (
  SELECT doc_id, CASE WHEN text IS NULL THEN CAST([] AS VARCHAR[][]) ELSE
    list_transform(list_transform(list_filter(string_split({cut}, chr(1)), lambda s: regexp_matches(s, {quote(words)})), lambda s: {marks}),
      lambda m: CASE WHEN len(m) > 0 THEN m ELSE ['<Unknown:>'] END) END AS marks
  FROM documents)
SELECT doc_id, regexp_replace(array_to_string(flatten(marks), ','), '[<>]|:>', '', 'g') AS sentence_ids,
  array_to_string(list_sort(list_distinct({single})), ',') AS licences,
  CAST(len(marks) AS BIGINT) AS n_sentences,
  CAST(len(list_filter(marks, lambda m: list_contains(m, '<Unknown:>'))) AS BIGINT) AS n_unknown
FROM cut"""
