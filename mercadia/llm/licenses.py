"""Licences by sentence rules: known sentences become identifiers, their sequences become licences.

A text is cut into sentences, and these are normalised: comment marks, quotes and extra white space
go, letters become small. A table of patterns names the sentences that licences are made of; other
sentences have no identifier. The document's identifiers, in order, are then read by a table of
licence rules, from the first, most specific rule to the last: where a rule's sequence stands, it
becomes the licence's name, so its sentences serve no later rule. Identifiers that no rule takes
are reported as unmatched; a sentence that denies a licence is one of them.

All of it is one projection of built-in functions on each row; there is no shuffle. Texts that
mention none of the licences' key words skip the cutting; very long texts are read whole. Ties
between patterns or rules go to the first of the table. A null or empty text has no licence;
repeated rows get equal results, null ids stay null, an empty table gives no rows, and further
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Sentence(NamedTuple):
    """A pattern's name; with `tail`, letters and digits of that group of the pattern follow the name."""

    name: str
    pattern: str
    tail: int = 0


class Licence(NamedTuple):
    name: str
    sentences: tuple[str, ...]


#: Words before a licence's name in a sentence that grants it.
GRANT = r"(?:.* )?(?:licen[sc]ed|licen[sc]e|released|available|distributed|shared|published) under (?:the terms of )?(?:a |an |the )?"
CC = GRANT + r"(?:cc|creative commons)[ -](?:by|attribution)"
VERSION = r"(?:[ -](?:licen[sc]e )?(?:version )?v?(\d\.\d))?"
OR_LATER = r"(?: of the licen[sc]e)?,? or (?:\(?at your option\)?,? )?(?:any )?later"

#: Sentences by pattern, matched against the normalised sentence from its start; the first that fits names it.
SENTENCES = (
    Sentence("Spdx", r"spdx-licen[sc]e-identifier-([a-z0-9.+-]+)", 1),
    # A denial is no licence; it is reported as an identifier that no rule takes.
    Sentence("Denied", r"(.* )?(not|never|nor|neither|isnt|cannot be|no longer)( yet| been| be| longer)* (licen[sc]ed|released|available|distributed|shared|published|dedicated|placed) (in)?(under|to)"),
    Sentence("MitRef", r"(.* )?(released|licensed|distributed|available) under (the )?(terms of (the )?)?mit(/x11)? licen[sc]e"),
    Sentence("MitTitle", r"(the )?mit licen[sc]e( \(mit\))?$"),
    Sentence("MitGrant", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    Sentence("MitNotice", r"the above copyright notice and this permission notice shall be included in all copies"),
    Sentence("AsIsMit", r"the software is provided as is, without warranty of any kind"),
    Sentence("NoLiabilityMit", r"in no event shall the authors or copyright holders be liable"),
    Sentence("ApacheRef2", r"(.* )?licensed under the apache licen[sc]e,? (version |v)?2(\.0)?"),
    Sentence("ApacheNotUse", r"you may not use this file except in compliance with the licen[sc]e"),
    Sentence("ApacheCopy", r"you may obtain a copy of the licen[sc]e at"),
    Sentence("ApacheAsIs", r"unless required by applicable law or agreed to in writing, software distributed under the licen[sc]e"),
    Sentence("ApacheLimits", r"see the licen[sc]e for the specific language governing permissions"),
    Sentence("GplRef3Later", r"((.* )?(gnu|the|a|this|under|of) )?general public licen[sc]e.* version 3(\.0)?( of the licen[sc]e)?,? or (\(?at your option\)?,? )?(any )?later"),
    Sentence("GplRef2Later", r"((.* )?(gnu|the|a|this|under|of) )?general public licen[sc]e.* version 2(\.0)?( of the licen[sc]e)?,? or (\(?at your option\)?,? )?(any )?later"),
    Sentence("GplRef3", r"(.* )?gnu general public licen[sc]e,? (as published by the free software foundation,? )?(either )?version 3"),
    Sentence("GplRef2", r"(.* )?gnu general public licen[sc]e,? (as published by the free software foundation,? )?(either )?version 2"),
    # The notice of version 2 has a semicolon before the version.
    Sentence("GplRefOpen", r"(.* )?gnu general public licen[sc]e,? as published by the free software foundation$"),
    Sentence("Version21Later", r"(either )?version 2\.1" + OR_LATER),
    Sentence("Version21Only", r"version 2\.1( of the licen[sc]e)?$"),
    Sentence("Version3Later", r"(either )?version 3(\.0)?( of the licen[sc]e)?,? or (\(?at your option\)?,? )?(any )?later"),
    Sentence("Version2Later", r"(either )?version 2(\.0)?( of the licen[sc]e)?,? or (\(?at your option\)?,? )?(any )?later"),
    Sentence("Version3Only", r"version 3(\.0)?( of the licen[sc]e)?$"),
    Sentence("Version2Only", r"version 2(\.0)?( of the licen[sc]e)?$"),
    Sentence("LgplLater", r"(?:.* )?gnu (?:lesser|library) general public licen[sc]e.* version (\d(?:\.\d)?)" + OR_LATER, 1),
    Sentence("LgplRef", r"(?:.* )?gnu (?:lesser|library) general public licen[sc]e(?:,? (?:as published by the free software foundation,? )?(?:either )?(?:version |v)(\d(?:\.\d)?))?", 1),
    Sentence("AgplLater", r"(?:.* )?gnu affero general public licen[sc]e.* version (\d(?:\.\d)?)" + OR_LATER, 1),
    Sentence("AgplRef", r"(?:.* )?gnu affero general public licen[sc]e(?:,? (?:as published by the free software foundation,? )?(?:either )?(?:version |v)(\d(?:\.\d)?))?", 1),
    Sentence("GplFreeSoftware", r"this program is free software( you can redistribute it|$)"),
    Sentence("GplNoWarranty", r"this program is distributed in the hope that it will be useful, but without any warranty"),
    Sentence("BsdRedistribution", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    Sentence("BsdSource", r"(1\.? )?redistributions of source code must retain the above copyright notice"),
    Sentence("BsdBinary", r"(2\.? )?redistributions in binary form must reproduce the above copyright notice"),
    Sentence("BsdEndorse", r"(3\.? )?neither the name of .* may be used to endorse or promote products"),
    Sentence("BsdAsIs", r"this software is provided by the copyright holders and contributors as is"),
    Sentence("BsdNoLiability", r"in no event shall the copyright (holder|owner)s? or contributors be liable"),
    Sentence("CcByNcNd", CC + r"[ -](?:nc|non[ -]?commercial)[ -](?:nd|no[ -]?deriv(?:ative)?s)" + VERSION, 1),
    Sentence("CcByNcSa", CC + r"[ -](?:nc|non[ -]?commercial)[ -](?:sa|share[ -]?alike)" + VERSION, 1),
    Sentence("CcByNc", CC + r"[ -](?:nc|non[ -]?commercial)" + VERSION, 1),
    Sentence("CcBySa", CC + r"[ -](?:sa|share[ -]?alike)" + VERSION, 1),
    Sentence("CcByNd", CC + r"[ -](?:nd|no[ -]?deriv(?:ative)?s)" + VERSION, 1),
    Sentence("CcBy", CC + VERSION, 1),
    Sentence("Cc0", r"(.* )?(licen[sc]ed|licen[sc]e|released|available|distributed|dedicated|marked|waived) (under|with|to|by|using) (a |the )?(cc0|creative commons (cc0|zero))"),
    Sentence("IscGrant", r"permission to use, copy, modify,? and(/or)? distribute this software for any purpose with or without fee is hereby granted"),
    Sentence("IscAsIs", r"the software is provided as is and the author disclaims all warranties"),
    Sentence("UnlicenseRef", r"this is free and unencumbered software released into the public domain"),
    Sentence("ZlibAsIs", r"this software is provided as-is, without any express or implied warranty"),
    Sentence("ZlibNoLiability", r"in no event will the authors? be held liable for any damages"),
    Sentence("ZlibGrant", r"permission is granted to anyone to use this software for any purpose, including commercial applications"),
    Sentence("ZlibOrigin", r"(1\.? )?the origin of this software must not be misrepresented"),
    Sentence("EplRef", r"(?:.* )?eclipse public licen[sc]e,?(?: -)?(?: version| v)?(?: (\d\.\d))?", 1),
    Sentence("BslRef", r"(.* )?boost software licen[sc]e,?( -)?( version| v)? 1\.0"),
    Sentence("MplRef2", r"(.* )?(subject to the terms of the mozilla public licen[sc]e,? v(ersion|\.)? ?2|source code form is subject to the terms of the mozilla public licen[sc]e,? v$)"),
    Sentence("PublicDomain", r"(.* )?(released|dedicated|placed) (in)?to the public domain"),
    Sentence("AllRights", r"(.* )?all rights reserved"),
)



def digits(version: str) -> str:
    """A version in identifiers."""
    return version.replace(".", "")


def shorts(version: str) -> tuple[str, ...]:
    """A version in identifiers: with and without a zero at its end."""
    return (version.replace(".", ""), version[0]) if version.endswith(".0") else (version.replace(".", ""),)


#: Licences with versions: name, identifier, version.
LESSER = (("LGPL", "Lgpl", "3.0"), ("LGPL", "Lgpl", "2.1"), ("LGPL", "Lgpl", "2.0"), ("AGPL", "Agpl", "3.0"))
CREATIVE = {
    "CcByNcNd": "CC-BY-NC-ND", "CcByNcSa": "CC-BY-NC-SA", "CcByNc": "CC-BY-NC", "CcBySa": "CC-BY-SA", "CcByNd": "CC-BY-ND", "CcBy": "CC-BY",
}
CC_VERSIONS = ("4.0", "3.0", "2.5", "2.0", "1.0")
#: Licence identifiers that a line of its own may name.
SPDX = (
    "MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "Unlicense", "MPL-2.0", "EPL-1.0", "EPL-2.0", "BSL-1.0",
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "CC0-1.0",
    "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)

#: Sequences by licence, in the order in which they are tried.
LICENCES = (
    Licence("BSD-3-Clause", ("BsdRedistribution", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs", "BsdNoLiability")),
    Licence("BSD-2-Clause", ("BsdRedistribution", "BsdSource", "BsdBinary", "BsdAsIs", "BsdNoLiability")),
    Licence("MIT", ("MitTitle", "MitGrant", "MitNotice", "AsIsMit", "NoLiabilityMit")),
    Licence("MIT", ("MitTitle", "MitGrant", "MitNotice", "AsIsMit")),
    Licence("MIT", ("MitGrant", "MitNotice", "AsIsMit", "NoLiabilityMit")),
    Licence("MIT", ("MitGrant", "MitNotice", "AsIsMit")),
    Licence("Apache-2.0", ("ApacheRef2", "ApacheNotUse", "ApacheCopy", "ApacheAsIs", "ApacheLimits")),
    Licence("Apache-2.0", ("ApacheRef2", "ApacheNotUse", "ApacheCopy")),
    Licence("Apache-2.0", ("ApacheRef2",)),
    Licence("GPL-3.0-or-later", ("GplFreeSoftware", "GplRefOpen", "Version3Later", "GplNoWarranty")),
    Licence("GPL-3.0-or-later", ("GplFreeSoftware", "GplRef3Later", "GplNoWarranty")),
    Licence("GPL-2.0-or-later", ("GplFreeSoftware", "GplRefOpen", "Version2Later", "GplNoWarranty")),
    Licence("GPL-2.0-or-later", ("GplFreeSoftware", "GplRef2Later", "GplNoWarranty")),
    Licence("GPL-3.0", ("GplFreeSoftware", "GplRefOpen", "Version3Only", "GplNoWarranty")),
    Licence("GPL-3.0", ("GplFreeSoftware", "GplRef3", "GplNoWarranty")),
    Licence("GPL-2.0", ("GplFreeSoftware", "GplRefOpen", "Version2Only", "GplNoWarranty")),
    Licence("GPL-2.0", ("GplFreeSoftware", "GplRef2", "GplNoWarranty")),
    *(Licence(f"{name}-{v}-or-later", ("GplFreeSoftware", f"{ref}Ref", f"Version{shorts(v)[-1]}Later", "GplNoWarranty")) for name, ref, v in LESSER),
    *(Licence(f"{name}-{v}-or-later", ("GplFreeSoftware", f"{ref}Later{short}", "GplNoWarranty")) for name, ref, v in LESSER for short in shorts(v)),
    *(Licence(f"{name}-{v}", ("GplFreeSoftware", f"{ref}Ref{short}", "GplNoWarranty")) for name, ref, v in LESSER for short in shorts(v)),
    *(Licence(name, ("GplFreeSoftware", f"{ref}Ref", "GplNoWarranty")) for name, ref in (("LGPL", "Lgpl"), ("AGPL", "Agpl"))),
    Licence("GPL-3.0-or-later", ("GplRefOpen", "Version3Later")),
    Licence("GPL-3.0-or-later", ("GplRef3Later",)),
    Licence("GPL-2.0-or-later", ("GplRefOpen", "Version2Later")),
    Licence("GPL-2.0-or-later", ("GplRef2Later",)),
    Licence("GPL-3.0", ("GplRefOpen", "Version3Only")),
    Licence("GPL-3.0", ("GplRef3",)),
    Licence("GPL-2.0", ("GplRefOpen", "Version2Only")),
    Licence("GPL-2.0", ("GplRef2",)),
    *(Licence(f"{name}-{v}-or-later", (f"{ref}Ref", f"Version{shorts(v)[-1]}Later")) for name, ref, v in LESSER),
    *(Licence(f"{name}-{v}-or-later", (f"{ref}Later{short}",)) for name, ref, v in LESSER for short in shorts(v)),
    *(Licence(f"{name}-{v}", (f"{ref}Ref{short}",)) for name, ref, v in LESSER for short in shorts(v)),
    *(Licence(name, (f"{ref}Ref",)) for name, ref in (("LGPL", "Lgpl"), ("AGPL", "Agpl"))),
    Licence("Zlib", ("ZlibAsIs", "ZlibNoLiability", "ZlibGrant", "ZlibOrigin")),
    Licence("Zlib", ("ZlibGrant", "ZlibOrigin")),
    Licence("ISC", ("IscGrant", "IscAsIs")),
    Licence("ISC", ("IscGrant",)),
    Licence("Unlicense", ("UnlicenseRef",)),
    *(Licence(f"EPL-{v}", (f"EplRef{digits(v)}",)) for v in ("1.0", "2.0")),
    Licence("BSL-1.0", ("BslRef",)),
    Licence("CC0-1.0", ("Cc0",)),
    Licence("MIT", ("MitRef",)),
    Licence("MIT", ("MitTitle",)),
    *(Licence(f"{name}-{v}", (f"{ref}{digits(v)}",)) for ref, name in CREATIVE.items() for v in CC_VERSIONS),
    *(Licence(name, (ref,)) for ref, name in CREATIVE.items()),
    Licence("MPL-2.0", ("MplRef2",)),
    Licence("Public-Domain", ("PublicDomain",)),
    Licence("All-Rights-Reserved", ("AllRights",)),
    *(Licence(name, ("Spdx" + re.sub("[^a-z0-9]", "", name.lower()),)) for name in SPDX),
)

#: Every pattern of SENTENCES needs one of these. None has white space or a mark in it, so that line breaks don't matter.
KEY_WORDS = ("licen", "permission", "copyright", "redistribut", "software", "program", "warrant", "domain", "reserved", "commons", "cc", "endorse", "origin", "liable")
#: Marks that normalised sentences lack.
MARKS = "\"'`“”‘’*;:"
#: A sentence ends at a mark that white space follows, or at an empty line.
SENTENCE_END = r"(?<=[.;:!?])\s+|\s*\n\s*\n\s*"


#: A line that names a licence by identifier is a sentence of its own.
SPDX_LINE = r"(?i)spdx-licen[sc]e-identifier:[ \t]*([a-z0-9.+-]+)"


def sentences_of(text: Column) -> Column:
    """Normalised sentences."""
    plain = F.regexp_replace(text, r"(?m)^[ \t]*(?://+|/\*+|\*+/?|#+|--+|;+|<!--|%+)", "")
    each = F.split(F.regexp_replace(plain, SPDX_LINE, "\n\nspdx-license-identifier-$1\n\n"), SENTENCE_END)

    def normal(s: Column) -> Column:
        s = F.regexp_replace(F.lower(s), f"[{MARKS}]+", "")
        return F.regexp_replace(F.btrim(F.regexp_replace(s, r"\s+", " ")), r"[ .!?,]+$", "")

    return F.filter(F.transform(each, normal), lambda s: s != "")


def identifier(sentence: Column, table: Sequence[Sentence]) -> Column:
    chain = F.lit(None).cast("string")
    for known in reversed(table):
        pattern = f"^(?:{known.pattern})"
        name = F.lit(known.name)
        if known.tail:
            found = F.regexp_extract(sentence, pattern, known.tail)
            name = F.concat(name, F.regexp_replace(found, "[^a-z0-9]", ""))
        chain = F.when(sentence.rlike(pattern), name).otherwise(chain)
    return chain


def licence_report(docs: DataFrame, sentences: Sequence[Sentence] = SENTENCES, licences: Sequence[Licence] = LICENCES) -> DataFrame:
    """Per document: doc_id, sentence identifiers in order, licences in order, and unmatched identifiers."""
    none = F.array().cast("array<string>")
    rows = docs.select("doc_id", "text", F.translate(F.lower("text"), MARKS, "").alias("small"))
    # Other tables of sentences may need other words.
    known = KEY_WORDS if tuple(sentences) == SENTENCES else ("",)

    def speaks(text: Column) -> Column:
        return reduce(or_, (F.contains(text, F.lit(word)) for word in known))

    rows = rows.select("doc_id", F.when(speaks(F.col("small")), sentences_of(F.col("text"))).otherwise(none).alias("cut"))
    speaking = F.filter("cut", speaks)
    rows = rows.select("doc_id", F.filter(F.transform(speaking, lambda s: identifier(s, sentences)), lambda i: i.isNotNull()).alias("sentence_ids"))
    # "<" and ">" close a licence's name, "," an identifier.
    read = F.concat(F.lit(","), F.array_join("sentence_ids", ",,"), F.lit(","))
    for known in licences:
        read = F.replace(read, F.lit("," + ",,".join(known.sentences) + ","), F.lit(f"<{known.name}>"))
    # Few texts have any identifier.
    rows = rows.withColumn("read", F.when(F.size("sentence_ids") > 0, read).otherwise(""))
    return rows.select(
        "doc_id",
        "sentence_ids",
        F.regexp_extract_all("read", F.lit("<([^>]+)>"), 1).alias("licences"),
        F.regexp_extract_all("read", F.lit(",([A-Za-z0-9]+),"), 1).alias("unmatched"),
    )


def digest(report: DataFrame) -> DataFrame:
    """The report with its lists as text."""
    names = F.array_join(F.array_sort(F.array_distinct("licences")), "+")
    return report.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"),
        names.alias("expression"),
        F.array_join("unmatched", ",").alias("unmatched"),
    )
