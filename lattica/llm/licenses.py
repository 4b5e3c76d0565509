"""License scans by sentences and rules: normalised sentences are mapped to the names of known license sentences, and the sequence of names is
matched against ordered rules.

A text is cut into sentences, and a sentence becomes lower-case ASCII words. A sentence that is, as a whole, one of KNOWN has its name.
Another one has the name of the first of MENTIONS that is found in it: short mentions, license sentences in other wordings, and those
that share their sentence with other text. Rules are tried in order; each that finds its names side by side records its license and
takes them out of the sequence, so that a long form is not reported again by the short form inside it. Every text is scanned whole, and
everything is one expression on one row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What belongs together although a sign or a blank line stands between: a tag and its value, a header and its version, a text and its address.
JOINED = [(r"(?i)(SPDX-License-Identifier)[ \t]*:[\t-\r ]*", 1), (r"(?i)(license[ \t]+at)[ \t\r]*:?[\t-\r ]+", 1), (r"(?i);([^A-Za-z0-9_]+either[\t-\r ]+version)", 1)]
#: Ends of sentences: . ! ? ; : before white space, and blank lines.
CUT = r"([.!?;:])[\t-\r ]+|\n[ \t\r]*\n"
#: What becomes of a sentence's characters, in this order: other than words and their signs, signs alone, signs at the ends.
PLAIN = [(r"[^A-Za-z0-9.+/-]+", " "), (r" [./+-]+ ", " "), (r"^[ ./+-]+|[ ./+-]+$", "")]


def normal(sentence: str) -> str:
    for pattern, by in PLAIN:
        sentence = re.sub(pattern, by, sentence)
    return sentence.lower()


# Sentences of well-known licenses and their headers, in their usual wording.
KNOWN = {
    normal(text): name
    for name, text in [
        ("MitGrant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
        ("MitNotice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
        ("MitAsIs", 'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement'),
        ("MitLiability", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"),
        ("IscGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
        ("IscAsIs", 'The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness'),
        ("BsdGrant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
        ("BsdSource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
        ("BsdBinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
        ("BsdEndorse", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
        ("BsdAsIs", 'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed'),
        ("GplRedistribute3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
        ("GplRedistribute2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
        ("GplNoWarranty", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
        ("Gpl3Ref", "This work is licensed under the GNU General Public License, version 3"),
        ("Apache2Ref", 'Licensed under the Apache License, Version 2.0 (the "License")'), ("Apache2Ref", "Licensed under the Apache License, Version 2.0"),
        ("ApacheUse", "you may not use this file except in compliance with the License"),
        ("ApacheCopy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
        ("ApacheAsIs", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
        ("MitRef", "Released under the MIT License"), ("MitRef", "Licensed under the MIT License"), ("MitRef", "The MIT License (MIT)"), ("MitRef", "MIT License"),
        ("UnlicenseText", "This is free and unencumbered software released into the public domain"),
        ("CcByNcRef", "Licensed under CC BY-NC 4.0"), ("CcByRef", "Licensed under CC BY 4.0"), ("CcBySaRef", "Licensed under CC BY-SA 4.0"),
        ("AllRights", "All rights reserved"),
    ]
}

# Mentions of licenses, and of their sentences in other wordings, after normalisation; the more specific first.
MENTIONS = [
    ("SpdxAgpl3", r"spdx-license-identifier agpl-3.0"),
    ("SpdxLgpl3", r"spdx-license-identifier lgpl-3.0"),
    ("SpdxLgpl21", r"spdx-license-identifier lgpl-2.1"),
    ("SpdxGpl3", r"spdx-license-identifier gpl-3.0"),
    ("SpdxGpl2", r"spdx-license-identifier gpl-2.0"),
    ("SpdxApache2", r"spdx-license-identifier apache-2.0"),
    ("SpdxMit", r"spdx-license-identifier mit"),
    ("SpdxBsd3", r"spdx-license-identifier bsd-3-clause"),
    ("SpdxBsd2", r"spdx-license-identifier bsd-2-clause"),
    ("SpdxMpl2", r"spdx-license-identifier mpl-2.0"),
    ("SpdxIsc", r"spdx-license-identifier isc"),
    ("SpdxCc0", r"spdx-license-identifier cc0-1.0"),
    ("MitGrant", r"permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("MitNotice", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("MitAsIs", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"),
    ("MitLiability", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("IscGrant", r"permission to use copy modify and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("IscAsIs", r"the software is provided as is and the author disclaims all warranties"),
    ("BsdGrant", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("BsdSource", r"redistributions of source code must retain the above copyright notice"),
    ("BsdBinary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BsdEndorse", r"neither the name of .* may be used to endorse or promote products"),
    ("BsdAsIs", r"this software is provided by the copyright holders and contributors as is"),
    ("GplRedistribute3", r"you can redistribute it and/or modify it under the terms of the gnu general public license .*version 3"),
    ("GplRedistribute2", r"you can redistribute it and/or modify it under the terms of the gnu general public license .*version 2"),
    ("GplNoWarranty", r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("Agpl3Ref", r"gnu affero general public license( v| version |.*version )?3|\bagpl ?v?-?3"),
    ("Lgpl3Ref", r"gnu lesser general public license.* v(ersion )?3|\blgpl ?v?-?3"),
    ("Lgpl21Ref", r"gnu lesser general public license.* v(ersion )?2|\blgpl ?v?-?2"),
    ("Gpl3Ref", r"gnu general public license.* v(ersion )?3|\bgpl ?v?-?3"),
    ("Gpl2Ref", r"gnu general public license.* v(ersion )?2|\bgpl ?v?-?2"),
    ("GplRef", r"gnu general public license"),
    ("Apache2Ref", r"(under|apache) .*apache license.*2|apache license v(ersion )?2|apache-2.0 license"),
    ("ApacheUse", r"you may not use this file except in compliance with the license"),
    ("ApacheCopy", r"you may obtain a copy of the license at .*apache"),
    ("ApacheAsIs", r"distributed under the license is distributed on an as is basis"),
    ("MitRef", r"(under|of) the (terms of the )?mit license|\bmit licensed|^mit license$|^the mit license"),
    ("Bsd3Ref", r"(3-clause|three-clause|new|revised|modified) bsd licen[cs]e|bsd 3-clause"),
    ("Bsd2Ref", r"(2-clause|two-clause|simplified) bsd licen[cs]e|bsd 2-clause"),
    ("BsdRef", r"under (the|a) bsd(-style)? licen[cs]e"),
    ("IscRef", r"(under|of) the isc license"),
    ("Mpl2Ref", r"mozilla public license.*2"),
    ("Epl2Ref", r"eclipse public license.*2"),
    ("BoostRef", r"boost software license"),
    ("ZlibRef", r"under the zlib license"),
    ("UnlicenseText", r"this is free and unencumbered software released into the public domain"),
    ("Cc0Ref", r"\bcc0\b|creative commons zero"),
    ("CcByNcSaRef", r"cc by-nc-sa|attribution-noncommercial-sharealike"),
    ("CcByNcNdRef", r"cc by-nc-nd|attribution-noncommercial-noderiv"),
    ("CcByNcRef", r"cc by-nc\b|attribution-noncommercial"),
    ("CcBySaRef", r"cc by-sa|attribution-sharealike"),
    ("CcByNdRef", r"cc by-nd|attribution-noderiv"),
    ("CcByRef", r"\bcc by\b|creative commons attribution"),
    ("PublicDomain", r"(is|into|in) the public domain"),
    ("AllRights", r"all rights reserved"),
    ("Copyright", r"^(portions )?copyright\b"),
    ("OtherLicense", r"licen[cs]ed? (under|terms)|under the .*licen[cs]e|(this|the) licen[cs]e"),
]

# Licenses by their SPDX names and the sentences that make them, the longest forms first.
RULES = [
    ("MIT", ["MitGrant", "MitNotice", "MitAsIs", "MitLiability"]), ("MIT", ["MitGrant", "MitNotice", "MitAsIs"]), ("MIT", ["MitGrant", "MitNotice"]),
    ("ISC", ["IscGrant", "IscAsIs"]), ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse", "BsdAsIs"]), ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs"]), ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
    ("Apache-2.0", ["Apache2Ref", "ApacheUse", "ApacheCopy", "ApacheAsIs"]), ("Apache-2.0", ["Apache2Ref", "ApacheUse", "ApacheCopy"]), ("Apache-2.0", ["Apache2Ref", "ApacheUse"]),
    ("GPL-3.0", ["GplRedistribute3", "GplNoWarranty"]), ("GPL-2.0", ["GplRedistribute2", "GplNoWarranty"]),
    ("AGPL-3.0", ["SpdxAgpl3"]), ("LGPL-3.0", ["SpdxLgpl3"]), ("LGPL-2.1", ["SpdxLgpl21"]), ("GPL-3.0", ["SpdxGpl3"]), ("GPL-2.0", ["SpdxGpl2"]), ("Apache-2.0", ["SpdxApache2"]), ("MIT", ["SpdxMit"]),
    ("BSD-3-Clause", ["SpdxBsd3"]), ("BSD-2-Clause", ["SpdxBsd2"]), ("MPL-2.0", ["SpdxMpl2"]), ("ISC", ["SpdxIsc"]), ("CC0-1.0", ["SpdxCc0"]),
    ("AGPL-3.0", ["Agpl3Ref"]), ("LGPL-3.0", ["Lgpl3Ref"]), ("LGPL-2.1", ["Lgpl21Ref"]), ("GPL-3.0", ["GplRedistribute3"]), ("GPL-3.0", ["Gpl3Ref"]), ("GPL-2.0", ["GplRedistribute2"]), ("GPL-2.0", ["Gpl2Ref"]), ("GPL", ["GplRef"]),
    ("Apache-2.0", ["Apache2Ref"]), ("MIT", ["MitRef"]), ("MIT", ["MitGrant"]), ("BSD-3-Clause", ["Bsd3Ref"]), ("BSD-2-Clause", ["Bsd2Ref"]), ("BSD", ["BsdGrant"]), ("BSD", ["BsdRef"]), ("ISC", ["IscGrant"]), ("ISC", ["IscRef"]),
    ("MPL-2.0", ["Mpl2Ref"]), ("EPL-2.0", ["Epl2Ref"]), ("BSL-1.0", ["BoostRef"]), ("Zlib", ["ZlibRef"]), ("Unlicense", ["UnlicenseText"]), ("CC0-1.0", ["Cc0Ref"]),
    ("CC-BY-NC-SA", ["CcByNcSaRef"]), ("CC-BY-NC-ND", ["CcByNcNdRef"]), ("CC-BY-NC", ["CcByNcRef"]), ("CC-BY-SA", ["CcBySaRef"]), ("CC-BY-ND", ["CcByNdRef"]), ("CC-BY", ["CcByRef"]),
    ("public-domain", ["PublicDomain"]), ("proprietary", ["Copyright", "AllRights"]), ("proprietary", ["AllRights"]), ("unknown", ["OtherLicense"]),
]


#: Words, one of which is in every sentence of KNOWN and in every match of MENTIONS (a test derives this from the patterns). Normalising joins no
#: words, so a text without them, in any case of letters, names no license; the SQL below looks at every text.
WORDS = ("licen", "gpl", "spdx", "permission", "copyright", "warrant", "liable", "redistribution", "endorse", "bsd", "cc", "commons", "attribution", "domain", "reserved", "unencumbered")


def _key(names: list[str]) -> str:
    return "".join(f"<{n}>" for n in names)


def sentences(text: Column) -> Column:
    """Array of normalised sentences: cut as JOINED and CUT say, then lower-case ASCII words; signs of comments are no words."""
    for pattern, group in JOINED:
        text = F.regexp_replace(text, pattern, f"${group} ")
    cut = F.split(F.regexp_replace(text, CUT, "$1\u0001"), "\u0001")

    def plain(s: Column) -> Column:
        for pattern, by in PLAIN:
            s = F.regexp_replace(s, pattern, by)
        return F.lower(s)

    return F.transform(cut, plain)


def _name(s: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    out = F.when(F.map_contains_key(known, s), known[s])
    for name, pattern in MENTIONS:
        out = out.when(s.rlike(pattern), name)
    return out


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sentence_ids (names of the recognised sentences in order), licenses (in the order of the rules, each once, comma-joined) and
    n_licenses for every row. Null and empty texts have none, texts may have any length, repeated rows are rows of their own, and an empty table gives
    an empty table; other columns are dropped. Of sentences that fit several mentions the first counts."""
    named = F.filter(F.transform(sentences(F.col(text)), _name), lambda n: n.isNotNull())
    low, some = F.lower(text), F.lit(False)
    for word in WORDS:
        some = some | F.contains(low, F.lit(word))
    rows = docs.select(F.col(key), F.coalesce(F.when(some, named), F.array().cast("array<string>")).alias("names"))
    ids = F.array_join("names", ",").alias("sentence_ids")
    rules = F.array(*[F.struct(F.lit(_key(names)).alias("names"), F.lit(name).alias("license")) for name, names in RULES])
    start = F.struct(F.array_join(F.transform("names", lambda n: F.concat(F.lit("<"), n, F.lit(">"))), "").alias("left"), F.array().cast("array<string>").alias("found"))
    step = lambda acc, r: F.when(F.contains(acc["left"], r["names"]), F.struct(F.replace(acc["left"], r["names"], F.lit("#")).alias("left"), F.array_append(acc["found"], r["license"]).alias("found"))).otherwise(acc)
    found = F.when(F.size("names") > 0, F.array_distinct(F.aggregate(rules, start, step, lambda acc: acc["found"]))).otherwise(F.array().cast("array<string>"))
    rows = rows.select(key, ids, found.alias("found"))
    return rows.select(key, F.coalesce("sentence_ids", F.lit("")).alias("sentence_ids"), F.array_join("found", ",").alias("licenses"), F.size("found").cast("long").alias("n_licenses"))


def duckdb_sql() -> str:
    """The same scan over `documents` in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    text, plain = "coalesce(text, '')", "s"
    for pattern, group in JOINED:
        text = f"regexp_replace({text}, {quote(pattern)}, '\\{group} ', 'g')"
    for pattern, by in PLAIN:
        plain = f"regexp_replace({plain}, {quote(pattern)}, {quote(by)}, 'g')"
    name = "CASE " + " ".join(f"WHEN s = {quote(k)} THEN {quote(n)}" for k, n in KNOWN.items()) + " " + " ".join(f"WHEN regexp_matches(s, {quote(p)}) THEN {quote(n)}" for n, p in MENTIONS) + " END"
    chain, left = [], "s0"
    for i, (_, names) in enumerate(RULES):
        chain.append(f"contains({left}, {quote(_key(names))}) AS f{i}, replace({left}, {quote(_key(names))}, '#') AS s{i + 1}")
        left = f"s{i + 1}"
    found = "list_filter([" + ", ".join(f"CASE WHEN f{i} THEN {quote(n)} END" for i, (n, _) in enumerate(RULES)) + "], lambda x: x IS NOT NULL)"
    steps = "a0 AS (SELECT doc_id, names, array_to_string(list_transform(names, lambda n: '<' || n || '>'), '') AS s0 FROM named)"
    for i, c in enumerate(chain):
        steps += f", a{i + 1} AS (SELECT *, {c} FROM a{i})"
    once = f"list_filter({found}, lambda x, i: list_position({found}, x) = i)"
    return f"""
        WITH cut AS (SELECT doc_id, list_transform(string_split(regexp_replace({text}, {quote(CUT)}, '\\1' || chr(1), 'g'), chr(1)), lambda s: lower({plain})) AS parts FROM documents),
             named AS (SELECT doc_id, list_filter(list_transform(parts, lambda s: {name}), lambda n: n IS NOT NULL) AS names FROM cut),
             {steps}
        SELECT doc_id, array_to_string(names, ',') AS sentence_ids, array_to_string({once}, ',') AS licenses, len({once}) AS n_licenses FROM a{len(chain)}"""
