"""Operator 5 [native]: licence scan by sentence rules.

Texts are split into sentences, sentences normalised (lower case, runs of other
characters than letters and digits are one space) and mapped to the identifiers of
known licence sentences; the sequence of identifiers is matched against ordered
rules. A known sentence may also begin or end at a line border: a line, or a run of
lines, inside a sentence counts when it is a known sentence by itself. Between two sentences of a rule other known sentences may stand, unknown
ones too, but not a sentence of the same rule out of order.

All of it is row-local column expressions: no shuffle, no Python. A first look
(``HINT``) passes texts that can't hold a known sentence; every known sentence
matches it, so the result is the same without it.

Defined cases: null and empty texts have no sentences and no licence; repeated rows
are judged alike; extra columns are ignored; an empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences and their identifiers.
SENTENCES = {
    "apache_short": "licensed under the apache license version 2 0",
    "apache_under": "licensed under the apache license version 2 0 the license",
    "apache_comply": "you may not use this file except in compliance with the license",
    "apache_copy": "you may obtain a copy of the license at",
    "apache_asis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache_see": "see the license for the specific language governing permissions and limitations under the license",
    "mit_short": "released under the mit license",
    "mit_licensed": "licensed under the mit license",
    "mit_grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit_notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit_asis": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3_short": "this work is licensed under the gnu general public license version 3",
    "gpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl_warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl_received": "you should have received a copy of the gnu general public license along with this program",
    "bsd_redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd_source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd_binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd_names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc_by_nc_short": "licensed under cc by nc 4 0",
    "cc_by_short": "licensed under cc by 4 0",
    "cc_by_sa_short": "licensed under cc by sa 4 0",
    "mpl_short": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "bsd_disclaimer": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "lgpl21_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "lgpl3_free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "lgpl_warranty": "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl_received": "you should have received a copy of the gnu lesser general public license along with this library",
    "agpl_free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl_received": "you should have received a copy of the gnu affero general public license along with this program",
    "isc_grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc_asis": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "epl_short": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "mpl_copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "unlicense_free": "this is free and unencumbered software released into the public domain",
    "unlicense_anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "boost_short": "distributed under the boost software license version 1 0",
    "boost_grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "cc0_short": "licensed under cc0 1 0",
    "reserved": "all rights reserved",
}
# Licence, category and the ordered sentences of each rule.
RULES = [
    ("Apache-2.0", "permissive", ["apache_short"]),
    ("Apache-2.0", "permissive", ["apache_under", "apache_comply", "apache_copy", "apache_asis", "apache_see"]),
    ("MIT", "permissive", ["mit_short"]),
    ("MIT", "permissive", ["mit_licensed"]),
    ("MIT", "permissive", ["mit_grant", "mit_notice", "mit_asis"]),
    ("GPL-3.0", "copyleft", ["gpl3_short"]),
    ("GPL-3.0-or-later", "copyleft", ["gpl_free", "gpl_warranty", "gpl_received"]),
    ("GPL-2.0-or-later", "copyleft", ["gpl2_free", "gpl_warranty", "gpl_received"]),
    ("BSD-3-Clause", "permissive", ["bsd_redistribution", "bsd_source", "bsd_binary", "bsd_names"]),
    ("BSD-2-Clause", "permissive", ["bsd_redistribution", "bsd_source", "bsd_binary"]),
    ("CC-BY-NC-4.0", "restricted", ["cc_by_nc_short"]),
    ("CC-BY-4.0", "permissive", ["cc_by_short"]),
    ("CC-BY-SA-4.0", "copyleft", ["cc_by_sa_short"]),
    ("MPL-2.0", "copyleft", ["mpl_short"]),
    ("LGPL-2.1-or-later", "copyleft", ["lgpl21_free", "lgpl_warranty", "lgpl_received"]),
    ("LGPL-3.0-or-later", "copyleft", ["lgpl3_free", "lgpl_warranty", "lgpl_received"]),
    ("AGPL-3.0-or-later", "copyleft", ["agpl_free", "gpl_warranty", "agpl_received"]),
    ("ISC", "permissive", ["isc_grant", "isc_asis"]),
    ("EPL-2.0", "copyleft", ["epl_short"]),
    ("Unlicense", "permissive", ["unlicense_free", "unlicense_anyone"]),
    ("BSL-1.0", "permissive", ["boost_short"]),
    ("BSL-1.0", "permissive", ["boost_grant"]),
    ("CC0-1.0", "permissive", ["cc0_short"]),
    ("All-Rights-Reserved", "restricted", ["reserved"]),
]
RESERVED = "All-Rights-Reserved"
# Each licence by its identifier line, too.
for _licence, _kind in sorted({(x, c) for x, c, _ in RULES if x != RESERVED} | {("GPL-2.0-only", "copyleft"), ("GPL-3.0-only", "copyleft")}):
    _name = _licence.lower().replace("-", " ").replace(".", " ")
    SENTENCES["spdx_" + _name.replace(" ", "_")] = "spdx license identifier " + _name
    RULES.append((_licence, _kind, ["spdx_" + _name.replace(" ", "_")]))
HINT = "(?i)licen[sc]e|distribut|reserved|warrant|permission|copyright|public domain"
#: A sentence ends after its mark and white space, or at a blank line. Other line breaks,
#: colons and semicolons are borders too, but a known sentence may run over them.
END, PAUSE = r"([.!?])\s+|\n\s*\n", r"([:;])\s+"
_GAP = r"[ \n\r\u0002]+"
#: A known sentence from border to border, the longest first, in a normalised text that
#: has only letters, digits, spaces, line breaks and the marks of END and PAUSE.
KNOWN = (r"(?<=[\u0001\u0002\n\r] ?)(?:" + "|".join(s.replace(" ", _GAP) for s in sorted(SENTENCES.values(), key=len, reverse=True))
         + r")(?= ?[\u0001\u0002\n\r])")


def rule_pattern(names: list[str]) -> str:
    """Regular expression of a rule over ``|id|id|`` sequences. The gap is possessive (it
    never holds a sentence of the rule), so it takes no stack however long it is."""
    own = "|".join(names)
    gap = rf"(?:\|(?!(?:{own})\|)[a-z0-9_]+(?=\|))*+"
    return gap.join(rf"\|{n}(?=\|)" for n in names)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, sentence_ids (in order, ``|``-separated),
    n_known, licences (sorted, ``,``-separated), category (the strictest)."""
    text = F.col("text").cast("string")
    marked = F.concat(F.lit("\u0001"), F.regexp_replace(F.regexp_replace(text, END, "$1\u0001"), PAUSE, "$1\u0002"), F.lit("\u0001"))
    plain = F.regexp_replace(F.lower(marked), r"[^a-z0-9\n\r\u0001\u0002]+", " ")
    sentences = F.transform(F.regexp_extract_all(plain, F.lit(KNOWN), F.lit(0)), lambda s: F.regexp_replace(s, _GAP, " "))
    known = F.array(*[F.lit(s) for s in SENTENCES.values()])
    names = F.array(*[F.lit(n) for n in SENTENCES])
    ids = F.transform(sentences, lambda s: F.get(names, F.array_position(known, s).cast("int") - 1))
    df = docs.select("doc_id", F.when(text.rlike(HINT), ids).alias("ids"))
    df = df.select("doc_id", F.coalesce("ids", F.array().cast("array<string>")).alias("ids"))
    df = df.withColumn("seq", F.concat(F.lit("|"), F.array_join(F.array_compact("ids"), "|"), F.lit("|")))
    found = [F.when(F.col("seq").rlike(rule_pattern(names_)), F.lit(licence)) for licence, _, names_ in RULES]
    full = F.array_compact(F.array(*found))
    # A three-clause text also matches the two-clause rule; the longer rule holds.
    full = F.when(F.array_contains(full, "BSD-3-Clause"), F.array_remove(full, "BSD-2-Clause")).otherwise(full)
    # Next to a whole licence the reservation of rights is part of its copyright line.
    whole = F.array_compact(F.array(*[hit for hit, (_, _, n) in zip(found, RULES) if len(n) > 1]))
    full = F.when(F.size(whole) > 0, F.array_remove(full, RESERVED)).otherwise(full)
    kinds = {k: F.array(*[F.lit(x) for x in sorted({lic for lic, c, _ in RULES if c == k})]) for k in ("restricted", "copyleft", "permissive")}
    df = df.withColumn("found", F.sort_array(F.array_distinct(full)))
    granted = F.when(F.size("found") > 1, F.array_remove("found", RESERVED)).otherwise(F.col("found"))
    category = F.coalesce(*[F.when(F.arrays_overlap(granted, v), F.lit(k)) for k, v in kinds.items()], F.lit("none"))
    return df.select("doc_id", F.array_join("ids", "|").alias("sentence_ids"), F.size("ids").cast("long").alias("n_known"),
                     F.array_join("found", ",").alias("licences"), category.alias("category"))
