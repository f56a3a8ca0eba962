"""Licences by recognition of their sentences.

A text is cut into sentences; each is normalised (lower case, everything but letters, digits and plus signs is one space)
and looked up among known licence sentences, which gives its identifier. Line ends and colons may end a sentence or stand
inside one: of the known sentences from one such place to another, the longest counts. The identifiers of a text, in order, are then matched against ordered rules: a rule is a sequence
of identifiers, and what it matches is taken out before the next rule looks, so the longest and most specific rules come
first. All of it works on the row at hand: no shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BREAK = "[.!?;]\\s+|\\n[\\s*#/]*\\n"  # a line of comment marks is blank
HARD, SOFT = "\x01", "\x02"  # no sentence goes over a hard break; line ends and colons are soft

# Published licence sentences, as normalised, by identifier.
SENTENCES = {
    "mit_name": ["released under the mit license", "licensed under the mit license", "mit license", "the mit license", "this project is licensed under the mit license", "license mit", "spdx license identifier mit"],
    "mit_grant": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"],
    "mit_notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "as_is_mit": ["the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "no_liability_mit": ["in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "apache2_name": ["licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license", "released under the apache license version 2 0", "apache license version 2 0", "license apache 2 0", "spdx license identifier apache 2 0"],
    "apache2_use": ["you may not use this file except in compliance with the license"],
    "apache2_copy": ["you may obtain a copy of the license at"],
    "apache2_as_is": ["unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "apache2_see": ["see the license for the specific language governing permissions and limitations under the license"],
    "gpl3_name": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3", "released under the gnu general public license version 3", "gnu general public license version 3", "spdx license identifier gpl 3 0 only", "spdx license identifier gpl 3 0 or later"],
    "gpl2_name": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2", "gnu general public license version 2", "spdx license identifier gpl 2 0 only", "spdx license identifier gpl 2 0 or later"],
    "gpl_free": ["this program is free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"],
    "gpl3_terms": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"],
    "gpl2_terms": ["you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"],
    "gpl3_either": ["either version 3 of the license or at your option any later version"],
    "gpl2_either": ["either version 2 of the license or at your option any later version"],
    "gpl_hope": ["this program is distributed in the hope that it will be useful but without any warranty", "without even the implied warranty of merchantability or fitness for a particular purpose"],
    "gpl_see": ["see the gnu general public license for more details"],
    "lgpl21_name": ["licensed under the gnu lesser general public license version 2 1", "gnu lesser general public license version 2 1", "spdx license identifier lgpl 2 1 only"],
    "lgpl3_name": ["licensed under the gnu lesser general public license version 3", "gnu lesser general public license version 3", "spdx license identifier lgpl 3 0 only"],
    "agpl3_name": ["licensed under the gnu affero general public license version 3", "gnu affero general public license version 3", "spdx license identifier agpl 3 0 only"],
    "mpl2_name": ["this source code form is subject to the terms of the mozilla public license v 2 0", "licensed under the mozilla public license version 2 0", "mozilla public license version 2 0", "spdx license identifier mpl 2 0"],
    "mpl2_copy": ["if a copy of the mpl was not distributed with this file you can obtain one at"],
    "bsd_grant": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "bsd_source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd_binary": ["redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd_name": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "bsd2_name": ["licensed under the bsd 2 clause license", "bsd 2 clause license", "spdx license identifier bsd 2 clause"],
    "bsd3_name": ["licensed under the bsd 3 clause license", "bsd 3 clause license", "spdx license identifier bsd 3 clause"],
    "isc_name": ["licensed under the isc license", "isc license", "spdx license identifier isc"],
    "isc_grant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"],
    "ccby4_name": ["licensed under cc by 4 0", "this work is licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license", "spdx license identifier cc by 4 0"],
    "ccbysa4_name": ["licensed under cc by sa 4 0", "this work is licensed under cc by sa 4 0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "spdx license identifier cc by sa 4 0"],
    "ccbync4_name": ["licensed under cc by nc 4 0", "this work is licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "spdx license identifier cc by nc 4 0"],
    "ccbynd4_name": ["licensed under cc by nd 4 0", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", "spdx license identifier cc by nd 4 0"],
    "cc0_name": ["licensed under cc0 1 0", "released under cc0 1 0", "cc0 1 0 universal", "spdx license identifier cc0 1 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain", "released into the public domain", "spdx license identifier unlicense"],
    "all_rights": ["all rights reserved"],
}
# Licence and the sequence of identifiers that states it, most specific first.
RULES = [
    ("MIT", ["mit_name", "mit_grant", "mit_notice", "as_is_mit", "no_liability_mit"]), ("MIT", ["mit_grant", "mit_notice", "as_is_mit", "no_liability_mit"]),
    ("Apache-2.0", ["apache2_name", "apache2_use", "apache2_copy", "apache2_as_is", "apache2_see"]),
    ("BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_name"]), ("BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl3_terms", "gpl_hope", "gpl_hope", "gpl_see"]), ("GPL-2.0-or-later", ["gpl_free", "gpl2_terms", "gpl_hope", "gpl_hope", "gpl_see"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl3_terms"]), ("GPL-2.0-or-later", ["gpl_free", "gpl2_terms"]),
    ("GPL-3.0-or-later", ["gpl_free", "gpl3_either"]), ("GPL-2.0-or-later", ["gpl_free", "gpl2_either"]),
    ("MPL-2.0", ["mpl2_name", "mpl2_copy"]), ("ISC", ["isc_name", "isc_grant"]), ("ISC", ["isc_grant"]), ("MIT", ["mit_name"]), ("Apache-2.0", ["apache2_name"]),
    ("GPL-3.0", ["gpl3_name"]), ("GPL-2.0", ["gpl2_name"]), ("LGPL-2.1", ["lgpl21_name"]), ("LGPL-3.0", ["lgpl3_name"]), ("AGPL-3.0", ["agpl3_name"]), ("MPL-2.0", ["mpl2_name"]),
    ("BSD-2-Clause", ["bsd2_name"]), ("BSD-3-Clause", ["bsd3_name"]), ("ISC", ["isc_name"]), ("CC-BY-SA-4.0", ["ccbysa4_name"]), ("CC-BY-NC-4.0", ["ccbync4_name"]),
    ("CC-BY-ND-4.0", ["ccbynd4_name"]), ("CC-BY-4.0", ["ccby4_name"]), ("CC0-1.0", ["cc0_name"]), ("Unlicense", ["unlicense"]),
]
# Every known sentence holds one of these, so a text without them has no known sentence.
ANCHORS = ("licen", "permission", "warrant", "redistribut", "mpl", "liable", "copyright", "rights", "cc0", "public domain", "free software")


def pattern(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def recognised(text: Column, sentences: dict[str, list[str]]) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    known = {s: i for i, every in sentences.items() for s in every}
    names = list(known)
    table = F.map_from_arrays(F.array(*[F.lit(s) for s in names]), F.array(*[F.lit(known[s]) for s in names]))
    runs = "|".join(n.replace("+", "\\+").replace(" ", f"[ {SOFT}]+") for n in sorted(names, key=len, reverse=True))
    marked = F.concat(F.lit(HARD), F.regexp_replace(F.translate(F.lower(text), HARD + SOFT, "  "), BREAK, HARD), F.lit(HARD))
    marked = F.regexp_replace(F.regexp_replace(marked, ":\\s+|\\n", SOFT), f"[^a-z0-9+{HARD}{SOFT}]+", " ")
    marked = F.regexp_replace(marked, f" ?([{HARD}{SOFT}]) ?", "$1")
    met = F.regexp_extract_all(marked, F.lit(f"(?<=[{HARD}{SOFT}])(?:{runs})(?=[{HARD}{SOFT}])"), F.lit(0))
    return F.transform(met, lambda s: table[F.regexp_replace(s, f"[ {SOFT}]+", " ")])


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, list[str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES,
           anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """(doc_id, sentences array, licenses array, unmatched long) of every row.

    sentences: identifiers in order; licenses: those whose rules match, each once, in order of the rules; unmatched: the
    identifiers that no rule took. Null and empty texts have none. Extra columns are ignored; an empty table gives an
    empty one.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    may = text.rlike("(?i)" + "|".join(a.replace(" ", "[^A-Za-z0-9+]+") for a in anchors))
    ids = F.when(may, recognised(text, sentences)).otherwise(F.array().cast("array<string>"))
    now = docs.select(F.col(f"`{id_col}`").alias("doc_id"), ids.alias("sentences"))
    every = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(pattern(i)).alias("p")) for name, i in rules])

    def rule(acc: Column, r: Column) -> Column:
        hit = F.contains(acc["left"], r["p"])
        return F.struct(F.when(hit, F.replace(acc["left"], r["p"], F.lit("#"))).otherwise(acc["left"]).alias("left"),
                        F.when(hit, F.concat(acc["found"], F.array(r["name"]))).otherwise(acc["found"]).alias("found"))
    first = F.struct(F.array_join(F.transform("sentences", lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "").alias("left"), F.array().cast("array<string>").alias("found"))
    none = F.struct(F.lit("").alias("left"), F.array().cast("array<string>").alias("found"))
    now = now.select("doc_id", "sentences", F.when(F.size("sentences") > 0, F.aggregate(every, first, rule)).otherwise(none).alias("r"))
    return now.select("doc_id", "sentences", F.array_distinct("r.found").alias("licenses"), F.regexp_count("r.left", F.lit("<")).cast("long").alias("unmatched"))
