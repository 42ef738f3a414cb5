"""Licence recognition by sentence rules, in DataFrame functions only.

Each text is cut into sentences, each sentence normalised (lower case, runs of other characters than letters and
digits as one space, which takes comment marks off) and looked up among the known licence sentences, by itself and
joined with those after it up to a blank line, since licences are wrapped. This gives the text's sequence of sentence
identifiers. Licence rules, tried in order, are sequences of identifiers; a rule matches where its identifiers follow
each other in the text's sequence (licence sentences only: other sentences between them are passed over). What an
earlier rule matched is taken out before the next rule is tried, so that a part of a licence isn't reported again.

Defined results: a null or empty text has no sentences and no licences; each row gets a row, repeated or null ids
too; an empty table gives no rows; other columns of the input aren't returned. Nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known licence sentences by identifier.
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-basis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "mit-short": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-nc4": "Licensed under CC BY-NC 4.0.",
    "cc-by4": "Licensed under CC BY 4.0.",
    "cc-by-sa4": "Licensed under CC BY-SA 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "reserved": "All rights reserved.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "lgpl-details": "See the GNU Lesser General Public License for more details.",
    "agpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl-details": "See the GNU Affero General Public License for more details.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "unlicense-free": "This is free and unencumbered software released into the public domain.",
    "boost-short": "Distributed under the Boost Software License, Version 1.0.",
    "cc-by-nd4": "Licensed under CC BY-ND 4.0.",
    "cc-by-nc-sa4": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd4": "Licensed under CC BY-NC-ND 4.0.",
    "cc-by4-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa4-long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc4-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}

#: Licences stated by a line with their short name.
SHORT_NAMES = ("0BSD", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib")
SENTENCES |= {f"spdx-{name}": f"SPDX-License-Identifier: {name}" for name in SHORT_NAMES}

#: Ordered rules: licence and the sequence of identifiers that states it. Longer statements come first.
RULES = (
    ("Apache-2.0", ("apache-grant", "apache-copy", "apache-basis", "apache-see")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-details")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope", "lgpl-details")),
    ("AGPL-3.0-or-later", ("agpl-free", "gpl-hope", "agpl-details")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("Apache-2.0", ("apache-grant",)),
    ("Apache-2.0", ("apache-short",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0", ("gpl3-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4",)),
    ("CC-BY-4.0", ("cc-by4",)),
    ("CC0-1.0", ("cc0",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("MPL-2.0", ("mpl2-subject", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-subject",)),
    ("Zlib", ("zlib-as-is", "zlib-grant")),
    ("Zlib", ("zlib-grant",)),
    ("Unlicense", ("unlicense-free",)),
    ("BSL-1.0", ("boost-short",)),
    ("CC-BY-ND-4.0", ("cc-by-nd4",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa4",)),
    ("CC-BY-NC-ND-4.0", ("cc-by-nc-nd4",)),
    ("CC-BY-4.0", ("cc-by4-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa4-long",)),
    ("CC-BY-NC-4.0", ("cc-by-nc4-long",)),
    *((name, (f"spdx-{name}",)) for name in SHORT_NAMES),
    ("all-rights-reserved", ("reserved",)),
)


def normalised(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


#: Identifiers by normalised sentence.
KNOWN = {normalised(v): k for k, v in SENTENCES.items()}


def sentences(text: Column) -> Column:
    """Sentences end at a line's end, and at ``.``, ``!``, ``?`` or ``:`` before blanks."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "([.!?:])[ \\t]+", "$1\n"), "\n")


def identifiers(text: Column, known: dict[str, str] | None = None) -> Column:
    """The known sentences of a text, by identifier, in order; of those that begin at one place the longest.

    The normalised pieces that ``sentences`` cuts are put between bars. A known sentence begins and ends at a bar and
    may have one bar in place of any blank, so that it is found when wrapped, but not across a blank line.
    """
    known = KNOWN if known is None else known
    if not known:
        return F.array().cast("array<string>")
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    # no empty piece where a line ends in blanks: that is no blank line
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), "([.!?:])[ \\t]+(?=[^ \\t\r\n])", "$1\n")
    plain = F.regexp_replace(F.translate(cut, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9\n]+", " ")
    pieces = F.concat(F.lit("|"), F.regexp_replace(plain, "^ | $| ?\n ?", "|"), F.lit("|"))
    any_known = "(?<=\\|)(?:" + "|".join(k.replace(" ", "[ |]") for k in sorted(known, key=len, reverse=True)) + ")(?=\\|)"
    return F.transform(F.regexp_extract_all(pieces, F.lit(any_known), F.lit(0)), lambda s: F.element_at(table, F.translate(s, "|", " ")))


def licences(ids: Column, rules=RULES) -> Column:
    """Distinct licences of a sequence of identifiers, sorted, by the ordered rules.

    The sequence is a string, each identifier between bars; a rule is a string to look for and to take out (a bar
    stays, doubled, so that parts on both sides don't join).
    """
    rest = F.concat(F.lit("|"), F.concat_ws("||", ids), F.lit("|"))
    state = F.struct(rest.alias("rest"), F.array().cast("array<string>").alias("found"))
    listed = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("|" + "||".join(seq) + "|").alias("seq")) for name, seq in rules])
    end = F.aggregate(listed, state, lambda a, r: F.struct(F.replace(a["rest"], r["seq"], F.lit("#")).alias("rest"), F.when(F.contains(a["rest"], r["seq"]), F.array_append(a["found"], r["name"])).otherwise(a["found"]).alias("found")))
    return F.sort_array(F.array_distinct(end["found"]))


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_known, sentence_ids and licences (both as text, joined by ``,``) for every row of ``docs``."""
    text = F.col("text")
    step = docs.select("doc_id", F.size(sentences(text)).cast("long").alias("n_sentences"), identifiers(text).alias("ids"))
    some = F.size("ids") > 0
    return step.select(
        "doc_id", "n_sentences", F.size("ids").cast("long").alias("n_known"), F.concat_ws(",", "ids").alias("sentence_ids"),
        F.when(some, F.concat_ws(",", licences(F.col("ids")))).otherwise("").alias("licences"),
    )


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """Pieces between doubled bars, so that each match takes one bar of its own on either side."""
    known = ", ".join(f"('{k}', '{v}')" for k, v in KNOWN.items())
    pattern = "\\|(?:" + "|".join(k.replace(" ", "(?: |\\|\\|)") for k in sorted(KNOWN, key=len, reverse=True)) + ")\\|"
    steps, last = [], "s"
    for i, (name, seq) in enumerate(RULES):
        key = "|" + "||".join(seq) + "|"
        steps.append(f"r{i} AS (SELECT rid, doc_id, n_sentences, n_known, sentence_ids, replace(rest, '{key}', '#') AS rest, CASE WHEN contains(rest, '{key}') THEN list_append(found, '{name}') ELSE found END AS found FROM {last})")
        last = f"r{i}"
    return rf"""
    WITH k(plain, id) AS (VALUES {known}),
    d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    n AS (SELECT rid, doc_id, len(string_split(regexp_replace(text, '([.!?:])[ \t]+', '\1' || chr(10), 'g'), chr(10)))::BIGINT AS n_sentences, regexp_replace(regexp_replace(text, '[ \t]+([\r\n]|$)', '\1', 'g'), '([.!?:])[ \t]+', '\1' || chr(10), 'g') AS cut FROM d),
    l AS (SELECT rid, doc_id, n_sentences, regexp_replace(translate(cut, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9\n]+', ' ', 'g') AS plain FROM n),
    b AS (SELECT rid, doc_id, n_sentences, regexp_extract_all('||' || regexp_replace(plain, '^ | $| ?\n ?', '||', 'g') || '||', '{pattern}') AS found FROM l),
    u AS (SELECT rid, unnest(found) AS found, unnest(range(len(found))) AS i FROM b),
    h AS (SELECT rid, list(k.id ORDER BY i) AS ids FROM u JOIN k ON k.plain = replace(found[2:-2], '||', ' ') GROUP BY rid),
    s AS (SELECT rid, doc_id, n_sentences, coalesce(len(ids), 0)::BIGINT AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids, '|' || coalesce(array_to_string(ids, '||'), '') || '|' AS rest, []::VARCHAR[] AS found FROM b LEFT JOIN h USING (rid)),
    {", ".join(steps)}
    SELECT doc_id, n_sentences, n_known, sentence_ids, coalesce(array_to_string(list_sort(list_distinct(found)), ','), '') AS licences FROM {last}
    """


SQL = {"op8_license_scan": _sql()}
