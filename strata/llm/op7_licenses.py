"""License scans by sentence rules.

A text's sentences are normalised and looked up among known licence sentences;
the sequence of their identifiers is then matched against rules, in order
(German, Manabe and Inoue 2010, "A Sentence-Matching Method for Automatic
License Identification of Source Code Files").  DataFrame operations only.

A line break, a ';' or a ':' may end a sentence or lie within one, so texts are
cut there and a known sentence is one piece or several in a row.  The SQL looks
at single pieces, without the third BSD clause; it gives the same result where
no notice is wrapped and none has that clause.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

#: Known sentences, normalised: lower case, words of letters and digits with one blank between them.
SENTENCES = {
    "licensed under the apache license version 2 0": "Apache2",
    "licensed under the apache license version 2 0 the license": "Apache2",
    "you may not use this file except in compliance with the license": "ApacheComply",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsIs",
    "see the license for the specific language governing permissions and limitations under the license": "ApacheSee",
    "released under the mit license": "MITRef",
    "licensed under the mit license": "MITRef",
    "this project is licensed under the mit license": "MITRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MITGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MITNotice",
    "this work is licensed under the gnu general public license version 3": "GPL3",
    "licensed under the gnu general public license version 3": "GPL3",
    "licensed under the gnu general public license version 2": "GPL2",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "GPL3Plus",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "GPL2Plus",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "GPLNoWarranty",
    "see the gnu general public license for more details": "GPLSee",
    "you should have received a copy of the gnu general public license along with this program": "GPLCopy",
    "licensed under the gnu lesser general public license version 3": "LGPL3",
    "licensed under the gnu affero general public license version 3": "AGPL3",
    "licensed under cc by 4 0": "CCBY4",
    "licensed under cc by sa 4 0": "CCBYSA4",
    "licensed under cc by nc 4 0": "CCBYNC4",
    "this work is licensed under a creative commons attribution 4 0 international license": "CCBY4",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "CCBYSA4",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BSDGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BSDSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BSDBinary",
    "licensed under the bsd 3 clause license": "BSD3Ref",
    "licensed under the isc license": "ISCRef",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "ISCGrant",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "MPL2Copy",
}
#: Rules in the order they are tried: the licence and the identifiers that must follow each other.
RULES = [
    ("Apache-2.0", ["Apache2", "ApacheComply", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["Apache2", "ApacheComply"]),
    ("Apache-2.0", ["Apache2"]),
    ("MIT", ["MITGrant", "MITNotice"]),
    ("MIT", ["MITRef"]),
    ("GPL-3.0-or-later", ["GPL3Plus", "GPLNoWarranty", "GPLSee", "GPLCopy"]),
    ("GPL-3.0-or-later", ["GPL3Plus"]),
    ("GPL-2.0-or-later", ["GPL2Plus", "GPLNoWarranty", "GPLSee", "GPLCopy"]),
    ("GPL-2.0-or-later", ["GPL2Plus"]),
    ("GPL-3.0-only", ["GPL3"]),
    ("GPL-2.0-only", ["GPL2"]),
    ("LGPL-3.0-only", ["LGPL3"]),
    ("AGPL-3.0-only", ["AGPL3"]),
    ("CC-BY-4.0", ["CCBY4"]),
    ("CC-BY-SA-4.0", ["CCBYSA4"]),
    ("CC-BY-NC-4.0", ["CCBYNC4"]),
    ("BSD-2-Clause", ["BSDGrant", "BSDSource", "BSDBinary"]),
    ("BSD-3-Clause", ["BSD3Ref"]),
    ("ISC", ["ISCGrant"]),
    ("ISC", ["ISCRef"]),
    ("MPL-2.0", ["MPL2", "MPL2Copy"]),
    ("MPL-2.0", ["MPL2"]),
]
#: The third BSD clause names the holder of the copyright.
BSD_NAMES = "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
HOLDER = "neither the name of (.+) nor the names of its contributors"
HOLDER_CHARS = 200
#: Words of a sentence that is told even behind other words.
LONG_WORDS = 12
#: Further sentences of published licences, normalised as above.  The SQL does not look for them.
MORE = {
    BSD_NAMES: "BSDNames",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MITAsIs",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "MITLiability",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "BSDAsIs",
    "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage": "BSDLiability",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "ISCAsIs",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software": "ISCLiability",
    "distributed under the boost software license version 1 0": "BoostRef",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "BoostGrant",
    "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor": "BoostNotice",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "UnlicenseGrant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "EPL2",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution and is available at http www eclipse org legal epl v10 html": "EPL1",
    "this software is provided as is without any express or implied warranty": "ZlibAsIs",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "LGPL21Plus",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "LGPLNoWarranty",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "AGPL3Plus",
}
#: Licences that a tag line may name.
TAGS = ["Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "BSL-1.0", "MPL-2.0", "EPL-2.0", "Unlicense", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-or-later"]
KNOWN = SENTENCES | MORE | {" ".join(["spdx license identifier", *re.split("[^a-z0-9]+", t.lower())]): "Tag" + re.sub("[^A-Za-z0-9]", "", t) for t in TAGS}
#: Rules for them; a rule for a whole licence is tried before one for its first sentences.
BEFORE = {
    "MIT": [("MIT", ["MITGrant", "MITNotice", "MITAsIs", "MITLiability"])],
    "BSD-2-Clause": [
        ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDNames", "BSDAsIs", "BSDLiability"]),
        ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDNames"]),
        ("BSD-2-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDAsIs", "BSDLiability"])],
    "ISC": [("ISC", ["ISCGrant", "ISCAsIs", "ISCLiability"])],
}
AFTER = [
    ("BSL-1.0", ["BoostGrant", "BoostNotice"]),
    ("BSL-1.0", ["BoostRef"]),
    ("Unlicense", ["Unlicense", "UnlicenseGrant"]),
    ("Unlicense", ["Unlicense"]),
    ("EPL-2.0", ["EPL2"]),
    ("EPL-1.0", ["EPL1"]),
    ("Zlib", ["ZlibAsIs", "ZlibGrant"]),
    ("LGPL-2.1-or-later", ["LGPL21Plus", "LGPLNoWarranty"]),
    ("LGPL-2.1-or-later", ["LGPL21Plus"]),
    ("AGPL-3.0-or-later", ["AGPL3Plus"]),
    *((t, ["Tag" + re.sub("[^A-Za-z0-9]", "", t)]) for t in TAGS),
]
_firsts = {name: next(k for k, (x, _) in enumerate(RULES) if x == name) for name in BEFORE}
ALL_RULES = [r for k, rule in enumerate(RULES) for r in [*(BEFORE[rule[0]] if _firsts.get(rule[0]) == k else []), rule]] + AFTER
#: Every known sentence has one of these; a text without any is not cut into sentences.
MARKS = ("licen", "permi", "warrant", "mpl", "copyright", "liable", "unencumbered", "anyone is free")
BREAK = r"[.;:!?]+(\s+|$)|[\r\n]+"


def _pattern() -> str:
    """Known sentences as whole pieces, in which a '|' may stand for any blank; the longest is tried first.

    A long one may follow other words, such as a title or a copyright line that a lost line break joined to it.
    """
    gap = "[ |]"
    forms = [("" if len(s.split()) >= LONG_WORDS else r"(?<=\|)") + s.replace(" ", gap) for s in sorted(KNOWN, key=len, reverse=True)]
    holder = BSD_NAMES.replace(" ", gap).replace(gap.join(["of", "the", "copyright", "holder", "nor"]), f"of{gap}[a-z0-9 |]{{1,{HOLDER_CHARS}}}?{gap}nor")
    return rf"(?<=[ |])(?:{'|'.join([*forms, holder])})(?=\|)"


def _known(text: Column) -> Column:
    low = F.lower(text)
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains(low, F.lit(m))
    names = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    # pieces between '|', words between blanks
    lines = F.regexp_replace(F.regexp_replace(low, BREAK, "\n"), r"[^a-z0-9\n]+", " ")
    flat = F.concat(F.lit("|"), F.regexp_replace(lines, r" *\n[ \n]*", "|"), F.lit("|"))
    flat = F.regexp_replace(flat, r" *\|[ |]*", "|")
    found = F.regexp_extract_all(flat, F.lit(_pattern()), F.lit(0))
    plain = F.transform(found, lambda s: F.regexp_replace(F.translate(s, "|", " "), HOLDER, BSD_NAMES.split(" may ")[0]))
    return F.when(marked, F.transform(plain, lambda s: F.element_at(names, s)))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, sentences, licenses, unmatched for every row of docs (doc_id, text).

    sentences: identifiers in order, joined by commas; licenses: those whose
    rules matched, sorted, joined by commas; unmatched: identifiers left over.
    A rule takes every run of its identifiers before the next rule is tried.
    Null and empty texts have none.  Extra columns are ignored.
    """
    found = docs.select("doc_id", F.coalesce(_known(F.col("text")), F.array().cast("array<string>")).alias("ids"))
    rest = F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" "))
    out = found.withColumn("rest", F.when(F.size("ids") > 0, rest).otherwise(F.lit("")))
    hits = []
    for k, (name, ids) in enumerate(ALL_RULES):
        run = " " + "  ".join(ids) + " "
        out = out.withColumn(f"r{k}", F.contains("rest", F.lit(run))).withColumn("rest", F.replace(F.col("rest"), F.lit(run), F.lit("|")))
        hits.append(F.when(F.col(f"r{k}"), F.lit(name)))
    licenses = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*hits)))), ",")
    return out.select("doc_id", F.array_join("ids", ",").alias("sentences"), licenses.alias("licenses"), F.regexp_count("rest", F.lit("[A-Za-z0-9]+")).cast("int").alias("unmatched"))


def query(spark, sf_dir):
    return scanned(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    pairs = ",\n    ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    runs = [" " + "  ".join(ids) + " " for _, ids in RULES]
    steps = ["x0 AS (SELECT *, CASE WHEN ids = '' THEN '' ELSE ' ' || replace(ids, ',', '  ') || ' ' END AS rest FROM t)"]
    for k, run in enumerate(runs):
        steps.append(f"x{k + 1} AS (SELECT * REPLACE (replace(rest, '{run}', '|') AS rest), CASE WHEN contains(rest, '{run}') THEN '{RULES[k][0]}' END AS r{k} FROM x{k})")
    listed = ", ".join(f"r{k}" for k in range(len(runs)))
    return f"""
WITH names(sentence, id) AS (VALUES
    {pairs}),
d AS (SELECT row_number() OVER () AS rid, doc_id, lower(coalesce(text, '')) AS low FROM documents),
s AS (SELECT rid, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos
      FROM (SELECT rid, string_split_regex(low, '[.;:!?]+(\\s+|$)|[\\r\\n]+') AS parts FROM d)),
k AS (SELECT rid, pos, id FROM s JOIN names ON trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) = sentence),
t AS (SELECT d.doc_id, coalesce(string_agg(id, ',' ORDER BY pos), '') AS ids FROM d LEFT JOIN k USING (rid) GROUP BY d.rid, d.doc_id),
{', '.join(steps)}
SELECT doc_id, ids AS sentences,
       array_to_string(list_sort(list_distinct(list_filter([{listed}], lambda x: x IS NOT NULL))), ',') AS licenses,
       len(regexp_extract_all(rest, '[A-Za-z0-9]+'))::INT AS unmatched
FROM x{len(runs)}
"""


ORACLE = _oracle()
