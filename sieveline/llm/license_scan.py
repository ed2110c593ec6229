"""Licence scan by sentence rules: sentences become known identifiers, and ordered identifiers become licences.

A text is stripped of decoration and normalised: lines are joined, so neither
wrapping nor comment marks cut a sentence. Known licence sentences are found
wherever they stand, also inside longer ones (where two begin at one word, the
longer counts), and become a sequence of identifiers in text order. Rules are ordered sequences of
identifiers; longer rules are tried first, and what a rule has matched is used
up. Identifiers that no rule has used are reported, since they hint at a licence
that the rules do not know.

A null text is an empty one: no sentences and no licences. Rows are judged one by
one, so repeated rows repeat their result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sieveline.llm.common import pick

# Sentences of public licences and licence notices, normalised (lower case, letters and digits, single spaces)
SENTENCES = {
    "apache-short": "licensed under the apache license version 2 0",
    "apache-the-license": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-warranty": "unless required by applicable law or agreed to in writing software distributed under the license is "
    "distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-short": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation the rights to "
    "use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
    "software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to "
    "the warranties of merchantability fitness for a particular purpose and noninfringement",
    "gpl3-short": "this work is licensed under the gnu general public license version 3",
    "gpl3-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
    "public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without even the "
    "implied warranty of merchantability or fitness for a particular purpose",
    "gpl-received": "you should have received a copy of the gnu general public license along with this program",
    "bsd-allowed": "redistribution and use in source and binary forms with or without modification are permitted provided that "
    "the following conditions are met",
    "ccbync4-short": "licensed under cc by nc 4 0",
    "ccby4-short": "licensed under cc by 4 0",
    "ccbysa4-short": "licensed under cc by sa 4 0",
    "mpl2-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
}

# Licences and the ordered sentences that state them
RULES = [
    ("Apache-2.0", ["apache-the-license", "apache-comply", "apache-copy", "apache-warranty", "apache-see"]),
    ("MIT", ["mit-grant", "mit-notice", "mit-warranty"]),
    ("GPL-3.0-or-later", ["gpl3-free", "gpl-warranty", "gpl-received"]),
    ("GPL-3.0-or-later", ["gpl3-free", "gpl-warranty"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("Apache-2.0", ["apache-the-license"]),
    ("Apache-2.0", ["apache-short"]),
    ("MIT", ["mit-short"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-grant"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("GPL-3.0-or-later", ["gpl3-free"]),
    ("CC-BY-NC-4.0", ["ccbync4-short"]),
    ("CC-BY-4.0", ["ccby4-short"]),
    ("CC-BY-SA-4.0", ["ccbysa4-short"]),
    ("MPL-2.0", ["mpl2-form"]),
]

_LATER = "of the license or at your option any later version"
_FSF = "as published by the free software foundation"
_MODIFY = "is free software you can redistribute it and or modify it under the terms of the gnu"
_NO_WARRANTY = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of " \
    "merchantability or fitness for a particular purpose"
_CC = "licensed under a creative commons"

# Further sentences and rules of the scan; the check SQL knows those above alone
MORE_SENTENCES = {
    "gpl2-free": f"this program {_MODIFY} general public license {_FSF} either version 2 {_LATER}",
    "gpl2-only": f"this program {_MODIFY} general public license {_FSF} version 2",
    "gpl2-only-of": f"this program {_MODIFY} general public license version 2 {_FSF}",
    "gpl3-only": f"this program {_MODIFY} general public license {_FSF} version 3",
    "lgpl21-free": f"this library {_MODIFY} lesser general public license {_FSF} either version 2 1 {_LATER}",
    "lgpl3-free": f"this library {_MODIFY} lesser general public license {_FSF} either version 3 {_LATER}",
    "lgpl3-program": f"this program {_MODIFY} lesser general public license {_FSF} either version 3 {_LATER}",
    "agpl3-free": f"this program {_MODIFY} affero general public license {_FSF} either version 3 {_LATER}",
    "lgpl-warranty": f"this library {_NO_WARRANTY}",
    "lgpl-received": "you should have received a copy of the gnu lesser general public license along with this library",
    "lgpl-received-program": "you should have received a copy of the gnu lesser general public license along with this program",
    "agpl-received": "you should have received a copy of the gnu affero general public license along with this program",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
    "following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-warranty": "any express or implied warranties including but not limited to the implied warranties of merchantability "
    "and fitness for a particular purpose are disclaimed",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-grant-and": "permission to use copy modify and distribute this software for any purpose with or without fee is hereby "
    "granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to "
    "alter it and redistribute it freely subject to the following restrictions",
    "boost-short": "distributed under the boost software license version 1 0",
    "epl2-form": "made available under the terms of the eclipse public license 2 0",
    "epl2-form-v": "made available under the terms of the eclipse public license v 2 0",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "ccby4-long": f"{_CC} attribution 4 0 international license",
    "ccbysa4-long": f"{_CC} attribution sharealike 4 0 international license",
    "ccbync4-long": f"{_CC} attribution noncommercial 4 0 international license",
    "cc0-short": "cc0 1 0 universal",
}
MORE_RULES = [
    ("BSD-3-Clause", ["bsd-allowed", "bsd-source", "bsd-binary", "bsd-name", "bsd-warranty"]),
    ("BSD-2-Clause", ["bsd-allowed", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("BSD-3-Clause", ["bsd-allowed", "bsd-source", "bsd-binary", "bsd-name"]),
    ("BSD-2-Clause", ["bsd-allowed", "bsd-source", "bsd-binary"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-warranty", "gpl-received"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-warranty", "gpl-received"]),
    ("GPL-2.0-only", ["gpl2-only-of", "gpl-warranty", "gpl-received"]),
    ("GPL-3.0-only", ["gpl3-only", "gpl-warranty", "gpl-received"]),
    ("LGPL-2.1-or-later", ["lgpl21-free", "lgpl-warranty", "lgpl-received"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "lgpl-warranty", "lgpl-received"]),
    ("LGPL-3.0-or-later", ["lgpl3-program", "gpl-warranty", "lgpl-received-program"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-warranty", "agpl-received"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-warranty"]),
    ("GPL-2.0-only", ["gpl2-only", "gpl-warranty"]),
    ("MPL-2.0", ["mpl2-form", "mpl2-copy"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("GPL-2.0-only", ["gpl2-only"]),
    ("GPL-2.0-only", ["gpl2-only-of"]),
    ("GPL-3.0-only", ["gpl3-only"]),
    ("LGPL-2.1-or-later", ["lgpl21-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-free"]),
    ("LGPL-3.0-or-later", ["lgpl3-program"]),
    ("AGPL-3.0-or-later", ["agpl3-free"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-grant-and"]),
    ("Zlib", ["zlib-grant"]),
    ("BSL-1.0", ["boost-short"]),
    ("EPL-2.0", ["epl2-form"]),
    ("EPL-2.0", ["epl2-form-v"]),
    ("Unlicense", ["unlicense-free"]),
    ("CC-BY-4.0", ["ccby4-long"]),
    ("CC-BY-SA-4.0", ["ccbysa4-long"]),
    ("CC-BY-NC-4.0", ["ccbync4-long"]),
    ("CC0-1.0", ["cc0-short"]),
]

# What separates sentences in the check SQL, the same in Java's and DuckDB's patterns
DECORATION = r"[^\p{L}\p{N}\s.!?:,;()'/\-]+|[!?]{2,}"
SENTENCE_END = r"[.!?]+\s+|\s*\n\s*\n\s*"
LINE_START = r"\n\s*(\p{Lu})"
OTHER = r"[^\p{L}\p{N}]+"


def normalised(text: Column) -> Column:
    """The words of a text without decoration, lower case, with one space before and after each."""
    plain = F.regexp_replace(text, DECORATION, "")
    return F.concat(F.lit(" "), F.trim(F.lower(F.regexp_replace(plain, OTHER, " "))), F.lit(" "))


def identifiers(text: Column, known: dict[str, str] = SENTENCES | MORE_SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in text order."""
    of = F.create_map(*[F.lit(x) for name, sentence in known.items() for x in (sentence, name)])
    any_known = "(?<= )(?:" + "|".join(sorted(known.values(), key=lambda s: (-len(s), s))) + ")(?= )"
    held = F.regexp_extract_all(normalised(text), F.lit(any_known), F.lit(0))
    return F.transform(held, lambda s: F.element_at(of, s))


def matched(ids: Column, rules: list[tuple[str, list[str]]] = RULES + MORE_RULES) -> tuple[Column, Column]:
    """(names of the rules that match, distinct and sorted; identifiers left over), from identifiers as one text."""
    longest_first = sorted(rules, key=lambda rule: -len(rule[1]))
    rest, found = ids, []
    for name, parts in longest_first:
        pattern = "".join(f"<{part}>" for part in parts)
        found.append(F.when(F.contains(rest, F.lit(pattern)), F.lit(name)))
        rest = F.replace(rest, F.lit(pattern), F.lit("|"))
    names = F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))
    return names, F.replace(rest, F.lit("|"), F.lit(""))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, `sentence_ids` and `licenses` (arrays), `unmatched` (identifiers no rule used, as one text)."""
    rows = pick(df, id_col, text_col).toDF(id_col, "text")
    known = rows.select(id_col, identifiers(F.coalesce("text", F.lit(""))).alias("sentence_ids"))
    as_text = F.array_join(F.transform("sentence_ids", lambda s: F.concat(F.lit("<"), s, F.lit(">"))), "")
    spelled = known.withColumn("spelled", as_text)
    names, rest = matched(F.col("spelled"))
    return spelled.select(id_col, "sentence_ids", names.alias("licenses"), rest.alias("unmatched"))


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id",
        F.size("sentence_ids").cast("long").alias("n_sentences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        "unmatched",
    )


def check_sql() -> str:
    """The scan of SENTENCES and RULES in DuckDB's words, for texts where a known sentence stands alone on its lines."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(s)}, {quote(n)})" for n, s in SENTENCES.items())
    rest, cases = "spelled", []
    for name, parts in sorted(RULES, key=lambda rule: -len(rule[1])):
        pattern = quote("".join(f"<{p}>" for p in parts))
        cases.append(f"CASE WHEN contains({rest}, {pattern}) THEN {quote(name)} END")
        rest = f"replace({rest}, {pattern}, '|')"
    return f"""
WITH known(sentence, name) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS rid, doc_id, replace(coalesce(text, ''), chr(30), ' ') AS t FROM documents),
p AS (SELECT rid, doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(t, {quote(DECORATION)}, '', 'g'),
        {quote(SENTENCE_END)}, chr(30), 'g'), {quote(LINE_START)}, chr(30) || '\\1', 'g'), chr(30)) AS s FROM d),
e AS (SELECT rid, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM p),
k AS (SELECT rid, count(*) AS n, string_agg(name, ',' ORDER BY i) AS ids, string_agg('<' || name || '>', '' ORDER BY i) AS spelled
      FROM e JOIN known ON known.sentence = trim(lower(regexp_replace(e.s, {quote(OTHER)}, ' ', 'g'))) GROUP BY rid),
f AS (SELECT d.doc_id, coalesce(n, 0) AS n, coalesce(ids, '') AS ids, coalesce(spelled, '') AS spelled FROM d LEFT JOIN k USING (rid))
SELECT doc_id, CAST(n AS BIGINT) AS n_sentences, ids AS sentence_ids,
       coalesce(array_to_string(list_sort(list_distinct([{", ".join(cases)}])), ','), '') AS licenses,
       replace({rest}, '|', '') AS unmatched
FROM f"""
