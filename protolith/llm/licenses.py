"""Licence scans by sentence rules, in DataFrame expressions only.

Known licence sentences are found anywhere in a text, the longest first, and mapped to their identifiers. Runs of other
than a-z and 0-9 count as one space, so sentences wrapped over lines, behind comment marks or inside longer sentences
are found too; the SQL knows them only as whole lines or sentences, as the test tables have them. The identifiers, in
order, are matched against ordered rules: each rule is a sequence of identifiers that follow each other with nothing
known between them; what a rule matches is taken out before later rules are tried, so the more specific licence wins,
and a rule counts once for each match. Of a clause that names a holder any name of up to `HOLDER` words is taken. A
sentence behind a negation ("is not licensed under") is none. Identifiers behind `SPDX-License-Identifier:` are licences
as they stand, those that rules know in the rules' spelling; what follows a WITH is an exception and none. These two, and
holders' names, aren't in the SQL.

Null and empty texts have no sentences. Repeated rows get equal results; other columns play no part; an empty table gives
no rows. Every known sentence has a word with one of `TRIGGERS` in it, so a text without any has none: one scan settles it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, table

#: Sentences of public licences and notices by identifier, as normalised.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-the": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-notice": "released under the mit license",
    "mit-notice-2": "this project is licensed under the mit license",
    "mit-notice-3": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-use": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-name": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "mpl-form": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-only-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 2",
    "lgpl-details": "see the gnu lesser general public license for more details",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software",
    "zlib-free": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-origin": "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "epl-made": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "public-domain": "this work is in the public domain",
    "wtfpl": "you just do what the fuck you want to",
    "spdx": "spdx license identifier",
}
#: Names of licences in notices, and their identifiers.
NAMED = {
    "apache license 2 0": "Apache-2.0", "apache 2 0 license": "Apache-2.0", "bsd 2 clause license": "BSD-2-Clause", "bsd 3 clause license": "BSD-3-Clause", "isc license": "ISC", "zlib license": "Zlib",
    "boost software license version 1 0": "BSL-1.0", "eclipse public license 2 0": "EPL-2.0", "mozilla public license 2 0": "MPL-2.0", "gnu general public license version 2": "GPL-2.0-only",
    "gnu general public license v3": "GPL-3.0-only", "gnu lesser general public license version 2 1": "LGPL-2.1-only", "gnu lesser general public license version 3": "LGPL-3.0-only", "gnu affero general public license version 3": "AGPL-3.0-only",
    "cc by nc sa 4 0": "CC-BY-NC-SA-4.0", "cc by nc nd 4 0": "CC-BY-NC-ND-4.0", "cc by 3 0": "CC-BY-3.0", "cc by sa 3 0": "CC-BY-SA-3.0", "sil open font license version 1 1": "OFL-1.1", "artistic license 2 0": "Artistic-2.0",
}
#: How a notice allows later versions.
LATER = ("or later", "or any later version", "or at your option any later version")
NAMED |= {f"{name} {later}": licence.replace("-only", "-or-later") for name, licence in list(NAMED.items()) if licence.endswith("-only") for later in LATER}
NAMED |= {f"gnu general public license version 3 {later}": "GPL-3.0-or-later" for later in LATER}
#: How a notice says it: every way with every name is a known sentence.
WAYS = ("licensed under", "released under", "distributed under", "licensed under the", "released under the", "distributed under the", "under the terms of the")
SENTENCES |= {f"{way.replace(' ', '-')}-{name.replace(' ', '-')}": f"{way} {name}" for name in NAMED for way in WAYS if name.startswith("cc") == (not way.endswith("the"))}
#: Licence, and the sentences that name it; the first rules are tried first.
RULES = (
    ("Apache-2.0", ("apache-the", "apache-use", "apache-copy", "apache-as-is", "apache-see")),
    ("Apache-2.0", ("apache-the", "apache-use")),
    ("Apache-2.0", ("apache-notice",)),
    ("MIT", ("mit-grant", "mit-keep")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-notice-2",)),
    ("MIT", ("mit-notice-3",)),
    ("ISC", ("isc-grant",)),
    ("BSD-3-Clause", ("bsd-use", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-use", "bsd-source", "bsd-binary")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("LGPL-2.1-or-later", ("lgpl-free",)),
    ("GPL-3.0-only", ("gpl3-notice",)),
    ("MPL-2.0", ("mpl-form", "mpl-copy")),
    ("MPL-2.0", ("mpl-form",)),
    ("CC-BY-SA-4.0", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", ("cc-by-nc",)),
    ("CC-BY-ND-4.0", ("cc-by-nd",)),
    ("CC-BY-4.0", ("cc-by",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    ("AGPL-3.0-or-later", ("agpl-free",)),
    ("GPL-2.0-only", ("gpl2-only-free",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("Zlib", ("zlib-free", "zlib-origin")),
    ("Zlib", ("zlib-free",)),
    ("0BSD", ("0bsd-grant",)),
    ("EPL-2.0", ("epl-made",)),
    ("WTFPL", ("wtfpl",)),
    ("Public-Domain", ("public-domain",)),
    *((licence, (f"{way.replace(' ', '-')}-{name.replace(' ', '-')}",)) for name, licence in NAMED.items() for way in WAYS if name.startswith("cc") == (not way.endswith("the"))),
)
#: Each known sentence has one of these inside a word, with nothing between its letters: no text with one is passed over.
TRIGGERS = "(?i)licen[sc]|redistribut|permission|copy|endorse|warrant|software|domain|waived|under|provided|fuck"


#: Sentences around a holder's name, and how many words it may have.
HOLDERS = {"bsd-name": ("neither the name of", "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission")}
HOLDER = 16
#: Words that turn a sentence round.
NEGATIONS = ("not", "never", "cannot", "isn't", "no longer")
_APART = "[^a-z0-9]++"


def _tree(told: list[list[str]]) -> str:
    """A pattern of word sequences that share their first words; the longest that fits is taken."""
    heads: dict[str, list[list[str]]] = {}
    for words in told:
        heads.setdefault(words[0], []).append(words[1:])
    out = []
    for word, rest in sorted(heads.items()):
        more = _tree([r for r in rest if r]) if any(rest) else ""
        out.append(word + (f"(?:{_APART}{more})" + "?" * ([] in rest) if more else ""))
    return f"(?:{'|'.join(out)})"


#: Known sentences in a text: their words with anything but letters and digits of ASCII between them.
FOUND = (
    f"(?i)(?<![a-z0-9])(?<!(?:{'|'.join(NEGATIONS)})[^a-z0-9]{{1,9}})(?:"
    + "|".join(f"{before.replace(' ', _APART)}{_APART}(?:[a-z0-9]++{_APART}){{1,{HOLDER}}}?{after.replace(' ', _APART)}" for before, after in HOLDERS.values())
    + f"|{_tree([s.split() for s in SENTENCES.values()])})(?![a-z0-9])"
)
_SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([( \t]*[a-z0-9.+:-]+[ \t)]*(?:\b(?:AND|OR|WITH)[( \t]+[a-z0-9.+:-]+[ \t)]*)*)"


def sentences(text: Column) -> Column:
    """Array of the known sentences, normalised, in order of text."""
    found = F.transform(F.regexp_extract_all(text, F.lit(FOUND), F.lit(0)), lambda s: F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))

    def plain(s):
        for name, (before, after) in HOLDERS.items():
            s = F.when(s.startswith(before) & s.endswith(after), F.lit(SENTENCES[name])).otherwise(s)
        return s

    return F.transform(found, plain)


def declared(text: Column) -> Column:
    """Array of the licences that SPDX expressions name, in order of text."""
    told = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_SPDX), F.lit(1)), lambda e: F.regexp_extract_all(F.regexp_replace(e, r"(?i)\bWITH[( \t]+[a-z0-9.+:-]+", " "), F.lit("[A-Za-z0-9.+:-]+"), F.lit(0))))
    told = F.filter(told, lambda w: ~F.upper(w).isin("AND", "OR"))
    known = F.create_map(*[F.lit(x) for n in sorted({n for n, _ in RULES}) for x in (n.lower(), n)])
    return F.transform(told, lambda w: F.coalesce(F.try_element_at(known, F.lower(w)), w))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentence_ids and licenses: arrays of names in order of text, and of rules, of every document."""
    text = F.coalesce("text", F.lit(""))
    names = sorted(SENTENCES)
    known = F.create_map(*[F.lit(x) for k, n in enumerate(names) for x in (SENTENCES[n], k)])
    ids = F.filter(F.transform(sentences(text), lambda s: F.try_element_at(known, s)), lambda k: k.isNotNull())
    spdx = F.when(text.contains("icense-") | text.contains("ICENSE-"), declared(text)).otherwise(F.expr("cast(array() as array<string>)"))
    df = documents(docs).select("doc_id", F.when(text.rlike(TRIGGERS), ids).otherwise(F.expr("cast(array() as array<int>)")).alias("_ids"), spdx.alias("_spdx"))
    # "<3><7>": identifiers as text; a rule is a run of them.
    df = df.withColumn("_rest", F.array_join(F.transform("_ids", lambda k: F.concat(F.lit("<"), k.cast("string"), F.lit(">"))), ""))
    counts = []
    alone = {names.index(n[0]): licence for licence, n in RULES if len(n) == 1 and sum(n[0] in rule for _, rule in RULES) == 1}
    for r, (name, rule) in enumerate(RULES):
        run = "".join(f"<{names.index(n)}>" for n in rule)
        if len(rule) == 1 and names.index(rule[0]) in alone:
            continue
        n = (F.length("_rest") - F.length(F.replace(F.col("_rest"), F.lit(run), F.lit("")))) / len(run)
        # A hole stays where a rule has matched, so nothing joins over it.
        df = df.withColumns({f"_n{r}": n.cast("int"), "_rest": F.replace(F.col("_rest"), F.lit(run), F.lit("|"))})
        counts.append(F.array_repeat(F.lit(name), F.col(f"_n{r}")))
    # Rules of one sentence that no other rule has: what is left of them, in any order, is one licence each.
    left = F.regexp_extract_all("_rest", F.lit("<([0-9]+)>"), F.lit(1))
    told = F.create_map(*[F.lit(x) for k, licence in sorted(alone.items()) for x in (str(k), licence)])
    counts.append(F.filter(F.transform(left, lambda k: F.try_element_at(told, k)), lambda n: n.isNotNull()))
    table_ = F.array(*[F.lit(n) for n in names])
    return df.select("doc_id", F.transform("_ids", lambda k: F.element_at(table_, k + 1)).alias("sentence_ids"), F.concat(*counts, "_spdx").alias("licenses"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(table(spark, sf_dir, "documents"))
    return s.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join(F.array_sort(F.array_distinct("licenses")), ",").alias("licenses"), F.size("licenses").cast("long").alias("n_notices"))


def oracle() -> str:
    """The same in DuckDB: sentences by a join with the known ones, rules by nested replacement."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    names = sorted(SENTENCES)
    known = ", ".join(f"({k}, {quoted(n)}, {quoted(SENTENCES[n])})" for k, n in enumerate(names))
    before, found = "ids", []
    for r, (_, rule) in enumerate(RULES):
        run = "".join(f"<{names.index(n)}>" for n in rule)
        found += [f"(length({before}) - length(replace({before}, '{run}', ''))) // {len(run)} AS n{r}", f"replace({before}, '{run}', '|') AS r{r}"]
        before = f"r{r}"
    labels = ", ".join(f"CASE WHEN n{r} > 0 THEN {quoted(name)} END" for r, (name, _) in enumerate(RULES))
    total = " + ".join(f"n{r}" for r in range(len(RULES)))
    return f"""
WITH known(k, name, sentence) AS (VALUES {known}),
s AS (SELECT doc_id, unnest(string_split(regexp_replace(coalesce(text, ''), '([.!?;])[ \\t\\r\\f]+', '\\1' || chr(10), 'g'), chr(10))) AS t,
      generate_subscripts(string_split(regexp_replace(coalesce(text, ''), '([.!?;])[ \\t\\r\\f]+', '\\1' || chr(10), 'g'), chr(10)), 1) AS pos FROM documents),
p AS (SELECT doc_id, pos, trim(regexp_replace(lower(t), '[^a-z0-9]+', ' ', 'g')) AS t FROM s),
h AS (SELECT doc_id, string_agg('<' || k || '>', '' ORDER BY pos) AS ids, string_agg(name, ',' ORDER BY pos) AS sentence_ids, count(*) AS n FROM p JOIN known ON t = sentence GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(ids, '') AS ids, coalesce(sentence_ids, '') AS sentence_ids, coalesce(n, 0) AS n_sentences FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN h USING (doc_id)),
r AS (SELECT *, {", ".join(found)} FROM d)
SELECT doc_id, CAST(n_sentences AS BIGINT) AS n_sentences, sentence_ids,
  coalesce(array_to_string(list_sort(list_distinct(list_filter([{labels}], lambda x: x IS NOT NULL))), ','), '') AS licenses,
  CAST({total} AS BIGINT) AS n_notices FROM r
"""
