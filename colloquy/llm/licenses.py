"""Licence recognition by sentences and rules, in DataFrame functions only.

A text is cut into sentences, each is normalised and looked up among known licence
sentences; what remains is the sequence of their identifiers in text order. A rule is an
ordered list of identifiers; a text has a licence where its sequence holds the rule's
identifiers in order. Everything happens inside the row: nothing is shuffled.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from colloquy.llm.common import prepared, table

# Sentences of well-known licences and licence notices, by identifier.
SENTENCES = {
    "agpl-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "apache-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-unless": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "cc-by-line": "Licensed under CC BY 4.0.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-sa-line": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-zero-line": "Licensed under CC0 1.0.",
    "gpl-2-line": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "mit-line": "Released under the MIT License.",
    "mit-line-2": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

# What a licence is, and the sentences of each of its forms, in order.
RULES = (
    ("AGPL-3.0", ("agpl-notice",)),
    ("Apache-2.0", ("apache-line",)),
    ("Apache-2.0", ("apache-notice", "apache-copy", "apache-unless", "apache-see")),
    ("Apache-2.0", ("apache-notice", "apache-unless")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("CC-BY-4.0", ("cc-by-line",)),
    ("CC-BY-4.0", ("cc-by-notice",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-line",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-line",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-line",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-notice",)),
    ("CC0-1.0", ("cc-zero-line",)),
    ("GPL-2.0", ("gpl-2-line",)),
    ("GPL-2.0-or-later", ("gpl-2-notice", "gpl-hope", "gpl-see")),
    ("GPL-3.0", ("gpl-3-line",)),
    ("GPL-3.0-or-later", ("gpl-3-notice", "gpl-hope", "gpl-see")),
    ("ISC", ("isc-grant",)),
    ("LGPL-3.0", ("lgpl-line",)),
    ("MIT", ("mit-grant", "mit-notice")),
    ("MIT", ("mit-line",)),
    ("MIT", ("mit-line-2",)),
    ("MPL-2.0", ("mpl-notice",)),
    ("Unlicense", ("unlicense",)),
)
#: Every known sentence holds one of these, each inside of one word; texts without any are not cut up.
TRIGGERS = ("licen", "redistribut", "copyright", "permission", "warrant", "unencumbered", "endorse")
#: Licences that need more sentences than another one replace it.
REPLACES = {"BSD-3-Clause": ("BSD-2-Clause",)}


def normal(sentence: str) -> str:
    """ASCII letters and digits in lower case, everything else one space."""
    return re.sub("[^a-z0-9]+", " ", sentence.translate({c: c + 32 for c in range(65, 91)})).strip(" ")


#: Normalised sentence to identifier.
KNOWN = {normal(sentence): name for name, sentence in SENTENCES.items()}


# Marks that begin a line: of comments, and of list items.
_MARKS = r"^[ \t]*(?:#+|//+|/?\*+/?|;+|--+|%+|[-•]|\(?[0-9a-z]{1,2}\))(?:[ \t]+|\r?$)"
# Ends of sentences and paragraphs, and borders that a sentence may go over: ends of lines
# and colons. What follows one of the words is no sentence of its own, wherever it begins.
_HARD, _SOFT = r"[.!?][ \t\r\n\f]+|\n[ \t\r\f]*\n", r":[ \t\r\f]|\r?\n"
_DENIED = "(^|[ \x04\x05])(not|never|nor|neither|without|no longer|isn t|aren t|wasn t)\x04"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ\x02\x03\x04\x05", "abcdefghijklmnopqrstuvwxyz    "
#: A known sentence from border to border; its words may be apart by a space or a soft border.
_KNOWN = "\x02(" + "|".join(k.replace(" ", "(?: |\x02\x02)") for k in sorted(KNOWN, key=lambda k: (-len(k), k))) + ")\x02"
#: Patterns and what they are replaced by, one after the other.
_STEPS = (
    (_HARD, "\x03"), (_SOFT, "\x02"), ("[^a-z0-9\x02\x03]+", " "), (" ?\x02[ \x02]*", "\x04"),
    ("[ \x04]*\x03[ \x03\x04]*", "\x05"), (_DENIED, r"{1}{2} "), ("\x04", "\x02\x02"), ("\x05", "\x02\x03\x02"),
)


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order.

    Words are lower-cased; borders between them stay. A known sentence begins and ends at
    a border: of a sentence, paragraph, line, comment or list item, or after a colon. So it
    may be wrapped or commented, but what is said of it inside of another sentence, or
    after a ``not`` at the end of the line before, is not it. The longest one is taken.
    """
    known = F.create_map(*[F.lit(x) for pair in sorted(KNOWN.items()) for x in pair])
    out = F.regexp_replace(F.translate(text, _UPPER, _LOWER), "(?md)" + _MARKS, "")
    for pattern, instead in _STEPS:
        out = F.regexp_replace(out, pattern, instead.replace("{", "$").replace("}", ""))
    whole = F.concat(F.lit("\x02"), F.trim(out), F.lit("\x02"))
    found = F.regexp_extract_all(whole, F.lit(_KNOWN), F.lit(1))
    return F.transform(found, lambda x: F.element_at(known, F.replace(x, F.lit("\x02\x02"), F.lit(" "))))


def _pattern(rule: tuple[str, ...]) -> str:
    return "%" + "%".join(f"<{x}>" for x in rule) + "%"


def licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, sentences, licenses`` of every row: identifiers in order, licences by name.

    A null or empty text, and one without known sentences, has two empty arrays. Rows
    are independent: repeated rows give repeated results. No other column is read.
    """
    prepared(docs.sparkSession)
    body = F.col(text).cast("string")
    trigger = "(?i)" + "|".join(TRIGGERS)
    none = F.array().cast("array<string>")
    found = docs.select(
        F.col(key).alias("key"),
        F.when(body.rlike(trigger), sentence_ids(body)).otherwise(none).alias("sentences"),
    )
    sequence = F.concat(F.lit("<"), F.array_join("sentences", "><"), F.lit(">"))
    names = dict.fromkeys(name for name, _ in RULES)
    by_name = {n: [F.col("sequence").like(_pattern(r)) for name, r in RULES if name == n] for n in names}
    fits = {n: _any(conditions) for n, conditions in by_name.items()}
    for name, weaker in REPLACES.items():
        for w in weaker:
            fits[w] = fits[w] & ~fits[name]
    matched = F.array_compact(F.array(*[F.when(fits[n], F.lit(n)) for n in sorted(names)]))
    return (
        found.withColumn("sequence", sequence)
        .select(F.col("key").alias(key), "sentences", F.when(F.size("sentences") > 0, matched).otherwise(none).alias("licenses"))
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def op3_licenses(spark, sf_dir: str) -> DataFrame:
    """Licences and licence sentences of every document."""
    found = licenses(table(prepared(spark), sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.size("sentences").cast("bigint").alias("n_sentences"),
        F.array_join("sentences", ",").alias("sentences"),
        F.array_join("licenses", ",").alias("licenses"),
    )


def _oracle() -> str:
    known = ", ".join(f"('{k}', '{v}')" for k, v in sorted(KNOWN.items()))
    by_name: dict[str, list[str]] = {}
    for name, rule in RULES:
        by_name.setdefault(name, []).append(f"sequence LIKE '{_pattern(rule)}'")
    fits = {n: "(" + " OR ".join(c) + ")" for n, c in by_name.items()}
    for name, weaker in REPLACES.items():
        for w in weaker:
            fits[w] = f"({fits[w]} AND NOT {fits[name]})"
    matched = ", ".join(f"CASE WHEN {fits[n]} THEN '{n}' END" for n in sorted(fits))
    code = lambda x: x.replace("'", "''")
    steps = f"regexp_replace(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '(?m){_MARKS}', '', 'g')"
    for pattern, instead in _STEPS:
        steps = f"regexp_replace({steps}, '{code(pattern)}', '{instead.replace('{', chr(92)).replace('}', '')}', 'g')"
    return rf"""
WITH known(k, id) AS (VALUES {known}),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
found AS (SELECT r, regexp_extract_all(chr(2) || trim({steps}, ' ') || chr(2), '{_KNOWN}', 1) AS said FROM docs),
units AS (SELECT r, replace(unnest(said), chr(2) || chr(2), ' ') AS k, generate_subscripts(said, 1) AS u FROM found),
sequences AS (
  SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY u) AS ids, '<' || string_agg(id, '><' ORDER BY u) || '>' AS sequence
  FROM units JOIN known USING (k) GROUP BY r
)
SELECT doc_id, coalesce(n, 0) AS n_sentences, coalesce(ids, '') AS sentences,
       CASE WHEN ids IS NULL THEN '' ELSE array_to_string(list_filter([{matched}], lambda x: x IS NOT NULL), ',') END AS licenses
FROM docs LEFT JOIN sequences USING (r)
"""


ORACLE = _oracle()
