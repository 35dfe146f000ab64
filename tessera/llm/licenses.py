"""Operator 10: licence recognition by sentences.

A text loses the marks that lead comment lines and is cut into sentences; each is normalised (lower case, letters and digits only, single spaces) and looked up among known licence sentences.
A known sentence that holds an end mark itself is cut by the same rule, and its pieces must follow each other; the longest that fits is taken.
The identifiers found, in order, are then matched against ordered rules: at each place the first rule whose identifiers follow each other there wins, and its identifiers are used up.
Known sentences and rules are fixed lists in this file, so they are small and travel with the function.  The SQL is made from the same lists.

Defined cases: a null or empty text has no licence; a licence found twice is named once; an identifier that no rule uses is counted as unmatched; of rules that fit at one place the first listed wins;
rows are judged one by one, so repeated rows get equal results; a very long text is read whole; other columns, whatever their names, are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Known licence sentences, as identifier and sentence.
SENTENCES = [
    ("mit-notice", "Released under the MIT License"),
    ("mit-notice", "Licensed under the MIT License"),
    ("mit-notice", "This project is licensed under the terms of the MIT license"),
    ("mit-title", "The MIT License (MIT)"),
    ("mit-title", "MIT License"),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit-keep", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2-notice", "Licensed under the Apache License, Version 2.0"),
    ("apache-2-notice", "Licensed under the Apache License, Version 2.0 (the \"License\")"),
    ("apache-2-copy", "You may obtain a copy of the License at"),
    ("gpl-3-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl-3-notice", "Licensed under the GNU General Public License, version 3"),
    ("gpl-2-notice", "Licensed under the GNU General Public License, version 2"),
    ("gpl-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl-3-notice", "Licensed under the GNU Lesser General Public License, version 3"),
    ("mpl-2-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc-4-notice", "Licensed under CC BY-NC 4.0"),
    ("cc-by-4-notice", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4-notice", "Licensed under CC BY-SA 4.0"),
    ("cc0-notice", "Released under CC0 1.0"),
    ("bsd-grant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense-use", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("mit-warranty", "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"),
    ("mit-liability", "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"),
    ("bsd-warranty", "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("bsd-liability", "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage"),
    ("isc-warranty", "The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("apache-title", "Apache License"),
    ("apache-2-version", "Version 2.0, January 2004"),
    ("apache-terms", "Terms and conditions for use, reproduction, and distribution"),
    ("apache-2-use", "you may not use this file except in compliance with the License"),
    ("apache-2-as-is", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("apache-2-see", "See the License for the specific language governing permissions and limitations under the License"),
    ("gpl-title", "GNU General Public License"),
    ("gpl-3-version", "Version 3, 29 June 2007"),
    ("gpl-2-version", "Version 2, June 1991"),
    ("gpl-verbatim", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("gpl-2-free", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("gpl-hope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("gpl-details", "See the GNU General Public License for more details"),
    ("agpl-title", "GNU Affero General Public License"),
    ("agpl-3-version", "Version 3, 19 November 2007"),
    ("lgpl-title", "GNU Lesser General Public License"),
    ("lgpl-2-1-version", "Version 2.1, February 1999"),
    ("lgpl-2-1-free", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"),
    ("lgpl-2-1-hope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("lgpl-3-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl-details", "See the GNU Lesser General Public License for more details"),
    ("agpl-3-free", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("agpl-details", "See the GNU Affero General Public License for more details"),
    ("mpl-2-title", "Mozilla Public License Version 2.0"),
    ("cc0-title", "CC0 1.0 Universal"),
]
#: Ordered rules, as licence and identifiers in sequence; the first that fits wins.
RULES = [
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names", "bsd-warranty", "bsd-liability")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty", "bsd-liability")),
    ("MIT", ("mit-title", "mit-grant", "mit-keep", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-keep", "mit-warranty", "mit-liability")),
    ("Apache-2.0", ("apache-2-notice", "apache-2-use", "apache-2-copy", "apache-2-as-is", "apache-2-see")),
    ("Apache-2.0", ("apache-title", "apache-2-version", "apache-terms")),
    ("Apache-2.0", ("apache-title", "apache-2-version")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-2.0-or-later", ("gpl-2-free", "gpl-hope", "gpl-details")),
    ("GPL-3.0-only", ("gpl-title", "gpl-3-version", "gpl-verbatim")),
    ("GPL-2.0-only", ("gpl-title", "gpl-2-version", "gpl-verbatim")),
    ("GPL-3.0-only", ("gpl-title", "gpl-3-version")),
    ("GPL-2.0-only", ("gpl-title", "gpl-2-version")),
    ("AGPL-3.0-only", ("agpl-title", "agpl-3-version")),
    ("LGPL-3.0-only", ("lgpl-title", "gpl-3-version")),
    ("LGPL-2.1-only", ("lgpl-title", "lgpl-2-1-version")),
    ("LGPL-3.0-or-later", ("lgpl-3-free", "gpl-hope", "lgpl-details")),
    ("LGPL-2.1-or-later", ("lgpl-2-1-free", "lgpl-2-1-hope", "lgpl-details")),
    ("AGPL-3.0-or-later", ("agpl-3-free", "gpl-hope", "agpl-details")),
    ("LGPL-3.0-or-later", ("lgpl-3-free",)),
    ("LGPL-2.1-or-later", ("lgpl-2-1-free",)),
    ("AGPL-3.0-or-later", ("agpl-3-free",)),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("Unlicense", ("unlicense", "unlicense-use")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-title", "mit-grant", "mit-keep")),
    ("MIT", ("mit-grant", "mit-keep")),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-title",)),
    ("Apache-2.0", ("apache-2-notice", "apache-2-copy")),
    ("Apache-2.0", ("apache-2-notice",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-2.0-or-later", ("gpl-2-free",)),
    ("GPL-3.0-only", ("gpl-3-notice",)),
    ("GPL-2.0-only", ("gpl-2-notice",)),
    ("LGPL-3.0-only", ("lgpl-3-notice",)),
    ("MPL-2.0", ("mpl-2-notice",)),
    ("MPL-2.0", ("mpl-2-title",)),
    ("CC0-1.0", ("cc0-title",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-4-notice",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-4-notice",)),
    ("CC-BY-4.0", ("cc-by-4-notice",)),
    ("CC0-1.0", ("cc0-notice",)),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense",)),
]
#: A sentence ends at a mark before white space or the end, or at an empty line.
SENTENCE_END = re.compile(r"[.!?;:](?=\s|$)|\n[ \t\r]*\n")
#: What leads a line of a comment; it goes before the text is cut, so that an empty comment line is an empty line.
LEADER = r"(?m)^[ \t]*(//+|#+|/[*]+|[*]+/?|--+|;+|<!--)[ \t]*"
NOT_WORD = re.compile(r"[^a-z0-9]+")


def normalised(sentence: str) -> str:
    return NOT_WORD.sub(" ", sentence.lower()).strip()


class Recogniser:
    def __init__(self, sentences=SENTENCES, rules=RULES):
        self.known = {normalised(s): i for i, s in sentences}
        #: First piece -> (pieces, identifier), the longest first.
        self.starts: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        for i, s in sentences:
            for parts in dict.fromkeys(((normalised(s),), tuple(filter(None, map(normalised, SENTENCE_END.split(s)))))):
                self.starts.setdefault(parts[0], []).append((parts, i))
        for x in self.starts.values():
            x.sort(key=lambda y: -len(y[0]))
        self.pieces = {p for x in self.starts.values() for parts, _ in x for p in parts}
        self.rules = list(rules)
        self.marks = self._marks()

    def _marks(self) -> list[str]:
        """Few words such that each known sentence has one: a text with none needs no look."""
        left, out = [set(k.split()) for k in self.known], []
        while left:
            count: dict[str, int] = {}
            for words in left:
                for w in words:
                    if len(w) >= 6:
                        count[w] = count.get(w, 0) + 1
            if not count:
                return [""]
            best = min(count, key=lambda w: (-count[w], w))
            out.append(best)
            left = [x for x in left if best not in x]
        return out

    def identifiers(self, text: str) -> list[str]:
        lower = re.sub(LEADER, "", text.lower())
        if not any(m in lower for m in self.marks):
            return []
        units = []
        for s in SENTENCE_END.split(lower):
            n = normalised(s)
            units += [n] if n in self.pieces or "\n" not in s else map(normalised, s.split("\n"))
        units = [u for u in units if u]
        out, at = [], 0
        while at < len(units):
            for parts, i in self.starts.get(units[at], ()):
                if tuple(units[at : at + len(parts)]) == parts:
                    out.append(i)
                    at += len(parts)
                    break
            else:
                at += 1
        return out

    def licences(self, ids: list[str]) -> tuple[list[str], int]:
        """Names in order of first sight, and the number of identifiers no rule used."""
        found, lost, i = [], 0, 0
        while i < len(ids):
            for name, seq in self.rules:
                if tuple(ids[i : i + len(seq)]) == seq:
                    found.append(name)
                    i += len(seq)
                    break
            else:
                lost, i = lost + 1, i + 1
        return list(dict.fromkeys(found)), lost


def scan(docs: DataFrame, sentences=SENTENCES, rules=RULES) -> DataFrame:
    """doc_id, licenses (names joined by a comma, null if none), n_sentences (identifiers found), n_unmatched."""
    names = ["doc_id", "licenses", "n_sentences", "n_unmatched"]

    def run(batches):
        r = Recogniser(sentences, rules)
        for batch in batches:
            out = []
            for t in batch.column(1):
                ids = r.identifiers(t.as_py() or "")
                found, lost = r.licences(ids) if ids else ([], 0)
                out.append((",".join(found) or None, len(ids), lost))
            cols = list(zip(*out)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(cols[0]), pa.string()), pa.array(list(cols[1]), pa.int64()), pa.array(list(cols[2]), pa.int64())], names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, licenses string, n_sentences long, n_unmatched long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def sql(sentences=SENTENCES, rules=RULES) -> str:
    """The scan as SQL: pieces, then identifiers, are single characters, and an alternation in order of preference finds their sequences."""
    r = Recogniser(sentences, rules)
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    piece = {p: chr(0x4E00 + i) for i, p in enumerate(sorted(r.pieces))}
    name = {n: chr(0x5E00 + i) for i, n in enumerate(dict.fromkeys(n for n, _ in sentences))}
    sentence = {}
    for parts, n in sorted((x for xs in r.starts.values() for x in xs), key=lambda x: -len(x[0])):
        sentence.setdefault("".join(piece[p] for p in parts), name[n])
    rule = {}
    for n, seq in rules:
        rule.setdefault("".join(name[i] for i in seq), n)
    table = lambda d: "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in d.items()) + "}"
    norm = "trim(regexp_replace({}, '[^a-z0-9]+', ' ', 'g'))"
    return f"""
WITH k(s, c) AS (VALUES {", ".join(f"({quoted(p)}, {quoted(c)})" for p, c in piece.items())}),
p AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS x FROM (
  SELECT doc_id, regexp_split_to_array(regexp_replace(regexp_replace(lower(text), '{LEADER}', '', 'g'), '[.!?;:]((?:\\s)|$)', chr(1) || '\\1', 'g'), chr(1) || '|\\n[ \\t\\r]*\\n') AS a FROM documents)),
l AS (SELECT doc_id, i, generate_subscripts(b, 1) AS j, unnest(b) AS x FROM (
  SELECT doc_id, i, CASE WHEN contains(x, chr(10)) AND {norm.format("x")} NOT IN (SELECT s FROM k) THEN string_split(x, chr(10)) ELSE [x] END AS b FROM p)),
u AS (SELECT doc_id, string_agg(coalesce(c, '.'), '' ORDER BY i, j) AS u FROM (SELECT doc_id, i, j, {norm.format("x")} AS n FROM l) LEFT JOIN k ON n = s WHERE n <> '' GROUP BY 1),
s AS (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(u, '{"|".join(sentence)}'), lambda x: {table(sentence)}[x]), '') AS ids FROM u),
m AS (SELECT doc_id, ids, generate_subscripts(f, 1) AS o, unnest(f) AS x FROM (SELECT doc_id, ids, regexp_extract_all(ids, '{"|".join(rule)}|.') AS f FROM s)),
w AS (SELECT doc_id, ids, o, {table(rule)}[x] AS name FROM m),
n AS (SELECT doc_id, any_value(length(ids))::BIGINT AS n_sentences, count(*) FILTER (name IS NULL)::BIGINT AS n_unmatched FROM w GROUP BY 1),
g AS (SELECT doc_id, string_agg(name, ',' ORDER BY o) AS licenses FROM (SELECT doc_id, name, min(o) AS o FROM w WHERE name IS NOT NULL GROUP BY 1, 2) GROUP BY 1)
SELECT d.doc_id, licenses, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(n_unmatched, 0)::BIGINT AS n_unmatched
FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN g ON d.doc_id = g.doc_id
"""


SQL = sql()
