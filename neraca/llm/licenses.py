"""Licence scan: known sentences, then ordered rules over their identifiers.

A text is cut into sentences, each normalised to lower-case words; a known one is replaced by its
identifier, and other sentences drop out.  What no known sentence covers as a whole is tried
line by line, so a notice on a line of its own is seen next to unfinished prose.  A rule is a sequence of
identifiers; a licence is found where its rule occurs unbroken in the sequence of a document.

Everything is built-in functions on the row of a document: no shuffle, no Python on executors.  Defined
results: null and empty texts have no sentence; repeated sentences repeat in the sequence, a licence
is named once; the order of rules is the order of the result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Published licence texts and the usual notices.
NOTICES = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT"],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "Released under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License")',
    ],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-only"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "bsd-2-clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "bsd-3-clause": ["Released under the BSD 3-Clause License.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "isc": ["Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0-1.0": ["Licensed under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0"],
    "proprietary": ["All rights reserved.", "Confidential and proprietary."],
}
TEXTS = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "gpl-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
}
#: The third clause that makes two clauses the three-clause licence.
THIRD_CLAUSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."

#: Where a sentence ends; where words end.
ENDS, GAPS = r"[.;!?]+[ \t\r\n]+|\n[ \t\r]*\n", "[^A-Za-z0-9]+"


def normal(sentence: str) -> str:
    return re.sub(GAPS, " ", sentence).strip().lower()


def sentences(text: str) -> list[str]:
    return [n for s in re.split(ENDS, text) if (n := normal(s))]


def knowledge() -> tuple[dict[str, str], list[tuple[str, list[str]]]]:
    """Identifier of each normalised sentence; licence and identifiers of each rule, longest first."""
    known: dict[str, str] = {}
    rules: list[tuple[str, list[str]]] = []

    def sequence(name: str, parts: list[str]) -> list[str]:
        return [known.setdefault(p, f"{name}/{sum(v.startswith(name + '/') for v in known.values()) + 1}") for p in parts]

    for name, text in TEXTS.items():
        rules.append((name, sequence(name, sentences(text))))
    rules.append(("bsd-3-clause", [*next(ids for name, ids in rules if name == "bsd-2-clause"), *sequence("bsd-3-clause", sentences(THIRD_CLAUSE))]))
    for name, notices in NOTICES.items():
        rules += [(name, sequence(name, sentences(n))) for n in notices]
    rules.sort(key=lambda r: -len(r[1]))
    return known, rules


def sequence_of(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order."""
    table = F.create_map(*[F.lit(x) for kv in knowledge()[0].items() for x in kv])

    def known(sentence: Column) -> Column:
        return F.element_at(table, F.lower(F.trim(F.regexp_replace(sentence, GAPS, " "))))

    def found(sentence: Column) -> Column:
        whole = known(sentence)
        by_line = F.when(F.instr(sentence, "\n") > 0, F.transform(F.split(sentence, "\n"), known))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(by_line)

    each = F.filter(F.transform(F.split(text, ENDS), found), lambda x: x.isNotNull())
    return F.coalesce(F.filter(F.flatten(each), lambda x: x.isNotNull()), F.array().cast("array<string>"))


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with sentence_ids, and licenses: every licence with a rule in the sequence."""
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(f",{','.join(ids)},").alias("ids")) for name, ids in knowledge()[1]])
    ids = F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(","))
    named = F.transform(F.filter(rules, lambda r: F.instr(F.col("__ids"), r["ids"]) > 0), lambda r: r["name"])
    marked = docs.withColumn("sentence_ids", sequence_of(F.col(text))).withColumn("__ids", ids)
    some = F.when(F.size("sentence_ids") > 0, F.array_distinct(named)).otherwise(F.array().cast("array<string>"))
    return marked.withColumn("licenses", some).drop("__ids")


def oracle() -> str:
    known, rules = knowledge()
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    table = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in known.items())
    listed = ", ".join(f"({n}, {quoted(name)}, {quoted(',' + ','.join(ids) + ',')})" for n, (name, ids) in enumerate(rules))
    norm = "lower(trim(regexp_replace(x, '[^A-Za-z0-9]+', ' ', 'g')))"
    return f"""
WITH known(norm, id) AS (VALUES {table}), rules(n, name, ids) AS (VALUES {listed}),
cut AS (SELECT doc_id, string_split_regex(text, '[.;!?]+[ \t\r\n]+|\n[ \t\r]*\n') AS s FROM documents),
units AS (SELECT doc_id, unnest(s) AS x, generate_subscripts(s, 1) AS k FROM cut),
tried AS (SELECT u.*, id FROM units u LEFT JOIN known ON norm = {norm}),
lines AS (SELECT doc_id, k, unnest(string_split(x, chr(10))) AS x, generate_subscripts(string_split(x, chr(10)), 1) AS j
          FROM tried WHERE id IS NULL),
hits AS (SELECT doc_id, k, 0 AS j, id FROM tried WHERE id IS NOT NULL
         UNION ALL SELECT doc_id, k, j, id FROM lines JOIN known ON norm = {norm}),
seq AS (SELECT doc_id, string_agg(id, ',' ORDER BY k, j) AS ids, count(*) AS n FROM hits GROUP BY doc_id),
lic AS (SELECT doc_id, name, min(rules.n) AS n FROM seq JOIN rules ON contains(',' || seq.ids || ',', rules.ids) GROUP BY ALL)
SELECT d.doc_id, coalesce(seq.n, 0) AS n_sentences, coalesce(seq.ids, '') AS sentence_ids,
       coalesce((SELECT string_agg(name, ',' ORDER BY lic.n) FROM lic WHERE lic.doc_id = d.doc_id), '') AS licenses
FROM documents d LEFT JOIN seq USING (doc_id)"""


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scanned(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"))
    return found.select(
        "doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
    )
