"""Licence scans: windows of texts against licence templates by the Dice coefficient over word bigrams, with DataFrame functions only.

Words run over line ends and punctuation, so that a notice is found however it is wrapped, commented or set into a paragraph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismflow.llm import common

#: Notices by which works name their licence (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-long": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-2-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
#: The least Dice coefficient of a finding.
LEAST = 0.8
#: Bytes of template text up to which the list of template bigrams is broadcast; a longer list is joined by shuffle.
SMALL = 4 << 20


def word_list(text: F.Column) -> F.Column:
    """Words of a text: runs of a-z and 0-9 of its lower-case form."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def pairs(words: F.Column) -> F.Column:
    """Adjacent words, in order; fewer than two words have none."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    return F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))


def once(df: DataFrame, column: F.Column, name: str, *keep: str) -> DataFrame:
    """``df`` with a column that is worked out once: filters on it aren't pushed through the generator."""
    return df.select(*keep, F.explode(F.array(column)).alias(name))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license_id, at, dice and n_bigrams: for each row of ``docs`` and template the window most like it, if that reaches ``least``.

    Windows begin at a bigram of the template and have as many bigrams as it, or end with the text. A window's set is its distinct bigrams of the
    template and all others of its bigrams; at is the number of its first word from 0, of equal coefficients the first one. Size bounds come first: a
    template isn't compared with a text that has too few bigrams, or too few of the template's own, for the coefficient to be reached.
    Bigrams of templates are an inverted list that bigrams of texts are looked up in, so that the number of templates doesn't matter for a text without them. Only bigrams
    that are found are shuffled, by row and template. Null and empty texts have no findings; each row counts, repeated ones too. Templates have two words or more.
    """
    templates = TEMPLATES if templates is None else templates
    if not templates or not 0 < least <= 1:
        raise ValueError("templates and a coefficient over 0 and up to 1 are needed")
    known = docs.sparkSession.createDataFrame(sorted(templates.items()), "license_id string, template string").select("license_id", pairs(word_list(F.col("template"))).alias("own"))
    known = known.select("license_id", F.size("own").alias("m"), F.size(F.array_distinct("own")).alias("t"), F.explode(F.array_distinct("own")).alias("pair"))
    if sum(map(len, templates.values())) <= SMALL:
        known = F.broadcast(known)
    # Dice >= least means that one set has least / (2 - least) of the other's size at least, and both as much in common.
    ratio = least / (2 - least)
    row = "row_id"
    texts = docs.where(F.col(text_col).isNotNull()).select(F.monotonically_increasing_id().alias(row), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    texts = once(texts, word_list(F.col("text")), "words", row, "doc_id").where("size(words) > 1")
    every = once(texts, pairs(F.col("words")), "pairs", row, "doc_id").select(row, "doc_id", F.size("pairs").alias("n"), F.posexplode("pairs").alias("at", "pair"))
    hits = every.join(known, "pair").where(F.col("n") >= F.col("t") * F.lit(ratio) - 1e-9)
    hits = hits.groupBy(row, "license_id").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("m").alias("m"), F.first("t").alias("t"), F.array_sort(F.collect_list(F.struct("at", "pair"))).alias("hits"))
    hits = hits.where(F.size("hits") >= F.col("t") * F.lit(ratio) - 1e-9)

    def window(h: F.Column, k: F.Column) -> F.Column:
        own = F.filter(F.slice("hits", k + 1, F.col("m")), lambda x: x["at"] < h["at"] + F.col("m"))
        shared, size = F.size(F.array_distinct(F.transform(own, lambda x: x["pair"]))), F.least(F.col("m"), F.col("n") - h["at"])
        return F.struct(shared.alias("shared"), (size - F.size(own) + shared).alias("n_bigrams"), h["at"].alias("at"))

    best = F.array_max(F.transform(F.transform("hits", window), lambda w: F.struct((2.0 * w["shared"] / (w["n_bigrams"] + F.col("t"))).alias("dice"), (-w["at"]).alias("at"), w["n_bigrams"].alias("n_bigrams"))))
    found = once(hits, best, "best", "doc_id", "license_id").where(F.col("best.dice") >= least)
    return found.select("doc_id", "license_id", (-F.col("best.at")).cast("bigint").alias("at"), F.col("best.dice").alias("dice"), F.col("best.n_bigrams").cast("bigint").alias("n_bigrams"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))


def _sql() -> str:
    words = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda w: w <> '')"
    rows = ", ".join(f"('{k}', '{t}')" for k, t in sorted(TEMPLATES.items()))
    return f"""
WITH w AS (SELECT license_id, {words.format("text")} AS w FROM (VALUES {rows}) v(license_id, text)),
t AS (SELECT DISTINCT license_id, len(w) - 1 AS m, w[k] || ' ' || w[k + 1] AS pair FROM w, LATERAL (SELECT unnest(range(1, len(w))) AS k) x),
s AS (SELECT license_id, count(*) AS t FROM t GROUP BY 1),
d AS (SELECT doc_id, len(w) - 1 AS n, w FROM (SELECT doc_id, {words.format("text")} AS w FROM documents WHERE text IS NOT NULL) WHERE len(w) > 1),
h AS (SELECT doc_id, n, place, license_id, m, pair FROM (SELECT doc_id, n, k - 1 AS place, w[k] || ' ' || w[k + 1] AS pair FROM d, LATERAL (SELECT unnest(range(1, len(w))) AS k) x) JOIN t USING (pair)),
v AS (SELECT a.doc_id, a.license_id, a.place, any_value(a.n) AS n, any_value(a.m) AS m, count(*) AS own, count(DISTINCT b.pair) AS shared FROM h a JOIN h b ON a.doc_id = b.doc_id AND a.license_id = b.license_id AND b.place >= a.place AND b.place < a.place + a.m GROUP BY 1, 2, 3),
f AS (SELECT doc_id, license_id, place, shared, least(m, n - place) - own + shared AS n_bigrams, t FROM v JOIN s USING (license_id))
SELECT doc_id, license_id, place::BIGINT AS "at", 2.0::DOUBLE * shared / (n_bigrams + t) AS dice, n_bigrams::BIGINT AS n_bigrams FROM f WHERE 2.0::DOUBLE * shared / (n_bigrams + t) >= {LEAST}
QUALIFY row_number() OVER (PARTITION BY doc_id, license_id ORDER BY 2.0::DOUBLE * shared / (n_bigrams + t) DESC, place) = 1
"""


OP9_SQL = _sql()
