"""Licence scan: Dice coefficient over word bigrams between passages of a text and licence templates.

Native: DataFrame functions only. Passages are the whole text, its paragraphs and its lines, normalised
to lower-case runs of letters and digits. A passage and a template meet only where the smaller of their
bigram counts is at least t / (2 - t) of the larger, below which the coefficient cannot reach the threshold t;
templates are spread over the counts that they may meet, so that this is an equi-join. Bigrams count with
their repeats. Null, empty and one-word texts match nothing. Repeated rows are reported once for each row's id.
The template table is a parameter of bounded size and is broadcast.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

#: Short notices and the first paragraphs of common licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def normal_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def template_rows(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple]:
    """(n, template, license_id, n_bigrams, bigrams, counts) for every bigram count n that the template may meet."""
    rows = []
    for i, (name, text) in enumerate(templates):
        w = normal_words(text)
        grams = Counter(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))
        size, share = len(w) - 1, threshold / (2 - threshold)
        for n in range(max(1, math.ceil(size * share - 1e-9)), math.floor(size / share + 1e-9) + 1):
            rows.append((n, i, name, size, list(grams), [*grams.values()]))
    return rows


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license_id, dice (best, 6 digits), n_passages: the licences that a passage of each text matches."""
    spark = docs.sparkSession
    rows = template_rows(templates, threshold)
    table = spark.createDataFrame(rows, "n int, template int, license_id string, t_size int, grams array<string>, counts array<int>")
    sizes, known = sorted({r[0] for r in rows}), sorted({g for r in rows for g in r[4]})
    vocabulary = sorted({w for g in known for w in g.split(" ")})
    text = F.regexp_replace(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}\n]+", " ")
    flat = lambda x: F.filter(F.split(x, r"[ \n]+", -1), lambda w: w != "")
    passages = F.array_distinct(F.flatten(F.array(F.array(F.col("_t")), F.split("_t", r"\n[ \n]*\n", -1), F.split("_t", "\n", -1))))
    arrays = F.transform(passages, flat)
    # every passage that can match shares words with the templates; the others end here
    able = F.filter(arrays, lambda a: (F.size(a) - 1).isin(sizes) & F.exists(a, lambda w: w.isin(vocabulary)))
    out = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t")).select("doc_id", F.explode(F.array_distinct(able)).alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    out = out.select("doc_id", F.sha2(F.array_join("w", " "), 256).alias("passage"), (F.size("w") - 1).alias("n"), pairs.alias("a"))
    out = out.filter(F.exists("a", lambda x: x.isin(known)))
    out = out.join(F.broadcast(table), "n").withColumn("shared", F.array_intersect("grams", "a")).filter("2 * size(shared) > 0")
    both = F.aggregate(F.zip_with("grams", "counts", lambda g, c: F.least(c, F.size(F.filter("a", lambda x: x == g)))), F.lit(0), lambda s, x: s + x)
    out = out.withColumn("dice", 2.0 * both / (F.col("n") + F.col("t_size"))).filter(F.col("dice") >= threshold - 1e-12)
    return out.groupBy("doc_id", "license_id").agg(F.round(F.max("dice"), 6).alias("dice"), F.countDistinct("passage").alias("n_passages"))
