"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Only DataFrame functions run. A text becomes five-word shingle hashes; what no
template holds cannot help a match and is left out at once, so all that
follows is a few rows per licensed document. Templates fall into classes by
their number of shingles (powers of two). For each class c windows of 2c
shingle positions start every c, so a template of the class lies whole within
one. MinHash is an aggregation (BANDS minima per window), retrieval a join on
(class, band, minimum), and verification counts the template's shingles in the
window.

Band settings: a window that holds the share s of a template, and at most as
many other template shingles as the template has, is at least s / 2 similar to
it; with BANDS bands of one row it collides with probability 1 - (1 - s/2) **
BANDS, which for s = 0.8 and 40 bands is above 1 - 2e-9.

Words are runs of letters and digits, joined by single dots or hyphens, A-Z
lower-cased. Defined results: null texts and texts under five words match
nothing; a template found several times in a document is one row; repeated
rows are found once per doc_id; null doc_id stays null; an empty table gives
an empty result; extra columns are ignored. Templates must have five words.
"""

from __future__ import annotations

import string
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.common import saved

WORDS = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
SHINGLE = 5
BANDS = 40

#: License notices to look for (fixed values: wording of the public licenses).
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "MIT line": "Released under the MIT License",
    "MIT line 2": "This project is licensed under the MIT License",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3",
    "GPL line": "Licensed under the GNU General Public License",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0",
    "CC-BY line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0 line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "All rights reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher",
}


def _with_shingles(df: DataFrame) -> DataFrame:
    """df plus shingles: hashes of every five words of text in a row, in order; null under five words."""
    low = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    df = df.withColumn("__words", F.regexp_extract_all(low, F.lit(WORDS), F.lit(0)))
    starts = F.sequence(F.lit(0), F.size("__words") - SHINGLE)
    hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(F.col("__words"), i + j) for j in range(SHINGLE)]))
    return df.withColumn("shingles", F.when(F.size("__words") >= SHINGLE, hashed)).drop("__words")


def _minima() -> list[Column]:
    return [F.min(F.xxhash64("h", F.lit(i))).alias(f"m{i}") for i in range(BANDS)]


def _bands() -> Column:
    return F.posexplode(F.array(*[F.col(f"m{i}") for i in range(BANDS)])).alias("band", "least")


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """doc_id, license, n_shingles, n_matched, containment, position (shingle of the best window's first match) of each match."""
    spark = docs.sparkSession
    known = _with_shingles(spark.createDataFrame(list(templates.items()), "license string, text string"))
    known = known.select("license", F.explode(F.array_distinct("shingles")).alias("h"))
    sizes = known.groupBy("license").agg(F.count(F.lit(1)).alias("n"), *_minima()).withColumn("c", F.pow(F.lit(2.0), F.ceil(F.log2("n"))).cast("long"))
    listed = [r[0] for r in known.select("h").distinct().collect()]  # of the given templates only
    classes = sorted(r[0] for r in sizes.select("c").distinct().collect())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The row number is added last: predicates don't move below it, where they would repeat the shingling.
    rows = _with_shingles(rows).select("doc_id", F.monotonically_increasing_id().alias("row"), "shingles").filter(F.arrays_overlap("shingles", F.array(*[F.lit(h) for h in listed])))
    hits = rows.select("doc_id", "row", F.posexplode("shingles").alias("at", "h")).filter(F.col("h").isin(listed))
    hits = saved(hits)
    c = F.explode(F.array(*[F.lit(x) for x in classes])).alias("c")
    cell = F.floor(F.col("at") / F.col("c"))
    windows = hits.select("*", c).select("*", F.explode(F.array(cell, cell - 1)).alias("window"))
    drawn = windows.groupBy("row", "c", "window").agg(*_minima()).select("row", "c", "window", _bands())
    asked = sizes.select("license", "n", "c", _bands())
    pairs = drawn.join(F.broadcast(asked), ["c", "band", "least"]).select("row", "c", "window", "license", "n").distinct()
    # Both sides grow with the input, and their compressed files hide their size: never a broadcast.
    found = windows.join(pairs.hint("merge"), ["row", "c", "window"]).join(F.broadcast(known), ["license", "h"])
    found = found.groupBy("doc_id", "row", "window", "license", "n").agg(F.count_distinct("h").alias("n_matched"), F.min("at").alias("at"))
    found = found.filter(F.col("n_matched") >= F.col("n") * least)
    best = F.max(F.struct("n_matched", (-F.col("at")).alias("at"))).alias("x")
    out = found.groupBy("doc_id", "license", F.col("n").alias("n_shingles")).agg(best)
    return out.select("doc_id", "license", "n_shingles", "x.n_matched", (F.col("x.n_matched") / F.col("n_shingles")).alias("containment"), (-F.col("x.at")).cast("long").alias("position"))


def sql(templates: Mapping[str, str] = TEMPLATES) -> str:
    """The same result by exact containment in every window, without MinHash, for DuckDB."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    values = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in templates.items())
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = f"regexp_extract_all({low}, '{WORDS}')"
    gram = "unnest(range(1, len(w) - 3)) as u(i)"
    return f"""
with t as (select license, {words.format('body')} as w from (values {values}) as v(license, body)),
k as (select distinct license, array_to_string(w[i:i+4], ' ') as h from t, {gram}),
s as (select license, count(*) as n, (2 ** ceil(log2(count(*))))::bigint as c from k group by license),
d as (select row_number() over () as rid, doc_id, {words.format('text')} as w from documents where text is not null),
g as (select rid, doc_id, i - 1 as pos, array_to_string(w[i:i+4], ' ') as h from d, {gram}),
hits as (select rid, doc_id, pos, k.license, k.h, s.n, s.c from g join k using (h) join s using (license)),
win as (select *, pos // c - o as win from hits, unnest([0, 1]) as x(o)),
f as (select rid, doc_id, license, n, win, count(distinct h) as m, min(pos) as pos from win group by all having count(distinct h) >= 0.8 * n)
select doc_id, license, n::bigint as n_shingles, max(m)::bigint as n_matched, max(m) / n::double as containment,
  min_by(pos, (-m, pos))::bigint as position
from f group by doc_id, license, n
"""
