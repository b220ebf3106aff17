"""License scans by MinHash bands over overlapping windows, in DataFrame functions only.

A template of ``L`` words is looked for in overlapping windows of a document.  For
templates of ``LONG`` words or more a window has 2 L words and starts every L / 2, so any
passage of 1.5 L words lies in one whole window, wherever words were put in between; one
insertion breaks four shingles, so shorter templates can't have any and still reach the
threshold, and their windows have 1.25 L words, every L / 4.

Each window is sketched by ``BANDS`` MinHash bands of one row, and a band retrieves the
templates whose sketch agrees.  A window that holds 0.8 of a template's shingles is
similar to it by 0.33 or more (long templates: 0.8 t shingles of at most 2 L - 4 + 0.2 t,
t = L - 4 being those of the template; short ones: 0.4), so the chance that no band meets
is below 0.67 ** 48, 5 in a thousand million.  Templates retrieved are verified by exact
shingle containment.  Windows without a single shingle of any template are not sketched:
their similarity to all of them is zero, and no band could rightly meet.

Templates go to the executors; they are a parameter of at most ``limit`` words.

Defined cases: a null or short text matches nothing; rows that share a doc_id are one
document in the result of ``scan`` (each text is searched by itself); a null doc_id is
kept as such; of equal matches the earliest window counts; a text may be as long as a row
can be; an empty table gives no rows; only doc_id and text are read, so no other column
can clash.  Templates need at least five words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lodestral.llm.decontam import words

SIZE = 5
BANDS = 48
LONG = 24

#: Public license notices and texts, as they are usually written.
TEMPLATES = {
    "0bsd": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE',
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-body": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "boost-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "bsd-2-clause-body": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-3-clause-endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nc-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc-by-nc-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "cc-by-nd-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "epl-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-disclaimer": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
    "isc": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-body": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mit-notice": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
}


def grid(n: int) -> tuple[int, int]:
    """Step and width of the windows for templates of ``n`` words."""
    step = max(1, n // 2 if n >= LONG else n // 4)
    return step, n + (2 * step if n >= LONG else step)


def _shingle(w: Column, i: Column) -> Column:
    return F.xxhash64(*(F.get(w, i + k) for k in range(SIZE)))


def _shingles(w: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(w) - SIZE), lambda i: _shingle(w, i))


def _sketch(shingles: Column) -> Column:
    """Per band: struct(band, least hash)."""

    def band(b: Column) -> Column:
        return F.struct(b.alias("band"), F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, b))).alias("least"))

    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)


def matches(docs: DataFrame, templates: dict[str, str] | None = None, share: float = 0.8, limit: int = 100_000) -> DataFrame:
    """(doc_id, template, start, containment): each window that holds ``share`` of a template's shingles."""
    spark = docs.sparkSession
    texts = TEMPLATES if templates is None else templates
    known = spark.createDataFrame(list(texts.items()), "template string, text string").select("template", words(F.col("text")).alias("w"))
    known = known.select("template", F.size("w").alias("len"), F.when(F.size("w") >= SIZE, F.array_distinct(_shingles(F.col("w")))).alias("s"))
    rows = known.collect()
    if any(r["s"] is None for r in rows) or sum(r["len"] for r in rows) > limit:
        raise ValueError(f"templates need {SIZE} words or more each, {limit} at most together")
    if not rows:
        return spark.createDataFrame([], "doc_id long, template string, start int, containment double")
    lengths = sorted({r["len"] for r in rows})
    hashes = sorted({h for r in rows for h in r["s"]})

    def hit(w: Column):
        return lambda i: _shingle(w, i).isin(hashes)

    def scanned(w: Column) -> Column:
        at = F.filter(F.when(F.size(w) >= SIZE, F.sequence(F.lit(0), F.size(w) - SIZE)), hit(w))
        return F.struct(w.alias("w"), at.alias("at"))

    base = docs.select("doc_id", F.transform(F.array(words(F.col("text"))), scanned)[0].alias("x")).select("doc_id", "x.w", "x.at").filter("size(at) > 0")
    classes = []
    for n in lengths:
        step, width = grid(n)
        # Windows k * step with position p inside, for the first and last such k.
        ks = F.flatten(F.transform("at", _windows(step, width)))
        classes.append(F.transform(F.array_distinct(ks), _cut(n, step, width)))
    windows = base.select("doc_id", F.explode(F.concat(*classes)).alias("v")).select("doc_id", "v.len", "v.start", F.array_distinct(_shingles(F.col("v.w"))).alias("s"))
    sketched = windows.select("doc_id", "len", "start", "s", F.explode(_sketch(F.col("s"))).alias("b"))
    bands = known.select("template", "len", F.explode(_sketch(F.col("s"))).alias("b"))
    pairs = sketched.join(F.broadcast(bands), ["len", "b"]).select("doc_id", "len", "start", "s", "template").distinct()
    checked = pairs.join(F.broadcast(known.select("template", F.col("s").alias("t"))), "template")
    return checked.select("doc_id", "template", "start", (F.size(F.array_intersect("t", "s")) / F.size("t")).alias("containment")).filter(F.col("containment") >= share)


def _windows(step: int, width: int):
    """Numbers of the windows that hold the whole shingle at a position."""
    return lambda p: F.sequence(F.greatest(F.ceil((p + SIZE - width) / step).cast("int"), F.lit(0)), F.floor(p / step).cast("int"))


def _cut(n: int, step: int, width: int):
    return lambda k: F.struct(F.lit(n).alias("len"), (k * step).alias("start"), F.slice("w", k * step + 1, width).alias("w"))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, share: float = 0.8) -> DataFrame:
    """Per doc_id: n_licenses, licenses (sorted, comma-joined) and first_word of the earliest match (-1: none)."""
    found = matches(docs, templates, share).groupBy(F.col("doc_id").alias("d")).agg(F.array_sort(F.collect_set("template")).alias("found"), F.min("start").alias("first"))
    ids = docs.select("doc_id").distinct()
    return ids.join(found, ids["doc_id"].eqNullSafe(found["d"]), "left").select(
        "doc_id", F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join("found", ","), F.lit("")).alias("licenses"), F.coalesce("first", F.lit(-1)).cast("long").alias("first_word")
    )


def oracle() -> str:
    """The same by plain containment over all windows, for DuckDB."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in TEMPLATES.items())
    low = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
WITH t AS (SELECT template, regexp_extract_all({low.format('text')}, {word}) AS w FROM (VALUES {rows}) AS v(template, text)),
ts AS (SELECT template, len(w) AS n, CASE WHEN len(w) >= {LONG} THEN len(w) // 2 ELSE greatest(1, len(w) // 4) END AS step, list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) AS s FROM t),
classes AS (SELECT DISTINCT n, step FROM ts),
d AS (SELECT * FROM (SELECT doc_id, regexp_extract_all({low.format('text')}, {word}) AS w FROM documents)
  WHERE len(list_intersect([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)], (SELECT flatten(list(s)) FROM ts))) > 0),
win AS (SELECT doc_id, n, k * step AS start, w[k * step + 1:k * step + n + CASE WHEN n >= {LONG} THEN 2 ELSE 1 END * step] AS v FROM (SELECT doc_id, w, n, step, unnest(range(0, len(w) // step + 1)) AS k FROM d, classes WHERE len(w) >= 5)),
sh AS (SELECT doc_id, n, start, [array_to_string(v[i:i + 4], ' ') FOR i IN range(1, len(v) - 3)] AS s FROM win WHERE len(v) >= 5),
m AS (SELECT DISTINCT doc_id, template, start FROM sh JOIN ts USING (n) WHERE len(list_intersect(ts.s, list_distinct(sh.s))) >= 0.8 * len(ts.s)),
g AS (SELECT doc_id, count(DISTINCT template) AS n_licenses, string_agg(DISTINCT template, ',' ORDER BY template) AS licenses, min(start) AS first_word FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_licenses, 0)::BIGINT AS n_licenses, coalesce(licenses, '') AS licenses, coalesce(first_word, -1)::BIGINT AS first_word
FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN g USING (doc_id)
"""
