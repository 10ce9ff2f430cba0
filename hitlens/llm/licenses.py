"""License notices in documents, found by MinHash and verified by shingle containment.

Words are lower-cased runs of letters and digits, shingles are five words. The shingles of a text are
taken in overlapping windows of ``WINDOW`` shingles, which also overhang both ends of the text and hold
what is there; a band is the least or the greatest hash in a window under one of ``HASHES`` hash
functions. A template is retrieved where a window and one of the template's windows agree in a band.
Where a text holds ``WINDOW`` shingles of a template in a row, this is certain, as both have the same
window; a shingle at an end of the text is a band itself; one further inside is a band of none of its
windows with the chance ``miss_chance()``, 3e-4 on average over all shingles. Templates of fewer than
``WINDOW`` shingles would depend on that chance, so each of their shingles is a key as it is and they
are never missed. Retrieved templates are then verified: the share of a template's shingles that the
text holds must reach the threshold, 0.8 unless given.

Only built-in expressions run on the documents. Templates are a parameter of bounded size; those of
fewer than five words are refused. Null and empty texts match nothing; repeated rows each match; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import product
from math import comb

from pyspark.sql import Column, DataFrame, functions as F

K, WINDOW, HASHES, CONTAINMENT = 5, 3, 3, 0.8
# Most shingles of all templates together.
MOST_SHINGLES = 50_000

# Public notices, as they stand in files.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to "
        "in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
        "for the specific language governing permissions and limitations under the License."),
    "MIT-line": "Released under the MIT License",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions"),
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version."),
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0",
    "BSD-condition": (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met"),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at "
        "https://mozilla.org/MPL/2.0/."),
}


def miss_chance(window: int = WINDOW, hashes: int = HASHES, shared: int = 1) -> float:
    """Chance that a shingle inside a text is a band of none of the windows that hold it.

    This is so if each of them has a lower and a higher neighbour of it. They share neighbours, so
    it is counted over all patterns of lower and higher ones, under random hashes. 0 for ``shared``
    shingles in a row that fill a window.
    """
    if shared >= window:
        return 0.0
    near = 2 * (window - 1)
    patterns = [p for p in product((0, 1), repeat=near)
                if all(0 < sum(p[i:i + window - 1]) < window - 1 for i in range(window))]
    one = sum(1 / ((near + 1) * comb(near, sum(p))) for p in patterns)
    return one ** hashes


def _with_shingles(df: DataFrame, text: str, k: int) -> DataFrame:
    """Add ``_sh``: hashes of the text's k-word shingles, in order."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))),
                                    r"[^\p{L}\p{N}]+", " "))
    df = df.withColumn("_words", F.split(plain, " "))
    df = df.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    found = F.transform(F.sequence(F.lit(0), F.size("_hashes") - k), lambda i: F.xxhash64(
        *[F.get("_hashes", i + j) for j in range(k)]))
    return df.withColumn("_sh", F.when(F.size("_hashes") >= k, found).otherwise(
        F.array().cast("array<bigint>"))).drop("_words", "_hashes")


def _with_bands(df: DataFrame, window: int, hashes: int) -> DataFrame:
    """Add ``_band0`` ...: for each hash function the least and the greatest hash per window.

    Windows overhang both ends by up to ``window - 1`` shingles.
    """
    for n in range(hashes):
        order = f"_order{n}"
        df = df.withColumn(order, F.col("_sh") if n == 0 else F.transform(
            "_sh", lambda x: F.xxhash64(F.lit(n), x)))

        def windows(pick, of) -> Column:
            # places beyond the end are null and left out; no array is made of each window
            inside = F.transform(
                F.sequence(F.lit(0), F.greatest(F.size(order) - window, F.lit(0))),
                lambda i: of(*[F.get(order, i + j) for j in range(window)]) if window > 1 else F.get(order, i))
            ends = [pick(F.slice(order, at, n)) for n in range(1, window) for at in (
                F.lit(1), F.greatest(F.size(order) - n, F.lit(0)) + 1)]
            return F.concat(inside, F.array(*ends)) if ends else inside

        some = F.size(order) > 0
        none = F.array().cast("array<bigint>")
        df = df.withColumn(f"_band{2 * n}", F.when(some, windows(F.array_min, F.least)).otherwise(none))
        df = df.withColumn(f"_band{2 * n + 1}", F.when(some, windows(F.array_max, F.greatest)).otherwise(none))
    return df.drop(*[f"_order{n}" for n in range(hashes)])


def _literal(values) -> Column:
    return F.array(*[F.lit(v) for v in sorted(values)]).cast("array<bigint>")


def license_matches(df: DataFrame, templates: Mapping[str, str] | None = None, *,
                    id_col: str = "doc_id", text_col: str = "text",
                    containment: float = CONTAINMENT, k: int = K, window: int = WINDOW,
                    hashes: int = HASHES) -> DataFrame:
    """One row per document and template: id, template, containment, shingles, first_word.

    ``shingles`` counts the template's shingles in the text, ``first_word`` is the place of the
    first of them.
    """
    spark = df.sparkSession
    templates = TEMPLATES if templates is None else templates
    listed = F.array(*[F.struct(F.lit(n).alias("template"), F.lit(t).alias("_text"))
                       for n, t in sorted(templates.items())])
    known = spark.range(1).select(F.inline(listed)) if templates else None
    bands = [f"_band{n}" for n in range(2 * hashes)]
    rows = [] if known is None else (
        _with_bands(_with_shingles(known, "_text", k), window, hashes).collect())
    short = [r["template"] for r in rows if not r["_sh"]]
    if short:
        raise ValueError(f"templates of fewer than {k} words: {short}")
    shingles = {r["template"]: set(r["_sh"]) for r in rows}
    if sum(map(len, shingles.values())) > MOST_SHINGLES:
        raise ValueError(f"more than {MOST_SHINGLES} shingles of templates")
    # templates of each key, by band: the index of a bounded library
    index = sorted({(n, key, r["template"]) for r in rows for n, b in enumerate(bands)
                    for key in r[b]}
                   # and of the shingles of templates that fill no window
                   | {(len(bands), key, name) for name, own in shingles.items()
                      if len(own) < window for key in own})
    parts = _with_bands(_with_shingles(df.select(
        df[id_col].alias("_id"), df[text_col].cast("string").alias("_text")), "_text", k),
        window, hashes)
    keys = [{key for m, key, _ in index if m == n} for n in range(len(bands) + 1)]
    met = F.concat(*[_tagged(F.array_intersect(b, _literal(keys[n])), n)
                     for n, b in enumerate([*bands, "_sh"]) if n < len(bands) or keys[n]])
    held = F.array_intersect("_sh", _literal(set().union(*shingles.values())))
    # the row number also keeps the optimizer from moving filters below the arrays, where it
    # would compute them anew for every element
    parts = parts.select("_id", "_sh", met.alias("_met"), held.alias("_held"),
                         F.monotonically_increasing_id().alias("_row"))
    parts = parts.where(F.size("_met") > 0).select("_id", "_row", "_met", "_held", F.transform(
        "_held", lambda x: F.array_position("_sh", x)).alias("_places"))
    if index:
        lookup = spark.range(1).select(F.inline(F.array(*[
            F.struct(F.lit(n).alias("band"), F.lit(key).cast("bigint").alias("key"),
                     F.lit(t).alias("template")) for n, key, t in index])))
    else:
        lookup = spark.range(0).selectExpr("0 as band", "id as key", "'' as template")
    found = (parts.select("*", F.inline("_met")).drop("_met")
             .join(F.broadcast(lookup), ["band", "key"])
             .groupBy("_id", "_row", "_held", "_places", "template").agg(F.count("*").alias("_n")))
    own = F.lit(None).cast("array<bigint>")
    for name, values in shingles.items():
        own = F.when(F.col("template") == name, _literal(values)).otherwise(own)
    found = found.withColumn("_own", own)
    found = found.withColumn("shingles", F.size(F.array_intersect("_held", "_own")).cast("long"))
    places = F.filter(F.zip_with("_held", "_places", lambda h, p: F.when(
        F.array_contains("_own", h), p)), lambda p: p.isNotNull())
    return found.select(
        F.col("_id").alias(id_col), "template",
        (F.col("shingles") / F.size("_own")).alias("containment"), "shingles",
        (F.array_min(places) - 1).cast("long").alias("first_word")).where(
        F.col("containment") >= containment)


def _tagged(keys: Column, band: int) -> Column:
    return F.transform(keys, lambda key: F.struct(F.lit(band).alias("band"), key.alias("key")))


def oracle(table: str = "documents", threshold: float = CONTAINMENT) -> str:
    """DuckDB SQL for the matches with the built-in templates: plain containment of every one."""
    names = ", ".join("('{}', '{}')".format(n, t.replace("'", "''"))
                      for n, t in sorted(TEMPLATES.items()))

    def shingled(key, text, source):
        words = (f"string_split(trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', "
                 "'g')), ' ')")
        run = " || ' ' || ".join(["w", *[f"lead(w, {j}) over o" for j in range(1, K)]])
        return f"""
  select {key} k, sh, min(p) p from (
    select {key}, p, {run} sh from (
      select {key}, unnest(ws) w, generate_subscripts(ws, 1) p from (
        select {key}, {words} ws from {source}))
    window o as (partition by {key} order by p)) where sh is not null group by all"""

    return f"""
with t as ({shingled('template', 'body', f'(values {names}) v(template, body)')}),
d as ({shingled('doc_id', "coalesce(text, '')", table)}),
m as (select d.k doc_id, t.k as template, count(*)::bigint shingles, min(d.p)::bigint - 1 first_word
      from d join t using (sh) group by all)
select doc_id, template, shingles / n::double containment, shingles, first_word
from m join (select k as template, count(*) n from t group by k) using (template)
where shingles / n::double >= {threshold}"""
