"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingles verify them.

DataFrame expressions only. The windows of a template of L words have 3(L-1) words and start every
L-1 words, so that a passage of up to 2L-1 words, which is the template with as many words put into
it, lies whole in one of them wherever the text starts. A window that holds four fifths of the
template's shingles has a Jaccard similarity of a quarter to it, or nearly so, and one of
:data:`BANDS` bands of one row agrees with a probability of 1 - 0.75 ** BANDS. (Templates of fewer
than nine words allow no edit; their windows have 2(L-1) words.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 40

# Names of licenses and the notices by which works declare them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    (
        "BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    (
        "BSD-2-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
)


def _words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _hashes(words: Column) -> Column:
    """A hash of each shingle; none for a text of fewer words."""
    each = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(SHINGLE))))
    return F.when(F.size(words) >= SHINGLE, each).otherwise(F.array().cast("array<bigint>"))


def _shingles(words: Column) -> Column:
    each = F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.concat_ws(" ", F.slice(words, i + 1, SHINGLE)))
    return F.when(F.size(words) >= SHINGLE, each).otherwise(F.array().cast("array<string>"))


def _signature(hashes: Column) -> Column:
    """Of each band: the least of its own hashes of the shingles, and the shingle's first hash."""

    def least(band: int) -> Column:
        return F.array_min(F.transform(hashes, lambda h: F.struct(F.xxhash64(h, F.lit(band)).alias("value"), h.alias("of"))))

    return F.array(*map(least, range(BANDS)))


def window_sizes(words: int) -> tuple[int, int]:
    """Words of a window for a template of so many words, and between the starts of two windows."""
    return (3 if words >= 2 * SHINGLE - 1 else 2) * (words - 1), words - 1


def _index(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """One row per template: its name, number, words' number, shingles and signature."""
    rows = spark.createDataFrame([(n, name, text) for n, (name, text) in enumerate(templates)], "template int, license string, text string")
    rows = rows.withColumn("words", _words(F.col("text")))
    shingles = F.array_distinct(_shingles(F.col("words")))
    return rows.select("template", "license", F.size("words").alias("size"), "words", shingles.alias("shingles"), _signature(_hashes(F.col("words"))).alias("signature"))


def _phrases(rows: DataFrame, words: Column, phrases: list) -> DataFrame:
    """Matches of templates that are too short for a shingle: the first place of all their words in a row."""

    def first(phrase: list[str]) -> Column:
        there = F.exists(words, lambda w: w == phrase[0])
        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.slice(words, i + 1, len(phrase)) == F.array(*map(F.lit, phrase)))
        return F.when(there, F.array_min(at))

    found = [F.struct(F.lit(r["license"]).alias("license"), first(r["words"]).alias("at"), F.lit(r["size"]).alias("n")) for r in phrases]
    each = rows.select("_id", "text_hash", F.explode(F.array(*found)).alias("m")).where("m.at IS NOT NULL")
    return each.select("_id", "text_hash", "m.license", F.lit(1.0).alias("containment"), F.col("m.at").alias("start_word"), (F.col("m.at") + F.col("m.n")).alias("end_word"))


def _windows(known: list, words: Column, hashes: Column) -> Column:
    """Array of the windows of a text that may hold a template: size, start, words, and the bands that some template has."""
    # a band can agree only in a window that has the very shingle which is a template's least
    leasts: dict[tuple[int, int], set[int]] = {}
    values: set[int] = set()
    for r in known:
        leasts.setdefault(window_sizes(r["size"]), set()).update(s["of"] for s in r["signature"])
        values.update(s["value"] for s in r["signature"])
    every = sorted(set().union(*leasts.values()))
    hits = F.filter(F.sequence(F.lit(0), F.size(hashes) - 1), lambda i: F.get(hashes, i).isin(every))

    def of_size(i: Column, span: int, step: int, own: set[int]) -> Column:
        places = span - SHINGLE + 1
        first = F.greatest(F.lit(0), F.ceil((i - places + 1) / step)).cast("int")
        windows = F.transform(F.sequence(first, F.floor(i / step).cast("int")), lambda k: F.struct(F.lit(span).alias("size"), (k * step).alias("at")))
        return F.when(F.get(hashes, i).isin(sorted(own)), windows).otherwise(F.array().cast("array<struct<size:int,at:int>>"))

    places = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.concat(*(of_size(i, *size, own) for size, own in sorted(leasts.items()))))))

    def bands(p: Column) -> Column:
        signature = F.transform(_signature(F.slice(hashes, p["at"] + 1, p["size"] - (SHINGLE - 1))), lambda s, i: F.struct(i.alias("band"), s["value"].alias("value")))
        return F.filter(signature, lambda s: s["value"].isin(sorted(values)))

    near = F.transform(places, lambda p: F.struct(p["size"].alias("size"), p["at"].alias("at"), bands(p).alias("bands")))
    near = F.filter(near, lambda p: F.size(p["bands"]) > 0)
    return F.transform(near, lambda p: F.struct(p["size"].alias("size"), p["at"].alias("at"), p["bands"].alias("bands"), F.slice(words, p["at"] + 1, p["size"]).alias("words")))


def license_matches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """``(id_col, text_hash, license, containment, start_word, end_word)``: the best match of each license in a text.

    containment is the share of a template's five-word shingles that one window of the text has;
    start_word and end_word are the place from the first to the last of them. Of equal ones the first
    counts. Templates are a bounded parameter; one of fewer than five words is sought as it is, one
    without a word matches nothing. Null, empty and shorter texts match nothing; repeated rows of one
    id and text give their matches once; an empty table gives an empty result.
    """
    index = _index(docs.sparkSession, templates)
    known = index.select("template", "license", "size", "words", "signature").collect()  # bounded by the templates
    long, short = [r for r in known if r["size"] >= SHINGLE], [r for r in known if 0 < r["size"] < SHINGLE]
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).alias("_text"))
    found = []
    if long:
        none = F.array().cast("array<struct<size:int,at:int,bands:array<struct<band:int,value:bigint>>,words:array<string>>>")
        windows = _once(_words(F.col("_text").cast("string")), lambda w: _once(_hashes(w), lambda h: F.when(F.size(h) > 0, _windows(long, w, h)).otherwise(none)))
        each = rows.select("_id", "text_hash", F.explode(windows).alias("w")).select("_id", "text_hash", "w.*")
        each = each.select("_id", "text_hash", "size", "at", "words", F.explode("bands").alias("b")).select("_id", "text_hash", "size", "at", "words", "b.*")
        spans = F.element_at(F.create_map(*(F.lit(x) for r in {r["size"]: r for r in long}.values() for x in (r["size"], window_sizes(r["size"])[0]))), F.col("size"))
        entries = index.where(F.col("size") >= SHINGLE).select("license", spans.alias("size"), "shingles", F.posexplode("signature.value").alias("band", "value"))
        pairs = each.join(F.broadcast(entries), ["size", "band", "value"])  # templates times bands
        inside = F.transform(_shingles(F.col("words")), lambda s: F.array_contains(F.col("shingles"), s))
        share = F.size(F.array_intersect("shingles", _shingles(F.col("words")))) / F.size("shingles")
        near = pairs.withColumn("containment", share).where(F.col("containment") >= containment).withColumn("inside", inside)
        length = F.size("inside")
        near = near.select(
            "_id", "text_hash", "license", "containment", (F.col("at") + F.array_position("inside", True) - 1).cast("int").alias("start_word"),
            (F.col("at") + length - F.array_position(F.reverse("inside"), True) + SHINGLE).cast("int").alias("end_word"),
        )
        found.append(near)
    if short:
        found.append(_phrases(rows.withColumn("_words", _words(F.col("_text").cast("string"))), F.col("_words"), short))
    if not found:
        found.append(rows.where("false").select("_id", "text_hash", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("start_word"), F.lit(0).alias("end_word")))
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    first = F.struct("containment", (-F.col("start_word")).alias("start"), (-F.col("end_word")).alias("end"))
    best = every.groupBy("_id", "text_hash", "license").agg(F.max(first).alias("b"))
    return best.select(F.col("_id").alias(id_col), "text_hash", "license", F.col("b.containment").alias("containment"), (-F.col("b.start")).alias("start_word"), (-F.col("b.end")).alias("end_word"))
