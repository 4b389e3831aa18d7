"""License scan: sparse TF-IDF cosine of lines and whole files to templates, then inheritance by directory.

Every line that holds a cue word, windows of neighbouring lines around it and their sentences, the leading comment,
and every file with such a line as a whole, whatever its length, become sparse TF-IDF vectors over the templates' terms; their cosine to each template is a join on the term. Whole files are compared
with full license texts too. A file's own license is the best match of its lines (headers, footers) or of itself. A
license file is one that matches as a whole, whose matched pieces make up most of its words, or that matches and has
the name of one (LICENSE, COPYING). Files without a license take that of the nearest ancestor directory that holds a
license file, by a join of their ancestor paths.

Defined results. Null text counts as empty, a null path as a file without directory. One row per input row, with its
id where ``id_col`` names one (null, negative and repeated ids included); an empty table gives an empty result. Of equal
cosines the alphabetically first license wins; of several license files in one directory the best cosine, then the
alphabetically first. Further columns are ignored. The template table has one row per term and license.
"""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Notices that announce a license (fixed values); further templates can be passed.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the BSD 3-Clause License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights. Public domain dedication CC0 1.0."],
}
#: Cue words; those of two may be parted by a line break and comment marks.
_GAP = r"[\s#*/;%-]+"
CUES = rf"(?i)licen[sc]e|copyright|spdx|redistribution|public{_GAP}domain|free{_GAP}software|hereby{_GAP}granted|creative{_GAP}commons"
#: Lines before and after a line with a cue that are joined to it as a window, and the window whose sentences are judged.
WINDOWS, AROUND = ((0, 1), (1, 0), (1, 1), (2, 3), (2, 24)), 6
COMMENT, MARKS = r"^\s*(?:#|//|/?\*|--|;|%|<!--|\"\"\"|$)", r"^[\s#*/;%<!\"-]+|\s*(?:\*/|-->)\s*$"
SENTENCE = r"(?<=[.;!?])\s+(?=[A-Z])"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
#: Cosine of a match, and share of a license file's words that its matched pieces hold.
LEAST, SHARE = 0.6, 0.6
#: Names of license files.
NAMED = r"(?i)(?:^|/)(?:un)?(?:licen[sc]e|copying|copyright)[^/]*$"


def terms(text: str) -> list[str]:
    import re

    return re.findall(TERM, text.lower())


def template_weights(templates: dict[str, list[str]]) -> list[tuple[int, str, str, float, float]]:
    """template, license, term, weight (unit length), idf."""
    texts = [(name, Counter(terms(t))) for name, group in sorted(templates.items()) for t in group]
    seen = Counter(t for _, c in texts for t in c)
    idf = {t: math.log((1 + len(texts)) / (1 + n)) + 1 for t, n in seen.items()}
    rows = []
    for i, (name, c) in enumerate(texts):
        size = math.sqrt(sum((n * idf[t]) ** 2 for t, n in c.items()))
        rows += [(i, name, t, n * idf[t] / size, idf[t]) for t, n in sorted(c.items())]
    return rows


def full_texts() -> dict[str, list[str]]:
    """License: its full text, from the files beside this one (read on the driver)."""
    return {p.stem: [p.read_text(encoding="utf-8")] for p in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}


def cosines(pieces: DataFrame, weights: list[tuple[int, str, str, float, float]], count: int) -> DataFrame:
    """key, whole, share, piece, license, cosine of each piece (key, piece, whole, share, text) and template of ``weights``, the best only."""
    table = pieces.sparkSession.createDataFrame(weights, "template int, license string, term string, weight double, idf double")
    unseen = math.log(1 + count) + 1  # idf of terms that no template has
    of = ["key", "piece", "whole", "share"]
    tokens = pieces.select(*of, F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("term"))
    counts = tokens.groupBy(*of, "term").agg(F.count(F.lit(1)).alias("tf"))
    # the template table is as large as the templates: safe to broadcast
    known = F.broadcast(table.select("term", "idf").distinct())
    weighted = counts.join(known, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    vectors = weighted.groupBy(*of).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"), F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "w"))).alias("terms"))
    products = vectors.select(*of, "size", F.explode("terms").alias("t")).select(*of, "size", "t.term", "t.w")
    sums = products.join(F.broadcast(table.drop("idf")), "term").groupBy(*of, "size", "template", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    found = sums.select(*of, "license", F.round(F.col("dot") / F.col("size"), 6).alias("cosine"))
    best = F.min_by(F.struct("license", "cosine"), F.struct((-F.col("cosine")).alias("c"), "license"))
    return found.groupBy(*of).agg(best.alias("b")).select(*of, "b.license", "b.cosine")


def scan(files: DataFrame, templates: dict[str, list[str]] | None = None, least: float = LEAST, path_col: str = "path", text_col: str = "text", id_col: str | None = None) -> DataFrame:
    """path, license, cosine, origin (own, inherited or null), license_path (and doc_id) for each row of files."""
    full = {} if templates else full_texts()
    templates = templates or TEMPLATES
    doc = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    rows = files.select(doc.alias("doc_id"), F.col(path_col).alias("path"), C.text_or_empty(text_col).alias("text"))
    # one pass: every row gets a number, texts without a cue are left out; written, so the numbers hold
    base = C.written(rows.select(F.monotonically_increasing_id().alias("key"), "doc_id", "path", F.when(F.col("text").rlike(CUES), F.col("text")).alias("text")), "license-rows")
    words = lambda text: F.regexp_count(F.lower(text), F.lit(TERM))
    cued = base.where("text is not null").withColumn("words", F.greatest(words(F.col("text")), F.lit(1)))
    # pieces of a file: its lines with a cue and their sentences, as other sentences would dilute the notice; then windows
    raw = F.split("text", r"\r\n|\n|\r")
    judged = cued.select("key", "words", "text", raw.alias("raw"), F.transform(raw, lambda x: F.regexp_replace(x, MARKS, "")).alias("plain"))
    at = F.filter(F.sequence(F.lit(1), F.size("plain")), lambda i: F.concat_ws(" ", F.element_at("plain", i), F.get("plain", i)).rlike(CUES))
    joined = lambda i, before, after: F.array_join(F.slice("plain", F.greatest(i - before, F.lit(1)), F.least(i, F.lit(before + 1)) + after), " ")
    cue = lambda x: x.rlike(CUES)
    single = F.flatten(F.transform(F.filter("raw", cue), lambda x: F.split(x, SENTENCE)))
    sentences = F.flatten(F.transform("at", lambda i: F.split(joined(i, AROUND, AROUND), SENTENCE)))
    windows = F.flatten(F.transform("at", lambda i: F.array(*(joined(i, x, y) for x, y in WINDOWS))))
    code = F.array_position(F.transform("raw", lambda x: x.rlike(COMMENT)), False).cast("int")
    head = F.array_join(F.slice("plain", 1, F.greatest(code - 1, F.lit(0))), " ")
    block = F.regexp_extract("text", r"^\s*/\*([\s\S]*?)\*/", 1)
    judged = judged.withColumn("at", at)
    cued_of = lambda texts, kind: F.transform(F.array_distinct(F.filter(texts, cue)), lambda x: F.struct(F.lit(kind).alias("single"), x.alias("text")))
    pieces = [cued_of(single, True), cued_of(F.concat(sentences, windows, F.array(head, block)), False)]
    lines = judged.select("key", "words", F.explode(F.concat(*pieces)).alias("p"))
    share = F.when(F.col("p.single"), words(F.col("p.text")) / F.col("words")).otherwise(0.0)
    lines = lines.select("key", F.xxhash64("p.single", "p.text").alias("piece"), F.lit(False).alias("whole"), share.alias("share"), F.col("p.text").alias("text"))
    whole = cued.select("key", F.lit(-1).cast("long").alias("piece"), F.lit(True).alias("whole"), F.lit(1.0).alias("share"), "text")
    matches = cosines(lines.unionByName(whole), template_weights(templates), sum(map(len, templates.values())))
    if full:
        every = {name: [*templates.get(name, []), *full.get(name, [])] for name in {*templates, *full}}
        last = {sum(len(every[m]) for m in sorted(every) if m <= name) - 1 for name in full}
        matches = matches.unionByName(cosines(whole, [w for w in template_weights(every) if w[0] in last], sum(map(len, every.values()))))
    best = C.written(matches.where(F.col("cosine") >= least), "license-matches")
    rank = F.struct((-F.col("cosine")).alias("c"), "license")
    own = best.groupBy("key").agg(F.min_by(F.struct("license", "cosine"), rank).alias("o"), (F.max("whole") | (F.sum(F.when(~F.col("whole"), F.col("share"))) >= SHARE)).alias("made_up"))
    is_file = (F.col("made_up") | F.col("path").rlike(NAMED)).alias("is_file")
    own = C.written(own.select("key", "o.license", "o.cosine", "made_up"), "license-of-keys")
    named = C.written(base.select("key", "doc_id", "path").join(own, "key", "left").select("doc_id", "path", "license", "cosine", is_file), "license-own")
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", ""))
    given = named.where("is_file and license is not null and path is not null").select(F.coalesce(folder, F.lit("")).alias("dir"), "license", "cosine", "path").groupBy("dir").agg(F.min_by(F.struct("license", "cosine", F.col("path").alias("license_path")), F.struct((-F.col("cosine")).alias("c"), "license", "path")).alias("g"))
    given = C.written(given, "license-dirs")  # written, as near is, so that the join of a hot directory can be split
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    bare = C.written(named.where("license is null and path is not null").select("path").distinct(), "license-bare")
    near = bare.select("path", F.explode(ups).alias("dir")).join(given, "dir").groupBy("path").agg(F.max_by("g", F.length("dir")).alias("g"))
    near = C.written(near.select(F.col("path").alias("_path"), F.col("g.license").alias("l"), F.col("g.cosine").alias("c"), F.col("g.license_path").alias("p")), "license-near")
    out = named.join(near, (named.path == near._path) & named.license.isNull(), "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("l").isNotNull(), "inherited")
    C.removed(own, given, bare, base)
    columns = ["path", F.coalesce("license", "l").alias("license"), F.coalesce("cosine", "c").alias("cosine"), origin.alias("origin"), F.when(F.col("license").isNull(), F.col("p")).alias("license_path")]
    return out.select(*(["doc_id"] if id_col else []), *columns)
