"""Licence scans: a trained paragraph classifier, confirmed against templates, in DataFrame operations.

Scored are lines, and paragraphs of several lines: runs of lines with letters or digits, so that notices
wrapped in source files, behind comment marks, are whole. A paragraph's family counts if none of its
lines has it; then families of its lines whose name is within its own (CC-BY in CC-BY-SA) are parts of
it and don't count. The features of both are the distinct word 2- and 3-grams that licence templates have;
a softmax regression over them tells licence families from the unknown class. It is trained on the
driver from the templates (with words dropped and other words around; as unknown: parts of them, and notices whose names are replaced) and a bounded sample of the
documents' own lines, of BACKGROUND, as unknown; its temperature and the least probability of a known
family are set on variants and lines left out. A prediction counts if its line or paragraph also has CONFIRM
of the 2-grams of one of that family's templates. Texts without any of the words that every confirmed
paragraph has one of (`telling`) have no licence; all others are scored by explode, broadcast joins with
the templates' n-grams and their weights, and sums by line and paragraph. n_paragraphs counts filled lines.

Defined cases: a null or empty text has no paragraphs and no licence; repeated documents each give a
row; equal probabilities go to the smaller family name; other columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

# Notices by which licences of each family are commonly declared, heads and grants of their full texts.
TEMPLATES = {
    "0BSD": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
        "SPDX-License-Identifier: 0BSD",
    ],
    "AGPL": [
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
        "SPDX-License-Identifier: AGPL",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "Released under the Apache 2.0 license.",
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "SPDX-License-Identifier: BSD",
    ],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY",
        "This work is licensed under a Creative Commons Attribution License",
        "This work is licensed under a Creative Commons Attribution 3.0 Unported License",
        "SPDX-License-Identifier: CC-BY",
    ],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC",
        "This work is licensed under a Creative Commons Attribution-NonCommercial License",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License",
        "SPDX-License-Identifier: CC-BY-NC",
    ],
    "CC-BY-NC-ND": [
        "Licensed under CC BY-NC-ND",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives License",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 Unported License",
        "SPDX-License-Identifier: CC-BY-NC-ND",
    ],
    "CC-BY-NC-SA": [
        "Licensed under CC BY-NC-SA",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike License",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License",
        "SPDX-License-Identifier: CC-BY-NC-SA",
    ],
    "CC-BY-ND": [
        "Licensed under CC BY-ND",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives License",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 3.0 Unported License",
        "SPDX-License-Identifier: CC-BY-ND",
    ],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA",
        "This work is licensed under a Creative Commons Attribution-ShareAlike License",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License",
        "SPDX-License-Identifier: CC-BY-SA",
    ],
    "EPL-2.0": [
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        'THE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS ECLIPSE PUBLIC LICENSE ("AGREEMENT"). ANY USE, REPRODUCTION OR DISTRIBUTION OF THE PROGRAM CONSTITUTES RECIPIENT\'S ACCEPTANCE OF THIS AGREEMENT.',
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Released under the GNU General Public License, version 2.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "SPDX-License-Identifier: GPL",
    ],
    "ISC": [
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "SPDX-License-Identifier: LGPL",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.',
        "SPDX-License-Identifier: MIT",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "Mozilla Public License Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "Public domain": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0.",
        "SPDX-License-Identifier: Unlicense",
        "SPDX-License-Identifier: CC0",
    ],
}

# Words that name a licence or what sets it apart from its neighbours.
NAMES = set(
    "0bsd affero agpl apache attribution bsd by cc cc0 commons creative eclipse epl general gnu gpl isc lesser lgpl "
    "mit mozilla mpl nc nd noderivatives noncommercial sa sharealike unlicense".split()
)

UNKNOWN = "unknown"
BACKGROUND = 1000
VARIANTS = 24
CONFIRM = 0.7
LEAST = 0.5
MAX_FEATURES = 20_000
#: Counts of so many templates are summed in one long, in fields of so many bits.
PACKED, FIELD = 7, 9


def tokens(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + k]) for k in (2, 3) for i in range(len(words) - k + 1)}


def telling() -> list[str]:
    """Words of which every text with CONFIRM of some template's 2-grams has one: without them, too few of
    any template's 2-grams are left."""
    left = [{tuple(g.split(" ")) for g in grams(tokens(t)) if g.count(" ") == 1} for ts in TEMPLATES.values() for t in ts]
    most, chosen = [CONFIRM * len(p) for p in left], []
    while any(len(p) >= m for p, m in zip(left, most, strict=True)):
        gain: dict[str, int] = {}
        for p, m in zip(left, most, strict=True):
            for pair in p if len(p) >= m else ():
                for w in set(pair):
                    gain[w] = gain.get(w, 0) + 1
        chosen.append(max(gain, key=lambda w: (len(w) > 5, gain[w], w)))
        left = [{pair for pair in p if chosen[-1] not in pair} for p in left]
    return chosen


@dataclass
class Model:
    families: list[str]  # the unknown class first
    features: list[str]
    weights: np.ndarray  # by feature and family
    bias: np.ndarray
    temperature: float
    least: float


def train(background: list[str], seed: int = 3) -> Model:
    rng = np.random.default_rng(seed)
    families = [UNKNOWN, *sorted(TEMPLATES)]
    features = sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(tokens(t))})
    if len(features) > MAX_FEATURES:
        raise ValueError(f"{len(features)} features; at most {MAX_FEATURES} can be sent to every task")
    place = {g: i for i, g in enumerate(features)}
    templates = [(families.index(f), tokens(t)) for f, ts in TEMPLATES.items() for t in ts]
    pairs = [{g for g in grams(t) if g.count(" ") == 1} for _, t in templates]
    rows, labels = [], []
    lines = [tokens(x) for x in background]
    lines = [w for w in lines if all(len(p & grams(w)) < 0.5 * len(p) for p in pairs)]
    filler = np.array([w for line in lines for w in line] or ["text"])
    for y, words in templates:
        for _ in range(VARIANTS):
            kept = [w for w in words if w in NAMES or rng.random() > 0.06]
            if not any(map(str.isdigit, families[y])):  # a family of any version
                kept = [str(rng.integers(6)) if w.isdigit() and rng.random() < 0.3 else w for w in kept]
            a, b = (rng.choice(filler, int(rng.integers(0, 12))).tolist() for _ in range(2))
            rows.append(grams([*a, *kept, *b]))
            labels.append(y)
        named = [w in NAMES for w in words]
        for _ in range(VARIANTS // 2 if any(named) else 0):  # nor is a notice of another name
            own = [str(rng.choice(filler)) if n else w for w, n in zip(words, named, strict=True)]
            rows.append(grams(own))
            labels.append(0)
        for _ in range(VARIANTS // 2):  # a few of a template's words are no licence
            n = max(2, len(words) // 4)
            at = int(rng.integers(0, len(words) - n + 1))
            rows.append(grams([*rng.choice(filler, 6).tolist(), *words[at : at + n], *rng.choice(filler, 6).tolist()]))
            labels.append(0)
    rows += [grams(w) for w in lines]
    labels += [0] * len(lines)
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, own in enumerate(rows):
        x[i, [place[g] for g in own if g in place]] = 1
    y = np.eye(len(families), dtype=np.float32)[labels]
    held = rng.random(len(rows)) < 0.2
    xs, ys = x[~held], y[~held]
    w, b = np.zeros((len(features), len(families)), np.float32), np.zeros(len(families), np.float32)
    m, s = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, 151):
        z = xs @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = xs.T @ (p - ys) / len(xs) + 1e-4 * w
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        b -= 0.5 * (p - ys).mean(0)
    z, t = x[held] @ w + b, y[held].argmax(1)

    def probabilities(temperature):
        e = np.exp((z - z.max(1, keepdims=True)) / temperature)
        return e / e.sum(1, keepdims=True)

    losses = {k: -np.log(probabilities(k)[np.arange(len(t)), t] + 1e-9).mean() for k in np.geomspace(0.3, 5, 30)}
    temperature = float(min(losses, key=losses.get)) if len(t) else 1.0
    known = probabilities(temperature)[t == 0, 1:].max(1) if (t == 0).any() else np.zeros(1)
    least = float(min(0.9, max(LEAST, np.quantile(known, 0.995))))
    return Model(families, features, w, b, temperature, least)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def background(docs: DataFrame, n: int = BACKGROUND) -> list[str]:
    """The n different lines (whole ones) with the smallest hashes: the unknown class's training sample.

    The number of different lines is estimated first, so that only lines with hashes below a bound, some times n, are
    shuffled; the bound is raised until n lines or all are below it.
    """
    rows = docs.select(F.explode(lines(F.col("text"))).alias("x")).filter(F.length("x") > 20)
    rows = rows.select("x", F.xxhash64("x").alias("h"))
    about = rows.agg(F.approx_count_distinct("h")).head()[0]
    share = 2 * n / max(about, 1)
    while True:
        below = rows.filter(F.col("h") <= int(-(2**63) + share * 2**64)) if share < 1 else rows
        chosen = below.distinct().orderBy("h", "x").limit(n).collect()
        if len(chosen) == n or share >= 1:
            return [r.x for r in chosen]
        share *= 4


def _ngrams(words: Column) -> Column:
    """gram and line (-1 if it goes over lines) of words (w, i: the word and its line)."""

    def gram(text: Column, last: Column, line: Column, own: Column) -> Column:
        return F.struct(F.concat_ws(" ", text, last).alias("gram"), F.when(line == own, line).otherwise(F.lit(-1)).alias("line"))

    n2, n3 = F.greatest(F.size(words) - 1, F.lit(0)), F.greatest(F.size(words) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, n2), F.slice(words, 2, n2), lambda a, b: gram(a["w"], b["w"], a["i"], b["i"]))
    triples = F.zip_with(F.slice(pairs, 1, n3), F.slice(words, 3, n3), lambda a, b: gram(a["gram"], b["w"], a["line"], b["i"]))
    return F.concat(pairs, triples)


#: Between paragraphs: lines without a letter or digit (comment marks alone are none).
BETWEEN = r"\n(?:[^\p{L}\p{N}\n]*\n)+"
#: Comment marks that look like words.
MARKS = r"(?m)^[ \t]*(?:dnl|REM|rem)[ \t]+"
WHOLE = -2


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs, n_licensed, families (confirmed, ascending), probability (the highest of
    those)."""
    spark = docs.sparkSession
    known = model.families[1:]
    names = [f"w{i}" for i in range(len(model.families))]
    templates = [(f, t) for f in known for t in TEMPLATES[f]]
    pairs = [{g for g in grams(tokens(t)) if g.count(" ") == 1} for _, t in templates]
    if max(map(len, pairs)) >= 1 << FIELD:
        raise ValueError(f"a template has {1 << FIELD} different 2-grams or more")
    counts = [f"t{k}" for k in range(-(-len(pairs) // PACKED))]
    rows = [("", [0.0] * len(names), [0] * len(counts))]  # keeps documents without features
    for i, g in enumerate(model.features):
        own = [0] * len(counts)
        for k, p in enumerate(pairs):
            own[k // PACKED] |= (g in p) << FIELD * (k % PACKED)
        rows.append((g, [float(v) for v in model.weights[i]], own))
    weights = spark.createDataFrame(rows, "gram string, w array<double>, t array<long>")
    weights = weights.select(
        "gram", *[F.col("w")[i].alias(c) for i, c in enumerate(names)], *[F.col("t")[k].alias(c) for k, c in enumerate(counts)]
    )

    filled = F.size(F.filter(lines(F.col("text")), lambda x: F.trim(x) != ""))
    runs = F.split(F.regexp_replace(F.coalesce("text", F.lit("")), MARKS, ""), BETWEEN)
    told = F.lower(F.coalesce("text", F.lit(""))).rlike("|".join(telling()))
    runs = F.when(told, runs).otherwise(F.array(F.lit("")))
    text = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), filled.alias("n_paragraphs"), runs.alias("runs"))
    each = text.select("doc_id", "row", "n_paragraphs", F.posexplode("runs").alias("par", "run"))

    def words(line: Column, i: Column) -> Column:
        found = F.filter(F.split(line, "[^a-z0-9]+"), lambda x: x != "")
        return F.transform(found, lambda w: F.struct(w.alias("w"), i.alias("i")))

    own = F.flatten(F.transform(F.split(F.lower("run"), "\n"), words))
    own = F.coalesce(F.when(F.lower("run").rlike("|".join(telling())), own), F.array().cast("array<struct<w:string,i:int>>"))
    each = each.select("doc_id", "row", "n_paragraphs", "par", F.contains("run", F.lit("\n")).alias("several"), own.alias("words"))
    first = F.array(F.struct(F.lit("").alias("gram"), F.lit(-1).alias("line")))
    found = F.concat(_ngrams(F.col("words")), F.when(F.col("par") == 0, first).otherwise(F.slice(first, 1, 0)))
    features = each.select("doc_id", "row", "n_paragraphs", "par", "several", F.explode(found).alias("g"))
    features = features.select("doc_id", "row", "n_paragraphs", "par", "several", "g.gram", "g.line")
    hits = features.join(F.broadcast(weights.select("gram")), "gram").groupBy("row", "par", "gram").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_paragraphs").alias("n_paragraphs"),
        F.first("several").alias("several"), F.collect_set("line").alias("in_lines"),
    )
    whole = F.col("several") | (F.col("gram") == "")
    units = F.filter("in_lines", lambda x: x >= 0)
    units = F.when(whole, F.concat(units, F.array(F.lit(WHOLE)))).otherwise(units)
    hits = hits.select("row", "par", "doc_id", "n_paragraphs", "gram", F.explode(units).alias("line"))
    sums = hits.join(F.broadcast(weights), "gram").groupBy("row", "par", "line").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_paragraphs").alias("n_paragraphs"),
        *[F.sum(c).alias(c) for c in [*names, *counts]],
    )
    # In steps, so that what many conditions read is worked out once.
    ids = ["row", "par", "line", "doc_id", "n_paragraphs"]
    each = sums.select(*ids, *counts, *[((F.col(c) + float(model.bias[i])) / model.temperature).alias(c) for i, c in enumerate(names)])
    each = each.withColumn("top", F.greatest(*names))
    total = sum((F.exp(F.col(c) - F.col("top")) for c in names), F.lit(0.0))
    best = F.coalesce(*[F.when(F.col(c) == F.col("top"), F.lit(f)) for c, f in zip(names, model.families, strict=True)])
    each = each.select(*ids, *counts, best.alias("best"), (1 / total).alias("p"))
    confirmed = F.lit(False)
    for f in known:
        some = F.lit(False)
        for k in [k for k, (own, _) in enumerate(templates) if own == f]:
            n = F.shiftright(f"t{k // PACKED}", FIELD * (k % PACKED)).bitwiseAND((1 << FIELD) - 1)
            some |= n >= CONFIRM * len(pairs[k])
        confirmed |= (F.col("best") == f) & some
    sure = (F.col("best") != UNKNOWN) & (F.col("p") >= model.least) & confirmed
    each = each.select(*ids, F.when(sure, F.col("best")).alias("family"), F.when(sure, F.col("p")).alias("p"))
    is_line = F.col("line") != WHOLE
    found = F.when(F.col("family").isNotNull(), F.struct("family", "p"))
    by_par = each.groupBy("row", "par").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_paragraphs").alias("n_paragraphs"),
        F.collect_list(F.when(is_line, found)).alias("of_lines"), F.max(F.when(~is_line, found)).alias("of_whole"),
    )
    own = F.col("of_whole.family")
    more = F.col("of_whole").isNotNull() & ~F.exists("of_lines", lambda x: x["family"] == own)
    others = F.filter("of_lines", lambda x: ~F.contains(own, x["family"]))
    each = by_par.select(
        "row", "doc_id", "n_paragraphs",
        F.when(more, F.concat(others, F.array("of_whole"))).otherwise(F.col("of_lines")).alias("found"),
    ).select(
        "row", "doc_id", "n_paragraphs", F.transform("found", lambda x: x["family"]).alias("families"),
        F.array_max(F.transform("found", lambda x: x["p"])).alias("p"),
    )
    out = each.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n_paragraphs").cast("long").alias("n_paragraphs"),
        F.sum(F.size("families")).cast("long").alias("n_licensed"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))).alias("families"),
        F.max("p").alias("probability"),
    )
    return out.drop("row")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, train(background(docs)))
    return found.withColumn("families", F.concat_ws(",", "families"))
