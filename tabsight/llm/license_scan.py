"""Licence notices in texts: a trained paragraph classifier over sparse word n-grams, confirmed against templates.

Training (numpy, on the templates below and variants of them; no row of any table): multinomial logistic regression on
the presence of word 1- to 3-grams, with a class of its own for what is no known licence, and a temperature set on
variants it hasn't seen. Its weights are whole thousandths, so sums are exact in any order.

Scan (DataFrame functions only): paragraphs are lines. Those without any word of the legal vocabulary hold no notice.
The others are classified once for each distinct paragraph: n-grams are exploded, joined with the weights and summed. A
prediction must beat the unknown class with a calibrated probability, and is confirmed if enough of its 2-grams stand in
a template of that family, or enough of a template's in it.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Notices of licence families, quoted from the public licences.
TEMPLATES = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "gpl-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-2.0-only",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "agpl-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the BSD 3-Clause License.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work. CC0 1.0 Universal Public Domain Dedication.",
    ),
    "isc": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "unlicense": (
        "Released under the Unlicense.",
        "This is free and unencumbered software released into the public domain.",
    ),
}
# What holds legal words and is no notice of a known licence.
OTHERS = (
    "You need a driving license to rent a car, and permission to park it.",
    "The city granted the restaurant a liquor license under the new terms of the law.",
    "All rights reserved. No part of this work may be copied without written permission of the author.",
    "Copyright the authors.",
    "The software license agreement between the company and the customer ends with the year.",
    "The warranty covers the parts of the machine for two years.",
    "The public library gives free copies of this work to any person.",
    "They were licensed under the rules of the general assembly, version of the year before.",
    "The photographer sells a license for commercial use of the picture.",
    "The foundation published the source of the river and its general form.",
)
FAMILIES = (*TEMPLATES, "unknown")
#: Words of which a paragraph must hold one: all families' notices do.
LEGAL = r"(?i)licen[cs]|permission|permitted|public domain|unencumbered|cc0|\bcc by|waived all"

SCALE = 1000
#: Least probability of a family, least share of 2-grams in common with a template, variants of each template.
PROBABILITY, SIMILARITY, VARIANTS = 0.6, 0.6, 24


def _words(text: str) -> list[str]:
    return [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split(" ") if w]


def grams(words: list[str], sizes=(1, 2, 3)) -> set[str]:
    return {" ".join(words[i : i + n]) for n in sizes for i in range(len(words) - n + 1)}


def _variants(random: np.random.Generator, times: int) -> list[tuple[set[str], int]]:
    """Templates whole, with words lost or changed at the ends, and inside other words; and mixtures that are none."""
    sets = [([_words(t) for t in texts], k) for k, texts in enumerate(TEMPLATES.values())]
    sets.append(([_words(t) for t in OTHERS], len(TEMPLATES)))
    every = [w for texts, _ in sets for words in texts for w in words]
    found = []
    for texts, k in sets:
        for words in texts:
            found.append((grams(words), k))
            for _ in range(times):
                kept = [w for w in words if random.random() > 0.1 * (len(words) > 6)]
                noise = [f"x{random.integers(10**6)}" for _ in range(random.integers(0, 25))]
                cut = int(random.integers(0, len(noise) + 1))
                found.append((grams(noise[:cut] + kept + noise[cut:]), k))
            loose = [str(w) for w in random.choice(every, size=random.integers(2, 16))]
            found += [(grams(loose), len(TEMPLATES)), (grams([f"x{random.integers(10**6)}", loose[0], "license"]), len(TEMPLATES))]
    return found


@cache
def train(seed: int = 5, rounds: int = 200) -> tuple[list[tuple[str, list[int]]], list[int], float]:
    """Weights of n-grams and intercepts for each class, in thousandths, and the temperature."""
    random = np.random.default_rng(seed)
    rows, unseen = _variants(random, VARIANTS), _variants(random, VARIANTS // 4)
    known = set().union(*(grams(_words(t)) for texts in (*TEMPLATES.values(), OTHERS) for t in texts))
    names = sorted(known)
    place = {g: i for i, g in enumerate(names)}

    def matrix(rows):
        x = np.zeros((len(rows), len(names)), np.float32)
        for i, (own, _) in enumerate(rows):
            x[i, [place[g] for g in own if g in place]] = 1
        return x, np.array([k for _, k in rows])

    x, y = matrix(rows)
    target = np.eye(len(FAMILIES), dtype=np.float32)[y]
    w, b, speed, speed_b = (np.zeros(s, np.float32) for s in ((len(names), len(FAMILIES)), len(FAMILIES), (len(names), len(FAMILIES)), len(FAMILIES)))
    for _ in range(rounds):
        z = x @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        speed = 0.9 * speed - 0.5 * (x.T @ (p - target) / len(x) + 1e-4 * w)
        speed_b = 0.9 * speed_b - 0.5 * (p - target).mean(0)
        w, b = w + speed, b + speed_b
    whole, whole_b = np.rint(w * SCALE).astype(int), np.rint(b * SCALE).astype(int)
    z, y = matrix(unseen)
    z = (z @ whole + whole_b) / SCALE

    def loss(t: float) -> float:
        s = z / t
        s -= s.max(1, keepdims=True)
        return float(-(s[np.arange(len(y)), y] - np.log(np.exp(s).sum(1))).mean())

    temperature = float(min(1.1 ** np.arange(-24, 25), key=loss))
    return [(g, row.tolist()) for g, row in zip(names, whole, strict=True) if row.any()], whole_b.tolist(), temperature


def _gram_columns(words: Column) -> Column:
    """Distinct 1- to 3-grams of an array of words."""
    places = F.when(F.size(words) > 0, F.sequence(F.lit(1), F.size(words))).otherwise(F.array().cast("array<int>"))
    parts = [words]
    for n in (2, 3):
        at = F.slice(places, F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(0)))
        parts.append(F.transform(at, _joiner(words, n)))
    return F.array_distinct(F.concat(*parts))


def _joiner(words: Column, n: int):
    return lambda i: F.array_join(F.slice(words, i, n), " ")


def scan_licenses(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``paragraph`` (line, from 0), ``family``, ``probability``, ``similarity``, ``confirmed``.

    One row for each paragraph of each row of ``docs`` that is taken for a known licence. Null and empty texts have
    none. Equal paragraphs are judged alike, repeated rows are listed again, rows without doc_id are listed too.
    """
    spark = docs.sparkSession
    weights, intercepts, temperature = train()
    classes = range(len(FAMILIES))
    # Proven size: the n-grams of the templates above.
    table = spark.createDataFrame([(g, *row) for g, row in weights], "gram string, " + ", ".join(f"c{k} int" for k in classes))
    shapes = [(family, t, g, len(own)) for family, texts in TEMPLATES.items() for t, text in enumerate(texts) for own in [grams(_words(text), (2,))] for g in own]
    templates = spark.createDataFrame(shapes, "t_family string, template int, gram string, t_size int")
    lines = docs.where(F.col("text").cast("string").rlike(LEGAL)).select(F.col("doc_id"), F.posexplode(F.split(F.col("text").cast("string"), r"\r\n|\r|\n")).alias("paragraph", "line"))
    lines = lines.where(F.col("line").rlike(LEGAL)).withColumn("id", F.sha2("line", 256))
    once = lines.groupBy("id").agg(F.min("line").alias("line"))
    words = F.filter(F.split(F.regexp_replace(F.lower("line"), "[^a-z0-9]+", " "), " "), lambda w: w != "")
    grammed = once.select("id", F.explode(_gram_columns(words)).alias("gram"))
    scores = grammed.join(F.broadcast(table), "gram").groupBy("id").agg(*[(F.sum(f"c{k}") + F.lit(intercepts[k])).alias(f"c{k}") for k in classes])
    ranked = F.array_sort(F.array(*[F.struct((-F.col(f"c{k}")).alias("z"), F.lit(k).alias("k"), F.lit(FAMILIES[k]).alias("family")) for k in classes]))
    best = scores.withColumn("best", ranked[0])
    total = sum((F.exp((F.col(f"c{k}") + F.col("best.z")) / (SCALE * temperature)) for k in classes), F.lit(0.0))
    predicted = best.select("id", F.col("best.family").alias("family"), (1 / total).alias("probability")).where((F.col("family") != "unknown") & (F.col("probability") >= PROBABILITY))
    # 2-grams in common with each template of the predicted family.
    pairs = grammed.where(F.size(F.split("gram", " ")) == 2)
    sizes = pairs.groupBy("id").agg(F.count(F.lit(1)).alias("p_size"))
    common = pairs.join(F.broadcast(templates), "gram").groupBy("id", "t_family", "template", "t_size").agg(F.count(F.lit(1)).alias("n"))
    likeness = common.join(sizes, "id").groupBy("id", F.col("t_family").alias("family")).agg(F.max(F.col("n") / F.least("t_size", "p_size")).alias("similarity"))
    judged = predicted.join(likeness, ["id", "family"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    found = lines.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "id").join(judged, "id")
    return found.select("doc_id", "paragraph", "family", "probability", "similarity", (F.col("similarity") >= SIMILARITY).alias("confirmed"))
