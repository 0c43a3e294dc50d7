"""Licence scans in DataFrame functions only.

A paragraph is a line of a document. A multinomial logistic regression over
sparse word 1- to 3-grams gives each line a probability for every licence
family and for "other". It is fitted on the driver from the notices below,
which are constants of this module; no row of the corpus is used, and none
passes through Python. The corpus is scored by a join of its n-grams with the
table of weights, which is broadcast (its size is that of the notices).

The fit has an L1 penalty, so most n-grams have no weight at all. That also says
which lines need no scoring: ``gate_words`` are words of which every n-gram with
a weight holds one, so a line without any of them has the score of the empty
line, which is "other". No list of words decides what the classifier sees.

A line is given a family only if its probability reaches a threshold; below it,
a line that is not "other" is ``unknown``. The threshold is the one with the
fewest errors on calibration lines that are in no fit and are no templates. A
predicted family is confirmed by comparison with its templates: at least half of
the 2-grams of one of them must be in the line.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

OTHER, UNKNOWN = "other", "unknown"

#: Short forms of public licence notices, by family.
NOTICES = {
    "mit": [
        "The MIT License (MIT)",
        "This code is MIT licensed",
        "Released under the MIT License.",
        "This project is licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "apache": [
        "Apache License, Version 2.0",
        "Code under the Apache licence",
        "Licensed under the Apache License, Version 2.0.",
        "This file is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "gpl": [
        "GNU General Public License",
        "Free software under the GNU GPL",
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU General Public License along with this program",
    ],
    "lgpl": [
        "GNU Lesser General Public License",
        "LGPL, version 3 or later",
        "This library is licensed under the GNU Lesser General Public License.",
        "Released under the LGPL version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "bsd": [
        "BSD License",
        "Redistributions of source code must retain the above copyright notice",
        "Released under the BSD 3-Clause License.",
        "This project is licensed under the BSD license.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ],
    "mpl": [
        "Mozilla Public License",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Creative Commons Attribution",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "CC BY-SA",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
    ],
    "cc-by-nc": [
        "CC BY-NC",
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "public-domain": [
        "This work is in the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "reserved": [
        "all rights reserved by the author",
        "All rights reserved.",
        "Copyright 2020 the authors. All rights reserved.",
        "No part of this publication may be reproduced or distributed without the prior written permission of the publisher",
    ],
}
#: Lines that hold anchor words and are no notice.
COUNTEREXAMPLES = [
    "He lost his driving license last year.",
    "The license plate of the car was covered in mud.",
    "The city granted the bar a liquor license.",
    "She was licensed to practise medicine in two states.",
    "The copyright lawsuit was settled out of court.",
    "They talked about copyright law for an hour.",
    "A license is needed to sell wine.",
    "The software license fee went up.",
    "The Apache tribe and the Apache language are old.",
    "He is on leave with the permission of the chief.",
    "We reserved a table for two and had rights to the view.",
    "The permission of her parents was needed for the trip.",
    "It was released to the public last week.",
    "The public was angry about the new law.",
    "Apache is the name of several groups of peoples.",
    "The apache server was restarted at noon.",
    "She studies at MIT and likes it there.",
    "the redistribution of wealth was the subject of the talk",
    "the warranty of the fridge had ended",
]
#: Lines of ordinary prose, so that common words carry no weight.
PROSE = [
    "This is one of the works of the author and not the last.", "You may see it with your own eyes.", "It was released by the studio in the spring.", "The form of the poem is free.",
    "He said that the project was under way.", "The terms of the peace were hard.", "A copy of the letter was sent to her.", "They went to the library, and then home.",
    "The source of the river is in the hills.", "The name of the ship was known to all.", "Version two of the story is longer.", "The public was in the hall, and the text was read aloud.",
    "All of this is at the end of the file.", "The general was no friend of the international press.", "The foundation of the house was of stone.", "It was subject to change, by the way.",
    "Please send this program to the school.", "The software was slow, and so were we.", "Use it with care, and not for long.", "Work began on the code in the year 2020.",
    "The conditions on the road were bad.", "No part of the town was spared.", "He was the holder of the cup for three years.", "The products of the farm are sold here.", "The notice on the door says that it is shut.",
    "Sie ist mit und ohne ihn gut.", "Mit der Zeit wird es besser.", "mit", "und mit dem", "de la part de", "por la noche y el dia", "by", "is with.", "in the", "under the", "this", "of the", "to you",
    "1 0", "2 0", "version 3", "4.0", "free", "public", "general", "source", "copy", "by the author of this", "the terms of this", "Text follows on the next page.",
]
#: Notices that name no known family: their family is ``unknown``.
UNFAMILIAR = [
    "This work is licensed under the terms below.",
    "Released under a custom license, see the file.",
    "The license of this text is given at the end.",
    "Licensed under the Beerware License.",
    "You may use this under the terms of the license that comes with it.",
    "Released under our own licence.",
]
#: Lines for the threshold, in no fit and no templates: notices worded otherwise, by family.
CALIBRATION = {
    "mit": ["Released under the MIT terms.", "MIT licensed.", "The code is available under the MIT licence, see LICENSE.", "to any person obtaining a copy of this software and associated documentation files"],
    "apache": ["Code under the Apache 2.0 licence.", "Apache License 2.0", "Available under the Apache License version 2.0, see the file.", "not use this file except in compliance with the License"],
    "gpl": ["Licensed under the GNU GPL, version 3 or any later version.", "GNU General Public License v2.0", "This program is free software under the GPL version 3."],
    "lgpl": ["Distributed under the GNU Lesser General Public License.", "LGPL version 3 or later."],
    "bsd": ["Released under the BSD 3-Clause terms.", "Use of this source code is governed by a BSD license.", "Redistribution in source and binary forms is permitted"],
    "mpl": ["This file is subject to the Mozilla Public License.", "Mozilla Public License 2.0"],
    "cc-by": ["Text under CC BY 4.0.", "Shared under the Creative Commons Attribution 4.0 license."],
    "cc-by-sa": ["Text under CC BY-SA 4.0.", "Shared under Creative Commons Attribution-ShareAlike."],
    "cc-by-nc": ["Pictures under CC BY-NC 4.0.", "Shared under Creative Commons Attribution-NonCommercial 4.0."],
    "public-domain": ["Released into the public domain.", "Dedicated to the public domain under CC0."],
    "reserved": ["All rights are reserved.", "Copyright 2019 by the publisher, all rights reserved."],
    OTHER: [
        "The licence of the pub was renewed.", "She has a license to drive a bus.", "He asked for permission to go home.", "They enjoy the public gardens.", "We went with them to the MIT museum.",
        "The Apache rode over the plain.", "The rights of the workers were a subject of the talk.", "The source of the fire is not known.", "What is said here is said under oath.", "Er kam mit dem Zug und ging mit ihr.",
        "Copies of the book are in the library.", "The commons of the village are open to all.",
    ],
}
#: Function words and lone digits. An n-gram of these alone is no feature of the model.
FUNCTION_WORDS = frozenset(
    "a all and any are as at be been by can d el de do for from had has have he her his i if in into is it its la last le may me mit my no nor not of on one or our out part s see she so such that "
    "the their them there these they this those to two und up use used was way we were what when which who will with year you your under without must above provided following 0 1 2 3 4 5 6 7 8 9".split()
) - {"mit"}
NGRAMS = 3
STEPS, RATE, LASSO = 4000, 1.0, 2e-4
CONFIRMED = 0.5
PROSE_COST = 4
#: Parts into which the rows of one notice are dealt.
SALT = 32
_WORDS = r"[^a-z0-9]+"


def _grams(line: str) -> list[str]:
    words = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in line.lower()).split() if w]
    return sorted({" ".join(words[k : k + n]) for n in range(1, NGRAMS + 1) for k in range(len(words) - n + 1)})


def _fit(lines: list[tuple[str, str]], classes: list[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Weights of the n-grams that have any, and the biases.

    Accelerated gradient steps on the mean loss, each followed by a shrinking of
    every weight (not of the biases) towards 0; a row is scaled by the root of
    its n-grams.
    """
    rows = [_grams(t) for t, _ in lines]
    names = sorted({g for r in rows for g in r if not FUNCTION_WORDS.issuperset(g.split())})
    at = {g: k for k, g in enumerate(names)}
    x = np.zeros((len(rows), len(names) + 1))
    for k, r in enumerate(rows):
        x[k, [at[g] for g in r if g in at]] = 1 / math.sqrt(max(1, len(r)))
        x[k, -1] = 1
    y = np.array([[c == own for c in classes] for _, own in lines], float)
    w = np.zeros((x.shape[1], len(classes)))
    ahead, t = w, 1.0
    for _ in range(STEPS):
        z = x @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - RATE * (x.T @ (p - y) / len(y))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - RATE * LASSO, 0)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (before - 1) / t * (new - w), new
    return {g: w[k] for g, k in at.items() if w[k].any()}, w[-1]


def _probabilities(weights, bias, line: str) -> np.ndarray:
    grams = _grams(line)
    z = bias + sum((weights[g] for g in grams if g in weights), np.zeros(len(bias))) / math.sqrt(max(1, len(grams)))
    p = np.exp(z - z.max())
    return p / p.sum()


def decide(p: np.ndarray, classes: list[str], bounds: tuple[float, float]) -> str:
    """A family, ``unknown`` or other, from a line's probabilities and the two bounds."""
    if p[:-1].max() >= bounds[0]:
        return classes[p[:-1].argmax()]
    return UNKNOWN if p[-1] < bounds[1] else OTHER


def _bounds(calibration: list[tuple[str, np.ndarray]], classes: list[str]) -> tuple[float, float]:
    """The least probability of a family, and the probability of other under which a line is a notice.

    Both lie between values that the calibration lines have; of all pairs with
    the least cost it is the middle one. Prose that is taken for a notice costs
    ``PROSE_COST`` errors, because nearly all lines of a corpus are prose. calibration: the right answer and
    the probabilities of each line.
    """

    def between(values) -> list[float]:
        seen = sorted(set(values))
        return [(a + b) / 2 for a, b in zip(seen, seen[1:], strict=False)]

    pairs = [(a, b) for a in between(float(p[:-1].max()) for _, p in calibration) for b in between(float(p[-1]) for _, p in calibration)]
    found = [sum((PROSE_COST if right == OTHER else 1) for right, p in calibration if decide(p, classes, pair) != right) for pair in pairs]
    good = [pair for pair, n in zip(pairs, found, strict=True) if n == min(found)]
    return good[len(good) // 2]


@lru_cache(1)
def model() -> tuple[list[str], dict[str, np.ndarray], np.ndarray, tuple[float, float]]:
    """Classes, weights, biases, and the calibrated bounds."""
    classes = [*NOTICES, OTHER]
    lines = [(t, f) for f, ts in NOTICES.items() for t in ts] + [(t, OTHER) for t in COUNTEREXAMPLES + PROSE]
    weights, bias = _fit(lines, classes)
    calibration = [(f, _probabilities(weights, bias, t)) for f, ts in (CALIBRATION | {UNKNOWN: UNFAMILIAR}).items() for t in ts]
    return classes, weights, bias, _bounds(calibration, classes)


@lru_cache(1)
def gate_words() -> tuple[str, ...]:
    """Words of which every n-gram with a weight holds one; a line without any has the biases as its score, and they say "other".

    Words that have a weight of their own are in it; longer n-grams that hold
    none of them add the longest of their words.
    """
    classes, weights, bias, bounds = model()
    if decide(_probabilities(weights, bias, ""), classes, bounds) != OTHER:
        raise ValueError("a line without any weight must be other")
    out = {g for g in weights if " " not in g}
    for gram in sorted((g for g in weights if " " in g), key=lambda g: (g.count(" "), g)):
        words = gram.split()
        if not out & set(words):
            out.add(max(words, key=lambda w: (w not in FUNCTION_WORDS, len(w), w)))
    return tuple(sorted(out))


def _ngrams(words: Column) -> Column:
    """Distinct 1- to 3-grams of a word array, as the model makes them.

    The array is bound to a lambda variable, so that it is made once and not
    for every gram of a long line.
    """

    def runs(w: Column, n: int) -> Column:
        steps = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(steps, lambda i: F.array_join(F.slice(w, i, n), " "))

    return F.transform(F.array(words), lambda w: F.array_distinct(F.concat(w, *[runs(w, n) for n in range(2, NGRAMS + 1)])))[0]


def _gated(text: Column) -> Column:
    """Does the text hold a gate word?"""
    return F.arrays_overlap(F.split(F.lower(text), _WORDS), F.array(*[F.lit(w) for w in gate_words()]))


def _templates() -> list[tuple[str, set[str]]]:
    """Family and 2-grams of each notice."""
    return [(f, {g for g in _grams(t) if g.count(" ") == 1 or len(_grams(t)) == 1}) for f, ts in NOTICES.items() for t in ts]


def scan_lines(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, line (its number), family, probability, confirmed: a row for each line that is taken for a notice.

    Nulls and empty texts have no lines. Equal rows give equal results, one for
    each. A null doc_id is kept. Other columns are ignored. Equal lines are
    scored once and joined back, so a notice that is everywhere is scored no more
    often; the join back splits such a notice's rows over tasks by a salt.
    """
    classes, weights, bias, bounds = model()
    lines = Scratch(spark).keep(
        docs.where(_gated(F.col("text")))
        .select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
        .where(_gated(F.col("raw"))).withColumn("raw", F.lower("raw"))
    )
    table_of_weights = spark.createDataFrame([(g, [float(v) for v in w]) for g, w in weights.items()], "gram string, w array<double>")
    templates = [(k, f, g) for k, (f, grams) in enumerate(_templates()) for g in sorted(grams)]
    sizes: dict[int, int] = {}
    for k, _, _ in templates:
        sizes[k] = sizes.get(k, 0) + 1
    table_of_templates = spark.createDataFrame([(k, f, g, sizes[k]) for k, f, g in templates], "template int, of string, gram string, size int")

    words = F.filter(F.split("raw", _WORDS), lambda w: w != "")
    once = lines.select("raw").distinct().withColumn("grams", _ngrams(words))
    grams = once.select("raw", F.greatest(F.size("grams"), F.lit(1)).alias("n"), F.explode("grams").alias("gram"))
    hits = grams.join(F.broadcast(table_of_weights), "gram")
    z = [(F.lit(float(b)) + F.sum(F.col("w")[k]) / F.sqrt(F.first("n"))).alias(f"z{k}") for k, b in enumerate(bias)]
    scored = hits.groupBy("raw").agg(*z)
    total = sum((F.exp(F.col(f"z{k}")) for k in range(len(classes))), F.lit(0.0))
    ranked = F.array_max(F.array(*[F.struct((F.exp(F.col(f"z{k}")) / total).alias("p"), F.lit(c).alias("c")) for k, c in enumerate(classes) if c != OTHER]))
    other = F.exp(F.col(f"z{len(classes) - 1}")) / total
    family = F.when(F.col("best.p") >= bounds[0], F.col("best.c")).when(F.col("other") < bounds[1], F.lit(UNKNOWN))
    named = scored.select("raw", ranked.alias("best"), other.alias("other")).withColumn("family", family).where("family is not null")
    covered = (
        grams.join(F.broadcast(table_of_templates), "gram").groupBy("raw", "of", "template")
        .agg((F.count(F.lit(1)) / F.first("size")).alias("part")).groupBy(F.col("raw").alias("of_raw"), "of").agg(F.max("part").alias("part"))
    )
    judged = named.join(covered, (F.col("raw") == F.col("of_raw")) & (F.col("family") == F.col("of")), "left").select(
        "raw", "family", F.round("best.p", 6).alias("probability"), (F.coalesce("part", F.lit(0.0)) >= CONFIRMED).alias("confirmed")
    )
    dealt = lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "line"), F.lit(SALT)).cast("int"))
    spread = judged.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return dealt.join(spread, ["raw", "salt"]).select("doc_id", "line", "family", "probability", "confirmed")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the families of its confirmed notices, and how many lines are notices, confirmed or not.

    Rows with equal doc_id share one answer.
    """
    docs = table(spark, sf_dir, "documents")
    found = scan_lines(spark, docs).groupBy(F.col("doc_id").alias("id")).agg(
        F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"),
        F.count(F.lit(1)).alias("n_notices"),
        F.count(F.when(~F.col("confirmed"), 1)).alias("n_unconfirmed"),
    )
    return docs.select("doc_id").join(found, F.col("doc_id").eqNullSafe(F.col("id")), "left").select(
        "doc_id", F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        F.coalesce("n_notices", F.lit(0)).alias("n_notices"), F.coalesce("n_unconfirmed", F.lit(0)).alias("n_unconfirmed"),
    )
