"""Licence scans: a paragraph classifier with template comparison.

A paragraph is a line, or up to WRAP consecutive lines without a blank one among them (a line of signs only, such as
a comment's, is blank), as notices are wrapped. Its words are lower-cased, ``gplv3`` is two words, ``2.0`` is ``2``, ``licence`` is ``license``. Features are hashed
single words and pairs of neighbouring words, any of them, divided by the root of the number of words, so words that
the training texts lack count against a prediction. A sparse multinomial logistic regression gives a score for each licence family and for
the class ``unknown``. Scores are divided by a temperature fitted on notices that are worded otherwise than those of the fit, and a
family is predicted where its probability reaches the least threshold that is right for PRECISION of them. A prediction is confirmed if,
of all templates of all families that the paragraph holds, the one with the most words there (then the most similar one) is of that family. A paragraph holds the name of a licence
if its words, version included, follow each other there; it holds a longer notice if CONFIRM of its words are there, and all its
numbers. Of confirmed paragraphs that share a line the one with the most words of its template counts, then the most
similar one, the shortest, the first. Paragraphs of several lines count only if confirmed; then lines of theirs don't count by themselves.

The classifier is fitted on the driver on paragraphs made from the names and notices below: a fixed number, whatever the
corpus. Scoring is built-in expressions on each row, without a shuffle; weights are a literal of the plan. Every line of every text is read
by the classifier: a first pass adds up the most that its words can give any family over ``unknown``; only where that can't
reach the threshold is the score itself not worked out.

Defined results: null and empty texts have no paragraphs; a paragraph may hold any number of words; repeated rows are
scanned each; equal probabilities go to the family listed first; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: Names of licences, by family.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache Software License, version 2.0", "Apache-2.0"),
    "MIT": ("MIT License", "MIT licence", "Expat License", "MIT/X11 license"),
    "ISC": ("ISC License", "ISC licence", "Internet Systems Consortium license"),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License", "two-clause BSD license", "BSD-2-Clause", "2-clause BSD license"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License", "three-clause BSD license", "BSD-3-Clause", "Modified BSD License", "3-clause BSD license"),
    "BSD": ("BSD license", "BSD licence"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL, version 2", "GPLv2", "GPL 2.0", "GNU General Public License v2", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL, version 3", "GPLv3", "GPL 3.0", "GNU General Public License v3", "GPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "GNU LGPL, version 2.1", "LGPLv2.1", "LGPL 2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "GNU LGPL, version 3", "LGPLv3", "LGPL 3.0", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "GNU AGPL, version 3", "AGPLv3", "AGPL 3.0", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"),
    "EPL-2.0": ("Eclipse Public License, version 2.0", "Eclipse Public License 2.0", "EPL 2.0", "EPL-2.0"),
    "BSL-1.0": ("Boost Software License, Version 1.0", "Boost Software License 1.0", "BSL-1.0"),
    "Zlib": ("zlib License", "zlib/libpng license"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0", "CC BY 4.0", "CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0", "CC BY-SA 4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0", "Creative Commons BY-NC 4.0", "CC BY-NC 4.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Zero 1.0", "CC0 1.0", "CC0 public domain dedication"),
    "Unlicense": ("The Unlicense",),
}
#: The usual notices and the first paragraphs of the licences themselves.
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "BSD-3-Clause": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "GPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "LGPL-2.1": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "LGPL-3.0": ("This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "AGPL-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",),
    "BSL-1.0": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, and transmit the Software",),
    "Zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    ),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    "Proprietary": (
        "All rights reserved.", "Copyright. All rights reserved.", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
        "No part of this publication may be reproduced without prior written permission of the publisher.",
    ),
}
#: Other licences, which are no family here.
NEAR = (
    "Artistic License 2.0", "European Union Public Licence 1.2", "GNU Free Documentation License, version 1.3", "Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0",
    "Creative Commons Attribution 3.0 Unported License", "CC BY 3.0", "CC BY-SA 3.0", "CC BY-NC-SA 4.0", "Mozilla Public License, version 1.1", "Apache License, Version 1.1", "GNU Library General Public License, version 2",
    "LGPL 2.0", "GPL version 1", "Academic Free License 3.0", "Open Software License 3.0", "Microsoft Public License", "SIL Open Font License 1.1", "BSD 4-Clause License", "PHP License 3.01", "Python Software Foundation License",
    "Eclipse Public License, version 1.0", "Common Development and Distribution License 1.0", "Affero General Public License, version 1", "W3C Software License",
)
#: Paragraphs that use the same words otherwise.
OTHERS = (
    "You need a driving license to work here.", "The license of this restaurant to serve wine has ended.", "She obtained a licensed copy of the software free of charge.",
    "The general public is free to use the following source of water.", "Permission to work on this project is granted by the person in charge.", "He released the second version of the program under a new name.",
    "The terms of the project are subject to conditions.", "All rights are human rights.", "The Apache people and the Mozilla project.", "MIT released a public work on software.",
    "A work of creative writing by a person.", "Copyright law is subject to public attention.", "The foundation published a source of general content.", "You may modify the form or copy the file.",
    "Use of the following files is not permitted.", "The international version of this publication is available.", "The eclipse was seen by the general public.", "A boost for the software market this year.",
    "The library is free and open to anyone.", "Students at MIT hold a license to fish.", "In no event was the author held at the station.", "The commons is a public domain of the town.", "Anyone can copy the recipe without permission.",
    "This file was licensed last year.", "The software was released under pressure.", "The terms of the public debate are available here.", "The second clause of the contract is void.", "New modified cars were simplified in three steps.",
)
#: How notices put a name. The second ones are for the threshold only.
LEADS = ("Licensed under the {}.", "Released under the {}.", "This work is licensed under a {}.", "This project is distributed under the terms of the {}.", "{}", "License: {}", "This software is released under {}, see below.")
OTHER_LEADS = ("Use of this code is governed by the {}.", "Available under the {}; details are in the file LICENSE.", "The code is made available under {} terms.", "SPDX-License-Identifier: {}")
ROUNDS, RIDGE, SPARSE = 200, 1e-4, 0.02
PRECISION, CONFIRM = 0.99, 0.8
WRAP = 10  # lines of a wrapped notice: the longest at 25 columns
SLOTS = 1 << 15  # of the hash table of features
SCALE = 10_000  # weights are multiples of its inverse, so that their sums are exact
SPLIT = "[^abcdefghijklmnopqrstuvwxyz0123456789.]+"  # one by one: Java looks them up at once, but tries ranges in turn


def terms_of(paragraph: str) -> list[str]:
    low = re.sub(r"([a-z])v\.?([0-9])", r"\1 \2", paragraph.lower())
    low = re.sub(r"\bv\.?\s?([0-9])", r"\1", low).replace("licence", "license")
    return [w for w in (re.sub(r"^([0-9]+)\.0$", r"\1", x.strip(".")) for x in re.split(SPLIT, low)) if w and w not in SKIPPED]


SKIPPED = ("version",)  # said or not said before numbers
FAMILIES = tuple(dict.fromkeys([*NAMES, *NOTICES]))
_MASK = 2**64 - 1


def hashed(feature: str) -> tuple[int, int]:
    """Slot and check number of a feature, as SQL's xxhash64 gives them."""
    h = xxhash.xxh64_intdigest(feature.encode(), 42)
    return h % SLOTS, h >> 33


def grams(terms: list[str]) -> list[str]:
    return terms + [f"{a} {b}" for a, b in zip(terms, terms[1:])]


def training() -> tuple[list[tuple[list[str], int]], list[tuple[list[str], int]]]:
    """Paragraphs (as terms, with the class) to fit on, and others, otherwise worded, to set temperature and threshold by."""
    rng, fit, held = np.random.default_rng(5), [], []
    noise = lambda n: ["".join(rng.choice(list("aeioulnrst"), rng.integers(2, 9))) for _ in range(n)]
    unknown = len(FAMILIES)
    for k, family in enumerate(FAMILIES):
        for name in NAMES.get(family, ()):
            fit += [(noise(i % 2 * int(rng.integers(0, 4))) + terms_of(lead.format(name)) + noise(int(rng.integers(0, 3))), k) for i, lead in enumerate(LEADS)]
            held += [(terms_of(lead.format(name)) + noise(int(rng.integers(0, 4))), k) for lead in OTHER_LEADS]
        for text in NOTICES.get(family, ()):
            words = terms_of(text)
            for i in range(12):
                kept = [w for w in words if i == 0 or rng.random() > 0.06 or any(c.isdigit() for c in w)]
                (held if i % 4 == 3 else fit).append((noise(i % 3) + kept + noise(i % 2), k))
    for n, name in enumerate(NEAR):
        fit += [(terms_of(lead.format(name)) + noise(int(rng.integers(0, 3))), unknown) for lead in LEADS for _ in range(2)]
        held += [(terms_of(lead.format(name)), unknown) for lead in OTHER_LEADS]
    for n, text in enumerate(OTHERS):
        for i in range(10):
            (held if i % 5 == 4 else fit).append((noise(int(rng.integers(0, 5))) + [w for w in terms_of(text) if i == 0 or rng.random() > 0.1] + noise(int(rng.integers(0, 5))), unknown))
    stock = sorted({w for words, _ in fit for w in words if w.isalpha()})
    for i in range(500):  # stray words, and leads without a name
        stray = list(rng.choice(stock, rng.integers(1, 12))) if i % 2 else terms_of(LEADS[i % len(LEADS)].format(" ".join(noise(3))))
        (held if i % 5 == 4 else fit).append((noise(int(rng.integers(0, 6))) + [str(w) for w in stray], unknown))
    return fit, held


@lru_cache(1)
def model():
    """Slots of features, rows (check number, most that the feature can give, weights by class), biases, temperature, least probability."""
    fit, held = training()
    counts: dict[str, int] = {}
    for words, _ in fit:
        for g in set(grams(words)):
            counts[g] = counts.get(g, 0) + 1
    at: dict[int, tuple[int, str]] = {}
    for g, n in sorted(counts.items(), key=lambda x: (-x[1], x[0])):
        if n >= 3:
            at.setdefault(hashed(g)[0], (hashed(g)[1], g))  # of features with one slot the more frequent one is kept
    column = {g: j for j, (_, g) in enumerate(at.values())}
    n_classes = len(FAMILIES) + 1

    def matrix(rows) -> tuple[np.ndarray, np.ndarray]:
        x = np.zeros((len(rows), len(column)), np.float32)
        for i, (words, _) in enumerate(rows):
            for g in grams(words):
                if g in column:
                    x[i, column[g]] += 1
            x[i] /= max(1, len(words)) ** 0.5
        return x, np.array([k for _, k in rows])

    (x, y), (xh, yh) = matrix(fit), matrix(held)
    weight = 1 / np.bincount(y, minlength=n_classes) ** 0.5
    share, hot = (weight[y] / weight[y].sum())[:, None].astype(np.float32), np.eye(n_classes, dtype=np.float32)[y]
    w, b = np.zeros((x.shape[1], n_classes), np.float32), np.zeros(n_classes, np.float32)
    vw, vb = w.copy(), b.copy()
    for i in range(ROUNDS):
        s = x @ vw + vb
        p = np.exp(s - s.max(1, keepdims=True))
        g = (p / p.sum(1, keepdims=True) - hot) * share
        nw, nb = vw - 6 * (x.T @ g + RIDGE * vw), vb - 6 * g.sum(0)
        m = i / (i + 3)
        vw, vb, w, b = nw + m * (nw - w), nb + m * (nb - b), nw, nb
    w = np.round(np.where(np.abs(w) < SPARSE, 0, w).astype(float), 4)
    b = np.round(b.astype(float), 4)
    s = xh @ w + b

    def probabilities(t: float) -> np.ndarray:
        e = np.exp((s - s.max(1, keepdims=True)) / t)
        return e / e.sum(1, keepdims=True)

    temperature = min((0.3, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=lambda t: -np.log(probabilities(t)[np.arange(len(yh)), yh] + 1e-12).mean())
    p = probabilities(temperature)
    best, top = p.argmax(1), p.max(1)
    family = best < n_classes - 1
    least = next((c for c in np.arange(0.3, 1.0, 0.05) if (family & (top >= c)).any() and (best == yh)[family & (top >= c)].mean() >= PRECISION), 0.95)
    slots = {slot: j for j, slot in enumerate(at)}
    gain = np.maximum(0, (w[:, :-1] - w[:, -1:]).max(1))
    rows = [(check, float(gain[j]), w[j].tolist()) for j, (check, _) in enumerate(at.values())]
    return slots, rows, b.tolist(), float(temperature), round(float(least), 2), column, gain


def templates() -> list[dict]:
    """Names are phrases; notices are sets of words, with the numbers among them."""
    out = []
    for k, family in enumerate(FAMILIES):
        for name in NAMES.get(family, ()):
            out.append({"k": k + 1, "phrase": f" {' '.join(terms_of(name))} ", "words": terms_of(name), "numbers": []})
        for text in NOTICES.get(family, ()):
            words = sorted(set(terms_of(text)))
            out.append({"k": k + 1, "phrase": None, "words": words, "numbers": [w for w in words if any(c.isdigit() for c in w)]})
    return out


def _literal(value, kind: str) -> Column:
    """A constant read from JSON, folded when the plan is optimized."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _terms(text: Column) -> Column:
    """terms_of() in SQL, of a lower-cased text."""
    low = F.regexp_replace(F.regexp_replace(text, r"([a-z])v\.?([0-9])", "$1 $2"), r"\bv\.?\s?([0-9])", "$1")
    low = F.replace(F.when(text.rlike(r"v\.?\s?[0-9]"), low).otherwise(text), F.lit("licence"), F.lit("license"))
    words = F.transform(F.split(low, SPLIT), lambda x: F.when(F.contains(x, F.lit(".")), F.regexp_replace(F.trim(x, F.lit(".")), r"^([0-9]+)\.0$", "$1")).otherwise(x))
    return F.filter(words, lambda x: (x != "") & ~x.isin(*SKIPPED))


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns keep with ``n_candidates`` (lines in paragraphs that may be notices) and ``findings``: array of paragraph (number of its
    first line from 0), family, probability, similarity, confirmed."""
    slots, rows, bias, temperature, least, _, _ = model()
    n_classes = len(bias)
    at_slot, check_of = [0] * SLOTS, [-1] * SLOTS
    for slot, j in slots.items():
        at_slot[slot], check_of[slot] = j + 1, rows[j][0]
    at_slot, check_of = _literal(at_slot, "array<int>"), _literal(check_of, "array<int>")
    gains, zeros = _literal([r[1] for r in rows], "array<double>"), _literal([0] * n_classes, "array<long>")
    weights, held = _literal([[round(v * SCALE) for v in r[2]] for r in rows], "array<array<long>>"), _literal(templates(), "array<struct<k:int,phrase:string,words:array<string>,numbers:array<string>>>")
    biases = _literal(bias, "array<double>")
    # the most a family may lead unknown by must reach what the least probability asks for
    margin = temperature * float(np.log(least / (1 - least))) - (max(bias[:-1]) - bias[-1])

    lines_of = lambda of, i, n: F.transform(F.sequence(i, i + n - 1), lambda j: F.get(F.col(of), j))  # noqa: E731  # slice() would read all lines
    place = lambda h: h.bitwiseAND(F.lit(SLOTS - 1).cast("long")).cast("int")
    known = lambda h: F.get(check_of, place(h)) == F.shiftrightunsigned(h, 33).cast("int")
    pair = lambda a, b: F.xxhash64(F.concat(a, F.lit(" "), b))
    hashes = lambda ws: F.transform(ws, lambda x: F.xxhash64(x))
    grams_of = lambda ws: F.concat(hashes(ws), F.transform(F.sequence(F.lit(1), F.size(ws) - 1), lambda i: pair(F.get(ws, i - 1), F.get(ws, i))))
    features = lambda hs: F.transform(F.filter(hs, known), lambda h: F.get(at_slot, place(h)))
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = lambda js, start: F.aggregate(js, start, lambda s, j: plus(s, F.element_at(weights, j)))

    out = docs.withColumn("_lines", F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), "\n"))
    out = out.withColumn("_words", F.transform("_lines", _terms))
    # each line: the features of its words and pairs, and that of the pair of the last word before it and its first one
    out = out.withColumn("_features", F.transform("_words", lambda ws: F.when(F.size(ws) > 1, features(grams_of(ws))).otherwise(features(hashes(ws)))))
    before = lambda i: F.get(F.col("_words"), i - 1)
    across = F.transform(
        "_words",
        lambda ws, i: F.when((i > 0) & (F.size(ws) > 0) & (F.size(before(i)) > 0), features(F.array(pair(F.element_at(before(i), -1), F.get(ws, F.lit(0)))))).otherwise(F.expr("cast(array() as array<int>)")),
    )
    out = out.withColumn("_across", across)
    # the most its features can give, the number of its words, the sum of its features' weights, and that with the pair across
    firsts = F.transform(
        F.arrays_zip("_words", "_features", "_across"),
        lambda x: F.struct(
            F.aggregate(x["_features"], F.lit(0.0), lambda s, j: s + F.element_at(gains, j)).alias("own"), F.size(x["_words"]).cast("double").alias("n"),
            total(x["_features"], zeros).alias("s"), x["_across"].alias("across"),
        ),
    )
    out = out.withColumn("_sums", firsts)
    out = out.withColumn("_firsts", F.transform("_sums", lambda x: F.struct(x["own"].alias("own"), x["n"].alias("n"), x["s"].alias("s"), total(x["across"], x["s"]).alias("t"))))
    # paragraphs: from a line with words to a line with words, without a blank line among them, that may reach the threshold. Each takes its
    # sums from the paragraph that ends a line before: sums are of whole numbers, so their order doesn't matter
    none = F.expr("cast(array() as array<struct<n:int,k:int,p:double>>)")
    highest = max(r[1] for r in rows)

    def judged_by(v: Column, words: Column, lines: Column) -> Column:
        """A paragraph of these sums: itself with its family and probability, if a family is predicted."""
        scaled = F.transform(F.array(1 / (SCALE * F.sqrt(words))), lambda f: F.zip_with(v, biases, lambda a, b: a * f + b))
        tops = F.transform(scaled, lambda s: F.struct(s.alias("s"), F.array_max(s).alias("m")))
        kinds = F.transform(tops, lambda x: F.struct(x["s"].alias("s"), x["m"].alias("m"), F.array_position(x["s"], x["m"]).cast("int").alias("k")))
        rated = F.transform(
            F.filter(kinds, lambda x: x["k"] < n_classes),
            lambda x: F.struct(lines.alias("n"), x["k"].alias("k"), (1 / F.aggregate(x["s"], F.lit(0.0), lambda a, v: a + F.exp((v - x["m"]) / F.lit(temperature)))).alias("p")),
        )
        return F.filter(rated, lambda x: x["p"] >= least)

    def longer(first: Column):
        """The step from a paragraph to that of one more line. n is 0 before the first, and -1 after a blank line."""

        def step(a: Column, x: Column) -> Column:
            one = F.struct(
                (a["n"] + 1).alias("n"), (a["rest"] + F.when(a["n"] > 0, x["own"] + highest).otherwise(0.0)).alias("rest"), (a["words"] + x["n"]).alias("words"),
                F.when(a["n"] > 0, plus(a["v"], x["t"])).otherwise(x["s"]).alias("v"), a["reach"].alias("reach"), a["found"].alias("found"),
            )
            may = lambda b: first["own"] + b["rest"] >= margin * F.sqrt(b["words"])
            grown = F.transform(
                F.array(one),
                lambda b: F.when(
                    may(b),
                    F.struct(b["n"].alias("n"), b["rest"].alias("rest"), b["words"].alias("words"), b["v"].alias("v"), b["n"].alias("reach"), F.concat(b["found"], judged_by(b["v"], b["words"], b["n"])).alias("found")),
                ).otherwise(b),
            )
            over = F.struct(F.lit(-1).alias("n"), a["rest"].alias("rest"), a["words"].alias("words"), a["v"].alias("v"), a["reach"].alias("reach"), a["found"].alias("found"))
            return F.when((a["n"] < 0) | (x["n"] == 0), over).otherwise(F.get(grown, F.lit(0)))

        return step

    start = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("rest"), F.lit(0.0).alias("words"), zeros.alias("v"), F.lit(0).alias("reach"), none.alias("found"))
    windows = F.transform(
        "_firsts",
        lambda f, i: F.aggregate(lines_of("_firsts", i, F.least(F.lit(WRAP), F.size("_firsts") - i)), start, longer(f), lambda a: F.struct(i.alias("i"), a["reach"].alias("n"), a["found"].alias("found"))),
    )
    out = out.withColumn("_windows", F.filter(windows, lambda w: w["n"] > 0))
    best = F.flatten(F.transform("_windows", lambda w: F.transform(w["found"], lambda c: F.struct(w["i"].alias("i"), c["n"].alias("n"), c["k"].alias("k"), c["p"].alias("p")))))
    out = out.withColumn("_best", best)

    def shares(text: Column, own: Column):
        """How much of a template is in a text of these words."""
        return lambda t: F.when(t["phrase"].isNotNull(), F.when(F.contains(text, t["phrase"]), F.lit(1.0)).otherwise(0.0)).otherwise(F.size(F.array_intersect(t["words"], own)) / F.size(t["words"]))

    def template(text: Column, own: Column) -> Column:
        """The template, of those that the paragraph holds, with the most words in it: number of words, similarity, family."""
        share = shares(text, own)
        likes = F.filter(F.transform("_held", lambda t: F.struct(share(t).alias("like"), t["words"].alias("ws"), t["k"].alias("k"), t["numbers"].alias("numbers"))), lambda r: r["like"] >= CONFIRM)
        whole = F.filter(likes, lambda r: F.forall(r["numbers"], lambda w: F.array_contains(own, w)))
        return F.array_max(F.transform(whole, lambda r: F.struct(F.round(F.size(r["ws"]) * r["like"]).cast("int").alias("words"), r["like"].alias("like"), (-r["k"]).alias("k"))))

    spaced = lambda ws: F.concat(F.lit(" "), F.array_join(ws, " "), F.lit(" "))
    # a paragraph holds no more than its whole text does: of most texts nothing that any family predicted there could be confirmed by
    none = F.filter(held, lambda t: F.lit(False))
    out = out.withColumn("_kinds", F.array_distinct(F.transform("_best", lambda c: c["k"])))
    whole = F.when(F.size("_kinds") > 0, F.flatten("_words"))
    out = out.withColumn("_whole", F.transform(F.array(whole), lambda ws: F.struct(spaced(ws).alias("text"), F.array_distinct(ws).alias("own")))[0])
    within = shares(F.col("_whole.text"), F.col("_whole.own"))
    able = F.exists(F.filter(held, lambda t: F.array_contains("_kinds", t["k"])), lambda t: within(t) >= CONFIRM)
    out = out.withColumn("_held", F.when((F.size("_kinds") > 0) & able, F.filter(held, lambda t: within(t) >= CONFIRM)).otherwise(none))
    texts = F.transform(  # made once for all templates
        "_best",
        lambda c: F.struct(
            c["i"].alias("i"), c["n"].alias("n"), c["k"].alias("k"), c["p"].alias("p"),
            F.when(F.size("_held") > 0, F.transform(F.array(F.flatten(lines_of("_words", c["i"], c["n"]))), lambda ws: F.struct(spaced(ws).alias("text"), F.array_distinct(ws).alias("own")))[0]).alias("of"),
        ),
    )
    out = out.withColumn("_texts", F.filter(texts, lambda c: (c["n"] == 1) | c["of"].isNotNull()))
    judged = F.transform(
        "_texts",
        lambda c: F.struct(c["i"].alias("i"), c["n"].alias("n"), c["k"].alias("k"), c["p"].alias("p"), F.when(c["of"].isNotNull(), template(c["of"]["text"], c["of"]["own"])).alias("t")),
    )
    out = out.withColumn("_rated", judged)
    own = lambda c: F.coalesce(c["t"]["k"] == -c["k"], F.lit(False))  # noqa: E731  # confirmed
    shaped = F.transform(
        "_rated",
        lambda c: F.struct(
            F.when(own(c), -c["t"]["words"]).otherwise(0).alias("fewer"), F.when(own(c), -c["t"]["like"]).otherwise(0.0).alias("unlike"),
            c["n"].alias("n"), c["i"].alias("i"), c["k"].alias("k"), c["p"].alias("p"),
        ),
    )
    out = out.withColumn("_judged", shaped)
    out = out.withColumn("_sure", F.array_sort(F.filter("_judged", lambda c: c["unlike"] < 0)))
    meets = lambda c, d: (c["i"] < d["i"] + d["n"]) & (d["i"] < c["i"] + c["n"])
    chosen = F.aggregate(
        "_sure", F.filter("_sure", lambda c: F.lit(False)),
        lambda got, c: F.when(F.exists(got, lambda d: meets(c, d)), got).otherwise(F.concat(got, F.array(c))),
    )
    out = out.withColumn("_chosen", chosen)
    alone = F.filter("_judged", lambda c: (c["n"] == 1) & (c["unlike"] == 0) & ~F.exists("_chosen", lambda d: meets(c, d)))
    found = F.transform(
        F.array_sort(F.transform(F.concat("_chosen", alone), lambda c: F.struct(c["i"].cast("long").alias("i"), c["k"].alias("k"), c["p"].alias("p"), c["unlike"].alias("unlike")))),
        lambda c: F.struct(
            c["i"].alias("paragraph"), F.element_at(F.array(*map(F.lit, FAMILIES)), c["k"]).alias("family"), F.round(c["p"], 4).alias("probability"),
            F.round(-c["unlike"], 4).alias("similarity"), (c["unlike"] < 0).alias("confirmed"),
        ),
    )
    lines = F.expr("size(array_distinct(flatten(transform(_windows, w -> sequence(w.i, w.i + w.n - 1)))))")
    return out.withColumn("findings", found).withColumn("n_candidates", lines.cast("long")).select(*keep, "n_candidates", "findings")


def op10_licence_paragraphs(spark, sf_dir: str) -> DataFrame:
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])
    sure, rest = F.filter("findings", lambda f: f["confirmed"]), F.filter("findings", lambda f: ~f["confirmed"])
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda f: f["family"]))), ",")
    return out.select(
        "doc_id", "n_candidates", F.size(sure).cast("long").alias("n_confirmed"), names(sure).alias("licences"), names(rest).alias("unconfirmed"),
        F.array_join(F.transform(sure, lambda f: F.concat_ws(":", f["paragraph"].cast("string"), f["family"])), ",").alias("paragraphs"),
    )
