"""Licence families of paragraphs, by a trained classifier over word n-grams that a template must confirm.

A paragraph is what stands between blank lines, or between ends of sentences at ends of lines: notices are wrapped, so a line that goes on
belongs to the next. Comment marks at the start of lines are taken out. Words and word pairs with a telling word are features.
Multinomial logistic regression gives each family and ``unknown`` a probability; it is trained on parts of the templates below and on paragraphs
that are no licence. The temperature by which probabilities can be trusted is fitted on templates that the weights have not seen: each fold of templates is
scored by a model of the others.

A template confirms its family where enough of its word pairs are in the paragraph, and where at least half of those pairs are that a
related template of any other family lacks (``gnu general`` in place of ``gnu affero``). So a relative is not taken for the family it is like.
Paragraphs that look like a licence without being confirmed are ``unknown``.

Training takes the fixed texts below, so it is the same for any input. Scanning is one projection over the documents: no Python.

Defined cases: null and empty texts have no paragraphs; paragraphs are numbered from 0 in their text, blank ones left out, also where rows repeat;
ties between families go to the first by name; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobmeter.llm.quality import STOP_WORDS

UNKNOWN = "unknown"

# The names of the Creative Commons licences.
COMMONS = {
    "CC-BY": "Attribution",
    "CC-BY-NC": "Attribution-NonCommercial",
    "CC-BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
    "CC-BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "CC-BY-ND": "Attribution-NoDerivatives",
    "CC-BY-SA": "Attribution-ShareAlike",
}
# Versions of them with the word that follows.
COMMONS_VERSIONS = ("4.0 International", "3.0 Unported", "2.0 Generic")
# The GNU licences, by name and version.
GNU = {
    "AGPL-3.0": ("Affero General", "3", "19 November 2007"),
    "GPL-2.0": ("General", "2", "June 1991"),
    "GPL-3.0": ("General", "3", "29 June 2007"),
}
# Notices by which texts are put under the licences of a family.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "This software is released under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "CC0-1.0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "This work is released under the Creative Commons CC0 1.0 Universal Public Domain Dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "EPL-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "GFDL": (
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3",
        "This work is licensed under the GNU Free Documentation License.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "Released under the ISC License.",
        "SPDX-License-Identifier: ISC",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License.",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "GNU Lesser General Public License Version 3, 29 June 2007",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
    ),
    **{family: (
        f"This work is licensed under the GNU {name} Public License, version {version}.",
        f"you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation; either version {version}",
        f"GNU {name} Public License Version {version}, {date}",
        f"SPDX-License-Identifier: {family}-only",
        f"SPDX-License-Identifier: {family}-or-later",
    ) for family, (name, version, date) in GNU.items()},
    **{family: (
        *[f"This work is licensed under a Creative Commons {name} {version} License." for version in COMMONS_VERSIONS],
        f"Licensed under {family.replace('-', ' ', 1)} 4.0.",
        f"SPDX-License-Identifier: {family}-4.0",
    ) for family, name in COMMONS.items()},
}
# Paragraphs that share words with notices but are none, or put a text under no known licence.
OTHERS = (
    "All rights reserved. No part of this publication may be reproduced without permission.",
    "This work is licensed under terms agreed with the publisher.",
    "Licensed under a commercial agreement; contact the vendor for the license.",
    "Proprietary and confidential. Unauthorized copying of this file is prohibited.",
    "The driver's license was issued under the old rules.",
    "A fishing license is required; permission is granted by the county.",
    "The public library published a general version of the work.",
    "The apache helicopter was released in a new version.",
    "Students at MIT released the source of their work.",
    "The foundation is free to use the software of the public.",
    "It is the aim of this work to be of use to any person.",
    "The new version of the work was released under the name of its author.",
    "This is the file that you may use, and the one that they made.",
    "The commons are open to the public, with or without a guide.",
    "Creative work is under way, and the international version is to follow.",
    "You should have received a copy of the license along with this program.",
    "This program is distributed in the hope that it will be useful, but without any warranty.",
    "The software is provided as is, without warranty of any kind, express or implied.",
    "Unless required by applicable law or agreed to in writing, software distributed under the license is distributed as is.",
    "Permission is granted to students to copy the document for their own use.",
)
#: Different telling words that a paragraph must have to look like a licence.
LEAST_WORDS = 2
#: Word pairs of a template, in percent, that a paragraph must have.
CONFIRMED = 60
#: Templates that share this many of their word pairs, in percent, are related.
RELATED = 40
FOLDS = 4
_SEED = 7
_PLAIN = frozenset("a an any are if met not of or may part provided that this to v. you can it by as is for the either use without with 1.0 1.3 2 2.0 2.1 3 3.0 4.0 19 29".split())
# What comments begin a line with; a line of nothing else is blank.
_COMMENT = r"(?m)^[ \t]*(?:(?:#+|//+|/?\*+/?|--+|;+|%+|<!--|>+)[ \t]*)+"
# A paragraph ends at a blank line, or at an end of line after the end of a sentence.
_END = r"\n[ \t]*(?:\n[ \t]*)+|(?<=[.!?][\"')]{0,2}[ \t]{0,4})\n"


def words_of(text: str) -> list[str]:
    return [w for w in re.sub(r"[^a-z0-9.]+", " ", text.lower()).replace(". ", " ").strip(" .").split(" ") if w]


def pairs_of(words: list[str]) -> set[str]:
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


@dataclass
class Check:
    """What a paragraph is compared with: a template's word pairs, and those that each related template lacks."""

    pairs: list[str]
    own: list[list[str]]


@dataclass
class Model:
    families: list[str]  # unknown is the last
    telling: list[str]  # words of the templates that say something
    anchors: list[str]  # a few of them, of which each template has one
    cover: list[str]  # word pairs of which every paragraph that a template confirms has one
    weights: dict[str, list[float]]  # by feature, one for each family
    bias: list[float]
    checks: dict[str, list[Check]]  # by family


def _parts(words: list[str], rng: np.random.Generator, n: int) -> list[list[str]]:
    """Words, whole and with some left out at both ends."""
    out = [words]
    for _ in range(n):
        cut = rng.integers(0, max(1, len(words) // 4) + 1, 2)
        out.append(words[cut[0]:len(words) - cut[1]] or words)
    return out


def _anchors(texts: list[set[str]]) -> list[str]:
    """Few words of which each text has one: always the word that most of those left have."""
    found = []
    while texts := [t for t in texts if not t & set(found)]:
        counts = Counter(w for t in texts for w in t)
        found.append(min(counts, key=lambda w: (-counts[w], w)))
    return sorted(found)


def _cover(templates: list[list[str]], known: set[str]) -> list[str]:
    """Word pairs of which every paragraph that a template confirms has one: the other pairs of the template are too few."""
    found = set()
    counts = Counter(p for words in templates for p in pairs_of(words))
    for words in templates:
        pairs = pairs_of(words)
        while 100 * len(left := pairs - found) // max(1, len(pairs)) >= CONFIRMED:
            found.add(min(left, key=lambda p: (-len(known & set(p.split(" "))), -counts[p], p)))
    return sorted(found)


def _checks(pairs: dict[str, list[set[str]]]) -> dict[str, list[Check]]:
    found = {}
    for family, mine in pairs.items():
        others = [u for f in sorted(pairs) if f != family for u in pairs[f]]
        found[family] = [Check(sorted(t), sorted({tuple(sorted(t - u)) for u in others if 100 * len(t & u) >= RELATED * len(t)})) for t in mine]
    return found


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _regression(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros((x.shape[1], y.shape[1]))
    for _ in range(300):
        w -= 2.0 * (x.T @ (_softmax(x @ w) - y) / len(x) + 1e-4 * w)
    return w


@cache
def _default_model() -> Model:
    return train(TEMPLATES, OTHERS)


def train(templates: dict[str, tuple[str, ...]] = TEMPLATES, others: tuple[str, ...] = OTHERS) -> Model:
    """Regression over features of the templates, L2-regularised, with a temperature from templates left out of it."""
    rng = np.random.default_rng(_SEED)
    families = sorted(templates) + [UNKNOWN]
    notices = [(families.index(f), words_of(t)) for f in families[:-1] for t in templates[f]]
    pairs = {f: [pairs_of(words_of(t)) for t in templates[f]] for f in families[:-1]}
    telling = sorted({w for _, words in notices for w in words} - set(STOP_WORDS) - _PLAIN)
    known = set(telling)
    # A part that is also a part of another family's template tells nothing.
    rows = [(p, k, n) for n, (k, words) in enumerate(notices) for p in _parts(words, rng, 9)
            if not any(pairs_of(p) <= other for f in pairs if f != families[k] for other in pairs[f])]
    rows += [(p, len(families) - 1, n) for n, t in enumerate(others) for p in _parts(words_of(t), rng, 9)] + [([], len(families) - 1, n) for n in range(12)]

    def grams(words: list[str]) -> set[str]:
        return {g for g in {*words, *pairs_of(words)} if not known.isdisjoint(g.split(" "))}

    features = sorted({g for p, k, _ in rows if k < len(families) - 1 for g in grams(p)})
    at = {g: n for n, g in enumerate(features)}
    x, y = np.zeros((len(rows), len(features) + 1)), np.eye(len(families))[[k for _, k, _ in rows]]
    x[:, -1] = 1
    for n, (p, _, _) in enumerate(rows):
        x[n, [at[g] for g in grams(p) if g in at]] = 1
    # Whole templates are left out, not parts of them.
    fold = np.array([n % FOLDS for _, _, n in rows])
    unseen = np.zeros(y.shape)
    for k in range(FOLDS):
        unseen[fold == k] = x[fold == k] @ _regression(x[fold != k], y[fold != k])
    heat = min((0.25 * 1.25 ** k for k in range(16)), key=lambda t: -np.log(np.maximum(1e-12, (_softmax(unseen / t) * y).sum(1))).mean())
    w = np.round(_regression(x, y) / heat, 6)
    anchors = _anchors([set(words) & known for _, words in notices])
    return Model(families, telling, anchors, _cover([words for _, words in notices], known), {g: w[n].tolist() for g, n in at.items()}, w[-1].tolist(), _checks(pairs))


def _words(paragraph: Column) -> Column:
    clean = F.regexp_replace(F.lower(paragraph), "[^a-z0-9.]+", " ")
    clean = F.btrim(F.replace(clean, F.lit(". "), F.lit(" ")), F.lit(" ."))
    return F.filter(F.split(clean, " "), lambda w: w != "")


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text as an array, without comment marks and blank ones."""
    plain = F.regexp_replace(F.regexp_replace(text, "\\r", ""), _COMMENT, "")
    return F.filter(F.split(plain, _END), lambda p: ~p.rlike(r"^\s*$"))


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``doc_id, paragraph, family, probability, similarity, confirmed`` for each paragraph that looks like a licence or that a template confirms.

    ``similarity`` is the largest share, in percent, of the word pairs of a template of the family; ``family`` is that of the
    classifier where a template confirms it, else ``unknown``.
    """
    model = model or _default_model()
    # A plain search first, which leaves out texts and paragraphs that neither look like a licence nor could be confirmed by a template.
    search = lambda words: r"(?i)(?<![a-z0-9])(?:" + "|".join(r"[^a-z0-9]+".join(map(re.escape, w.split(" "))) for w in words) + r")(?![a-z0-9])"
    likely = search([*model.anchors, *model.cover])
    found = docs.where(F.col("text").rlike(likely)).select("doc_id", F.posexplode(paragraphs(F.col("text"))).alias("paragraph", "part"))
    found = found.where(F.col("part").rlike(likely)).select("doc_id", "paragraph", _words(F.col("part")).alias("words"), F.col("part").rlike(search(model.anchors)).alias("like"))
    telling = F.size(F.array_distinct(F.filter("words", lambda w: w.isin(*model.telling))))
    pairs = F.transform(F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.get("words", i), w))
    found = found.select("doc_id", "paragraph", "words", (F.col("like") & (telling >= LEAST_WORDS)).alias("like"), F.array_distinct(pairs).alias("pairs"))
    grams = F.array_distinct(F.concat("words", "pairs"))
    known = found.select("doc_id", "paragraph", "like", "pairs", F.filter(grams, lambda g: g.isin(*model.weights)).alias("features"))
    table = F.create_map(*[x for g, w in sorted(model.weights.items()) for x in (F.lit(g), F.array(*[F.lit(v) for v in w]))])
    start = F.array(*[F.lit(float(b)) for b in model.bias])
    sums = F.aggregate("features", start, lambda total, g: F.zip_with(total, F.element_at(table, g), lambda a, b: a + b))
    scored = known.select("doc_id", "paragraph", "like", "pairs", sums.alias("z"))
    total = F.aggregate("z", F.lit(0.0), lambda s, z: s + F.exp(z - F.array_max("z")))
    best = F.array_position("z", F.array_max("z")).cast("int")
    names = F.array(*[F.lit(f) for f in model.families])
    scored = scored.select("doc_id", "paragraph", "like", "pairs", F.element_at(names, best).alias("guess"), F.round(1 / total, 6).alias("probability"))
    # Only the templates of the family that the classifier names are compared.
    compared = F.struct(F.lit(False).alias("first"), F.lit(0).alias("similarity"), F.lit(False).alias("confirmed"))
    for family, checks in sorted(model.checks.items()):
        compared = F.when(F.col("guess") == family, F.array_max(F.array(*[_compared(c) for c in checks]))).otherwise(compared)
    shown = scored.select("doc_id", "paragraph", "like", "guess", "probability", compared.alias("c"))
    confirmed = (F.col("probability") >= 0.5) & F.col("c.confirmed")
    # The test stands in a generator: as a filter it would be worked out below the projections, and all they hold with it.
    row = F.struct(F.when(confirmed, F.col("guess")).otherwise(UNKNOWN).alias("family"), "probability", F.col("c.similarity").alias("similarity"), confirmed.alias("confirmed"), "like")
    return shown.select("doc_id", "paragraph", F.inline(F.filter(F.array(row), lambda r: r["like"] | r["confirmed"]))).drop("like")


def _compared(check: Check) -> Column:
    """Word pairs of a template that ``pairs`` has, in percent, and whether they confirm its family; confirming templates go first."""
    def n_of(some: list[str] | tuple[str, ...]) -> Column:
        return F.size(F.array_intersect("pairs", F.array(*[F.lit(p) for p in some])))

    share = F.floor(n_of(check.pairs) * 100 / len(check.pairs)).cast("int")
    confirmed = share >= CONFIRMED
    for own in check.own:
        # A template that is wholly in another family's tells nothing by itself.
        confirmed = confirmed & (n_of(own) * 2 >= len(own) if own else F.lit(False))
    return F.struct(confirmed.alias("first"), share.alias("similarity"), confirmed.alias("confirmed"))
