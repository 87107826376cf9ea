"""Licence notices: a trained classifier of paragraphs, scored with DataFrame functions only.

A multinomial logistic regression over word uni- and bigrams is trained on the small labelled table
below. A paragraph is a line. Scoring joins its n-grams to the sparse weights; a probability under the
calibrated bound makes it ``unknown``, and a predicted family counts only if the paragraph shares enough
n-grams with one of its templates.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semgraph.llm.common import Queries, table
from semgraph.session import materialize

QUERIES = Queries()

NONE = "none"
#: Share of held-out accepted predictions that must be right; sets the bound of the unknown class.
PRECISION = 0.98
#: Least share of the smaller n-gram set that a paragraph and a template of its family have in common.
OVERLAP = 0.6
#: Most n-grams in the model, which bounds what is broadcast.
MOST_GRAMS = 5000
#: Above the number of any gram; a pair of numbers is one integer.
PAIR = 1 << 13
#: Sums of weights in another order differ by less.
ROUNDING = 1e-9

# Abbreviations of licences that are no words of the corpus languages (as ``mit`` and ``by`` are).
SHORT = frozenset("gpl lgpl agpl bsd mpl spdx cc0 gnu".split())

# Wording of public licences and of the notices that refer to them.
NOTICES = {
    "MIT": """Released under the MIT License.
Licensed under the MIT license.
This project is licensed under the terms of the MIT license.
SPDX-License-Identifier: MIT
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
MIT licensed, see the LICENSE file for details.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0.
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
SPDX-License-Identifier: Apache-2.0
Released under the Apache 2.0 license.
This software is distributed under the terms of the Apache License version 2.
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS""",
    "GPL": """This work is licensed under the GNU General Public License, version 3.
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation
Licensed under the GNU GPL version 2 or later.
SPDX-License-Identifier: GPL-3.0-or-later
SPDX-License-Identifier: GPL-2.0-only
Released under the GPL, version 2.
You should have received a copy of the GNU General Public License along with this program.""",
    "LGPL": """Licensed under the GNU Lesser General Public License, version 2.1.
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
SPDX-License-Identifier: LGPL-2.1-or-later
Released under the LGPL, version 3.
You should have received a copy of the GNU Lesser General Public License along with this library.""",
    "AGPL": """Licensed under the GNU Affero General Public License, version 3.
you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
SPDX-License-Identifier: AGPL-3.0-only
Released under the AGPL version 3.
You should have received a copy of the GNU Affero General Public License""",
    "BSD": """Released under the BSD License.
Licensed under the 3-clause BSD license.
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
SPDX-License-Identifier: BSD-3-Clause
Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.""",
    "MPL-2.0": """Licensed under the Mozilla Public License, version 2.0.
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.
SPDX-License-Identifier: MPL-2.0
Released under the MPL 2.0.""",
    "CC-BY": """Licensed under CC BY 4.0.
This work is licensed under a Creative Commons Attribution 4.0 International License.
Except where otherwise noted, content is licensed under CC-BY 3.0.
SPDX-License-Identifier: CC-BY-4.0
Text available under the Creative Commons Attribution license, https://creativecommons.org/licenses/by/4.0/""",
    "CC-BY-NC": """Licensed under CC BY-NC 4.0.
This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.
Content is licensed under CC-BY-NC 3.0, non-commercial use only.
SPDX-License-Identifier: CC-BY-NC-4.0
Shared under the Creative Commons Attribution NonCommercial license, https://creativecommons.org/licenses/by-nc/4.0/""",
    "CC-BY-SA": """Licensed under CC BY-SA 4.0.
This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.
Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.
SPDX-License-Identifier: CC-BY-SA-4.0
Content is licensed under CC-BY-SA 3.0, share alike.""",
    "CC0": """To the extent possible under law, the author has waived all copyright and related rights to this work.
Dedicated to the public domain under CC0 1.0.
This is free and unencumbered software released into the public domain.
SPDX-License-Identifier: CC0-1.0
This work has been dedicated to the public domain, Creative Commons Zero.""",
    "reserved": """Copyright (c) 2020 Example Corporation. All rights reserved.
All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher.
Copyright 2019 by the authors. All rights reserved.
Proprietary and confidential. Unauthorized copying of this file is strictly prohibited.
This material may not be published, broadcast, rewritten or redistributed.""",
    NONE: """The driver had to show a license before the car was released.
She asked for permission to leave the work to the others and went home.
This is the first version of the story that I have read, and I like it.
You may obtain the tickets at the door of the theatre on the day.
All of the terms of the agreement were met by the end of the year.
The work of the artist is on show in the public hall until May.
A free copy of the book was given to any person at the fair.
In the above notice the city asks for the use of the other road.
The source of the river is in the north, along with two lakes and a forest.
They have the right to be heard, and the law will be on their side.
The file is on the table and the list of names is in the drawer.
The program of the evening begins at eight and ends at eleven.
The library is open for all students from nine to six.
This project is about the history of the common house.
The software is fast, and the documentation can be found on the site.
Provided that the weather is fine, we will be there with the children.
The general said that the foundation of the state is its people.
It is not possible to do it at this time, as far as I know.
The company published its report in the last week of March.
Modify the recipe as you like; the following steps are for four people.
Es ist nicht bekannt, unter welchen Bedingungen die Arbeit getan wurde.
Der Text liegt vor und kann von allen gelesen werden.
Sie fuhr mit den Kindern in die Stadt und kam mit dem Zug zur Arbeit.
Er ist mit der Frau und mit einem Freund am See.
Und wer nicht mit ihr geht, kommt mit mir.
La obra fue publicada por la ciudad en el mes de mayo de este año.
El autor tiene todos los libros en la casa de su madre.
Le travail est fini et la maison est ouverte au public.
Tous les droits sont connus des habitants de la ville.
With or without the files, the code must be in the original form.
The conditions at sea were bad, and the written word was of no use.
Two versions of the international paper are available under the bridge.
Example of content that is subject to change and may not be noted.""",
}


def grams_of(text: str) -> list[str]:
    words = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return sorted({*words, *(" ".join(p) for p in pairwise(words))})


def _fit(rows: list[list[str]], classes: np.ndarray, n_classes: int, vocabulary: dict[str, int]) -> np.ndarray:
    """Weights of grams and, in the last row, of the constant, by gradient descent with momentum."""
    x = np.zeros((len(rows), len(vocabulary) + 1))
    x[:, -1] = 1
    for i, row in enumerate(rows):
        x[i, [vocabulary[g] for g in row if g in vocabulary]] = 1
    y, w = np.eye(n_classes)[classes], np.zeros((x.shape[1], n_classes))
    step = np.zeros_like(w)
    for _ in range(400):
        step = 0.9 * step - 0.02 * (x.T @ (_softmax(x @ w) - y) + 0.05 * w)
        w += step
    return w


def _softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _chances(w: np.ndarray, rows: list[list[str]], vocabulary: dict[str, int]) -> np.ndarray:
    return _softmax(np.array([w[[vocabulary[g] for g in r if g in vocabulary]].sum(0) + w[-1] for r in rows]))


@functools.cache
def model() -> dict:
    """Weights by gram, constants, telling words, and the calibrated bound of the unknown class.

    Leave-one-out predictions over the labelled table give the bound: the least probability from
    which on ``PRECISION`` of the accepted predictions are right."""
    families = list(NOTICES)
    rows, classes = [], []
    for c, notices in enumerate(NOTICES.values()):
        for line in notices.split("\n"):
            rows.append(grams_of(line))
            classes.append(c)
    classes = np.array(classes)
    grams = sorted({g for r in rows for g in r})[:MOST_GRAMS]
    vocabulary = {g: i for i, g in enumerate(grams)}
    best, right = [], []
    for fold in range(10):
        out = np.arange(len(rows)) % 10 == fold
        w = _fit([r for r, o in zip(rows, out) if not o], classes[~out], len(families), vocabulary)
        p = _chances(w, [r for r, o in zip(rows, out) if o], vocabulary)
        best += p.max(1).tolist()
        right += (p.argmax(1) == classes[out]).tolist()
    order = np.argsort(best)[::-1]
    exact = np.cumsum(np.array(right)[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(exact >= PRECISION)
    bound = float(np.array(best)[order][good[-1]]) if len(good) else 1.0
    w = _fit(rows, classes, len(families), vocabulary)
    plain = {g for r, c in zip(rows, classes) if families[c] == NONE for g in r}
    telling = sorted({g for r, c in zip(rows, classes) if families[c] != NONE for g in r
                      if " " not in g and len(g) > 4 and not g.isdigit() and g not in plain}
                     | SHORT | {"license", "licensed", "copyright", "permission"})
    return {"families": families, "grams": grams, "weights": w, "telling": telling, "bound": max(bound, 0.5),
            "held_out": float(np.mean(right)),
            "templates": [(families[c], t, g) for t, (r, c) in enumerate(zip(rows, classes)) if families[c] != NONE for g in r]}


def _words(line: Column) -> Column:
    return F.array_remove(F.split(F.lower(line), "[^a-z0-9]+"), "")


def _constant(values: list, kind: str) -> Column:
    """An array as one literal, which the optimizer folds."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _places(keys: list, hash_of: Callable[[list, int], list[int]]) -> tuple[int, list]:
    """A modulus under which no two hashes of ``keys`` meet, and the keys by their place under it."""
    hashes = np.array(hash_of(keys))
    size = 4 * len(keys) + 1
    while len(np.unique(hashes % size)) < len(keys):
        size += 2
    table = [None] * size
    for key, place in zip(keys, (hashes % size).tolist()):
        table[place] = key
    return size, table


@functools.cache
def _lookup() -> dict:
    """Tables that find a word, then a pair of words, by a hash without collisions; and by a gram's
    number how far it moves each family ahead of none."""
    fitted = model()
    at = {g: i for i, g in enumerate(fitted["grams"])}
    words = [g for g in at if " " not in g]
    pairs = {at[a] * PAIR + at[b]: at[g] for g in at if " " in g for a, b in [g.split(" ")]}
    n_words, by_word = _places(words, lambda ks: [zlib.crc32(k.encode()) for k in ks])
    n_pairs, by_pair = _places(list(pairs), lambda ks: ks)
    none = fitted["families"].index(NONE)
    ahead = np.delete(fitted["weights"] - fitted["weights"][:, [none]], none, 1)
    return {"n_words": n_words, "words": [w or "" for w in by_word], "numbers": [at.get(w, -1) for w in by_word],
            "n_pairs": n_pairs, "pairs": [-1 if p is None else p for p in by_pair],
            "pair_numbers": [pairs.get(p, -1) for p in by_pair], "ahead": ahead}


def known_grams(words: Column) -> Column:
    """Numbers of the model's uni- and bigrams that ``words`` holds, each once; every word of a
    bigram is a unigram of the model."""
    t = _lookup()
    names, numbers = _constant(t["words"], "string"), _constant(t["numbers"], "int")
    keys, pair_numbers = _constant(t["pairs"], "int"), _constant(t["pair_numbers"], "int")

    def number(word: Column) -> Column:
        place = (F.crc32(word.cast("binary")) % F.lit(t["n_words"])).cast("int")
        return F.when(F.get(names, place) == word, F.get(numbers, place)).otherwise(-1)

    def pair(a: Column, b: Column) -> Column:
        key = a * PAIR + b
        place = key % F.lit(t["n_pairs"])
        return F.when((a >= 0) & (b >= 0) & (F.get(keys, place) == key), F.get(pair_numbers, place)).otherwise(-1)

    # the numbers of the words are made once, then passed on
    return F.flatten(F.transform(F.array(F.transform(words, number)), lambda own: F.array_remove(F.array_distinct(
        F.concat(own, F.zip_with(own, F.slice(own, 2, F.greatest(F.size(own) - 1, F.lit(0))), pair))), -1)))


def beats_none(grams: Column) -> Column:
    """Whether a family scores above none, up to rounding, for a line of these grams of the model."""
    ahead = _lookup()["ahead"]
    start, ahead = ahead[-1], ahead[:-1]

    def total(moves: np.ndarray, at: float) -> Column:
        table = _constant(moves.tolist(), "double")
        return F.aggregate(grams, F.lit(float(at)), lambda so_far, gram: so_far + F.get(table, gram))

    # no family can be ahead if the sum of each gram's best move is not; only other lines are scored by family
    bound = total(ahead.max(1), start.max())
    scores = [total(ahead[:, f], start[f]) for f in range(ahead.shape[1])]
    return F.when(bound < -ROUNDING, False).otherwise(F.greatest(*scores) >= -ROUNDING)


def licence_paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, body, pos, family, chance, confirmed`` of the lines of ``docs(doc_id, text)`` that the
    classifier takes for a licence notice; ``body`` is a hash of the text.

    ``family`` is ``unknown`` where no family is probable enough or the templates do not confirm it.
    Every line is scored: in place first, by looking its n-grams up in constant tables, and only the lines
    where a family scores above none go on.
    """
    spark, fitted = docs.sparkSession, model()
    n = len(fitted["families"])
    weights = spark.createDataFrame(
        [(g, [float(v) for v in w]) for g, w in zip(fitted["grams"], fitted["weights"])], "gram string, w array<double>")
    templates = spark.createDataFrame(fitted["templates"], "family string, template int, gram string")
    lines = docs.select("doc_id", F.xxhash64("text").alias("body"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    worded = lines.select("doc_id", "body", "pos", _words(F.col("line")).alias("words"))
    # stored: few lines are left, and their words are then read, not split anew for every pair
    telling = materialize(worded.withColumn("known", known_grams(F.col("words"))).filter(beats_none(F.col("known"))).drop("known"))
    places = F.sequence(F.lit(0), F.greatest(F.size("words") - 2, F.lit(0)))
    pairs = F.when(F.size("words") > 1, F.transform(
        places, lambda i: F.concat_ws(" ", F.get("words", i), F.get("words", i + 1)))).otherwise(F.array().cast("array<string>"))
    # one column that is never null, so that rows without doc_id meet their own n-grams too
    key = ["at"]
    grams = telling.select(F.struct("doc_id", "body", "pos").alias("at"), F.array_distinct(F.concat("words", pairs)).alias("grams"))
    # at most MOST_GRAMS rows; a line's n-grams stay in its task up to the sums
    met = grams.select(*key, F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(F.broadcast(weights), "gram", "left")
    sums = met.groupBy(*key).agg(F.first("n").alias("n"), *[F.sum(F.get("w", F.lit(i))).alias(f"s{i}") for i in range(n)])
    scores = F.array(*[F.coalesce(f"s{i}", F.lit(0.0)) + float(fitted["weights"][-1][i]) for i in range(n)])
    top = F.array_max("scores")
    chance = F.lit(1.0) / F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s - F.col("top")))
    named = F.array(*map(F.lit, fitted["families"]))
    predicted = (sums.withColumn("scores", scores).withColumn("top", top).withColumn("chance", chance)
                 .select(*key, "n", F.get(named, F.array_position("scores", F.col("top")) - 1).alias("family"), "chance")
                 .filter(F.col("family") != NONE))
    sizes = templates.groupBy("template").agg(F.count("*").alias("size"))
    sized = templates.join(sizes, "template")
    shared = (grams.select(*key, F.explode("grams").alias("gram")).join(F.broadcast(sized), "gram")
              .groupBy(*key, "family", "template").agg((F.count("*")).alias("both"), F.first("size").alias("size")))
    compared = predicted.join(shared, [*key, "family"], "left").groupBy(*key, "family").agg(
        F.first("chance").alias("chance"),
        F.max(F.coalesce(F.col("both") / F.least("n", "size"), F.lit(0.0))).alias("overlap"))
    confirmed = (F.col("chance") >= fitted["bound"]) & (F.col("overlap") >= OVERLAP)
    return compared.select("at.doc_id", "at.body", "at.pos", F.when(confirmed, F.col("family")).otherwise("unknown").alias("family"),
                           F.round("chance", 6).alias("chance"), confirmed.alias("confirmed"))


def licence_documents(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: ``n_paragraphs`` (lines with text), ``n_notices``,
    ``n_unknown`` (notices of no known family) and ``families`` (confirmed, sorted, comma-joined, empty if none).

    Null and empty texts have no paragraphs. Rows that share a ``doc_id`` are kept apart by their texts.
    """
    found = licence_paragraphs(docs.select("doc_id", "text")).groupBy("doc_id", "body").agg(
        F.count("*").alias("n_notices"), F.count_if(~F.col("confirmed")).alias("n_unknown"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families")
    ).withColumnsRenamed({"doc_id": "f_id", "body": "f_body"})
    own = docs.select("doc_id", F.xxhash64("text").alias("body"), F.size(F.filter(
        F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.trim(line) != "")).cast("long").alias("n_paragraphs"))
    met = own.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("body") == F.col("f_body")), "left")
    zero = F.lit(0).cast("long")
    return met.select("doc_id", "n_paragraphs", F.coalesce("n_notices", zero).alias("n_notices"),
                      F.coalesce("n_unknown", zero).alias("n_unknown"), F.coalesce("families", F.lit("")).alias("families"))


@QUERIES.add("op2_license_scan")
def op2(spark, sf):
    return licence_documents(table(spark, sf, "documents"))
