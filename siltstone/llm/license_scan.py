"""Licence scans: a trained classifier over sparse word n-grams, confirmed by comparison with templates.

Scanning uses DataFrame functions only, and looks at every word of every text. Words are numbered by the vocabulary of the
notices below; line breaks, comment marks and doubled spaces don't matter. Neighbouring vocabulary words that aren't mere
function words make a unit, a paragraph of licence talk however its lines are broken: a unit goes on as long as the next such
word comes within a few words. A unit's features are the word 1-, 2- and 3-grams in it that the notices have; other n-grams
have no weight, so that text without vocabulary words can't change a verdict. Multinomial logistic regression gives the odds of each licence family and of
'unknown'. It is trained on the driver from the notices, worn down and padded with foreign words, against near misses; the
probability that a family needs is calibrated on other worn copies and near misses. A prediction stands only if the unit
also holds most word pairs of one of the family's templates, most of those that no other family has, and fits no template of
another family better; besides the likeliest family, any other one with odds enough and a template confirmed is given too.
A family of several versions has a class for each, and one for notices that name none.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence families, the names by which they are called, and sentences of their notices.
NAMES = {
    "AGPL-3.0": ["GNU Affero General Public License", "GNU Affero General Public License version 3", "GNU Affero General Public License v3.0", "GNU AGPL version 3", "AGPL v3", "AGPLv3", "AGPL license"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache 2 license", "Apache License", "Apache Software License"],
    "BSD": ["BSD license", "BSD style license"],
    "BSD-2-Clause": ["BSD 2-Clause License", "BSD 2-Clause", "2-clause BSD license", "Simplified BSD License", "two-clause BSD license", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "BSD 3-Clause", "3-clause BSD license", "New BSD License", "Modified BSD License", "three-clause BSD license"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "Creative Commons Attribution 4.0"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "Creative Commons Attribution Non Commercial 4.0"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "Creative Commons Attribution Share Alike 4.0"],
    "CC0-1.0": ["Creative Commons Zero v1.0 Universal license", "CC0 1.0 Universal", "CC0 1.0", "CC0 license", "CC0 Public Domain Dedication"],
    "GPL": ["GNU General Public License", "GNU GPL", "GPL license"],
    "GPL-2.0": ["GNU General Public License version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GNU GPL v2", "GPL version 2", "GPL v2", "GPLv2", "GPL 2.0 license"],
    "GPL-3.0": ["GNU General Public License version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GNU GPL v3", "GPL version 3", "GPL v3", "GPLv3", "GPL 3.0 license"],
    "ISC": ["ISC License", "ISC licence", "Internet Systems Consortium license"],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL", "LGPL license"],
    "LGPL-2.1": ["GNU Lesser General Public License version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL version 2.1", "LGPL version 2.1", "LGPL v2.1", "LGPLv2.1", "LGPL 2.1 license"],
    "LGPL-3.0": ["GNU Lesser General Public License version 3", "GNU Lesser General Public License v3.0", "GNU LGPL version 3", "LGPL version 3", "LGPL v3", "LGPLv3", "LGPL 3.0 license"],
    "MIT": ["MIT License", "MIT licence", "MIT licensed", "Expat License"],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "Mozilla Public License v. 2.0", "Mozilla Public License 2.0", "MPL 2.0", "Mozilla Public License"],
    "Unlicense": ["The Unlicense", "Unlicense license"],
}
SENTENCES = {
    "AGPL-3.0": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "Apache-2.0": ["you may not use this file except in compliance with the License", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer", "Redistributions in binary form must reproduce the above copyright notice"],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "nor the names of its contributors may be used to endorse or promote products derived from this software"],
    "CC0-1.0": ["dedicated to the public domain under CC0 1.0", "waived all copyright and related or neighboring rights to this work"],
    "GPL": ["it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "GPL-2.0": ["it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version", "under the terms of the GNU General Public License version 2 only", "under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"],
    "GPL-3.0": ["it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "under the terms of the GNU General Public License version 3 or any later version"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "LGPL-2.1": ["it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "LGPL-3.0": ["it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "MPL-2.0": ["subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
}
#: Endings of a family's SPDX identifiers.
ENDINGS = {"AGPL-3.0": ("", "-only", "-or-later"), **{x: ("-only", "-or-later", "", "+") for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")}}
UNVERSIONED = ("BSD", "GPL", "LGPL")
#: What comes before a licence's name in running text, for training.
LEADS = ["licensed under the", "released under the", "distributed under the terms of the", "made available under the", "is subject to the", "covered by the", "under", "see the", "License:"]
# Sentences that look alike but name none of the families; licences of other families among them.
NEAR_MISSES = [
    "All rights reserved", "Copyright by the authors", "a driver license is needed", "the license was revoked by the city", "software license agreement for customers", "this work is copyrighted",
    "licensed under a commercial agreement with the vendor", "he got his license in version 2", "permission is granted by the teacher", "the public domain of the king", "released under the bridge",
    "the free software was distributed to the general public", "redistribution of income in binary terms", "the Massachusetts Institute of Technology released a report", "the apache people", "creative work in the commons",
    "SPDX-License-Identifier: LicenseRef-Proprietary", "SPDX-License-Identifier: Zlib", "SPDX-License-Identifier: EPL-2.0", "licensed under the terms agreed with the owner", "under the license of the county, section 3",
    "licensed under the zlib License", "released under the Eclipse Public License 2.0", "under the Microsoft Public License", "distributed under the Artistic License 2.0", "licensed under the European Union Public Licence, version 1.2",
    "Boost Software License, Version 1.0", "GNU Free Documentation License, Version 1.3", "a version 2 of the program was published by the foundation", "the terms of the lease, at your option, either version 3", "you can modify the general terms of the public tender",
    "in compliance with the law of the general public", "a copy of the file was not distributed with the program", "the name of the holder may be used to promote products", "any later version of the document is published in the public records", "Microsoft Software License Terms",
]


def _notices() -> dict[str, list[str]]:
    """The templates of each family: names, sentences, SPDX identifiers."""
    out = {}
    for family, names in NAMES.items():
        ids = [] if family in UNVERSIONED else [family + x for x in ENDINGS.get(family, ("",))]
        out[family] = [*names, *SENTENCES.get(family, ()), *(f"SPDX-License-Identifier: {x}" for x in ids), *(f"license: {x}" for x in ids)]
    return out


NOTICES = _notices()


# Words that alone don't tell of a licence.
FUNCTION_WORDS = "a all an and any are as at be by can copy either file following for form free from he his in included is it its later list may must name new not of on one only or other person product products program public same section see shall that the this to under use used using version was with without work works world you your".split()
#: Numbers of versions: no unit begins with them either, but they tell one licence from another.
VERSIONS = "1.0 2 2.0 2.1 3 3.0 4.0 v".split()
#: What stands between words: white space and punctuation, but for dots inside of words, and plus signs.
BREAK = r"\.*[\x00-*,\-/:-@\[-`{-\u00a9\u00ab-\u00b4\u00b6-\u00bf\u2000-\u206f\u3000-\u303f]+|\.+$"
LICENCE_WORD = r"licen[cs]|spdx"


@dataclass(frozen=True)
class LicenseParams:
    #: Words from one vocabulary word of a unit to the next, at most.
    gap: int = 6
    #: Share of a template's word pairs that a unit must hold.
    containment: float = 0.6
    steps: int = 250
    rate: float = 0.5
    penalty: float = 1e-3
    #: Cells of each of the two tables in which words and n-grams are looked up.
    cells: int = 1 << 14


def _words(text: Column) -> Column:
    """Lower-case words; empty ones may stand at the ends."""
    return F.split(F.lower(text), BREAK)


def _array(values: list, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


class _Table:
    """Numbers, from 1, of known keys: two tables of cells, of which the second holds what finds its cell in the first taken."""

    def __init__(self, spark: SparkSession, keys: list, kind: str, cells: int):
        self.keys, self.kind, salt, left = _array([None, *keys], kind), kind, 0, list(range(1, len(keys) + 1))
        self.parts: list[tuple[int, int, Column]] = []
        while left:
            own = spark.range(1).select(F.transform(_array([keys[i - 1] for i in left], kind), lambda k: self._cell(k, salt, cells)).alias("c")).first().c  # noqa: B023
            table, later = [0] * cells, []
            for i, c in zip(left, own):
                if table[c]:
                    later.append(i)
                else:
                    table[c] = i
            if len(later) == len(left):
                raise ValueError("repeated keys")
            self.parts.append((salt, cells, _array(table, "int")))
            if not salt:  # most keys asked for fail at the first look
                every = spark.range(1).select(F.transform(_array(keys, kind), lambda k: self._cell(k, 0, cells)).alias("c")).first().c
                self.taken = _array(np.isin(np.arange(cells), every).tolist(), "boolean")
            left, salt = later, salt + 1

    @staticmethod
    def _cell(key: Column, salt: int, cells: int) -> Column:
        return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(cells)).cast("int")

    def number(self, key: Column) -> Column:
        """The number of key, 0 if it isn't known."""
        out = F.lit(0)
        for salt, cells, table in reversed(self.parts):
            at = F.get(table, self._cell(key, salt, cells))
            out = F.when(F.get(self.keys, at) == key, at).otherwise(out)
        salt, cells, _ = self.parts[0]
        return F.when(F.get(self.taken, self._cell(key, salt, cells)), out).otherwise(0)


def _worn(sentence: str, rng: np.random.Generator) -> str:
    """A copy with some words lost, if it has many, and foreign words around."""
    words = sentence.split()
    kept = [w for w in words if len(words) < 8 or rng.random() > 0.08]
    noise = ["".join(rng.choice(list("abdeghilmnorstu"), rng.integers(2, 9))) for _ in range(rng.integers(0, 7))]
    cut = rng.integers(0, len(noise) + 1)
    return " ".join([*noise[:cut], *kept, *noise[cut:]])


class Classifier:
    """Vocabulary, features, families ('unknown' last), weights (feature by family), biases, and the probability that a family needs."""

    def __init__(self, spark: SparkSession, p: LicenseParams):
        rng = np.random.Generator(np.random.PCG64(3))
        self.p, self.families = p, [*NOTICES, "unknown"]
        unknown = len(NOTICES)
        plain = list(dict.fromkeys([*(x for name in NOTICES for x in NOTICES[name]), *LEADS, *NEAR_MISSES]))
        cut = dict(zip(plain, spark.range(1).select(F.transform(_array(plain, "string"), lambda x: F.filter(_words(x), lambda w: w != "")).alias("w")).first().w))
        vocabulary = sorted({w for words in cut.values() for w in words}, key=lambda w: (w not in FUNCTION_WORDS, w not in VERSIONS, w))
        number = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.size, self.vocabulary = len(vocabulary) + 1, vocabulary
        mere = sum(w in FUNCTION_WORDS for w in vocabulary)  # versions have larger numbers, and core words still larger ones
        self.plain = mere + sum(w in VERSIONS for w in vocabulary)
        found: dict[int, None] = {}
        for words in cut.values():
            ids = [number[w] for w in words]
            for n in (1, 2, 3):
                for i in range(len(ids) - n + 1):
                    if max(ids[i : i + n]) > (self.plain if n == 1 else mere):
                        found.setdefault(self._key(ids[i : i + n]))
        self.known = {k: i + 1 for i, k in enumerate(found)}
        self.words, self.grams = _Table(spark, vocabulary, "string", p.cells), _Table(spark, list(found), "bigint", p.cells)
        # Pairs of each template, as features; which other families' templates are much like it; and which pairs no other family has.
        pairs = lambda x: [self.known[k] for k in dict.fromkeys(self._key([number[a], number[b]]) for a, b in zip(cut[x], cut[x][1:])) if k in self.known]
        self.templates = [(k, t) for k, name in enumerate(NOTICES) for x in NOTICES[name] if (t := pairs(x) or [self.known[number[w]] for w in cut[x] if number[w] in self.known])]
        many = [(k, set(t)) for k, t in self.templates]
        alike = lambda s, t: 2 * len(s & t) >= min(len(s), len(t))
        self.rivals = [[j for j, (l, t) in enumerate(many) if l != k and alike(s, t)] for k, s in many]
        self.larger = [[j for j, (l, t) in enumerate(many) if l != k and s < t] for k, s in many]
        of = [set().union(*(t for l, t in many if l == k)) for k in range(unknown)]
        self.telling = [[f for f in t if not any(f in x for l, x in enumerate(of) if l != k)] for k, t in self.templates]
        plainly = [(x, k) for k, name in enumerate(NOTICES) for x in NOTICES[name]] + [(f"{lead} {x}", k) for k, name in enumerate(NOTICES) for x in NAMES[name] for lead in LEADS]
        rows = [(s, k, part) for x, k in plainly for part in (0, 1) for s in (x, *(_worn(x, rng) for _ in range(8 if len(x.split()) >= 8 else 2)))]
        rows += [(s, unknown, part) for x in NEAR_MISSES for part in (0, 1) for s in (x, *(_worn(x, rng) for _ in range(10)))]
        common = [w for w in vocabulary if sum(any(w in cut[x] for x in NOTICES[name]) for name in NOTICES) != 1]  # words that one family alone has aren't noise
        rows += [(" ".join(rng.choice(common, rng.integers(1, 5))), unknown, part) for part in (0, 1) for _ in range(300)]
        texts = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, text string").repartition(8, "i")
        numbered = texts.select("i", self.numbers(_words(F.col("text"))).alias("v"))
        x = np.zeros((len(rows), len(self.known) + 1), np.float32)
        for r in numbered.select("i", self.features(F.col("v"), F.lit(0), F.size("v") - 1).alias("f")).collect():  # the training texts
            x[r.i, r.f] = 1
        y, part = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        target = np.eye(len(self.families), dtype=np.float32)[y]
        own = part == 0
        a, t = x[own], target[own]
        back = np.ascontiguousarray(a.T)
        weight = (len(a) / (len(self.families) * target[own].sum(0)))[y[own], None].astype(np.float32) ** 0.5  # families of few notices count for more
        w, b = np.zeros((x.shape[1], len(self.families)), np.float32), np.zeros(len(self.families), np.float32)
        sw, sb = np.full_like(w, 1e-8), np.full_like(b, 1e-8)
        for _ in range(p.steps):
            e = self._softmax(a @ w + b) - t
            e *= weight
            gw, gb = back @ e / len(a) + p.penalty * w, e.mean(0)
            sw += gw * gw
            sb += gb * gb
            w -= p.rate * gw / np.sqrt(sw)
            b -= p.rate * gb / np.sqrt(sb)
        self.weights, self.bias = np.round(w.astype(np.float64), 3), np.round(b.astype(np.float64), 3)
        prob = self._softmax(x[~own] @ self.weights + self.bias)
        best, top = prob[:, :unknown].argmax(1), prob[:, :unknown].max(1)
        wrong = top[(y[~own] == unknown) | (best != y[~own])]  # what must stay below
        self.least = float(np.round(np.clip(np.quantile(wrong, 0.99) if len(wrong) else 0.5, 0.5, 0.9), 3))

    def _key(self, ids: list[int]) -> int:
        """One number for an n-gram of vocabulary numbers."""
        return reduce(lambda k, i: k * self.size + i, ids, 0)

    def numbers(self, words: Column) -> Column:
        """Vocabulary numbers of words, 0 for all others."""
        return F.transform(words, self.words.number)

    def features(self, numbers: Column, low: Column, high: Column) -> Column:
        """Distinct features of the n-grams within places low to high of numbers."""

        def ending(i: Column) -> Column:
            a, b, c = (F.get(numbers, i - k).cast("long") for k in (2, 1, 0))
            two = F.when((i > low) & (b > 0), b * self.size + c)
            three = F.when((i > low + 1) & (a > 0) & (b > 0), (a * self.size + b) * self.size + c)
            return F.when(c > 0, F.array(c, two, three))

        keys = F.filter(F.flatten(F.filter(F.transform(F.sequence(low, high), ending), lambda x: x.isNotNull())), lambda k: k.isNotNull())
        found = F.transform(F.array_distinct(keys), self.grams.number)
        return F.when(high >= low, F.filter(found, lambda f: f > 0)).otherwise(F.array().cast("array<int>"))

    def with_units(self, df: DataFrame) -> DataFrame:
        """df (_v: vocabulary numbers) with _units, array<struct(low, high)>: runs of core words no more than gap words apart, with two words more at each end.

        The arrays that lambdas look into are columns of their own, each used more than once, so that none is worked out anew
        for each element.
        """
        found = F.filter(F.transform("_v", lambda v, i: F.when(v > self.plain, i)), lambda i: i.isNotNull())
        df = df.withColumn("_core", F.when(F.array_max("_v") > self.plain, found).otherwise(F.array().cast("array<int>")))
        core, first = F.col("_core"), F.col("_first")
        df = df.withColumn("_first", F.filter(F.transform(core, lambda c, k: F.when((k == 0) | (c - F.get(core, k - 1) > self.p.gap), k)), lambda k: k.isNotNull()))
        low = lambda k: F.greatest(F.get(core, k) - 2, F.lit(0))
        high = lambda k: F.least(F.get(core, F.coalesce(k - 1, F.size(core) - 1)) + 2, F.size("_v") - 1)
        return df.withColumn("_units", F.transform(first, lambda k, n: F.struct(low(k).alias("low"), high(F.get(first, n + 1)).alias("high"))))

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


_trained: dict[tuple[str, LicenseParams], Classifier] = {}


def classifier(spark: SparkSession, p: LicenseParams) -> Classifier:
    """Trained once in an application: the notices don't change."""
    key = (spark.sparkContext.applicationId, p)
    if key not in _trained:
        _trained.clear()
        _trained[key] = Classifier(spark, p)
    return _trained[key]


def scan(docs: DataFrame, p: LicenseParams = LicenseParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_candidates, family, families, probability, containment for every row.

    families: the confirmed families of all units, ascending; family: the most probable confirmed one (of equals the first by
    name), 'unknown' if the text has candidates but none confirmed, 'none' without candidates (also for null and empty
    texts). A candidate is a unit with a word for a licence, or one whose likeliest class is a family. probability and
    containment: the largest of that family's confirmed units, null without one. Whole texts are scanned; repeated rows give
    the same; an empty table gives an empty result. Other columns are not looked at.
    """
    model = classifier(docs.sparkSession, p)
    k = len(model.families)
    flat, names = _array(model.weights.reshape(-1).tolist(), "double"), F.array(*[F.lit(x) for x in model.families])
    bias, owner = F.array(*[F.lit(float(x)) for x in model.bias]), _array([c for c, _ in model.templates], "int")
    enough = float(np.log(model.least / (1 - model.least)))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), _words(F.coalesce(F.col(text_col), F.lit(""))).alias("_words"))
    # A text without a core word has no unit; one look at the whole array finds most of these.
    core = _array(model.vocabulary[model.plain :], "string")
    own = own.withColumn("_v", F.when(F.arrays_overlap("_words", core), model.numbers(F.col("_words"))).otherwise(F.array().cast("array<int>")))
    spoken = lambda u: F.exists(F.slice("_words", u["low"] + 1, u["high"] - u["low"] + 1), lambda w: w.rlike(LICENCE_WORD))
    own = model.with_units(own)
    own = own.withColumn("_units", F.transform("_units", lambda u: F.struct(model.features(F.col("_v"), u["low"], u["high"]).alias("f"), spoken(u).alias("spoken"))))
    own = own.withColumn("_flat", flat).withColumn("_templates", _array([t for _, t in model.templates], "array<int>"))
    own = own.withColumns({"_rivals": _array(model.rivals, "array<int>"), "_larger": _array(model.larger, "array<int>"), "_telling": _array(model.telling, "array<int>")})

    def logits(u: Column) -> Column:
        z = lambda c: F.aggregate(u["f"], F.get(bias, c), lambda s, f: s + F.get(F.col("_flat"), f * k + c))
        return F.struct(u["f"].alias("f"), u["spoken"].alias("spoken"), F.transform(F.sequence(F.lit(0), F.lit(k - 1)), z).alias("z"))

    def odds(u: Column) -> Column:
        top = F.array_max(u["z"])
        total = F.aggregate(u["z"], F.lit(0.0), lambda s, z: s + F.exp(z - top))
        return F.struct(u["f"].alias("f"), u["spoken"].alias("spoken"), (F.array_position(u["z"], top) - 1 < k - 1).alias("family"), F.transform(u["z"], lambda z: F.exp(z - top) / total).alias("odds"), F.transform(u["z"], lambda z: z - F.element_at(u["z"], -1)).alias("over"))

    def held(u: Column) -> Column:
        """The shares of each template's pairs that the unit holds, for units in which a family has the odds against 'unknown'."""
        some = F.exists(F.slice(u["over"], 1, k - 1), lambda x: x >= enough)
        share = lambda t: F.size(F.array_intersect(t, u["f"])) / F.size(t)
        return F.struct(u["odds"].alias("odds"), u["over"].alias("over"), u["f"].alias("f"), u["spoken"].alias("spoken"), u["family"].alias("family"), F.when(some, F.transform("_templates", share)).alias("held"))

    def confirmed(u: Column) -> Column:
        """Families whose odds against 'unknown' are enough, with a template that the unit holds for the most part.

        A template doesn't count if one of another family that is much like it fits better, or holds all of it and more, or if
        the unit lacks the pairs that only its family has.
        """

        def one(c: Column, i: Column) -> Column:
            family, share = F.get(owner, i), F.get(u["held"], i)
            sure = (F.get(u["over"], family) >= enough) & (share >= p.containment)
            told = F.get(F.col("_telling"), i)
            tells = F.size(F.array_intersect(told, u["f"])) >= p.containment * F.size(told)
            beaten = F.exists(F.get(F.col("_rivals"), i), lambda j: F.get(u["held"], j) > share) | F.exists(F.get(F.col("_larger"), i), lambda j: F.get(u["held"], j) >= share)
            return F.when(sure & tells & ~beaten, F.struct((-F.get(u["odds"], family)).alias("p"), F.get(names, family).alias("family"), share.alias("containment")))

        found = F.filter(F.transform(u["held"], one), lambda x: x.isNotNull())
        kept = F.filter(found, lambda x: (-x["p"] >= model.least) | (x["containment"] == 1.0))  # a whole template counts beside a likelier one
        return F.coalesce(kept, F.array().cast("array<struct<p: double, family: string, containment: double>>"))

    own = own.withColumn("_units", F.transform("_units", logits)).withColumn("_units", F.transform("_units", odds)).withColumn("_units", F.transform("_units", held))
    own = own.withColumn("n_candidates", F.size(F.filter("_units", lambda u: u["spoken"] | u["family"])).cast("long"))
    own = own.withColumn("_sure", F.flatten(F.transform("_units", confirmed)))
    own = own.withColumn("_top", F.array_min("_sure"))
    mine = F.filter("_sure", lambda u: u["family"] == F.col("_top")["family"])
    return own.select(
        "doc_id",
        "n_candidates",
        F.when(F.col("_top").isNotNull(), F.col("_top")["family"]).when(F.col("n_candidates") > 0, "unknown").otherwise("none").alias("family"),
        F.array_sort(F.array_distinct(F.transform("_sure", lambda u: u["family"]))).alias("families"),
        F.round(-F.col("_top")["p"], 6).alias("probability"),
        F.array_max(F.transform(mine, lambda u: u["containment"])).alias("containment"),
    )
