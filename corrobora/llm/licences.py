"""Licence scan: a paragraph classifier trained on licence notices, confirmed against them. Native to Spark."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from corrobora.llm.common import load, whole_text

UNKNOWN = "unknown"

# Names and opening notices of public licences, by family.
NAMES = {
    "MIT": ["the MIT License", "MIT license", "MIT"],
    "Apache": ["the Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"],
    "GPL": ["the GNU General Public License, version 3", "the GNU General Public License version 2", "GNU GPL v3", "GPL-3.0-or-later", "GPL-2.0-only"],
    "LGPL": ["the GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v3", "LGPL-2.1-or-later"],
    "AGPL": ["the GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0-only"],
    "BSD": ["the BSD 3-Clause License", "the BSD license", "BSD 2-Clause License", "BSD-3-Clause"],
    "MPL": ["the Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL-2.0"],
    "ISC": ["the ISC License", "ISC"],
    "EPL": ["the Eclipse Public License, version 2.0", "EPL-2.0"],
    "CC-BY": ["CC BY 4.0", "the Creative Commons Attribution 4.0 International License", "CC-BY-4.0"],
    "CC-BY-SA": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"],
    "CC-BY-NC": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0"],
    "CC0": ["CC0 1.0", "the Creative Commons Zero v1.0 Universal public domain dedication", "CC0-1.0"],
    "Unlicense": ["the Unlicense", "Unlicense"],
}
NOTICES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS",
    ],
    "GPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "You should have received a copy of the GNU General Public License along with this program.",
    ],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"],
    "AGPL": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "CC-BY-SA": ["Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
LEADS = ("Released under {}.", "Licensed under {}.", "This work is licensed under {}.", "Distributed under the terms of {}.",
         "This project is available under {}, see the LICENSE file.", "SPDX-License-Identifier: {}")
OTHERS = (
    "All rights reserved.", "Copyright 2020 Example Inc. All rights reserved.", "No license is granted.", "Proprietary and confidential.",
    "A driving licence and a license plate are required.", "Licensed under the terms agreed by both parties.",
    "The software is provided by the vendor under a commercial agreement.", "Version 2.0 of the program was released.",
    "This work is part of a series.", "The public may use this file.", "Permission of the teacher is required.",
    "Released under the bridge.", "This program is about software.", "general public", "source code and binary",
)
#: At most about so many paragraphs of the corpus serve as examples of the unknown class.
SAMPLE = 400
#: Least probability, and least share of the shorter side's word pairs that paragraph and template have in common.
LEAST, ALIKE = 0.5, 0.5
_UNIT = 1_000_000


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def grams(words: list[str]) -> set[str]:
    """Words, and pairs of neighbours joined by a blank."""
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


def examples() -> list[tuple[str, str]]:
    """(family, text) of every notice, lead-in with a name, and cut of a notice; and of texts that are no licence."""
    out = [(UNKNOWN, t) for t in OTHERS]
    for family, names in NAMES.items():
        out += [(family, lead.format(name)) for name in names for lead in LEADS]
        for notice in NOTICES.get(family, ()):
            w = notice.split()
            out.append((family, notice))
            out += [(family, " ".join(w[a * len(w) // 10 : b * len(w) // 10])) for a, b in ((0, 7), (3, 10), (2, 8))]
            out += [(UNKNOWN, " ".join(w[k : k + 3])) for k in range(0, len(w) - 2, 4)]
    return out


def templates() -> list[tuple[str, str]]:
    """(family, text) that a prediction is compared with."""
    named = [(f, lead.format(n)) for f, names in NAMES.items() for n in names for lead in LEADS]
    return named + [(f, n) for f, notices in NOTICES.items() for n in notices]


#: Every word of a template: a line without any is no notice.
CUES = tuple(sorted({w for _, t in templates() for w in words_of(t)}))
#: Every pair of neighbouring words of a template. A line is classified if it shares two of them, the least that :func:`scan` asks for.
PAIRS = tuple(sorted({g for _, t in templates() for g in grams(words_of(t)) if " " in g}))


def _any_pair() -> str:
    """A regular expression for lines in lower case that have one of :data:`PAIRS`; common beginnings are tried once."""

    def branch(rest: list[str]) -> str:
        heads = sorted({r[0] for r in rest if r})
        if not heads:
            return "(?![a-z0-9])"
        ways = [("[^a-z0-9]+" if h == " " else h) + branch([r[1:] for r in rest if r[:1] == h]) for h in heads]
        ways += ["(?![a-z0-9])"] if "" in rest else []
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return "(?<![a-z0-9])" + branch(list(PAIRS))


@dataclass(frozen=True)
class Model:
    """Softmax weights over word n-grams, as whole millionths; class 0 is the unknown one."""

    classes: tuple[str, ...]
    vocabulary: dict[str, int]
    weights: np.ndarray  # (n-grams, classes)
    bias: np.ndarray
    warmth: float  # the temperature that calibrates the probabilities

    def probabilities(self, text: str) -> np.ndarray:
        rows = [self.vocabulary[g] for g in grams(words_of(text)) if g in self.vocabulary]
        z = (self.bias + self.weights[rows].sum(axis=0)) / _UNIT / self.warmth
        e = np.exp(z - z.max())
        return e / e.sum()


def train(corpus: list[str], steps: int = 400, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """Fit by gradient descent on the fixed examples and ``corpus`` paragraphs (unknown); calibrate on every third example.

    A corpus paragraph that has half of a template's word pairs is left out.
    """
    pairs = [{g for g in grams(words_of(t)) if " " in g} for _, t in templates()]
    plain = [t for t in corpus if not any(len(p & grams(words_of(t))) * 2 >= len(p) for p in pairs if p)]
    rows = examples() + [(UNKNOWN, t) for t in plain]
    classes = (UNKNOWN, *NAMES)
    vocabulary = {g: k for k, g in enumerate(sorted({g for f, t in rows if f != UNKNOWN for g in grams(words_of(t))}))}
    x = np.zeros((len(rows), len(vocabulary)))
    for k, (_, text) in enumerate(rows):
        x[k, [vocabulary[g] for g in grams(words_of(text)) if g in vocabulary]] = 1
    y = np.array([classes.index(f) for f, _ in rows])
    weigh = 1 / np.sqrt(np.bincount(y, minlength=len(classes)).clip(1))[y]
    weigh /= weigh.sum()

    def fitted(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((x.shape[1], len(classes))), np.zeros(len(classes))
        target = np.eye(len(classes))[y[chosen]]
        for _ in range(steps):
            p = softmax(x[chosen] @ w + b)
            error = (p - target) * (weigh[chosen] / weigh[chosen].sum())[:, None]
            w -= rate * 4 * (x[chosen].T @ error + decay * w)
            b -= rate * 4 * error.sum(axis=0)
        return w, b

    def softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    aside = np.arange(len(rows)) % 3 == 2
    w, b = fitted(~aside)
    loss = {t: -np.log(softmax((x[aside] @ w + b) / t)[np.arange(aside.sum()), y[aside]] + 1e-12).mean() for t in np.geomspace(0.2, 5, 33)}
    warmth = min(loss, key=loss.get)
    w, b = fitted(np.ones(len(rows), bool))
    return Model(classes, vocabulary, np.rint(w * _UNIT).astype(np.int64), np.rint(b * _UNIT).astype(np.int64), float(warmth))


def corpus_sample(docs: DataFrame, bound: int = SAMPLE) -> list[str]:
    """About ``bound`` paragraphs, from documents chosen by a hash of their id."""
    n = max(1, docs.count())
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, bound / n))
    chosen = docs.filter(share).select(F.split(whole_text(), "\n", -1)[0].alias("line"))
    return sorted(r.line[:2000] for r in chosen.limit(4 * bound).collect())


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, line_no, single, pairs) of the lines that share two word pairs with the templates; ``tag`` tells apart rows that share an id."""
    rows = docs.select("doc_id", F.xxhash64("doc_id", whole_text()).alias("tag"), F.lower(whole_text()).alias("text"))
    lines = rows.select("doc_id", "tag", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    words = lines.filter(F.rlike("line", F.lit(_any_pair()))).select("doc_id", "tag", "line_no", F.explode(F.array(F.array_remove(F.split("line", "[^a-z0-9]+"), ""))).alias("w"))
    pairs = F.filter(F.zip_with("w", F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)), lambda p: p.isNotNull())
    found = words.select("doc_id", "tag", "line_no", "w", F.explode(F.array(F.array_distinct(pairs))).alias("pairs"))
    shared = F.size(F.filter("pairs", lambda p: p.isin(list(PAIRS))))
    return found.filter(shared >= 2).select("doc_id", "tag", "line_no", F.array_distinct("w").alias("single"), "pairs")


def scan(docs: DataFrame, model: Model, least: float = LEAST, alike: float = ALIKE) -> DataFrame:
    """(doc_id, tag, line_no, family, probability, likeness): the paragraphs that are licence notices.

    A paragraph is a line; a notice over several lines is judged line by line. It is reported if the likeliest class is a family
    with probability ``least`` or more, and it shares at least two word pairs, and
    the share ``alike`` of the shorter side's pairs, with a template of that
    family. Null and empty texts have no paragraphs; rows that repeat both id and text are
    scanned as one; an empty table has none. The weights that travel are as many as the templates have n-grams.
    """
    spark = docs.sparkSession
    known = templates()
    pairs = [frozenset(g for g in grams(words_of(t)) if " " in g) for _, t in known]
    kept = sorted({(f, p) for (f, _), p in zip(known, pairs) if p}, key=lambda fp: (fp[0], sorted(fp[1])))
    holders: dict[str, list[int]] = {}
    for k, (_, p) in enumerate(kept):
        for g in p:
            holders.setdefault(g, []).append(k)
    rows = [(g, model.weights[k].tolist(), holders.get(g, [])) for g, k in model.vocabulary.items()]
    rows += [(g, [0] * len(model.classes), ks) for g, ks in holders.items() if g not in model.vocabulary]
    weights = spark.createDataFrame(rows, "gram string, weights array<long>, templates array<int>")
    key = ["doc_id", "tag", "line_no"]
    found = paragraphs(docs)
    n_pairs = F.size("pairs").alias("n_pairs")
    said = found.select(*key, n_pairs, F.explode(F.concat("single", "pairs")).alias("gram")).join(F.broadcast(weights), "gram")
    sums = [F.sum(F.col("weights")[k]).alias(f"z{k}") for k in range(len(model.classes))]
    shared = said.groupBy(*key, "n_pairs").agg(*sums, F.flatten(F.collect_list("templates")).alias("templates"))
    logits = [(F.col(f"z{k}") + int(model.bias[k])) / (_UNIT * model.warmth) for k in range(len(model.classes))]
    scored = shared.select(*key, "n_pairs", "templates", F.array(*logits).alias("z"))
    top = F.array_max("z")
    total = F.aggregate("z", F.lit(0.0), lambda acc, v: acc + F.exp(v - F.array_max("z")))
    names = F.array(*(F.lit(c) for c in model.classes))
    best = scored.select(*key, "n_pairs", "templates", F.element_at(names, F.array_position("z", top).cast("int")).alias("family"), F.round(1 / total, 6).alias("probability"))
    likely = best.filter((F.col("family") != UNKNOWN) & (F.col("probability") >= least))
    sizes = spark.createDataFrame([(k, f, len(p)) for k, (f, p) in enumerate(kept)], "template int, family string, size int")
    met = likely.select(*key, "family", "probability", "n_pairs", F.explode("templates").alias("template")).groupBy(*key, "family", "probability", "n_pairs", "template").agg(F.count("*").alias("common"))
    near = met.join(F.broadcast(sizes), ["template", "family"]).withColumn("likeness", F.col("common") / F.least("n_pairs", "size"))
    confirmed = near.filter((F.col("likeness") >= alike) & (F.col("common") >= F.least(F.lit(2), F.col("size"))))
    return confirmed.groupBy(*key, "family", "probability").agg(F.round(F.max("likeness"), 6).alias("likeness"))


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, families, lines): each row's licence families and the numbers of their lines, empty for none."""
    found = scan(docs, train(corpus_sample(docs)))
    hits = found.groupBy("tag").agg(F.sort_array(F.collect_set("family")).alias("families"), F.sort_array(F.collect_set("line_no")).alias("lines"))
    rows = docs.select("doc_id", F.xxhash64("doc_id", whole_text()).alias("tag"))
    none = F.array().cast
    return rows.join(hits, "tag", "left").select(
        "doc_id", F.coalesce("families", none(T.ArrayType(T.StringType()))).alias("families"), F.coalesce("lines", none(T.ArrayType(T.IntegerType()))).alias("lines")
    )


def licences_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_documents(load(spark, sf_dir, "documents"))
