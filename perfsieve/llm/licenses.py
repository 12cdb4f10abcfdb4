"""License scan: a trained paragraph classifier, a calibrated unknown class, and a template check.

Paragraphs (lines) are classified by multinomial logistic regression on their word n-grams. The
training rows are the notice texts below with shortened forms of each, and paragraphs of a bounded
sample of documents as the unknown class. A second, one-feature regression on held-out rows turns
the margin of the best family over "unknown" into a probability; below a half a paragraph is
unknown. What is left must share at least half of its word n-grams with a template of the family.
All of it is DataFrame and ML-pipeline work; no Python runs per row.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from perfsieve.llm.common import table
from perfsieve.session import materialize

# Notice texts of common licence families (fixed values).
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ],
    "bsd": [
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc0": [
        "This work is dedicated to the public domain under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ],
    "all-rights-reserved": [
        "All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission "
        "of the publisher.",
    ],
}
UNKNOWN = "unknown"
# So that the unknown class has rows whatever the sample holds.
ORDINARY = [
    "The meeting was moved to the following week because the room was not free.",
    "In this chapter we look at the results of the second experiment.",
    "She opened the window and listened to the rain for a while.",
    "Sign in to read the rest of this story.",
    "The software was released last year and is used by many people.",
    "The public library is open on Sundays.",
]

# Bounds of the fit: documents that give unknown paragraphs, paragraphs of each, n-grams known.
SAMPLE_DOCS = 400
SAMPLE_PARAGRAPHS = 20
VOCABULARY = 1 << 14
HELD_OUT = 4
LEAST_CONTAINED = 0.5
SEED = 5
# What parts words.
BETWEEN = r"[^\p{L}\p{N}]+"


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def with_grams(rows: DataFrame) -> DataFrame:
    """``rows`` (with a column text) with its words and ``grams``: its runs of two and of three words."""
    cut = RegexTokenizer(inputCol="text", outputCol="words", pattern=BETWEEN, toLowercase=True).transform(rows)
    for n, name in ((2, "pairs"), (3, "triples")):
        cut = NGram(n=n, inputCol="words", outputCol=name).transform(cut)
    return cut.withColumn("grams", F.concat("pairs", "triples")).drop("pairs", "triples")


def _training_rows(spark: SparkSession) -> DataFrame:
    """Every template, and its halves and its first and last two thirds where they stay long enough to tell."""
    rows = []
    for family, texts in {**TEMPLATES, UNKNOWN: ORDINARY}.items():
        for text in texts:
            found = text.split()
            n = len(found)
            rows.append((family, text))
            if n >= 12:
                rows += [(family, " ".join(found[a:b])) for a, b in ((0, n // 2), (n // 2, n), (0, 2 * n // 3), (n // 3, n))]
    return spark.createDataFrame(rows, "family string, text string")


class Scanner:
    """The fitted classifier; ``scan`` applies it."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        spark = docs.sparkSession
        template = spark.createDataFrame(
            [(family, text) for family, texts in TEMPLATES.items() for text in texts], "t_family string, text string"
        )
        # A short table of fixed texts.
        self.templates = with_grams(template).select("t_family", F.array_distinct("grams").alias("t_grams"))
        some = docs.select(F.col(text_col).alias("text")).where(F.length("text") > 0)
        some = some.orderBy(F.xxhash64("text", F.lit(SEED)), "text").limit(SAMPLE_DOCS)
        lines = some.select(F.explode(F.slice(paragraphs(F.col("text")), 1, SAMPLE_PARAGRAPHS)).alias("text"))
        lines = materialize(lines.where("text <> ''").distinct(), "license-sample")
        # A sampled paragraph that is a licence notice must not teach the unknown class.
        near = with_grams(lines).select("text", F.explode("grams").alias("gram"), "grams").join(
            F.broadcast(self.templates.select(F.explode("t_grams").alias("gram"), "t_grams")), "gram"
        )
        close = F.max(self._contained("grams", "t_grams")) >= LEAST_CONTAINED
        notices = near.groupBy("text").agg(close.alias("close")).where("close").select(F.col("text").alias("notice"))
        unknown = lines.join(notices, F.col("text") == F.col("notice"), "left_anti").select(F.lit(UNKNOWN).alias("family"), "text")
        self.families = [UNKNOWN, *TEMPLATES]
        number = F.array_position(F.array(*[F.lit(f) for f in self.families]), F.col("family")) - 1
        rows = _training_rows(spark).unionByName(unknown).withColumn("label", number.cast("double"))
        # Bounded by the sample; one sorted partition makes every fit the same.
        rows = materialize(rows.distinct().orderBy("family", "text").coalesce(1), "license-training").coalesce(1)
        known = F.col("family") != UNKNOWN
        # Only n-grams of the templates are features: no other n-gram can speak for a family.
        self.words = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=VOCABULARY, binary=True).fit(
            with_grams(rows.where(known))
        )
        held = (F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0) & ~known
        # The unknown class weighs as much as all notices together, however many paragraphs the sample has.
        counts = rows.where(~held).agg(F.sum(known.cast("int")), F.sum((~known).cast("int"))).first()
        weighted = rows.where(~held).withColumn("weight", F.when(known, 1.0).otherwise(counts[0] / counts[1]))
        learner = LogisticRegression(
            family="multinomial", regParam=2e-4, elasticNetParam=0.5, maxIter=40, standardization=False, weightCol="weight"
        )
        self.model = learner.fit(self.words.transform(with_grams(weighted)).select("label", "features", "weight"))
        # Notices have few forms, so each serves the fit and, cut short by a word at either end, the calibration.
        pieces = F.split("text", " ")
        cut = F.array_join(F.slice(pieces, 2, F.greatest(F.size(pieces) - 2, F.lit(1))), " ")
        trial = rows.where(held).unionByName(rows.where(known).withColumn("text", F.when(F.size(pieces) > 6, cut).otherwise(F.col("text"))))
        scored = self._scored(with_grams(trial)).select("margin", (F.col("family") != UNKNOWN).cast("double").alias("known"))
        self.slope, self.intercept = self._calibrate(scored)
        self.anchors = self._anchor_words(with_grams(rows.where(~known)))

    @staticmethod
    def _contained(one: str, other: str) -> Column:
        """The share of the shorter text's n-grams that the other has too."""
        shorter = F.least(F.size(F.array_distinct(one)), F.size(F.array_distinct(other)))
        return F.size(F.array_intersect(one, other)) / F.greatest(shorter, F.lit(1))

    @staticmethod
    def _calibrate(scored: DataFrame) -> tuple[float, float]:
        rows = VectorAssembler(inputCols=["margin"], outputCol="features").transform(scored)
        if rows.select("known").distinct().count() < 2:
            return 1.0, 0.0
        fitted = LogisticRegression(labelCol="known", regParam=0.01, maxIter=50, standardization=False).fit(rows)
        return float(fitted.coefficients[0]), float(fitted.intercept)

    def _scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``best`` (family) and ``margin`` (its log-odds over the unknown class)."""
        raw = vector_to_array(F.col("rawPrediction"))
        scored = self.model.transform(self.words.transform(rows)).withColumn("raw", raw)
        best = F.array_max(F.slice("raw", 2, len(self.families)))
        names = F.array(*[F.lit(f) for f in self.families])
        scored = scored.withColumn("margin", best - F.col("raw")[0])
        place = F.array_position(F.slice("raw", 2, len(self.families)), best) + 1
        return scored.withColumn("best", F.element_at(names, place.cast("int"))).drop("raw", "rawPrediction", "probability", "prediction", "features", "words")

    def _anchor_words(self, rows: DataFrame) -> list[str] | None:
        """Words of which a paragraph must hold one to be taken for a licence; None where there is no such set.

        A paragraph without any n-gram that speaks for a family scores at most what an empty one
        does. Every such n-gram is known by its word that is rarest in the unknown sample. Words
        common there are let go as long as all their n-grams together could not lift an empty
        paragraph to the calibrated half; one of the others must then be in every licence.
        """
        weights = self.model.coefficientMatrix.toArray()
        bias = self.model.interceptVector.toArray()
        if self.slope <= 0:
            return None
        room = -self.intercept / self.slope - float((bias[1:] - bias[0]).max())
        if room <= 0:
            return None
        margins = (weights[1:] - weights[0]).max(axis=0)
        own = [(gram.split(" "), float(m)) for gram, m in zip(self.words.vocabulary, margins, strict=True) if m > 0]
        asked = sorted({word for gram, _ in own for word in gram})
        counts = rows.select(F.explode("words").alias("w")).where(F.col("w").isin(asked)).groupBy("w").count().collect()
        seen = {r["w"]: r["count"] for r in counts}
        lift: dict[str, float] = {}
        for gram, margin in own:
            word = min(gram, key=lambda w: (seen.get(w, 0), -len(w), w))
            lift[word] = lift.get(word, 0.0) + margin
        for word in sorted(lift, key=lambda w: (lift[w] / (1 + seen.get(w, 0)), w)):
            if seen.get(word, 0) and lift[word] < room:
                room -= lift.pop(word)
        return sorted(lift)

    def candidates(self, text: Column) -> Column:
        """The paragraphs of a text that can be licences, as (number, text)."""
        numbered = F.transform(paragraphs(text), lambda p, i: F.struct(i.alias("paragraph"), p.alias("text")))
        if self.anchors is None:
            return numbered
        # Whole words against a set: an alternation of this many words is slow, and finds them inside other words too.
        anchors = F.array(*map(F.lit, self.anchors)).cast("array<string>")
        return F.filter(numbered, lambda s: F.arrays_overlap(F.split(F.lower(s["text"]), BETWEEN), anchors))

    def scan(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row per licence paragraph: doc_id, text_key, paragraph, family, probability, contained."""
        rows = docs.select(
            F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.explode(self.candidates(F.col(text_col))).alias("c")
        )
        likely = self._scored(with_grams(rows.select("doc_id", "text_key", "c.paragraph", "c.text")))
        likely = likely.withColumn("probability", 1 / (1 + F.exp(-F.least(F.lit(500.0), self.slope * F.col("margin") + self.intercept))))
        likely = likely.where("probability >= 0.5")
        compared = likely.join(F.broadcast(self.templates), F.col("best") == F.col("t_family"))
        # Rows that repeat id and text fall together here and count once.
        return (
            compared.groupBy("doc_id", "text_key", "paragraph", F.col("best").alias("family"))
            .agg(F.max("probability").alias("probability"), F.max(self._contained("grams", "t_grams")).alias("contained"))
            .where(F.col("contained") >= LEAST_CONTAINED)
        )


def license_families(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_paragraphs, n_licenses, families (sorted, comma-joined), probability (the highest).

    Null and empty texts are one empty paragraph without a licence. Rows without a licence have
    empty families and a null probability. Equal rows get equal results; an empty table gives an
    empty result; other columns are not read.
    """
    if docs.isEmpty():
        none = {"n_paragraphs": "long", "n_licenses": "long", "families": "string", "probability": "double"}
        return docs.select(id_col, *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()])
    found = Scanner(docs, id_col, text_col).scan(docs, id_col, text_col)
    by_doc = found.groupBy(F.col("doc_id").alias("f_id"), F.col("text_key").alias("f_key")).agg(
        F.count(F.lit(1)).alias("n_licenses"),
        F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"),
        F.max("probability").alias("probability"),
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    breaks = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n")))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), (breaks + 1).cast("long").alias("n_paragraphs"))
    both = rows.join(by_doc, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("f_key")), "left")
    return both.select(
        F.col("id").alias(id_col),
        "n_paragraphs",
        F.coalesce("n_licenses", F.lit(0)).cast("long").alias("n_licenses"),
        F.coalesce("families", F.lit("")).alias("families"),
        F.round("probability", 4).alias("probability"),
    )


def _query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_families(table(spark, sf_dir, "documents"))


QUERIES = {"op7_license_scan": _query}
CHECKS: dict[str, str] = {}
