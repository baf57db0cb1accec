"""Licence scans: a trained paragraph classifier, in DataFrame operations only.

Paragraphs (lines, and runs of non-empty lines, so that a wrapped notice is whole; cut into
overlapping passages of ``PASSAGE`` words where longer) become sparse binary features: the uni- and
bigrams of words that occur in training notices. A multinomial logistic regression with an L1
penalty, trained on notices generated from the families' templates and on a bounded sample of corpus
paragraphs as the unknown class, gives each passage's family. Paragraphs without any word that the
trained weights need for a family are not scored further: the bound that chooses those words proves
that their prediction is the unknown class.

The unknown class is calibrated: a family is predicted only above the probability that passages of
at most one in a thousand unknown lines (of paragraphs that no licence word marks and that resemble
no template) reach, by a histogram of their scores. A prediction counts once the family's template confirms it:
the passage must hold most of a notice's bigrams, digits aside.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.llm.common import hashed_sample, stored, table

PASSAGE, STEP = 60, 30
UNKNOWN = "unknown"
#: Public licence notices by family (fixed values).
TEMPLATES = {
    "agpl": ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL"),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at", "SPDX-License-Identifier: Apache"),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License", "SPDX-License-Identifier: BSD"),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Released under CC0 1.0 Universal Public Domain Dedication"),
    "epl-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "SPDX-License-Identifier: EPL"),
    "gpl": ("This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "Licensed under the GNU General Public License version 2 or later", "SPDX-License-Identifier: GPL"),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "Licensed under the ISC License", "SPDX-License-Identifier: ISC"),
    "lgpl": ("This library is licensed under the GNU Lesser General Public License, version 2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL"),
    "mit": ("Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, Version 2.0", "SPDX-License-Identifier: MPL"),
    "unlicense": ("This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary"),
}
#: A notice of at most so many bigrams is confirmed by all of them only.
SHORT = 3
#: The threshold is at most this, however sure the model is of unknown passages: confirmation follows.
SUREST = 0.9
#: A line that names a licence, whichever.
_NAMED = r"licen[sc]ed under|under the [^\n]{0,60}licen[sc]e"
#: What training puts around notices, and sentences that only sound like one.
_BEFORE = ("", "This file is part of the project.", "Copyright 2019 the authors.", "All code in this directory:", "Note:")
_AFTER = ("", "See the file LICENSE for details.", "All rights reserved.", "Thank you.")
_LIKE = ("The driver showed a licence to the officer", "The city renewed the licence of the public house", "the general public was free to use the library", "a licence fee is due every year", "she wrote a permission slip for the school trip", "the work is subject to the terms of the contract", "version 2 of the program was released under pressure", "a person may obtain a copy of the report free of charge", "creative people share common ground", "the warranty of the device covers two years")


def _split(text: Column) -> Column:
    """Lower-cased words of letters (and whatever is not ASCII), empty ones included."""
    return F.split(F.lower(text), r"[\x00-\x60\x7B-\x7F]+", -1)


def tokens(text: Column) -> Column:
    """Lower-cased words of letters; digits separate words."""
    return F.filter(_split(text), lambda w: w != "")


def bigrams(words: Column) -> Column:
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1)))).otherwise(F.expr("cast(array() as array<string>)"))


def blocks(text: Column) -> Column:
    """Runs of lines that hold more than blanks."""
    return F.split(text, r"\n(?:[\x20\t\r]*\n)+", -1)


def holding(text: Column, gate: list[str]) -> Column:
    """Whether a text may hold one of these words: all that do, and some more."""
    return F.rlike(F.lower(text), F.lit(rf"(?<![a-z])(?:{'|'.join(map(re.escape, gate))})(?![a-z])")) if gate else F.lit(False)


def passages(docs: DataFrame, text: str, key: list[str], gate: list[str] | None = None) -> DataFrame:
    """(key columns, words, grams): one row a passage with a word, of each line and of each run of
    two or more lines. ``gate``: only passages that hold one of these words; texts and lines that
    cannot are left out before they are cut into words."""
    gated = lambda w: F.arrays_overlap(w, F.array(*map(F.lit, gate)).cast("array<string>"))
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs if gate is None else docs.where(holding(body, gate))
    runs = F.filter(blocks(body), lambda x: F.contains(F.btrim(x, F.lit("\x20\t\r\n")), F.lit("\n")))
    lines = docs.select(*key, F.explode(F.concat(F.split(body, "\n", -1), runs)).alias("_line"))
    lines = lines if gate is None else lines.where(holding(F.col("_line"), gate))
    words = lines.select(*key, tokens(F.col("_line")).alias("_w")).where(F.size("_w") > 0)
    cuts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_w") - PASSAGE + STEP - 1), F.lit(STEP))
    cut = words.select(*key, F.explode(F.transform(cuts, lambda i: F.slice("_w", i + 1, PASSAGE))).alias("words"))
    cut = cut if gate is None else cut.where(gated(F.col("words")))
    return cut.select(*key, "words", F.concat("words", bigrams(F.col("words"))).alias("grams"))


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def unmarked(docs: DataFrame, text: str) -> DataFrame:
    """(line): the runs of lines without a word that starts like "licence"."""
    like = F.contains(F.lower("line"), F.lit("licen")) & F.exists(tokens(F.col("line")), lambda w: F.startswith(w, F.lit("licen")))
    return docs.select(F.explode(blocks(F.coalesce(F.col(text), F.lit("")))).alias("line")).where(~like)


def notice_bigrams(notice: str) -> list[str]:
    """The distinct bigrams of a notice's words, sorted."""
    w = re.findall("[a-z]+", notice.lower())
    return sorted({f"{x} {y}" for x, y in zip(w, w[1:], strict=False)})


def resembles(words: Column, share: float) -> Column:
    """Whether a passage holds ``share`` of the bigrams of any notice."""
    lists = [notice_bigrams(t) for ts in TEMPLATES.values() for t in ts]
    notices = F.array(*(F.array(*map(F.lit, theirs)) for theirs in lists))
    whole = F.array(*map(F.lit, sorted({g for theirs in lists for g in theirs})))
    # the passage's bigrams of any notice at all, mostly none, are found once
    near = F.transform(F.array(F.array_intersect(bigrams(words), whole)), lambda mine: (F.size(mine) > 0) & F.exists(notices, lambda n: F.size(F.array_intersect(mine, n)) >= share * F.size(n)))
    return F.element_at(near, 1)


def training_rows(spark: SparkSession, docs: DataFrame, text: str, negatives: int, confirm: float) -> DataFrame:
    """(label index as double, grams, held boolean): generated notices and sampled paragraphs."""
    families = [UNKNOWN, *sorted(TEMPLATES)]
    made = [(families.index(f), f"{b} {t}{e} {a}") for f, ts in TEMPLATES.items() for t in ts for b in _BEFORE for a in _AFTER for e in (".", "")]
    made += [(0, f"{b} {t}. {a}") for t in _LIKE for b in _BEFORE for a in _AFTER]
    own = spark.sql("SELECT * FROM VALUES " + ",".join(f"({y}.0D, {_literal(t)})" for y, t in made) + " AS t(label, line)")
    # at most `negatives` documents teach the unknown class, least hash first
    some = hashed_sample(docs.where(F.col(text).isNotNull()).select(F.col(text).alias("line")), F.col("line"), negatives)
    plain = unmarked(some, "line").select(F.lit(0.0).alias("label"), "line")
    # what resembles a notice is no example of the unknown, whether it says "licence" or not
    rows = passages(own, "line", ["label"]).unionByName(passages(plain, "line", ["label"]).where(~resembles(F.col("words"), confirm / 2)))
    return rows.select("label", "grams", (F.pmod(F.xxhash64("grams"), F.lit(4)) == 0).alias("held"))


class Classifier:
    """The trained model, its calibrated threshold, the words without which no family is likely, and
    ``candidates``: the rows of ``docs`` whose text may hold a family's passage at all."""

    def __init__(self, spark: SparkSession, docs: DataFrame, text: str = "text", negatives: int = 500, confirm: float = 0.6) -> None:
        self.families = [UNKNOWN, *sorted(TEMPLATES)]
        # some thousand rows: few partitions, as every iteration is a job over them
        rows = stored(training_rows(spark, docs, text, negatives, confirm).coalesce(4), "licence-training")
        self.vectors = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=2.0).fit(rows.where("label > 0"))
        fit = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.9, maxIter=60)
        self.model = fit.fit(self.vectors.transform(rows).where("not held or label > 0"))
        seen = rows.where("label = 0").select(F.explode("grams").alias("w")).where(F.col("w").isin([w for w in self.vectors.vocabulary if " " not in w]))
        common = dict(map(tuple, seen.groupBy("w").count().collect()))
        self.threshold = 0.5  # the least there is: passages without a word of its gate score below
        gate = self._needed(common)
        self.candidates = stored(docs.where(holding(F.coalesce(F.col(text), F.lit("")), gate)), "licence-candidates")
        self.threshold = self._calibrated(docs, text, gate, confirm)
        self.gate = self._needed(common)

    def _calibrated(self, docs: DataFrame, text: str, gate: list[str], confirm: float) -> float:
        """The thousandth that unknown passages of at most one in a thousand lines reach, ``SUREST``
        at most."""
        body = F.coalesce(F.col(text), F.lit(""))
        total = docs.agg(F.sum(F.length(body) - F.length(F.translate(body, "\n", "")) + 1)).first()[0] or 0
        unknown = unmarked(self.candidates, text)
        # lines of a wrapped notice resemble it without being unknown
        high = self.predict(passages(unknown, "line", [], gate)).where(~resembles(F.col("words"), confirm / 2))
        bins = dict(map(tuple, high.groupBy(F.least(F.floor(F.col("p") * 1000), F.lit(999)).cast("int")).count().collect()))
        above, at = 0, 1000
        while at > 500 and above + bins.get(at - 1, 0) <= total / 1000:
            at -= 1
            above += bins.get(at, 0)
        return min(SUREST, at / 1000)

    def _needed(self, common: dict[str, int]) -> list[str]:
        """Words of which a passage must hold one to reach the threshold.

        Left out are as many words as possible, those ``common`` in unknown passages first, while for each family the intercepts
        and all positive weights of terms made of left-out words alone stay below the threshold's
        logit: p_f / p_unknown = exp(margin), so p_f stays below the threshold."""
        weights, bias = self.model.coefficientMatrix.toArray(), self.model.interceptVector.toArray()
        terms = [t.split(" ") for t in self.vectors.vocabulary]
        gains = [[max(0.0, float(weights[f][i] - weights[0][i])) for f in range(1, len(self.families))] for i in range(len(terms))]
        limit = [math.log(self.threshold / (1 - self.threshold)) - float(bias[f] - bias[0]) for f in range(1, len(self.families))]
        best: dict[str, float] = {}
        for t, g in zip(terms, gains, strict=True):
            for w in t:
                best[w] = max(best.get(w, 0.0), *g)
        out: set[str] = set()
        for w in sorted(best, key=lambda w: (-common.get(w, 0), best[w], w)):
            trial = out | {w}
            sums = [sum(g[f] for t, g in zip(terms, gains, strict=True) if trial.issuperset(t)) for f in range(len(limit))]
            if all(s < 0.99 * x for s, x in zip(sums, limit, strict=True)):
                out = trial
        return sorted(set(best) - out)

    def _scored(self, rows: DataFrame) -> DataFrame:
        """Rows with ``p``, the largest probability of a family, and its ``family``."""
        each = F.slice(vector_to_array("probability"), 2, len(self.families) - 1)
        got = self.model.transform(rows).withColumn("p", F.array_max(each))
        names = F.array(*map(F.lit, self.families[1:]))
        return got.withColumn("family", F.element_at(names, F.array_position(each, F.col("p")).cast("int")))

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with grams) that are predicted to be of a family, with p and family."""
        return self._scored(self.vectors.transform(rows)).where(F.col("p") >= self.threshold)


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", confirm: float = 0.6, negatives: int = 500) -> DataFrame:
    """(id_col, n_paragraphs, licences, n_confirmed, n_unconfirmed, n_unknown), one row per row of
    ``docs``.

    ``licences``: the confirmed families, sorted and comma-joined, empty where none. A prediction is
    confirmed by a share ``confirm`` of a notice's bigrams, of a notice of up to ``SHORT`` by all.
    ``n_unknown``: of a document without a confirmed family, the lines that name some licence. Null
    and empty texts have no paragraphs; ``n_paragraphs`` counts lines. Repeated rows get equal
    results; null ids are kept; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col), F.col(text).alias("_text"))
    key = F.xxhash64(F.coalesce("_text", F.lit("")))
    model = Classifier(spark, rows.select(key.alias("_key"), "_text"), "_text", negatives, confirm)
    found = model.predict(passages(model.candidates, "_text", ["_key"], model.gate))
    notices = spark.sql("SELECT * FROM VALUES " + ",".join(f"({_literal(f)}, {_literal(t)})" for f, ts in TEMPLATES.items() for t in ts) + " AS t(family, notice)")
    notices = notices.select("family", F.array_distinct(bigrams(tokens(F.col("notice")))).alias("theirs"))
    hits = stored(found.select("_key", "family", F.array_distinct(bigrams(F.col("words"))).alias("mine")), "licence-hits").distinct()
    wants = F.when(F.size("theirs") <= SHORT, F.size("theirs")).otherwise(F.ceil(F.size("theirs") * confirm))
    checked = hits.join(F.broadcast(notices), "family").select("_key", "family", "mine", (F.size(F.array_intersect("mine", "theirs")) >= wants).alias("ok"))
    checked = checked.groupBy("_key", "family", "mine").agg(F.max("ok").alias("ok"))
    per = stored(checked.groupBy("_key").agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("family")))), ",").alias("licences"), F.count_if("ok").alias("n_confirmed"), F.count_if(~F.col("ok")).alias("n_unconfirmed")), "licence-texts")
    # texts with hits, at most 32 MB, go to every task; more are joined by a shuffle
    per = F.broadcast(per) if per.count() * 64 <= 32 << 20 else per
    lines = F.split("_text", "\n", -1)
    count = F.when(F.length("_text") > 0, F.size(F.filter(lines, lambda line: F.length(F.trim(line)) > 0))).otherwise(0).cast("long")
    low = F.lower("_text")
    named = F.when(F.contains(low, F.lit("licen")), F.size(F.filter(F.split(low, "\n", -1), lambda line: F.rlike(line, F.lit(_NAMED))))).otherwise(0).cast("long")
    lean = rows.select(F.col(id_col), key.alias("_key"), F.coalesce(count, F.lit(0)).alias("n_paragraphs"), F.coalesce(named, F.lit(0)).alias("_named"))
    none = F.lit(0).cast("long")
    licences = F.coalesce("licences", F.lit(""))
    return lean.join(per, "_key", "left").select(id_col, "n_paragraphs", licences.alias("licences"), F.coalesce("n_confirmed", none).alias("n_confirmed"), F.coalesce("n_unconfirmed", none).alias("n_unconfirmed"), F.when(licences == "", F.col("_named")).otherwise(none).alias("n_unknown"))


def licence_query(spark, sf_dir: str) -> DataFrame:
    """op2: licence families in all documents."""
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
