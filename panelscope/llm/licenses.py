"""Licence scans by a positional index of rare words, with built-in expressions only.

How rare the words of the licence templates are is counted over all documents. The index holds, for every template, its rarest
words and where they stand. A document looks up those of its words that are rarest per template; every posting names a shift between
document and template, and words that agree on a shift, give or take a few words, support the template. Where rare
words of enough weight agree, the template's mandatory phrases must stand at that shift, too.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelscope.llm.common import stored, whole_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases that are found wherever they stand, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


@dataclass(frozen=True)
class Template:
    """A licence text or notice; ``phrases`` must stand where the text has them."""

    label: str
    text: str
    phrases: tuple[str, ...]


# Notices and opening words of public licences, and phrases that none of their copies lacks.
TEMPLATES = (
    Template("mit", "Released under the MIT License.", ("mit license",)),
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software.""", ("to deal in the software without restriction", "rights to use copy modify merge publish")),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies.""", ("with or without fee is hereby granted",)),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer.""", ("redistribution and use in source and binary forms",)),
    Template("apache-2", "Licensed under the Apache License, Version 2.0.", ("apache license version 2",)),
    Template("apache-2", """you may not use this file except in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
             ("apache org licenses license 2 0", "except in compliance with the license")),
    Template("gpl-3", "This work is licensed under the GNU General Public License, version 3.", ("gnu general public license version 3",)),
    Template("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
             ("gnu general public license as published", "version 3 of the license")),
    Template("gpl-2", "This work is licensed under the GNU General Public License, version 2.", ("gnu general public license version 2",)),
    Template("gpl-2", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
             ("gnu general public license as published", "version 2 of the license")),
    Template("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License
        as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""",
             ("gnu lesser general public license",)),
    Template("agpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
             ("gnu affero general public license",)),
    Template("mpl-2", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at http://mozilla.org/MPL/2.0/.""", ("mozilla public license v 2 0",)),
    Template("epl-2", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is
        available at http://www.eclipse.org/legal/epl-2.0""", ("eclipse public license 2 0",)),
    Template("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary.""", ("free and unencumbered software",)),
    Template("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
        applications, and to alter it and redistribute it freely.""", ("in no event will the authors be held liable", "alter it and redistribute it freely")),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0.", ("cc by nc",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
             ("creative commons attribution noncommercial",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
             ("creative commons attribution sharealike",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0",)),
    Template("cc0", """The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to
        the work worldwide under copyright law.""", ("dedicated the work to the public domain",)),
)


def words_of(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN, text.translate(str.maketrans(UPPER, LOWER))) if w]


def word_column(text: Column) -> Column:
    """Words of a text, lower-cased (A-Z)."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), BETWEEN), lambda w: w != "")


def starts_of(words: Column, phrase: list[str]) -> Column:
    """Where a phrase's words stand one after the other, from 0; looked for only in documents that have them all."""
    places = F.sequence(F.lit(0), F.size(words) - len(phrase))
    found = F.filter(places, lambda i: F.slice(words, i + 1, F.lit(len(phrase))) == F.array(*map(F.lit, phrase)))
    has_all = reduce(and_, [F.array_contains(words, w) for w in phrase], F.size(words) >= len(phrase))
    return F.when(has_all, found).otherwise(F.array().cast("array<int>"))


def table_of(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small fixed table as literals."""
    kind = f"array<struct<{schema}>>"
    value = lambda x: F.array(*map(value, x)) if isinstance(x, list) else F.struct(*map(value, x)) if isinstance(x, tuple) else F.lit(x)
    return spark.range(1).select(F.inline(value(rows).cast(kind)))


@dataclass(frozen=True)
class Posting:
    word: str
    template: int
    place: int
    weight: float


def rare_index(counts: dict[str, int], documents: int, templates: tuple[Template, ...], indexed: int) -> list[Posting]:
    """Postings of the rarest words of every template: at most ``indexed`` and at most half of its different words."""
    out = []
    for number, template in enumerate(templates):
        words = words_of(template.text)
        weight = {w: math.log((documents + 2) / (counts.get(w, 0) + 1)) for w in words}
        rare = sorted(weight, key=lambda w: (-weight[w], w))[:min(indexed, (len(weight) + 1) // 2)]
        out += [Posting(w, number, i, weight[w]) for i, w in enumerate(words) if w in rare]
    return out


def phrase_places(template: Template) -> list[tuple[list[str], int]]:
    words = words_of(template.text)
    out = []
    for phrase in map(words_of, template.phrases):
        at = [i for i in range(len(words)) if words[i:i + len(phrase)] == phrase]
        if not at:
            raise ValueError(f"the text of {template.label} lacks its phrase {phrase}")
        out.append((phrase, at[0]))
    return out


def word_frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many documents have each word of the templates: at most one row per word comes to the driver."""
    met = words.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, vocabulary)))).alias("word"))
    return {r["word"]: r["n"] for r in met.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}


def matches(scanned: DataFrame, postings: list[Posting], templates: tuple[Template, ...], looked_up: int, slack: int, least: float) -> DataFrame:
    """rid, label and share of every template whose rare words agree on a shift and whose phrases stand there."""
    spark = scanned.sparkSession
    index = table_of(spark, [(p.word, p.template, p.place, p.weight) for p in postings], "word: string, template: int, place: int, weight: double")
    full = {t: sum(sorted({p.word: p.weight for p in postings if p.template == t}.values(), reverse=True)[:looked_up]) for t in range(len(templates))}
    known = table_of(
        spark, [(t, x.label, full[t], phrase_places(x)) for t, x in enumerate(templates)],
        "template: int, label: string, full: double, phrases: array<struct<words: array<string>, place: int>>")
    # both tables are as large as the templates, whatever the documents
    hits = scanned.where(F.col("text_words").isNotNull()).select("rid", F.explode("hits").alias("hit")).select("rid", F.col("hit.word").alias("word"), F.col("hit.at").alias("at"))
    posted = hits.join(F.broadcast(index), "word").withColumn("shift", F.col("at") - F.col("place"))
    rarest = Window.partitionBy("rid", "template").orderBy(F.desc("weight"), "word")
    posted = posted.withColumn("nth", F.dense_rank().over(rarest)).where(F.col("nth") <= looked_up)
    # two rows of bins, half a bin apart, so that near shifts meet in one of them
    bins = F.array(*[F.floor((F.col("shift") + F.lit(half)) / F.lit(slack)) * 2 + F.lit(n) for n, half in ((0, 0), (1, slack // 2))])
    support = (
        posted.withColumn("bin", F.explode(bins))
        .groupBy("rid", "template", "bin", "word").agg(F.max("weight").alias("weight"), F.min("shift").alias("shift"))
        .groupBy("rid", "template", "bin").agg(F.sum("weight").alias("weight"), F.min("shift").alias("shift"))
        .join(F.broadcast(known), "template").withColumn("share", F.least(F.lit(1.0), F.col("weight") / F.greatest("full", F.lit(1e-9))))
        .where(F.col("share") >= least)
    )
    texts = scanned.where(F.col("text_words").isNotNull()).select("rid", F.split("text_words", " ").alias("words"))
    stands = F.forall("phrases", lambda p: F.exists(
        F.sequence(F.lit(-slack), F.lit(2 * slack)),
        lambda d: (F.col("shift") + p["place"] + d >= 0) & (
            F.slice("words", F.greatest(F.col("shift") + p["place"] + d, F.lit(0)) + 1, F.size(p["words"])) == p["words"])))
    return support.join(texts, "rid").where(stands).groupBy("rid", "label").agg(F.max("share").alias("share"))


def find_licenses(
    docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES, indexed: int = 16, looked_up: int = 8, slack: int = 8, least: float = 0.6,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and licenses (label, share) of every document.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text, lower-cased (A-Z). Base phrases count wherever their words stand in a row;
    first and last word are the smallest and largest start (null without any). A template is found where its rarest words (those of
    ``looked_up`` words the document has, of ``indexed``) agree on a shift within ``slack`` words with at least ``least`` of their
    weight, and its phrases stand there. The score is 1 with a base phrase, else the largest share found, else 0. Null and empty texts have
    no words; repeated rows are scanned each; an empty table gives an empty result. The words of a document count as a whole, however many.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), word_column(whole_text(text_col)).alias("words"))
    vocabulary = sorted({w for t in templates for w in words_of(t.text)})
    postings = rare_index(word_frequencies(texts, vocabulary), docs.count(), templates, indexed)
    rare = sorted({p.word for p in postings})
    places = {phrase: starts_of(F.col("words"), phrase.split(" ")) for phrase in BASE}
    read = texts.withColumns({
        "hits": F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("at"))), lambda x: x["word"].isin(rare)),
        **{f"base_{n}": p for n, p in enumerate(places.values())},
    })
    starts = F.concat(*[F.col(f"base_{n}") for n in range(len(BASE))])
    base = F.concat(*[F.when(F.size(f"base_{n}") > 0, F.array(F.lit(label))).otherwise(F.array().cast("array<string>")) for n, label in enumerate(BASE.values())])
    several = F.size(F.array_distinct(F.transform("hits", lambda x: x["word"]))) > 1
    scanned = stored(read.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("words").cast("long").alias("n_words"), starts.alias("starts"),
        F.array_sort(F.array_distinct(base)).alias("base"), "hits", F.when(several, F.array_join("words", " ")).alias("text_words")), "licence_words")
    found = (
        matches(scanned, postings, templates, looked_up, slack, least)
        .groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("label", "share"))).alias("licenses"))
    )
    nothing = F.array().cast("array<struct<label: string, share: double>>")
    joined = scanned.drop("hits", "text_words").join(found, "rid", "left").withColumn("licenses", F.coalesce("licenses", nothing))
    labels = F.array_sort(F.array_distinct(F.concat("base", F.transform("licenses", lambda x: x["label"]))))
    return joined.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"), F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size("starts") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("licenses", lambda x: x["share"])), F.lit(0.0))).alias("score"), "licenses")
