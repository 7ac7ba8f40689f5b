"""License scan: exact set-similarity join of text blocks with license templates.

A block is a line, a paragraph of several lines where blank lines mark paragraphs, and for each
template a run of lines: one with a word of the template and those after it, until these hold as
many words as the template.  A notice thus lies in a block however its lines are wrapped; lines
without words and comment marks do not count.  Blocks and templates are sets of words; a block
matches a template if it holds at least
``threshold`` of the template's words.  Words are ordered by how many documents of the whole
corpus hold them, rarest first.  A template is indexed under its prefix only: of n words with
``need`` required, one of the n - need + 1 rarest must be in any matching block (prefix filter).
Blocks with fewer than ``need`` template words are out (length filter), and so are pairs whose
remaining words after the first common one cannot reach ``need`` (positional filter).  What is
left is verified by its whole overlap, so the join is exact.

Of the templates that a block matches, the one with the highest containment, then the most words,
gives the block's label: a notice of CC BY-NC also holds the words of CC BY.

Templates are a short parameter list, so index and word order are broadcast with a size known
beforehand.

Defined results: NULL or empty text: no words, no labels, score 0.  Equal texts have equal
results; repeated rows stay repeated.  Empty table: no rows.  Input columns named like a result
are replaced.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdara.llm.common import lower_ascii

#: What is not part of a word.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit": ["mit", "license"], "apache": ["apache", "license"],
        "gpl": ["general", "public", "license"]}

#: Lines that start a run in one row of the join.
CHUNK = 64

#: Fixed values: (label, notice) of common public licenses.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
            "software and associated documentation files (the \"Software\"), to deal in the "
            "Software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
               "file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the "
            "terms of the GNU General Public License as published by the Free Software "
            "Foundation"),
    ("lgpl", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the "
             "terms of the GNU Lesser General Public License as published by the Free Software "
             "Foundation"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the "
             "terms of the GNU Affero General Public License as published by the Free Software "
             "Foundation"),
    ("agpl", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are "
            "permitted provided that the following conditions are met"),
    ("bsd", "Released under the BSD 3-Clause License."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose "
            "with or without fee is hereby granted"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event "
             "will the authors be held liable for any damages arising from the use of this software."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a "
              "copy of the software and accompanying documentation covered by this license"),
    ("epl", "This program and the accompanying materials are made available under the terms of the "
            "Eclipse Public License 2.0"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International "
              "License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 "
                 "International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
                 "International License."),
    ("cc-by-nc-sa", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-nd", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]


def words(text: Column) -> Column:
    return F.filter(F.split(lower_ascii(text), SEPARATORS, -1), lambda w: w != "")


def _template_words(text: str) -> list[str]:
    """All words, repeats included."""
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return [w for w in re.split(SEPARATORS, lower) if w]


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _paragraphs(text: Column) -> Column:
    """Paragraphs of several lines between blank lines, where there are any."""
    cut = F.filter(F.split(text, r"\n[\x20\t\r]*\n[\x20\t\n\f\r]*", -1), lambda p: p.contains("\n"))
    return F.when(text.rlike(r"\n[\x20\t\r]*\n"), cut).otherwise(F.array().cast("array<string>"))


def _measured(parts: Column, order: Column) -> Column:
    """(n, own) of parts with words: their number and those of ``order``, in its order."""
    found = F.transform(F.transform(parts, words), lambda w: F.struct(
        F.size(w).alias("n"), F.array_intersect(order, w).alias("own")))
    return F.filter(found, lambda x: x["n"] > 0)


def blocks(texts: DataFrame, order: Column, longest: int) -> DataFrame:
    """(_id, block, run): measured lines of each block, a line or paragraph being a run of one.

    A run holds at least the lines that any template of up to ``longest`` words asks for.  Lines are
    dealt into rows of CHUNK starts, so the size of a row does not follow that of the text.
    """
    size = F.size("_lines")
    starts = F.when(size > 0, F.sequence(F.lit(1), size, F.lit(CHUNK))).otherwise(
        F.array().cast("array<int>"))
    chunks = F.concat(F.transform(starts, lambda i: F.slice("_lines", i, CHUNK + longest)),
                      F.transform("_paragraphs", lambda p: F.array(p)))
    rows = (texts.select("_id", _measured(F.split("_text", "\n", -1), order).alias("_lines"),
                         _measured(_paragraphs(F.col("_text")), order).alias("_paragraphs"))
            .select("_id", F.posexplode(chunks).alias("_chunk", "_lines")))
    each = F.transform(F.sequence(F.lit(1), F.least(size, F.lit(CHUNK))), lambda i: F.array(
        F.slice("_lines", i, 1), F.slice("_lines", i, longest + 1)))
    return (rows.select("_id", "_chunk", F.posexplode(F.flatten(each)).alias("_place", "run"))
            .where(F.size(F.col("run")[0]["own"]) > 0)
            .select("_id", F.struct("_chunk", "_place").alias("block"), "run"))


def _cut(run: Column, length: Column) -> Column:
    """Words of the first line and of those after it until these have ``length`` words."""
    first = F.struct(F.lit(0).alias("n"), run[0]["own"].alias("own"))
    return F.aggregate(F.slice(run, 2, F.size(run)), first, lambda a, x: F.when(
        a["n"] < length, F.struct((a["n"] + x["n"]).alias("n"), F.concat(a["own"], x["own"]).alias("own"))
    ).otherwise(a))["own"]


def word_order(texts: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of documents that hold a word, rarest first, then by word."""
    seen = (texts.select(F.explode(F.array_intersect(words(F.col("_text")), _strings(vocabulary)))
                         .alias("w")).groupBy("w").count())
    counts = {r["w"]: r["count"] for r in seen.collect()}  # at most the vocabulary
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def matches(texts: DataFrame, templates: list[tuple[str, str]] = TEMPLATES,
            threshold: float = 0.8) -> DataFrame:
    """(_id, block, template, label, containment): every match; ``texts`` has _id and _text."""
    every = [_template_words(t) for _, t in templates]
    sets = [(i, label, list(dict.fromkeys(ws))) for i, ((label, _), ws) in enumerate(zip(templates, every))]
    order = word_order(texts, sorted({w for _, _, ws in sets for w in ws}))
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for i, label, ws in sets:
        ws = sorted(ws, key=rank.__getitem__)
        need = math.ceil(threshold * len(ws) - 1e-9)
        rows += [(w, i, label, p, len(ws), need, len(every[i]), ws) for p, w in enumerate(ws[:len(ws) - need + 1])]
    index = texts.sparkSession.createDataFrame(
        rows, "w string, template int, label string, p int, n int, need int, length int, "
              "template_words array<string>")
    prefix = _strings(sorted({r[0] for r in rows}, key=rank.__getitem__))
    least = min(r[5] for r in rows)
    found = blocks(texts.where(F.arrays_overlap(words(F.col("_text")), prefix)), _strings(order),
                   max(map(len, every)))
    own = F.array_intersect(_strings(order), F.flatten("run.own"))  # rarest first
    probes = (found.withColumn("own", own).where(F.size("own") >= least)
              .select("_id", "block", "run", "own", F.posexplode("own").alias("q", "w")))
    pairs = probes.join(F.broadcast(index), "w").where(
        (F.size("own") >= F.col("need"))
        & (F.least(F.col("n") - F.col("p"), F.size("own") - F.col("q")) >= F.col("need")))
    first = F.array_intersect("own", "template_words")[0] == F.col("w")
    pairs = pairs.where(first & F.arrays_overlap(F.col("run")[0]["own"], F.col("template_words")))
    held = F.size(F.array_intersect("template_words", _cut(F.col("run"), F.col("length"))))
    return (pairs.withColumn("_held", held).where(F.col("_held") >= F.col("need"))
            .select("_id", "block", "template", "label", "n",
                    (F.col("_held") / F.col("n")).alias("containment")))


def _places(ws: Column) -> Column:
    """(word, label) of every place where the words of a base phrase stand one after another."""
    at = F.transform(ws, lambda w, i: F.struct(i.cast("long").alias("at"), w.alias("w")))

    def of(label: str, phrase: list[str]) -> Column:
        return F.transform(F.filter(at, lambda x: _stands(ws, x, phrase)),
                           lambda x: F.struct(x["at"].alias("at"), F.lit(label).alias("label")))

    return F.concat(*[of(label, phrase) for label, phrase in BASE.items()])


def _stands(ws: Column, x: Column, phrase: list[str]) -> Column:
    test = x["w"] == phrase[0]
    for k, w in enumerate(phrase[1:], 1):
        test = test & (F.get(ws, x["at"].cast("int") + k) == w)
    return F.coalesce(test, F.lit(False))


RESULTS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text",
         templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """Add RESULTS to every row; the text itself is left out."""
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    identity = F.struct(F.col(f"`{key}`").alias("k"), F.xxhash64(whole).alias("a"),
                        F.octet_length(whole).alias("n"))
    hits = matches(docs.select(identity.alias("_id"), whole.alias("_text")), templates, threshold)
    best = (hits.groupBy("_id", "block").agg(F.max(F.struct("containment", "n", "label")).alias("b"))
            .groupBy("_id").agg(F.collect_set("b.label").alias("_labels"),
                                F.max("b.containment").alias("_best")))
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in RESULTS and c != text]
    # the words are computed once and bound inside the expression
    found = F.transform(F.array(words(whole)), lambda w: F.struct(
        F.size(w).cast("long").alias("n"),
        F.when(lower_ascii(whole).contains("license"), _places(w)).otherwise(none).alias("at")))[0]
    rows = docs.select(*rest, identity.alias("_id"), found.alias("_found"))
    at = F.col("_found.at")
    base = F.array_sort(F.array_distinct(at["label"]))
    joined = rows.join(best, "_id", "left")
    labels = F.array_sort(F.array_union(base, F.coalesce(
        F.col("_labels"), F.array().cast("array<string>"))))
    return joined.select(
        *rest, F.col("_found.n").alias("n_words"), F.size(at).cast("long").alias("n_base"),
        F.array_min(at["at"]).alias("first_word"), F.array_max(at["at"]).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.size(at) > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0)))
        .alias("score"))
