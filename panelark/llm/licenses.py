"""License scan: base phrases, and a positional index of the rare words of license notices.

Everything here is DataFrame and SQL functions.

The index holds the words of each notice (template) with their places and their
inverse document frequency over all documents. A file looks up the rarest words
that it shares with a template; each of their places votes for where the template
would begin. A beginning with enough votes is a candidate, which must hold the
template's key phrases nearby and agree with it in enough of its weight. A file is
judged within its own row, so nothing is shuffled but one count a licence word.
"""

from __future__ import annotations

import json
import math
import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelark.llm.common import documents, pick

# Fixed values of the contract: words, and phrase by label.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

LOOKUPS = 12  # rarest shared words of a file and a template that are looked up
MIN_VOTES = 0.5  # share of the looked-up words that must agree on a beginning
MIN_SCORE = 0.6  # share of a template's weight that must be in place
SLACK = 12  # words before and after a template where its key phrases may stand


class Template(NamedTuple):
    label: str
    text: str
    phrases: tuple[str, ...]


def spdx(label: str, name: str) -> Template:
    """The identifier line that source files carry."""
    return Template(label, f"SPDX-License-Identifier: {name}", (f"SPDX-License-Identifier: {name}",))


GNU = "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} General Public License as published by the Free Software Foundation, {2} of the License"


def gnu(label: str, kind: str, version: str) -> list[Template]:
    """Notices of one licence of the GNU family: the long one and the short one."""
    phrases = (f"GNU {kind} General Public License", f"version {version}")
    return [
        Template(label, GNU.format("This program", kind, f"either version {version}"), phrases),
        Template(label, f"licensed under the GNU {kind} General Public License, version {version}", phrases),
    ]


# Wording of well-known notices.
TEMPLATES = [
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", ("free of charge", "without restriction")),
    Template("mit", "Released under the MIT License", ("MIT License",)),
    Template("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License", ("Apache License", "in compliance with the License")),
    Template("apache-2", "Licensed under the Apache License, Version 2.0", ("Apache License Version 2",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms", "conditions are met")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee",)),
    Template("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("Mozilla Public License v 2",)),
    Template("cc-by-nc", "Licensed under CC BY-NC 4.0", ("CC BY-NC",)),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("Creative Commons Attribution 4",)),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("Creative Commons Attribution-ShareAlike",)),
    Template("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", ("Creative Commons Attribution-NonCommercial",)),
    Template("cc0", "has waived all copyright and related or neighboring rights to this work under CC0 1.0", ("related or neighboring rights", "CC0")),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    *gnu("gpl-2", "", "2"), *gnu("gpl-3", "", "3"), *gnu("lgpl-3", "Lesser", "3"), *gnu("agpl-3", "Affero", "3"),
    spdx("mit", "MIT"), spdx("apache-2", "Apache-2.0"), spdx("gpl-2", "GPL-2.0"), spdx("gpl-3", "GPL-3.0"),
    spdx("lgpl-3", "LGPL-3.0"), spdx("agpl-3", "AGPL-3.0"), spdx("mpl-2", "MPL-2.0"), spdx("isc", "ISC"), spdx("bsd", "BSD-3-Clause"),
]


def words_of(text: str) -> list[str]:
    """The words of a short text, as the scan takes them."""
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def _lowered(column: str) -> Column:
    return F.translate(F.coalesce(F.col(column), F.lit("")), UPPER, LOWER)


def _words(column: str) -> Column:
    return F.regexp_extract_all(F.col(column), F.lit(WORD), F.lit(0))


def rarity(docs: DataFrame, templates: list[Template] = TEMPLATES, text_col: str = "text") -> dict[str, float]:
    """Inverse document frequency over all documents of the words of the templates, whose number bounds what reaches the driver."""
    vocabulary = sorted({w for t in templates for w in words_of(t.text)})
    if not vocabulary:
        return {}
    lowered = docs.select(_lowered(text_col).alias("_t"))
    # a null marks the document itself, so that one pass counts both
    own = F.concat(F.array_intersect(F.lit(vocabulary), _words("_t")), F.array(F.lit(None).cast("string")))
    counted = {r.word: r["count"] for r in lowered.select(F.explode(own).alias("word")).groupBy("word").count().collect()}
    total = counted.get(None, 0)
    return {w: round(math.log((total + 1) / (counted.get(w, 0) + 1)), 6) for w in vocabulary}


def index(templates: list[Template], idf: dict[str, float]) -> list[dict]:
    """Templates with their postings, words in order of rarity, weights, and key phrases.

    ``anchors`` are words without which the key phrases cannot be there; a text
    that lacks one as a plain substring is not looked at.
    """
    out = []
    for t in templates:
        words = words_of(t.text)
        postings: dict[str, list[int]] = {}
        for place, word in enumerate(words):
            postings.setdefault(word, []).append(place)
        phrases = [words_of(p) for p in t.phrases]
        out.append({
            "label": t.label, "words": words, "postings": postings, "weights": [idf[w] for w in words],
            "total": max(sum(idf[w] for w in words), 1e-9), "rare": sorted(postings, key=lambda w: (-idf[w], w)),
            "phrases": [f" {' '.join(p)} " for p in phrases], "anchors": sorted({max(p, key=lambda w: (idf.get(w, 99.0), w)) for p in phrases}),
        })
    return out


INDEX = (
    "array<struct<label:string,words:array<string>,postings:map<string,array<int>>,weights:array<double>,total:double,"
    "rare:array<string>,phrases:array<string>,anchors:array<string>>>"
)
HIT = "struct<label:string,start:int,score:double>"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL that evaluates a value once and uses it under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _base() -> str:
    """SQL for the array of (label, start) of all places of the base phrases."""
    found = []
    for phrase, label in BASE.items():
        words = phrase.split()
        rest = " AND ".join(f"get(_w, i + {k}) = {_quoted(w)}" for k, w in enumerate(words[1:], 1))
        there = " AND ".join(f"contains(_t, {_quoted(w)})" for w in words)
        found.append(
            f"IF({there}, transform(filter(transform(_w, (w, i) -> IF(w = {_quoted(words[0])} AND {rest}, i, -1)), i -> i >= 0), "
            f"i -> named_struct('label', {_quoted(label)}, 'start', i)), CAST(array() AS array<struct<label:string,start:int>>))"
        )
    return f"concat({', '.join(found)})"


def _found(entries: list[dict]) -> str:
    """SQL for the array of (label, start, score) of verified templates."""
    table = f"from_json({_quoted(json.dumps(entries))}, '{INDEX}')"
    votes = """sort_array(flatten(filter(transform(_w, (w, i) ->
        IF(array_contains(look, w), transform(t.postings[w], q -> i - q), NULL)), x -> x IS NOT NULL)))"""
    # in a sorted list of votes, a value has m of them if it stands m - 1 places further on again
    least = f"greatest(2, CAST(ceil({MIN_VOTES} * size(look)) AS int))"
    agreed = """array_distinct(filter(zip_with(slice(v, 1, greatest(size(v) - m + 1, 0)), slice(v, m, greatest(size(v) - m + 1, 0)),
        (a, b) -> IF(a = b, a, NULL)), x -> x IS NOT NULL))"""
    near = f"concat(' ', array_join(slice(_w, greatest(at - {SLACK}, 0) + 1, size(t.words) + {2 * SLACK}), ' '), ' ')"
    verified = _let("near", near, "forall(t.phrases, p -> contains(near, p))")
    share = "aggregate(transform(t.words, (w, q) -> IF(get(_w, at + q) = w, t.weights[q], 0D)), 0D, (s, x) -> s + x) / t.total"
    # one expression a step: beginnings with votes, their scores, then the checks
    places = _let("v", votes, _let("m", least, agreed))
    scored = f"transform({places}, at -> named_struct('label', t.label, 'start', at, 'score', round(IF({verified}, {share}, 0D), 6)))"
    one = _let("look", f"slice(array_intersect(t.rare, _w), 1, {LOOKUPS})", scored)
    return f"""filter(flatten(transform({table}, t -> IF(forall(t.anchors, a -> contains(_t, a)), {one}, CAST(array() AS array<{HIT}>)))),
        h -> h.score >= {MIN_SCORE})"""


def scan(docs: DataFrame, idf: dict[str, float], templates: list[Template] = TEMPLATES, text_col: str = "text") -> DataFrame:
    """The rows with ``_n`` (words), ``_base`` (label, start) and ``_found`` (label, start, score) added; places are word numbers from 0.

    A null or empty text has no words and no places. Each row is judged by itself.
    """
    work = docs.withColumn("_t", _lowered(text_col)).withColumn("_w", _words("_t"))
    found = F.expr(_found(index(templates, idf))) if templates else F.expr(f"CAST(array() AS array<{HIT}>)")
    return work.select(*docs.columns, F.size("_w").cast("long").alias("_n"), F.expr(_base()).alias("_base"), found.alias("_found"))


def report(docs: DataFrame, idf: dict[str, float], templates: list[Template] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the largest share of a template's weight that is in place, 0 if
    no template is there; base phrases do not count in it. Other columns are
    ignored, repeated rows are reported each, an empty table gives an empty result.
    """
    rows = scan(pick(docs, doc_id=id_col, text=text_col), idf, templates, "text")
    written = lambda array: F.concat_ws(",", F.array_sort(F.array_distinct(array)))
    return rows.select(
        "doc_id",
        F.col("_n").alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        F.array_min("_base.start").cast("long").alias("first_word"),
        F.array_max("_base.start").cast("long").alias("last_word"),
        written(F.col("_base.label")).alias("base_labels"),
        written(F.concat("_base.label", "_found.label")).alias("labels"),
        F.coalesce(F.array_max("_found.score"), F.lit(0.0)).alias("score"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """op12: licences in all documents."""
    docs = documents(spark, folder)
    return report(docs, rarity(docs))
