"""Licence mentions by a positional rare-token index, with DataFrame operations only.

Texts are split into words, and the document frequency of every licence word is
counted over all texts.  The index is a table of templates (phrases of a licence or
of its notice, each with a mandatory key phrase in it), posted under the word of the
key phrase with the highest IDF.  A file's words that the index posts are joined with
it: a posting of such a word at position p proposes that the key phrase starts at p
minus the word's place in it.  The template's other rare words must stand at their
places relative to that start, then the key phrase word for word, then enough of the
template around it.

A proposal carries only the words around it (twice the longest template), so no text
is copied for its matches, and more templates make the index longer, not the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases, each with its label.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
# Templates of the method: label, phrase of the licence or of its notice, key phrase within it.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "the mit license"),
    ("apache-2", "licensed under the apache license version 2 0", "the apache license version 2"),
    ("cc-by-nc", "this work is licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "distribute this software for any purpose with or without fee is hereby granted"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", "terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    ("epl", "under the terms of the eclipse public license", "eclipse public license"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", "you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "this program is free software you can redistribute it and or modify it"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file", "this source code form is subject to the terms of the mozilla public license"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "neither the name of the copyright holder nor the names of its contributors"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work", "waived all copyright and related rights"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "provided as is without any express or implied warranty"),
    ("bsl-1", "distributed under the boost software license version 1 0", "boost software license version 1 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
)
#: Of a key phrase, so many of its rarest words are posted (the first) or intersected (the others).
RARE_WORDS = 4
#: Of a method's template, this share of the words must stand at their places.
LEAST_SHARE = 0.5

def text_words(text: Column) -> Column:
    return F.filter(F.split(F.translate(text, UPPER, LOWER), BREAK), lambda w: w != "")


def all_templates() -> list[tuple[str, bool, list[str], list[str]]]:
    """(label, base, words, key words): a base phrase is its own key phrase."""
    base = [(label, True, phrase.split(), phrase.split()) for label, phrase in BASE]
    return base + [(label, False, phrase.split(), key.split()) for label, phrase, key in TEMPLATES]


def vocabulary() -> list[str]:
    return sorted({w for _, _, phrase, _ in all_templates() for w in phrase})


def indexed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, present, words): ``words`` only where all words of some key phrase are present."""
    split = docs.select("doc_id", text_words(F.coalesce("text", F.lit(""))).alias("words"))
    present = split.select("doc_id", "words", F.size("words").cast("long").alias("n_words"), F.array_intersect("words", F.array(*map(F.lit, vocabulary()))).alias("present"))
    keys = F.array(*[F.array(*map(F.lit, key)) for key in sorted({tuple(key) for *_, key in all_templates()})])
    possible = F.exists(keys, lambda key: F.size(F.array_except(key, "present")) == 0)
    return present.withColumn("words", F.when((F.size("present") > 1) & possible, F.col("words"))).withColumn("row", F.monotonically_increasing_id())


def rarest(key: list[str], idf: dict[str, float]) -> list[tuple[str, int]]:
    """(word, place) of the rarest words of a key phrase, the rarest first; a word that comes again has its first place."""
    first = {w: i for i, w in reversed(list(enumerate(key)))}
    return sorted(first.items(), key=lambda x: (-idf[x[0]], x[1]))[:RARE_WORDS]


def template_index(spark, idf: dict[str, float]) -> DataFrame:
    """The index: a row (label, base, phrase, key, key_at, anchor, place, rare) per template, under its anchor."""
    rows = []
    for label, base, phrase, key in all_templates():
        key_at = next(i for i in range(len(phrase)) if phrase[i : i + len(key)] == key)
        (anchor, place), *others = rarest(key, idf)
        rare = [F.struct(F.lit(w).alias("word"), F.lit(i).alias("place")) for w, i in others]
        values = {
            "label": F.lit(label), "base": F.lit(base), "phrase": F.lit(phrase), "key": F.lit(key), "key_at": F.lit(key_at), "anchor": F.lit(anchor), "place": F.lit(place),
            "rare": F.array(*rare).cast("array<struct<word:string,place:int>>"),
        }
        rows.append(F.struct(*[c.alias(n) for n, c in values.items()]))
    return spark.range(1).select(F.inline(F.array(*rows)))


def found_templates(likely: DataFrame, index: DataFrame, anchors: list[str]) -> DataFrame:
    """(row, label, base, start, share): places of key phrases in likely(row, words)."""
    reach = max(len(phrase) for _, _, phrase, _ in all_templates())
    posted = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("word"), i.alias("i"))), lambda s: s["word"].isin(anchors))
    around = F.transform(posted, lambda s: F.struct(
        s["word"].alias("word"), s["i"].alias("i"), F.greatest(F.lit(0), s["i"] - reach).alias("from"),
        F.slice("words", F.greatest(F.lit(0), s["i"] - reach) + 1, 2 * reach + 1).alias("near"),
    ))
    spots = likely.select("row", F.explode(around).alias("s")).select("row", "s.word", "s.i", "s.from", "s.near")
    # A row per template of the module, so small by definition.
    proposed = spots.join(F.broadcast(index), F.col("word") == F.col("anchor")).withColumn("start", F.col("i") - F.col("place")).where("start >= 0")
    at = F.col("start") - F.col("from")  # in the words around; below 0 only where the text is left of them
    met = proposed.where((at >= 0) & F.forall("rare", lambda r: F.coalesce(F.get("near", at + r["place"]) == r["word"], F.lit(False))))
    stands = met.where(F.slice("near", at + 1, F.size("key")) == F.col("key"))
    first = at - F.col("key_at")
    hits = F.size(F.filter(F.transform("phrase", lambda w, k: (first + k >= 0) & F.coalesce(F.get("near", F.greatest(F.lit(0), first + k)) == w, F.lit(False))), lambda x: x))
    return stands.select("row", "label", "base", "start", (hits / F.size("phrase")).alias("share"))


def find_licenses(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score).

    ``n_base`` counts all places of the base phrases, ``first_word`` and
    ``last_word`` are the smallest and largest start among them.  ``score`` is 1
    with a base phrase, else the largest share of a template's words at their
    places, else 0.  Null and empty texts have no words, long ones are read whole;
    repeated rows and null ids stay; an empty table gives no rows.  Other columns are
    not read, so their names do not matter.
    """
    rows = materialise(indexed(docs))
    n_docs = rows.count()
    counted = rows.select(F.explode("present").alias("word")).groupBy("word").count().collect()  # licence words only
    seen = {r["word"]: r["count"] for r in counted}
    idf = {w: math.log((n_docs + 1) / (seen.get(w, 0) + 1)) for w in vocabulary()}
    anchors = sorted({rarest(key, idf)[0][0] for *_, key in all_templates()})
    found = found_templates(rows.where("words is not null").select("row", "words"), template_index(docs.sparkSession, idf), anchors)
    base = F.col("base")
    sure = base | (F.col("share") >= LEAST_SHARE)
    by_row = found.groupBy("row").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_labels"), F.collect_set(F.when(sure, F.col("label"))).alias("labels"),  # as many as there are labels
        F.max(F.when(base, F.lit(1.0)).when(F.col("share") >= LEAST_SHARE, F.col("share"))).alias("score"),
    )
    joined = lambda labels: F.coalesce(F.array_join(F.array_sort(labels), ","), F.lit(""))
    return rows.select("row", "doc_id", "n_words").join(by_row, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        joined("base_labels").alias("base_labels"), joined("labels").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
