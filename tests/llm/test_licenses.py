import random
import re

from pyspark.sql import functions as F

from meetpoint.llm import licenses


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += hits
        labels |= {label} if hits else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_equals_plain_search(spark):
    rng = random.Random(6)
    bits = ["under", "the", "MIT", "license", "Apache", "License,", "version", "2.0", "CC", "BY-NC", "by", "nc", "über", "x_y", "Kelvin", "zz"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += [None, "", "!!", "cc by nc " * 3000, "Released under the MIT License. Licensed under the Apache License, Version 2.0. CC BY-NC 4.0.", "cc by", "under the mit licenses", "CC BY-NC"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0]), (None, "cc by nc")], "doc_id long, text string").withColumn("words", F.lit(1)).repartition(4)
    got = licenses.find_licenses(docs).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = plain(texts[r.doc_id] if r.doc_id is not None else "cc by nc")
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want, texts[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
        assert 0 <= r.score <= 1 and (r.score == 1 or not r.n_base)


def test_method_finds_changed_notices(spark):
    rows = [
        (1, "This work is licensed under the GNU General Public License, version 3."),
        (2, "x y this software is licensed under GNU General Public License version 3"),
        (3, "Permission is hereby granted, free of charge, to any person obtaining a copy"),
        (4, "the general public has a license to walk under the version 3 bridge"),
        (5, "public license gnu general version 3 this work is licensed under the"),
        (6, "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ]
    got = {r.doc_id: r for r in licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].labels for i in range(1, 7)] == ["gpl-3", "gpl-3", "mit", "", "", "bsd"]
    assert got[1].score == 1.0 and 0.5 <= got[2].score < 1 and got[4].score == 0


def test_empty(spark):
    assert licenses.find_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_method(text):
    """Labels and score by trying every template at every place."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    labels, score = set(), 0.0
    for label, base, phrase, key in licenses.all_templates():
        key_at = next(i for i in range(len(phrase)) if phrase[i : i + len(key)] == key)
        for i in range(len(words)):
            if words[i : i + len(key)] == key:
                first = i - key_at
                share = sum(0 <= first + k < len(words) and words[first + k] == w for k, w in enumerate(phrase)) / len(phrase)
                if base or share >= licenses.LEAST_SHARE:
                    labels.add(label)
                    score = max(score, 1.0 if base else share)
    return ",".join(sorted(labels)), score


def test_labels_equal_a_search_of_all_places(spark):
    rng = random.Random(9)
    pool = [" ".join(phrase) for _, _, phrase, _ in licenses.all_templates()] + [" ".join(key) for *_, key in licenses.all_templates()]
    noise = licenses.vocabulary() + ["bridge", "walk"]
    texts = []
    for _ in range(250):
        words = []
        for _ in range(rng.randint(0, 4)):
            part = rng.choice(pool).split()
            for _ in range(rng.choice([0, 0, 0, 1, 3, 8])):
                part[rng.randrange(len(part))] = rng.choice(noise)
            words += [rng.choice(noise) for _ in range(rng.randint(0, 6))] + part[rng.choice([0, 0, 3]) :]
        texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = 0
    for r in licenses.find_licenses(docs).collect():
        labels, score = plain_method(texts[r.doc_id])
        assert r.labels == labels and abs(r.score - score) < 1e-12, texts[r.doc_id]
        found += bool(labels)
    assert found > 100
