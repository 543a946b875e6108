import random

import numpy as np
from pyspark.sql import functions as F

from meetpoint.llm import langid

SYLLABLES = {"aa": "the and ing tion er of wh sh", "bb": "ich und sch heit für über ä ver", "cc": "eaux le une è que ré oi pa"}


def corpus(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        parts = SYLLABLES[lang].split()
        words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 200))]
        rows.append((i, " ".join(words), lang))
    return rows


def test_windows_cover_the_text():
    text = bytes(range(256)) * 2 + b"abc"
    windows, counts = langid.cut([text, b"", b"xy"])
    assert counts.tolist() == [3, 1, 1]
    assert windows[:2].tobytes() == text[:512] and windows[2].tobytes() == text[-langid.WINDOW :]
    assert windows[4].tobytes().rstrip() == b"xy"


def test_pair_tables_equal_the_plain_network():
    rng = np.random.default_rng(0)
    windows = rng.integers(0, 256, (8, langid.WINDOW), dtype=np.uint8)
    net = langid.fit(windows, np.array([0, 1] * 4), ["a", "b"], epochs=1)
    got = langid.window_probabilities(net, windows)
    assert np.allclose(got.sum(axis=1), 1, atol=1e-5)
    # A filter of width 2 sees its own pair only: later tables are zero for it.
    assert not net.tables[1][:, : langid.FILTERS].any() and not net.tables[2][:, : 2 * langid.FILTERS].any()
    assert net.tables[2][:, 2 * langid.FILTERS :].any()


def test_held_out_accuracy_and_rules(spark):
    rows = corpus(600)
    odd = [(600, None, "aa"), (601, "", "aa"), (602, "12 34 !!", "bb"), (603, "the and " * 20_000, None), (None, "ich und für", "bb"), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = langid.identify_languages(docs, sample=900)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = got.collect()
    assert len(found) == 606
    by = {r.doc_id: r for r in found}
    import zlib

    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0) for r in found)
    held = [(by[i].lang_pred == lang) for i, _, lang in rows if by[i].held_out]
    assert np.mean(held) > 0.95
    assert [by[i].lang_pred for i in (600, 601, 602, 603)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in found)
    kept = langid.keep_identified(docs, sample=900)
    assert kept.columns == docs.columns
    assert {600, 601, 602}.isdisjoint(r.doc_id for r in kept.collect())
    assert langid.identify_languages(docs.limit(0)).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string")).where("doc_id in (1, 600)")
    assert sorted(r.lang_pred for r in langid.identify_languages(unlabelled).collect()) == ["und", "und"]


def test_predictions_equal_a_plain_loop(spark):
    """Windows, filters, pooling and softmax, one byte after another."""
    rng = random.Random(8)
    rows = corpus(40, 5)
    windows = np.stack([langid.cut([t.encode()])[0][0] for _, t, _ in rows])
    classes = sorted(SYLLABLES)
    net = langid.fit(windows, np.array([classes.index(lang) for *_, lang in rows]), classes, epochs=1)
    texts = [rows[0][1], "ich", "é" * langid.WINDOW, "".join(rng.choice("abc ü") for _ in range(2 * langid.WINDOW + 5))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(docs, net).collect()}
    width = len(net.tables)
    for k, text in enumerate(texts):
        data = text.encode()
        starts = [*range(0, len(data) - langid.WINDOW + 1, langid.WINDOW)]
        parts = [data[a : a + langid.WINDOW] for a in starts]
        if len(data) % langid.WINDOW or not data:
            parts.append(data[-langid.WINDOW :].ljust(langid.WINDOW))
        mean = np.zeros(len(classes))
        for part in parts:
            pairs = langid.as_pairs(np.frombuffer(part, np.uint8)[None])[0].tolist()
            pooled = [-np.inf] * len(net.bias)
            for at in range(len(pairs) - width + 1):
                for f in range(len(pooled)):
                    pooled[f] = max(pooled[f], sum(float(net.tables[j][pairs[at + j], f]) for j in range(width)))
            hidden = [max(0.0, x + b) for x, b in zip(pooled, net.bias, strict=True)]
            z = np.array([sum(h * w for h, w in zip(hidden, net.weights[:, c], strict=True)) + net.offsets[c] for c in range(len(classes))])
            mean += np.exp(z - z.max()) / np.exp(z - z.max()).sum() / len(parts)
        assert got[k].lang_pred == classes[int(mean.argmax())]
        assert abs(got[k].score - mean.max()) < 1e-3
