import hashlib

import numpy as np
from pyspark.sql import functions as F

from meetpoint.llm import fim
from meetpoint.llm.queries import op13_fim


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by slices of the text."""
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_units_are_found_at_every_place():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("aé€😀 ́"), n)) for n in (0, 1, 7, 8, 9, 0, 63, 64, 65, 200, 0)]
    data = [t.encode() for t in texts]
    units = fim.Units(np.frombuffer(b"".join(data), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in data]))))
    assert units.counts().tolist() == [len(t) for t in texts]
    for d, t in enumerate(texts):
        cuts = units.cut(np.full(len(t) + 1, d), np.arange(len(t) + 1))
        assert cuts.tolist() == [int(units.offsets[d]) + len(t[:k].encode()) for k in range(len(t) + 1)]


def test_equals_plain_form_and_is_restored(spark):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("ab <>PSMé€😀\n"), rng.integers(0, 60))) for _ in range(400)]
    texts += [None, "", "x", "<", "<P", "<M>", "a<S>b", "<P<S", "é" * 300_000, "same", "same"]
    rows = [(k if k % 50 else None, t, "x", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int").repartition(3)
    got = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: (str(r[0]), str(r[1:]))
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=key) == sorted(((i, *plain(i, t)) for i, t, *_ in rows), key=key)
    assert sorted(r.back for r in got) == sorted(t or "" for t in texts)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_blocks_of_one_batch_agree(spark, monkeypatch):
    texts = [f"é{k}" * (k % 7) for k in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    assert sorted((r.doc_id, r.output) for r in fim.fill_in_middle(docs).collect()) == [(k, plain(k, t)[4]) for k, t in enumerate(texts)]
    assert list(fim.byte_blocks(np.array([0, 3, 3, 9, 10]), 4)) == [(0, 2), (2, 3), (3, 4)]
    assert list(fim.byte_blocks(np.array([0]), 4)) == []


def test_broken_utf8_comes_back(spark):
    docs = spark.sql("select id as doc_id, cast(unhex('8041C3E28281FF80') as string) as text from range(40)")
    back = fim.fill_in_middle(docs).select(F.hex(fim.restored(F.col("output"), F.col("form")).cast("binary")).alias("x"))
    assert {r.x for r in back.collect()} == {"8041C3E28281FF80"}


def test_query(spark, tmp_path):
    texts = [None, "", "ä b c", "<P> there"] + [f"{k} é word" * k for k in range(30)]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op13_fim(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for k, t in enumerate(texts):
        n, form, prefix, middle, output = plain(k, t)
        r = got[k]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, prefix, middle, sha(output), sha(t or ""))
