import hashlib
import re

from pyspark.sql import functions as F

from meetpoint.llm import mixing


def plain(rows, share=1.5, cap=2.0, weights=(5, 2, 1)):
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in sources}
    weight = {s: weights[i % 3] for i, s in enumerate(sources)}
    target, free, left = {}, set(sources), share * sum(size)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > cap * total[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        for s in over:
            target[s] = cap * total[s]
            left -= target[s]
        free -= over
    out = []
    for s in sources:
        budget = int(target[s] + 0.5)
        epochs = budget // total[s] if total[s] else 0
        rest = budget - epochs * total[s]
        key = lambda i: int(hashlib.md5(f"mix:{'' if rows[i][0] is None else rows[i][0]}:{rows[i][1] or ''}".encode()).hexdigest()[:15], 16)
        for i in sorted((i for i in range(len(rows)) if rows[i][2] == s), key=key):
            extra = max(0, min(size[i], rest))
            rest -= extra
            out.append((rows[i][0], size[i], total[s], round(target[s], 6), epochs * size[i] + extra))
    return sorted(out, key=str)


def test_equals_plain_mix(spark):
    rows = [(i, "w " * (i * 37 % 91), ("hot" if i % 3 else f"s{i % 11}") if i % 17 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("KEY", F.lit("clash")).repartition(5)
    got = mixing.mix_sources(docs, bucket_rows=16).select("doc_id", "size", "source_size", F.round("target", 6).alias("t"), "taken")
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y z", None), (None, "x y z", None), (3, "é e f\x0bg", "é"), (3, "é e f\x0bg", "é"), (4, "w " * 60_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    for s in (None, "a", "b", "é"):
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 0.5
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    blank = mixing.mix_sources(spark.createDataFrame([(1, " ", "a")], "doc_id long, text string, source string")).first()
    assert (blank.size, blank.taken) == (0, 0)


def test_budgets_are_met_without_ids_and_with_odd_names(spark):
    rows = [(None, "one", "a") for _ in range(2500)] + [(None, f"w{i}", "b") for i in range(500)] + [(7, "x", None) for _ in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    odd = docs.withColumns({c: F.lit(c) for c in ("s", "cut_key", "cut_words", "KEY", "row", "Rank", "a.b")})
    got = mixing.mix_sources(odd)
    assert {"s", "cut_key", "cut_words", "KEY", "row", "Rank", "a.b"} <= set(got.columns)
    first = sorted((r.source, r.taken) for r in got.na.fill("-").collect())
    assert len(first) == len(rows)
    sums = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("taken").alias("most")).collect()
    assert all(abs(r.taken - r.target) <= 0.5 and r.most <= 2 for r in sums)
    assert first == sorted((r.source, r.taken) for r in mixing.mix_sources(odd.repartition(3)).na.fill("-").collect())
