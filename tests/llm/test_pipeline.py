from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from meetpoint.llm import decontaminate, langid, secrets

from test_similar import plain_groups

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
def test_stages_against_the_operators(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    extra = docs.where("doc_id in (1, 2)").withColumn("doc_id", F.col("doc_id") + 1_000_000)
    extra = extra.withColumn("text", F.concat(F.lit("secret = Zx81kq0PPx "), F.reverse("text")))
    docs = docs.union(extra)
    names = docs.columns
    now = docs
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, DATA).write.parquet(f"{tmp_path}/{k}")
        new = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert new.columns == names
        seen.append((now, new))
        now = new
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    before, after = seen[0]
    marked = langid.identify(before, langid.train(before)).collect()
    assert ids(after) == {r.doc_id for r in marked if r.lang_pred != "und" and r.score >= 0.3}
    before, after = seen[1]
    rows = before.orderBy("doc_id").collect()
    label = plain_groups([r.text for r in rows])
    assert ids(after) == {rows[k].doc_id for k in set(label)} and len(set(label)) < len(rows)
    before, after = seen[2]
    bad = ids(decontaminate.find_contamination(before, spark.read.parquet(f"{DATA}/benchmark.parquet")))
    assert bad and ids(after) == ids(before) - bad
    before, after = seen[3]
    found = {r.doc_id: sorted((s.start, s.stop) for s in r.found) for r in secrets.find_secrets(before).collect()}
    texts = {r.doc_id: r.text for r in before.collect()}
    assert any(found.values())
    for r in after.collect():
        assert r.text == secrets.redact(texts[r.doc_id], found[r.doc_id], "[SECRET]") and r.n_chars == len(r.text)
    before, after = seen[4]
    sums = after.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 1 for r in sums)
    assert after.where("taken > 2 * size").isEmpty()


def test_odd_rows_through_all_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    texts = [None, "", "   ", "12 34", "the same text for a few of the rows here and there", "the same text for a few of the rows here and there", "mot " * 50_000]
    odd = spark.createDataFrame([(None if i % 2 else 9_000_000 + i, t, None, None, None) for i, t in enumerate(texts)], docs.schema)
    names = {c: F.lit(1) for c in ("s", "Score", "LANG_PRED", "__hash", "text_hash", "cut_key", "row", "key", "node", "component")}
    now = docs.unionByName(odd).unionByName(odd).withColumns(names)
    given = now.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, DATA).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert set(given) <= set(now.columns) and now.count() > 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0
