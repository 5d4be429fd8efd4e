"""The pipeline's stages against what they should keep."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from veritext.llm import registry


def tables(spark, folder):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    good = [text(rng.randint(60, 150)) for _ in range(300)]
    junk = [f"{word()} " * 60 for _ in range(60)]
    leak = text(30)
    near = good[0].split()
    near[5] = "changed"
    rows = good + junk + [good[1].upper(), good[2], " ".join(near), text(40) + " " + leak + " " + text(40)]
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(rows)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i < 300), 0) for i in range(360)], "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages(spark, tmp_path):
    docs = tables(spark, str(tmp_path))
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "jaccard_join", "decontamination", "sentencepiece"]
    left = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        at = stage(spark, at, str(tmp_path))
        if k < 4:
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            at.write.parquet(f"{tmp_path}/stage{k}")
            at = spark.read.parquet(f"{tmp_path}/stage{k}")
        left.append({r.doc_id for r in at.select("doc_id").collect()})
    quality, exact, near, clean, tokens = left
    assert len(quality & set(range(300, 360))) <= 2 and len(quality & set(range(300))) >= 297
    assert exact == quality - ({2} if 361 in quality else set()) - ({1} if 360 in quality else set())
    assert exact - near == {362} and near - clean == {363} and tokens == clean
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == tokens
    assert len(docs) == 364


def test_awkward_rows(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, whole rows that repeat, further columns: each decision is about its own row."""
    tables(spark, str(tmp_path))
    leak = spark.read.parquet(f"{tmp_path}/benchmark.parquet").first().text
    base = spark.read.parquet(f"{tmp_path}/documents.parquet")
    fresh = lambda k: " ".join(f"{chr(97 + (k * 7 + i * i) % 26)}{chr(97 + (i * k) % 26)}{chr(97 + (i // 5 + k) % 26)}" for i in range(90))
    odd = [(None, fresh(1)), (None, fresh(1)), (None, fresh(2)), (900, fresh(3)), (900, f"{fresh(4)} {leak}"), (900, fresh(3)), (None, None), (901, ""), (902, "long " + " ".join(fresh(k) for k in range(40, 400)))]
    more = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in odd], base.schema)
    docs = base.unionByName(more).withColumn("rep", F.lit("own")).withColumn("stays", F.col("doc_id"))
    docs.write.mode("overwrite").parquet(f"{tmp_path}/all")
    at = spark.read.parquet(f"{tmp_path}/all")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
        at.write.parquet(f"{tmp_path}/odd-{name}")
        at = spark.read.parquet(f"{tmp_path}/odd-{name}")
    left = [(r.doc_id, r.text) for r in at.where("doc_id IS NULL OR doc_id >= 900").collect()]
    assert sorted(left, key=str) == sorted([(None, fresh(1)), (None, fresh(2)), (900, fresh(3)), (901, ""), odd[8]], key=str)
    assert all(r.rep == "own" and r.stays == r.doc_id for r in at.collect())


def test_empty_documents(spark, tmp_path):
    tables(spark, str(tmp_path))
    spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none")
    at = spark.read.parquet(f"{tmp_path}/none")
    for _, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, str(tmp_path))
        assert at.count() == 0


def test_registry():
    names = registry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names)
