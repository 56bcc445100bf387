import numpy as np
from pyspark.sql import functions as F

from chronolex.llm import quality_classifier as C
from chronolex.llm.common import held_out

from .helpers import SF, awkward, clashing, documents


def read(spark, name, sf="0.01"):
    return spark.read.parquet(f"{SF.replace('0.001', sf)}/{name}.parquet")


def test_score_is_the_average_of_feature_logits():
    logits = np.random.default_rng(1).normal(size=C.BUCKETS).astype(np.float32)
    texts = ["a bb ccc bb bb", "", None, "één twee één", "x" * 5000]
    got = C.Batch(texts).score(logits, 0.3)
    for t, s in zip(texts, got, strict=True):
        ids, share = C.text_features(t or "")
        want = 1 / (1 + np.exp(-(share @ logits[ids] + 0.3))) if len(ids) else C.EMPTY_SCORE
        assert abs(s - want) < 1e-6


def test_held_out_accuracy(spark):
    docs, labels = read(spark, "documents", "0.1"), read(spark, "labels", "0.1")
    got = C.digest(docs, labels).join(labels, "doc_id").filter("held_out")
    share = got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert share >= 0.97
    assert got.filter("quality = 1").agg(F.avg("predicted")).first()[0] >= 0.98


def test_nothing_is_learnt_from_the_held_out(spark):
    docs, labels = read(spark, "documents", "0.001"), read(spark, "labels", "0.001")
    other = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in C.digest(docs, x).collect()} for x in (labels, other))
    assert a == b


def test_awkward_rows(spark):
    docs = clashing(awkward(spark, [(1, "good words here"), (3, "### $$$ %%%")]))
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (3, 0, 1), (None, 1, None), (4, None, None)], "doc_id long, quality int, toxic int")
    got = C.digest(docs, labels)
    assert got.count() == docs.count()
    assert all(r.score == C.EMPTY_SCORE and r.predicted == 0 for r in got.collect() if r.doc_id in (900, 901, 904))
    assert C.digest(docs.limit(0), labels).count() == 0
    assert {r.score for r in C.digest(docs, labels.limit(0)).collect()} <= {0.5, C.EMPTY_SCORE}


def test_labels_of_long_texts_only_are_learnt(spark):
    texts = [(k, ("fine plain prose here " if k % 2 else "### buy $$$ now ### ") * 4000) for k in range(60)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in C.digest(documents(spark, texts), labels).collect()}
    assert all((got[k] > 0.5) == (k % 2 == 1) for k in range(60))
