import numpy as np
from pyspark.sql import functions as F

from chronolex.llm import language_id as L
from chronolex.llm.common import held_out

from .helpers import SF, awkward, clashing


def grams(text):
    data = (" " + L.BLANKS.sub(" ", text.lower()) + " ").encode()
    return {data[i : i + n] for n in range(1, L.MAX_N + 1) for i in range(len(data) - n + 1)}


def test_kernel_is_the_n_gram_overlap():
    texts = ["the cat sat", "the  Cat sat on the mat", "voilà l'été", ""]
    k = L.kernel(*[L.presence(texts)] * 2)
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            x, y = grams(a), grams(b)
            assert abs(k[i, j] - len(x & y) / np.sqrt(len(x) * len(y))) < 0.03  # bins may collide


def test_batches_do_not_matter():
    texts = [r * n for r, n in (("das ist gut ", 3), ("this is it ", 40), ("é", 1), ("", 1))]
    together = L.presence(texts)
    assert all((together[i] == L.presence([t])[0]).all() for i, t in enumerate(texts))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    got = L.digest(docs).join(docs.select("doc_id", "lang"), "doc_id")
    share = got.filter("held_out AND lang IS NOT NULL").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share >= 0.98
    assert got.agg(F.min("score"), F.max("score")).first()[0] >= 0


def test_nothing_is_learnt_from_the_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    other = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in L.digest(d).collect()} for d in (docs, other))
    assert a == b


def test_awkward_rows(spark):
    docs = clashing(awkward(spark, [(1, "1234 !!"), (2, "das Haus"), (3, "the house")]))
    got = {r.doc_id: r for r in L.digest(docs).collect()}
    assert L.digest(docs).count() == docs.count()
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1, 900, 901, 904))
    assert got[902].lang_pred == "en"
    assert not got[None].held_out
    assert L.digest(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in L.digest(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_no_letter_is_undetermined(spark):
    from .helpers import documents

    docs = documents(spark, [(1, "½ ²"), (2, "①②"), (3, "Ⅷ 〇"), (4, "１２"), (5, "x½"), (6, "文"), (7, "́̈"), *[(10 + k, "das ist ein Haus") for k in range(8)]])
    got = {r.doc_id: r.lang_pred for r in L.digest(docs).collect()}
    assert [got[k] for k in range(1, 8)] == ["und"] * 4 + ["en", "en", "und"]


def test_a_language_of_long_texts_only_is_learnt(spark):
    from .helpers import documents

    short = [(k, f"the house number {k} and the garden", "en", "s", 0) for k in range(30)]
    long = [(100 + k, "zażółć gęślą jaźń, dom i ogród " * 4000, "pl", "s", 0) for k in range(12)]
    got = {r.doc_id: r for r in L.digest(documents(spark, short + long + [(999, "dom i ogród gęślą", None, None, 0)])).collect()}
    assert all(got[100 + k].lang_pred == "pl" for k in range(12)) and got[999].lang_pred == "pl" and got[3].lang_pred == "en"


def test_all_landmarks_give_exact_kernel_ridge():
    """With every text a landmark the Nystroem features are exact, so values equal those of the dual solution."""
    rng = np.random.default_rng(3)
    words = {"a": "alpha beta gamma the and".split(), "b": "uno due tre che non".split(), "c": "eins zwei drei und nicht".split()}
    langs = [k for k in words for _ in range(9)]
    texts = [" ".join(rng.choice(words[k], 5)) + f" {i}" for i, k in enumerate(langs)]
    model = L.Model(texts, langs)
    x = L.presence(texts)
    y = np.where(np.array(langs)[:, None] == np.array(sorted(words)), 1.0, -1.0)
    k = L.kernel(x, x).astype(np.float64)
    alpha = np.linalg.solve(k + L.RIDGE * 9 * np.eye(len(texts)), y - y.mean(0))
    new = ["the alpha and", "tre che", "drei nicht uno", "zwei"]
    exact = L.kernel(L.presence(new), x) @ alpha + y.mean(0)
    rows = L.presence(new).astype(np.float32)
    values = (rows @ model.weights) / np.sqrt(rows.sum(1))[:, None] + model.bias
    assert np.abs(values - exact).max() < 1e-3
    assert [model.labels[k] for k in L.scores(new, model.weights, model.bias)[0]] == [sorted(words)[k] for k in exact.argmax(1)]
