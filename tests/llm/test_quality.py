import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagequarry.llm import quality as Q
from pagequarry.llm.common import fold


def test_features_match_a_plain_count():
    texts = ["One two, three. Four!\nOne two", "", None, "x | y | 99%", "é" * 10 + " word word"]
    got = Q.batch_features(pa.array(texts, pa.string()))
    for x, t in zip(got, texts):
        t = t or ""
        words, raw = t.split(), t.encode()
        f = dict(zip(Q.FEATURES, x))
        assert np.isclose(f["words"], np.log1p(len(words))) and np.isclose(f["bytes"], np.log1p(len(raw)))
        assert np.isclose(f["digits"], sum(c in b"0123456789" for c in raw) / max(1, len(raw)))
        assert np.isclose(f["different_words"], len(set(words)) / max(1, len(words)))
        assert np.isclose(f["mean_word"], np.mean([len(w.encode()) for w in words]) if words else 0)
        lines = [x for x in t.splitlines(keepends=True)]
        assert np.isclose(f["different_lines"], len(set(lines)) / max(1, len(lines)))


def test_learns_main_effects_and_interactions():
    random = np.random.default_rng(0)
    x = random.normal(size=(4000, len(Q.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = Q.fit(x[:3000], y[:3000])
    assert ((Q.score(model, x[3000:]) >= 0.5) == y[3000:]).mean() > 0.85
    assert any(set(p[:2]) == {0, 1} for p in model["pairs"])


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = Q.train(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    held = Q.classify(docs, model, into="s").join(labels.select("doc_id", "quality"), "doc_id").where(fold(F.col("doc_id"), 3) == 1)
    assert held.where("(s >= 0.5) = (quality = 1)").count() >= 0.97 * held.count()
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a b " * 50_000), (2, "")], "doc_id long, text string")
    scores = [r["quality_score"] for r in Q.classify(odd, model).orderBy("doc_id").collect()]
    assert all(0 <= s <= 1 for s in scores) and scores[0] == scores[1] == scores[2]


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert Q.classify(docs, Q.train(docs, labels)).first()["quality_score"] == 0.5
    assert Q.classify(docs.limit(0), Q.train(docs.limit(0), labels)).count() == 0


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", "k", 2.0, "l"), (2, None, "k", 2.0, "l")], "doc_id long, text string, id string, quality_score double, y string")
    labels = spark.createDataFrame([(1, 1, 3.0), (2, 0, 3.0)], "doc_id long, quality int, y double")
    model = Q.train(docs, labels)
    beside = Q.classify(docs, model, into="s")
    assert beside.columns == [*docs.columns, "s"] and beside.where("quality_score = 2 AND id = 'k' AND s BETWEEN 0 AND 1").count() == 2
    assert Q.classify(docs, model).where("quality_score = 2").count() == 0
