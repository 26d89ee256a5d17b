"""The factorization machine against sums over all pairs, an interaction that weights alone can't say, and held-out texts."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagequarry.llm import toxicity
from pagequarry.llm.common import fold
from pagequarry.llm.queries import op12_toxicity

SF = "/root/testdata/sf0.01"


def test_margin_is_the_sum_over_all_pairs():
    rng = np.random.default_rng(0)
    model = {"intercept": 0.3, "weights": rng.normal(size=20), "vectors": rng.normal(size=(20, 4))}
    texts = [rng.choice(20, n, replace=False) for n in (0, 1, 5, 12, 0)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = toxicity.margin(model, offsets, np.concatenate(texts).astype(np.int64))
    for value, t in zip(got, texts):
        pairs = sum(model["vectors"][i] @ model["vectors"][j] for k, i in enumerate(t) for j in t[k + 1 :])
        assert np.isclose(value, 0.3 + model["weights"][t].sum() + pairs)


def test_terms_of_a_text():
    words = ["insult", "Insult", "a", "groups!", "ünïcode", "..."]
    texts = pa.array([" ".join(words), None, "", "insult insult", "x" * 100_000])
    found = {}
    for first, text, term in toxicity.distinct(texts):
        for t, h in zip(text, term):
            found.setdefault(first + t, []).append(h)
    assert len(found[0]) == len(set(found[0])) == 4 + 2 + 2 + 3 and len(found[3]) == 3 and len(found[4]) == 4 and 1 not in found and 2 not in found
    offsets, places = toxicity.active(texts, np.unique(np.array(found[3])))
    assert np.diff(offsets).tolist() == [3, 0, 0, 3, 0] and sorted(places[:3]) == [0, 1, 2]


def test_pairs_say_what_weights_cannot():
    """Toxic is the insult with the group; each alone is as often harmless."""
    rng = random.Random(2)
    rows = [[w for w, p in (("a", 0.5), ("b", 0.5), ("c", 0.5), ("d", 0.5)) if rng.random() < p] for _ in range(2000)]
    y = np.array([("a" in r) != ("b" in r) for r in rows], float)  # not a threshold of any sum of weights
    place = {w: k for k, w in enumerate("abcd")}
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    places = np.array([place[w] for r in rows for w in r])
    model = toxicity.fit(offsets, places, y, np.arange(4), epochs=40)
    assert ((toxicity.margin(model, offsets, places) > 0) == (y == 1)).mean() > 0.99
    flat = model | {"vectors": np.zeros_like(model["vectors"])}
    assert ((toxicity.margin(flat, offsets, places) > 0) == (y == 1)).mean() < 0.9


def test_held_out_texts(spark):
    """Of the labelled texts that training has not seen, most toxic ones are found and harmless ones left alone."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op12_toxicity(spark, SF).join(labels, "doc_id").where("held_out").collect()
    toxic, harmless = [r["predicted"] for r in rows if r["toxic"] == 1], [r["predicted"] for r in rows if r["toxic"] == 0]
    assert np.mean(toxic) >= 0.7 and np.mean(harmless) <= 0.02


def test_held_out_labels_are_not_used(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    one = toxicity.train(docs, labels.where(fold(F.col("doc_id"), 3) != 1))
    turned = labels.withColumn("toxic", F.when(fold(F.col("doc_id"), 3) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = toxicity.train(docs, turned.where(fold(F.col("doc_id"), 3) != 1))
    assert np.array_equal(one["vocabulary"], other["vocabulary"]) and np.array_equal(one["vectors"], other["vectors"])


def test_hostile_rows(spark):
    docs = spark.createDataFrame([(1, "you scum"), (1, "you scum"), (1, "other"), (2, None), (None, "x"), (3, ""), (4, "scum " * 200_000)], "doc_id long, text string").withColumn("score", F.lit("mine")).withColumn("id", F.lit(0))
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1), (3, None), (4, 1), (9, 0)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0)):
        model = toxicity.train(docs, given)
        scores = [r["score"] for r in toxicity.classify(docs, model, into="score").collect()]
        assert len(scores) == 7 and all(0 <= s <= 1 for s in scores) and (given is labels or set(scores) == {0.5})
    assert toxicity.classify(docs.limit(0), model).count() == 0
