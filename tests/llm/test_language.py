import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from pagequarry.llm import language

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, language string"
EN = "the cat sat on the mat and the dog ran after the ball in the park "
FR = "le chat est sur la table et le chien court dans le jardin avec une balle "


def rows(*texts):
    return [(k, t, None, "s", 0, "clash") for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def training(spark):
    return spark.createDataFrame([(k, t * 4, lang, "s", 0, "") for k, (t, lang) in enumerate([(EN, "en"), (FR, "fr")] * 4)], SCHEMA)


def brute(model_texts, text):
    """Bits of text under PPM with escape method C over up to three bytes of context, straight from the definition."""
    counts = [defaultdict(Counter) for _ in range(4)]
    for t in model_texts:
        raw = b"   " + t.encode()
        for i in range(3, len(raw)):
            for k in range(4):
                counts[k][raw[i - k : i]][raw[i]] += 1
    raw, bits = b"   " + text.encode(), 0.0
    for i in range(3, len(raw)):
        for k in range(3, -2, -1):
            if k < 0:
                bits += 8
                break
            seen = counts[k].get(raw[i - k : i])
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if raw[i] in seen:
                bits -= math.log2(seen[raw[i]] / total)
                break
            bits -= math.log2(len(seen) / total)
    return bits


def test_code_lengths_are_exact(training):
    costs = language.Costs(language.train(training))
    for text in ("the dog", "chien", "zz\tqq é", "a"):
        raw = np.frombuffer(text.encode(), np.uint8)
        got = costs.lengths(raw, np.array([0, len(raw)]))[0]
        for lang, sample in enumerate(([EN * 4] * 4, [FR * 4] * 4)):
            assert got[lang] == pytest.approx(brute(sample, text), rel=1e-4)


def test_predictions_and_odd_rows(spark, training):
    docs = spark.createDataFrame(rows("the ball in the park", "le chien court", None, "", "123 --", "the ball in the park", EN * 20_000), SCHEMA)
    got = {r["doc_id"]: r["language"] for r in language.identify(docs, training).collect()}
    assert [got[k]["lang"] for k in range(7)] == ["en", "fr", "und", "und", "und", "en", "en"]
    assert got[0] == got[5] and all(0 <= x["score"] <= 1 for x in got.values())


def test_empty_tables(spark, training):
    nothing = training.limit(0)
    assert language.identify(nothing, training).count() == 0
    assert {r["language"]["lang"] for r in language.identify(training, nothing).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs, language.training_rows(docs)).where(language.fold(docs["doc_id"], 5) == 0)
    assert found.where("language.lang = lang").count() >= 0.98 * found.count()
