"""Counts and scores against loops over all phrases, and the query against its SQL."""

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from pagequarry.llm import phrases
from pagequarry.llm.queries import ORACLES, op13_phrases

SCHEMA = "doc_id long, text string, lang string, n long, phrase string"


def plain(rows: list[tuple], least: int, per_lang: int, covered: int = 80) -> set[tuple]:
    f, n = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    longest = Counter()
    for (lang, w), a in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longest[lang, w[i : i + k]] = max(longest[lang, w[i : i + k]], a)
    kept = []
    for (lang, w), a in found.items():
        if (lang, w) in longest and 100 * longest[lang, w] >= covered * a:
            continue
        score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
        kept.append((lang, score, a, " ".join(w), f[lang, w[:k]], f[lang, w[k:]]))
    out = set()
    for lang in n:
        own = sorted((r for r in kept if r[0] == lang), key=lambda r: (-r[1], -r[2], r[3].encode()))[:per_lang]
        out |= {(lang, i, phrase, a, left, right, n[lang], score) for i, (_, score, a, phrase, left, right) in enumerate(own, 1)}
    return out


def made(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    words = ["The", "the", "of", "ÀB", "àb", "x", "new", "york", "city", "co-op", "1"]
    rows = []
    for i in range(80):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " \r"]) for _ in range(rng.randrange(0, 120)))
        rows.append((i, text, rng.choice(["en", "fr", None]), 5, "mine"))
    return rows + [(1, None, "en", 1, "x"), (None, "", None, None, None), (2, "new york city hall " * 30, "en", 1, None), (2, "new york city hall " * 30, "en", 1, None), (3, "w" * 300_000, "de", 0, "")]


@pytest.mark.parametrize("seed, least, per_lang", [(1, 5, 2000), (2, 3, 7), (3, 30, 2000)])
def test_against_loops(spark, seed, least, per_lang):
    rows = made(seed)
    for bits in (None, 17):
        got = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3), least=least, per_lang=per_lang, bits=bits)
        assert {tuple(r) for r in got.collect()} == plain(rows, least, per_lang)


def test_a_full_sketch_loses_nothing(spark, monkeypatch):
    """With 64 counters for everything no prefix is ruled out, and tasks hand windows on early."""
    monkeypatch.setattr(phrases, "BLOCK_BITS", 4)
    rows = made(4)
    got = phrases.collocations(spark.createDataFrame(rows, SCHEMA).repartition(2), least=4, bits=6)
    assert {tuple(r) for r in got.collect()} == plain(rows, 4, 2000)


def test_counts_beyond_64_bits(spark):
    """2 000 000 times a count passes 64 bits without an error."""
    big = 6_000_000_000_000_000_000
    above, below = (F.lit(big).cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(8,0)")).alias("above"), (F.lit(big).cast("decimal(20,0)") + F.lit(big).cast("decimal(20,0)")).alias("below")
    assert spark.range(1).select(above, below).selectExpr("above div below AS score").first()[0] == 1_000_000


def test_empty_table(spark):
    assert phrases.collocations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.001"
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = duck.sql(ORACLES["op13_phrases"])
    got = op13_phrases(spark, sf)
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())
